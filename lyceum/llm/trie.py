"""The trie of conversations by their common beginnings (operator 11).

A conversation's prefix of d turns is named by a SHA-256 chained over its turns: the root's digest is that of nothing, each
turn's is that of its parent's digest, the role and the text, their lengths ahead. Every prefix is one row; rows of equal
(depth, digest) are a node. Sums over subtrees send what a node has to its ancestors. The nodes that one
conversation represents (it is their smallest member) lie on a line that ends with it, so they are summed along this line first
and each line is exploded to its conversation's prefixes: rows grow with the prefixes, not with the square of a length.

Turns (conv_id, pos, role, text) go by pos; null roles and texts are empty, repeated rows are turns of their own. ``rebuilt`` orders
a table's rows by turn (nulls first), then role and text. Rows without a conversation id belong to none and are left out. An empty table has no
node, not even a root. Other columns are ignored. A conversation's turns and a node's members pass one task in a stream, whatever
their number: no task holds more than one turn and one block of ids.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import checkpointed, raw

PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("last_bytes", pa.int64()), ("ends", pa.bool_())])
BLOCKS = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
HASHES = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
NODE = ["depth", "digest"]
ROOT = hashlib.sha256(b"").digest()
EMPTY = ROOT.hex()
#: Characters of the ids that one row of a node's list holds.
BLOCK = 1 << 12


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, i, role, text): each conversation's turns in order, from 1."""
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return own.withColumn("i", F.row_number().over(order)).select("conv_id", "i", "role", "text")


def rebuilt(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c begins with the first h turns of c - c mod ``group`` (all if it has fewer, none if it isn't there) and goes on with its own after the first h; h is crc32(decimal c) mod ``most``."""
    turns = checkpointed(ordered(rows))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    names = turns.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"))
    # A conversation that begins with itself stays as it is, so only others meet their base's few first turns.
    heads = turns.filter(F.col("i") < most).select(F.col("conv_id").alias("base"), "i", "role", "text")
    lead = names.filter("base <> conv_id and h > 0").join(heads, "base").filter("i <= h").select("conv_id", F.col("i").alias("pos"), "role", "text")
    own = turns.withColumn("h", h.cast("int")).filter((F.col("i") > F.col("h")) | (F.pmod("conv_id", F.lit(group)) == 0)).select("conv_id", F.col("i").alias("pos"), "role", "text")
    # The place in the conversation need not be without gaps: the base may be shorter than h.
    return lead.unionByName(own), names.select("conv_id")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, pos, role, text) in order, pos 0 for the conversation itself, to rows of ``PREFIXES``."""
    last = None  # the row before, whose end the next one tells
    for b in batches:
        out = []
        for conv, pos, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), raw(b.column(3)), strict=True):
            if last is not None:
                out.append((*last, last[0] != conv))
            if pos == 0:
                last = (conv, 0, ROOT, None, 0)
            else:
                digest = hashlib.sha256(last[2] + struct.pack("<QQ", len(role), len(text)) + role + text).digest()
                last = (conv, last[1] + 1, digest, last[2], len(text))
        if out:
            yield _rows(out, PREFIXES)
    if last is not None:
        yield _rows([(*last, True)], PREFIXES)


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for every prefix of every conversation, the empty one too."""
    none = F.lit("")
    rows = turns.select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "text").unionByName(conversations.select("conv_id", F.lit(0).cast("long").alias("pos"), none.alias("role"), none.alias("text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(chained, from_arrow_schema(PREFIXES))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, conv_id) in order to rows (digest, first, ids) with the ids joined by commas, BLOCK characters or so in each."""
    node, ids, size = None, [], 0
    for b in batches:
        done = []
        for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (digest != node or size >= BLOCK):
                done.append((node, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            node = digest
            ids.append(conv)
            size += len(str(conv)) + 1
        if done:
            yield _rows(done, BLOCKS)
    if ids:
        yield _rows([(node, ids[0], ",".join(map(str, ids)))], BLOCKS)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, first, ids) in order to rows (digest, ends_sha256)."""
    node, state = None, None
    for b in batches:
        done = []
        for digest, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if digest == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((node, state.hexdigest()))
            node, state = digest, hashlib.sha256(ids.encode())
        if done:
            yield _rows(done, HASHES)
    if node is not None:
        yield _rows([(node, state.hexdigest())], HASHES)


def member_hashes(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the conversations that end at each node.

    One hash reads all ids of a node in order. Ranges of (node, id) are joined to blocks first, so that a node with very many
    members sends few rows to the task that hashes them, and that task holds one block at a time.
    """
    ends = rows.filter("ends").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    lists = ends.mapInArrow(blocks, from_arrow_schema(BLOCKS))
    return lists.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, from_arrow_schema(HASHES))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = checkpointed(prefixes(turns, conversations))
    nodes = checkpointed(rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("last_bytes").alias("last_bytes")))
    # A conversation represents its own node of every depth from its head's on.
    line = Window.partitionBy("conv_id").orderBy("depth")
    placed = nodes.withColumn("head", F.lag("depth").over(line).isNull()).withColumn("goes_on", F.lead("depth").over(line).isNotNull())
    heads = placed.filter("head and depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest"), "conv_id")
    forks = heads.groupBy(*NODE).agg(F.count("*").alias("forks"))
    own = placed.join(forks, NODE, "left").withColumn("n_children", F.coalesce("forks", F.lit(0)) + F.col("goes_on").cast("long"))
    own = checkpointed(own.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("last_bytes")).drop("forks", "goes_on"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = own.select("conv_id", *NODE, "head", F.sum("leaf").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved"))
    lines = sums.filter("head and depth > 0").select("conv_id", F.col("depth").alias("top"), "leaves", "saved")
    above = rows.select("conv_id", *NODE).join(lines, "conv_id").filter("depth < top").select(*NODE, "leaves", "saved")
    totals = sums.select(*NODE, "leaves", "saved").unionByName(above).groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # The parent of a node below a head has the same representative; a head's own is looked up.
    parents = heads.join(nodes.select(*NODE, F.col("conv_id").alias("_p")), NODE).select("conv_id", (F.col("depth") + 1).alias("depth"), "_p")
    out = own.join(totals, NODE).join(member_hashes(rows), "digest", "left").join(parents, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("_p", "conv_id"))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

