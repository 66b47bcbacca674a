"""SimHash near-duplicates by deletion-variant signatures (operator 10).

A text's fingerprint has a bit set if over half of its shingles' XXH64 values have it set.
Fingerprints that differ in at most two bits are cut into two segments of 32 bits: one of
them differs in at most one bit, so indexing each segment with each of its bits deleted (64
variants) finds every such pair by equality. Candidates are verified by the count of
differing bits, and only where the first variant that they share says so, so a link comes once.

Only distinct fingerprints are indexed; a fingerprint has at most 2,080 others within two bits,
so links grow in proportion to texts. A bucket of more than LIMIT fingerprints is not paired off in
its task: its members are indexed again with every two of the 33 remaining bits deleted, where a bucket
holds at most four. Both ways are exact.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other.
Ids that are null get the component of their fingerprint but never name one (null if all are).
Repeated rows share a fingerprint; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS_PER_TASK, add_columns, checkpointed, in_tasks, named, raw, rows_named, shuffle_partitions
from .components import components

SHINGLE = 3
SEED = 42
#: Fingerprints of a bucket that one task pairs off.
LIMIT = 4096
#: Rows that a task holds at once.
CHUNK = 1 << 18
_hash = xxhash.xxh64_intdigest


def shingles(data: bytes, k: int = SHINGLE) -> list[bytes]:
    """Word shingles of a text, repeats included; only A-Z are lowered, and only ASCII blanks part words."""
    words = data.lower().split()
    if not words:
        return []
    if len(words) < k:
        return [b" ".join(words)]
    whole = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    return [whole[a:b] for a, b in zip(starts, ends[k - 1 :], strict=False)]


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have set, as a signed number."""
    if not len(h):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(data: bytes, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number."""
    return majority(np.array([_hash(s, SEED) for s in shingles(data, k)], dtype=np.uint64))


def fingerprinted(df: DataFrame, text_col: str = "text", out: str = "fp", k: int = SHINGLE) -> DataFrame:
    def start():
        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array([fingerprint(x, k) for x in raw(column)], pa.int64())]

        return compute

    return add_columns(df, [text_col], [T.StructField(out, T.LongType())], start)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): key is the number of the deletion variant (segment * 32 + bit) and the segment without that bit."""
    which = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    rows = fps.select("fp", which)
    segment = F.when(F.col("i") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    mask = F.expr("~ shiftleft(1L, i % 32)")
    return rows.select((F.expr("shiftleft(cast(i as long), 32)")).bitwiseOR(segment.bitwiseAND(mask)).alias("key"), "fp")


def _first_variant(x: np.ndarray) -> np.ndarray:
    """Number of the first variant that two fingerprints with difference ``x`` share."""
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)

    def bit(s: np.ndarray) -> np.ndarray:
        return np.where(s == 0, 0, np.bitwise_count(s - np.uint64(1)).astype(np.int64))

    return np.where(np.bitwise_count(high) <= 1, bit(high), 32 + bit(low))


def pair_off(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted (key, fp) rows whose groups are whole."""
    us, vs = [], []
    at = np.arange(len(keys))
    for shift in range(1, len(keys)):
        at = at[at + shift < len(keys)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        x = fps[at] ^ fps[at + shift]
        ok = (np.bitwise_count(x) <= 2) & (x != 0)
        hit, x = at[ok], x[ok]
        hit = hit[_first_variant(x) == (keys[hit] >> 32)]
        us.append(fps[hit])
        vs.append(fps[hit + shift])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def link(limit: int):
    """A mapper over sorted (key, fp) rows: rows (u, v, null) for links, (key, null, fp) for members of large buckets."""

    def emit(u, v, w) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int64())], names=["a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        large = None  # the key of a bucket that has grown too large

        def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(heads, len(keys)))
            per = np.repeat(sizes, sizes)
            big = (per > limit) | (keys == large if large is not None else False)
            if big.any():
                yield emit(keys[big], [None] * int(big.sum()), fps[big].view(np.int64))
            some = ~big & (per > 1)
            u, v = pair_off(keys[some], fps[some])
            if len(u):
                yield emit(u.view(np.int64), v.view(np.int64), [None] * len(u))

        for b in batches:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)))
            size += b.num_rows
            if size < CHUNK:
                continue
            keys, fps = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from settle(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > limit:  # its members go out; the rest of them follow when they come
                large = int(keys[-1])
                yield from settle(keys, fps)
                keys, fps = keys[:0], fps[:0]
            held, size = [(keys, fps)], len(keys)
        if held:
            yield from settle(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return run


def second_index(rows: DataFrame) -> DataFrame:
    """Links (u, v) among members (key, fp) of large buckets, by deleting each two of their 33 other bits."""
    i = F.shiftright("key", 32).cast("int")
    # Bits are numbered within the fingerprint: the other segment's 32, and the deleted one.
    other = F.when(i < 32, F.sequence(F.lit(0), F.lit(31))).otherwise(F.sequence(F.lit(32), F.lit(63)))
    places = F.concat(other, F.array(F.when(i < 32, i + 32).otherwise(i - 32)))
    two = F.flatten(F.transform(places, lambda a: F.transform(F.filter(places, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = rows.select("key", "fp", F.explode(two).alias("t")).select("key", "fp", F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    rows = rows.withColumn("rest", F.expr("fp & ~ shiftleft(1L, a) & ~ shiftleft(1L, b)"))
    # At most four fingerprints share the rest.
    groups = rows.groupBy("key", "a", "b", "rest").agg(F.collect_set("fp").alias("s")).filter(F.size("s") > 1)
    pairs = groups.select(F.explode("s").alias("u"), "s").select("u", F.explode("s").alias("v")).filter("u < v")
    return pairs.distinct()


def links(fps: DataFrame, limit: int = LIMIT, n: int | None = None) -> DataFrame:
    """(u, v): every two distinct fingerprints of ``fps`` (``n`` rows) that differ in one or two bits, once."""
    dealt = variants(fps).repartition(shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    # Each fingerprint has 64 variants, so tasks take fewer of them.
    found = checkpointed(dealt.mapInArrow(link(limit), "a long, b long, c long"), n, TEXTS_PER_TASK)
    out = found.filter("c is null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = found.filter("c is not null").select(F.col("a").alias("key"), F.col("c").alias("fp"))
    if large.isEmpty():
        return out
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(second_index(large)).distinct()


def rooted(own: DataFrame, limit: int = LIMIT, n: int | None = None) -> DataFrame:
    """``own`` (fp, ...; one row for each of its ``n`` fingerprints) with ``root``, a name for the component."""
    roots = components(links(own.select("fp"), limit, n), n).withColumnRenamed("node", "fp")
    return own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of ``df``."""
    n = df.count()
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("_text"))
    fps = checkpointed(fingerprinted(rows, "_text", "fp", k).select("id", "fp"))
    own = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("least_id")), n)
    named = checkpointed(rooted(own, limit, n), n)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = named.join(least, "root").select("fp", "component_id")
    # A hot fingerprint's rows are two longs each; a skewed join is split at run time.
    out = fps.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return in_tasks(out, n)


def least_rows(marked: DataFrame, n: int, limit: int = LIMIT) -> DataFrame:
    """(id, h): the least row of each component of ``marked`` (id, h, fp; ``n`` rows)."""
    own = checkpointed(marked.groupBy("fp").agg(F.min(F.struct("id", "h")).alias("first")), n)
    first = rooted(own, limit, n).groupBy("root").agg(F.min("first").alias("first"))
    return checkpointed(first.select("first.id", "first.h"), n)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """``df`` with one row of each component: that of its least id, a null id being the last (of one id the least hash of the text)."""
    n = df.count()
    marked = checkpointed(fingerprinted(named(df, id_col, text_col), "text", "fp", k).select("id", "h", "fp"))
    return in_tasks(rows_named(df, least_rows(marked, n, limit), id_col, text_col), n, TEXTS_PER_TASK)
