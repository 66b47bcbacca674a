"""Near copies by the similarity of word shingles, for the pipeline.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least 0.8. Each
set's BANDS * ROWS least values under as many hash functions make BANDS keys; sets of similarity 0.8 share one of them
with probability 1 - (1 - 0.8^7)^45 = 0.99997, more similar ones more often, those of similarity 0.5 in 0.3 of cases.
A byte of each least value makes a sketch, whose equal bytes estimate the similarity with a deviation of 0.023 at 0.8.

The rows of a key are gone through in order in one task. A row that its sketch shows to be as good as equal (SURE) to one before
it is paired with that one only; any other is paired with each of those before it that it can be a near copy of (MAYBE, 4.5 deviations
below), and those that follow are held against it, too. Every pair is then verified on the whole texts; of a
verified pair the later row goes. So of two near copies that share a key one always goes, a row goes only for a near copy before
it, and copies aren't expanded into pairs. Keys of more than LIMIT rows aren't held by a task: the least rows lead,
all others are joined with them, verified and go, and leaders double each round until no two rows are left.
The first keys are gone through on their own (SCHEDULE), which takes out most rows of large groups before they meet under all others.

Rows are ordered by id, null last, and by a hash of the text. Rows of equal id and text count as one. Texts without words
stay, unless ``fingerprints`` asks for one row of each group of linked SimHash fingerprints first (operator 10). An empty table
stays empty; other columns come through as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS_PER_TASK, add_columns, checkpointed, in_tasks, named, raw, release, rows_named, shuffle_partitions
from .simhash import SEED, least_rows, majority, shingles

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 45, 7
#: Bands whose keys are gone through together.
SCHEDULE = [(0, 1), (1, 2), (2, BANDS)]
#: Shares of equal sketch bytes: as good as equal, and possibly near copies.
SURE, MAYBE = 0.92, 0.70
#: Rows of a key that one task goes through.
LIMIT = 4096
_RANDOM = np.random.default_rng(SEED)
_FACTOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def hashes(data: bytes) -> np.ndarray:
    """A text's hashed shingles, repeats included."""
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(data, WORDS)], dtype=np.uint64)


def least_values(of: np.ndarray) -> np.ndarray:
    """The least value of a set that isn't empty under each hash function."""
    high = (of >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(of), 1 << 11):
        x = high[at : at + (1 << 11)] * _FACTOR[:, None]
        x += _SHIFT[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return least


def keys_of(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def sketch_of(least: np.ndarray) -> bytes:
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def keys(of: np.ndarray) -> list[int]:
    """The band keys of a set."""
    return keys_of(least_values(of)) if len(of) else []


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets given as distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _signatures():
    def compute(column: pa.Array) -> list[pa.Array]:
        fps, bands, sketches = [], [], []
        for data in raw(column):
            own = hashes(data)
            least = least_values(np.unique(own)) if len(own) else None
            fps.append(majority(own))
            bands.append([] if least is None else keys_of(least))
            sketches.append(b"" if least is None else sketch_of(least))
        return [pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]

    return compute


def signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fp, bands, sketch) of the rows, from one pass over the texts by the scan's own tasks."""
    fields = [T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return checkpointed(add_columns(named(df, id_col, text_col), ["text"], fields, _signatures).select("id", "h", "fp", "bands", "sketch"))


def paired(band: int, bands: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Places (before, row) to verify among the rows of one key of ``band``, given in order: their band keys and sketches."""
    out: list[tuple[int, int]] = []
    ahead = np.zeros(len(sketches), dtype=np.int64)
    n = 0
    for x in range(len(sketches)):
        equal = (sketches[ahead[:n]] == sketches[x]).mean(axis=1)
        sure = np.flatnonzero(equal >= SURE)
        if len(sure):
            out.append((int(ahead[sure[0]]), x))
            continue
        near = ahead[:n][equal >= MAYBE]
        if len(near):
            # Two rows that share several keys are paired under the first.
            near = near[(bands[near] == bands[x]).argmax(axis=1) == band]
            out += [(int(a), x) for a in near]
        ahead[n] = x
        n += 1
    return out


def pairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, band, id, h, bands, sketch) in order of key, id and h to pairs (lead_id, lead_h, id, h)."""
    held: list[tuple] = []

    def settle() -> pa.RecordBatch:
        sketches = np.frombuffer(b"".join(r[5] for r in held), dtype=np.uint8).reshape(len(held), -1)
        pairs = paired(held[0][1], np.array([r[4] for r in held]), sketches) if len(held) > 1 else []
        columns = [[held[a][2] for a, _ in pairs], [held[a][3] for a, _ in pairs], [held[x][2] for _, x in pairs], [held[x][3] for _, x in pairs]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["lead_id", "lead_h", "id", "h"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield settle()
                held = []
            held.append(row)
    if held:
        yield settle()


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, text, text0), sorted so that equal texts0 follow each other, to those (id, h) that are similar."""
    leader, its = None, None
    for b in batches:
        ids, hs, ok = b.column(0), b.column(1), []
        for text, other in zip(raw(b.column(2)), raw(b.column(3)), strict=True):
            if other != leader:
                leader, its = other, np.unique(hashes(other))
            ok.append(similarity(np.unique(hashes(text)), its) >= LEAST)
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([ids.filter(mask), hs.filter(mask)], names=["id", "h"])


def shared(rows: DataFrame, above: int = 1, most: int | None = None) -> DataFrame:
    """Those of the rows (key, ...) whose key has more than ``above`` and at most ``most``."""
    many = rows.groupBy("key").agg(F.count("*").alias("_c")).filter(F.col("_c") > above)
    many = many if most is None else many.filter(F.col("_c") <= most)
    return rows.join(many.select("key"), "key", "left_semi")


def apart(rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``rows`` without those that any of the ``tables`` (id, h) names."""
    for t in tables:
        rows = rows.join(t, ["id", "h"], "left_anti")
    return rows


def verified(pairs: DataFrame, bodies: DataFrame, n: int) -> DataFrame:
    """(id, h) of the later rows of those ``pairs`` (lead_id, lead_h, id, h) that are near copies."""
    first = bodies.select(F.col("id").alias("lead_id"), F.col("h").alias("lead_h"), F.col("text").alias("lead_text"))
    both = pairs.join(bodies, ["id", "h"]).join(first, ["lead_id", "lead_h"]).select("id", "h", "text", "lead_text")
    return checkpointed(both.mapInArrow(compared, "id long, h long").distinct(), n)


def led(rows: DataFrame, bodies: DataFrame, n: int, limit: int) -> list[DataFrame]:
    """Tables (id, h) of the rows (key, id, h) of keys with more than ``limit`` rows that are near copies of one before them."""
    gone: list[DataFrame] = []
    left, leaders = checkpointed(shared(rows, limit), n, TEXTS_PER_TASK), 1
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy("id", "h"))
        lead = checkpointed(left.withColumn("_n", place).filter(F.col("_n") <= leaders).select("key", F.col("id").alias("lead_id"), F.col("h").alias("lead_h")), n)
        pairs = left.join(lead, "key").filter("struct(id, h) > struct(lead_id, lead_h)").select("lead_id", "lead_h", "id", "h").distinct()
        gone.append(verified(pairs, bodies, n))
        rest = left.join(lead.select("key", F.col("lead_id").alias("id"), F.col("lead_h").alias("h")), ["key", "id", "h"], "left_anti")
        left = checkpointed(shared(apart(rest, gone[-1:])), n, TEXTS_PER_TASK)
        leaders *= 2
    return gone


def dropped(alive: DataFrame, texts: DataFrame, n: int, limit: int = LIMIT) -> list[DataFrame]:
    """Tables (id, h) of the rows of ``alive`` (id, h, bands, sketch; distinct, at most ``n``) that are near copies of one before them; ``texts`` has (id, h, text)."""
    every = alive.select("id", "h", F.posexplode("bands").alias("band", "key"))
    keyed = checkpointed(shared(every), n, TEXTS_PER_TASK)
    release(alive.sparkSession)
    # Only rows that meet another are compared, so only their texts are carried along.
    bodies = checkpointed(texts.join(keyed.select("id", "h").distinct(), ["id", "h"], "left_semi").dropDuplicates(["id", "h"]), n, TEXTS_PER_TASK)
    marks = alive.select("id", "h", "bands", "sketch")
    gone: list[DataFrame] = []
    for low, high in SCHEDULE:
        rows = keyed.filter(F.col("band").between(low, high - 1))
        gone += led(apart(rows.select("key", "id", "h"), gone), bodies, n, limit)
        small = shared(apart(rows, gone), 1, limit).join(marks, ["id", "h"], "left").select("key", "band", "id", "h", "bands", "sketch")
        pairs = small.repartition(shuffle_partitions(alive.sparkSession), "key").sortWithinPartitions("key", "id", "h").mapInArrow(pairing, "lead_id long, lead_h long, id long, h long")
        gone.append(verified(checkpointed(pairs, n, TEXTS_PER_TASK).distinct(), bodies, n))
    return gone


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False, limit: int = LIMIT) -> DataFrame:
    """``df`` without the rows that are near copies of one before them; ``fingerprints``: first with one row of each group of linked fingerprints."""
    n = df.count()
    if not n:
        return df
    marked = signed(df, id_col, text_col)
    alive = marked.select("id", "h", "bands", "sketch").dropDuplicates(["id", "h"])
    if fingerprints:
        alive = alive.join(least_rows(marked.select("id", "h", "fp"), n), ["id", "h"], "left_semi")
    alive = checkpointed(alive, n)
    release(df.sparkSession)
    kept = checkpointed(apart(alive.select("id", "h"), dropped(alive, named(df, id_col, text_col), n, limit)), n)
    release(df.sparkSession)
    return in_tasks(rows_named(df, kept, id_col, text_col), n, TEXTS_PER_TASK)
