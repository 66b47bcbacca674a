"""Compressed vectors: product codes by weighted Lloyd over distinct integer parts (operator 12).

A vector's components become integers floor(4096 x); it is cut into PARTS equal consecutive parts. Equal parts of a position
are one row with a weight, which is all that the rounds read: every round assigns each distinct part to the nearest entry of
its position's codebook (squared distance, ties to the lower index) and sums weighted components by (position, entry).
The driver sees these sums only: ENTRIES integers for each component of one vector. At last codes and errors are joined back to the
vectors by position and part.

Null vectors and those with null or non-finite components are left out. The most frequent length that PARTS divides (the lesser of
equally frequent ones) is that of the coded vectors; those of another length, of length 0, or with a component of 2^50 or more keep
their row with null code and error. Rows count as often as they occur; a null id comes last, rows of equal id go by
components. An error over the greatest long is the greatest long. An empty table gives no row. Fewer vectors than entries
make a smaller codebook. A column of a new column's name is replaced, others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_LONG, checkpointed, unused, without

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components from here on are too large for sums of 38 digits.
LARGEST = 2.0**50
#: Components up to here have distances that 64 bits hold in parts of up to 4,096 of them.
SMALL = 1 << 24
#: Distinct parts that a task measures at a time.
AT_ONCE = 4096
DECIMAL = "decimal(38,0)"


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries; beyond SMALL as Python's integers."""
    if max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)) > SMALL or parts.shape[1] > 4096:
        parts, book = parts.astype(object), book.astype(object)
    out = np.zeros((len(parts), len(book)), dtype=parts.dtype)
    for k in range(parts.shape[1]):
        out += (parts[:, k][:, None] - book[:, k][None, :]) ** 2
    return out


def nearest(positions: np.ndarray, parts: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; of equally near entries the first."""
    code, error = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=object)
    for p in np.unique(positions):
        at = np.flatnonzero(positions == p)
        d = squared(parts[at], books[p])
        code[at] = best = d.argmin(axis=1)
        error[at] = d[np.arange(len(at)), best]
    return code, error


def _read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """A batch (position, part, ...) in slices: positions and parts as arrays, and the slice."""
    for at in range(0, b.num_rows, AT_ONCE):
        s = b.slice(at, AT_ONCE)
        yield s.column(0).to_numpy(), s.column(1).flatten().to_numpy().reshape(s.num_rows, -1), s


def summing(books: list[np.ndarray]):
    """A mapper from rows (position, part, weight) to a task's sums (position, entry, sums, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for positions, parts, s in _read(b):
                weights = s.column(2).to_numpy()
                code, _ = nearest(positions, parts, books)
                exact = int(np.abs(parts).max(initial=0)) * int(weights.max()) * len(parts) >= 2**62
                kinds = (parts.astype(object), weights.astype(object)) if exact else (parts, weights)
                for p, c in set(zip(positions.tolist(), code.tolist(), strict=True)):
                    at = (positions == p) & (code == c)
                    own = [int(x) for x in (kinds[0][at] * kinds[1][at][:, None]).sum(axis=0)] + [int(kinds[1][at].sum())]
                    was = held.get((p, c))
                    held[p, c] = own if was is None else [x + y for x, y in zip(was, own, strict=True)]
        if held:
            rows = [(p, c, [str(x) for x in v[:-1]], v[-1]) for (p, c), v in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64()), strict=True)], names=["position", "entry", "sums", "weight"])

    return run


def coding(books: list[np.ndarray]):
    """A mapper from rows (position, part) to (position, part, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for positions, parts, s in _read(b):
                code, error = nearest(positions, parts, books)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(code, pa.int32()), pa.array([min(int(x), MAX_LONG) for x in error], pa.int64())], names=["position", "part", "code", "error"])

    return run


def codebooks(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The entries of each position after ``rounds`` rounds over weighted distinct parts (position, part, weight)."""
    if not len(books[0]):
        return books
    rows = distinct.select("position", "part", "weight")
    for _ in range(rounds):
        found = rows.mapInArrow(summing(books), "position int, entry int, sums array<string>, weight long")
        each = found.select("position", "entry", "weight", F.posexplode("sums").alias("k", "s")).groupBy("position", "entry", "k").agg(F.sum(F.col("s").cast(DECIMAL)).alias("s"), F.sum("weight").alias("n"))
        books = [b.copy() for b in books]
        # As many rows as there are entries' components.
        for r in each.collect():
            books[r.position][r.entry, r.k] = int(r.s) // r.n
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by position, entry and place in the part."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """``df``'s rows with finite vectors, with ``code`` (two hex digits a part) and ``error`` in the vector's place; and each position's entries."""
    keep = without(df, [vector_col, "code", "error"])
    vector = F.col(f"`{vector_col}`")
    small = ~F.exists(vector, lambda x: F.abs(x.cast("double")) >= LARGEST)
    # Written once, so that every pass sees the same numbers of rows; other columns travel in one, away from names in use here.
    rows = df.filter(finite(vector)).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.when(small, integers(vector)).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = checkpointed(rows)
    length = rows.filter((F.size("v") > 0) & (F.size("v") % PARTS == 0)).groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    width = length[0]["n"] // PARTS if length else 1
    coded = rows.filter(F.size("v") == width * PARTS)
    first = coded.orderBy(F.col("kept")[id_col].asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), PARTS, width)
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.slice("v", p * width + 1, width))
    parts = coded.select("row", F.posexplode(cut).alias("position", "part"))
    distinct = checkpointed(parts.groupBy("position", "part").agg(F.count("*").alias("weight")))
    books = codebooks(distinct, [start[:, p, :] for p in range(PARTS)])
    schema = T.StructType([distinct.schema["position"], distinct.schema["part"], T.StructField("code", T.IntegerType()), T.StructField("error", T.LongType())])
    known = distinct.select("position", "part").mapInArrow(coding(books), schema)
    met = parts.join(known, ["position", "part"]).select("row", "position", "code", "error")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0"))
    codes = met.groupBy("row").agg(F.array_join(digits, "").alias("code"), whole_sum("error").alias("error"))
    out = rows.select("row", "kept").join(codes, "row", "left")
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], "code", "error"), books


def whole_sum(column: str) -> Column:
    """A sum of longs that stops at the greatest one."""
    total = F.sum(F.col(column).cast(DECIMAL))
    return F.when(total > MAX_LONG, F.lit(MAX_LONG)).otherwise(total.cast("long"))


def with_group_error(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the sum of ``error`` over rows of equal ``column``, nulls together; null where none of them has an error."""
    key, total = unused(df, "_key", "_total")
    sums = df.groupBy(F.col(f"`{column}`").alias(key)).agg(whole_sum("error").alias(total))
    kept = [F.col(f"`{c}`") for c in without(df, [out])]
    return df.join(sums, F.col(f"`{column}`").eqNullSafe(F.col(key)), "left").select(*kept, F.col(total).alias(out))
