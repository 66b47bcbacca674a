"""Lengths of TF-IDF vectors of words and pairs of neighbouring words, without a row for each chunk and term.

A term's weight needs in how many chunks it stands, so something of every term must move. What moves here is, of each slice of a task's
chunks, a number for each distinct term and the step to each chunk that has it, packed by ranges of these numbers.
A pair of two words of the book (BOOK frequent words of some texts) is numbered by its two places there, in 32 bits that lie close together; any
other term has a number of 64 bits, which takes about six bytes. What the book holds changes the bytes that move and no result.
A range is summed in one piece, which gives back one partial sum for each chunk that it touches. A task adds up the sums of its ranges before
they move, and there are a few tasks a core, so what comes back grows with the chunks and not with chunks times ranges.

Terms are told apart by their numbers. Pairs of the book have their own; among m distinct other terms m * m / 2 ** 65 pairs share one (0.03 of a pair
among a thousand million), which would count their chunks together in the document frequency and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import counts

#: Words of a slice, rows of a slice (they are numbered in two bytes), and bytes of text for each range of terms.
SLICE, ROWS, RANGE = 4_000_000, 65_536, 16_000_000
#: Tasks a core that sum ranges, and chunks whose sums such a task holds before it gives them on.
TASKS, HELD = 2, 4_000_000
#: Words of the book, the bytes of text that it is made of, and how many places of a pair's second word stay side by side.
BOOK, BOOK_OF, BLOCK = 65_536, 16_000_000, 256
#: What a range has of a slice: its pairs of the book, its words and its other pairs; sizes, rows and counts of all three, one after the other.
NUMBERED = ("pairs", "words", "others")
PACKED = f"part int, slice long, {', '.join(f'{c} binary' for c in NUMBERED)}, sizes binary, rows binary, tfs binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def book_of(rows: DataFrame, size: int) -> list[str]:
    """The most frequent words of about BOOK_OF bytes of the texts of rows (id, words), at most BOOK of them and only such as come twice."""
    share = min(1.0, BOOK_OF / max(size, 1))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    words = some.select(F.explode(rows.columns[1]).alias("w")).filter(F.length("w") <= 64).groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")
    return [r["w"] for r in words.orderBy(F.desc("n"), "w").limit(BOOK).collect()]


def places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number of 32 bits for each pair of places in the book: BLOCK second words side by side, the blocks in mixed order, so that ranges are alike."""
    blocks = BOOK * BOOK // BLOCK
    block = first.astype(np.uint64) * np.uint64(BOOK // BLOCK) + second.astype(np.uint64) // np.uint64(BLOCK)
    return (block * np.uint64(2_654_435_761) % np.uint64(blocks)) * np.uint64(BLOCK) + second.astype(np.uint64) % np.uint64(BLOCK)


@dataclass
class Rows:
    """Ascending numbers of terms, and of each in how many rows it stands, which these are (as ``gaps``) and how often."""

    terms: np.ndarray
    sizes: np.ndarray
    gaps: np.ndarray
    tfs: np.ndarray

    @classmethod
    def of(cls, term: np.ndarray, row: np.ndarray) -> Rows:
        """From numbers and rows, one after the other by both; a repeated one counts."""
        first = np.flatnonzero(np.concatenate([np.ones(min(len(term), 1), dtype=bool), (term[1:] != term[:-1]) | (row[1:] != row[:-1])]))
        tf = np.diff(np.append(first, len(term))).astype(np.uint32)
        row, term = row[first].astype(np.uint16), term[first]
        head = np.flatnonzero(np.concatenate([np.ones(min(len(term), 1), dtype=bool), term[1:] != term[:-1]]))
        return cls(term[head], np.diff(np.append(head, len(row))).astype(np.uint32), gaps(row, head), tf)

    @classmethod
    def small(cls, number: np.ndarray, row: np.ndarray) -> Rows:
        """From numbers below 2 ** 48 in any order: a number and its row are sorted as one."""
        key = np.sort(number.astype(np.uint64) << np.uint64(16) | row.astype(np.uint64))
        return cls.of(key >> np.uint64(16), key & np.uint64(0xFFFF))

    def cut(self, part: np.ndarray, n_parts: int) -> list[tuple[np.ndarray, ...]]:
        """(terms, sizes, gaps, tfs) of each part; ``part``: that of each term, ascending."""
        edge, ends = np.searchsorted(part, np.arange(n_parts + 1)), np.append(0, np.cumsum(self.sizes, dtype=np.int64))
        return [(self.terms[a:z], self.sizes[a:z], self.gaps[ends[a] : ends[z]], self.tfs[ends[a] : ends[z]]) for a, z in zip(edge[:-1], edge[1:], strict=True)]


def terms_of(row: np.ndarray, code: np.ndarray, words: pa.Array, book: pa.Array) -> list[Rows]:
    """The pairs of the book, the words and the other pairs of neighbouring words of rows."""
    own = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    place = pc.fill_null(pc.index_in(words, value_set=book), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = np.flatnonzero(row[1:] == row[:-1])
    a, z, whose = code[inner], code[inner + 1], row[inner]
    known = (place[a] >= 0) & (place[z] >= 0)
    pairs = Rows.small(places(place[a[known]], place[z[known]]), whose[known])
    order = np.argsort(own, kind="stable")
    rank = np.empty(len(own), dtype=np.int64)
    # Words that share a number are one term, as in any other slice.
    rank[order] = np.cumsum(np.concatenate([[0], own[order][1:] != own[order][:-1]]))
    single = Rows.small(rank[code], row)
    single.terms = np.unique(own)
    a, z, whose = a[~known], z[~known], whose[~known]
    pair = mixed(own[a] * np.uint64(0x9E3779B97F4A7C15) + mixed(own[z]) + np.uint64(1))
    order = np.argsort(pair, kind="stable")
    return [pairs, single, Rows.of(pair[order], whose[order])]


def steps(ascending: np.ndarray) -> bytes:
    """The steps between ascending numbers, first bytes first: the high bytes are zeros side by side, which a shuffle's compression takes away."""
    return np.diff(ascending, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unstepped(x: bytes) -> np.ndarray:
    planes = np.frombuffer(x, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def gaps(row: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The steps between rows that ascend from each of ``heads`` on; at a head the row itself."""
    out = np.diff(row, prepend=row.dtype.type(0))
    out[heads] = row[heads]
    return out


def squeezed(x: np.ndarray) -> bytes:
    """Small unsigned numbers, first bytes first, behind their count and with an entropy code: few of their bytes repeat in a row."""
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(x: bytes, of: type) -> np.ndarray:
    n, width = int.from_bytes(x[:8], "little"), np.dtype(of).itemsize
    planes = np.frombuffer(pa.decompress(x[8:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(of).ravel()


def ungapped(gap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows of terms that have ``sizes`` rows each."""
    total = np.cumsum(gap, dtype=np.int64)
    heads = np.cumsum(sizes, dtype=np.int64) - sizes
    return total - np.repeat(total[heads] - gap[heads], sizes)


def packed(rows: DataFrame, n_parts: int, book: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(PACKED, ids) of rows (id, words): for each slice and range its terms, in how many rows of the slice each stands, which these are and how often; ids: the slice's, with one of its ranges."""
    schema = T.StructType([*T.StructType.fromDDL(PACKED), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    known = pa.array(book, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                some = whole.slice(low, ROWS)
                for b in counts.sliced(some, some.column(1), SLICE):
                    row, code, words = counts.encoded(b.column(1))
                    if not len(words):
                        continue
                    kinds = terms_of(row, code, words, known)
                    # Numbers of the book fill 32 bits, others 64.
                    cuts = [k.cut(((k.terms >> np.uint64(s)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64), n_parts) for k, s in zip(kinds, (0, 32, 32), strict=True)]
                    there = [p for p in range(n_parts) if any(len(c[p][0]) for c in cuts)]
                    lists = [[squeezed(np.diff(cuts[0][p][0], prepend=np.uint64(0)).astype(np.uint32)) for p in there], *[[steps(c[p][0]) for p in there] for c in cuts[1:]]]
                    lists += [[squeezed(np.concatenate([c[p][i] for c in cuts])) for p in there] for i in (1, 2, 3)]
                    ids = pa.ListArray.from_arrays(pa.array([0] + [b.num_rows] * len(there), pa.int32()), pa.concat_arrays([b.column(0)]))
                    columns = [pa.array(there, pa.int32()), pa.array([key] * len(there), pa.int64()), *[pa.array(x, pa.binary()) for x in lists], ids]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    key += 1

    return rows.mapInArrow(run, schema)


def sums_of(t: pa.Table, n: int) -> pa.Table:
    """(slice, rows, sums, ids) of one range of PACKED rows: of each slice the rows that it touches and their sums of squared weights."""
    kinds = [[np.cumsum(unsqueezed(x, np.uint32), dtype=np.uint64) for x in t.column("pairs").to_pylist()], *[[unstepped(x) for x in t.column(c).to_pylist()] for c in NUMBERED[1:]]]
    sizes, gap, tf = ([unsqueezed(x, of) for x in t.column(c).to_pylist()] for c, of in (("sizes", np.uint32), ("rows", np.uint16), ("tfs", np.uint32)))
    squares: list[list[np.ndarray]] = [[] for _ in gap]
    for i, terms in enumerate(kinds):
        # A slice's sizes are those of its terms of one kind after the other.
        before = [sum(len(k[j]) for k in kinds[:i]) for j in range(len(terms))]
        at = np.unique(np.concatenate(terms), return_inverse=True)[1]
        df = np.bincount(at, weights=np.concatenate([s[b : b + len(x)] for s, b, x in zip(sizes, before, terms, strict=True)]))
        square = ((np.log((1.0 + n) / (1.0 + df)) + 1) ** 2)[at]
        ends = np.cumsum([len(x) for x in terms])
        for own, end, x in zip(squares, ends, terms, strict=True):
            own.append(square[end - len(x) : end])
    hit, sums = [], []
    for own, size, g, f in zip(squares, sizes, gap, tf, strict=True):
        total = np.bincount(ungapped(g, size), weights=np.repeat(np.concatenate(own), size) * np.square(f, dtype=np.float64))
        some = np.flatnonzero(total)
        hit.append(some.astype(np.uint16).tobytes())
        sums.append(total[some].tobytes())
    return pa.table([t.column("slice"), pa.array(hit, pa.binary()), pa.array(sums, pa.binary()), t.column("ids")], names=["slice", "rows", "sums", "ids"])


def added(batches: Iterator[pa.RecordBatch], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of ``sums_of`` of a task's ranges, those of a slice as one."""
    held: dict[int, np.ndarray] = {}
    names: dict[int, pa.Array] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for k, own in held.items():
            some = np.flatnonzero(own)
            listed = names.get(k, pa.array([], ids.value_type))
            columns = [pa.array([k], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (some.astype(np.uint16), own[some])], pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "rows", "sums", "ids"])

    for b in batches:
        for i, (k, row, s) in enumerate(zip(b.column("slice").to_pylist(), b.column("rows").to_pylist(), b.column("sums").to_pylist(), strict=True)):
            row, own = np.frombuffer(row, dtype=np.uint16), held.get(k, np.zeros(0))
            if len(row) and row[-1] >= len(own):
                own = np.concatenate([own, np.zeros(int(row[-1]) + 1 - len(own))])
            own[row] += np.frombuffer(s, dtype=np.float64)
            held[k] = own
            whose = b.column("ids").slice(i, 1).flatten()
            if len(whose):
                names[k] = whose
        if sum(map(len, held.values())) > HELD:
            yield from out()
            held.clear()
            names.clear()
    yield from out()


def norms(rows: DataFrame, n: int, size: int) -> DataFrame:
    """(id, norm) of those rows (id, words) that have a word. ``n``: how many rows there are; ``size``: about how many bytes their texts have."""
    n_parts = max(1, -(-size // RANGE))
    of = packed(rows, n_parts, book_of(rows, size)).repartition(min(n_parts, TASKS * rows.sparkSession.sparkContext.defaultParallelism), "part")
    ids = of.schema["ids"]
    schema = T.StructType([*T.StructType.fromDDL("slice long, rows binary, sums binary"), ids])
    list_of = pa.list_(to_arrow_type(ids.dataType.elementType))

    def whole(t: pa.Table) -> pa.Table:
        own = pa.concat_arrays([c.flatten() for c in t.column("ids").chunks])
        total = np.zeros(len(own))
        for row, s in zip(t.column("rows").to_pylist(), t.column("sums").to_pylist(), strict=True):
            total[np.frombuffer(row, dtype=np.uint16)] += np.frombuffer(s, dtype=np.float64)
        some = np.flatnonzero(total)
        return pa.table([own.take(pa.array(some)), pa.array(total[some])], names=["id", "s"])

    parts = of.groupBy("part").applyInArrow(lambda t: sums_of(t, n), schema).mapInArrow(lambda b: added(b, list_of), schema)
    squares = parts.groupBy("slice").applyInArrow(whole, T.StructType([rows.schema["id"], T.StructField("s", T.DoubleType())]))
    return squares.groupBy("id").agg(F.sqrt(F.sum("s")).alias("norm"))
