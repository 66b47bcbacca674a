"""Dense search over an inverted file: vectors lie in the cell of their nearest centre, a question reads the cells nearest to it.

Centres are fitted on a bounded sample; every row with a vector is indexed. How many cells a question probes follows from a
measurement: a bounded number of questions is answered over all rows, and the cells of these answers tell what share of them a number
of probes finds. Cells are read in blocks of rows and of questions, so that a cell with a third of all rows is many groups. Vectors of
other lengths than the index's lie in a cell for each length, which questions of that length read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import dense, nearest, topk, units
from .sizes import broadcast_if_small, checkpointed, numbered, stored

#: Rows and values that the sample of the fit may have, and its rounds.
SAMPLE, VALUES, ROUNDS = 65_536, 4_000_000, 8
#: Cells at most, and rows of the sample for each at least.
CELLS, PER_CELL = 4_096, 16
#: Rows and questions of one group of a search.
ROWS, ASKED = 8_192, 2_048
#: Questions whose answers over all rows set the probes, and the share of these answers that must be found.
MEASURED, GOAL = 256, 0.95


@dataclass
class Ivf:
    """rows(cell, lot, id, vector), stored and sorted by cell; sizes(cell, pieces); the centres, of norm 1."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray


def closest(m: np.ndarray, centres: np.ndarray, block: int = 4_096) -> np.ndarray:
    """The number of each row's nearest centre, the lower of equal ones."""
    return np.concatenate([np.zeros(0, np.int64), *[(m[i : i + block] @ centres.T).argmax(axis=1) for i in range(0, len(m), block)]])


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of norm 1 by spherical k-means from the sample's first rows; a centre without rows stays."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = closest(sample, centres)
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.add.reduceat(sample[order], heads, axis=0)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres[own[order][heads]] = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres[own[order][heads]])
    return centres


def indexed(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Ivf:
    """The inverted file of vectors (id, vector), by default with the square root of their number as cells, at most ``CELLS``.

    The centres come from at most ``sample`` rows and ``VALUES`` values, chosen by a hash of id and vector. The index's length is the one
    that most vectors have. Null vectors, such with a null or NaN and rows without an id aren't indexed, as they can't answer; zero vectors and
    repeated ids are. An empty table gives an index without centres.
    """
    spark, own = vectors.sparkSession, vectors.select("id", "vector").filter("id IS NOT NULL")
    lengths = own.filter("vector IS NOT NULL").groupBy(F.size("vector").alias("l")).count().orderBy(F.desc("count"), "l").head()
    dims, n = (lengths["l"], lengths["count"]) if lengths else (0, 0)
    bound = min(sample, VALUES // max(dims, 1))
    some = own.filter(F.size("vector") == dims)
    if n > bound:  # nine tenths of the bound are expected, so that the limit hardly ever cuts
        some = some.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int(0.9 * bound / n * (1 << 30)))
    some = some.limit(bound).select("vector").toArrow().combine_chunks()
    m = units(some.column(0).combine_chunks())[1].get(dims, np.zeros((0, dims))) if some.num_rows else np.zeros((0, dims))
    m = m[(m != 0).any(axis=1) & np.isfinite(m).all(axis=1)]
    want = cells or round(n**0.5)
    centres = fitted(m, max(1, min(want, CELLS, len(m) // PER_CELL))) if len(m) else m
    held = spark.sparkContext.broadcast(centres)
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("lot", T.LongType()), own.schema["id"], own.schema["vector"]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = 0
        for b in batches:
            lengths, of = units(b.column(1))
            cell = -1 - lengths
            if dims in of and len(held.value):
                cell[lengths == dims] = closest(of[dims], held.value)
            b = pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.arange(lot, lot + len(cell))), b.column(0), b.column(1)], names=schema.names).filter(pa.array(lengths >= 0))
            lot += len(cell)
            yield b

    rows = stored(own.mapInArrow(assign, schema).repartitionByRange("cell", "lot").sortWithinPartitions("cell"))
    sizes = checkpointed(rows.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).alias("pieces")))
    return Ivf(rows, sizes, centres)


def ranked_cells(lengths: np.ndarray, of: dict[int, np.ndarray], centres: np.ndarray, probes: int) -> list[list[int] | None]:
    """The cells that each question reads, nearest first; a question of another length than the centres' has its length's own, one without a score none."""
    dims = centres.shape[1]
    out: list[list[int] | None] = [[-1 - int(n)] if n >= 0 else [] for n in lengths]
    if dims in of and len(centres):
        near = np.argsort(-(of[dims] @ centres.T), axis=1, kind="stable")[:, :probes]
        for i, cells in zip(np.flatnonzero(lengths == dims), near.tolist(), strict=True):
            out[i] = cells
    return out


def search(index: Ivf, asked: DataFrame, k: int, probes: int, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank): the k vectors of the greatest cosine, rounded, in the ``probes`` cells nearest to each asked vector (qid, vector).

    As ``dense``, but only of the probed cells: with as many probes as cells it is the same. Ties go to the greater id.
    """
    sc = asked.sparkSession.sparkContext
    held = sc.broadcast(index.centres)
    numbered_ = checkpointed(numbered(asked.select("qid", "vector"), "qid", "_n"))
    schema = T.StructType([T.StructField("_n", T.LongType()), T.StructField("vector", numbered_.schema["vector"].dataType), T.StructField("cells", T.ArrayType(T.LongType()))])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ASKED):
                part = b.slice(at, ASKED)
                cells = ranked_cells(*units(part.column(1)), held.value, probes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.list_(pa.int64()))], names=schema.names)

    reads = numbered_.select("_n", "vector").mapInArrow(near, schema).select("_n", "vector", F.explode("cells").alias("cell"))
    reads = checkpointed(reads)
    # A cell is read in blocks: each piece of its rows meets each piece of the questions that probe it.
    plan = reads.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).alias("groups")).join(index.sizes, "cell")
    plan = broadcast_if_small(checkpointed(plan))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    questions = reads.join(plan, "cell").select("cell", upto("pieces").alias("piece"), F.pmod("_n", "groups").alias("group"), "_n", F.col("vector").alias("asked"))
    rows = index.rows.join(plan, "cell").select("cell", F.pmod("lot", "pieces").alias("piece"), upto("groups").alias("group"), "id", "vector")
    out = T.StructType([T.StructField("_n", T.LongType()), index.rows.schema["id"], T.StructField("score", T.DoubleType())])
    empty = pa.RecordBatch.from_pylist([], schema=pa.schema([("_n", pa.int64()), ("id", to_arrow(index.rows.schema["id"].dataType)), ("score", pa.float64())]))

    def best(q: pa.Table, own: pa.Table) -> pa.Table:
        found = [empty]
        if q.num_rows and own.num_rows:
            numbers = q.column("_n").to_numpy()
            lengths, of = units(q.column("asked").combine_chunks())
            local = {n: (np.flatnonzero(lengths == n), m) for n, m in of.items()}
            for b in nearest(local, k, digits, out.names)(own.select(["id", "vector"]).combine_chunks().to_batches()):
                found.append(pa.RecordBatch.from_arrays([pa.array(numbers[b.column(0).to_numpy()]), b.column(1).cast(empty.schema.field("id").type), b.column(2)], names=out.names))
        return pa.Table.from_batches(found)

    key = ["cell", "piece", "group"]
    scored = questions.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(best, out)
    return topk(scored, k, key="_n", digits=digits).join(numbered_.select("_n", "qid"), "_n").select("qid", "id", "score", "rank")


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def probes_for(index: Ivf, vectors: DataFrame, asked: DataFrame, k: int, goal: float = GOAL, measured: int = MEASURED) -> int:
    """The fewest probes that find the share ``goal`` of the exact best k of ``measured`` questions (those of least hash of the qid), over all rows.

    The measurement is one exact search of these questions, whose cost grows with the rows. Without questions all cells are probed.
    """
    cells = len(index.centres)
    few = checkpointed(asked.select("qid", "vector").orderBy(F.xxhash64("qid"), "qid").limit(measured).withColumn("qid", F.monotonically_increasing_id()))
    exact = dense(vectors, few, k)
    where = index.rows.join(broadcast_if_small(exact.select("qid", "id")), "id").filter("cell >= 0").select("qid", "id", "cell").distinct().toArrow()
    if not where.num_rows:
        return max(1, cells)
    held = few.toArrow().combine_chunks()
    lengths, of = units(held.column("vector").combine_chunks())
    order = {q: {c: i + 1 for i, c in enumerate(row)} for q, row in zip(held.column("qid").to_pylist(), ranked_cells(lengths, of, index.centres, cells), strict=True)}
    ranks = np.sort([order[q].get(c, cells) for q, c in zip(where.column("qid").to_pylist(), where.column("cell").to_pylist(), strict=True)])
    return int(ranks[min(len(ranks) - 1, max(0, int(np.ceil(goal * len(ranks))) - 1))])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (expected, found): how many of the exact answers (qid, id) the found ones hold; repeated answers count once."""
    want, got = exact.select("qid", "id").distinct(), found.select("qid", "id").distinct().withColumn("_f", F.lit(1))
    return want.join(got, ["qid", "id"], "left").agg(F.count("*").alias("expected"), F.count("_f").alias("found"))
