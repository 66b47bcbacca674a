"""Plumbing shared by the operators: Arrow mapping, checkpoints, block shuffles."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LONG, MAX_LONG = -(2**63), 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's ``spark.checkpoint.dir``.

    Only a plain local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = sc.getConf().get("spark.checkpoint.dir") or None
    if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lyceum-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows that a task writes of a table of a few numbers a row, and of rows that come from whole texts.
PER_TASK, TEXTS_PER_TASK = 50_000, 8_192


def in_tasks(df: DataFrame, rows: int, per: int = PER_TASK) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need; fewer partitions stay as they are.

    For what a shuffle has dealt out. A coalesce reaches down to the last shuffle, so over a scan it would take the scan's tasks away.
    """
    return df.coalesce(max(1, -(-rows // per)))


def checkpointed(df: DataFrame, rows: int | None = None, per: int = PER_TASK) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut; with ``rows`` in as many files as these need.

    Every file costs the shared file system a few calls, so small tables must not be written by hundreds of tasks.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else in_tasks(df, rows, per)).checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator has written, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no DataFrame in use leads to, which else waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that none of ``names`` replaces (case is ignored)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): what names a row, its id (null as the greatest long) and a hash of its text (null as empty)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(MAX_LONG)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def rows_named(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that ``kept`` (id, h) names; of repeated rows one, the least by its other columns."""
    a, b, n = unused(df, "_id", "_h", "_n")
    others = [f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in (id_col, text_col)]
    own = df.withColumn(a, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(MAX_LONG))).withColumn(b, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    own = own.join(kept.select(F.col("id").alias(a), F.col("h").alias(b)), [a, b], "left_semi")
    order = Window.partitionBy(a, b).orderBy(*others) if others else Window.partitionBy(a, b).orderBy(a)
    return own.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    start: Callable[[], Callable[..., list[pa.Array]]],
) -> DataFrame:
    """Append ``fields`` computed batch by batch with Arrow.

    ``start`` runs once per task and returns the function that maps the input
    arrays to the new ones. A column of ``df`` with a new column's name is replaced.
    """
    keep = without(df, [f.name for f in fields])
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    # An input that is kept anyway isn't sent twice.
    extra = [c for c in inputs if c not in keep]
    at = [keep.index(c) if c in keep else len(keep) + extra.index(c) for c in inputs]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for b in batches:
            cols = b.columns
            new = compute(*[cols[i] for i in at])
            yield pa.RecordBatch.from_arrays([*cols[:n_keep], *new], names=schema.names)

    picked = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(extra)]
    return df.select(*picked).mapInArrow(run, schema)


#: Rows of a batch that are Python objects at one time.
SLICE = 256


def raw(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as the empty text, a few rows at a time."""
    for at in range(0, len(column), SLICE):
        for x in column.slice(at, SLICE).cast(pa.binary()).to_pylist():
            yield x or b""


def texts(column: pa.Array) -> Iterator[str]:
    """Python strings of a string column, null as the empty text, a few rows at a time."""
    for at in range(0, len(column), SLICE):
        for x in column.slice(at, SLICE).to_pylist():
            yield x or ""
