"""Lines that many documents share, by levelled sorted runs of line hashes (operator 13, native).

A line's key is the line without white space (space, tab to carriage return) at both ends, A-Z lower-cased; its hash is the key's MD5.
``Runs`` keeps, for all batches of documents so far, how many documents have each key: a batch counts its own keys, leaves out those that
a run already shows as frequent (a merge anti-join with each run), and is added as a sorted run of its own. Whenever the two latest runs cover
equally many batches they are merged, so runs are few and a key is rewritten a logarithmic number of times. Runs are
tables bucketed and sorted by hash: joins and merges read bucket by bucket and don't shuffle a run again. A run is named by the batches
it covers; one that a longer run covers is out of date, so a job that dies between the writing of a merged run and the removal of its parts leaves a
right state, and a batch that a run covers isn't added twice.

``cut`` drops every line whose key at least ``least`` documents have. Lines are parted by \\n alone; a null text is the empty text, one empty
line. Keys under ``min_chars`` code points (1: the empty key) never count. A row is a document, so repeated rows and rows of equal
id count as often as they occur. Null ids are ids like others. Empty tables give empty results. Other columns stay;
those named as a new column are replaced.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_LONG, remove, shared_folder, shuffle_partitions, unused, without

SPACE = " \t\n\x0b\x0c\r"
#: Documents that make a line frequent; batches of a whole table.
LEAST, BATCHES = 10, 4


def key(line: Column) -> Column:
    ascii_only = F.octet_length(line) == F.char_length(line)
    low = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))
    return F.btrim(low, F.lit(SPACE))


def hashes(text: Column, min_chars: int = 1) -> Column:
    """The hash of every line's key in order; the empty string for keys that don't count."""
    one = lambda k: F.when(F.char_length(k) >= max(min_chars, 1), F.md5(k.cast("binary"))).otherwise(F.lit(""))
    return F.transform(F.transform(F.split(text, "\n"), key), one)


def kept(text: Column, dropped: Column) -> Column:
    """``text`` without the lines at the places ``dropped`` (ascending, from 0): the stretches between them, each copied once."""

    def between(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
        ends = F.concat(dropped, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    # As a lambda's variable the lines are split once for each text.
    return F.transform(F.array(F.split(text, "\n")), between)[0]


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One run of two. A full outer join of equally bucketed runs merges them without a shuffle; a sum over their union would
    need one, and without it (Spark 4.1 plans that for bucketed Parquet tables) gives a row for each run."""
    none = F.lit(0).cast("long")
    both = a.withColumnRenamed("docs", "_a").join(b.withColumnRenamed("docs", "_b"), "key", "full_outer")
    return both.select("key", (F.coalesce("_a", none) + F.coalesce("_b", none)).alias("docs"))


class Runs:
    """Levelled runs (key, docs) below ``folder``, in a store that all executors reach; an existing folder goes on where it was."""

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST, buckets: int | None = None):
        self.spark, self.folder, self.least = spark, folder.rstrip("/"), least
        there = self._listed()
        # All runs of a folder have the same buckets.
        self.buckets = there[0][2] if there else buckets or shuffle_partitions(spark)
        self._tables: dict[str, str] = {}

    def _listed(self) -> list[tuple[int, int, int, str]]:
        """(first batch, last batch, buckets, path) of the runs that are whole."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        whole = [n for n in names if n.count("-") == 2 and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted((*map(int, n.split("-")), f"{self.folder}/{n}") for n in whole)

    def live(self) -> list[tuple[int, int, int, str]]:
        """The runs that no longer run covers, in order of their batches."""
        found = self._listed()
        return [r for r in found if not any(o is not r and o[0] <= r[0] and r[1] <= o[1] for o in found)]

    def read(self, path: str) -> DataFrame:
        if path not in self._tables:
            self._tables[path] = name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (key STRING, docs BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._tables[path])

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        # What a run that died before left here isn't whole and goes.
        path = f"{self.folder}/{first}-{last}-{self.buckets}"
        remove(self.spark, path)
        self._tables[path] = name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)

    def _forget(self, path: str) -> None:
        if path in self._tables:
            self.spark.sql(f"DROP TABLE {self._tables.pop(path)}")  # the files of an external table stay

    def add(self, batch: int, documents: DataFrame) -> None:
        """Counts ``documents`` (hashes), the rows of batch number ``batch``; batches come in order from 0."""
        runs = self.live()
        if any(a <= batch <= b for a, b, *_ in runs):
            return
        if batch != (runs[-1][1] + 1 if runs else 0):
            raise ValueError(f"batch {batch} doesn't follow the runs {[r[:2] for r in runs]}")
        own = documents.select(F.explode(F.array_distinct("hashes")).alias("key")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("docs"))
        for *_, path in runs:
            own = own.join(self.read(path).filter(F.col("docs") >= self.least).select("key"), "key", "left_anti")
        self._write(own.repartition(self.buckets, "key"), batch, batch)
        self.compact()

    def compact(self) -> None:
        """Merges the two latest runs as long as they cover equally many batches."""
        while len(runs := self.live()) > 1 and runs[-1][1] - runs[-1][0] == runs[-2][1] - runs[-2][0]:
            (first, *_, a), (_, last, _, b) = runs[-2:]
            self._write(merged(self.read(a), self.read(b)), first, last)
            for old in (a, b):
                self._forget(old)
                remove(self.spark, old)

    def frequent(self) -> DataFrame:
        """(key): the hashes that at least ``least`` documents of all batches have."""
        runs = [self.read(path) for *_, path in self.live()]
        if not runs:
            return self.spark.createDataFrame([], "key string")
        return reduce(merged, runs).filter(F.col("docs") >= self.least).select("key")

    def close(self) -> None:
        """Takes the runs' names out of the catalogue; their files stay."""
        for path in list(self._tables):
            self._forget(path)


def hashed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(id, h, hashes): what names a row, its id (null as the greatest long) and its text's hash, and the hashes of its lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(MAX_LONG)).alias("id"), F.xxhash64(text).alias("h"), hashes(text, min_chars).alias("hashes"))


def without_lines(df: DataFrame, lines: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the text that is left, ``n_lines`` and ``n_dropped``, given its ``lines`` as ``hashed`` gives them and the keys to drop."""
    a, b, at = unused(df, "_id", "_h", "_dropped")
    each = lines.select("id", "h", F.posexplode("hashes").alias("pos", "key")).filter("key <> ''")
    # Rows of equal id and text have the same places.
    places = each.join(frequent, "key", "left_semi").groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias(at))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = df.withColumn(a, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(MAX_LONG))).withColumn(b, F.xxhash64(text))
    met = own.join(places.select(F.col("id").alias(a), F.col("h").alias(b), at), [a, b], "left")
    keep = [F.col(f"`{c}`") for c in without(df, [text_col, "n_lines", "n_dropped"])]
    dropped = F.coalesce(F.col(at), F.array().cast("array<int>"))
    whole = F.when(F.col(at).isNull(), text).otherwise(kept(text, dropped))
    return met.select(*keep, whole.alias(text_col), F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"))


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_chars: int = 1, batches: int = BATCHES) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` without its frequent lines (see ``without_lines``), counted in ``batches`` batches; and what removes the tables that it reads, to call after use."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    # Texts are hashed once; what batches and the last join read is a tenth of their size.
    hashed(df, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("id long, h long, hashes array<string>, batch int").parquet(f"{folder}/lines")
    runs = Runs(spark, f"{folder}/runs", least)
    for b in range(batches):
        runs.add(b, lines.filter(F.col("batch") == b))

    def done() -> None:
        runs.close()
        remove(spark, folder)

    return without_lines(df, lines, runs.frequent(), id_col, text_col), done
