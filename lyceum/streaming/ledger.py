"""Appends that happen once for each batch, and tables that a stream takes anew with every batch.

``Ledger`` writes a batch's rows to a folder named by the query and the batch and then a small entry that appears whole; readers take the folders that have an entry.
A batch that runs again after a failure, with whatever rows, finds its entry and adds nothing; one that died before the
entry is written anew in the same place. ``Refreshed`` is the other side of a stream-static join: the version of a published table
(``sources/versions.py``) that is current when a batch begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions


class Ledger:
    """An append-only table of batches below ``folder``, written by the queries that name themselves."""

    def __init__(self, spark: SparkSession, folder: str, partition: str | None = None):
        self.store, self.partition = versions.Store(spark, folder), partition

    def has(self, query: str, batch: int) -> bool:
        return self.store.exists(f"entries/{query}-{batch:012d}.json")

    def append(self, query: str, batch: int, rows: DataFrame) -> bool:
        """Adds the rows of a batch; False if the batch was added before."""
        if self.has(query, batch):
            return False
        at = f"data/{query}-{batch:012d}"
        out = rows.write.mode("overwrite")
        (out.partitionBy(self.partition) if self.partition else out).parquet(f"{self.store.root}/{at}")
        return self.store.put(f"entries/{query}-{batch:012d}.json", json.dumps({"path": at}))

    def read(self, schema) -> DataFrame:
        """All rows of the batches that have an entry."""
        paths = [f"{self.store.root}/data/{name.removesuffix('.json')}" for name in self.store.names("entries")]
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame([], schema)
        # A folder at a time: each has its own partitions below it.
        return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(p) for p in paths])

    def sink(self, query: str, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: appends what ``made`` makes of a batch."""

        def put(batch: DataFrame, number: int) -> None:
            # The work isn't done again for a batch that is there.
            if not self.has(query, number):
                self.append(query, number, made(batch))

        return put


class Refreshed:
    """The latest published version of a table at ``root``, looked up whenever it is asked for."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.store, self.name = versions.Store(spark, root), name

    def publish(self, rows: DataFrame) -> versions.Version:
        """Makes ``rows`` the table from the next batch on; batches under way keep the version they began with."""
        at = versions.staged(self.store, rows, self.name)
        return versions.commit(self.store, {self.name: [at]}, base=versions.current(self.store))

    def now(self) -> DataFrame:
        version = versions.current(self.store)
        if version is None:
            raise FileNotFoundError(f"nothing is published at {self.store.root}")
        return versions.table(self.store, version, self.name)


def admitted(requests: DataFrame, roster: DataFrame, key: str = "email") -> DataFrame:
    """Requests with ``admitted``: whether the roster lists their sender. A null sender is nobody."""
    known = roster.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, key, "left").withColumn("admitted", F.coalesce("_known", F.lit(False))).drop("_known")


def gate_stream(requests: DataFrame, roster: Refreshed, ledger: Ledger, query: str, checkpoint: str, key: str = "email", day: Column | None = None):
    """A running query that notes each request once, with whether the roster current at its batch admits the sender."""

    def made(batch: DataFrame) -> DataFrame:
        out = admitted(batch, roster.now(), key)
        return out if day is None else out.withColumn("day", day)

    return requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(ledger.sink(query, made)).start()
