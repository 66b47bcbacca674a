"""Event streams: daily counts, quotas with state, and a conversation's last turns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a plain local session without it gets a temporary one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    top = found.get() if found.isDefined() else sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="lyceum-stream-")
    return f"{top}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A file source over a Parquet file or folder; ``ts`` as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(schema)
    # A stream reads folders; a single file is the one of its name in its folder.
    rows = stream.parquet(path) if folder else stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n) in tumbling days; rows later than ``late`` are left out once a day is closed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


CAPPED = "event_id long, user_id long, day date, nth int, accepted boolean"
STATE = "day date, n int"


def capped(stream: DataFrame, limit: int) -> DataFrame:
    """Each request with its number in its user's day and whether the quota accepts it.

    State is one day and a counter for each user; a later day resets it, a day that is over is refused.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for ts, event in zip(rows["ts"], rows["event_id"], strict=True):
            today = ts.date()
            if day is None or today > day:
                day, n = today, 0
            if today < day:
                out.append((event, key[0], today, 0, False))
                continue
            n += 1
            out.append((event, key[0], today, n, n <= limit))
        state.update((day, n))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "day", "nth", "accepted"])

    return stream.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(step, CAPPED, STATE, "append", GroupStateTimeout.NoTimeout)


MEMORY_STATE = "roles array<string>, texts array<string>"


def session_memory(stream: DataFrame, k: int = C.MEMORY_TURNS) -> DataFrame:
    """(conv_id, roles, texts): the last k turns of a conversation after each batch; state keeps no more."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        roles, texts = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        roles, texts = (roles + rows["role"].tolist())[-k:], (texts + rows["text"].tolist())[-k:]
        state.update((roles, texts))
        yield pd.DataFrame({"conv_id": [key[0]], "roles": [roles], "texts": [texts]})

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, roles array<string>, texts array<string>", MEMORY_STATE, "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, provider: str | None = None) -> DataFrame:
    """What a query over all that is there now writes: in complete mode the last batch, else all batches. ``provider``: the state store that the query needs."""
    spark = stream.sparkSession
    if provider:
        name = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name)
        spark.conf.set(name, provider)
        try:
            return drained(stream, mode)
        finally:
            spark.conf.set(name, before)
    folder = shared_folder(spark)

    def put(batch: DataFrame, n: int) -> None:
        # A batch that is run again after a failure overwrites what it wrote.
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    try:
        out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    return out.select(*stream.columns)
