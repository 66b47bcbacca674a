"""Daily quotas as keyed state with timers: a user's state lasts a day and no longer.

The state of a user is one number for each day that is still open; those of BLOCK days lie in one entry, since each call to the state
store costs far more than a row. Of a batch's rows Python holds two numbers each, their time and id, by which they are numbered; they come and go in chunks. When the watermark
passes the end of an entry's first open day, a timer takes the numbers of all days that are over away, so users who don't come back leave nothing behind. As in every stream with a watermark,
rows that are later than it are left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAPPED = "event_id long, user_id long, day date, nth int, accepted boolean"
#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)
#: Rows of a chunk that is given out.
CHUNK = 10_000
#: Days whose numbers are one entry of a user's state.
BLOCK = 32


class DailyQuota(StatefulProcessor):
    """Numbers each user's requests of a day and accepts the first ``limit``."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # By a block's first day: the sum of its numbers, and these.
        self.days = handle.getMapState("days", "day int", "n int, counts array<int>")

    def put(self, block: int, counts: np.ndarray) -> None:
        if counts.any():
            self.days.updateValue((block,), (int(counts.sum()), counts.tolist()))
        else:
            self.days.removeKey((block,))

    def due(self, block: int, counts: np.ndarray) -> None:
        """A timer for the end of the block's first open day."""
        self.handle.registerTimer((block + int(np.flatnonzero(counts)[0]) + 1) * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [(c["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), c["event_id"].to_numpy(np.int64)) for c in rows]
        ts, event = (np.concatenate(x) for x in zip(*chunks, strict=True))
        order = np.lexsort((event, ts))
        ts, event = ts[order], event[order]
        day = ts // (DAY_MS * 1000)
        first = np.flatnonzero(np.concatenate([[True], day[1:] != day[:-1]]))
        counts = np.diff(np.append(first, len(day)))
        days = day[first]
        had = np.zeros(len(days), dtype=np.int64)
        blocks = days // BLOCK * BLOCK
        for block in np.unique(blocks).tolist():
            at = np.flatnonzero(blocks == block)
            was = np.array(self.days.getValue((block,))[1] if self.days.containsKey((block,)) else [0] * BLOCK, dtype=np.int64)
            had[at] = was[days[at] - block]
            now = was.copy()
            now[days[at] - block] += counts[at]
            self.put(block, now)
            if not was.any() or np.flatnonzero(now)[0] < np.flatnonzero(was)[0]:
                self.due(block, now)
        nth = np.arange(1, len(day) + 1) - np.repeat(first, counts) + np.repeat(had, counts)
        dates = np.repeat(np.array([EPOCH + dt.timedelta(days=d) for d in days.tolist()], dtype=object), counts)
        for at in range(0, len(day), CHUNK):
            part = slice(at, at + CHUNK)
            yield pd.DataFrame({"event_id": event[part], "user_id": key[0], "day": dates[part], "nth": nth[part].astype(np.int32), "accepted": nth[part] <= self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // DAY_MS
        for (block,), (n, counts) in list(self.days.iterator()):
            left = np.array(counts, dtype=np.int64)
            left[: max(0, over - block)] = 0
            if left.sum() < n:
                self.put(block, left)
                if left.any():
                    self.due(block, left)
        return iter(())

    def close(self) -> None:
        pass


def capped(stream: DataFrame, limit: int, late: str = "1 day") -> DataFrame:
    """Each request (event_id, user_id, ts) with its number in its user's day and whether the quota accepts it.

    The session's state store must be PROVIDER. A day's state goes once the latest request is ``late`` past the day's end.
    """
    rows = stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(DailyQuota(limit), outputStructType=CAPPED, outputMode="Append", timeMode="EventTime")
