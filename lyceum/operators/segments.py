"""A table as an append-only log of segments, for builds that touch a part of it.

Rows belong to owners (a file, a topic). An append adds one segment with the rows of some owners and names those whose earlier rows
are dead (tombstones); nothing that was written changes. A row is alive unless a later append declares its owner
dead. Segments are laid out in buckets by owner, so the rows of a few owners are read from the folders of their buckets alone. When FAN
segments of one tier (a power of FAN in rows) have gathered, they are merged without their dead rows, so a row is
rewritten a logarithmic number of times; tombstones older than every segment go.

A log's state is a small dictionary of folders and numbers that a version's manifest holds (``sources/versions.py``): several logs go forward
together or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import versions
from .sizes import broadcast_if_small

#: Buckets of a segment; segments of a tier that are merged.
BUCKETS, FAN = 16, 4


@dataclass
class Log:
    """``place``: from the owner's column to what its bucket is chosen by. ``joined``: makes one segment's rows of those of several, where rows add up."""

    store: versions.Store
    name: str
    owner: str
    place: Callable[[Column], Column]
    state: dict | None = None
    buckets: int = BUCKETS
    joined: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        self.state = self.state or {"next": 1, "segments": [], "dead": [], "buckets": self.buckets}
        self.buckets = self.state["buckets"]

    def folders(self) -> list[str]:
        return [s["path"] for s in self.state["segments"]] + [d["path"] for d in self.state["dead"]]

    def bucket(self, owner: Column) -> Column:
        return F.pmod(F.xxhash64(self.place(owner)), F.lit(self.buckets)).cast("int")

    def _staged(self, rows: DataFrame, number: int) -> None:
        spread = rows.withColumn("_segment", F.lit(number)).withColumn("_bucket", self.bucket(F.col(self.owner))).repartitionByRange("_bucket", self.owner)
        path = versions.staged(self.store, spread, self.name, "_bucket")
        parts = [int(x.split("=")[1]) for x in self.store.names(path) if x.startswith("_bucket=")]
        if not parts:
            self.store.remove(path)
            return
        n = self._of([f"{path}/_bucket={b}" for b in parts]).count()
        self.state["segments"].append({"path": path, "number": number, "rows": n, "buckets": parts})

    def _of(self, paths: list[str]) -> DataFrame:
        return self.store.spark.read.parquet(*[f"{self.store.root}/{p}" for p in paths])

    def append(self, rows: DataFrame, dead: DataFrame | None = None) -> Log:
        """Adds ``rows``; earlier rows of the owners ``dead`` (a column of the owner's name) count no more."""
        number = self.state["next"]
        self.state = {**self.state, "next": number + 1, "segments": [*self.state["segments"]], "dead": [*self.state["dead"]]}
        if dead is not None and self.state["segments"]:
            path = versions.staged(self.store, dead.select(self.owner).distinct().withColumn("_from", F.lit(number)), f"{self.name}-dead")
            self.state["dead"].append({"path": path, "number": number})
        self._staged(rows, number)
        self._tier()
        return self

    def buckets_of(self, owners: DataFrame) -> list[int]:
        """The buckets of the owners: numbers, as many as there are buckets at most."""
        return sorted(r[0] for r in owners.select(self.bucket(F.col(self.owner))).distinct().collect())

    def paths(self, buckets: list[int] | None = None, segments: list[dict] | None = None) -> list[str]:
        """The folders that hold the rows of these buckets (None: all)."""
        own = self.state["segments"] if segments is None else segments
        return [f"{s['path']}/_bucket={b}" for s in own for b in s["buckets"] if buckets is None or b in buckets]

    def read(self, buckets: list[int] | None = None, owners: DataFrame | None = None) -> DataFrame | None:
        """The living rows, of these buckets or owners alone; None where nothing was ever written there."""
        buckets = self.buckets_of(owners) if owners is not None else buckets
        paths = self.paths(buckets)
        if not paths:
            return None
        rows = self._of(paths)
        if owners is not None:
            rows = rows.join(broadcast_if_small(owners.select(self.owner).distinct()), self.owner, "left_semi")
        return self._alive(rows, self.state["dead"]).drop("_segment")

    def _alive(self, rows: DataFrame, dead: list[dict]) -> DataFrame:
        if not dead:
            return rows
        since = self._of([d["path"] for d in dead]).groupBy(self.owner).agg(F.max("_from").alias("_from"))
        met = rows.join(broadcast_if_small(since), self.owner, "left")
        return met.filter(F.col("_from").isNull() | (F.col("_segment") >= F.col("_from"))).drop("_from")

    def _tier(self) -> None:
        """Merges the segments of a tier that has FAN of them, and what that makes, until none has."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in self.state["segments"]:
                tier = 0
                while FAN ** (tier + 1) <= s["rows"]:
                    tier += 1
                tiers.setdefault(tier, []).append(s)
            full = next((of for _, of in sorted(tiers.items()) if len(of) >= FAN), None)
            if full is None:
                break
            last = max(s["number"] for s in full)
            # A tombstone up to the merged segment's number has done its work on these rows; later ones still apply to it.
            rows = self._alive(self._of(self.paths(None, full)), [d for d in self.state["dead"] if d["number"] <= last])
            self.state["segments"] = [s for s in self.state["segments"] if s not in full]
            rows = rows.drop("_segment")
            self._staged(self.joined(rows) if self.joined else rows, last)
        oldest = min((s["number"] for s in self.state["segments"]), default=self.state["next"])
        self.state["dead"] = [d for d in self.state["dead"] if d["number"] > oldest]
