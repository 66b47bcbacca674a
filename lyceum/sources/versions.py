"""Several tables published together: versions whose manifests appear whole, readers that pin one, and expiry of the rest.

Below a root, data lie in ``data/<name>-<uuid>`` folders that are never written twice, and version n is the file
``manifests/<n>.json``. It lists the folders of every table, is written beside and renamed, and is the last thing that a commit does: a
writer that is refused or dies leaves folders that no manifest names, and the version before stays the current one for all tables.
A reader takes the highest number once and keeps its folders; nothing that it reads is overwritten. ``expire`` removes what neither
the latest versions nor a pinned one name.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published a version since this one began."""


class Store:
    """The files below ``root`` through Spark's own access to stores, so that any path Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).head()[0]

    def put(self, name: str, text: str) -> bool:
        """Writes a small file that appears whole; False if there is one of this name."""
        whole, part = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/_new-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        self._fs.mkdirs(whole.getParent())
        if self._fs.exists(whole) or not self._fs.rename(part, whole):
            self._fs.delete(part, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime() / 1000


@dataclass
class Version:
    """What a version's tables are: for each name the folders below the root, and facts that its writer notes."""

    number: int
    tables: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


def _file(number: int) -> str:
    return f"manifests/{number:012d}.json"


def current(store: Store) -> Version | None:
    """The latest version, or None before the first."""
    found = [n for n in store.names("manifests") if n.endswith(".json")]
    return opened(store, int(found[-1].split(".")[0])) if found else None


def opened(store: Store, number: int) -> Version:
    own = json.loads(store.read(_file(number)))
    return Version(number, own["tables"], own["facts"])


def table(store: Store, version: Version, name: str) -> DataFrame:
    """A table of a version; its folders stay as long as the version is among the latest or pinned."""
    return store.spark.read.parquet(*[f"{store.root}/{p}" for p in version.tables[name]])


def staged(store: Store, df: DataFrame, name: str, partition: str | None = None) -> str:
    """``df`` written to a folder that no version names yet; the folder's name below the root."""
    at = f"data/{name}-{uuid.uuid4().hex}"
    out = df.write.partitionBy(partition) if partition else df.write
    out.parquet(f"{store.root}/{at}")
    return at


def commit(store: Store, tables: dict[str, list[str]], facts: dict | None = None, base: Version | None = None) -> Version:
    """The version after ``base`` (None: the first one) with these tables; refused if there is such a version by now."""
    number = (base.number if base else 0) + 1
    latest = current(store)
    if (latest.number if latest else 0) != number - 1 or not store.put(_file(number), json.dumps({"tables": tables, "facts": facts or {}})):
        raise Conflict(f"version {number} has been published by another writer")
    return Version(number, tables, facts or {})


def discard(store: Store, folders: list[str]) -> None:
    """Takes back what was staged for a version that isn't published."""
    for at in folders:
        store.remove(at)


def pin(store: Store, version: Version) -> str:
    """Keeps a version from expiry until it is released or the pin is too old; gives the pin's name."""
    name = f"pins/{version.number}-{uuid.uuid4().hex}"
    store.put(name, "")
    return name


def release(store: Store, name: str) -> None:
    store.remove(name)


def expire(store: Store, keep: int = 2, pin_seconds: float = 86_400, loose_seconds: float = 86_400) -> list[str]:
    """Removes manifests before the latest ``keep`` versions that no pin holds, and folders that no manifest left names; their names.

    A pin counts for ``pin_seconds``. Folders younger than ``loose_seconds`` may belong to a writer at work and stay.
    """
    for p in store.names("pins"):
        if store.age(f"pins/{p}") > pin_seconds:
            store.remove(f"pins/{p}")
    held = {int(p.split("-")[0]) for p in store.names("pins")}
    numbers = [int(n.split(".")[0]) for n in store.names("manifests") if n.endswith(".json")]
    last = set(numbers[-max(keep, 1) :])
    gone = []
    for n in numbers:
        if n not in last and n not in held:
            store.remove(_file(n))
            gone.append(_file(n))
    named = {p for n in numbers if n in last or n in held for of in opened(store, n).tables.values() for p in of}
    for folder in store.names("data"):
        at = f"data/{folder}"
        if not any(p == at or p.startswith(f"{at}/") for p in named) and store.age(at) >= loose_seconds:
            store.remove(at)
            gone.append(at)
    return gone
