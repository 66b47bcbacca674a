"""Which of many literal patterns occur in which texts: one pass over the texts with an automaton of all patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of one automaton; more patterns take more passes.
BLOCK = 50_000


def finder(patterns: list[str]) -> Callable[[str], set[str]]:
    """A function from a text to those of the patterns that it contains. Needs ``pyahocorasick``, and fails without it."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(p, p)
    automaton.make_automaton()
    return lambda text: {p for _, p in automaton.iter(text)} if patterns else set()


def occurrences(texts: DataFrame, key: str, column: str, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, pattern): every text with each of the ``patterns`` (pattern) that it contains, once. Null and empty ones occur nowhere.

    Patterns come to the driver and go out with the tasks in blocks of about ``block``, so neither holds more than that of them.
    """
    distinct = patterns.filter("pattern <> ''").select("pattern").distinct()
    n_blocks = max(1, -(-distinct.count() // block))
    schema = T.StructType([texts.schema[key], T.StructField("pattern", T.StringType())])
    rows = texts.select(key, F.coalesce(F.col(column), F.lit("")).alias("_text"))
    out = None
    for i in range(n_blocks):
        some = sorted(r["pattern"] for r in distinct.filter(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)) == i).collect())

        def run(batches: Iterator[pa.RecordBatch], some: list[str] = some) -> Iterator[pa.RecordBatch]:
            inside = finder(some)
            for b in batches:
                found = [sorted(inside(t)) for t in b.column(1).to_pylist()]
                at = [i for i, x in enumerate(found) for _ in x]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([p for x in found for p in x], pa.string())], names=schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
