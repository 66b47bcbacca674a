"""Operator 12 against plain loops over Python's integers."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from lyceum.llm import codes, queries
from tests.compare import differences
from tests.llm.fixtures import SF

VECTORS = "vec_id long, embedding array<double>, label int, row string, code string, v int, position int"


def by_loops(rows, width):
    """The contract read literally, for rows (vec_id, embedding, label): (sorted (vec_id, code, error, label_error), codebooks' hash)."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in kept if len(v) == 8 * width]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in own]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            to = {}
            for c in cut:
                to.setdefault(best(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*to[k])] if k in to else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, y), c in zip(own, cut):
        found = [best(c[p], books[p]) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), 2**63 - 1), y))
    out += [(i, None, None, y) for i, v, y in kept if len(v) != 8 * width]
    group = {}
    for _, _, e, y in out:
        group.setdefault(y, []).append(e)
    total = {y: min(sum(e for e in es if e is not None), 2**63 - 1) if any(e is not None for e in es) else None for y, es in group.items()}
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, total[y]) for i, c, e, y in out), key=repr), hashlib.sha256(flat.encode()).hexdigest()


def of_spark(spark, rows):
    df = spark.createDataFrame([(*r, "kept", "gone", 1, 2) for r in rows], VECTORS).repartition(3)
    found, books = codes.encode(df)
    got = codes.with_group_error(found, "label", "label_error")
    assert got.columns == ["vec_id", "label", "row", "v", "position", "code", "error", "label_error"]
    assert got.filter("row <> 'kept' or v <> 1").count() == 0
    return sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error").collect()), key=repr), codes.digest(books)


def awkward(seed=1, width=2):
    rng = random.Random(seed)
    draw = lambda: [rng.choice([rng.gauss(0, 1), rng.choice([-0.5, 0.0, 0.25, -1 / 4096])]) for _ in range(8 * width)]
    rows = [(i, draw(), rng.choice([0, 1, None])) for i in range(90)]
    rows += [(100 + i, rows[3][1], 1) for i in range(80)]  # copies
    rows += [(7, rows[7][1], 1), (7, draw(), 2), (None, draw(), None), (None, draw(), 5)]
    rows += [(200, None, 1), (201, rows[0][1][:-1] + [None], 1), (202, rows[0][1][:-1] + [math.nan], 1), (203, [math.inf] + rows[0][1][1:], 0)]
    rows += [(210, [0.5] * 3, 8), (211, [], 1), (212, [1.0] * 8, None)]
    return rows


def test_as_by_loops(spark, monkeypatch):
    monkeypatch.setattr(codes, "AT_ONCE", 7)
    assert of_spark(spark, awkward()) == by_loops(awkward(), 2)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i * 10**6 + k) for k in range(8)], i % 2) for i in range(40)] + [(77, [2.0**49] * 8, 3), (78, [-(2.0**49)] * 8, 3)]
    assert of_spark(spark, rows) == by_loops(rows, 1)
    # Beyond sums of 38 digits a vector keeps its row and has no code.
    assert [(r[1], r[2]) for r in of_spark(spark, [(1, [0.5] * 8, 0), (2, [1e300] * 8, 0)])[0]] == [("00" * 8, 0), (None, None)]


def test_fewer_vectors_than_entries(spark):
    rows = awkward(2)[:5]
    assert of_spark(spark, rows) == by_loops(rows, 2)
    assert of_spark(spark, [(1, [0.1] * 8, None)] * 3) == by_loops([(1, [0.1] * 8, None)] * 3, 1)


def test_nothing_in_nothing_out(spark):
    assert of_spark(spark, [])[0] == [] and of_spark(spark, [(1, None, 0)])[0] == []
    assert of_spark(spark, [(1, [1.0], 0)])[0] == [(1, None, None, None)]


def test_query_as_sql(spark):
    assert differences(queries.op12_vector_codes(spark, SF), SF, queries.op12_sql()) is None
    assert queries.op12_vector_codes(spark, SF).filter(F.length("code") != 16).count() == 0
