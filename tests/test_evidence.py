"""Evidence of pairs against a plain loop: a hot member, repeated rows, and pairs without any."""

import random

import pytest

from lyceum.operators import graph


@pytest.mark.parametrize("k", [None, 3])
def test_evidence_of_pairs(spark, k):
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.choice("abcd")) for _ in range(150)] + [(i, "hot") for i in range(500)] * 2
    pairs = [("a", "b", 0.5), ("a", "hot", 0.4), ("c", "d", 0.3), ("d", "hot", 0.2), ("a", "none", 0.1)]
    of = {}
    for key, member in rows:
        of.setdefault(member, set()).add(str(key))
    want = {(a, b, s): sorted(of[a] & of.get(b, set()))[:k] for a, b, s in pairs}
    got = graph.with_evidence(spark.createDataFrame(pairs, "l string, r string, score double"), spark.createDataFrame(rows, "id long, m string"), "id", "m", k)
    assert {(r.l, r.r, r.score): r.evidence for r in got.collect()} == want and want["a", "none", 0.1] == []
    if k is not None:
        assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
