"""Similar sets by prefixes against all pairs."""

import math
import random

import pytest

from lyceum.operators import graph, setjoin
from lyceum.operators.setjoin import Threshold


def plain(rows, t):
    sets = {}
    for k, m in rows:
        if k is not None and m is not None:
            sets.setdefault(m, set()).add(k)
    out = []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= max(t.shared, 1):
                score = {"ochiai": both / math.sqrt(len(sets[a]) * len(sets[b])), "jaccard": both / len(sets[a] | sets[b])}.get(t.measure, 1.0)
                if score >= t.least:
                    out.append((a, b, both, len(sets[a]), len(sets[b])))
    return sorted(out)


def draw(seed, members=40, keys=25):
    rng = random.Random(seed)
    rows = [(f"k{min(int(rng.expovariate(0.2)), keys - 1)}", f"m{rng.randrange(members):02d}") for _ in range(300)]
    return rows + [("everywhere", f"m{i:02d}") for i in range(members)] + [(None, "m01"), ("k1", None)] + rows[:5]


@pytest.mark.parametrize("t", [Threshold(), Threshold(2, "jaccard", 0.12), Threshold(1, "ochiai", 0.1), Threshold(3), Threshold(1, "jaccard", 0.7), Threshold(2, "ochiai", 0.8)])
def test_as_all_pairs(spark, t):
    rows = draw(7)
    df = spark.createDataFrame(rows, "key string, member string").repartition(3)
    want = plain(rows, t)
    for split in (setjoin.SPLIT, 3):
        assert sorted(map(tuple, setjoin.similar(df, "key", "member", t, split).collect())) == want != []


def test_one_concept_on_every_page(spark):
    """400 pages with the same concept and two of their own each: not one pair is made of the common one."""
    rows = [("common", f"p{i}") for i in range(400)] + [(f"own{i // 2}-{k}", f"p{i}") for i in range(400) for k in range(2)]
    df = spark.createDataFrame(rows, "key string, member string")
    t = Threshold(2, "jaccard", 0.12)
    assert setjoin.candidates(df, "key", "member", t).count() == 200
    assert setjoin.similar(df, "key", "member", t).count() == 200


def test_a_frequent_key_is_split(spark):
    """A key that stays frequent in prefixes meets in blocks: the plan's join is on (key, i, j), and no pair is lost."""
    df = spark.createDataFrame([("k", f"p{i:03d}") for i in range(90)], "key string, member string")
    found = setjoin.candidates(df, "key", "member", Threshold(), split=10)
    assert found.count() == 90 * 89 // 2 and found.filter("l >= r").count() == 0


def test_nothing(spark):
    assert setjoin.similar(spark.createDataFrame([], "key string, member string"), "key", "member", Threshold(2)).count() == 0


def test_bridges_leave_out_what_is_common(spark):
    rows = [(f"m{i % 4}", f"s{i}", f"c{k}", f"id{i}", 1) for i in range(60) for k in {0, 1 + i % 15, 20 + i % 9}]
    mentioned = spark.createDataFrame(rows, "module string, section string, concept string, id string, n long")
    stop = spark.createDataFrame([("c3",)], "concept string")
    sets, of = {}, {}
    for m, s, c, _, _ in rows:
        if c != "c3":
            sets.setdefault((m, s), set()).add(c)
            of[m, s] = m
    want = {(min(a, b), max(a, b)) for a in sets for b in sets if a < b and of[a] != of[b] and len(sets[a] & sets[b]) >= 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.12}
    got = {tuple(tuple(x.split("\x1f")) for x in (r.l, r.r)) for r in graph.topic_bridges(mentioned, stop).collect()}
    assert {tuple(sorted(p)) for p in got} == want
