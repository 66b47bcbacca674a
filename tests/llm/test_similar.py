"""The pipeline's near copies against plain loops over sets of five-word shingles."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from lyceum.llm import similar
from tests.llm.fixtures import SF, frame


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return bool(a or b) and len(a & b) >= 0.8 * len(a | b)


def apart(before, after):
    sets = {i: slow_set(t) for i, t in before}
    return not [(a, b) for a, b in itertools.combinations(sorted(after), 2) if alike(sets[a], sets[b])]


def check(before, after):
    """None of two near copies stays with the other; what goes has a near copy before it."""
    assert apart(before, after)
    sets = {i: slow_set(t) for i, t in before}
    for i in sets:
        assert i in after or any(j < i and alike(sets[i], sets[j]) for j in sets)


def copies(n_groups, n_copies):
    """Texts of 100 to 300 words with copies of which one to five words are replaced, and some that are too far."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randint(100, 300))]
        for k in range(n_copies):
            text = list(base)
            for at in rng.sample(range(len(text)), min(k, 5) if k % 4 else 12):
                text[at] = rng.choice(words)
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_copies_go(spark):
    rows = copies(12, 10)
    df = frame(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    out = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    assert apart(rows, {r.doc_id for r in out.collect()})
    after = {r.doc_id for r in similar.without_copies(df).collect()}
    check(rows, after)
    assert len(after) < len(rows)


@pytest.mark.parametrize("limit", [1, 3])
def test_keys_of_many_rows(spark, limit):
    """Keys that no task holds are gone through by leaders, with the same rules."""
    rows = copies(3, 14)
    df = frame(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    check(rows, {r.doc_id for r in similar.without_copies(df, limit=limit).collect()})


def test_pairs_of_a_key():
    """Copies are paired with one row only; rows that may be near copies with all of these, under their first common key."""
    sketches = np.zeros((4, 315), dtype=np.uint8)
    sketches[1, :20] = 1  # as good as equal to the first
    sketches[2, :63] = 2  # 0.8
    sketches[3] = 3
    bands = np.zeros((4, 45), dtype=np.int64)
    assert similar.paired(0, bands, sketches) == [(0, 1), (0, 2)]
    bands[2, 0] = 9
    assert similar.paired(0, bands, sketches) == [(0, 1)] and similar.paired(1, bands, sketches) == [(0, 1), (0, 2)]


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, {r.doc_id for r in similar.without_copies(docs).collect()})


def test_awkward_rows(spark):
    out = similar.without_copies(frame(spark)).collect()
    ids = [r.doc_id for r in out]
    assert {2, 3, 12, None, -3, 20, 21} <= set(ids) and ids.count(9) == 1
    assert similar.without_copies(frame(spark, [])).collect() == []
