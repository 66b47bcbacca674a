"""Operator 11 against plain loops."""

import hashlib
import random
import zlib

from lyceum.llm import queries, trie
from tests.compare import differences
from tests.llm.fixtures import SF

TURNS = "conv_id long, turn long, role string, text string, digest string, depth int"


def by_loops(rows):
    """The contract read literally: {(depth, conv_id): row} of the rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for seq, of in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        leaf = lambda s: not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in members)
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(str(c) for c in sorted(c for c in of if len(whole[c]) == len(seq)))
        parent = min(members[seq[:-1]]) if seq else None
        out[len(seq), min(of)] = (parent, len(of), sum(len(s) == len(seq) + 1 for s in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def of_spark(spark, rows):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], TURNS).repartition(3)
    got = trie.trie(*trie.rebuilt(df)).collect()
    out = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def awkward():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        rows += [(c, i if i else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "word " * 3])) for i in range(rng.choice([1, 2, 3, 9, 12]))]
    rows += [(100 + 5 * k, i, "user", "same") for k in range(40) for i in range(3)]  # copies
    rows += [(1001, 0, "u", "x"), (1001, 0, "u", "x"), (1001, 0, "u", "w")]  # repeated rows and ties; its base isn't there
    rows += [(-3, 1, "u", "ab"), (None, 0, "u", "nobody"), (7000, 3, "", ""), (7001, 1, "u\x00", "long " * 5000)]
    rows += [(8000, i, "user", str(i % 3)) for i in range(150)]
    rng.shuffle(rows)
    return rows


def test_as_by_loops(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 12)
    want = by_loops(awkward())
    assert of_spark(spark, awkward()) == want and any(v[5] == trie.EMPTY for v in want.values())


def test_nothing_in_nothing_out(spark):
    assert of_spark(spark, []) == {} and of_spark(spark, [(None, 1, "a", "b")]) == {}


def test_framing_keeps_turns_apart(spark):
    """Role and text can't run into each other, nor a turn into the next."""
    rows = [(5, 0, "ab", "c"), (10, 0, "a", "bc"), (15, 0, "", "abc"), (20, 0, "abc", "")]
    assert sum(d == 1 for d, _ in of_spark(spark, rows)) == 4


def test_a_long_conversation_stays_linear(spark):
    """2,000 turns and 200 copies of their start: rows that meet ancestors follow the prefixes."""
    rows = [(5, i, "u", str(i)) for i in range(2000)] + [(10 * k, i, "u", str(i)) for k in range(1, 201) for i in range(3)]
    got = of_spark(spark, rows)
    assert len(got) == 2001 and got[3, 5][1] == 201 and got[0, 5][3] == 1


def test_query_as_sql(spark):
    assert differences(queries.op11_conversation_trie(spark, SF), SF, queries.OP11_SQL) is None
