"""Operators 1 to 6 and 8 to 10 against brute force, round trips, a reference library or held-out labels."""

import hashlib
import itertools
import math
import struct
import zlib

import numpy as np
import pytest
import xxhash

from lyceum.llm import bpe, chat, components, media, ordermin, packing, quality, queries, sharding, simhash, toxicity
from tests.compare import differences
from tests.llm.fixtures import SF, documents, frame, sentence

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

# ------------------------------------------------------------------ 1 audio


def adpcm_by_hand(block):
    predicted, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [predicted]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEP_SIZE[index])
            diff = step >> 3
            if code & 1:
                diff += step >> 2
            if code & 2:
                diff += step >> 1
            if code & 4:
                diff += step
            predicted = max(-32768, min(32767, predicted - diff if code & 8 else predicted + diff))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(predicted)
    return out


def test_adpcm_blocks_as_one_by_one():
    blocks = np.random.default_rng(0).integers(0, 256, (40, 64)).astype(np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [adpcm_by_hand(b.tobytes()) for b in blocks]


def test_companding_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


@pytest.mark.parametrize("codec", [media.MULAW, media.ALAW, media.IMA_ADPCM])
def test_container_round_trip(codec):
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert media.read_back(media.store(data, codec)) == (codec, media.RATE, data)


def test_doubling_keeps_the_samples():
    pcm = np.random.default_rng(2).integers(-32768, 32767, 100).astype(np.int16)
    up = media.doubled(pcm)
    assert (up[::2] == pcm).all() and len(up) == 200
    assert len(media.doubled(pcm[:1])) == 2


def slow_feature(payload):
    mu, a = (t().tolist() for t in (media.mulaw_table, media.alaw_table))
    rms = lambda x: math.sqrt(sum(v * v for v in x) / len(x))
    linear = [mu[b] for b in payload]
    blocks = [v for at in range(0, len(payload), 64) for v in adpcm_by_hand(payload[at : at + 64])]
    crossings = sum((x < 0) != (y < 0) for x, y in zip(linear, linear[1:]))
    p = [linear[0], *linear, linear[-1], linear[-1]]
    up = [v for i, x in enumerate(linear) for v in (x, max(-32768, min(32767, (9 * (p[i + 1] + p[i + 2]) - p[i] - p[i + 3] + 8) >> 4)))]
    pcm = struct.pack(f"<{len(up)}h", *up)
    return f"mulaw_rms={rms(linear):.3f};alaw_rms={rms([a[b] for b in payload]):.3f};adpcm_rms={rms(blocks):.3f};crossings={crossings};pcm16k_crc32={zlib.crc32(pcm):08x}", pcm


def test_features_by_hand(spark, monkeypatch):
    """Features and resampled PCM, also where groups end inside a batch."""
    monkeypatch.setattr(media, "GROUP_BYTES", 3000)
    rows = media.decoded(media.encoded(frame(spark))).collect()
    assert len(rows) == len(documents())
    for r in rows:
        assert (r.feature, bytes(r.pcm)) == slow_feature(media.padded((r.text or "").encode()))


def test_media_are_stored(spark, tmp_path):
    """The second step takes nothing but what the stored table holds."""
    media.telephony(frame(spark), path=str(tmp_path / "media")).count()
    held = spark.read.parquet(str(tmp_path / "media"))
    assert {media.read_back(bytes(r.media))[2] for r in held.collect()} == {media.padded((t or "").encode()) for _, t, *_ in documents()}
    out = queries.op1_telephony_audio(spark, SF)
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert out.filter("length(pcm) = 4 * payload_bytes").count() == out.count() == 200


def test_media_contract(spark):
    df = frame(spark).withColumnRenamed("source", "media")
    rows = media.telephony(df).collect()
    assert len(rows) == len(documents())
    for r in rows:
        data = (r.text or "").encode()
        payload = media.padded(data)
        assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(data)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(r.media))
        assert media.read_back(bytes(r.media))[2] == payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert np.array_equal(np.frombuffer(r.pcm, "<i2")[::2], media.mulaw_table()[np.frombuffer(payload, np.uint8)])
    assert media.telephony(frame(spark, [])).collect() == []


# ------------------------------------------------------------------ 2 Order MinHash


def slow_signature(text, k=ordermin.K, l=ordermin.L, m=ordermin.M):
    grams = ordermin.kmers(ordermin.codes_of(text), k)
    seen, h = {}, []
    for g in grams.tolist():
        n = seen[g] = seen.get(g, -1) + 1
        h.append(int(ordermin._mix(np.array([(g + n * 0x9E3779B97F4A7C15) % 2**64], dtype=np.uint64))[0]) >> 32)
    mul, xor = ordermin._families(m)
    out = []
    for a, x in zip(mul.tolist(), xor.tolist()):
        best = sorted(range(len(h)), key=lambda i: (((h[i] ^ x) * a) % 2**32, i))[:l]
        acc = np.uint64(len(best))
        for i in sorted(best):
            acc = ordermin._mix(np.array([(int(acc) ^ h[i]) * 0x9E3779B97F4A7C15 % 2**64], dtype=np.uint64))[0]
        out.append(int(acc) >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi", "ab" * 300, sentence(4, 80), "é東\U0001f600" * 9])
def test_signature_by_hand(text):
    assert ordermin.fingerprint(text).tolist() == slow_signature(text)


def test_order_counts():
    a, b = sentence(1, 300), sentence(2, 300)
    mixed = " ".join(sorted(a.split()))
    sig = ordermin.fingerprint
    assert ordermin.likeness(sig(a), sig(a)) == 1
    assert ordermin.likeness(sig(a), sig(ordermin.edited(a, b))) > ordermin.likeness(sig(a), sig(mixed))


def test_tiles_make_no_difference(monkeypatch):
    text = sentence(5, 500)
    whole = ordermin.fingerprint(text).tolist()
    monkeypatch.setattr(ordermin, "TILE", 97)
    assert ordermin.fingerprint(text).tolist() == whole


def test_pairs_with_next(spark):
    rows = sorted(((i if i is not None else -(2**63), t or "") for i, t, *_ in documents()))
    want = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        e = ordermin.edited(t, following)
        f, fe, fn = (ordermin.fingerprint(x) for x in (t, e, following))
        want.append((None if i == -(2**63) else i, len(t), hashlib.sha256(e.encode()).hexdigest(), ordermin._hex(f), ordermin._hex(fe), ordermin.likeness(f, fe), ordermin.likeness(f, fn)))
    assert sorted(map(tuple, ordermin.with_next(frame(spark)).collect()), key=str) == sorted(want, key=str)
    assert ordermin.with_next(frame(spark, [])).collect() == []
    assert len(ordermin.with_next(frame(spark, documents()[:1])).collect()) == 1


# ------------------------------------------------------------------ 3 quality


def test_qda_against_plain_densities():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, quality.D)), rng.normal(1, 2, (120, quality.D))])
    y = np.repeat([0, 1], [80, 120])
    n = np.array([80.0, 120.0])
    first = np.stack([x[y == c].sum(0) for c in (0, 1)])
    second = np.stack([x[y == c].T @ x[y == c] for c in (0, 1)])
    model = quality.solve(n, first, second)
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    scale = np.sqrt((covs[0].diagonal() * 80 + covs[1].diagonal() * 120) / 200)
    density = []
    for c, cov in enumerate(covs):
        r = cov / np.outer(scale, scale)
        r = 0.9 * r + (0.1 * max(np.trace(r) / quality.D, quality.FLOOR) + quality.FLOOR) * np.eye(quality.D)
        full = r * np.outer(scale, scale)
        d = x - x[y == c].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(full), d) - 0.5 * np.linalg.slogdet(full)[1])
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0] + math.log(120 / 80), -40, 40)))
    assert np.allclose(model.scores(x), want, atol=1e-8)


def slow_statistics(text):
    data = text.encode()
    n, words, lines = len(data), data.split(), data.split(b"\n")
    of = lambda chars: math.log((sum(data.count(bytes([c])) for c in chars) + 1) / (n + 40))
    types = math.log((len(set(words)) + 5) / (len(words) + 5)) + 0.15 * math.log1p(len(words) / 50)
    echo = sum(a == b for a, b in zip(words, words[1:]))
    return [math.log1p(n), math.log((n + 6) / (len(words) + 1)), *map(of, quality.CLASSES.values()), types, math.log((echo + 0.3) / (len(words) + 20)), math.log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 4))]


def test_quality_moments_by_hand(spark):
    """The plan's sums against plain ones over the labelled texts, whichever way the labelled rows are found."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    x = {c: np.array([slow_statistics(text[r.doc_id]) for r in labels.collect() if r.quality == c]) for c in (0, 1)}
    assert np.allclose(quality.statistics(text[0].encode()), slow_statistics(text[0]))
    want = quality.solve(np.array([len(x[c]) for c in (0, 1)], dtype=float), np.stack([x[c].sum(0) for c in (0, 1)]), np.stack([x[c].T @ x[c] for c in (0, 1)]))
    rows = quality.featured(docs, "text", "_x")
    for model in (quality.fit(docs, labels), quality.fit_measured(rows.withColumnRenamed("doc_id", "_id"), labels)):
        assert np.allclose(model.mean, want.mean) and np.allclose(model.factor, want.factor) and model.share == want.share
    a = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, want).collect()}
    assert a == {r.doc_id: (r.score, r.predicted) for r in quality.score_measured(rows, want).collect()}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality_qda(spark, sf).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.9


def test_quality_without_labels(spark):
    df, none = frame(spark), spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(df, quality.fit(df, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(df, quality.fit(df, one)).collect()} == {1.0}
    assert quality.score(frame(spark, []), quality.Model(0.5)).collect() == []
    assert "score" in quality.score(df.withColumnRenamed("lang", "Score"), quality.Model(0.5)).columns


# ------------------------------------------------------------------ 4 sharding


def test_table_is_fair_and_stable():
    names = [f"s{i}" for i in range(10)]
    t = sharding.fill(names, 4099)
    sizes = [t.count(i) for i in range(10)]
    assert max(sizes) - min(sizes) <= 1
    less = sharding.fill(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(t, less) if a != 9)
    assert moved < 0.2 * 4099
    with pytest.raises(ValueError):
        sharding.fill(names, 100)


def test_table_by_turns():
    assert queries.shard_table_text() == ",".join(map(str, sharding.fill(queries.SHARD_NAMES)))


def test_placement(spark):
    assert differences(queries.op4_sharding(spark, SF), SF, queries.op4_sql()) is None
    df = frame(spark).withColumnRenamed("lang", "shard")
    rows = sharding.place(df, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(rows) == len(documents()) and all(r.shard in (0, 1, 2) for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 9}) == 1
    spread = sharding.place(spark.range(4000).selectExpr("'hot' as k", "id"), "k", [f"s{i}" for i in range(8)], 1009, spread=64, spread_by="id")
    assert spread.select("shard").distinct().count() == 8
    assert sharding.place(frame(spark, []), "doc_id", ["a"], 101).collect() == []


# ------------------------------------------------------------------ 5 toxicity


def test_ordinal_gradient_finds_thresholds():
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.normal(size=n)
    noise = rng.logistic(size=n)
    grade = (2 * x + noise > 0).astype(int) + (2 * x + noise > 2) + (2 * x + noise > 4)
    w, theta = toxicity.ordinal_fit(np.arange(n), np.zeros(n, dtype=int), x, grade, np.ones(n), 1, l2=0)
    assert abs(w[0] - 2) < 0.25 and np.allclose(theta, [0, 2, 4], atol=0.3)
    assert (np.diff(theta) > 0).all()


def test_toxicity_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 5 <> 0"))
    rows = toxicity.score(docs, model).join(labels.withColumnRenamed("toxic", "truth").drop("quality"), "doc_id").filter("doc_id % 5 = 0").collect()
    toxic = [r for r in rows if r.truth]
    clean = [r for r in rows if not r.truth]
    assert sum(r.toxic for r in toxic) > 0.7 * len(toxic)
    assert sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.severity_grade <= 3 for r in rows)
    assert len({r.severity_grade for r in rows}) >= 3


def test_toxicity_by_hand(spark):
    """Features, their choice and the scores against plain loops."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    n = {c: sum(v == c for v in truth.values()) for c in (0, 1)}
    inside = {c: {} for c in (0, 1)}
    for i, c in truth.items():
        for b in toxicity.buckets_of(text[i]):
            inside[c][b] = inside[c].get(b, 0) + 1
    want = {}
    for b in {*inside[0], *inside[1]}:
        k = {c: inside[c].get(b, 0) for c in (0, 1)}
        both = (k[0] + k[1]) / (n[0] + n[1])
        z = abs(k[1] / n[1] - k[0] / n[0]) / math.sqrt(max(both * (1 - both), 1e-12) * (1 / n[1] + 1 / n[0]))
        if k[0] + k[1] >= toxicity.MIN_ROWS and z >= toxicity.SIGNIFICANT:
            want[b] = (math.log((k[1] + 0.5) / (n[1] + 1)) - math.log((k[0] + 0.5) / (n[0] + 1)), z)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "toxic", "text").mapInArrow(toxicity.counted_features, "_id long, _label int, b array<int>, v array<double>")
    got = {r.b: (r.odds, r.z) for r in toxicity.telling(rows, n[0], n[1], toxicity.FEATURES, toxicity.MIN_ROWS, toxicity.SIGNIFICANT).collect()}
    assert set(got) == set(want) and all(np.allclose(got[b], want[b]) for b in want)
    model = toxicity.fit(docs, labels)
    assert set(np.flatnonzero(model.weight)) <= set(want) and len(model.theta) == 3 and (np.diff(model.theta) > 0).all()
    for r in toxicity.score(docs, model).collect():
        margin = sum(float(model.weight[b]) * math.log1p(c) for b, c in toxicity.buckets_of(r.text).items())
        p = [1 / (1 + math.exp(t - margin)) for t in model.theta]
        assert np.allclose([r.expected_severity, r.p_toxic], [sum(p), p[0]], atol=1e-6)
        assert r.severity_grade == sum(x >= 0.5 for x in p) and r.toxic == (p[0] >= 0.5)


def test_three_thresholds_when_hits_tie():
    grade = toxicity.grades(np.array([0, 0, 1, 1, 1]), np.array([0, 0, 2, 2, 2]))
    assert grade.tolist() == [0, 0, 1, 1, 1]
    w, theta = toxicity.ordinal_fit(np.arange(5), np.zeros(5, dtype=int), np.array([0, 0, 1.0, 1, 1]), grade, np.ones(5), 1)
    assert len(theta) == 3 and (np.diff(theta) > 0).all() and w[0] > 0


def test_toxicity_edges(spark):
    df = frame(spark)
    none = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, toxicity.fit(df, none)).collect()
    assert {(r.expected_severity, r.toxic) for r in rows} == {(0.0, 0)}
    both = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, both)
    assert len(toxicity.score(df.withColumnRenamed("source", "p_toxic"), model).collect()) == len(documents())
    assert toxicity.score(frame(spark, []), model).collect() == []


# ------------------------------------------------------------------ 6 chat


CONV = "conv_id long, turn long, role string, text string"
ODD = ["<|im_end|>", "<\\|im_start|>", "<", "|im_end|>", "<\\\\|", "a\nb", "", None, "<|<|\\|>|", "\\n<|im_start|>user\n"]


def test_chat_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ODD)]
    rows += [(2, 1, "assistant", "first"), (2, 2, "user", "x"), (3, None, None, None), (None, 0, "user", "u"), (4, 0, "us\ner\\n", "t"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame(rows, CONV)
    read = {r.conv_id: r for r in chat.read_back(chat.conversations(df)).collect()}
    assert [(t.role, t.text) for t in read[1].turns_read] == [(r, t or "") for _, _, r, t in rows[: len(ODD)]]
    assert list(read[1].loss_read) == [t or "" for t in ODD[1::2]]
    assert "".join(s.text for s in read[1].segments) == read[1].formatted
    assert read[1].valid and not read[2].valid and not read[3].valid and read[None].valid and not read[4].valid
    assert read[2].first_illegal == 1 and read[5].first_illegal == 2 and len(read[5].turns_read) == 2
    assert [(t.role, t.text) for t in read[4].turns_read] == [("us\ner\\n", "t")]
    pieces = chat.segments(df).collect()
    assert len(pieces) == 4 * len(rows)
    assert chat.conversations(spark.createDataFrame([], CONV)).collect() == []


def test_roles_of_any_text(spark):
    rows = [(i, 0, r, "t") for i, r in enumerate(["\x00", "a\x00b\\", "\\n", "\\b\n", "<|im_start|>", "<\\|x", "\\\\", "b\nn"])]
    read = {r.conv_id: r.turns_read for r in chat.read_back(chat.conversations(spark.createDataFrame(rows, CONV))).collect()}
    assert {i: [(t.role, t.text) for t in x] for i, x in read.items()} == {i: [(r, "t")] for i, _, r, _ in rows}


def test_loss_is_read_under_the_mask(spark):
    """Only ``formatted`` and the mask count: with other segments the loss text stays the same."""
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|>q"), (1, 1, "assistant", "a<|im_start|>\U0001f600 é"), (1, 2, "user", ""), (1, 3, "assistant", "")], CONV)
    made = chat.conversations(df)
    r = chat.read_back(made.drop("segments")).head()
    assert list(r.loss_read) == ["a<|im_start|>\U0001f600 é", ""]
    turns = r.formatted.split("<|im_start|>")[1:]
    under = ["<|im_start|>" + t for t in turns]
    assert [under[i][s.offset : s.offset + s.length] for i, spans in enumerate(r.loss_mask) for s in spans] == ["a<\\|im_start|>\U0001f600 é", ""]


def test_other_template(spark):
    plain = chat.Template(transitions={"": ["q"], "q": ["a"], "a": ["q"]}, accepting=("a",), turn_open="<|turn|>", turn_close="<|end|>", turn_gap="", loss_roles=("a",), loss_on_close=True)
    df = spark.createDataFrame([(1, 0, "q", "why <|end|>?"), (1, 1, "a", "so")], CONV)
    r = chat.read_back(chat.conversations(df, plain), plain).head()
    assert r.valid and [(t.role, t.text) for t in r.turns_read] == [("q", "why <|end|>?"), ("a", "so")]
    assert [s.loss for s in r.segments] == [False, False, False, False, False, True, True, False]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_chat_sql(spark, sf):
    assert differences(queries.op6_chat_format(spark, sf), sf, queries.OP6_SQL) is None


# ------------------------------------------------------------------ 8 packing


def least_padding(lengths, counts, k):
    m = len(lengths)
    return min(
        sum(n * (next(lengths[e] for e in ends if lengths[e] >= x) - x) for x, n in zip(lengths, counts))
        for size in range(1, min(k, m) + 1)
        for ends in ((*c, m - 1) for c in itertools.combinations(range(m - 1), size - 1))
    )


def test_boundaries_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(60):
        m = int(rng.integers(1, 10))
        lengths = np.sort(rng.choice(np.arange(1, 60), m, replace=False))
        counts = rng.integers(1, 30, m)
        k = int(rng.integers(1, 5))
        ends, cost = packing.boundaries(lengths, counts, k)
        assert cost == least_padding(lengths.tolist(), counts.tolist(), k)
        assert len(ends) <= k and ends[-1] == lengths[-1]
    assert packing.boundaries([], []) == ([], 0)


@pytest.mark.parametrize("group", [50_000, 7])
def test_batches(spark, group):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, budget=4000, k=5, group=group).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    text = {r.doc_id: r.text for r in docs.collect()}
    batches = {}
    for r in rows:
        assert r.n_tokens == len(text[r.doc_id].split()) + 1 and r.padded_to >= r.n_tokens
        batches.setdefault(r.batch_id, []).append(r)
    open_batches = 0
    for own in batches.values():
        assert len({(r.bucket, r.padded_to) for r in own}) == 1
        room = max(1, 4000 // own[0].padded_to)
        assert sorted(r.place for r in own) == list(range(len(own))) and len(own) <= room
        open_batches += len(own) < room
    assert open_batches <= 5


def test_long_texts_have_exact_bounds(spark):
    rows = [(i, " ".join(["x"] * (n - 1)), "en", "s", n) for i, n in enumerate([11, 3000, 3001, 3002])]
    assert {r.n_tokens: r.padded_to for r in packing.pack(frame(spark, rows)).collect()} == {11: 11, 3000: 3000, 3001: 3001, 3002: 3002}
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.choice(np.arange(1, 9000), 10, replace=False))
    rows = [(i, None, "en", "s", int(n)) for i, n in enumerate(np.repeat(lengths, 3))]
    out = packing.pack(frame(spark, rows), k=4, length_col="n_chars").collect()
    assert sum(r.padded_to - r.n_tokens for r in out) == least_padding(lengths.tolist(), [3] * 10, 4)


@pytest.mark.parametrize("group", [8192, 20])
def test_one_id_many_times(spark, group):
    """A null or repeated id is dealt out like others: no row is lost, places run on."""
    df = spark.range(700).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5L, id)) as doc_id", "'a b c' as text")
    rows = packing.pack(df, budget=40, group=group).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in df.collect())
    assert sorted((int(r.batch_id.split("-")[1]), r.place) for r in rows) == [(i // 10, i % 10) for i in range(700)]


def test_packing_joins_its_rows(spark):
    df = frame(spark, [(i, sentence(i, i + 1), "en", "s", 1) for i in range(20)]).withColumnRenamed("lang", "bucket")
    rows = packing.joined(df, packing.pack(df)).collect()
    assert len(rows) == 20 and all(r.n_tokens == len(r.text.split()) + 1 and r.source == "s" for r in rows)


def test_packing_edges(spark):
    rows = packing.pack(frame(spark), budget=100).collect()
    assert len(rows) == len(documents())
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 12)} == {1}
    assert packing.pack(frame(spark, [])).collect() == []
    blanks = spark.createDataFrame([(1, " a  b\tc \n"), (2, "a\x0bb")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in packing.pack(blanks).collect()} == {1: 4, 2: 3}


# ------------------------------------------------------------------ 9 BPE

PATH = P.path("byte_bpe_50k.json")


def test_bpe_as_the_library():
    lib = tokenizers.Tokenizer.from_file(PATH)
    own = bpe.tokenizer(PATH)
    odd = ["", " ", "\n\n  x", "a<|endoftext|>b <|endoftext|>", "don't we'll I'M", "x" * 3000, "ab" * 700, "12345 678", "é東京\U0001f600", "\u00a0\u2003 x\r\n\t", "a\u0301\u0000b", "  lead", "…!?—", "z" * 257 + " " + "hello" * 60]
    for text in odd + [t or "" for _, t, *_ in documents()]:
        want = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)
    for ids in ([220, 128], [50256, 447], list(range(0, 50257, 501))):
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_table(spark):
    lib = tokenizers.Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, SF).collect():
        ids = np.array(lib.encode(docs[r.doc_id], add_special_tokens=False).ids, dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.encode(frame(spark).withColumnRenamed("lang", "ids"), PATH).collect()
    assert len(rows) == len(documents()) and all(r.decoded == (r.text or "") for r in rows)
    assert bpe.encode(frame(spark, []), PATH).collect() == []


def test_unknown_tokenizer_settings_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.refuse_unknown(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.refuse_unknown(spec | change)


# ------------------------------------------------------------------ 10 SimHash


def slow_fingerprint(data, k=3):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", data) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """{id: least id} by union of all pairs within two bits."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(rows)), key=str)


@pytest.mark.parametrize("limit", [4096, 4])
def test_simhash_by_hand(spark, limit):
    rows = [(i, slow_fingerprint((t or "").encode())) for i, t, *_ in documents()]
    assert sorted(map(tuple, simhash.grouped(frame(spark), limit=limit).collect()), key=str) == slow_components(rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, slow_fingerprint(r.text.encode())) for r in docs.collect()]
    assert sorted(map(tuple, simhash.grouped(docs, limit=limit).collect()), key=str) == slow_components(rows)
    assert simhash.grouped(frame(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [4096, 40, 3])
def test_links_of_a_dense_ball(spark, limit):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2**63, 3)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(120):
            flips = rng.integers(0, 64, rng.integers(1, 4))
            x = b
            for f in flips.tolist():
                x ^= 1 << f
            fps.add(x - 2**64 if x >> 63 else x)
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    got = [tuple(sorted((r.u, r.v))) for r in simhash.links(df, limit).collect()]
    want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 3), (7, 7), (3, 100)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {roots[i] for i in range(20)} == {0} and {roots[i] for i in range(20, 40)} == {20} and roots[100] == 0
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_of_each_group_stays(spark):
    rows = documents()
    kept = simhash.deduplicated(frame(spark)).collect()
    classes = {}
    for d, _, c in slow_components([(i, slow_fingerprint((t or "").encode())) for i, t, *_ in rows]):
        classes.setdefault(c, set()).add(d)
    assert len(kept) == len(classes) and {r.doc_id for r in kept if r.doc_id is not None} == {c for c in classes if c is not None}
    assert simhash.deduplicated(frame(spark, [])).collect() == []
