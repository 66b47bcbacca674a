"""Removal of repeated passages by a logarithmic family of suffix arrays (operator 7).

A byte goes if a string of WIDTH bytes that covers it also starts in a document of a smaller
id. All texts are judged on the input.

Sampling. Among the K-byte strings of a window of WIDTH bytes the one of least hash is its anchor.
Equal windows have equal anchors, so every repeat shows at an anchor, about one suffix in
eighteen. The windows of one anchor are neighbours and make a span of WIDTH to 2 WIDTH - K bytes.
A sampled suffix is a record: fingerprint of its anchor, then of its span, document, place. Records are
ordered by fingerprint, which serves equality as the order by bytes does and is a fifth of the size.

Index. Records go to one task for each range of anchors. There every batch that arrives is sorted (its
suffix array), scanned in step with each level of the index for equal suffixes, and becomes a level; levels
of equal size merge into one of twice the size. The index keeps the records of the least document of each
span; a record that meets one of a lesser document is a repeat and leaves. The outcome does not depend on the order of batches.

Edges. At the edge of a repeated passage a span differs although some of its windows repeat. Where an anchor
has several spans left in the index, the bytes of these (not of their repeats) come from the texts to the same
task, and their windows go through a second index. Fingerprints have 96 bits or more; no passage is taken on less.

All rows move as blocks of packed arrays, one for each task and target: records take about 16 bytes, texts are compressed.
Texts are read whole; a null text is empty, a text under WIDTH bytes repeats nothing. A null id counts as the least and
is returned as null. Rows of equal id don't repeat each other. Columns other than id and text are left alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIN_LONG, checkpointed, in_tasks, release, shuffle_partitions

WIDTH, K = 50, 20
#: Text bytes whose records are made together, and those that are dealt to blocks together.
CHUNK, FLUSH = 1 << 19, 24 << 20
#: Records of a batch that gets a suffix array.
BATCH = 1 << 18
#: Texts whose records or rows a task takes; one goes through its ranges of anchors one after the other.
PER_TASK = 4096
BLOCKS = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.BinaryType())])
RECORDS, ASKED, REPEATS, EDGES, TEXTS = 0, 1, 2, 3, 9
_U = np.uint64


# ---------------------------------------------------------------- packed arrays


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; each is compressed if that helps."""
    out = [struct.pack("<H", len(arrays))]
    squeeze = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        plain = a.tobytes()
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else plain
        small = squeeze.compress(planes)
        packed = len(small) < 0.9 * len(plain)
        body = small if packed else plain
        out.append(struct.pack("<2sBQQ", a.dtype.str[1:].encode(), packed, len(a), len(body)))
        out.append(body)
    return b"".join(out)


def load(block: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<H", block), 2, []
    expand = zstandard.ZstdDecompressor()
    for _ in range(n):
        code, packed, count, size = struct.unpack_from("<2sBQQ", block, at)
        at += 19
        dtype = np.dtype("<" + code.decode())
        if packed:
            planes = np.frombuffer(expand.decompress(block[at : at + size], max_output_size=count * dtype.itemsize), dtype=np.uint8)
            a = np.ascontiguousarray(planes.reshape(dtype.itemsize, count).T).view(dtype).reshape(-1) if dtype.itemsize > 1 else planes.view(dtype)
        else:
            a = np.frombuffer(block, dtype=dtype, count=count, offset=at)
        out.append(a)
        at += size
    return out


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    pid, kind, block = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.binary())], names=["pid", "kind", "block"])


def by_target(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each target and the places of its entries, in their order."""
    order = np.argsort(target, kind="stable")
    sorted_ = target[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, dtype=int)
    for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
        yield int(sorted_[a]), order[a:b]


# ---------------------------------------------------------------- fingerprints


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


#: Random values of the bytes, and odd multipliers for two rolling hashes.
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
MULT = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(MULT[which], -1, 1 << 64) if inverse else MULT[which]
        size = max(n, CHUNK + (1 << 18))
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _powers[which, inverse] = np.multiply.accumulate(step)
        if size > 4 * CHUNK:  # a very long text's powers aren't kept
            del _powers[which, inverse]
    return have[:n]


class Prefix:
    """Rolling fingerprints of any substring of a buffer."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        n = len(buf)
        self.inverse = powers(which, n + 1, True)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(LETTER[buf] * powers(which, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def spans(buf: np.ndarray, ends: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of every anchor in texts laid end to end (``ends``): text number, start in the buffer, length, fingerprints of anchor and span."""
    n = len(buf)
    n_windows = n - width + 1
    if n_windows <= 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    base, size = LETTER[buf], 1
    h, have = None, 0  # h: rolling hash of ``have`` bytes
    mult = MULT[1]
    while True:
        if k & size:
            if h is None:
                h, have = base, size
            else:
                m = n - have - size + 1
                h = h[:m] * _U(pow(mult, size, 1 << 64)) + base[have : have + m]
                have += size
        if 2 * size > k:
            break
        base = base[:-size] * _U(pow(mult, size, 1 << 64)) + base[size:]
        size *= 2
    grams = mix(h)
    least = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach, window = 1, width - k + 1
    while 2 * reach <= window:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < window:
        least = np.minimum(least[: -(window - reach)], least[window - reach :])
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    crossing = np.zeros(n_windows + 1, dtype=np.int32)  # windows that don't lie in one text
    inner = ends[:-1]
    np.add.at(crossing, np.minimum(np.maximum(inner - width + 1, 0), n_windows), 1)
    np.add.at(crossing, np.minimum(inner, n_windows), -1)
    anchor[np.cumsum(crossing[:-1]) > 0] = -1
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [n_windows]])
    real = anchor[starts] >= 0
    starts, stops = starts[real], stops[real]
    length = stops - starts + width - 1
    return np.searchsorted(ends, starts, "right"), starts, length, grams[anchor[starts]], Prefix(buf).of(starts, starts + length)


# ---------------------------------------------------------------- the index


class Records:
    """Columns c, x (fingerprint), doc, uid, start, length of suffixes, ordered by c and x."""

    NAMES = ("c", "x", "doc", "uid", "start", "length")

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.c)

    def take(self, at: np.ndarray) -> Records:
        return Records(**{n: getattr(self, n)[at] for n in self.NAMES})

    @staticmethod
    def join(parts: list[Records]) -> Records:
        return Records(**{n: np.concatenate([getattr(p, n) for p in parts]) for n in Records.NAMES})

    @staticmethod
    def array(parts: list[Records]) -> Records:
        """The suffix array of unordered records."""
        whole = Records.join(parts)
        return whole.take(np.lexsort((whole.doc, whole.x, whole.c)))

    @staticmethod
    def merge(a: Records, b: Records) -> Records:
        whole = Records.join([a, b])
        whole = whole.take(np.argsort(whole.c, kind="stable"))
        same = whole.c[1:] == whole.c[:-1]
        wrong = same & (whole.x[1:] < whole.x[:-1])
        if wrong.any():  # few runs of equal c hold several x; only these are sorted by it
            run = np.cumsum(np.concatenate([[False], ~same]))
            mixed = np.zeros(run[-1] + 1, dtype=bool)
            mixed[run[1:][wrong]] = True
            at = np.flatnonzero(mixed[run])
            order = np.arange(len(whole))
            order[at] = at[np.lexsort((whole.x[at], whole.c[at]))]
            whole = whole.take(order)
        return whole

    def search(self, c: np.ndarray, x: np.ndarray, side: str = "left") -> np.ndarray:
        """Where each (c, x) would go in, as ``np.searchsorted``."""
        low = np.searchsorted(self.c, c)
        within = np.minimum(low, max(len(self) - 1, 0))
        left = np.flatnonzero((low < len(self)) & (self.c[within] == c))
        high = low.copy()
        high[left] = np.searchsorted(self.c, c[left], "right")
        while len(left):
            middle = (low[left] + high[left]) // 2
            after = self.x[middle] <= x[left] if side == "right" else self.x[middle] < x[left]
            low[left[after]] = middle[after] + 1
            high[left[~after]] = middle[~after]
            left = left[low[left] < high[left]]
        return low


class LevelFamily:
    """Suffix arrays of about BATCH * 2^i records; at most one of each i."""

    def __init__(self) -> None:
        self.levels: list[Records | None] = []

    def add(self, new: Records) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Take in a batch's suffix array; the repeats found, as uid, start and length."""
        found = []

        def out(rows: Records, at: np.ndarray) -> Records:
            if at.any():
                gone = rows.take(at)
                found.append((gone.uid, gone.start, gone.length))
                rows = rows.take(~at)
            return rows

        if not len(new):
            return found
        heads = np.concatenate([[True], (new.c[1:] != new.c[:-1]) | (new.x[1:] != new.x[:-1])])
        first = np.flatnonzero(heads)
        least = new.doc[first][np.cumsum(heads) - 1]  # the array is ordered by document within a suffix
        new = out(new, new.doc > least)
        for i, level in enumerate(self.levels):
            if level is None or not len(new):
                continue
            at = level.search(new.c, new.x)
            inside = np.minimum(at, len(level) - 1)
            equal = (at < len(level)) & (level.c[inside] == new.c) & (level.x[inside] == new.x)
            older = np.zeros(len(new), dtype=bool)
            older[equal] = new.doc[equal] > level.doc[inside[equal]]
            newer = np.flatnonzero(equal)
            newer = newer[new.doc[newer] < level.doc[inside[newer]]]
            if len(newer):
                lost = np.zeros(len(level) + 1, dtype=np.int64)
                np.add.at(lost, at[newer], 1)
                np.add.at(lost, level.search(new.c[newer], new.x[newer], "right"), -1)
                level = out(level, np.cumsum(lost[:-1]) > 0)
                self.levels[i] = level if len(level) else None
            new = out(new, older)
        i = 0
        while len(new):
            if i == len(self.levels):
                self.levels.append(None)
            if self.levels[i] is None and len(new) <= BATCH << i:
                self.levels[i] = new
                break
            if self.levels[i] is not None:
                new = Records.merge(self.levels[i], new)
                self.levels[i] = None
            i += 1
        return found

    def ambiguous(self) -> Records | None:
        """The records of anchors with several spans, from several documents."""
        whole = None
        for level in self.levels:
            if level is not None:
                whole = level if whole is None else Records.merge(whole, level)
        if whole is None:
            return None
        group = whole.c >> _U(24)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(heads, len(group)))
        spans_differ = (np.minimum.reduceat(whole.c, heads) != np.maximum.reduceat(whole.c, heads)) | (np.minimum.reduceat(whole.x, heads) != np.maximum.reduceat(whole.x, heads))
        docs_differ = np.minimum.reduceat(whole.doc, heads) != np.maximum.reduceat(whole.doc, heads)
        return whole.take(np.repeat(spans_differ & docs_differ, sizes))


# ---------------------------------------------------------------- tasks


def uid_of(key: int, text: bytes) -> int:
    """Names a row: rows of equal id and text are alike in all that follows."""
    return xxhash.xxh64_intdigest(text, seed=key & 0xFFFFFFFF) ^ (key & 0xFFFFFFFFFFFFFFFF)


def chunked(items: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Lists of items whose texts (their last part) have about ``size`` bytes."""
    held, n = [], 0
    for item in items:
        held.append(item)
        n += len(item[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])


def places(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray]:
    """Starts as gaps within each text; rows are ordered by text and start."""
    gaps = np.diff(start, prepend=0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    gaps[first] = start[first]
    return (gaps.astype(np.uint32),)


def owners(doc: np.ndarray, keys: np.ndarray, uids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids, uids and record counts of the texts that ordered rows belong to."""
    own, count = np.unique(doc, return_counts=True)
    return keys[own], uids[own], count.astype(np.uint32)


def record_blocks(n: int):
    """Texts to blocks of records, one for each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunked(documents(batches), FLUSH):
            keys = np.array([k for k, _ in some], dtype=np.int64)
            uids = np.array([uid_of(k, t) for k, t in some], dtype=np.uint64)
            parts, done = [], 0
            for group in chunked(iter(some), CHUNK):
                buf, ends = laid([t for _, t in group])
                doc, start, length, g, s = spans(buf, ends)
                origin = np.concatenate([[0], ends])[doc]
                parts.append((doc + done, start - origin, length, g, s))
                done += len(group)
            doc, start, length, g, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = []
            for target, at in by_target(((g & _U(0xFFFFFF)) % _U(n)).astype(np.int64)):
                c = ((g[at] >> _U(24)) << _U(24)) | (s[at] >> _U(40))
                rows.append((target, RECORDS, dump(c, s[at].astype(np.uint32), *places(doc[at], start[at]), length[at].astype(np.uint8), *owners(doc[at], keys, uids))))
                if len(rows) >= 256:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    return run


def placed(gaps: np.ndarray, length: np.ndarray, keys: np.ndarray, uids: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Document, uid, start and length of each record of a block."""
    count = count.astype(np.int64)
    first = np.cumsum(count) - count
    start = np.cumsum(gaps.astype(np.int64))
    start -= np.repeat(start[first] - gaps[first].astype(np.int64), count)
    return {"doc": np.repeat(keys, count), "uid": np.repeat(uids, count), "start": start.astype(np.uint32), "length": length}


def read_records(block: bytes) -> Records:
    c, x, *rest = load(block)
    return Records(c=c, x=x, **placed(*rest))


def marks(kind: int, n: int, uid: np.ndarray, start: np.ndarray, length: np.ndarray, home: int = 0) -> list[tuple[int, int, bytes]]:
    """Blocks of (uid, start, length, the task that sent them), one for each target of the texts."""
    return [(target, kind, dump(uid[at], start[at].astype(np.uint32), length[at].astype(np.uint8), np.full(len(at), home, dtype=np.uint32))) for target, at in by_target((uid % _U(n)).astype(np.int64))]


def index_task(n: int, read, ask: bool):
    """Blocks, ``read`` as records, to marks of repeats and, with ``ask``, of spans whose windows are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, size, now = LevelFamily(), [], 0, None
        repeats: list[tuple[np.ndarray, ...]] = []
        n_repeats = 0

        def settle() -> None:
            nonlocal held, size, n_repeats
            if held:
                for r in family.add(Records.array(held)):
                    repeats.append(r)
                    n_repeats += len(r[0])
            held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal repeats, n_repeats
            if repeats:
                yield batch(marks(REPEATS, n, *(np.concatenate(x) for x in zip(*repeats, strict=True))))
            repeats, n_repeats = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            settle()
            yield from flush()
            if ask and (left := family.ambiguous()) is not None and len(left):
                yield batch(marks(ASKED, n, left.uid, left.start, left.length, now))

        for b in batches:
            for pid, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if pid != now:
                    yield from close()
                    family, now = LevelFamily(), pid
                rows = read(block)
                held.append(rows)
                size += len(rows)
                if size >= BATCH:
                    settle()
                if n_repeats >= 1 << 21:
                    yield from flush()
        yield from close()

    return run


def text_blocks(n: int):
    """Texts, and any columns that follow id and text, to compressed blocks, one for each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            if not b.num_rows:
                continue
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            others = b.select(list(range(2, b.num_columns))) if b.num_columns > 2 else None
            uids = np.array([uid_of(k, t) for k, t in zip(keys, texts, strict=True)], dtype=np.uint64)
            rows = []
            for target, at in by_target((uids % _U(n)).astype(np.int64)):
                own = [texts[i] for i in at]
                head = dump(uids[at], np.array([keys[i] for i in at], dtype=np.int64), np.array([len(t) for t in own], dtype=np.int64))
                rest = b""
                if others is not None:
                    sink = pa.BufferOutputStream()
                    part = others.take(pa.array(at))
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    rest = squeeze.compress(sink.getvalue().to_pybytes())
                rows.append((target, TEXTS, struct.pack("<QQ", len(head), len(rest)) + head + rest + squeeze.compress(b"".join(own))))
            yield batch(rows)

    return run


def read_texts(block: bytes) -> tuple[list[int], list[int], list[bytes], pa.RecordBatch | None]:
    """uids, ids, texts and the columns that travel with them."""
    size, rest = struct.unpack_from("<QQ", block)
    uids, keys, lengths = load(block[16 : 16 + size])
    expand = zstandard.ZstdDecompressor()
    others = pa.ipc.open_stream(expand.decompressobj().decompress(block[16 + size : 16 + size + rest])).read_next_batch() if rest else None
    total = int(lengths.sum())
    whole = expand.decompress(block[16 + size + rest :], max_output_size=total) if total else b""
    ends = np.cumsum(lengths).tolist()
    return uids.tolist(), keys.tolist(), [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)], others


class Messages:
    """Marks that came for a partition's texts, found by uid."""

    def __init__(self, parts: list[list[np.ndarray]]):
        uid, start, length, home = (np.concatenate([p[i] for p in parts]) for i in range(4)) if parts else (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)
        order = np.argsort(uid, kind="stable")
        self.start, self.length, self.home = (x[order].astype(np.int64) for x in (start, length, home))
        self.uids, first = np.unique(uid[order], return_index=True)
        self.at = {u: (a, b) for u, a, b in zip(self.uids.tolist(), first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True)}

    def of(self, uid: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at.get(uid, (0, 0))
        return self.start[a:b], self.length[a:b]

    def home_of(self, uid: int) -> np.ndarray:
        a, b = self.at.get(uid, (0, 0))
        return self.home[a:b]


def with_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(messages, uids, ids, texts, others) of each block of texts in sorted (pid, kind, block) rows; a partition's messages come first."""
    now, parts, messages = None, [], None
    for b in batches:
        for pid, kind, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if pid != now:
                now, parts, messages = pid, [], None
            if kind != TEXTS:
                parts.append(load(block))
                continue
            if messages is None:
                messages, parts = Messages(parts), []
            yield (messages, *read_texts(block))


def edge_blocks(n: int):
    """Texts and the spans asked of them to blocks of the spans' bytes, for the task that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked() -> Iterator[tuple]:
            for messages, uids, keys, texts, _ in with_messages(batches):
                for uid, key, text in zip(uids, keys, texts, strict=True):
                    start, length = messages.of(uid)
                    if len(start):
                        yield uid, key, start, length, messages.home_of(uid), text

        for some in chunked(asked(), FLUSH):
            count = [len(x[2]) for x in some]
            doc = np.repeat(np.arange(len(some)), count)
            start, length, home = (np.concatenate([x[i] for x in some]) for i in (2, 3, 4))
            keys = np.array([x[1] for x in some], dtype=np.int64)
            uids = np.array([x[0] for x in some], dtype=np.uint64)
            buf, ends = laid([x[5] for x in some])
            at = start + np.concatenate([[0], ends])[doc]
            rows = []
            for target, to in by_target(home):
                to = to[np.lexsort((start[to], doc[to]))]
                rows.append((target, EDGES, dump(buf[inside(at[to], length[to])], *places(doc[to], start[to]), length[to].astype(np.uint8), *owners(doc[to], keys, uids))))
            yield batch(rows)

    return run


def inside(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions that intervals hold, one interval after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def read_edges(block: bytes, width: int = WIDTH) -> Records:
    """Records of all windows of the spans in a block."""
    buf, gaps, length, keys, uids, count = load(block)
    spans_ = placed(gaps, length, keys, uids, count)
    length = length.astype(np.int64)
    many = length - width + 1
    at = inside(np.cumsum(length) - length, many)
    start = inside(spans_["start"].astype(np.int64), many)
    return Records(c=Prefix(buf).of(at, at + width), x=Prefix(buf, 1).of(at, at + width).astype(np.uint32), doc=np.repeat(spans_["doc"], many), uid=np.repeat(spans_["uid"], many), start=start.astype(np.uint32), length=np.full(len(at), width, dtype=np.uint8))


def covered(start: np.ndarray, length: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs that intervals cover."""
    if not len(start):
        return [], []
    order = np.argsort(start, kind="stable")
    a, b = start[order], (start + length)[order]
    reach = np.maximum.accumulate(b)
    head = np.concatenate([[True], a[1:] > reach[:-1]])
    at = np.flatnonzero(head)
    return a[at].tolist(), reach[np.append(at[1:] - 1, len(a) - 1)].tolist()


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def cut_one(messages: Messages, uid: int, text: bytes) -> tuple[bytes, list[int], list[int]]:
    """What is left of a text, and the starts and ends of what goes."""
    starts, ends = covered(*messages.of(uid))
    kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)) if starts else text
    return kept, starts, ends


def cut_task(full: bool):
    """Texts and their repeats to rows of RESULT; the last two columns only with ``full``."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary()), ("removed", span)] * full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for messages, uids, keys, texts, _ in with_messages(batches):
            rows = []
            for uid, key, text in zip(uids, keys, texts, strict=True):
                kept, starts, ends = cut_one(messages, uid, text)
                row = {"doc_id": None if key == MIN_LONG else key, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(starts), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                if full:
                    row |= {"kept": kept, "removed": [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)]}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def rewrite_task(names: list[str]):
    """Texts and their repeats to the texts' rows (columns ``names``, the text last) with what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for messages, uids, _, texts, others in with_messages(batches):
            left = [cut_one(messages, u, t)[0].decode("utf-8", "ignore") for u, t in zip(uids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(others.columns if others is not None else []), pa.array(left, pa.string())], names=names)

    return run


def deal(rows: DataFrame, n: int) -> DataFrame:
    """Blocks to their targets' tasks, messages before texts."""
    return rows.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "kind")


def matched(df: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """Blocks of the texts of ``df`` with, before them in each task, the marks of what repeats."""
    n, size = shuffle_partitions(df.sparkSession), df.count()
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(MIN_LONG)).alias("_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"), *[F.col(f"`{c}`") for c in others])
    pair = rows.select("_key", "_text")
    records = deal(pair.mapInArrow(record_blocks(n), BLOCKS), n).select("pid", "block")
    first = checkpointed(records.mapInArrow(index_task(n, read_records, True), BLOCKS), size, PER_TASK)
    del records
    release(df.sparkSession)
    asked = deal(first.filter(F.col("kind") == ASKED).unionByName(pair.mapInArrow(text_blocks(n), BLOCKS)), n)
    edges = deal(asked.mapInArrow(edge_blocks(n), BLOCKS), n).select("pid", "block")
    second = checkpointed(edges.mapInArrow(index_task(n, read_edges, False), BLOCKS), size, PER_TASK)
    del asked, edges
    release(df.sparkSession)
    repeats = first.filter(F.col("kind") == REPEATS).unionByName(second)
    return in_tasks(deal(repeats.unionByName(rows.mapInArrow(text_blocks(n), BLOCKS)), n), size, PER_TASK)


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Rows of RESULT for each row of ``df`` (``full``: with the kept bytes and the removed spans)."""
    return matched(df, id_col, text_col, []).mapInArrow(cut_task(full), RESULT if full else T.StructType(RESULT.fields[:5]))


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its texts cut; parts of characters that a cut leaves are dropped, null becomes empty."""
    others = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(text_col, T.StringType())])
    return matched(df, id_col, text_col, others).mapInArrow(rewrite_task(schema.names), schema).select(*[F.col(f"`{c}`") for c in df.columns])
