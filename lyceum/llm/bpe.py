"""Byte-level BPE encoding and decoding (operator 9).

A word's parts are kept as one contiguous array of (boundary, rank of the pair that starts
there). The array is scanned for the least rank, the boundary after it goes, and the ranks
of the pair and of the one before are looked up anew, until no pair has a rank. A word
longer than LONG bytes, where repeated scans would take quadratic time, keeps its ranks in a heap
instead, with the same choice (least rank, leftmost first) and so the same ids.

The vocabulary comes from a tokenizer file whose path is a parameter; added tokens in
texts are found first, the leftmost and of those the longest. Null is the empty text, which has no
ids. Repeated rows repeat, empty tables stay empty, and columns with new names are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, texts

#: What splits a text into words (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 256
#: Words that a task remembers with their ids, and the bytes a remembered word may have.
REMEMBER, REMEMBER_BYTES = 300_000, 64
NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_unknown(spec: dict) -> None:
    """Raises an error where a tokenizer file sets what isn't done here."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    found = {
        "model": model.get("type", "BPE") != "BPE",
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or not before.get("use_regex", True),
        "add_prefix_space": bool(before.get("add_prefix_space")),
        "decoder": (spec.get("decoder") or {"type": "ByteLevel"}).get("type") != "ByteLevel",
        **{k: bool(model.get(k)) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")},
        "added_tokens": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")),
    }
    if any(found.values()):
        raise ValueError(f"a tokenizer file with settings that aren't supported: {', '.join(k for k, v in found.items() if v)}")


class Tokenizer:
    def __init__(self, vocab: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], added: dict[str, int]):
        self.vocab, self.pairs, self.added = vocab, pairs, added
        self.single = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in added.items()}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        names = sorted(added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    @staticmethod
    def load(path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_unknown(spec)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        text_vocab = spec["model"]["vocab"]
        vocab = {bytes(letters[c] for c in s): i for s, i in text_vocab.items() if s not in added}
        pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs[text_vocab[a], text_vocab[b]] = (rank, text_vocab[a + b])
        return Tokenizer(vocab, pairs, added)

    def word(self, data: bytes) -> list[int]:
        """Ids of one word by the contiguous rank array."""
        ids = [self.single[b] for b in data]
        if len(ids) > LONG:
            return self._long(ids)
        pairs = self.pairs
        get = pairs.get
        missing = (NONE, -1)
        ranks = [get(p, missing)[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = pairs[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), missing)[0]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), missing)[0]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        get = self.pairs.get
        heap = [(r[0], i) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            found = get((ids[i], ids[j])) if ids[i] >= 0 and j >= 0 else None
            if not found or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i))
            h = before[i]
            if h >= 0 and (r := get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str, out: list[int]) -> None:
        known = self.known
        extend = out.extend
        for w in self.split(text):
            found = known.get(w)
            if found is None:
                data = w.encode("utf-8", "surrogatepass")
                found = self.word(data)
                if len(data) <= REMEMBER_BYTES:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[w] = found
            extend(found)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.special is None:
            self._plain(text, out)
            return out
        for part in self.special(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        get = self.bytes_of
        return b"".join([get[i] for i in ids if i in get]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, read once in a process."""
    return Tokenizer.load(path)


FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(df: DataFrame, path: str, text_col: str = "text", keep: bool = True) -> DataFrame:
    """``df`` with FIELDS; the ids and the decoded text themselves only with ``keep``.

    ``path`` is opened on the executors and must be readable there, as an installed package's file is.
    """

    def start():
        tok = tokenizer(path)

        def compute(column: pa.Array) -> list[pa.Array]:
            ids, decoded, n, sha, dsha = [], [], [], [], []
            for text in texts(column):
                x = tok.encode(text)
                back = tok.decode(x)
                a = np.array(x, dtype="<u4")
                n.append(len(x))
                sha.append(hashlib.sha256(a.tobytes()).hexdigest())
                dsha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                if keep:
                    ids.append(a.astype(np.int32))
                    decoded.append(back)
            tail = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dsha, pa.string())]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), *tail] if keep else tail

        return compute

    return add_columns(df, [text_col], FIELDS if keep else FIELDS[2:], start)
