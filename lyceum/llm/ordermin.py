"""Order MinHash document fingerprints (operator 2).

A text's k-mers of code points are numbered by occurrence. Each of M hash functions
keeps the L smallest numbered k-mers, puts them back in text order and hashes the
tuple: one entry of the signature. Two signatures' share of equal entries estimates
a likeness that falls with edit distance, not only with the set of k-mers.

A text shorter than k is one k-mer; the empty text too. Fewer than L k-mers make a
shorter tuple. Null is the empty text. ``with_next`` pairs each document with the
next by id: rows of equal id are taken in text order, a null id comes first, the
last document's next is the first. Repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIN_LONG, shuffle_partitions

K, L, M = 8, 2, 32
#: Numbers handled at once: M hashes of as many k-mers.
TILE = 1 << 14
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _families(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix((np.arange(2 * m, dtype=np.uint64) + np.uint64(1)) * _GOLD)
    return (seeds[:m] | np.uint64(1)).astype(np.uint32) | np.uint32(1), seeds[m:].astype(np.uint32)


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hash of each k-mer of code points; of the whole text if it is shorter."""
    h = _mix((codes.astype(np.uint64) + np.uint64(1)) * _GOLD)
    if len(h) < k:
        acc = np.uint64(len(h) + 1)
        for x in h:
            acc = _mix(np.array([acc ^ x], dtype=np.uint64))[0]
        return np.array([acc], dtype=np.uint64)
    p = np.uint64(0xD6E8FEB86659FD93)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= p
        out += h[j : len(h) - k + 1 + j]
    return out


def numbered(grams: np.ndarray) -> np.ndarray:
    """32-bit hash of each (k-mer, how often it has occurred before) in text order."""
    n = len(grams)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    keys = np.sort(((_mix(grams) >> bits) << bits) | np.arange(n, dtype=np.uint64))
    pos = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ids = keys >> bits
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    begins = np.flatnonzero(first)
    nth = np.empty(n, dtype=np.uint64)
    nth[pos] = (np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))).astype(np.uint64)
    return (_mix(grams + nth * _GOLD) >> np.uint64(32)).astype(np.uint32)


def smallest(h: np.ndarray, family: tuple[np.ndarray, np.ndarray], l: int = L) -> tuple[np.ndarray, np.ndarray]:
    """For each hash function the l least values and their positions (m x l, value order).

    Of equal values the one that comes first in the text is taken.
    """
    mul, xor = family
    values, places = [], []
    for at in range(0, len(h), TILE):
        v = (h[None, at : at + TILE] ^ xor[:, None]) * mul[:, None]
        rows = np.arange(len(v))
        for _ in range(min(l, v.shape[1])):
            j = v.argmin(axis=1)
            values.append(v[rows, j].copy())
            places.append(j + at)
            v[rows, j] = np.uint32(0xFFFFFFFF)
    return np.stack(values, 1), np.stack(places, 1)


def signature(h: np.ndarray, family: tuple[np.ndarray, np.ndarray], l: int = L) -> np.ndarray:
    """m entries of 32 bits, each the hash of l chosen k-mers in text order."""
    values, places = smallest(h, family, l)
    if values.shape[1] > l:
        best = np.lexsort((places, values), axis=1)[:, :l]
        places = np.take_along_axis(places, best, 1)
    places = np.sort(places, axis=1)
    acc = np.full(len(places), places.shape[1], dtype=np.uint64)
    for c in range(places.shape[1]):
        acc = _mix((acc ^ h[places[:, c]].astype(np.uint64)) * _GOLD)
    return (acc >> np.uint64(32)).astype(np.uint32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def fingerprint(text: str, k: int = K, l: int = L, m: int = M) -> np.ndarray:
    """The Order MinHash signature of one text."""
    return signature(numbered(kmers(codes_of(text), k)), _families(m), l)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first code points of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


#: Bounds are looked up among every STEP-th first, then among the STEP that follow it.
STEP = 32


def array_of(values: list[int]):
    """An array of longs as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def neighbours(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, key, ord, id, text), partitioned by bucket and sorted by key.

    Buckets are ranges of ids between quantiles that are ids themselves. The first row of
    a bucket goes to the bucket before as well (``ord`` 1), the first of all to the last
    bucket, so each bucket holds every document with its next, however the rows fall.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(MIN_LONG)).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    cuts = rows.agg(F.min("key").alias("lo"), F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10000).alias("q")).head()
    bounds = sorted({cuts["lo"], *(cuts["q"] or [])}) if cuts["lo"] is not None else [0]
    n = len(bounds)
    marks = array_of(bounds)
    ahead = F.size(F.filter(array_of(bounds[::STEP]), lambda b: b <= F.col("key"))) - 1
    own = ahead * STEP + F.size(F.filter(F.slice(marks, ahead * STEP + 1, STEP), lambda b: b <= F.col("key"))) - 1
    first = F.when(F.col("key") == F.get(marks, own), F.array(F.struct(own.alias("bucket"), F.lit(0).alias("ord")), F.struct(F.pmod(own - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("ord"))))
    to = F.coalesce(first, F.array(F.struct(own.alias("bucket"), F.lit(0).alias("ord"))))
    dealt = rows.withColumn("to", F.explode(to)).select(F.col("to.bucket").alias("bucket"), F.col("to.ord").alias("ord"), "key", "id", "text")
    return dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ord", "key", "text")


FIELDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M) -> DataFrame:
    """One row per document: its fingerprint and likeness to its edited text and to its next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _families(m)

        def sign(text: str) -> np.ndarray:
            return signature(numbered(kmers(codes_of(text), k)), family, l)

        out: list[tuple] = []
        held = None  # the document whose next hasn't come yet
        done = False  # the next of the bucket's last document has been used

        def pair(following: str, sig: np.ndarray) -> None:
            doc, text, own = held
            other = edited(text, following)
            esig = own if other == text else sign(other)
            out.append((doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), _hex(own), _hex(esig), likeness(own, esig), likeness(own, sig)))

        for b in batches:
            for order, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if order and done:
                    continue
                sig = sign(text)
                if held is not None:
                    pair(text, sig)
                held = (doc, text, sig)
                done = bool(order)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist([dict(zip(FIELDS.names, r, strict=True)) for r in out], schema=arrow)
                    out.clear()
        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS.names, r, strict=True)) for r in out], schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return neighbours(df, id_col, text_col).select("ord", "id", "text").mapInArrow(run, FIELDS)
