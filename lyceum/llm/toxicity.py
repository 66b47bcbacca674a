"""Severity of toxicity by cumulative-link ordinal regression (operator 5).

P(grade >= k) = 1 / (1 + exp(theta_k - w.x)) for k = 1 .. GRADES - 1: one weight vector for
all thresholds, theta ascending. x is sparse: log(1 + count) of a text's lower-cased words
and their prefixes of four and five letters, hashed to BUCKETS. Expected severity is the sum
of P(grade >= k).

The labels are 0 and 1. Rows labelled 1 get grades 1 to GRADES - 1 by the terciles of how often
features occur in them that are found almost only in rows labelled 1.

The fit uses at most ``max_rows`` labelled ids of each label (SAMPLE by default), those of the
least hash, weighted up to the label's count. In how many of their whole texts a feature occurs is counted inside the
plan; the driver gets the at most ``max_features`` features that tell the labels apart, and those rows' counts of them.
Scoring covers every whole text. Null and empty texts have no feature and get the base rate. Ids or
labels that are null are left out of the fit, of several labels of an id the greatest counts.
Without labels of both kinds every text scores 0. Repeated rows repeat, an empty table stays
empty, and columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, checkpointed, texts

BUCKETS = 1 << 18
GRADES = 4
SAMPLE = 3000
#: Features kept for the fit: those that differ most between the labels.
FEATURES = 8192
MIN_ROWS = 3
#: Least z of the difference between the labels' shares for a feature to enter the fit.
SIGNIFICANT = 4.0
L2 = 1e-4
ROUNDS = 1000
#: Words whose features a task remembers.
REMEMBER = 200_000
WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its prefixes of four and five letters if it is longer."""
    keys = ["w" + word, *(f"p{word[:n]}" for n in (4, 5) if len(word) >= n)]
    return [xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), seed=7) % BUCKETS for k in keys]


def counted(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def buckets_of(text: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for word, n in counted(text).items():
        for b in features(word):
            out[b] = out.get(b, 0) + n
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Rows of the sample in one file of its checkpoint.
PER_FILE = 512


@dataclass
class Model:
    weight: np.ndarray | None  # by bucket; None without labels of both kinds
    theta: np.ndarray

    def exceed(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) by row and k."""
        if self.weight is None:
            return np.zeros((len(margin), len(self.theta)))
        return sigmoid(margin[:, None] - self.theta[None, :])


def ordinal_fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_cols: int, l2: float = L2, rounds: int = ROUNDS, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and n_grades - 1 thresholds by Adam on the weighted likelihood; entries (rows, cols, vals) are x.

    Thresholds are theta_1 plus sums of exponentials, which keeps them ascending. Grades without a row are unlikely ones.
    """
    k = n_grades - 1
    n = len(grade)
    weight = weight / weight.sum()
    rate = np.array([(weight * (grade >= i)).sum() for i in range(1, k + 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - rate) / rate)
    p = np.concatenate([np.zeros(n_cols), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    padded_low, padded_high = grade - 1, grade
    for t in range(1, rounds + 1):
        w, gaps = p[:n_cols], np.exp(p[n_cols + 1 :])
        theta = p[n_cols] + np.concatenate([[0.0], np.cumsum(gaps)])
        margin = np.bincount(rows, weights=w[cols] * vals, minlength=n)
        above = np.concatenate([np.ones((n, 1)), sigmoid(margin[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        low, high = above[at, padded_low + 1], above[at, padded_high + 1]
        prob = np.maximum(low - high, 1e-12)
        # d P(y >= j) / d margin = s (1 - s), zero for the constant columns
        slope = above * (1 - above)
        d_low, d_high = slope[at, padded_low + 1], slope[at, padded_high + 1]
        g_margin = -weight * (d_low - d_high) / prob
        grad = np.zeros_like(p)
        grad[:n_cols] = np.bincount(cols, weights=g_margin[rows] * vals, minlength=n_cols) + l2 * w
        g_theta = np.zeros(k + 2)
        np.add.at(g_theta, padded_low + 1, weight * d_low / prob)
        np.add.at(g_theta, padded_high + 1, -weight * d_high / prob)
        g_theta = g_theta[1 : k + 1]
        grad[n_cols] = g_theta.sum()
        grad[n_cols + 1 :] = np.cumsum(g_theta[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:n_cols], p[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_cols + 1 :]))])


def grades(label: np.ndarray, hits: np.ndarray, n: int = GRADES) -> np.ndarray:
    """0 for label 0; for label 1 the quantile class of the hits, 1 to n - 1."""
    out = np.zeros(len(label), dtype=np.int64)
    own = label == 1
    cuts = np.quantile(hits[own], np.arange(1, n - 1) / (n - 1))
    out[own] = 1 + (hits[own][:, None] > cuts[None, :]).sum(axis=1)
    return out


def sampled(labels: DataFrame, label_col: str, id_col: str, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels, at most ``max_rows`` of each label; and each label's count."""
    rows = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    rows = rows.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    parts = [rows.filter(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def counted_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, text) to (id, label, buckets, log counts)."""
    for b in batches:
        found = [buckets_of(text) for text in texts(b.column(2))]
        values = [[math.log1p(n) for n in x.values()] for x in found]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["_id", "_label", "b", "v"])


def telling(rows: DataFrame, n0: int, n1: int, max_features: int, min_rows: int, significant: float) -> DataFrame:
    """(b, odds, z): buckets by whose shares the labels differ most, with the log ratio of the shares and the two-proportion z."""
    both = rows.select("_label", F.explode("b").alias("b")).groupBy("b").agg(F.sum("_label").alias("in1"), F.sum(1 - F.col("_label")).alias("in0"))
    share = (F.col("in1") + F.col("in0")) / (n1 + n0)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    odds = F.log((F.col("in1") + 0.5) / (n1 + 1)) - F.log((F.col("in0") + 0.5) / (n0 + 1))
    found = both.filter(F.col("in1") + F.col("in0") >= min_rows).select("b", odds.alias("odds"), (F.abs(F.col("in1") / n1 - F.col("in0") / n0) / spread).alias("z"))
    return found.filter(F.col("z") >= significant).orderBy(F.desc("z"), "b").limit(max_features)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = SAMPLE, max_features: int = FEATURES, min_rows: int = MIN_ROWS, significant: float = SIGNIFICANT) -> Model:
    chosen, counts = sampled(labels, label_col, id_col, max_rows)
    none = Model(None, np.zeros(GRADES - 1))
    if len(counts) < 2:
        return none
    # At most 2 max_rows ids: the broadcast is bounded.
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")
    # The scan keeps its tasks; only the sample's features are dealt to a few. A checkpoint numbers them for good.
    found = docs.mapInArrow(counted_features, "_id long, _label int, b array<int>, v array<double>").repartition(max(1, -(-sum(min(n, max_rows) for n in counts.values()) // PER_FILE)))
    rows = checkpointed(found.withColumn("_row", F.monotonically_increasing_id()))
    seen = sorted(map(tuple, rows.select("_row", "_id", "_label").collect()), key=lambda r: (r[1], r[0]))
    label = np.array([r[2] for r in seen], dtype=np.int64)
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    if not n1 or not n0:
        return none
    best = checkpointed(telling(rows, n0, n1, max_features, min_rows, significant), max_features)
    features_ = sorted(map(tuple, best.collect()))
    entries = rows.select("_row", F.explode(F.arrays_zip("b", "v")).alias("e")).select("_row", "e.b", "e.v").join(F.broadcast(best.select("b")), "b")
    # Entries come as columns, not as rows of Python objects: at most 2 max_rows x max_features of them.
    table = entries.toArrow()
    e_row, e_bucket, val = (np.asarray(table.column(c)) for c in ("_row", "b", "v"))
    row_names, buckets = np.array([r[0] for r in seen], dtype=np.int64), np.array([f[0] for f in features_], dtype=np.int64)
    by_name = np.argsort(row_names)
    at = by_name[np.searchsorted(row_names, e_row, sorter=by_name)] if len(e_row) else np.zeros(0, dtype=np.int64)
    col = np.searchsorted(buckets, e_bucket)
    order = np.lexsort((val, col, at))
    at, col, val = at[order], col[order], val[order]
    strong = np.array([odds > math.log(20) and z > 3 for _, odds, z in features_], dtype=bool)
    hits = np.bincount(at, weights=np.expm1(val) * strong[col], minlength=len(seen)) if len(val) else np.zeros(len(seen))
    weight = np.where(label == 1, counts[1] / n1, counts[0] / n0)
    w, theta = ordinal_fit(at, col, val, grades(label, hits), weight, len(features_))
    dense = np.zeros(BUCKETS, dtype=np.float32)
    dense[[f[0] for f in features_]] = w
    return Model(dense, theta)


FIELDS = [T.StructField("expected_severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("severity_grade", T.IntegerType()), T.StructField("toxic", T.IntegerType())]


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with expected severity (0 to GRADES - 1), P(grade >= 1), the grade whose P(grade >= k) still reaches a half, and ``toxic`` (1 if P(grade >= 1) >= ``threshold``)."""

    def start():
        known: dict[str, tuple] = {}
        weight = model.weight

        def of(word: str) -> tuple:
            if len(known) >= REMEMBER:
                known.clear()
            known[word] = found = tuple(b for b in features(word) if weight[b])
            return found

        def margin(text: str) -> float:
            if weight is None:
                return 0.0
            sums: dict[int, int] = {}
            for word, n in counted(text).items():
                found = known.get(word)
                for b in of(word) if found is None else found:
                    sums[b] = sums.get(b, 0) + n
            if not sums:
                return 0.0
            keys = sorted(sums)
            return float(weight[keys].astype(np.float64) @ np.log1p([sums[b] for b in keys]))

        def compute(column: pa.Array) -> list[pa.Array]:
            p = model.exceed(np.array([margin(t) for t in texts(column)]).reshape(-1))
            p1 = np.round(p[:, 0], 9)
            return [pa.array(np.round(p.sum(axis=1), 9)), pa.array(p1), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array((p1 >= threshold).astype(np.int32))]

        return compute

    return add_columns(df, [text_col], FIELDS, start)
