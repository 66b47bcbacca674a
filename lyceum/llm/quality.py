"""Quality by regularised quadratic discriminant analysis (operator 3).

Each text gives D statistics (shares of character classes, repetition, lengths), put
on log or logit scales. Per class, mean and covariance come from sums over all
labelled rows; covariances are shrunk towards a multiple of the identity, and a score
is the logistic of the difference of the classes' Mahalanobis log densities, taken
with Cholesky factors computed once, and the log odds of the classes.

Nulls and empty texts have the statistics of the empty text and a score. Labels that
are null are left out, of several labels for one id the least counts. Without labels of
both classes the score is the share of label 1 (0.5 without any). Repeated rows count
as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, raw

SHRINKAGE = 0.1
#: Least variance of a statistic within a class, in units of its pooled variance.
FLOOR = 0.02
THRESHOLD = 0.3
NAMES = ("length", "word_length", "upper", "exclaim", "symbol", "bar", "digit", "space", "stop", "types", "echo", "lines")
D = len(NAMES)
#: The character classes whose shares are statistics (fixed values).
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "exclaim": b"!?", "symbol": b"#$%&*@^~=+<>{}[]\\", "bar": b"|", "digit": b"0123456789", "space": b" \t\r\n", "stop": b".,;:"}
_WEIGHTS = np.zeros((256, len(CLASSES)))
for _j, _chars in enumerate(CLASSES.values()):
    _WEIGHTS[list(_chars), _j] = 1


def statistics(data: bytes) -> list[float]:
    """The D transformed statistics of one text given as UTF-8."""
    n = len(data)
    shares = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _WEIGHTS
    words = data.split()
    m = len(words)
    distinct = len(set(words))
    echo = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    repeated = len(lines) - len(set(lines))
    # Shares are smoothed as if 40 more bytes held one hit, so short texts aren't extreme.
    scaled = [math.log((s + 1.0) / (n + 40.0)) for s in shares]
    # A long text repeats words anyway: distinct words are held against Heaps' exponent.
    types = math.log((distinct + 5.0) / (m + 5.0)) + 0.15 * math.log1p(m / 50.0)
    return [math.log1p(n), math.log((n + 6.0) / (m + 1.0)), *scaled, types, math.log((echo + 0.3) / (m + 20.0)), math.log((repeated + 0.5) / (len(lines) + 4.0))]


@dataclass
class Model:
    """Class log odds, means and inverse Cholesky factors; ``share`` serves alone without both classes."""

    share: float
    mean: tuple[np.ndarray, np.ndarray] | None = None
    factor: tuple[np.ndarray, np.ndarray] | None = None
    log_det: tuple[float, float] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None or not len(x):
            return np.full(len(x), self.share)
        density = []
        for mean, inverse, log_det in zip(self.mean, self.factor, self.log_det, strict=True):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * (z * z).sum(axis=1) - log_det)
        odds = density[1] - density[0] + math.log(self.share / (1 - self.share))
        return np.round(1 / (1 + np.exp(-np.clip(odds, -40, 40))), 9)


def solve(n: np.ndarray, first: np.ndarray, second: np.ndarray, shrinkage: float = SHRINKAGE) -> Model:
    """The model of counts (2), sums (2 x D) and sums of products (2 x D x D)."""
    if n.sum() == 0:
        return Model(0.5)
    if n.min() == 0:
        return Model(float(n[1] / n.sum()))
    means = first / n[:, None]
    covs = second / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.maximum((covs * (n / n.sum())[:, None, None]).sum(axis=0).diagonal(), 1e-6)
    scale = np.sqrt(pooled)
    factors, dets = [], []
    for c in covs:
        r = c / np.outer(scale, scale)
        r = (1 - shrinkage) * r + shrinkage * max(np.trace(r) / len(r), FLOOR) * np.eye(len(r))
        r += FLOOR * np.eye(len(r))
        chol = np.linalg.cholesky(r * np.outer(scale, scale))
        factors.append(np.linalg.inv(chol))
        dets.append(float(np.log(chol.diagonal()).sum()))
    return Model(float(n[1] / n.sum()), tuple(means), tuple(factors), tuple(dets))


def featured(df: DataFrame, text_col: str, out: str) -> DataFrame:
    def start():
        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array([statistics(x) for x in raw(column)], pa.list_(pa.float64()))]

        return compute

    return add_columns(df, [text_col], [T.StructField(out, T.ArrayType(T.DoubleType()))], start)


def labelled(df: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """One label per id: rows of ids or labels that are null are left out, the least label counts."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    return rows.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))


#: Labelled ids that are broadcast so that only their texts are measured; more ids meet the measures of all texts.
BROADCAST_IDS = 1_000_000


def fit_measured(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", shrinkage: float = SHRINKAGE) -> Model:
    """The model of ``rows`` (_id, _x: statistics) that have a label; class moments are summed inside the plan: 1 + D + D (D + 1) / 2 numbers a class."""
    joined = rows.join(labelled(labels, label_col, id_col), "_id").select("_label", *[F.get("_x", F.lit(i)).alias(f"x{i}") for i in range(D)])
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    sums_ = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    n, first, second = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for r in joined.groupBy("_label").agg(F.count("*").alias("n"), *sums_).collect():
        c = r["_label"]
        n[c], first[c] = r["n"], [r[f"s{i}"] for i in range(D)]
        for i, j in pairs:
            second[c, i, j] = second[c, j, i] = r[f"p{i}_{j}"]
    return solve(n, first, second, shrinkage)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", shrinkage: float = SHRINKAGE) -> Model:
    """The model of the labelled rows of ``df``."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    ids = labelled(labels, label_col, id_col).select("_id")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), "_id", "left_semi")
    return fit_measured(featured(rows, "_text", "_x").select("_id", "_x"), labels, label_col, id_col, shrinkage)


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def _scored(x: np.ndarray, model: Model, threshold: float) -> list[pa.Array]:
    s = model.scores(x.reshape(-1, D))
    return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or above)."""

    def start():
        return lambda column: _scored(np.array([statistics(x) for x in raw(column)]), model, threshold)

    return add_columns(df, [text_col], FIELDS, start)


def score_measured(df: DataFrame, model: Model, stats_col: str = "_x", threshold: float = THRESHOLD) -> DataFrame:
    """As ``score``, from a column of statistics that ``featured`` has made."""

    def start():
        return lambda column: _scored(column.flatten().to_numpy(zero_copy_only=False), model, threshold)

    return add_columns(df, [stats_col], FIELDS, start)
