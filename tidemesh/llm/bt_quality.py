"""Quality classification by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import bounded_batches, checkpointed, id_remainder, row_struct, text_or_empty

#: At most this many labelled documents of each class are fitted on, the first by a hash of their ids.
SAMPLE_PER_CLASS = 4000
#: Of each class, documents after the first that reach so many characters in all are not fitted on either.
SAMPLE_CHARS = 64_000_000
#: Preference pairs drawn among them.
PAIRS = 60_000
CUT = 0.7
FOLDS, HELD_OUT = 4, 2
FEATURES = 15


def features(text: bytes) -> list[float]:
    """What the ranking sees of a text: shares of byte classes, repetition, and length."""
    n = max(len(text), 1)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    words = text.split()
    w = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x]
    upper, lower = count[65:91].sum(), count[97:123].sum()
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    plain = count[46] + count[44] + count[39] + count[45]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(x)
        for x in (
            np.sqrt(upper / max(upper + lower, 1)),
            np.sqrt(count[48:58].sum() / n),
            np.sqrt(count[33] / n),
            np.sqrt(count[124] / n),
            np.sqrt((marks - plain) / n),
            np.sqrt(plain / n),
            np.sqrt(count[10] / n),
            (upper + lower + count[128:].sum()) / n,
            len(words) / n,
            np.sqrt(repeats / w),
            len(set(words)) / w,
            np.log(1 + len(set(words))) / np.log(1 + w) if words else 1.0,
            len(set(lines)) / max(len(lines), 1),
            np.log(1 + n),
            np.log(1 + n) ** 2 / 10,
        )
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: strength = weights . (features - mean) / scale, and its map to scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strengths(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Weights that minimise logistic loss with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def rank(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 42) -> Ranking:
    """Fit on labelled feature rows.

    Each pair prefers a document of label 1 to one of label 0; the model is
    P(i beats j) = sigmoid(w . (x_i - x_j)), without intercept. The threshold
    is that quantile of the fitted strengths which best parts the labels by
    balanced accuracy; scores put it at CUT.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    sign = rng.integers(0, 2, pairs) * 2 - 1
    w = _newton((z[i] - z[j]) * sign[:, None], (sign > 0).astype(float), 1e-3)
    s = z @ w
    threshold, slope = calibrate(s, label)
    return Ranking(mean, scale, w, threshold, slope)


def calibrate(s: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The quantile of ``s`` that parts the labels with the best balanced accuracy, and a logistic slope around it."""
    good, bad = np.sort(s[label == 1]), np.sort(s[label == 0])
    levels = np.unique(np.quantile(s, np.linspace(0, 1, 2001)))
    right = (1 - np.searchsorted(good, levels) / len(good)) + np.searchsorted(bad, levels) / len(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    # The middle between the levels at which the classes part best and the next values below.
    low = s[s < levels[best[0]]]
    threshold = float((levels[best[-1]] + (low.max() if len(low) else levels[best[0]])) / 2)
    share = len(good) / len(s)
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    slope = 1.0
    for _ in range(50):
        z = slope * (s - threshold)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        g = (weight * (p - label) * (s - threshold)).mean() + 1e-3 * slope
        h = (weight * p * (1 - p) * (s - threshold) ** 2).mean() + 1e-3
        slope = float(np.clip(slope - g / h, 0.05, 20))
    return threshold, slope


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, id_col: str, text_col: str, per_class: int) -> DataFrame:
    """The labelled documents to fit on: (_id, _label, _text), at most ``per_class`` of each label, one row an id.

    Labels decide first and by hash alone, so at most twice ``per_class`` ids
    are broadcast to the scan of the documents. Of rows that share an id the
    one of the least text hash is fitted on, found before the shuffle, so a
    repeated id neither adds to the sample nor gathers in a task. Of each
    label, documents past SAMPLE_CHARS characters in all are left out.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    known = known.filter(allowed).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = [known.filter(F.col("_label") == v).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(per_class) for v in (0, 1)]
    chosen = F.broadcast(checkpointed(chosen[0].union(chosen[1])))
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(chosen, "_id")
    one = checkpointed(texts.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("_one")).select("_id", "_label", F.col("_one.t").alias("_text")))
    # At most twice ``per_class`` rows of numbers are numbered here.
    upto = Window.partitionBy("_label").orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = one.select("_id", "_label", F.length("_text").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).filter(F.col("_before") < SAMPLE_CHARS)
    return one.join(F.broadcast(fits.select("_id")), "_id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Ranking | float:
    """A ranking, or, if a class has no example, the constant score: 1 without labels, else the one label."""

    @pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    bounded_batches(docs.sparkSession)
    allowed = id_remainder("_id", FOLDS) != HELD_OUT
    sample = labelled_sample(docs, labels, label_col, allowed, id_col, text_col, per_class)
    rows = sample.select("_id", "_label", vector(F.col("_text").cast("binary")).alias("x")).toPandas().sort_values("_id", kind="stable")
    y = rows["_label"].to_numpy()
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 1.0
    return rank(np.array(rows["x"].tolist()), y)


def score(model: Ranking | float, text: Column) -> Column:
    """A text's score, from 0 to 1, as a column for any projection."""
    if isinstance(model, float):
        return F.when(text.isNotNull(), F.lit(model)).otherwise(F.lit(model))

    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(-1, FEATURES)))

    return of(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def classify(df: DataFrame, model: Ranking | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each whole text: id, held_out, score, predicted (1 at CUT or more).

    Defined cases: null text is scored as the empty one; a null id isn't held
    out; repeated rows score alike; an empty table gives no rows; only the
    text enters a score.
    """
    out = df.select(F.col(id_col), F.coalesce(id_remainder(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), score(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(df: DataFrame, model: Ranking | float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches CUT."""
    packed, unpacked = row_struct(df)
    return df.select(packed.alias("_row"), score(model, F.col(f"`{text_col}`")).alias("_score")).filter(F.col("_score") >= CUT).select(*unpacked)
