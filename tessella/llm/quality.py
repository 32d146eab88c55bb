"""Quality classifier: regularised quadratic discriminant over document statistics (operator 5).

One narrow pass turns every whole text into a fixed vector of transformed statistics. Class
counts, means and scatter matrices are summed over all labelled training rows (sums of fixed
size, so nothing is sampled). Each class covariance is shrunk towards the pooled one and towards
a scaled identity; its Cholesky factor is cached in the model. A score is the logistic of the
Mahalanobis log-density difference plus the log prior odds, cooled by a temperature.

Null and empty texts get the vector of an empty text and a score like any other. Rows with a null
id are scored, count as held out, and are never learnt from. Repeated label rows count once, and
conflicting ones count for both classes; labels that are null or neither 0 nor 1 are ignored.
With no labels of one class every score is the share of label 1 (0.5 with no labels at all).
Texts of any length are measured whole; equal texts get equal scores; an empty table gives an
empty table; columns of other names, clashing ones too, are ignored. The sums over the labelled rows
are of doubles and arrive in any order, so scores may differ in their last digits between runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fold, materialize, slices, table

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "symbols", "pipes", "digits", "punctuation", "repeated_words",
    "repeated_lines", "line_length", "top_word", "byte_entropy", "ends_symbol", "wordy",
)
SHRINK_POOLED, SHRINK_IDENTITY, TEMPERATURE = 0.2, 0.05, 2.0
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:?'\"()-"]] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _POINT)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; ratios by smoothed square roots, sizes by logarithms."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = data.lower().split()
    w = max(1, len(words))
    lines = data.split(b"\n")
    upper, lower = int(count[_UPPER].sum()), int(count[_LOWER].sum())
    share = count[count > 0] / n
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    root = lambda a, b: math.sqrt(a / max(1, b))
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(sum(map(len, words)) / w), root(upper, upper + lower), root(int(count[_SYMBOL].sum()), n),
        root(int(count[124]), n), root(int(count[_DIGIT].sum()), n), root(int(count[_POINT].sum()), n), root(w - len(seen), w) if words else 0.0,
        root(len(lines) - len(set(lines)), len(lines)), math.log1p(n / len(lines)), root(max(seen.values(), default=0), w), float(-(share * np.log2(share)).sum()) if data else 0.0,
        root(sum(x[-1] < 128 and bool(_SYMBOL[x[-1]]) for x in seen), len(seen)), root(sum(len(x) > 3 for x in seen), len(seen)),
    ]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id column and ``x``, the array of statistics."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                yield {id_col: b.column(id_col), "x": [statistics(t) for t in b.column(text_col).to_pylist()]}

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, x array<double>")


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor and half log determinant; temperature cools the odds."""

    prior: tuple[float, float]
    mean: list[np.ndarray] | None = None
    whiten: list[np.ndarray] | None = None
    half_logdet: list[float] | None = None
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior[1])
        log = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whiten[k].T
            log.append(-0.5 * np.einsum("ij,ij->i", z, z) - self.half_logdet[k])
        odds = (log[1] - log[0]) / self.temperature + math.log(self.prior[1] / self.prior[0])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", shrink_pooled: float = SHRINK_POOLED, shrink_identity: float = SHRINK_IDENTITY) -> Discriminant:
    """From features and (id, quality): sums of fixed size over all labelled rows, then the factors on the driver."""
    known = labels.select(F.col(id_col), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1)).distinct()
    d = len(FEATURES)

    def run(batches):
        total = np.zeros((2, d + 1, d + 1))
        for b in batches:
            v = np.array(b.column("x").to_pylist(), float).reshape(-1, d)
            y = np.array(b.column("y").to_pylist(), int)
            one = np.hstack([np.ones((len(v), 1)), v])
            for k in (0, 1):
                total[k] += one[y == k].T @ one[y == k]
        rows = [(k, i, j) for k in (0, 1) for i in range(d + 1) for j in range(d + 1)]
        yield {"k": [r[0] for r in rows], "i": [r[1] for r in rows], "j": [r[2] for r in rows], "s": [total[r] for r in rows]}

    sums = arrow_map(x.join(known, id_col).select("x", "y"), run, "k int, i int, j int, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s"))
    total = np.zeros((2, d + 1, d + 1))
    for r in sums.collect():  # 2 (d+1)^2 rows, whatever the input
        total[r.k, r.i, r.j] = r.s
    n = total[:, 0, 0]
    if n.min() < 2:
        return Discriminant(((n[0] + 0.5) / (n.sum() + 1), (n[1] + 0.5) / (n.sum() + 1)))
    mean = [total[k, 0, 1:] / n[k] for k in (0, 1)]
    scatter = [total[k, 1:, 1:] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    whiten, half = [], []
    for k in (0, 1):
        own = (1 - shrink_pooled) * scatter[k] / n[k] + shrink_pooled * pooled
        own = own / np.outer(scale, scale)  # unit pooled variances, so that the identity is a fair target
        own = (1 - shrink_identity) * own + shrink_identity * np.eye(d)
        factor = np.linalg.cholesky((own + own.T) / 2)
        whiten.append(np.linalg.solve(factor, np.eye(d)) / scale)
        half.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant((float(n[0] / n.sum()), float(n[1] / n.sum())), mean, whiten, half)


def score(x: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    kind = x.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = np.array(b.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            yield {id_col: b.column(id_col), "score": model.score(v)}

    return arrow_map(x.select(id_col, "x"), run, f"`{id_col}` {kind}, score double")


def keep(docs: DataFrame, model: Discriminant, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``threshold``: one narrow pass."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, text_col):
                v = np.array([statistics(t) for t in b.column(text_col).to_pylist()], float).reshape(-1, len(FEATURES))
                part = b.filter(pa.array(model.score(v) >= threshold))
                yield {c: part.column(c) for c in part.schema.names}

    return arrow_map(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from rows outside the held-out fold only."""
    x = materialize(features(docs))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    model = fit(x.where(~held), labels)
    return score(x, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
