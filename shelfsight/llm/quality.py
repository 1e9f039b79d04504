"""Document quality by regularised quadratic discriminant analysis.

Each class is a Gaussian over transformed document statistics. Class covariances are shrunk
towards their own diagonal and a pooled scale. Scores are differences of log densities, the
Mahalanobis part through Cholesky factors that are inverted once and shipped with the job.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import fold, own_columns, saved

FEATURES = ("log_words", "mean_word", "sd_word", "distinct", "top_word", "runs", "symbols", "other_marks", "upper", "digits",
            "non_ascii", "marked_words", "lone_marks", "stops", "dup_lines", "line_words")
_SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
_MARKS = b".,;:!?\"'()-/"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def features(text: str | None) -> list[float]:
    """Statistics of one whole text, ratios on a square-root scale; all zero without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    total = sum(map(len, words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(w[-1:] in b"#*$%&|<>!" for w in words)
    lone = sum(len(w) == 1 and not w.isalnum() and w[0] < 128 for w in words)
    root = math.sqrt
    return [
        math.log1p(n), math.log(total / n), math.log1p(float(lengths.std())), root(len(counts) / n),
        root(max(counts.values()) / n), root(sum(a == b for a, b in zip(words, words[1:])) / n),
        root(without(_SYMBOLS) / total), root(without(_MARKS) / total), root(without(_UPPER) / total),
        root(without(_DIGITS) / total), root(without(_HIGH) / total), root(ends / n), root(lone / n),
        root(sum(counts[w] for w in counts if len(w) <= 3) / n),
        root((len(lines) - len(set(lines))) / len(lines)), math.log1p(n / len(lines))]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


@dataclass
class Gaussian:
    mean: np.ndarray
    inverse: np.ndarray  # of the covariance's Cholesky factor
    log_det: float
    log_prior: float

    def density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.log_prior - 0.5 * self.log_det - 0.5 * (z * z).sum(axis=1)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score in [0, 1] of class 1; a tanh bounds what one odd statistic can say."""
        z = 6 * np.tanh((x - self.centre) / self.scale / 6)
        gap = (self.classes[1].density(z) - self.classes[0].density(z)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def _moments(rows: DataFrame, centre: np.ndarray, scale: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: weight, sum and sum of outer products, added up on the executors."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {y: np.zeros(1 + d + d * d) for y in (0, 1)}
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), dtype=float).reshape(-1, d)
            z = 6 * np.tanh((x - centre) / scale / 6)
            y = batch["y"].to_numpy()
            for c in acc:
                own = z[y == c]
                acc[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        for c, v in acc.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), c), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["y", "i", "v"])
    added = rows.mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {y: np.zeros(1 + d + d * d) for y in (0, 1)}
    for r in added:
        out[r["y"]][r["i"]] = r["v"]
    return {y: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for y, v in out.items()}


def fit(rows: DataFrame, own: float = 0.7, ridge: float = 0.05, temperature: float = 2.0) -> Model:
    """A model of labelled rows (x array<double>, y int): one pass for scale, one for the class moments.

    A class covariance is own * S + (1 - own) * pooled, plus `ridge` on the diagonal of
    standardised statistics. A class without rows takes the pooled shape; without any rows
    every score is one half.
    """
    d = len(FEATURES)
    stats = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    centre, scale = np.zeros(d), np.ones(d)
    for r in stats:
        centre[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-3)
    moments = _moments(rows, centre, scale)
    total = sum(m[0] for m in moments.values())
    means, covs = {}, {}
    for y, (n, s, ss) in moments.items():
        means[y] = s / max(n, 1)
        covs[y] = ss / max(n, 1) - np.outer(means[y], means[y])
    pooled = sum((moments[y][0] * covs[y] for y in (0, 1)), np.zeros((d, d))) / max(total, 1)
    out = []
    for y in (0, 1):
        n = moments[y][0]
        weight = own * n / (n + d)  # few rows lean on the pooled shape
        factor = np.linalg.cholesky(weight * covs[y] + (1 - weight) * pooled + ridge * np.eye(d))
        out.append(Gaussian(means[y], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), math.log((n + 1) / (total + 2))))
    return Model(centre, scale, (out[0], out[1]), temperature)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every document, kept for fitting and scoring alike."""
    return saved(own_columns(docs, ["doc_id", "text"]).mapInArrow(_measure, "doc_id long, x array<double>"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents (doc_id, text).

    labels has (doc_id, quality 0 or 1). Rows whose crc32(doc_id as text) mod 5 is 0 are held out:
    their labels are not read. Labels that are null or other than 0 and 1, and ids without a
    document, are left out; repeated labels count as often as they stand. Null and empty texts have
    the statistics of a text without words and a score like any other. Other columns, source and
    language among them, are never read. Without labels every score is 0.5.
    """
    stats = measured(docs)
    known = own_columns(labels, ["doc_id", "quality"]).where("quality IN (0, 1)").where(fold(F.col("doc_id")) != 0)
    rows = stats.join(known, "doc_id").select("x", F.col("quality").cast("int").alias("y"))
    model = fit(saved(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x))], names=["doc_id", "score"])
    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
