"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import crc_mod, each
from tarnwick.llm.labelled import labelled_sample
from tarnwick.llm.statistics import NAMES, describe


@dataclass
class Gaussian:
    """A class density with its cached Cholesky factor, and that factor's inverse to solve by."""

    mean: np.ndarray
    factor: np.ndarray
    log_prior: float
    inverse: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, pooled: np.ndarray, share: float, to_pooled: float, to_diagonal: float) -> Gaussian:
        mean = rows.mean(axis=0)
        own = np.cov(rows.T, bias=True) if len(rows) > 1 else pooled
        # Fewer rows lean more on the pooled covariance.
        lean = max(to_pooled, len(mean) / (len(mean) + len(rows)))
        cov = (1 - lean) * own + lean * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        return cls(mean, factor, float(np.log(share)), np.tril(np.linalg.solve(factor, np.eye(len(mean)))))

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        """Log density and prior without constants, from the Mahalanobis distance."""
        z = self.inverse @ (rows - self.mean).T
        return self.log_prior - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(self.factor)).sum()


@dataclass
class QualityModel:
    """Two class densities; ``heat`` flattens their log-density difference into a probability."""

    scale: np.ndarray
    low: Gaussian | None
    high: Gaussian | None
    heat: float = 4.0
    prior: float = 0.5

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(rows), self.prior)
        rows = (rows - self.scale[0]) / self.scale[1]
        gap = (self.high.log_density(rows) - self.low.log_density(rows)) / self.heat
        return 1 / (1 + np.exp(-np.clip(gap, -60, 60)))


def fit_discriminant(rows: np.ndarray, y: np.ndarray, to_pooled: float = 0.05, to_diagonal: float = 0.05, heat: float = 4.0) -> QualityModel:
    """Fit both classes; with one class only, the model is the constant prior."""
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros((2, len(NAMES))), None, None, heat, prior)
    scale = np.stack([rows.mean(axis=0), rows.std(axis=0) + 1e-6])
    rows = (rows - scale[0]) / scale[1]
    parts = [rows[y == k] for k in (0, 1)]
    pooled = sum(np.cov(p.T, bias=True) * len(p) for p in parts if len(p) > 1) / len(rows) + 1e-6 * np.eye(rows.shape[1])
    low, high = (Gaussian.of(p, pooled, len(p) / len(rows), to_pooled, to_diagonal) for p in parts)
    return QualityModel(scale, low, high, heat, prior)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 10_000, folds: int = 5, held_out: int = 0,
                id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold.

    Null texts count as empty, rows without an id or a label of 0 or 1 teach nothing, a repeated
    row teaches as often as it occurs, and ties in the sample's order go to the smaller id.
    Without labels, or with one class only, the model is that share of good rows.
    """
    sample = labelled_sample(docs, labels, label, per_class, folds, held_out, id_col, text_col)
    stats = _statistics()
    got = sample.select("y", "doc_id", stats("text").alias("x")).orderBy("doc_id").toArrow()
    rows = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    return fit_discriminant(rows, got.column("y").to_numpy())


def _statistics():
    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([describe(t) for t in each(texts)], pa.list_(pa.float64()))

    return stats


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, folds: int = 5, held_out: int = 0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts are scored by their (zero) statistics like any other; repeated rows get
    equal scores; an empty table gives an empty table; a null id is held out of nothing.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([describe(t) for t in each(texts)]).reshape(-1, len(NAMES))))

    doc = F.col(id_col)
    scored = docs.select(doc.alias("doc_id"), F.coalesce(crc_mod(doc, folds) == held_out, F.lit(False)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject; all columns stay.

    A verdict depends on the text alone: repeated rows stay or go together, rows without an id are
    judged like all others, null texts as empty ones, and an empty table gives an empty table. A
    score that equals ``threshold`` stays.
    """

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([describe(t) for t in each(texts)]).reshape(-1, len(NAMES))) >= threshold)

    return docs.where(good(F.col(text_col)))
