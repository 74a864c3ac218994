"""Quality classifier: cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(t_j - w x): all grades share the hashed-text weights w, and the thresholds
are ordered because their steps are exponentials. The expected grade and the tail probability of the
best grades serve for selection. Training is full-batch Adam in numpy on a bounded sample of
graded rows (``sample`` rows in the order of a hash of their identifiers).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.hashed_text import Cache, Matrix, adam, choose, feature_rows, gathered, held_out, present
from helixframe.llm.nested import identifier

SAMPLE, FEATURES, LEAST_Z = 12_000, 1024, 4.0
STEPS, RATE, PENALTY = 250, 0.1, 1e-3
TAIL, THRESHOLD = 2, 0.5


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class OrdinalModel:
    """Ordered ``thresholds`` (one less than the grades) and weights of the chosen buckets."""

    thresholds: tuple[float, ...]
    weights: dict[int, float]

    def tails(self, buckets: set[int]) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        z = sum(self.weights[b] for b in sorted(buckets))
        return _sigmoid(z - np.array(self.thresholds))


def train_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int, features: int = FEATURES, least_z: float = LEAST_Z, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> OrdinalModel:
    """Fit; without rows the thresholds lie so that every grade is equally likely."""
    if not rows:
        return OrdinalModel(tuple(float(np.log((j + 1) / (levels - j - 1))) for j in range(levels - 1)), {})
    chosen = choose([[r for r, g in zip(rows, grades, strict=True) if g == level] for level in range(levels)], features, least_z)
    x, n, y = Matrix(rows, chosen), len(rows), np.asarray(grades)
    share = np.clip(np.cumsum(np.bincount(y, minlength=levels))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    steps0 = np.log(np.maximum(np.diff(first), 1e-3))

    def thresholds(v: np.ndarray) -> np.ndarray:
        return first[0] + v[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps0 + v[1:]))])

    def gradient(v: np.ndarray) -> np.ndarray:
        w, t = v[: x.width], thresholds(v[x.width :])
        z = x.dot(w)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        a, b = _sigmoid(edges[y + 1] - z), _sigmoid(edges[y] - z)
        a, b = np.where(y == levels - 1, 1.0, a), np.where(y == 0, 0.0, b)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p / n, b * (1 - b) / p / n
        gt = np.zeros(levels + 1)
        np.add.at(gt, y + 1, -da)
        np.add.at(gt, y, db)
        gt = gt[1:-1]
        gv = np.concatenate([[gt.sum()], [gt[j + 1 :].sum() * np.exp(steps0[j] + v[x.width + 1 + j]) for j in range(levels - 2)]])
        return np.concatenate([x.back(da - db) + penalty * w, gv])

    v = adam(x.width + levels - 1, gradient, steps, rate)
    return OrdinalModel(tuple(thresholds(v[x.width :]).tolist()), dict(zip(chosen.tolist(), v[: x.width].tolist(), strict=True)))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int, *, text: str = "text", ident: str = "doc_id", sample: int = SAMPLE) -> OrdinalModel:
    """Train on at most ``sample`` graded rows outside the held-out fold; their identifiers are broadcast."""
    known = ratings.where(~held_out(F.col(ident)) & F.col(ident).isNotNull() & grade.isNotNull())
    known = known.groupBy(F.col(ident).alias("id")).agg(F.max(grade.cast("int")).alias("g"))
    chosen = [(r["id"], r["g"]) for r in known.orderBy(F.xxhash64(F.lit("grades"), F.col("id")), "id").limit(sample).collect()]
    if not chosen:
        return train_ordinal([], np.zeros(0, np.int64), levels)
    table = docs.sparkSession.createDataFrame(chosen, f"s_id {identifier(docs, ident)[0]}, s_g int")
    rows = docs.select(F.col(ident).alias("f_id"), F.col(text).alias("f_text")).join(F.broadcast(table), F.col("f_id") == F.col("s_id")).select("s_id", "s_g", "f_text")
    grades, features = gathered(feature_rows(rows, "f_text", ["s_id", "s_g"], shape=True))
    return train_ordinal(features, grades.astype(np.int64), levels)


def grade(docs: DataFrame, model: OrdinalModel, *, text: str = "text", ident: str = "doc_id", tail: int = TAIL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability P(grade >= ``tail``), predicted_grade and kept."""
    names = ["doc_id", "held_out", "expected_grade", "tail_probability", "predicted_grade", "kept"]
    kinds = [identifier(docs, ident)[1], pa.bool_(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(frozenset(model.weights))
        for batch in batches:
            tails = np.array([model.tails(present(t.as_py() or "", cache, True)) for t in batch.column(2)], float).reshape(-1, len(model.thresholds))
            best = tails[:, tail - 1]
            columns = [batch.column(0), batch.column(1), pa.array(tails.sum(axis=1)), pa.array(best), pa.array((tails >= 0.5).sum(axis=1).astype(np.int32)), pa.array(best >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(names, kinds, strict=True))))

    rows = docs.select(F.col(ident).alias("doc_id"), held_out(F.col(ident)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {identifier(docs, ident)[0]}, held_out boolean, expected_grade double, tail_probability double, predicted_grade int, kept boolean")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades 0 (poor), 1 (well written but toxic) and 2 (well written) from the two labels.

    Null texts are graded as empty ones; null labels or identifiers are no ratings, of repeated ratings the best counts;
    repeated rows get repeated results; an empty table gives none. Identifiers keep their type.
    """
    return grade(docs, fit(docs, labels, F.col("quality").cast("int") * (2 - F.col("toxic").cast("int")), 3))
