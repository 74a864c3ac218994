"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts of the training fold are unlabelled.
With class prior p the risk is p R_P(+) + max(0, R_U(-) - p R_P(-)): the unlabelled risk less the
part that hidden positives cause, kept from turning negative. The linear model over hashed
words and stems is trained in numpy on a bounded sample (``positives`` and ``unlabelled`` rows,
taken in the order of a hash of their identifiers) and scores every whole text on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.hashed_text import Cache, Matrix, adam, choose, feature_rows, gathered, held_out, present
from helixframe.llm.nested import identifier

POSITIVES, UNLABELLED, FEATURES, LEAST_Z, LEAST_LIFT = 3000, 9000, 256, 4.0, 3.0
STEPS, RATE, PENALTY = 200, 0.1, 5e-4
THRESHOLD = 0.7


@dataclass(frozen=True)
class PuModel:
    """Log odds: ``bias`` plus the weights of the chosen buckets that are present."""

    bias: float
    weights: dict[int, float]

    def score(self, buckets: set[int]) -> float:
        z = self.bias + sum(self.weights[b] for b in sorted(buckets))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = FEATURES, least_z: float = LEAST_Z, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> PuModel:
    """Fit by full-batch Adam with logistic loss. Without positives every score is the prior, if any."""
    prior = min(max(prior, 1e-4), 0.9)
    if not positive or not unlabelled:
        return PuModel(float(np.log(prior / (1 - prior))) if positive else -10.0, {})
    chosen = choose([positive, unlabelled], features, least_z, LEAST_LIFT)
    p, u = Matrix(positive, chosen), Matrix(unlabelled, chosen)

    def gradient(wb: np.ndarray) -> np.ndarray:
        w, b = wb[:-1], wb[-1]
        zp, zu = p.dot(w) + b, u.dot(w) + b
        # loss of calling z positive is softplus(-z), negative softplus(z)
        negative_risk = _softplus(zu).mean() - prior * _softplus(zp).mean()
        gp_plus, gp_minus, gu = -_sigmoid(-zp) / p.n, _sigmoid(zp) / p.n, _sigmoid(zu) / u.n
        if negative_risk >= 0:
            gp, gz = prior * (gp_plus - gp_minus), gu
        else:  # step back where the corrected risk has turned negative
            gp, gz = prior * gp_minus, -gu
        g = p.back(gp) + u.back(gz) + penalty * w
        return np.append(g, gp.sum() + gz.sum())

    wb = adam(len(chosen) + 1, gradient, steps, rate)
    return PuModel(float(wb[-1]), dict(zip(chosen.tolist(), wb[:-1].tolist(), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", ident: str = "doc_id", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PuModel:
    """Train on rows outside the held-out fold; labels of that fold are never read into the model.

    The sample's identifiers (at most ``positives`` + ``unlabelled``) are broadcast to select
    its texts; only hashed features of the sample reach the driver.
    """
    known = labels.where(~held_out(F.col(ident)) & F.col(label).isNotNull() & F.col(ident).isNotNull())
    known = known.groupBy(F.col(ident).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    share = known.agg(F.avg("y").alias("p")).first()["p"] or 0.0
    hashed = F.xxhash64(F.lit("pu"), F.col("id").cast("string"))
    toxic = [r["id"] for r in known.where("y = 1").orderBy(hashed, "id").limit(positives).collect()]
    others = docs.where(~held_out(F.col(ident)) & F.col(ident).isNotNull()).select(F.col(ident).alias("id"))
    others = [r["id"] for r in others.orderBy(hashed, "id").limit(unlabelled).collect()]
    chosen = [(i, 1) for i in set(toxic)] + [(i, 0) for i in set(others) - set(toxic)]
    if not chosen:
        return train_nnpu([], [], share)
    sample = docs.sparkSession.createDataFrame(chosen, f"s_id {identifier(docs, ident)[0]}, s_y int")
    rows = docs.select(F.col(ident).alias("f_id"), F.col(text).alias("f_text")).join(F.broadcast(sample), F.col("f_id") == F.col("s_id")).select("s_id", "s_y", "f_text")
    labels_, features = gathered(feature_rows(rows, "f_text", ["s_id", "s_y"], shape=False))
    by = [[f for f, own in zip(features, labels_, strict=True) if own == y] for y in (1, 0)]
    return train_nnpu(*by, prior=share)


def score(docs: DataFrame, model: PuModel, *, text: str = "text", ident: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text; null texts are empty."""
    schema = pa.schema([("doc_id", identifier(docs, ident)[1]), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(frozenset(model.weights))
        for batch in batches:
            found = np.array([model.score(present(t.as_py() or "", cache, False)) for t in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(ident).alias("doc_id"), held_out(F.col(ident)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {identifier(docs, ident)[0]}, held_out boolean, score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit and score every row. Null texts are scored as empty ones; null labels or identifiers train nothing, repeated labels
    count as toxic if one is; rows without identifier are never held out; repeated rows get repeated results.
    Without labels every text scores near 0; an empty table gives no rows. Identifiers keep their type."""
    return score(docs, fit(docs, labels))
