"""Trained operators: held-out accuracy, unread labels, and awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from helixframe.llm import ordinal, toxicity
from helixframe.llm.hashed_text import bucket


def corpus(spark, n=900):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    out, labels = [], []
    for i in range(n):
        toxic, poor = i % 8 == 0, i % 5 == 0
        text = [r.choice(words) for _ in range(60)]
        if toxic:
            text[5], text[30] = r.choice(["vile", "nasty", "grossly"]), r.choice(["vile", "nasty"])
        if poor:
            text = [w + "###" for w in text]
        out.append((i, " ".join(text), "en", "s"))
        if i % 3:
            labels.append((i, 0 if poor else 1, int(toxic)))
    out += [(n, None, None, None), (n + 1, "", None, None), (None, "vile words", None, None), out[0], out[0]]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string"), spark.createDataFrame([*labels, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = corpus(spark)
    found = toxicity.toxicity_report(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    unseen = [r for r in found if r.doc_id is not None and r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in unseen]) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark, 300)
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    one, two = (sorted(map(tuple, toxicity.toxicity_report(docs, x).collect()), key=str) for x in (labels, turned))
    assert one == two


def test_ordinal_quality(spark):
    docs, labels = corpus(spark)
    found = ordinal.quality_report(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in found)
    unseen = [r for r in found if r.doc_id is not None and r.held_out and r.doc_id < 900]
    assert np.mean([r.kept == (r.doc_id % 5 != 0 and r.doc_id % 8 != 0) for r in unseen]) > 0.9


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    rows = [np.unique([bucket(b"g%d" % g), *rng.integers(0, 1 << 20, 5)]) for g in range(4) for _ in range(50)]
    model = ordinal.train_ordinal(rows, np.repeat(np.arange(4), 50), 4)
    assert list(model.thresholds) == sorted(model.thresholds)
    tails = model.tails({bucket(b"g3")} & set(model.weights))
    assert tails.sum() > model.tails({bucket(b"g0")} & set(model.weights)).sum()


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 30)
    none = labels.limit(0)
    assert all(r.predicted == 0 for r in toxicity.toxicity_report(docs, none).collect())
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    assert ordinal.quality_report(docs, none).count() == docs.count() and ordinal.quality_report(docs.limit(0), labels).count() == 0


def slope(loss, v, step=1e-5):
    return np.array([(loss(v + step * e) - loss(v - step * e)) / (2 * step) for e in np.eye(len(v))])


def presence(rows, buckets):
    return np.array([[b in set(r.tolist()) for b in buckets] for r in rows], float)


def test_ordinal_fit_is_a_minimum_of_the_likelihood():
    """The slope of an independent cumulative-link loss is zero at the fit."""
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 400)
    rows = [np.unique([b for b in range(8) if rng.random() < (0.2 + 0.2 * g if b < 3 else 0.8 - 0.2 * g if b < 6 else 0.5)]).astype(np.int64) for g in grades]
    model = ordinal.train_ordinal(rows, grades, 4, least_z=0.5, steps=6000, rate=0.02, penalty=1e-2)
    buckets = sorted(model.weights)
    x = presence(rows, buckets)

    def loss(v):
        w, t = v[: len(buckets)], np.concatenate([[-1e9], v[len(buckets) :], [1e9]])
        below = 1 / (1 + np.exp(-np.clip(t[None, :] - (x @ w)[:, None], -500, 500)))
        p = below[np.arange(len(x)), grades + 1] - below[np.arange(len(x)), grades]
        return -np.log(p).mean() + 1e-2 / 2 * (w * w).sum()

    fit = np.array([model.weights[b] for b in buckets] + list(model.thresholds))
    assert len(buckets) > 3 and np.abs(slope(loss, fit)).max() < 1e-3


def test_pu_fit_is_a_minimum_of_the_corrected_risk():
    rng = np.random.default_rng(3)

    def draw(toxic):
        return np.flatnonzero(rng.random(10) < (np.r_[[0.8] * 4, [0.3] * 6] if toxic else np.r_[[0.05] * 4, [0.3] * 6])).astype(np.int64)

    positive, unlabelled, prior = [draw(True) for _ in range(150)], [draw(rng.random() < 0.2) for _ in range(600)], 0.2
    model = toxicity.train_nnpu(positive, unlabelled, prior, least_z=1.0, steps=6000, rate=0.02, penalty=1e-2)
    buckets = sorted(model.weights)
    p, u = presence(positive, buckets), presence(unlabelled, buckets)

    def parts(v):
        zp, zu = p @ v[:-1] + v[-1], u @ v[:-1] + v[-1]
        return prior * np.log1p(np.exp(-zp)).mean(), np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()

    def loss(v):
        plus, minus = parts(v)
        return plus + max(0.0, minus) + 1e-2 / 2 * (v[:-1] ** 2).sum()

    fit = np.array([model.weights[b] for b in buckets] + [model.bias])
    assert len(buckets) > 2 and parts(fit)[1] > 0 and np.abs(slope(loss, fit)).max() < 1e-3


def test_pu_risk_is_kept_from_turning_negative():
    """Unlabelled rows without any sign of the positives: the plain estimate would fall below zero without end."""
    positive, unlabelled = [np.array([1]) for _ in range(100)], [np.array([2]) for _ in range(100)]
    model = toxicity.train_nnpu(positive, unlabelled, 0.5, least_z=0.0, steps=2000, penalty=0.0)
    zp, zu = (model.bias + sum(w for b, w in model.weights.items() if b == k) for k in (1, 2))
    assert np.log1p(np.exp(zu)) - 0.5 * np.log1p(np.exp(zp)) > -0.2 and model.score({1} & set(model.weights)) > 0.5


def test_identifiers_of_any_type(spark):
    docs, labels = corpus(spark, 120)
    named = [x.selectExpr("concat('d', doc_id) as doc_id", *[c for c in x.columns if c != "doc_id"], "1 as s_id", "2 as f_id") for x in (docs, labels)]
    for report in (toxicity.toxicity_report, ordinal.quality_report):
        assert {r.doc_id for r in report(*named).collect()} == {None if i is None else f"d{i}" for i in [*range(122), None]}
