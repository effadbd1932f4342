"""The two classifiers: held-out accuracy, calibration, and what they may not look at."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm.quality import isotonic, score_quality
from skytally.llm import quality, toxicity
from skytally.llm.toxicity import score_toxicity

FOLDER = "/root/testdata/sf0.01"


def auc(y, score):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.mark.parametrize(("score", "label", "folds", "left", "least"), [(score_quality, "quality", 4, 2, 0.97), (score_toxicity, "toxic", 3, 1, 0.9)])
def test_held_out(data, score, label, folds, left, least):
    docs, labels = data
    out = score(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert ((out.score >= 0.7).astype(int) == out.predicted).all()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == left) for i, h in zip(out.doc_id, out.held_out, strict=True))
    held = out[out.held_out & out[label].notna()]
    assert auc(held[label].to_numpy(), held.score.to_numpy()) >= least
    # Labels of held-out rows change nothing.
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == left, 1 - F.col(label)).otherwise(F.col(label)))
    again = score(docs, turned).select("doc_id", F.col("score").alias("s")).toPandas().merge(out, on="doc_id")
    assert np.allclose(again.s, again.score, atol=1e-9)


def test_sentences(data):
    docs, labels = data
    found = score_toxicity(docs, labels).where("predicted = 1").select("sentences").collect()
    assert found and any(s.strip() for r in found for s in r.sentences)


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_odd(spark, table, odd, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score(table(odd), none).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.doc_id is None and not r.held_out for r in rows) == 2
    some = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(table(odd), some).count() == len(odd)
    assert score(table([]), some).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, centres = rng.integers(1, 5, 12).astype(float), np.arange(12.0)
        ones = np.minimum(n, rng.integers(0, 5, 12)).astype(float)
        knots, levels = isotonic(centres, n, ones)
        assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
        # The least-squares increasing fit by its max-min formula.
        fit = [max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(sorted(set(np.round(fit, 9))), np.round(levels, 9))


def test_length_alone_is_not_toxic(spark):
    """Harmless documents joined to very long ones stay below the threshold; one bad document among many is still found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels, "doc_id").orderBy("doc_id")
    clean = [r.text for r in labelled.where("toxic = 0").collect() if r.text]
    score = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    worst = max((r for r in labelled.where("toxic = 1").collect()), key=lambda r: score[r.doc_id])
    made = [(10**9 + n, "\n".join((clean * 5)[:n])) for n in (1, 20, 60, 348, 1200)] + [(2 * 10**9, "\n".join([*clean[:40], worst.text]))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r.doc_id: r for r in score_toxicity(both, labels).where("doc_id >= 1000000000").collect()}
    assert all(got[10**9 + n].predicted == 0 and not got[10**9 + n].sentences for n in (1, 20, 60, 348, 1200))
    assert got[2 * 10**9].predicted == 1 and got[2 * 10**9].sentences


def test_ridge_weights(spark):
    """The partition-summed equations give the weights that one solve over all rows gives."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.FEATURES))).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(row.tolist(), float(t), k % quality.FOLDS) for k, (row, t) in enumerate(zip(x, y, strict=True))], "x array<float>, y double, fold int").repartition(5)
    model = quality.fit(rows, n_features=24)
    z = model.features(x.astype(float))
    direct = [np.linalg.solve(z.T @ z + p * np.eye(25), z.T @ y) for p in quality.PENALTIES]
    assert min(np.abs(model.weights - w).max() for w in direct) < 1e-6


def test_noisy_or_gradient():
    """The gradient that bags of sentences give is that of their likelihood, by small differences and plain loops."""
    rng = np.random.default_rng(4)
    text = np.sort(rng.integers(0, 6, 20))
    sentence = rng.integers(0, 20, 60)
    word, y, weights = rng.integers(0, 8, 60), rng.integers(0, 2, 6).astype(float), rng.normal(size=9)

    def loss(w):
        total = 0.0
        for d in range(6):
            mine = np.flatnonzero(text == d)
            clear = 1.0
            for s in mine:
                z = w[-1] - toxicity.LENGTH * np.log(len(mine)) + sum(w[k] for k in word[sentence == s])
                clear *= 1 - 1 / (1 + np.exp(-z))
            total -= np.log(np.clip(1 - clear, 1e-9, 1 - 1e-9)) if y[d] > 0 else np.log(clear)
        return total

    gradient, value = toxicity._step(weights, word, sentence, text, y)
    assert abs(value - loss(weights)) < 1e-8
    for k in range(9):
        moved = np.zeros(9)
        moved[k] = 1e-5
        assert abs((loss(weights + moved) - loss(weights - moved)) / 2e-5 - gradient[k]) < 1e-5


def test_labels_with_clashing_columns(spark):
    """Columns of the label table that the operators use themselves change nothing."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    more = labels.withColumns({"text": F.lit("x"), "y": F.lit(5), "fold": F.lit("f"), "score": F.lit(None), "x": F.array(F.lit(1.0))})
    for score in (score_quality, score_toxicity):
        plain, other = ({r.doc_id: r.predicted for r in score(docs, t).collect()} for t in (labels, more))
        assert plain == other
