"""Logistic models of the sweep against a plain NumPy fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.operators import logistic
from varietas.operators.logistic import Settings

SMALL = Settings(dims=64, rounds=12, patience=3)


def _texts(n=240):
    rng = np.random.default_rng(3)
    good, bad, both = (["alpha", "beta", "gamma"], ["omega", "sigma", "theta"], ["the", "and", "of", "on"])
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        words = list(rng.choice(bad if label else good, 2)) + list(rng.choice(both, 5))
        if rng.random() < 0.15:
            label = 1 - label
        rows.append((i, " ".join(words), label))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = _texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    train = spark.createDataFrame([(s, i, y) for i, _, y in rows for s in ("a", "b") if s == "a" or i % 3], "subsample string, doc_id long, label int")
    return docs, train


def _plain(x, y, held, s):
    """The same descent over a dense table."""
    at = ahead = np.zeros(x.shape[1])
    best, ran = (np.inf, 0, at), 0
    for t in range(1, s.rounds + 1):
        ran = t
        z = x @ ahead
        loss = (np.logaddexp(0, z) - y * z)[held].mean()
        if loss < best[0]:
            best = (loss, t, ahead)
        elif t - best[1] >= s.patience:
            break
        g = x[~held].T @ (1 / (1 + np.exp(-z)) - y)[~held] / (~held).sum()
        g[:-1] += s.decay * ahead[:-1]
        moved = ahead - s.step * g
        ahead, at = moved + (t - 1) / (t + 2) * (moved - at), moved
    return best, ran


def test_fit_equals_plain_descent(spark, tables):
    docs, train = tables
    vec = logistic.text_vectors(train, docs, SMALL)
    model, history = logistic.train_logistic(train, vec, SMALL)
    got = {r["subsample"]: np.array(r["weights"]) for r in model.collect()}
    hist = {r["subsample"]: r for r in history.collect()}
    bags = {r["doc_id"]: r for r in vec.collect()}
    held_ids = {r[0] for r in docs.where(F.pmod(logistic.hash_u32(SMALL.seed, "doc_id"), F.lit(10_000)) < 3300).collect()}
    for s in ("a", "b"):
        rows = train.where(F.col("subsample") == s).collect()
        x = np.zeros((len(rows), SMALL.dims + 1))
        for i, r in enumerate(rows):
            x[i, bags[r["doc_id"]]["idx"]] = bags[r["doc_id"]]["val"]
        x[:, -1] = 1
        held = np.array([r["doc_id"] in held_ids for r in rows])
        (loss, at, w), ran = _plain(x, np.array([r["label"] for r in rows], float), held, SMALL)
        assert np.allclose(got[s], w, atol=1e-6)
        assert hist[s]["best_round"] == at and hist[s]["rounds"] == ran
        assert abs(hist[s]["valid_loss"] - loss) < 1e-6 and hist[s]["n_valid"] == held.sum()


def test_same_weights_whatever_the_partitioning(spark, tables):
    docs, train = tables
    fits = []
    for n in (1, 7):
        vec = logistic.text_vectors(train, docs, SMALL)
        model, _ = logistic.train_logistic(train.repartition(n), vec.repartition(n, "doc_id"), SMALL)
        fits.append({r[0]: list(r[1]) for r in model.collect()})
    assert fits[0] == fits[1]


def test_vectors_have_length_one_and_odd_texts_none(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, None), (3, ""), (4, "!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in logistic.text_vectors(docs, docs).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert abs(sum(v * v for v in got[1]["val"]) - 1) < 1e-12
    assert all(got[i]["idx"] == [] for i in (2, 3, 4))


def test_stops_early_and_predicts_every_pair(spark, tables):
    docs, train = tables
    vec = logistic.text_vectors(train, docs, SMALL)
    s = Settings(dims=64, rounds=40, patience=2, decay=0.0)
    noise = train.withColumn("label", F.pmod(F.hash("doc_id"), F.lit(2)))     # nothing to learn: the loss soon rises
    _, history = logistic.train_logistic(noise, vec, s)
    assert all(r["rounds"] < 40 and r["rounds"] - r["best_round"] == 2 for r in history.collect())
    model, _ = logistic.train_logistic(train, vec, SMALL)
    test = train.where("subsample = 'a'").select("doc_id", "label")
    p = logistic.predict_logistic(model, test, vec)
    assert p.count() == 2 * test.count()
    assert p.where("pred = label").count() / p.count() > 0.8
    assert p.where("(score > 0.5) <> (pred = 1)").count() == 0


def test_empty_one_class_and_too_many_models(spark, tables, monkeypatch):
    docs, train = tables
    vec = logistic.text_vectors(train, docs, SMALL)
    model, history = logistic.train_logistic(train.where("false"), vec, SMALL)
    assert model.count() == 0 and history.count() == 0
    ones = train.where("subsample = 'a'").withColumn("label", F.lit(1))
    model, _ = logistic.train_logistic(ones, vec, SMALL)
    p = logistic.predict_logistic(model, ones.select("doc_id", "label"), vec)
    assert p.where("pred = 0").count() == 0
    monkeypatch.setattr(logistic, "MAX_WEIGHTS", 65)
    with pytest.raises(ValueError, match="more than 1 models"):
        logistic.train_logistic(train, vec, SMALL)
