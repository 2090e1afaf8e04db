"""Language identification and quality classifier: exact small cases and held-out accuracy."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.llm import classifier, langid, queries_models

SF = "/root/testdata/sf0.01"


# ---- language identification -------------------------------------------------------------------------------

PIECES = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "aab"] + [""] * 256
BYTES = list(range(8, 264))


def brute_word(word, log_p):
    marked, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(marked)]
        p = 1.0
        for x, y in zip(at, at[1:]):
            s = marked[x:y]
            if s in PIECES[:8]:
                p *= math.exp(log_p[PIECES.index(s)])
            elif len(s) == 1:
                p *= math.prod(math.exp(log_p[BYTES[b]]) for b in s.encode())
            else:
                p = 0
                break
        total += p
    return math.log(total)


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(PIECES, BYTES)
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(len(PIECES)), 2).T)
    words = ["a", "ab", "abab", "aabba", "bab", "aé", "ééb", "漢a", "b" * 9]
    got = langid.word_scores(lattice, words, log_p)
    want = [[brute_word(w, log_p[:, k]) for k in (0, 1)] for w in words]
    assert np.allclose(got, want)
    assert np.allclose([langid._long_score(lattice, w, log_p) for w in words], want)
    long = "ab" * 30
    assert np.allclose(langid.word_scores(lattice, [long], log_p)[0], langid._long_score(lattice, long, log_p))


def test_expected_counts_brute_force():
    lattice = langid.Lattice(PIECES, BYTES)
    log_p = np.log(np.random.default_rng(2).dirichlet(np.ones(len(PIECES)), 2).T)
    word, want, total = "abaab", np.zeros(len(PIECES)), 0.0
    marked = "▁" + word
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(marked)]
        parts = [marked[x:y] for x, y in zip(at, at[1:])]
        if all(s in PIECES[:8] for s in parts):
            p = math.exp(sum(log_p[PIECES.index(s), 1] for s in parts))
            total += p
            for s in parts:
                want[PIECES.index(s)] += p
    got = langid.expected_counts(lattice, [word], np.array([1]), np.array([3.0]), log_p)
    assert np.allclose(got[:, 1], 3 * want / total) and not got[:, 0].any()


def test_long_words_teach_as_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    pieces, byte_of = langid.load_pieces(langid.VOCABULARY)
    log_p = np.log(rng.dirichlet(np.full(len(pieces), 0.5), 2).T + 1e-12)
    words = ["Haus", "größe", "antidisestablishmentarianism", "漢字", "x"]
    lang, weight = np.array([0, 1, 0, 1, 1]), np.array([1.0, 2.0, 3.0, 1.0, 5.0])
    lattice = langid.Lattice(pieces, byte_of)
    plain = langid.expected_counts(lattice, words, lang, weight, log_p)
    monkeypatch.setattr(langid, "_LONG", 0)
    assert np.allclose(langid.expected_counts(lattice, words, lang, weight, log_p), plain, rtol=1e-9, atol=1e-12)
    long = langid.expected_counts(lattice, ["ab" * 4000], np.array([1]), np.array([1.0]), log_p)
    assert np.isfinite(long).all() and 500 < long.sum() <= 8001


def test_langid_held_out_accuracy(spark):
    got = queries_models.op2_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_langid_edge_cases(spark):
    docs = spark.createDataFrame(
        [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de"),
                                                 (None, "de"), ("12 34 !!", "en"), ("", None), ("x" * 5000, None), ("漢字", None),
                                                 ("DER HUND", None), ("²½", None)])],
        "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs.where("doc_id < 3"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model, keep={"doc_id": F.col("doc_id")}).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 7)] == ["en", "de", "de"]
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (2, 3, 4, 8)] == [("und", 0.0)] * 4
    assert got[5]["lang_pred"] in ("en", "de") and got[6]["lang_pred"] in ("en", "de")
    none = langid.fit(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict(docs, none, keep={"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, keep={"doc_id": F.col("doc_id")}).count() == 0


# ---- classifier --------------------------------------------------------------------------------------------

def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = classifier.Model(0.3, rng.normal(size=classifier.SIZE), rng.normal(size=(classifier.SIZE, 4)))
    at = np.array([1, 5, 9, 20, 7, 2])
    x = rng.random(6)
    got = classifier.raw_scores(m, at, x, np.array([0, 4]))
    for s, (a, b) in enumerate([(0, 4), (4, 6)]):
        want = 0.3 + sum(m.linear[at[i]] * x[i] for i in range(a, b))
        want += sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert abs(got[s] - want) < 1e-9


def test_factors_learn_a_product():
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b]), np.ones(2)))
        y.append(a ^ b)
    m = classifier.train(rows, np.array(y, float), epochs=20, rate=0.3)
    z = [classifier.raw_scores(m, r[0], r[1], np.array([0]))[0] > 0 for r in rows[:100]]
    assert np.mean(np.array(z) == np.array(y[:100])) > 0.95       # no linear model can


def test_classifier_held_out(spark):
    got = queries_models.op8_factorisation_machine(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(got) == 10000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    good = [r["predicted"] for r in held if r["quality"] == 1]
    bad = [1 - r["predicted"] for r in held if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.9


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words here."), (2, None), (3, ""), (4, "x" * 100_000), (4, "x" * 100_000)],
                                 "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (9, 0), (None, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, F.lit(True))
    got = classifier.score(docs, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert classifier.score(docs.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0
    with_none = classifier.fit(docs.limit(0), labels, F.lit(True))
    assert with_none.linear.sum() == 0


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"A b.\n\nC d!"])
def test_features_are_bounded(text):
    at, x = classifier.features(text)
    assert len(at) == len(x) == len(set(at)) and max(at) < classifier.SIZE
