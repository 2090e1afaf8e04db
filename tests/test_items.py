"""Radius search by pivots, representatives, full squares, wide tables, names that contain others, scored subsets."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.operators import distances, diversity, joins, sampling, topics


def points(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "doc_id long, embedding array<double>")


def dist(a, b, metric):
    a, b = np.asarray(a, float), np.asarray(b, float)
    if metric == "l2":
        return float(np.sqrt(((a - b) ** 2).sum()))
    n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return 1.0 - (float(a @ b) / n if n > 0 else 0.0)


@pytest.mark.parametrize(("metric", "radius"), [("cosine", 0.05), ("cosine", 0.6), ("cosine", 1.2), ("cosine", -0.1), ("l2", 0.7), ("l2", 0.0)])
def test_radius_search_equals_brute_force(spark, metric, radius):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=4) for _ in range(60)] + [np.zeros(4), None]
    x += [x[3], 2 * x[3]]
    df = points(spark, x)
    got = {(r["anchor_id"], r["doc_id"]) for r in diversity.within_radius(df, df.where("doc_id % 3 = 0"), radius, metric).collect()}
    want = {(a, b) for a in range(0, 64, 3) for b in range(64) if x[a] is not None and x[b] is not None
            and (d := dist(x[a], x[b], metric)) <= radius and abs(d - radius) > 1e-9}
    near = {(a, b) for a, b in got if abs(dist(x[a], x[b], metric) - radius) <= 1e-9}
    assert got - near == want - near


def test_pivots_rule_out_most_points(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = [centres[i % 30] + 0.02 * rng.normal(size=16) for i in range(1500)]
    df = points(spark, x)
    index = diversity.PivotIndex(df)
    anchors = df.where("doc_id < 60")
    compared = index.candidates(anchors, 0.01).count()
    found = diversity.within_radius(index, anchors, 0.01).count()
    assert found == 60 * 50 and compared <= 60 * 1500 / 10
    assert diversity.within_radius(points(spark, []), anchors, 0.5).count() == 0


def test_square_has_both_triangles_and_the_diagonal(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 5))
    x[7] = 0
    df = points(spark, x)
    d = np.array([[dist(a, b, "cosine") for b in x] for a in x])
    s = distances.distance_summary(df, block_rows=16, chunk_rows=5, square=True).first()
    assert s["n_pairs"] == 1600 and abs(s["mean"] - d.mean()) < 1e-9 and abs(s["std"] - d.std()) < 1e-9 and s["min"] == 0.0
    q = distances.distance_quantiles(df, [0.0, 0.3, 0.5, 1.0], block_rows=16, chunk_rows=7, bins=32, square=True)
    assert all(abs(r["value"] - np.percentile(np.where(np.eye(40) * (d < 0.5), 0, d), 100 * r["q"])) < 1e-9 for r in q.collect())
    h = distances.distance_histogram(df, bins=7, block_rows=16, square=True)
    assert sum(r["n"] for r in h.collect()) == 1600


def test_representative_documents(spark):
    texts = [(i, t, k) for i, (t, k) in enumerate([("cat dog cat", 1), ("cat cat cat dog", 1), ("dog dog", 1), ("fish", 1), ("", 1), (None, 1),
                                                   ("tax law tax", 2), ("tax law tax", 2), ("law", 2), ("none", None)])]
    docs = spark.createDataFrame(texts, "doc_id long, text string, topic_nr int")
    tt = topics.c_tf_idf(topics.term_counts(docs.select("doc_id", "text"), docs.select("doc_id", "topic_nr")))
    w = {(r["topic_nr"], r["term"]): r for r in tt.collect()}
    words = {k: sum(r["tf"] for (t, _), r in w.items() if t == k) for k in (1, 2)}
    want = {}
    for i, t, k in texts:
        c = Counter(re.findall(r"\w{2,}", t or ""))
        if k and c:
            v = {x: n * w[k, x]["weight"] * words[k] / w[k, x]["tf"] for x, n in c.items()}
            norm = math.sqrt(sum(r["weight"] ** 2 for (q, _), r in w.items() if q == k))
            want.setdefault(k, []).append((-round(sum(v[x] * w[k, x]["weight"] for x in v) / math.sqrt(sum(y * y for y in v.values())) / norm, 9), i))
    got = topics.representative_docs(docs.select("doc_id", "text"), docs.select("doc_id", "topic_nr"), tt, k=3).orderBy("topic_nr", "rank").collect()
    flat = [(k, n + 1, i, -s) for k in sorted(want) for n, (s, i) in enumerate(sorted(want[k])[:3])]
    assert [(r["topic_nr"], r["rank"], r["doc_id"]) for r in got] == [f[:3] for f in flat]
    assert all(abs(r["similarity"] - f[3]) < 2e-9 for r, f in zip(got, flat))


def test_outliers_with_equal_weights_take_the_first_topic(spark):
    rows = [(1, -1, c, 0.4) for c in (3, 1, 2)] + [(2, -1, 0, 0.01), (3, 5, 0, 0.9)]
    r = topics.reassign_outliers(spark.createDataFrame(rows, "doc_id long, topic_nr int, candidate int, weight double").repartition(3))
    assert {x["doc_id"]: x["topic_nr"] for x in r.collect()} == {1: 1, 2: -1, 3: 5}


def test_mean_coherence(spark):
    c = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, None)], "topic_nr int, coherence double")
    assert tuple(topics.mean_coherence(c).first()) == (0.375, 2)


@pytest.mark.parametrize("exact", [False, True])
def test_variants_of_names(spark, exact):
    names = ["cnn", "cnn-website", "the cnn show", "CNN", "bbc", "ab-website", "xaby", "b", "a", "fox news", "fox news-website", "ox news", None, "",
             "abc news-website", "xx abc news yy", "bc news", "bbc", "é", "é-website", "né"]
    got = Counter(r["source"] for r in joins.prefer_variant(spark.createDataFrame([(n,) for n in names], "source string"), exact=exact).collect())
    bases = [n[:-8] for n in names if n and n.endswith("-website")]
    hit = (lambda n: n in bases) if exact else (lambda n: any(b in n for b in bases))
    want = Counter(n for n in names if n is None or (not n.endswith("-website") and not hit(n))) + Counter(bases)
    assert got == want
    alone = spark.createDataFrame([("-website",), ("x",), (None,)], "source string")      # an empty base is in every name
    assert sorted(r["source"] or "" for r in joins.prefer_variant(alone).collect()) == ["", ""]


def test_scored_subsets_call_the_score(spark):
    pool = spark.createDataFrame([(i, f"c{i % 4}", float(i % 4)) for i in range(80)], "doc_id long, category string, v double")
    members, scores = sampling.create_scored_subsets(
        pool, lambda m: m.groupBy("subsample").agg((1 + F.stddev_pop("v")).alias("vs")), n_total=12, alphas=["1"], reps=2)
    rows = scores.collect()
    assert len(rows) == 4 and max(r["normalized_vs"] for r in rows) == 1.0
    assert {r["subsample"] for r in rows} == {r["subsample"] for r in members.select("subsample").distinct().collect()}
