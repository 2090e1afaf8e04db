"""No cap, prefix or setting may change a result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas import session
from varietas.operators import distances, diversity, joins, reshape, sampling, stats, suites
from varietas.operators import entities as ent
from varietas.plans import sweep_plans


def vectors(spark, n, dim=6, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")


def cosine_distances(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return 1 - u @ u.T


def test_every_anchor_is_answered(spark, monkeypatch):
    monkeypatch.setattr(diversity, "PIVOTS", 5)
    x, p = vectors(spark, 300)
    got = {(r["anchor_id"], r["doc_id"]) for r in diversity.within_radius(p, p.where("doc_id < 100"), 0.3).collect()}
    d = cosine_distances(x)[:100]
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.3))} and len({a for a, _ in got}) == 100


def test_radius_sample_tries_on_and_reports(spark):
    from varietas.functions.hashing import hash_order
    x, p = vectors(spark, 120, dim=3)
    order = [r["doc_id"] for r in p.orderBy(hash_order(42, F.lit("anchor"), "doc_id"), "doc_id").select("doc_id").collect()]
    late = order[60]                                        # 30 points crowd around the 61st anchor only
    x = np.eye(3)[np.zeros(120, int)] * 0
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    near = order[60:90]
    x[near] = np.array([1.0, 0, 0]) + rng.normal(size=(30, 3)) * 1e-4
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    got = diversity.radius_sample(p, n=30, radius=1e-6, batch=8).collect()
    first = next(a for a in order if (cosine_distances(x)[a] <= 1e-6).sum() >= 30)
    assert {r["anchor_id"] for r in got} == {first} and order.index(first) >= 20 and len(got) == 30 and late in near
    none = diversity.radius_sample(p, n=121, radius=3.0, batch=50).collect()
    assert len(none) == 1 and none[0]["anchor_id"] is None and none[0]["n_within"] == 120


def test_deciles_split_heavy_bins(spark):
    x, p = vectors(spark, 90)
    x[:40] = x[0] + np.random.default_rng(3).normal(size=(40, 6)) * 1e-5          # most pairs in one narrow bin
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    d = cosine_distances(x)[np.triu_indices(90, 1)]
    probs = [0.0, 0.1, 0.15, 0.5, 0.9, 1.0]
    got = {r["q"]: r["value"] for r in distances.distance_quantiles(p, probs, bins=4, rank_rows=20, block_rows=32, chunk_rows=7).collect()}
    assert np.allclose([got[q] for q in probs], np.quantile(d, probs), atol=1e-12)
    one = distances.distance_quantiles(p.limit(1), [0.5]).collect()
    assert one[0]["value"] is None


def test_ranks_do_not_need_exchange_reuse(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 4000, 20_000)
    df = spark.createDataFrame([(int(k), int(x)) for k, x in zip(rng.integers(0, 2, 20_000), v)], "k int, v int").repartition(7)
    was = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        pdf = stats.average_rank(df, "v", ["k"]).toPandas()
        q = {(r["k"], r["q"]): r["value"] for r in stats.quantiles(df, "v", [0.0, 0.33, 1.0], ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", was)
    assert len(pdf) == 20_000 and (pdf["v_rank"] == pdf.groupby("k")["v"].rank()).all()
    for (k, p), x in q.items():
        assert abs(x - np.quantile(pdf[pdf["k"] == k]["v"], p)) < 1e-9
    at = spark.createDataFrame([(0,), (19_999,), (5000,)], "p long")
    got = {r["p"]: r["v"] for r in stats.value_at(df, "v", at, "p").collect()}
    s = np.sort(v)
    assert got == {0: s[0], 19_999: s[-1], 5000: s[5000]}


def test_a_position_meets_few_values(spark):
    # one value holds half of the positions, 3,000 others share the rest
    v = ["hot"] * 6000 + [f"w{i % 3000:04d}" for i in range(6000)]
    df = spark.createDataFrame([(x,) for x in v], "v string")
    spans, width = stats.position_spans(df, "v")
    spans = spans.toPandas()
    assert width == len(v) // 3001 and len(spans) <= 3 * 3001
    met = spans.groupby("_bucket").size().reindex(np.arange(len(v)) // width)
    assert met.mean() <= 4 and met.max() <= width + 1
    at = spark.createDataFrame([(p,) for p in (*range(0, len(v), 7), -1, len(v), None)], "p long")
    got = {r["p"]: r["v"] for r in stats.value_at(df, "v", at, "p").collect()}
    assert got == {p: sorted(v)[p] for p in range(0, len(v), 7)}
    assert stats.value_at(df.where("v is null"), "v", at, "p").count() == 0


def test_subsamples_train_on_equal_numbers_of_labelled_rows(spark):
    train, test = sweep_plans.uniform_train(spark, "/root/testdata/sf0.1")
    n = {r["subsample"]: r["n"] for r in train.groupBy("subsample").agg(F.count("label").alias("n")).collect()}
    assert set(n.values()) == {500} and len(n) == 3
    assert train.join(test, "doc_id").count() == 0


def test_split_ignores_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(80)], "doc_id long, label int")
    got = sampling.stratified_split(df, "label", test_fraction=0.25).collect()
    assert len(got) == 80 and sum(bool(r["is_test"]) for r in got) == 15
    assert not any(r["is_test"] for r in got if r["label"] is None)


def test_unknown_test_set_and_missing_kernel_are_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "dataset string")
    with pytest.raises(Exception, match="no test set for b"):
        joins.pick_test_set(df, spark.createDataFrame([("a", "x")], "dataset string, test_set string"), "dataset").collect()
    w = spark.createDataFrame([("s", 1, 2), ("s", 2, 1)], "subsample string, topic_nr int, cnt long")
    k = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (1, 2, 0.0)], "item_i int, item_j int, k double")
    with pytest.raises(Exception, match="no kernel entry for items 2, 1"):
        diversity.vendi_kernel_weights(w, k).collect()


def test_title_row_has_its_score(spark):
    df = spark.createDataFrame([(1, "T", 0.5, "a", 1.0, None, 2.0)], "id int, t string, ts double, s0 string, v0 double, s1 string, v1 double")
    got = reshape.wide_to_long(df, "id", ["s0", "s1"], ["v0", "v1"], "t", "ts").collect()
    assert sorted((r["idx"], r["text"], r["score"]) for r in got) == [(-1, "T", 0.5), (0, "a", 1.0)]


def test_multi_word_entities_and_equal_variants(spark):
    docs = spark.createDataFrame([(1, "President Trump met Trump in new York City")], "doc_id long, text string")
    gaz = spark.createDataFrame([("trump", "PERSON"), ("president trump", "PERSON"), ("new york", "GPE"), ("york city", "LOC")],
                                "surface string, label string")
    e = ent.tag_entities(docs, gaz).collect()[0]["entities"]
    assert [(x["text"], x["label"]) for x in e] == [("President Trump", "PERSON"), ("Trump", "PERSON"), ("new York", "GPE")]
    d = spark.createDataFrame([(["Cat", "dog", "CAT", "cat", "Dog", "b"],)], "e array<string>")
    assert d.select(ent.dedupe_entities("e").alias("d")).collect()[0]["d"] == ["Cat", "dog", "b"]
    t = spark.createDataFrame([("c", "[c] x", 0)], "category string, text string, label int")
    ex = spark.createDataFrame([("c", "m", "A"), ("c", "m", "A")], "category string, minority string, example string")
    assert suites.suite_templates(t, ex).count() == 2


def test_loaded_words_with_tagged_tokens(spark):
    docs = spark.createDataFrame([(1, "Dogs chase cats.", 0), (2, "Not neutral", 1)], "doc_id long, text string, label int")
    lex = spark.createDataFrame([("big", "ADJ"), ("fast", "ADV"), ("dogs", "NOUN")], "word string, pos string")
    tagged = spark.createDataFrame([(1, 0, "Dogs", "NOUN", True), (1, 1, "chase", "VERB", True), (1, 2, "cats", "NOUN", False),
                                    (1, 3, ".", "PUNCT", False)], "doc_id long, i int, w string, pos string, hook boolean")
    got = {r["text_loaded"] for r in suites.suite_loaded(docs, lex, k=2, tagged=tagged).collect()}
    assert got == {"big Dogs chase cats .", "Dogs chase fast cats ."}
    got = {r["text_loaded"] for r in suites.suite_loaded(docs, lex, k=1).collect()}
    assert got == {"big Dogs chase cats .", "Dogs chase cats ."}


def test_shared_folder_is_needed_off_local_mode():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
