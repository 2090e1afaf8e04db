import numpy as np
from pyspark.sql import functions as F

from varietas.functions import text as T
from varietas.operators import entities as E
from varietas.operators import suites, topics


def test_alpha_and_article_rules(spark):
    df = spark.createDataFrame([("alpha_0_05_idx_2", "the theatre"), ("alpha_inf_idx_1", "the US"),
                                ("alpha_1000_idx_3", "thermal")], "s string, e string")
    r = df.select(T.parse_alpha("s").alias("a"), T.strip_article("e").alias("d"),
                  T.strip_article("e", legacy=True).alias("l")).collect()
    assert [x["a"] for x in r] == [0.05, float("inf"), 1000.0]
    assert r[0]["d"] == "theatre" and r[0]["l"] == "atre" and r[2]["l"] == "rmal"


def test_vote_dedupe_resolve(spark):
    df = spark.createDataFrame([(["Trump", "Biden", "cats"], ["Trump", "cats"], ["Biden", "Texas"], ["Texas", "texas", "US", "cats"])],
                               "a array<string>, b array<string>, c array<string>, d array<string>")
    r = df.select(E.majority_vote("a", "b", "c").alias("v"), E.dedupe_entities("d").alias("dd"),
                  E.resolve_entities(E.dedupe_entities("d")).alias("rs")).collect()[0]
    assert r["v"] == ["Biden", "Trump", "cats"]
    assert r["dd"] == ["Texas", "US", "cats"]
    assert r["rs"] == ["Texas", "United States", "cat"]


def test_pronouns_capitalised_at_start(spark):
    df = spark.createDataFrame([("Acme sued Bob. Bob said Acme lied.",
                                 [("Acme", "ORG"), ("Bob", "PERSON")])],
                               "text string, entities array<struct<text:string,label:string>>")
    out = df.select(suites.to_pronouns(F.col("text"), F.col("entities")).alias("t")).collect()[0]["t"]
    assert out == "It sued they. they said It lied."


def test_upsert_null_keys_keep_last(spark):
    schema = "test string, model string, category string, category_minority string, Accuracy double, pos int"
    old = spark.createDataFrame([("T", "m", None, None, 0.1, 9), ("T", "m", "c", "x", 0.2, 1)], schema)
    new = spark.createDataFrame([("T", "m", None, None, 0.9, 2), ("T", "m", None, None, 0.5, 1)], schema)
    r = {(x["category"], x["category_minority"]): x["Accuracy"]
         for x in suites.upsert_results(old, new, order_col="pos").collect()}
    assert r == {(None, None): 0.9, ("c", "x"): 0.2}


def test_expand_templates(spark):
    from varietas.operators.joins import expand_templates
    t = spark.createDataFrame([("region", "In [region] now", 0), ("region", "[region] is bad", 1)],
                              "category string, text string, label int")
    e = spark.createDataFrame([("region", "A", "ASIA"), ("region", "E", "EUROPE")],
                              "category string, minority string, example string")
    rows = sorted(r["text"] for r in expand_templates(t, e).collect())
    assert rows == ["ASIA is bad", "EUROPE is bad", "In ASIA now", "In EUROPE now"]


def test_window_cooccurrence_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vocab = ["aa", "bb", "cc", "dd", "ee", "ff"]
    docs = [[vocab[j] for j in rng.integers(0, 6, size=int(rng.integers(3, 40)))] for _ in range(25)]
    docs.append(["zz"] * 5)
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id int, tokens array<string>")
    rel = spark.createDataFrame([(w, i) for i, w in enumerate(vocab[:4])], "word string, idx int")
    pairs, nwin = topics.window_cooccurrence(df, rel, window=7)
    got = {(r["i"], r["j"]): r["c"] for r in pairs.collect()}
    brute, n = {}, 0
    for d in docs:
        if not any(w in vocab[:4] for w in d):
            continue
        wins = [d[s:s + 7] for s in range(max(1, len(d) - 6))]
        for w in wins:
            n += 1
            present = sorted({vocab[:4].index(x) for x in w if x in vocab[:4]})
            for a in present:
                for b in present:
                    if a <= b:
                        brute[(a, b)] = brute.get((a, b), 0) + 1
    assert got == brute and nwin.collect()[0]["n_windows"] == n


def test_results_stream_upsert(spark):
    import tempfile

    from varietas.streaming.results_sink import current_results, start_results_stream
    base = tempfile.mkdtemp(prefix="varietas-stream-")
    schema = "test string, model string, category string, category_minority string, Accuracy double"
    inp = f"{base}/in"
    spark.createDataFrame([("T", "m", None, None, 0.1), ("T", "m", "c", "x", 0.2)], schema) \
        .write.mode("append").parquet(inp)
    start_results_stream(spark.readStream.schema(schema).parquet(inp), f"{base}/table", f"{base}/ck").awaitTermination(120)
    # a later run drops new results; the same stream (same checkpoint) picks them up as the next batch
    spark.createDataFrame([("T", "m", None, None, 0.9)], schema).write.mode("append").parquet(inp)
    start_results_stream(spark.readStream.schema(schema).parquet(inp), f"{base}/table", f"{base}/ck").awaitTermination(120)
    r = {(x["category"], x["category_minority"]): x["Accuracy"] for x in current_results(spark, f"{base}/table").collect()}
    assert r == {(None, None): 0.9, ("c", "x"): 0.2}


def test_cluster_entities_keeps_every_word_of_a_large_vocabulary(spark):
    # more words than PCA has columns for: 70,000 words of one document each, and two groups
    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), F.array(
        F.concat(F.lit("w"), F.col("id").cast("string")),
        F.when(F.col("id") % 2 == 0, "aaa aaa aaa aaa").otherwise("zzz zzz zzz zzz")).alias("entities"))
    bags = E.project_bags(docs, F.flatten(F.transform("entities", lambda e: F.split(e, " "))))
    # four times one sign and once another in every dimension: no word is lost or shares all its signs
    sizes = bags.select(F.explode(F.transform("_y", lambda y: F.abs(F.round(y * 16)).cast("int"))).alias("n")).distinct().collect()
    assert {r["n"] for r in sizes} == {3, 5}
    got = E.cluster_entities(docs, k=2, n_components=2).groupBy(F.col("doc_id") % 2, "entity_cluster").count().collect()
    assert len(got) == 2 and {r["count"] for r in got} == {35_000}
