import json
import os
import tempfile

from pyspark.sql import functions as F

from varietas.sources import io


def test_scan_articles_skips_broken_and_empty(spark):
    d = tempfile.mkdtemp(prefix="varietas-art-")
    art = {"source": "NYT", "main-entities": ["X"], "date": "2020-01-02", "title": "t", "url": "u",
           "article-level-annotations": {"author-sentiment": {"A": "neg", "a": "pos"}, "stance": "L"},
           "annotators": ["x"],
           "body": [{"sentence": "One.", "sentence-index": 0, "annotations": [{"bias": "Lexical"}]},
                    {"sentence": "", "sentence-index": 1, "annotations": []},
                    {"sentence": "Two.", "sentence-index": 2, "annotations": [{"bias": "Informational"}]}]}
    with open(os.path.join(d, "1_nyt.json"), "w") as f:
        json.dump(art, f, indent=2)
    with open(os.path.join(d, "2_bad.json"), "w") as f:
        f.write("{ not json")
    sents, audit = io.scan_articles(spark, d)
    rows = sorted((r["text"], r["source"], r["label"]) for r in sents.collect())
    assert rows == [("One.", "the-new-york-times", 1), ("Two.", "the-new-york-times", 0)]
    a = audit.collect()[0]
    assert a["files"] == 2 and a["skipped"] == 1 and a["empty"] == 1


def test_subsample_sink_round_trip_and_keyed_folder(spark):
    d = tempfile.mkdtemp(prefix="varietas-sink-")
    m = spark.createDataFrame([("docs", "source", "alpha_1_idx_1", 1), ("docs", "source", "alpha_inf_idx_1", 2)],
                              "dataset string, dimension string, subsample string, doc_id int")
    s = spark.createDataFrame([("docs", "source", "alpha_1_idx_1", 1.0, 2.0, 0.5)],
                              "dataset string, dimension string, subsample string, alpha double, vs double, normalized_vs double")
    io.write_subsamples(m, s, d)
    back = spark.read.parquet(f"{d}/members").where(F.col("subsample") == "alpha_inf_idx_1")
    assert [r["doc_id"] for r in back.collect()] == [2]
    csv_dir = os.path.join(d, "results")
    os.makedirs(csv_dir)
    for name, rows in (("results_small_topic.csv", ["x,0.5,1.0", "y,0.25,2.0"]), ("results_large_source.csv", ["z,0.1,3.0"])):
        with open(os.path.join(csv_dir, name), "w") as f:
            f.write("subsample,mcc,vs\n" + "\n".join(rows) + "\n")
    keyed = io.scan_folder_keyed(spark, csv_dir, "subsample string, mcc double, vs double")
    got = sorted((r["subsample"], r["dataset"], r["dimension"]) for r in keyed.collect())
    assert got == [("x", "small", "topic"), ("y", "small", "topic"), ("z", "large", "source")]


def test_template_store(spark):
    d = tempfile.mkdtemp(prefix="varietas-store-")
    ex = spark.createDataFrame([("region", "A", "ASIA"), ("nation", "ASIA", "N1")],
                               "category string, minority string, example string")
    t = spark.createDataFrame([("region", "[region] x", 0)], "category string, text string, label int")
    io.write_template_store(ex, t, d)
    e2, t2 = io.scan_template_store(spark, d)
    assert sorted(r["category"] for r in e2.collect()) == ["nation", "region"] and t2.count() == 1
