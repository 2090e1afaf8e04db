"""The pipeline's stages on all that the one before kept."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from varietas.llm import decontaminate, quality_rules, simhash
from varietas.llm.queries_layout import mixed

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())

    kept = cp.cut(cp.quality(spark, docs, SF))
    assert kept.columns == COLUMNS and ids(kept) == sorted(r["id"] for r in quality_rules.judge(docs).where("kept").collect())
    assert kept.where(F.length("text") != F.col("n_chars")).count() == 0

    single = cp.cut(cp.near_duplicates(spark, kept, SF))
    comp = simhash.near_duplicates(kept).collect()
    assert single.columns == COLUMNS and ids(single) == sorted({r["component_id"] for r in comp})

    clean = cp.cut(cp.benchmark(spark, single, SF))
    hit = decontaminate.hits(single, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0")
    gone = {r["id"] for r in hit.collect()}
    assert clean.columns == COLUMNS and ids(clean) == [i for i in ids(single) if i not in gone]

    mix = cp.cut(cp.mixture(spark, clean, SF))
    want = sorted(r["doc_id"] for r in mixed(clean).collect() for _ in range(r["copies"]))
    assert mix.columns == COLUMNS and len(ids(mix)) > 0 and set(ids(mix)) <= set(ids(clean))
    assert len(ids(mix)) == len(want)

    out = cp.shards(spark, mix, SF).collect()
    assert len(out) == mix.count() and {r["doc_id"] for r in out} == set(ids(mix))
    assert sorted((r["shard"], r["slot"]) for r in cp.run(spark, SF).collect()) == sorted((r["shard"], r["slot"]) for r in out)


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, "a b c " * 30, "en", "s", 1), (1, "a b c " * 30, "en", "s", 1), (None, "x", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, data, SF)
            assert out.columns == COLUMNS
            out.collect()
        cp.shards(spark, data, SF).collect()
