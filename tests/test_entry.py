import duckdb

import __spark_entry__ as E
from varietas.sources.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["subsample", "alpha", "vs", "normalized_vs"]
    assert len(rows) == 36 and max(r["normalized_vs"] for r in rows) == 1.0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _cmp(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in res.fetchall())
    df = E.queries()[name](spark, SMALL)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_oracle_small_sample_queries(spark):
    for name in ("uniform_allocation", "uniform_members", "dirichlet_allocation", "stratified_split",
                 "ols_by_group", "top_words", "page_links", "upsert_results"):
        _cmp(spark, name)


def test_sweep_properties_on_small_corpus(spark):
    from pyspark.sql import functions as F

    from varietas.operators import diversity, sampling
    from varietas.plans.sampling_plans import rated_pool
    members, alloc = sampling.create_subsets(rated_pool(spark, SMALL), n_total=100)
    assert members.groupBy("subsample", "doc_id").count().where("count > 1").count() == 0
    sizes = [r["n"] for r in members.groupBy("subsample").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 36 and max(sizes) <= 100
    assert alloc.where(F.col("n") > F.col("cap")).count() == 0
    v = diversity.vendi_features(members, ["subsample"]).join(
        members.select("subsample", "alpha").distinct(), "subsample").collect()
    assert all(1 - 1e-9 <= r["vs"] <= r["n_groups"] + 1e-9 for r in v)
    low = [r["vs"] for r in v if r["alpha"] == 0.001]
    uni = [r["vs"] for r in v if r["alpha"] == float("inf")]
    assert sum(low) / len(low) < sum(uni) / len(uni)
