import numpy as np
from pyspark.sql import functions as F

from varietas.operators import distances, diversity


def test_grouped_vendi_equals_dense(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in ("a", "b"):
        for i in range(120):
            g = int(rng.integers(0, 6))
            rows.append((s, i, float(g * 3.5), float(-g * 2.0 + 1)))
    rows.append(("a", 999, None, None))
    df = spark.createDataFrame(rows, "subsample string, doc_id int, reliability double, bias double")
    got = {r["subsample"]: r for r in diversity.vendi_features(df, ["subsample"]).collect()}
    for s in ("a", "b"):
        x = np.array([[r[2], r[3]] for r in rows if r[0] == s and r[2] is not None])
        dense = diversity.dense_vendi(diversity.feature_kernel(x, "l1"))
        assert abs(got[s]["vs"] - dense) < 1e-9
    assert got["a"]["n_unrated"] == 1 and got["b"]["n_unrated"] == 0


def test_vendi_bounds_identical_rows(spark):
    df = spark.createDataFrame([("s", i, 1.0, 2.0) for i in range(50)],
                               "subsample string, doc_id int, reliability double, bias double")
    assert abs(diversity.vendi_features(df).collect()[0]["vs"] - 1.0) < 1e-9


def test_cosine_vendi_equals_dense_with_zero_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6))
    x[3] = 0.0
    rows = [("t", i, [float(v) for v in x[i]]) for i in range(80)]
    df = spark.createDataFrame(rows, "topic string, doc_id int, embedding array<double>").repartition(4)
    got = diversity.vendi_cosine(df, keys=["topic"]).collect()[0]["vs"]
    nrm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(nrm > 0, x / np.where(nrm > 0, nrm, 1), 0)
    assert abs(got - diversity.dense_vendi(u @ u.T)) < 1e-9


def test_distance_profile_blocks_equal_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(70, 5))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(70)], "doc_id int, embedding array<double>")
    # small blocks and chunks: several block pairs, several chunks per pair
    s = distances.distance_summary(df, "cosine", block_rows=16, chunk_rows=5).collect()[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = (1 - u @ u.T)[np.triu_indices(70, 1)]
    assert s["n_pairs"] == d.size
    assert abs(s["mean"] - d.mean()) < 1e-9 and abs(s["std"] - d.std()) < 1e-9
    assert abs(s["min"] - d.min()) < 1e-12 and abs(s["max"] - d.max()) < 1e-12
    h = {r["bin"]: r["n"] for r in distances.distance_histogram(df, "cosine", bins=10, block_rows=16, chunk_rows=5).collect()}
    ref, _ = np.histogram(d, bins=10, range=(d.min(), d.max()))
    assert [h.get(i, 0) for i in range(10)] == list(ref)


def test_score_table_alpha_and_normalisation(spark):
    df = spark.createDataFrame([("alpha_0_05_idx_2", 2.0), ("alpha_inf_idx_1", 8.0), ("alpha_1000_idx_3", 4.0)],
                               "subsample string, vs double")
    got = {r["subsample"]: r for r in diversity.score_table(df).collect()}
    assert got["alpha_0_05_idx_2"]["alpha"] == 0.05 and got["alpha_inf_idx_1"]["alpha"] == float("inf")
    assert got["alpha_1000_idx_3"]["normalized_vs"] == 0.5


def test_distance_quantiles_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    x[5] = x[6]  # a duplicate pair gives a zero distance
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "doc_id int, embedding array<double>")
    probs = [round(i / 10, 1) for i in range(11)]
    got = {r["q"]: r["value"] for r in
           distances.distance_quantiles(df, probs, "cosine", bins=64, block_rows=16, chunk_rows=7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = (1 - u @ u.T)[np.triu_indices(60, 1)]
    for q in probs:
        assert abs(got[q] - np.percentile(d, q * 100)) < 1e-12
