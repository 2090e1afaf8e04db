"""Distributed spectrum: every singular value, scores equal to the dense ones, no bound on the number of items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.operators import diversity, spectrum


def _features(spark, seed, sizes, unrated=3):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in sizes.items():
        x = rng.normal(size=(n, 2)) * 5
        rows += [(name, float(a), float(b)) for (a, b) in x for _ in range(int(rng.integers(1, 4)))]
        rows += [(name, None, 1.0)] * unrated
    return spark.createDataFrame(rows, "subsample string, reliability double, bias double")


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_blocks_equal_one_task(spark, metric):
    df = _features(spark, 3, {"a": 90, "b": 41, None: 30, "small": 4})
    one = {r["subsample"]: r for r in diversity.vendi_features(df, ["subsample"], metric=metric).collect()}
    # blocks of 30 columns of the largest key: three of them, one rests in each round
    cut = diversity.vendi_features(df, ["subsample"], metric=metric, max_groups=10, block_bytes=8 * 90 * 30).collect()
    assert {r["subsample"] for r in cut} == {"a", "b", None, "small"}
    for r in cut:
        o = one[r["subsample"]]
        assert abs(r["vs"] - o["vs"]) < 1e-8 * o["vs"]
        assert (r["n"], r["n_groups"], r["n_unrated"]) == (o["n"], o["n_groups"], o["n_unrated"])


def test_whole_corpus_and_other_orders(spark):
    df = _features(spark, 5, {"a": 60}).drop("subsample")
    for q in (1.0, 0.5):
        one = diversity.vendi_features(df, [], q=q).first()
        cut = diversity.vendi_features(df, [], q=q, max_groups=5, block_bytes=8 * 60 * 15).first()
        assert abs(one["vs"] - cut["vs"]) < 1e-8 * one["vs"]


def test_every_small_value_is_found(spark):
    """Values over twelve decades, repeated ones and zeros: all come back, within the overlap left over."""
    rng = np.random.default_rng(1)
    lam = np.concatenate([10.0 ** -np.arange(12), np.full(9, 1e-3), np.zeros(3)])
    v, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    m = (v * lam) @ v.T
    rows = [(1, b, m[b::4].tobytes(), 24, 0.0) for b in range(4)]
    table = spark.createDataFrame(rows, "key int, _blk int, _cols binary, _n int, _off double")
    got = sorted(r["value"] for r in spectrum.singular_values(table, ["key"], 4).collect())
    assert len(got) == 24
    assert np.allclose(got, np.sort(lam), atol=spectrum.OVERLAP, rtol=0)


def test_large_kernel_of_items_and_negative_eigenvalues(spark):
    rng = np.random.default_rng(9)
    n = 40
    x = rng.normal(size=(n, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = u @ u.T
    k[0, 1] = k[1, 0] = 1.9                        # no longer without negative eigenvalues
    kernel = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(n) for j in range(n)], "item_i int, item_j int, k double")
    w = [("s", i, int(rng.integers(1, 9))) for i in range(n)] + [("t", i, 2) for i in range(0, n, 3)]
    weights = spark.createDataFrame(w, "subsample string, topic_nr int, cnt int")
    one = {r["subsample"]: r for r in diversity.vendi_kernel_weights(weights, kernel).collect()}
    cut = {r["subsample"]: r for r in diversity.vendi_kernel_weights(weights, kernel, max_items=5, block_bytes=8 * n * 8).collect()}
    for s in ("s", "t"):
        at = [i for (name, i, _) in w if name == s]
        cnt = np.array([c for (name, _, c) in w if name == s], float)
        dense = diversity.weighted_vendi(k[np.ix_(at, at)], cnt / cnt.sum())
        assert abs(one[s]["vs"] - dense) < 1e-9 and abs(cut[s]["vs"] - dense) < 1e-7
        assert one[s]["n"] == cut[s]["n"] == int(cnt.sum())
    with pytest.raises(Exception, match="no kernel entry for items"):
        diversity.vendi_kernel_weights(weights, kernel.where(F.col("item_i") != 3), max_items=5).collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], "subsample string, reliability double, bias double")
    assert diversity.vendi_features(df, ["subsample"]).collect() == []
