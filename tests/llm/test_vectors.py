"""Hard negatives and whitening against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.llm import negatives, queries_vectors, whitening

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def rows_of(spark, data, kind="float"):
    df = spark.createDataFrame(data, f"id bigint, label int, e array<{kind}>")
    return df.select("id", "label", negatives.integer_vector(F.col("e")).alias("x"))


def brute(data, anchor, n_pos=5, n_neg=5):
    rows = {}
    for i, label, e in sorted((r for r in data if r[0] is not None and r[1] is not None and r[2] is not None),
                              key=lambda r: (r[0], str(r[1]))):
        if all(c is not None and math.isfinite(c) for c in e):
            rows.setdefault(i, (label, [math.floor(256 * c) for c in e]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in filter(anchor, rows):
        s = sorted((-dot(rows[a][1], x), i, label) for i, (label, x) in rows.items() if i != a)
        pos = [r for r in s if r[2] == rows[a][0]][:n_pos]
        for p, pid, _ in pos:
            band = [r for r in s if r[2] != rows[a][0] and 80 * -p <= 100 * -r[0] <= 100 * -p]
            out += [(a, pid, k, i, -p, -n) for k, (n, i, _) in enumerate(band[:n_neg], 1)]
    return sorted(out)


def mined(rows, anchor=None):
    got = negatives.mine(rows, F.col("id") % 10 == 0 if anchor is None else anchor)
    return sorted(tuple(r) for r in got.collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    want = sorted(con.execute(queries_vectors.ORACLE["op12_hard_negatives"]).fetchall())
    df = queries_vectors.op12_hard_negatives(spark, SMALL)
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) > 50
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(n, dim, labels, seed=1, size=1.0):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), [float(np.float32(v)) for v in size * (rng.standard_normal(dim) / 3 + 1)]) for i in range(n)]


@pytest.mark.parametrize("size", [0.01, 1.0, 1e3, 1e6])        # from several fields in a double to wide integers
def test_exact_at_every_field_width(spark, size):
    data = vectors(120, 7, 3, size=size)
    assert mined(rows_of(spark, data)) == brute(data, lambda i: i % 10 == 0)


def test_blocks_do_not_matter(spark, monkeypatch):
    data = vectors(300, 5, 2, size=0.05)
    want = brute(data, lambda i: i % 10 == 0)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 7)
    assert mined(rows_of(spark, data).repartition(5)) == want


def test_one_vector_and_one_label_for_a_third_of_all_rows(spark):
    data = [(i, 0 if i % 3 else i % 4, [0.5, 0.25, -0.5] if i % 3 == 1 else [i / 400, 0.5, -0.25]) for i in range(400)]
    assert mined(rows_of(spark, data)) == brute(data, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    data = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 2, [0.5, 0.4]), (3, None, [0.5, 0.4]), (None, 1, [0.5, 0.5]), (4, 2, None),
            (5, 2, [None, 0.5]), (6, 2, [NAN, 0.5]), (7, 2, [INF, 0.5]), (8, 2, [0.5]), (9, 2, []), (2, 2, [0.5, 0.4]), (10, 3, [-0.5, -0.5]),
            (11, 3, [-0.5, -0.6]), (12, 2, [0.5, 0.4, 9.0])]
    assert mined(rows_of(spark, data)) == brute(data, lambda i: i % 10 == 0)
    more = rows_of(spark, data).withColumn("score", F.lit(1)).withColumn("anchor", F.lit("x")).withColumn("rank", F.lit(2))
    assert mined(more) == brute(data, lambda i: i % 10 == 0)
    assert mined(rows_of(spark, [])) == [] and mined(rows_of(spark, data[:1])) == []
    assert mined(rows_of(spark, [(1, 1, [1.0])])) == []
    huge = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e299, 1.0]), (3, 1, [-1e300, 1.0])]
    assert {r[:2] for r in mined(rows_of(spark, huge, "double"))} == {(0, 1)}      # held at the limits, no overflow


# ---- whitening -----------------------------------------------------------------------------------------------

def check(got, data, want=4):
    """The contract's figures against a dense eigen-decomposition."""
    dim = max(len(e) for _, e in data)
    x = np.array([[math.floor(256 * c) for c in e] + [0] * (dim - len(e)) for _, e in data], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit - s / n).astype(float)
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(want, int((values > dim * 1e-14 * max(values[0], 1e-300)).sum()))
    ids = [i for i, _ in data]
    assert sorted((r["id"] is None, r["id"] or 0, r["component"]) for r in got) == sorted((i is None, i or 0, j) for i in ids for j in range(1, k + 1))
    sign = {}
    first = {}
    for (i, _), row in zip(data, x, strict=True):
        first.setdefault(i, row)
    for r in got:
        row, j = first[r["id"]], r["component"] - 1
        want_z = float((row - s / n).astype(float) @ vectors[:, j]) / math.sqrt(values[j])
        if abs(want_z) > 1e-3:
            sign.setdefault(j, np.sign(want_z) * np.sign(r["whitened"]))
        assert r["whitened"] * sign.get(j, 1) == pytest.approx(want_z, abs=1e-7)
        assert r["n"] == n and r["deviation"] == sum(int(n * a - b) ** 2 for a, b in zip(row, s, strict=True))
        assert r["explained"] == pytest.approx(values[j] / np.trace(v), rel=1e-10) and r["identity_error"] < 1e-9


def test_whole_query(spark):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    df = queries_vectors.op13_feast_whitening(spark, SMALL)
    check(df.withColumnRenamed("vec_id", "id").collect(), data)
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whitened(spark, data):
    df = spark.createDataFrame(data, "id bigint, e array<double>").withColumn("n", F.lit("clash")).withColumn("component", F.lit(0))
    return whitening.whiten(df.withColumn("x", negatives.integer_vector(F.col("e")))).collect()


def test_copies_count_once(spark):
    data = [(i, [0.5, 0.25, 0.1] if i % 3 else [i / 50, (i * i % 17) / 9, -i / 80]) for i in range(120)]
    check(whitened(spark, data), data)


def test_odd_vectors(spark):
    good = [(1, [0.5, 0.25, 1.0]), (2, [0.5, 2.0]), (None, [1.0, 0.0, 3.0]), (3, []), (3, []), (4, [2.0, 1.0, 0.5])]
    bad = [(5, None), (6, [None, 1.0, 2.0]), (7, [NAN, 1.0, 1.0]), (8, [1.0, INF, 1.0])]
    check(whitened(spark, good + bad), good)
    assert whitened(spark, []) == [] and whitened(spark, bad) == [] and whitened(spark, [(1, [1.0, 2.0])] * 3) == []
    assert whitened(spark, [(1, []), (2, [])]) == []
    line = [(i, [i / 4, i / 2]) for i in range(9)]                  # one dimension of variance: one component
    check(whitened(spark, line), line)
    large = whitened(spark, [(i, [i * 1e12, 1.0]) for i in range(3)])
    assert [r["deviation"] for r in large if r["id"] != 1] == [None, None] and {r["identity_error"] < 1e-9 for r in large} == {True}


def test_equal_eigenvalues_and_gaps(spark):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    for spectrum in ([5.0] * 4 + [1.0] * 16, [3.0] * 20, [9, 8, 7, 6.999999] + [1e-9] * 16, list(range(20, 0, -1)), [1e6, 1, 1, 1] + [0.0] * 16):
        v = (q * np.array(spectrum)) @ q.T
        v = (v + v.T) / 2
        values, vectors = whitening.components(spark, v, 4)
        k = len(values)
        assert k == min(4, sum(s > 2e-13 * spectrum[0] for s in spectrum))
        assert np.allclose(values, spectrum[:k], rtol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-10 * spectrum[0]


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17):
        a = rng.standard_normal((n, n))
        a = a + a.T
        diag, off = whitening.tridiagonal(a)
        values = np.linalg.eigvalsh(a)
        assert all(whitening.above(diag, off, s) == (values > s).sum() for s in (-2.0, -0.5, 0.1, 0.7, 3.0))
