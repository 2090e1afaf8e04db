"""WARC archive, K-d tree shards and cube-method mix: round trips, laws and brute force."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.llm import kdtree, mixing, queries_layout, warc
from varietas.llm.common import numbered

SMALL = "/root/testdata/sf0.001"


# ---- WARC --------------------------------------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SMALL}/pages.parquet')")
    res = con.execute(queries_layout.ORACLE["op7_warc"])
    cols = [d[0] for d in res.description]
    got = queries_layout.op7_warc(spark, SMALL).select(*cols).collect()
    assert sorted(tuple(r) for r in got) == sorted(res.fetchall())


def test_warc_round_trip_and_edge_cases(spark):
    rows = [(3, "http://a/é", "same"), (1, None, "same"), (2, "http://b", None), (5, "http://c", ""), (4, "http://d\r\nX: y", "ü" * 3),
            (7, "http://e", "x" * 200_000), (7, "http://e", "x" * 200_000), (None, "http://f", "only"), (None, "http://g", "same")]
    src = pages(spark, rows).withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    arc = warc.write_archive(src)
    assert spark.read.parquet(arc.payloads).count() == 5          # each payload once
    got = {}
    for r in warc.read_index(arc, spark).collect():
        got.setdefault(r["page_id"], []).append(r)
    body = {str(k): (h or "").encode() for k, _, h in rows if k is not None}
    for k, b in body.items():
        for r in got[k]:
            assert r["payload_bytes"] == len(b)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
    said = {k: (got[k][0]["record_type"], got[k][0]["refers_to"]) for k in body}
    assert said == {"3": ("revisit", "1"), "1": ("response", None), "2": ("response", None), "5": ("revisit", "2"),
                    "4": ("response", None), "7": ("response", None)}
    assert len(got["7"]) == 2 and sorted((r["record_type"], r["refers_to"]) for r in got[None]) == [
        ("response", None), ("revisit", "1")]
    whole = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(arc, spark).collect()}
    head, _, block = whole["4"].partition(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://d%0D%0AX:%20y\r\n" in head + b"\r\n"
    n = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
    assert block[:n].endswith("üüü".encode()) and block[n:] == b"\r\n\r\n"
    assert whole["3"].count(b"same") == 0                          # a revisit has no payload
    small = warc.write_archive(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3)
    types = {r["page_id"]: r["record_type"] for r in warc.read_index(small, spark).collect()}
    assert types == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    assert warc.read_index(warc.write_archive(pages(spark, [])), spark).count() == 0


def test_damaged_payload_is_noticed(spark):
    arc = warc.write_archive(pages(spark, [(1, "u", "good")]))
    bad = warc.Archive(arc.payloads + "-bad", arc.records)
    spark.read.parquet(arc.payloads).withColumn("payload", F.lit("evil").cast("binary")).write.parquet(bad.payloads)
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(bad, spark).collect()


# ---- shards ------------------------------------------------------------------------------------------------

def doc_rows(n, seed=2, copies=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(1, 200))), rng.choice(["en", "de", None]),
             f"src{min(rng.randrange(12), rng.randrange(12))}") for i in range(n)]
    return rows + [(n + i, "one text of many copies " * 20, "en", "src0") for i in range(copies)]


@pytest.mark.parametrize("copies", [30, 1500])
def test_shards_are_near_equal_whole_and_gapless(spark, copies):
    docs = spark.createDataFrame(doc_rows(1500, copies=copies), "doc_id long, text string, lang string, source string")
    got = queries_layout.sharded(docs, 6).collect()
    assert len(got) == 1500 + copies
    size, slots, where = {}, {}, {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    mean = sum(size.values()) / 6
    assert len(size) == 6 and all(abs(x / mean - 1) < 0.05 for x in size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    split = [k for k, v in where.items() if len(v) > 1]
    assert len(split) == (1 if copies == 1500 else 0)        # only a group larger than a shard is dealt out


def test_shards_follow_the_metadata(spark):
    rows = [(i, "x" * (50 + i % 7), f"l{i % 4}", f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame([(a, b + str(a), c, d) for a, b, c, d in rows], "doc_id long, text string, lang string, source string")
    got = queries_layout.sharded(docs, 4).join(docs, "doc_id").select("shard", "lang").distinct().count()
    assert got <= 8        # four equal languages: a cut misses a border by a document at most


def test_shard_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, shard string, g string"
    rows = [(1, None, None, None, "x", "y"), (1, None, None, None, "x", "y"), (2, "", "en", None, "", ""), (None, "é", None, "s", "", "")]
    got = queries_layout.sharded(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted(r["size"] for r in got) == [8, 8, 8, 10] and {r["law"] for r in got} == {"bytes"}
    assert [r["text_crc32"] for r in got if r["doc_id"] == 1] == [0, 0]
    assert queries_layout.sharded(spark.createDataFrame([], schema), 3).count() == 0


def test_numbered(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(20)) for _ in range(300)]
    got = numbered(spark.createDataFrame(rows, "g string, v int").repartition(7), ["g"], ["v"], "k").collect()
    for g in ("a", "b", None):
        own = sorted((r["k"], r["v"]) for r in got if r["g"] == g)
        assert [k for k, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)


# ---- mix ---------------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        lam = left / sum(w[s] for s in open_)
        over = [s for s in open_ if lam * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: lam * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_targets_brute_force(spark):
    rng = random.Random(6)
    for sizes in ({"a": 10, "b": 1000, "é": 20, "Z": 0, None: 300}, {f"s{i}": rng.randrange(1, 10 ** rng.randrange(1, 6)) for i in range(40)},
                  {"only": 7}):
        t = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(t).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 400):
        pi, z = rng.random(n), rng.integers(0, 500, n).astype(float)
        was = pi.copy()
        left = mixing._flight(pi, z, rng)
        assert len(left) <= 2 and ((pi >= 0) & (pi <= 1)).all()
        assert sum(1e-9 < x < 1 - 1e-9 for x in pi) == len(left)
        assert abs(pi.sum() - was.sum()) < 1e-6 * n + 1e-6 and abs(pi @ z - was @ z) < 1e-5 * (1 + was @ z)


def test_inclusion_probabilities_are_kept_on_average():
    z, hits = np.array([5.0, 9, 9, 30, 2, 14, 7, 1]), np.zeros(8)
    for s in range(2000):
        pi = np.full(8, 0.4)
        mixing._flight(pi, z, np.random.default_rng(s))
        hits += pi
    assert np.abs(hits / 2000 - 0.4).max() < 0.05


def test_mix_reaches_its_targets(spark, block=64):
    docs = spark.createDataFrame(doc_rows(3000), "doc_id long, text string, lang string, source string").withColumn(
        "source", F.when(F.col("source") != "src3", F.col("source")))   # src3 is the null source
    size = F.size(F.split("text", " "))
    got = mixing.mix(docs, size, text_hash=F.xxhash64("text"), block_rows=block)
    rows = got.collect()
    assert len(rows) == 3000 and max(r["copies"] for r in rows) <= 2
    by = {}
    for r in rows:
        a = by.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        a[1] += r["copies"] * r["size"]
    assert all(abs(a[1] - a[0]) <= 0.01 * a[0] + 5 for a in by.values())
    again = mixing.mix(docs.repartition(5), size, text_hash=F.xxhash64("text"), block_rows=block).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in rows)


def test_mix_edge_cases(spark):
    schema = "doc_id long, text string, source string, size string, row string"
    rows = [(1, None, None, "a", "b"), (2, "", "s", "", ""), (3, "a b c", "s", "", ""), (3, "a b c", "s", "", ""), (None, "x", "t", "", "")]
    got = queries_layout.mixed(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 1, 3, 3] and all(0 <= r["copies"] <= 2 for r in got)
    assert queries_layout.mixed(spark.createDataFrame([], schema)).count() == 0


def test_every_group_that_fits_a_shard_is_a_point_of_the_tree(spark, monkeypatch):
    """No byte skips the tree, and shards are near equal although most bytes are in heavy groups."""
    seen, build = [], kdtree._build
    monkeypatch.setattr(kdtree, "_build", lambda points, *a: (seen.append(points.agg(F.sum("w")).first()[0] or 0), build(points, *a))[1])
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([5, 30, 300, 900]))) for _ in range(160)]
    rows = [(i, t, rng.choice(["en", "de"]), f"s{rng.randrange(4)}") for i, t in enumerate(texts)] + [(200 + i, texts[3], "en", "s0") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = queries_layout.sharded(docs, 8).collect()
    size, where = {}, {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert seen[0] == sum(size.values()) == sum(len(t or "") + 8 for _, t, _, _ in rows)
    assert all(len(v) == 1 for v in where.values())
    assert len(size) == 8 and max(size.values()) / min(size.values()) < 1.05


def test_heavy_groups_leave_only_leaves_that_they_overfill():
    weight, leaf = np.array([6.0, 5.0, 4.0, 3.0, 2.0]), np.array([0, 0, 1, 2, 2])
    assert list(kdtree._even_out(weight, leaf, np.zeros(3), 20.0)) == [0, 0, 1, 2, 2]
    got = kdtree._even_out(weight, leaf, np.zeros(3), 7.0)
    assert np.bincount(got, weight).max() <= 7.0
    rng = np.random.default_rng(1)
    w = rng.uniform(1, 30, 400)
    load = np.bincount(kdtree._even_out(w, np.repeat(0, 400), np.zeros(24), w.sum() / 24), w, 24)
    assert load.max() / (w.sum() / 24) < 1.02
