"""Registered queries on sentence vectors: Gram table, cosine Vendi, radius
sample, distance profile, Vendi curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.operators import diversity, distances
from varietas.sources import fixtures as fx

SEED = 42


# --------------------------------------------------------------------------- topic_gram (V2 part)
def q_topic_gram(spark, sf_dir):
    """Gram sums of unit vectors per topic (i <= j; i = j = -1 holds the count)."""
    g = diversity.gram_table(fx.embedding(spark, sf_dir), keys=["topic_nr"])
    return g.select("topic_nr", "i", "j", F.round("g", 6).alias("g"))


SQL_TOPIC_GRAM = """
WITH e AS (SELECT vec_id, label AS topic_nr, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e),
x AS (SELECT vec_id, topic_nr, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i,
             unnest(list_transform(v, lambda y: CASE WHEN nrm > 0 THEN y / nrm ELSE 0.0 END)) AS x FROM n)
SELECT a.topic_nr, a.i, b.i AS j, round(sum(a.x * b.x), 6) AS g
FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.topic_nr, a.i, b.i
UNION ALL
SELECT label AS topic_nr, -1 AS i, -1 AS j, round(CAST(count(*) AS DOUBLE), 6) AS g FROM embeddings GROUP BY label
"""


# --------------------------------------------------------------------------- topic_vendi (V3)
def q_topic_vendi(spark, sf_dir):
    """V3: cosine Vendi score of the sentence vectors of each topic."""
    v = diversity.vendi_cosine(fx.embedding(spark, sf_dir), keys=["topic_nr"])
    return v.select("topic_nr", F.round("vs", 6).alias("vs"), "n")


def q_vector_vendi_curve(spark, sf_dir):
    """V4: Vendi score of growing md5-ordered samples (100, 200, 500, 1000, ...)."""
    v = distances.vendi_curve(fx.embedding(spark, sf_dir), sizes=(100, 200, 500, 1000, 2000, 5000, 10000))
    return v.select("size", F.round("vs", 6).alias("vs"), "n")


# --------------------------------------------------------------------------- radius_sample
RADIUS = 0.85
RADIUS_N = 20


def q_radius_sample(spark, sf_dir):
    pts = fx.embedding(spark, sf_dir)
    s = diversity.radius_sample(pts, n=RADIUS_N, radius=RADIUS, seed=SEED)
    return s.select("anchor_id", "doc_id", F.round("dist", 6).alias("dist"), "n_within")


SQL_RADIUS_SAMPLE = """
WITH p AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
a AS (SELECT doc_id AS anchor_id, v AS av,
             row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'anchor', doc_id)), doc_id) AS anchor_rank
      FROM p),
d AS (SELECT a.anchor_id, a.anchor_rank, p.doc_id,
        1.0 - CASE WHEN sqrt(list_sum(list_transform(p.v, lambda x: x * x))) > 0
                        AND sqrt(list_sum(list_transform(a.av, lambda x: x * x))) > 0
                   THEN list_sum(list_transform(list_zip(p.v, a.av), lambda t: t[1] * t[2]))
                        / (sqrt(list_sum(list_transform(p.v, lambda x: x * x))) * sqrt(list_sum(list_transform(a.av, lambda x: x * x))))
                   ELSE 0.0 END AS dist
      FROM p CROSS JOIN a),
near AS (SELECT * FROM d WHERE dist <= 0.85),
cnt AS (SELECT anchor_id, anchor_rank, count(*) AS n_within FROM near GROUP BY ALL),
best AS (SELECT anchor_id, n_within FROM cnt WHERE n_within >= 20 ORDER BY anchor_rank LIMIT 1),
pick AS (SELECT n.anchor_id, n.doc_id, n.dist, b.n_within,
           row_number() OVER (PARTITION BY n.anchor_id ORDER BY md5(concat_ws('|', '42', 'pick', n.doc_id)), n.doc_id) AS rn
         FROM near n JOIN best b ON n.anchor_id = b.anchor_id)
SELECT anchor_id, doc_id, round(dist, 6) AS dist, n_within FROM pick WHERE rn <= 20
"""


# --------------------------------------------------------------------------- distance_profile
def q_distance_profile(spark, sf_dir):
    """V7: moments and min/max of all pairwise cosine distances (i < j)."""
    prof = distances.distance_summary(fx.embedding(spark, sf_dir), metric="cosine")
    return prof.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


_SQL_PAIRS = """
WITH p AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM p),
pairs AS (
  SELECT 1.0 - CASE WHEN a.nrm > 0 AND b.nrm > 0
                    THEN list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])) / (a.nrm * b.nrm)
                    ELSE 0.0 END AS d
  FROM u a JOIN u b ON a.doc_id < b.doc_id)
"""

SQL_DISTANCE_PROFILE = _SQL_PAIRS + """
SELECT count(*) AS n_pairs, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std,
       round(min(d), 6) AS min, round(max(d), 6) AS max FROM pairs
"""


def q_distance_histogram(spark, sf_dir):
    """A8 on V7: 30 equal-width bins over [min, max], last bin closed."""
    h = distances.distance_histogram(fx.embedding(spark, sf_dir), metric="cosine", bins=30)
    return h.select("bin", "n")


SQL_DISTANCE_HISTOGRAM = _SQL_PAIRS + """,
mm AS (SELECT min(d) AS lo, max(d) AS hi FROM pairs)
SELECT CAST(least(floor((d - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n
FROM pairs, mm GROUP BY 1
"""


_DECILES = [round(i / 10, 1) for i in range(11)]


def q_distance_deciles(spark, sf_dir):
    """V7 + A7: exact deciles of all pairwise cosine distances (pairs never emitted)."""
    q = distances.distance_quantiles(fx.embedding(spark, sf_dir), _DECILES, metric="cosine")
    return q.select("q", F.round("value", 6).alias("value"))


SQL_DISTANCE_DECILES = _SQL_PAIRS + """
SELECT unnest([""" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _DECILES) + """]) AS q,
       round(unnest(quantile_cont(d, [""" + ", ".join(str(x) for x in _DECILES) + """])), 6) AS value
FROM pairs
"""


def q_topic_vendi2(spark, sf_dir):
    """V2 / V3 at order 2: 1 / sum (g / n)^2 over the Gram table of each topic."""
    g = diversity.gram_table(fx.embedding(spark, sf_dir), keys=["topic_nr"])
    return diversity.vendi2_from_gram(g, ["topic_nr"]).select("topic_nr", F.round("vs2", 6).alias("vs2"), "n")


SQL_TOPIC_VENDI2 = """
WITH e AS (SELECT vec_id, label AS topic_nr, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e),
x AS (SELECT vec_id, topic_nr, generate_subscripts(v, 1) AS i,
             unnest(list_transform(v, lambda y: CASE WHEN nrm > 0 THEN y / nrm ELSE 0.0 END)) AS x FROM n),
g AS (SELECT a.topic_nr, a.i, b.i AS j, sum(a.x * b.x) AS g FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL),
c AS (SELECT label AS topic_nr, count(*) AS n FROM embeddings GROUP BY 1)
SELECT g.topic_nr, round(1.0 / sum(power(g / n, 2)), 6) AS vs2, n FROM g JOIN c ON g.topic_nr = c.topic_nr GROUP BY g.topic_nr, n
"""


def q_vector_vendi2_curve(spark, sf_dir):
    """V4 at order 2: the score of growing md5-ordered samples."""
    v = distances.vendi_curve(fx.embedding(spark, sf_dir), sizes=(100, 200, 500, 1000, 2000, 5000, 10000), q=2.0)
    return v.select(F.col("size").cast("int").alias("size"), F.round("vs", 6).alias("vs2"), "n")


SQL_VECTOR_VENDI2_CURVE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
             row_number() OVER (ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id) AS rk, count(*) OVER () AS total FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e),
x AS (SELECT vec_id, rk, generate_subscripts(v, 1) AS i,
             unnest(list_transform(v, lambda y: CASE WHEN nrm > 0 THEN y / nrm ELSE 0.0 END)) AS x FROM n),
s0 AS (SELECT unnest([100, 200, 500, 1000, 2000, 5000, 10000]) AS size),
s AS (SELECT size, least(size, total) AS n FROM s0 CROSS JOIN (SELECT count(*) AS total FROM embeddings)
      QUALIFY size <= total OR size = min(size) FILTER (WHERE size >= total) OVER ()),
g AS (SELECT s.size, s.n, a.i, b.i AS j, sum(a.x * b.x) AS g FROM x a JOIN x b ON a.vec_id = b.vec_id
      JOIN s ON a.rk <= s.size GROUP BY ALL)
SELECT size, round(1.0 / sum(power(g / n, 2)), 6) AS vs2, n FROM g GROUP BY size, n
"""


def q_distance_square(spark, sf_dir):
    """J10 + A6 + A7: moments and deciles of the full distance matrix, diagonal and both triangles."""
    pts = fx.embedding(spark, sf_dir)
    prof = distances.distance_summary(pts, metric="cosine", square=True).select("n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "std")])
    q = distances.distance_quantiles(pts, _DECILES, metric="cosine", square=True)
    return q.select("q", F.round("value", 6).alias("value")).crossJoin(F.broadcast(prof))


SQL_DISTANCE_SQUARE = _SQL_PAIRS.replace("a.doc_id < b.doc_id", "true").replace(
    "SELECT 1.0 - CASE", "SELECT CASE WHEN a.doc_id = b.doc_id AND a.nrm > 0 THEN 0.0 ELSE 1.0 END * (1.0 - CASE").replace(
    "ELSE 0.0 END AS d\n", "ELSE 0.0 END) AS d\n") + """,
prof AS (SELECT count(*) AS n_pairs, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std FROM pairs),
q AS (SELECT unnest([""" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _DECILES) + """]) AS q,
      round(unnest(quantile_cont(d, [""" + ", ".join(str(x) for x in _DECILES) + """])), 6) AS value FROM pairs)
SELECT q, value, n_pairs, mean, std FROM q CROSS JOIN prof
"""


QUERIES = {
    "distance_square": q_distance_square,
    "topic_vendi2": q_topic_vendi2,
    "vector_vendi2_curve": q_vector_vendi2_curve,
    "distance_deciles": q_distance_deciles,
    "topic_gram": q_topic_gram,
    "topic_vendi": q_topic_vendi,
    "vector_vendi_curve": q_vector_vendi_curve,
    "radius_sample": q_radius_sample,
    "distance_profile": q_distance_profile,
    "distance_histogram": q_distance_histogram,
}

ORACLE = {
    "distance_square": SQL_DISTANCE_SQUARE,
    "topic_vendi2": SQL_TOPIC_VENDI2,
    "vector_vendi2_curve": SQL_VECTOR_VENDI2_CURVE,
    "distance_deciles": SQL_DISTANCE_DECILES,
    "topic_gram": SQL_TOPIC_GRAM,
    "radius_sample": SQL_RADIUS_SAMPLE,
    "distance_profile": SQL_DISTANCE_PROFILE,
    "distance_histogram": SQL_DISTANCE_HISTOGRAM,
}
