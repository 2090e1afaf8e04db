"""Registered queries: corpus preparation, allocation, draws and Vendi scores.

Every query reads the test tables under ``sf_dir`` and returns a DataFrame.
Float outputs are rounded to 6 decimals (Spark and DuckDB differ in the last
digits of sums).  The oracle SQL twin of each query sits next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varietas.operators import diversity, joins, sampling
from varietas.sources import fixtures as fx

N = 500
SEED = 42


def rated_pool(spark: SparkSession, sf_dir: str, drop_sources: tuple[str, ...] = ()) -> DataFrame:
    """Corpus with (reliability, bias) of its source."""
    c = fx.corpus(spark, sf_dir).select("doc_id", "source", "lang", "category", "label")
    return joins.enrich_left(c, fx.rating(spark, sf_dir, drop_sources), on="source")


# --------------------------------------------------------------------------- corpus_rated
def q_corpus_rated(spark, sf_dir):
    """J1 + A2 + W3 + P18 + P19: per-source profile."""
    c = fx.corpus(spark, sf_dir)
    sizes = c.groupBy("source").agg(F.count("*").alias("size"))
    prof = joins.enrich_left(sizes, fx.rating(spark, sf_dir), on="source")
    allw = Window.partitionBy(F.lit(1))
    return prof.select(
        "source", "size", "reliability", "bias",
        F.round(F.col("size") / F.sum("size").over(allw), 6).alias("proportion"),
        F.round(F.col("size") / F.max("size").over(allw) * 50, 6).alias("scaled_size"),
        F.round(F.coalesce((F.col("reliability") - F.min("reliability").over(allw))
                           / F.nullif(F.max("reliability").over(allw) - F.min("reliability").over(allw),
                                      F.lit(0.0)), F.lit(0.0)), 6).alias("reliability_mm"))


SQL_CORPUS_RATED = """
WITH rating AS (
  SELECT d.source, round(avg(l.quality) * 64, 6) AS reliability, round(avg(l.toxic) * 84 - 42, 6) AS bias
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source),
sizes AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
prof AS (SELECT s.source, s.size, r.reliability, r.bias FROM sizes s LEFT JOIN rating r ON s.source = r.source)
SELECT source, size, reliability, bias,
  round(size / sum(size) OVER (), 6) AS proportion,
  round(size / max(size) OVER () * 50, 6) AS scaled_size,
  round(coalesce((reliability - min(reliability) OVER ())
        / nullif(max(reliability) OVER () - min(reliability) OVER (), 0), 0), 6) AS reliability_mm
FROM prof
"""


# --------------------------------------------------------------------------- unrated_sources
def q_unrated_sources(spark, sf_dir):
    """Sources without a rating (the rating table lacks src0)."""
    c = fx.corpus(spark, sf_dir)
    return joins.unmatched(c, fx.rating(spark, sf_dir, ("src0",)), "source")


SQL_UNRATED_SOURCES = """
WITH rating AS (
  SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.source <> 'src0' GROUP BY d.source)
SELECT DISTINCT source FROM documents d
WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rating r WHERE r.source = d.source)
"""


# --------------------------------------------------------------------------- uniform_allocation
def q_uniform_allocation(spark, sf_dir):
    """D4 with category = source_lang."""
    caps = sampling.category_caps(fx.corpus(spark, sf_dir))
    return sampling.allocate_uniform(caps, N)


_SQL_UNIFORM_ALLOC_CTE = """
caps AS (SELECT concat_ws('_', source, lang) AS category, count(*) AS cap FROM documents
         WHERE concat_ws('_', source, lang) IS NOT NULL GROUP BY 1),
s AS (SELECT category, cap,
        row_number() OVER (ORDER BY cap, category) - 1 AS i,
        coalesce(sum(cap) OVER (ORDER BY cap, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_i,
        count(*) OVER () AS m, sum(cap) OVER () AS total FROM caps),
l AS (SELECT *, max(floor((500 - s_i) / (m - i))) OVER () AS lvl FROM s),
b AS (SELECT *, CASE WHEN total <= 500 THEN cap ELSE least(cap, lvl) END AS base,
             (total > 500 AND cap > lvl) AS open_ FROM l),
r AS (SELECT *, 500 - sum(base) OVER () AS rem,
             row_number() OVER (PARTITION BY open_ ORDER BY category) AS ord FROM b),
alloc AS (SELECT category, cap,
             CAST(base + CASE WHEN open_ AND ord <= rem THEN 1 ELSE 0 END AS BIGINT) AS n FROM r)
"""

SQL_UNIFORM_ALLOCATION = "WITH " + _SQL_UNIFORM_ALLOC_CTE + "SELECT category, cap, n FROM alloc"


# --------------------------------------------------------------------------- uniform_members
def uniform_members_df(spark, sf_dir, reps: int = 3) -> DataFrame:
    pool = rated_pool(spark, sf_dir)
    caps = sampling.category_caps(pool)
    alloc = sampling.allocate_uniform(caps, N).withColumn(
        "subsample", F.explode(F.array(*[F.lit(f"alpha_inf_idx_{r}") for r in range(1, reps + 1)])))
    return sampling.draw(pool, alloc, N, SEED)


def q_uniform_members(spark, sf_dir):
    """Three uniform subsamples."""
    return uniform_members_df(spark, sf_dir).select("subsample", "category", "doc_id")


_SQL_UNIFORM_MEMBERS_CTE = _SQL_UNIFORM_ALLOC_CTE + """,
reps AS (SELECT 'alpha_inf_idx_' || CAST(r AS VARCHAR) AS subsample FROM range(1, 4) t(r)),
docs AS (SELECT doc_id, source, concat_ws('_', source, lang) AS category FROM documents),
ranked AS (
  SELECT s.subsample, d.category, d.doc_id, d.source, a.n,
         row_number() OVER (PARTITION BY s.subsample, d.category
                            ORDER BY md5(concat_ws('|', '42', s.subsample, d.doc_id)), d.doc_id) AS rn
  FROM docs d JOIN alloc a ON d.category = a.category CROSS JOIN reps s WHERE a.n > 0),
members AS (SELECT subsample, category, doc_id, source FROM ranked WHERE rn <= n)
"""

SQL_UNIFORM_MEMBERS = "WITH " + _SQL_UNIFORM_MEMBERS_CTE + "SELECT subsample, category, doc_id FROM members"


# --------------------------------------------------------------------------- dirichlet_allocation
_FLAT_SUBSAMPLES = ("alpha_1_idx_1", "alpha_1_idx_2", "alpha_1_idx_3")


def q_dirichlet_allocation(spark, sf_dir):
    """D3 with Dirichlet(1) weights from md5 exponential spacings."""
    caps = sampling.category_caps(fx.corpus(spark, sf_dir))
    w = sampling.flat_dirichlet_weights(caps, _FLAT_SUBSAMPLES, SEED)
    a = sampling.allocate_dirichlet(w, caps, N, SEED)
    return a.select("subsample", "category", "cap", F.round("w", 6).alias("w"), "n")


SQL_DIRICHLET_ALLOCATION = """
WITH caps AS (SELECT concat_ws('_', source, lang) AS category, count(*) AS cap FROM documents
              WHERE concat_ws('_', source, lang) IS NOT NULL GROUP BY 1),
subs AS (SELECT unnest(['alpha_1_idx_1', 'alpha_1_idx_2', 'alpha_1_idx_3']) AS subsample),
e AS (SELECT s.subsample, c.category, c.cap,
        -ln((CAST(('0x' || substr(md5(concat_ws('|', '42', s.subsample, c.category)), 1, 8)) AS BIGINT) + 0.5)
            / 4294967296.0) AS e
      FROM caps c CROSS JOIN subs s),
w AS (SELECT subsample, category, cap, e / sum(e) OVER (PARTITION BY subsample) AS w FROM e),
a AS (SELECT *, CASE WHEN w IS NULL OR isnan(w) OR w <= 0 THEN 0 ELSE least(floor(500 * w), cap) END AS n0 FROM w),
b AS (SELECT *, 500 - sum(n0) OVER (PARTITION BY subsample) AS rem FROM a),
c AS (SELECT *, (n0 + rem) < cap AS ok FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY subsample, ok
                                   ORDER BY md5(concat_ws('|', '42', subsample, category)), category) AS pick FROM c)
SELECT subsample, category, cap, round(w, 6) AS w,
       CAST(n0 + CASE WHEN ok AND pick = 1 AND rem > 0 THEN rem ELSE 0 END AS BIGINT) AS n
FROM d
"""


def q_dirichlet_sweep_allocation(spark, sf_dir):
    """D2 + D3: weights and allocation of all 11 alphas x 3 draws."""
    caps = sampling.category_caps(fx.corpus(spark, sf_dir))
    a = sampling.allocate_dirichlet(sampling.dirichlet_weights(caps, seed=SEED), caps, N, SEED, carry=("alpha",))
    return a.select("subsample", "alpha", "category", "cap", F.round("w", 6).alias("w"), "n")


SQL_DIRICHLET_SWEEP_ALLOCATION = """
WITH caps AS (SELECT concat_ws('_', source, lang) AS category, count(*) AS cap FROM documents
              WHERE concat_ws('_', source, lang) IS NOT NULL GROUP BY 1),
grid AS (SELECT 'alpha_' || replace(a, '.', '_') || '_idx_' || r AS subsample, CAST(a AS DOUBLE) AS alpha
         FROM unnest([%s]) x(a) CROSS JOIN range(1, 4) y(r)),
h AS (SELECT g.subsample, g.alpha, c.category, c.cap, i, md5(concat_ws('|', '42', g.subsample, c.category, i)) AS h
      FROM caps c CROSS JOIN grid g CROSS JOIN range(%d) t(i)),
u AS (SELECT *, alpha + 2.0::DOUBLE / 3.0::DOUBLE AS d,
        (CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u0,
        (CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u1,
        (CAST('0x' || substr(h, 17, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u2,
        (CAST('0x' || substr(h, 25, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u3 FROM h),
z AS (SELECT *, sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) AS z FROM u),
v AS (SELECT *, pow(1 + z / sqrt(9 * d), 3) AS v FROM z),
ok AS (SELECT * FROM v WHERE CASE WHEN v > 0 THEN ln(u2) < z * z / 2 + d * (1 - v + ln(v)) ELSE false END),
lg AS (SELECT subsample, alpha, category, cap, arg_min(ln(d) + ln(v) + ln(u3) / alpha, i) AS lg FROM ok GROUP BY ALL),
e AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY subsample)) AS e FROM lg),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY subsample) AS w FROM e),
a AS (SELECT *, CASE WHEN w <= 0 THEN 0 ELSE least(floor(500 * w), cap) END AS n0 FROM w),
b AS (SELECT *, 500 - sum(n0) OVER (PARTITION BY subsample) AS rem FROM a),
c AS (SELECT *, (n0 + rem) < cap AS ok FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY subsample, ok
                                   ORDER BY md5(concat_ws('|', '42', subsample, category)), category) AS pick FROM c)
SELECT subsample, alpha, category, cap, round(w, 6) AS w,
       CAST(n0 + CASE WHEN ok AND pick = 1 AND rem > 0 THEN rem ELSE 0 END AS BIGINT) AS n
FROM p
""" % (", ".join(f"'{a}'" for a in sampling.DEFAULT_ALPHAS), sampling.GAMMA_TRIES)


# --------------------------------------------------------------------------- source kernel / vendi
def q_source_kernel(spark, sf_dir):
    """V1 kernel table over the distinct (reliability, bias) of the whole corpus."""
    k = diversity.feature_kernel_table(rated_pool(spark, sf_dir))
    return k.select(*[F.round(c, 6).alias(c) for c in
                      ("reliability_i", "bias_i", "reliability_j", "bias_j", "p_i", "p_j", "k")])


_SQL_RATING_CTE = """
rating AS (
  SELECT d.source, round(avg(l.quality) * 64, 6) AS reliability, round(avg(l.toxic) * 84 - 42, 6) AS bias
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)
"""

SQL_SOURCE_KERNEL = "WITH " + _SQL_RATING_CTE + """,
pool AS (SELECT r.reliability, r.bias FROM documents d LEFT JOIN rating r ON d.source = r.source
         WHERE r.reliability IS NOT NULL AND r.bias IS NOT NULL),
g AS (SELECT reliability, bias, count(*) AS c FROM pool GROUP BY ALL),
p AS (SELECT reliability, bias, c / sum(c) OVER () AS p FROM g)
SELECT round(a.reliability, 6) AS reliability_i, round(a.bias, 6) AS bias_i,
       round(b.reliability, 6) AS reliability_j, round(b.bias, 6) AS bias_j,
       round(a.p, 6) AS p_i, round(b.p, 6) AS p_j,
       round(1.0 / (1.0 + abs(a.reliability - b.reliability) + abs(a.bias - b.bias)), 6) AS k
FROM p a CROSS JOIN p b
"""


def q_source_vendi2(spark, sf_dir):
    """Order-2 Vendi score of each uniform subsample (plain aggregates)."""
    m = uniform_members_df(spark, sf_dir)
    k = diversity.feature_kernel_table(m, keys=["subsample"])
    return diversity.vendi2_from_kernel(k, ["subsample"]).select("subsample", F.round("vs2", 6).alias("vs2"))


SQL_SOURCE_VENDI2 = "WITH " + _SQL_UNIFORM_MEMBERS_CTE + "," + _SQL_RATING_CTE + """,
rm AS (SELECT m.subsample, r.reliability, r.bias FROM members m JOIN rating r ON m.source = r.source),
g AS (SELECT subsample, reliability, bias, count(*) AS c FROM rm GROUP BY ALL),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY subsample) AS p FROM g)
SELECT a.subsample,
       round(1.0 / sum(a.p * b.p * power(1.0 / (1.0 + abs(a.reliability - b.reliability) + abs(a.bias - b.bias)), 2)), 6) AS vs2
FROM p a JOIN p b ON a.subsample = b.subsample GROUP BY a.subsample
"""


def q_source_vendi(spark, sf_dir):
    """V1 + V5: order-1 Vendi score per uniform subsample (rows-only check)."""
    m = uniform_members_df(spark, sf_dir)
    s = diversity.vendi_features(m, ["subsample"])
    return diversity.score_table(s).select("subsample", "alpha", "vs", "normalized_vs")


def q_source_vendi_whole(spark, sf_dir):
    """V8: Vendi score of the unsampled corpus; sources without rating counted."""
    pool = rated_pool(spark, sf_dir, drop_sources=("src0",))
    return diversity.vendi_features(pool, keys=[]).select(F.round("vs", 6).alias("vs"), "n", "n_groups",
                                                         "n_unrated")


def subsample_scores(spark, sf_dir, n_total: int = N, reps: int = 3) -> DataFrame:
    """D6 + V1 + V5: the full sweep of 36 source subsamples with scores."""
    pool = rated_pool(spark, sf_dir)
    return sampling.create_scored_subsets(pool, lambda members: diversity.vendi_features(members, ["subsample"]),
                                          n_total=n_total, reps=reps, seed=SEED)[1]


def q_subsample_scores(spark, sf_dir):
    return subsample_scores(spark, sf_dir)


def flat_sweep_members(spark, sf_dir) -> DataFrame:
    """D6 in a form that SQL can follow: Dirichlet(1) subsamples from md5 spacings plus uniform ones."""
    pool = rated_pool(spark, sf_dir)
    caps = sampling.category_caps(pool)
    flat = sampling.allocate_dirichlet(sampling.flat_dirichlet_weights(caps, _FLAT_SUBSAMPLES, SEED), caps, N, SEED)
    uniform = sampling.allocate_uniform(caps, N).withColumn(
        "subsample", F.explode(F.array(*[F.lit(f"alpha_inf_idx_{r}") for r in range(1, 4)])))
    alloc = flat.select("subsample", "category", "n").unionByName(uniform.select("subsample", "category", "n"))
    return sampling.draw(pool, alloc, N, SEED)


def q_flat_sweep_scores(spark, sf_dir):
    """D6 + V1 at order 2 + V5: score table of three Dirichlet(1) and three uniform subsamples."""
    k = diversity.feature_kernel_table(flat_sweep_members(spark, sf_dir), keys=["subsample"])
    s = diversity.vendi2_from_kernel(k, ["subsample"]).withColumnRenamed("vs2", "vs")
    return diversity.score_table(s).select("subsample", "alpha", "vs", "normalized_vs")


_SQL_FLAT_CTE = SQL_DIRICHLET_ALLOCATION.strip().replace("WITH caps AS", "fcaps AS").replace("FROM caps c", "FROM fcaps c")
_SQL_FLAT_CTE = _SQL_FLAT_CTE.replace("w AS (SELECT subsample", "fw AS (SELECT subsample").replace("least(floor(500 * w), cap) END AS n0 FROM w)", "least(floor(500 * w), cap) END AS n0 FROM fw)")
_SQL_FLAT_CTE = _SQL_FLAT_CTE.replace("b AS (SELECT *, 500 - sum(n0)", "fb AS (SELECT *, 500 - sum(n0)").replace("AS ok FROM b)", "AS ok FROM fb)")

SQL_FLAT_SWEEP_SCORES = "WITH " + _SQL_UNIFORM_MEMBERS_CTE + "," + _SQL_RATING_CTE + "," + _SQL_FLAT_CTE.split("SELECT subsample, category, cap, round(w, 6)")[0].rstrip() + """,
flat AS (SELECT subsample, category,
           CAST(n0 + CASE WHEN ok AND pick = 1 AND rem > 0 THEN rem ELSE 0 END AS BIGINT) AS n FROM d),
franked AS (SELECT f.subsample, docs.category, docs.doc_id, docs.source, f.n,
              row_number() OVER (PARTITION BY f.subsample, docs.category
                                 ORDER BY md5(concat_ws('|', '42', f.subsample, docs.doc_id)), docs.doc_id) AS rn
            FROM docs JOIN flat f ON docs.category = f.category WHERE f.n > 0),
every AS (SELECT subsample, source FROM members UNION ALL SELECT subsample, source FROM franked WHERE rn <= n),
rm AS (SELECT m.subsample, r.reliability, r.bias FROM every m JOIN rating r ON m.source = r.source),
g AS (SELECT subsample, reliability, bias, count(*) AS c FROM rm GROUP BY ALL),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY subsample) AS p FROM g),
v AS (SELECT a.subsample,
       round(1.0 / sum(a.p * b.p * power(1.0 / (1.0 + abs(a.reliability - b.reliability) + abs(a.bias - b.bias)), 2)), 3) AS vs
FROM p a JOIN p b ON a.subsample = b.subsample GROUP BY a.subsample)
SELECT subsample, CASE WHEN subsample LIKE '%inf%' THEN CAST('inf' AS DOUBLE) ELSE 1.0::DOUBLE END AS alpha, vs,
       round(vs / max(vs) OVER (), 5) AS normalized_vs FROM v
"""


def q_source_vendi2_whole(spark, sf_dir):
    """V8 at order 2: the unsampled corpus, rows without a rating left out."""
    k = diversity.feature_kernel_table(rated_pool(spark, sf_dir, drop_sources=("src0",)))
    return diversity.vendi2_from_kernel(k).select(F.round("vs2", 6).alias("vs2"))


SQL_SOURCE_VENDI2_WHOLE = "WITH " + _SQL_RATING_CTE + """,
pool AS (SELECT r.reliability, r.bias FROM documents d JOIN rating r ON d.source = r.source WHERE d.source <> 'src0'),
g AS (SELECT reliability, bias, count(*) AS c FROM pool GROUP BY ALL),
p AS (SELECT *, c / sum(c) OVER () AS p FROM g)
SELECT round(1.0 / sum(a.p * b.p * power(1.0 / (1.0 + abs(a.reliability - b.reliability) + abs(a.bias - b.bias)), 2)), 6) AS vs2
FROM p a CROSS JOIN p b
"""


def q_random_docs(spark, sf_dir):
    """50 documents in md5 order (a top-k, not a full sort)."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.random_sample(d, 50, SEED)


SQL_RANDOM_DOCS = """
SELECT doc_id, source FROM documents ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id LIMIT 50
"""


QUERIES = {
    "flat_sweep_scores": q_flat_sweep_scores,
    "source_vendi2_whole": q_source_vendi2_whole,
    "random_docs": q_random_docs,
    "corpus_rated": q_corpus_rated,
    "unrated_sources": q_unrated_sources,
    "uniform_allocation": q_uniform_allocation,
    "uniform_members": q_uniform_members,
    "dirichlet_allocation": q_dirichlet_allocation,
    "dirichlet_sweep_allocation": q_dirichlet_sweep_allocation,
    "source_kernel": q_source_kernel,
    "source_vendi2": q_source_vendi2,
    "source_vendi": q_source_vendi,
    "source_vendi_whole": q_source_vendi_whole,
    "subsample_scores": q_subsample_scores,
}

ORACLE = {
    "flat_sweep_scores": SQL_FLAT_SWEEP_SCORES,
    "source_vendi2_whole": SQL_SOURCE_VENDI2_WHOLE,
    "random_docs": SQL_RANDOM_DOCS,
    "corpus_rated": SQL_CORPUS_RATED,
    "unrated_sources": SQL_UNRATED_SOURCES,
    "uniform_allocation": SQL_UNIFORM_ALLOCATION,
    "uniform_members": SQL_UNIFORM_MEMBERS,
    "dirichlet_allocation": SQL_DIRICHLET_ALLOCATION,
    "dirichlet_sweep_allocation": SQL_DIRICHLET_SWEEP_ALLOCATION,
    "source_kernel": SQL_SOURCE_KERNEL,
    "source_vendi2": SQL_SOURCE_VENDI2,
}
