"""Registered queries for aggregations and statistics (A1-A20, W*, X4) on
lineitem / orders / documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.operators import stats
from varietas.sources import fixtures as fx

R6 = lambda c: F.round(c, 6)


def _lineitem(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem")


# --------------------------------------------------------------------------- A14
def q_ols_by_group(spark, sf_dir):
    r = stats.ols(_lineitem(spark, sf_dir), "l_extendedprice", "l_quantity",
                  ["l_returnflag", "l_linestatus"], with_p=False)
    return r.select("l_returnflag", "l_linestatus", "n",
                    *[R6(c).alias(c) for c in ("slope", "intercept", "r2", "stderr", "t")])


SQL_OLS_BY_GROUP = """
WITH a AS (
  SELECT l_returnflag, l_linestatus, regr_slope(l_extendedprice, l_quantity) AS slope,
         regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
         regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
         regr_count(l_extendedprice, l_quantity) AS n
  FROM lineitem GROUP BY ALL),
b AS (SELECT *, sqrt(greatest(syy - slope * slope * sxx, 0.0) / (n - 2) / sxx) AS stderr FROM a)
SELECT l_returnflag, l_linestatus, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(r2, 6) AS r2, round(stderr, 6) AS stderr, round(slope / stderr, 6) AS t FROM b
"""


def q_ols_pvalues(spark, sf_dir):
    """A14 + X4: p of the slope (rows-only; p-values are not SQL)."""
    o = fx.table(spark, sf_dir, "orders")
    r = stats.ols(o, "o_totalprice", "o_custkey", ["o_orderpriority"])
    return r.select("o_orderpriority", "n", R6("slope").alias("slope"), R6("t").alias("t"), R6("p").alias("p"))


# --------------------------------------------------------------------------- A12 / A13
def q_corr_by_group(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    keys = ["l_returnflag", "l_linestatus"]
    p = stats.pearson(li, "l_quantity", "l_discount", keys, with_p=False)
    s = stats.spearman(li, "l_quantity", "l_discount", keys, with_p=False)
    return p.select(*keys, "n", R6("r").alias("pearson_r"), R6("t").alias("pearson_t")).join(
        s.select(*keys, R6("rho").alias("spearman_rho")), keys)


SQL_CORR_BY_GROUP = """
WITH p AS (SELECT l_returnflag, l_linestatus, count(*) AS n, corr(l_quantity, l_discount) AS r
           FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY ALL),
rk AS (SELECT l_returnflag, l_linestatus,
         rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity)
           + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_discount)
           + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_discount) - 1) / 2.0 AS ry
       FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL),
s AS (SELECT l_returnflag, l_linestatus, corr(rx, ry) AS rho FROM rk GROUP BY ALL)
SELECT p.l_returnflag, p.l_linestatus, CAST(p.n AS BIGINT) AS n, round(p.r, 6) AS pearson_r,
       round(p.r * sqrt((p.n - 2) / (1 - p.r * p.r)), 6) AS pearson_t, round(s.rho, 6) AS spearman_rho
FROM p JOIN s ON p.l_returnflag = s.l_returnflag AND p.l_linestatus = s.l_linestatus
"""


def q_corr_pvalues(spark, sf_dir):
    """A12 / A13 with p-values (rows-only)."""
    li = _lineitem(spark, sf_dir)
    keys = ["l_returnflag", "l_linestatus"]
    p = stats.pearson(li, "l_quantity", "l_extendedprice", keys)
    s = stats.spearman(li, "l_quantity", "l_extendedprice", keys)
    return p.select(*keys, R6("r").alias("pearson_r"), R6("p").alias("pearson_p")).join(
        s.select(*keys, R6("rho").alias("spearman_rho"), R6("p").alias("spearman_p")), keys)


# --------------------------------------------------------------------------- A15
def q_anova_groups(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    a = stats.anova(o, "o_totalprice", "o_orderpriority", ["o_orderstatus"], with_p=False)
    return a.select("o_orderstatus", "k", "n", "df1", "df2",
                    R6(F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta_sq"), R6("f").alias("f"))


SQL_ANOVA_GROUPS = """
WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n_g, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v
           FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(n_g) OVER (PARTITION BY o_orderstatus) AS n_all,
             sum(n_g * m) OVER (PARTITION BY o_orderstatus) / sum(n_g) OVER (PARTITION BY o_orderstatus) AS grand FROM g),
a AS (SELECT o_orderstatus, sum(n_g * (m - grand) * (m - grand)) AS ssb, sum(n_g * v) AS ssw,
             count(*) AS k, first(n_all) AS n FROM t GROUP BY o_orderstatus)
SELECT o_orderstatus, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df1,
       CAST(n - k AS BIGINT) AS df2, round(ssb / (ssb + ssw), 6) AS eta_sq,
       round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f
FROM a
"""


def q_anova_low_high(spark, sf_dir):
    """A15 + P18 + P20 as in the analysis: min-max scale, right-closed bins,
    ANOVA of low against high (rows-only: carries the p-value)."""
    o = fx.table(spark, sf_dir, "orders").withColumn("_vs", F.col("o_totalprice"))
    from varietas.functions.text import bin_edges
    o = stats.with_min_max(o, "_vs", ["o_orderpriority"], "_scaled").withColumn("group", bin_edges("_scaled"))
    a = stats.anova(o, "o_custkey", "group", ["o_orderpriority"], groups=["low", "high"])
    return a.select("o_orderpriority", "k", "n", R6("f").alias("f"), R6("p").alias("p"))


# --------------------------------------------------------------------------- A16
_PIVOT_COLS = [str(i) for i in range(1, 8)]


def q_regression_pivot(spark, sf_dir):
    li = _lineitem(spark, sf_dir).withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    cells = stats.regression_pivot(li, "l_extendedprice", "l_quantity", ["l_returnflag"], "l_linestatus",
                                   ["l_linenumber"], with_stars=False)
    return stats.pivot_cells(cells, ["l_returnflag", "row_minority"], _PIVOT_COLS)


SQL_REGRESSION_PIVOT = """
WITH g AS (
  SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 0 THEN l_linestatus END AS row_minority,
         CAST(l_linenumber AS VARCHAR) AS col, regr_slope(l_extendedprice, l_quantity) AS slope
  FROM lineitem
  GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag, l_linestatus, l_linenumber))),
c AS (SELECT l_returnflag, row_minority, col,
             CASE WHEN slope IS NULL THEN 'N/A' ELSE format('{:.3f}', slope * 10) END AS cell FROM g)
SELECT l_returnflag, row_minority,
""" + ",\n".join(f"  coalesce(max(CASE WHEN col = '{c}' THEN cell END), 'N/A') AS \"{c}\"" for c in _PIVOT_COLS) + """
FROM c GROUP BY l_returnflag, row_minority
"""


def q_regression_pivot_stars(spark, sf_dir):
    """A16 with significance stars (inclusive rule; rows-only)."""
    li = _lineitem(spark, sf_dir).withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    cells = stats.regression_pivot(li, "l_extendedprice", "l_quantity", ["l_returnflag"], "l_linestatus",
                                   ["l_linenumber"], with_stars=True)
    return stats.pivot_cells(cells, ["l_returnflag", "row_minority"], _PIVOT_COLS)


# --------------------------------------------------------------------------- A6 / A7 / A8 / A18
def q_price_summary(spark, sf_dir):
    s = stats.summary(_lineitem(spark, sf_dir), "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", "n", *[R6(c).alias(c) for c in ("mean", "std", "min", "max")])


SQL_PRICE_SUMMARY = """
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_pop(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
       round(max(l_extendedprice), 6) AS max
FROM lineitem GROUP BY l_returnflag
"""

_DECILES = [round(i / 10, 1) for i in range(11)]


def q_price_deciles(spark, sf_dir):
    q = stats.quantiles(_lineitem(spark, sf_dir), "l_extendedprice", _DECILES, ["l_returnflag", "l_linestatus"])
    return q.select("l_returnflag", "l_linestatus", "q", R6("value").alias("value"))


SQL_PRICE_DECILES = """
SELECT l_returnflag, l_linestatus, unnest([""" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _DECILES) + """]) AS q,
       round(unnest(quantile_cont(l_extendedprice, [""" + ", ".join(str(x) for x in _DECILES) + """])), 6) AS value
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag, l_linestatus
"""


def q_price_histogram(spark, sf_dir):
    h = stats.histogram(_lineitem(spark, sf_dir), "l_extendedprice", 30, ["l_returnflag"])
    return h.select("l_returnflag", "bin", "n")


SQL_PRICE_HISTOGRAM = """
WITH m AS (SELECT l_returnflag, l_extendedprice AS x,
                  min(l_extendedprice) OVER (PARTITION BY l_returnflag) AS lo,
                  max(l_extendedprice) OVER (PARTITION BY l_returnflag) AS hi
           FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT l_returnflag, CAST(least(floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END * 30), 29) AS INTEGER) AS bin,
       count(*) AS n
FROM m GROUP BY ALL
"""


def q_box_summary(spark, sf_dir):
    """Quartiles by group, middle group left out."""
    o = fx.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") != "3-MEDIUM")
    q = stats.quantiles(o, "o_totalprice", [0.0, 0.25, 0.5, 0.75, 1.0], ["o_orderpriority"])
    return q.select("o_orderpriority", "q", R6("value").alias("value"))


SQL_BOX_SUMMARY = """
SELECT o_orderpriority, unnest([CAST(0.0 AS DOUBLE), 0.25, 0.5, 0.75, 1.0]) AS q,
       round(unnest(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0])), 6) AS value
FROM orders WHERE o_orderpriority <> '3-MEDIUM' AND o_totalprice IS NOT NULL GROUP BY o_orderpriority
"""


# --------------------------------------------------------------------------- A1 / A4 / A5 / A20
def q_topic_counts(spark, sf_dir):
    """A1 with dropna=False: NULL topic is its own group."""
    return stats.value_counts(fx.doc_topic(spark, sf_dir), ["topic_nr"])


SQL_TOPIC_COUNTS = """
SELECT e.label AS topic_nr, count(*) AS count
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY e.label
"""


def q_mean_by(spark, sf_dir):
    """A4: mean of two measures per group."""
    li = _lineitem(spark, sf_dir)
    return li.groupBy("l_linestatus").agg(R6(F.avg("l_discount")).alias("mean_discount"),
                                          R6(F.avg("l_tax")).alias("mean_tax"))


SQL_MEAN_BY = """
SELECT l_linestatus, round(avg(l_discount), 6) AS mean_discount, round(avg(l_tax), 6) AS mean_tax
FROM lineitem GROUP BY l_linestatus
"""


def q_distinct_values(spark, sf_dir):
    """A5: distinct values and their number."""
    d = fx.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"))


SQL_DISTINCT_VALUES = "SELECT lang, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang"


def q_audit_counts(spark, sf_dir):
    """Rows before, NULL / empty texts, rows after the text filter."""
    d = fx.table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("rows_before"),
                 F.count_if(F.col("text").isNull()).alias("null_text"),
                 F.count_if(F.length("text") == 0).alias("empty_text"),
                 F.count_if(F.length("text") > 0).alias("rows_after"))


SQL_AUDIT_COUNTS = """
SELECT count(*) AS rows_before, CAST(count_if(text IS NULL) AS BIGINT) AS null_text,
       CAST(count_if(length(text) = 0) AS BIGINT) AS empty_text,
       CAST(count_if(length(text) > 0) AS BIGINT) AS rows_after FROM documents
"""


def q_annotator_mean(spark, sf_dir):
    """Mean label per (item, unit) over its annotations (events: user x type)."""
    e = fx.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("article"), F.col("event_type").alias("sentence")).agg(
        R6(F.avg("value")).alias("mean_label"), F.count("*").alias("n_annotations"))


SQL_ANNOTATOR_MEAN = """
SELECT user_id AS article, event_type AS sentence, round(avg(value), 6) AS mean_label, count(*) AS n_annotations
FROM events GROUP BY user_id, event_type
"""


QUERIES = {
    "annotator_mean": q_annotator_mean,
    "ols_by_group": q_ols_by_group,
    "ols_pvalues": q_ols_pvalues,
    "corr_by_group": q_corr_by_group,
    "corr_pvalues": q_corr_pvalues,
    "anova_groups": q_anova_groups,
    "anova_low_high": q_anova_low_high,
    "regression_pivot": q_regression_pivot,
    "regression_pivot_stars": q_regression_pivot_stars,
    "price_summary": q_price_summary,
    "price_deciles": q_price_deciles,
    "price_histogram": q_price_histogram,
    "box_summary": q_box_summary,
    "topic_counts": q_topic_counts,
    "mean_by": q_mean_by,
    "distinct_values": q_distinct_values,
    "audit_counts": q_audit_counts,
}

ORACLE = {
    "annotator_mean": SQL_ANNOTATOR_MEAN,
    "ols_by_group": SQL_OLS_BY_GROUP,
    "corr_by_group": SQL_CORR_BY_GROUP,
    "anova_groups": SQL_ANOVA_GROUPS,
    "regression_pivot": SQL_REGRESSION_PIVOT,
    "price_summary": SQL_PRICE_SUMMARY,
    "price_deciles": SQL_PRICE_DECILES,
    "price_histogram": SQL_PRICE_HISTOGRAM,
    "box_summary": SQL_BOX_SUMMARY,
    "topic_counts": SQL_TOPIC_COUNTS,
    "mean_by": SQL_MEAN_BY,
    "distinct_values": SQL_DISTINCT_VALUES,
    "audit_counts": SQL_AUDIT_COUNTS,
}


# --------------------------------------------------------------------------- p-value oracles
from varietas.plans.sql_pvalues import betainc_ctes, f_src, t_src  # noqa: E402

SQL_OLS_PVALUES = """
WITH RECURSIVE a AS (
  SELECT o_orderpriority, o_orderpriority AS id, regr_slope(o_totalprice, o_custkey) AS slope,
         regr_sxx(o_totalprice, o_custkey) AS sxx, regr_syy(o_totalprice, o_custkey) AS syy,
         regr_count(o_totalprice, o_custkey) AS n
  FROM orders GROUP BY o_orderpriority),
b AS (SELECT *, slope / sqrt(greatest(syy - slope * slope * sxx, 0.0) / (n - 2) / sxx) AS t, n - 2 AS df FROM a),
""" + t_src("b", "t", "df", "src") + "," + betainc_ctes("src", "pv") + """
SELECT b.o_orderpriority, CAST(b.n AS BIGINT) AS n, round(b.slope, 6) AS slope, round(b.t, 6) AS t, round(pv.p, 6) AS p
FROM b JOIN pv ON b.id = pv.id
"""

SQL_CORR_PVALUES = """
WITH RECURSIVE base AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, l_extendedprice AS y FROM lineitem
                        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
p AS (SELECT l_returnflag, l_linestatus, l_returnflag || '|' || l_linestatus AS id, count(*) AS n, corr(x, y) AS r
      FROM base GROUP BY ALL),
rk AS (SELECT l_returnflag, l_linestatus,
         rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY x)
           + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY y)
           + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, y) - 1) / 2.0 AS ry FROM base),
s AS (SELECT l_returnflag, l_linestatus, l_returnflag || '|' || l_linestatus AS id, count(*) AS n, corr(rx, ry) AS rho
      FROM rk GROUP BY ALL),
pt AS (SELECT id, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM p),
st AS (SELECT id, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS df FROM s),
""" + t_src("pt", "t", "df", "psrc") + "," + betainc_ctes("psrc", "ppv") + "," + \
    t_src("st", "t", "df", "ssrc") + "," + betainc_ctes("ssrc", "spv") + """
SELECT p.l_returnflag, p.l_linestatus, round(p.r, 6) AS pearson_r, round(ppv.p, 6) AS pearson_p,
       round(s.rho, 6) AS spearman_rho, round(spv.p, 6) AS spearman_p
FROM p JOIN s ON p.id = s.id JOIN ppv ON p.id = ppv.id JOIN spv ON p.id = spv.id
"""

SQL_ANOVA_LOW_HIGH = """
WITH RECURSIVE o AS (
  SELECT o_orderpriority, o_custkey,
    CASE WHEN max(o_totalprice) OVER w > min(o_totalprice) OVER w
         THEN (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w)
         ELSE 0.0 END AS s
  FROM orders WINDOW w AS (PARTITION BY o_orderpriority)),
gq AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN s <= 0.1 THEN 'low' WHEN s <= 0.9 THEN 'middle' ELSE 'high' END AS grp
       FROM o),
g AS (SELECT o_orderpriority, grp, count(*) AS n_g, avg(o_custkey) AS m, var_pop(o_custkey) AS v
      FROM gq WHERE o_custkey IS NOT NULL AND grp IN ('low', 'high') GROUP BY ALL),
t AS (SELECT *, sum(n_g) OVER (PARTITION BY o_orderpriority) AS n_all,
             sum(n_g * m) OVER (PARTITION BY o_orderpriority) / sum(n_g) OVER (PARTITION BY o_orderpriority) AS grand FROM g),
a AS (SELECT o_orderpriority, o_orderpriority AS id, sum(n_g * (m - grand) * (m - grand)) AS ssb, sum(n_g * v) AS ssw,
             count(*) AS k, first(n_all) AS n FROM t GROUP BY o_orderpriority),
fa AS (SELECT *, (ssb / (k - 1)) / (ssw / (n - k)) AS f, k - 1 AS d1, n - k AS d2 FROM a),
""" + f_src("fa", "f", "d1", "d2", "src") + "," + betainc_ctes("src", "pv") + """
SELECT fa.o_orderpriority, CAST(fa.k AS BIGINT) AS k, CAST(fa.n AS BIGINT) AS n, round(fa.f, 6) AS f, round(pv.p, 6) AS p
FROM fa JOIN pv ON fa.id = pv.id
"""

SQL_REGRESSION_PIVOT_STARS = """
WITH RECURSIVE g AS (
  SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 0 THEN l_linestatus END AS row_minority,
         CAST(l_linenumber AS VARCHAR) AS col, regr_slope(l_extendedprice, l_quantity) AS slope,
         regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
         regr_count(l_extendedprice, l_quantity) AS n
  FROM lineitem
  GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag, l_linestatus, l_linenumber))),
gi AS (SELECT *, concat_ws('|', l_returnflag, coalesce(row_minority, '~'), col) AS id,
              slope / sqrt(greatest(syy - slope * slope * sxx, 0.0) / (n - 2) / sxx) AS t, n - 2 AS df FROM g),
""" + t_src("gi", "t", "df", "src") + "," + betainc_ctes("src", "pv") + """,
c AS (SELECT gi.l_returnflag, gi.row_minority, gi.col,
             CASE WHEN gi.slope IS NULL THEN 'N/A'
                  ELSE format('{:.3f}', gi.slope * 10) ||
                       CASE WHEN pv.p <= 0.01 THEN '**' WHEN pv.p <= 0.05 THEN '*' ELSE '' END END AS cell
      FROM gi LEFT JOIN pv ON gi.id = pv.id)
SELECT l_returnflag, row_minority,
""" + ",\n".join(f"  coalesce(max(CASE WHEN col = '{c}' THEN cell END), 'N/A') AS \"{c}\"" for c in _PIVOT_COLS) + """
FROM c GROUP BY l_returnflag, row_minority
"""

ORACLE.update({
    "ols_pvalues": SQL_OLS_PVALUES,
    "corr_pvalues": SQL_CORR_PVALUES,
    "anova_low_high": SQL_ANOVA_LOW_HIGH,
    "regression_pivot_stars": SQL_REGRESSION_PIVOT_STARS,
})
