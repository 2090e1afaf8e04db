"""Registered queries for the sweep: held-out split, naive Bayes per subsample,
predictions, metrics, and quality against diversity (D1, T1-T3, A9-A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.operators import diversity, joins, logistic, sampling, stats, sweep
from varietas.plans.sampling_plans import rated_pool
from varietas.session import cut_lineage
from varietas.sources import fixtures as fx

R6 = lambda c: F.round(c, 6)
SEED = 42
N = 500
TEST_FRACTION = 0.25


def split(spark, sf_dir) -> DataFrame:
    """D1 over the labelled corpus: (doc_id, label, is_test)."""
    lab = fx.corpus(spark, sf_dir).where(F.col("label").isNotNull()).select("doc_id", "label")
    return sampling.stratified_split(lab, "label", test_fraction=TEST_FRACTION, seed=SEED)


def q_stratified_split(spark, sf_dir):
    return split(spark, sf_dir).select("doc_id", "label", "is_test")


_SQL_SPLIT_CTE = """
lab AS (SELECT d.doc_id, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL),
cnt AS (SELECT label, count(*) AS nc FROM lab GROUP BY label),
q1 AS (SELECT *, sum(nc) OVER () AS n, ceil(0.25 * sum(nc) OVER ()) AS nt FROM cnt),
q2 AS (SELECT *, floor(nt * nc / n) AS q0, nt * nc / n - floor(nt * nc / n) AS frac FROM q1),
q3 AS (SELECT *, nt - sum(q0) OVER () AS left_, row_number() OVER (ORDER BY frac DESC, label) AS r FROM q2),
quota AS (SELECT label, q0 + CASE WHEN r <= left_ THEN 1 ELSE 0 END AS quota FROM q3),
split AS (SELECT l.doc_id, l.label,
            row_number() OVER (PARTITION BY l.label ORDER BY md5(concat_ws('|', '42', l.doc_id)), l.doc_id) <= q.quota AS is_test
          FROM lab l JOIN quota q ON l.label = q.label),
test AS (SELECT doc_id, label FROM split WHERE is_test)
"""

SQL_STRATIFIED_SPLIT = "WITH " + _SQL_SPLIT_CTE + "SELECT doc_id, label, is_test FROM split"


def uniform_train(spark, sf_dir, reps: int = 3, n_total: int = N):
    """Uniform subsamples drawn from the labelled corpus minus the test set."""
    sp = split(spark, sf_dir)
    test = cut_lineage(sp.where("is_test").select("doc_id", "label"))
    pool = (fx.corpus(spark, sf_dir).where(F.col("label").isNotNull()).select("doc_id", "category", "label")
            .join(test.select("doc_id"), "doc_id", "left_anti"))
    caps = sampling.category_caps(pool)
    alloc = sampling.allocate_uniform(caps, n_total).withColumn(
        "subsample", F.explode(F.array(*[F.lit(f"alpha_inf_idx_{r}") for r in range(1, reps + 1)])))
    members = sampling.draw(pool, alloc, n_total, SEED)
    train = members.select("subsample", "doc_id", "label")
    # both are id lists read by several later stages; cut their lineage once
    return cut_lineage(train), test


def nb_predictions(spark, sf_dir):
    train, test = uniform_train(spark, sf_dir)
    toks = fx.doc_texts(spark, sf_dir)
    model, _ = sweep.train_nb(train, toks)
    model = cut_lineage(model)
    classes = sweep.class_table(train, model)  # both inputs are materialised; a cheap aggregate
    return sweep.predict_nb(model, classes, test, toks), classes


def q_nb_model(spark, sf_dir):
    """Per-subsample class sizes, word totals and vocabulary."""
    train, _ = uniform_train(spark, sf_dir)
    _, classes = sweep.train_nb(train, fx.doc_texts(spark, sf_dir))
    return classes.select("subsample", "docs0", "docs1", "words0", "words1", "vocab")


_SQL_NB_CTE = _SQL_SPLIT_CTE + r""",
pool AS (SELECT d.doc_id, concat_ws('_', d.source, d.lang) AS category, l.toxic AS label
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id
         WHERE l.toxic IS NOT NULL AND d.doc_id NOT IN (SELECT doc_id FROM test)),
caps AS (SELECT category, count(*) AS cap FROM pool WHERE category IS NOT NULL GROUP BY 1),
s AS (SELECT category, cap,
        row_number() OVER (ORDER BY cap, category) - 1 AS i,
        coalesce(sum(cap) OVER (ORDER BY cap, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_i,
        count(*) OVER () AS m, sum(cap) OVER () AS total FROM caps),
lv AS (SELECT *, max(floor((500 - s_i) / (m - i))) OVER () AS lvl FROM s),
b AS (SELECT *, CASE WHEN total <= 500 THEN cap ELSE least(cap, lvl) END AS base,
             (total > 500 AND cap > lvl) AS open_ FROM lv),
r AS (SELECT *, 500 - sum(base) OVER () AS rem,
             row_number() OVER (PARTITION BY open_ ORDER BY category) AS ord FROM b),
alloc AS (SELECT category, base + CASE WHEN open_ AND ord <= rem THEN 1 ELSE 0 END AS n FROM r),
reps AS (SELECT 'alpha_inf_idx_' || CAST(x AS VARCHAR) AS subsample FROM range(1, 4) t(x)),
ranked AS (
  SELECT sp.subsample, p.doc_id, p.label, a.n,
         row_number() OVER (PARTITION BY sp.subsample, p.category
                            ORDER BY md5(concat_ws('|', '42', sp.subsample, p.doc_id)), p.doc_id) AS rn
  FROM pool p JOIN alloc a ON p.category = a.category CROSS JOIN reps sp WHERE a.n > 0),
train AS (SELECT subsample, doc_id, label FROM ranked WHERE rn <= n AND label IS NOT NULL),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM documents),
model AS (SELECT t.subsample, k.token, count_if(t.label = 0) AS n0, count_if(t.label = 1) AS n1
          FROM train t JOIN toks k ON t.doc_id = k.doc_id GROUP BY ALL),
docs AS (SELECT subsample, CAST(count_if(label = 0) AS BIGINT) AS docs0, CAST(count_if(label = 1) AS BIGINT) AS docs1
         FROM train GROUP BY ALL),
words AS (SELECT subsample, CAST(sum(n0) AS BIGINT) AS words0, CAST(sum(n1) AS BIGINT) AS words1, count(*) AS vocab
          FROM model GROUP BY ALL),
classes AS (SELECT d.subsample, d.docs0, d.docs1, coalesce(w.words0, 0) AS words0, coalesce(w.words1, 0) AS words1,
                   coalesce(w.vocab, 0) AS vocab FROM docs d LEFT JOIN words w ON d.subsample = w.subsample)
"""

SQL_NB_MODEL = "WITH " + _SQL_NB_CTE + "SELECT subsample, docs0, docs1, words0, words1, vocab FROM classes"

_SQL_PRED_CTE = _SQL_NB_CTE + """,
tc AS (SELECT t.doc_id, k.token, count(*) AS cnt FROM test t JOIN toks k ON t.doc_id = k.doc_id GROUP BY ALL),
sc AS (SELECT m.subsample, tc.doc_id, sum(cnt * ln(n0 + 1.0)) AS l0, sum(cnt * ln(n1 + 1.0)) AS l1, sum(cnt) AS mm
       FROM tc JOIN model m ON tc.token = m.token GROUP BY ALL),
pairs AS (SELECT c.*, t.doc_id, t.label FROM classes c CROSS JOIN test t),
j AS (SELECT p.*, coalesce(sc.l0, 0.0) AS l0, coalesce(sc.l1, 0.0) AS l1, coalesce(sc.mm, 0) AS mm
      FROM pairs p LEFT JOIN sc ON p.subsample = sc.subsample AND p.doc_id = sc.doc_id),
scores AS (SELECT subsample, doc_id, label,
    CASE WHEN docs0 > 0 THEN ln(docs0 / (docs0 + docs1)) + l0 - mm * ln(words0 + vocab) END AS score0,
    CASE WHEN docs1 > 0 THEN ln(docs1 / (docs0 + docs1)) + l1 - mm * ln(words1 + vocab) END AS score1 FROM j),
pred AS (SELECT subsample, doc_id, label,
    CASE WHEN score1 IS NULL THEN 0 WHEN score0 IS NULL THEN 1 WHEN score1 > score0 THEN 1 ELSE 0 END AS pred
    FROM scores)
"""


def q_nb_predict(spark, sf_dir):
    """Predicted label of every test doc under every subsample's model."""
    p, _ = nb_predictions(spark, sf_dir)
    return p.select("subsample", "doc_id", "label", "pred")


SQL_NB_PREDICT = "WITH " + _SQL_PRED_CTE + "SELECT subsample, doc_id, label, pred FROM pred"


def q_sweep_metrics(spark, sf_dir):
    """A9 + A10: confusion counts and the five metrics per subsample."""
    p, _ = nb_predictions(spark, sf_dir)
    m = stats.binary_metrics(p, ["subsample"])
    return m.select("subsample", "tp", "fp", "fn", "tn",
                    *[R6(c).alias(c) for c in ("mcc", "f1", "precision", "recall", "roc_auc", "accuracy")])


SQL_SWEEP_METRICS = "WITH " + _SQL_PRED_CTE + """,
cf AS (SELECT subsample, CAST(count_if(label = 1 AND pred = 1) AS BIGINT) AS tp,
              CAST(count_if(label = 0 AND pred = 1) AS BIGINT) AS fp,
              CAST(count_if(label = 1 AND pred = 0) AS BIGINT) AS fn,
              CAST(count_if(label = 0 AND pred = 0) AS BIGINT) AS tn FROM pred GROUP BY ALL),
d AS (SELECT *, CAST(tp AS DOUBLE) AS tpd, CAST(fp AS DOUBLE) AS fpd, CAST(fn AS DOUBLE) AS fnd, CAST(tn AS DOUBLE) AS tnd FROM cf)
SELECT subsample, tp, fp, fn, tn,
  round(CASE WHEN sqrt(tpd + fpd) * sqrt(tpd + fnd) * sqrt(tnd + fpd) * sqrt(tnd + fnd) > 0
             THEN (tpd * tnd - fpd * fnd) / (sqrt(tpd + fpd) * sqrt(tpd + fnd) * sqrt(tnd + fpd) * sqrt(tnd + fnd))
             ELSE 0.0 END, 6) AS mcc,
  round(CASE WHEN 2 * tpd + fpd + fnd > 0 THEN 2 * tpd / (2 * tpd + fpd + fnd) ELSE 0.0 END, 6) AS f1,
  round(CASE WHEN tpd + fpd > 0 THEN tpd / (tpd + fpd) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tpd + fnd > 0 THEN tpd / (tpd + fnd) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tpd + fnd > 0 AND tnd + fpd > 0 THEN (tpd / (tpd + fnd) + tnd / (tnd + fpd)) / 2 END, 6) AS roc_auc,
  round((tpd + tnd) / (tpd + fpd + fnd + tnd), 6) AS accuracy
FROM d
"""


def source_members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(members, test) of the 36 source subsamples: train and test rows are apart."""
    sp = split(spark, sf_dir)
    test = cut_lineage(sp.where("is_test").select("doc_id", "label"))
    # rows without a label are dropped before sampling, so every subsample trains and is scored on the same rows
    pool = rated_pool(spark, sf_dir).where(F.col("label").isNotNull()).join(test.select("doc_id"), "doc_id", "left_anti")
    members, _ = sampling.create_subsets(pool, n_total=N, seed=SEED)
    return cut_lineage(members.select("subsample", "alpha", "doc_id", "label", "reliability", "bias")), test


def sweep_results(spark, sf_dir) -> DataFrame:
    """T1 -> T2 -> A10 -> J4 over all 36 source subsamples (sweep result table)."""
    members, test = source_members(spark, sf_dir)
    scores = diversity.score_table(diversity.vendi_features(members, ["subsample"]))
    train = members.select("subsample", "doc_id", "label")
    toks = fx.doc_texts(spark, sf_dir)
    model, _ = sweep.train_nb(train, toks)
    model = cut_lineage(model)
    classes = sweep.class_table(train, model)  # both inputs are materialised; a cheap aggregate
    pred = sweep.predict_nb(model, classes, test, toks)
    m = stats.binary_metrics(pred, ["subsample"])
    res = joins.attach(m, scores, ["subsample"])
    return res.select(F.lit("documents").alias("dataset"), F.lit("source").alias("dimension"), "subsample",
                      "alpha", *[R6(c).alias(c) for c in ("mcc", "f1", "precision", "recall", "roc_auc")],
                      "vs", "normalized_vs")


def q_sweep_logistic(spark, sf_dir):
    """T1 -> T2 -> A10 -> J4 with logistic models that stop early, over all 36 source subsamples."""
    members, test = source_members(spark, sf_dir)
    scores = diversity.score_table(diversity.vendi_features(members, ["subsample"]))
    toks = fx.doc_texts(spark, sf_dir)
    every = members.select("doc_id").unionByName(test.select("doc_id"))
    vectors = cut_lineage(logistic.text_vectors(every, toks))    # read by the fit and by the predictions
    model, history = logistic.train_logistic(members.select("subsample", "doc_id", "label"), vectors)
    m = stats.binary_metrics(logistic.predict_logistic(model, test, vectors), ["subsample"])
    res = joins.attach(m, scores, ["subsample"]).join(history, "subsample")
    return res.select("subsample", "alpha", F.lit("logistic").alias("model"),
                      *[R6(c).alias(c) for c in ("mcc", "f1", "precision", "recall", "roc_auc")],
                      "vs", "normalized_vs", "rounds", "best_round", R6("valid_loss").alias("valid_loss"), "n_train", "n_valid")


def q_sweep_results(spark, sf_dir):
    return sweep_results(spark, sf_dir)


def q_sweep_analysis(spark, sf_dir):
    """A12-A15 on the sweep: MCC against vs (correlations, OLS, ANOVA low vs high)."""
    r = cut_lineage(sweep_results(spark, sf_dir))  # 36 rows, read by four analyses
    keys = ["dataset", "dimension"]
    o = stats.ols(r, "mcc", "vs", keys).select(*keys, R6("slope").alias("slope"), R6("r2").alias("r2"),
                                               R6("p").alias("slope_p"))
    p = stats.pearson(r, "vs", "mcc", keys).select(*keys, R6("r").alias("pearson_r"), R6("p").alias("pearson_p"))
    s = stats.spearman(r, "vs", "mcc", keys).select(*keys, R6("rho").alias("spearman_rho"),
                                                    R6("p").alias("spearman_p"))
    from varietas.functions.text import bin_edges
    g = stats.with_min_max(r, "vs", keys, "_scaled").withColumn("group", bin_edges("_scaled"))
    a = stats.anova(g, "mcc", "group", keys, groups=["low", "high"]).select(
        *keys, R6("f").alias("anova_f"), R6("p").alias("anova_p"))
    return o.join(p, keys).join(s, keys).join(a, keys, "left")


QUERIES = {
    "stratified_split": q_stratified_split,
    "nb_model": q_nb_model,
    "nb_predict": q_nb_predict,
    "sweep_metrics": q_sweep_metrics,
    "sweep_results": q_sweep_results,
    "sweep_logistic": q_sweep_logistic,
    "sweep_analysis": q_sweep_analysis,
}

ORACLE = {
    "stratified_split": SQL_STRATIFIED_SPLIT,
    "nb_model": SQL_NB_MODEL,
    "nb_predict": SQL_NB_PREDICT,
    "sweep_metrics": SQL_SWEEP_METRICS,
}
