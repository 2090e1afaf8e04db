"""Registered queries for topics (X1-X3, X5, X7, X8, X10, O2, V6) and the
topic-dimension subsamples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varietas.operators import density, diversity, neighbours, sampling, topics
from varietas.session import cut_lineage
from varietas.sources import fixtures as fx

R6 = lambda c: F.round(c, 6)
SEED = 42


def topic_term(spark, sf_dir):
    return topics.c_tf_idf(topics.term_counts(fx.doc_texts(spark, sf_dir), fx.doc_topic(spark, sf_dir)))


_SQL_CTFIDF_CTE = r"""
toks AS (SELECT e.label AS topic_nr, unnest(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}')) AS term
         FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.label IS NOT NULL),
tf AS (SELECT topic_nr, term, count(*) AS tf FROM toks GROUP BY ALL),
pt AS (SELECT topic_nr, CAST(sum(tf) AS BIGINT) AS words FROM tf GROUP BY ALL),
aa AS (SELECT floor(avg(words)) AS a FROM pt),
pf AS (SELECT term, CAST(sum(tf) AS BIGINT) AS f FROM tf GROUP BY ALL),
w AS (SELECT tf.topic_nr, tf.term, tf.tf, (tf.tf / pt.words) * ln(aa.a / pf.f + 1.0) AS weight
      FROM tf JOIN pt ON tf.topic_nr = pt.topic_nr JOIN pf ON tf.term = pf.term CROSS JOIN aa)
"""


def q_c_tf_idf(spark, sf_dir):
    return topic_term(spark, sf_dir).select("topic_nr", "term", "tf", R6("weight").alias("weight"))


SQL_C_TF_IDF = "WITH " + _SQL_CTFIDF_CTE + "SELECT topic_nr, term, tf, round(weight, 6) AS weight FROM w"


def q_top_words(spark, sf_dir):
    tw = topics.top_words(topic_term(spark, sf_dir), k=10)
    return tw.select("topic_nr", "rank", "term", R6("weight").alias("weight"))


SQL_TOP_WORDS = "WITH " + _SQL_CTFIDF_CTE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY topic_nr ORDER BY weight DESC, term) AS rank FROM w)
SELECT topic_nr, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 10
"""


def q_topic_labels(spark, sf_dir):
    """Default names '<nr>_<top 4 words>'."""
    return topics.label_topics(topic_term(spark, sf_dir), k=4)


SQL_TOPIC_LABELS = "WITH " + _SQL_CTFIDF_CTE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY topic_nr ORDER BY weight DESC, term) AS rank FROM w)
SELECT topic_nr, CASE WHEN topic_nr = -1 THEN NULL
       ELSE CAST(topic_nr AS VARCHAR) || '_' || string_agg(term, '_' ORDER BY rank) END AS topic
FROM r WHERE rank <= 4 GROUP BY topic_nr
"""


def topic_cosine(spark, sf_dir):
    return topics.centred_cosine(topics.topic_gram(topic_term(spark, sf_dir)))


def q_centred_topic_cosine(spark, sf_dir):
    return topic_cosine(spark, sf_dir).select("topic_i", "topic_j", R6("cosine").alias("cosine"))


SQL_CENTRED_TOPIC_COSINE = "WITH " + _SQL_CTFIDF_CTE + """,
g AS (SELECT a.topic_nr AS topic_i, b.topic_nr AS topic_j, sum(a.weight * b.weight) AS g
      FROM w a JOIN w b ON a.term = b.term GROUP BY ALL),
ra AS (SELECT topic_i, avg(g) AS ra FROM g GROUP BY ALL),
gm AS (SELECT avg(g) AS gm FROM g),
c AS (SELECT g.topic_i, g.topic_j, g.g - x.ra - y.ra + gm.gm AS c
      FROM g JOIN ra x ON g.topic_i = x.topic_i JOIN ra y ON g.topic_j = y.topic_i CROSS JOIN gm),
d AS (SELECT topic_i, c AS cd FROM c WHERE topic_i = topic_j)
SELECT c.topic_i, c.topic_j,
       round(CASE WHEN sqrt(di.cd) * sqrt(dj.cd) > 0 THEN c.c / (sqrt(di.cd) * sqrt(dj.cd)) ELSE 0.0 END, 6) AS cosine
FROM c JOIN d di ON c.topic_i = di.topic_i JOIN d dj ON c.topic_j = dj.topic_i
"""


def q_topic_kernel_vendi(spark, sf_dir):
    """V6: Vendi score of the topic set itself (one row per topic)."""
    k = topic_cosine(spark, sf_dir).select(F.col("topic_i").alias("item_i"), F.col("topic_j").alias("item_j"),
                                             F.col("cosine").alias("k"))
    w = k.select(F.col("item_i").alias("topic_nr")).distinct().withColumn("cnt", F.lit(1)) \
         .withColumn("subsample", F.lit("topics"))
    return diversity.vendi_kernel_weights(w, k, ["subsample"]).select("subsample", R6("vs").alias("vs"), "n")


def _with_outliers(spark, sf_dir):
    """doc_topic with -1 for documents without a topic."""
    return fx.doc_topic(spark, sf_dir).withColumn("topic_nr", F.coalesce("topic_nr", F.lit(-1)))


def topic_members(spark, sf_dir):
    """D6 on the topic dimension; documents without a topic (-1) are a category of the uniform draws only."""
    pool = _with_outliers(spark, sf_dir)
    pool = pool.withColumn("category", F.when(F.col("topic_nr") >= 0, F.col("topic_nr").cast("string")))
    return sampling.create_subsets(pool, seed=SEED)[0]


def _kernel_with_outliers(spark, sf_dir):
    """Centred cosine kernel (item_i, item_j, k) of all topics, the vector of -1 being that of the documents left over."""
    terms = topics.c_tf_idf(topics.term_counts(fx.doc_texts(spark, sf_dir), _with_outliers(spark, sf_dir)))
    return topics.centred_cosine(topics.topic_gram(terms)).select(
        F.col("topic_i").alias("item_i"), F.col("topic_j").alias("item_j"), F.col("cosine").alias("k"))


def q_topic_subsample_scores(spark, sf_dir):
    """D6 on the topic dimension: 36 subsamples scored with the centred topic kernel."""
    weights = topic_members(spark, sf_dir).groupBy("subsample", "topic_nr").agg(F.count("*").alias("cnt"))
    s = diversity.vendi_kernel_weights(weights, _kernel_with_outliers(spark, sf_dir), ["subsample"])
    return diversity.score_table(s)


def q_coherence_cv(spark, sf_dir):
    """c_v coherence of the top 10 words of every topic."""
    tw = topics.top_words(topic_term(spark, sf_dir), k=10).select("topic_nr", F.col("term").alias("word"))
    c = topics.coherence_cv(fx.doc_tokens(spark, sf_dir), tw)
    return c.select("topic_nr", R6("coherence").alias("coherence"))


def q_coherence_mean(spark, sf_dir):
    """Mean c_v coherence over the topics."""
    tw = topics.top_words(topic_term(spark, sf_dir), k=10).select("topic_nr", F.col("term").alias("word"))
    return topics.mean_coherence(topics.coherence_cv(fx.doc_tokens(spark, sf_dir), tw)).select(R6("coherence").alias("coherence"), "n_topics")


def q_topic_representatives(spark, sf_dir):
    """The three documents nearest to each topic's c-TF-IDF row."""
    r = topics.representative_docs(fx.doc_texts(spark, sf_dir), fx.doc_topic(spark, sf_dir), topic_term(spark, sf_dir), k=3)
    return r.select("topic_nr", "rank", "doc_id", R6("similarity").alias("similarity"))


SQL_TOPIC_REPRESENTATIVES = "WITH " + _SQL_CTFIDF_CTE + r""",
dt AS (SELECT e.label AS topic_nr, d.doc_id, unnest(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}')) AS term
       FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.label IS NOT NULL),
dc AS (SELECT topic_nr, doc_id, term, count(*) AS n FROM dt GROUP BY ALL),
idf AS (SELECT pf.term, ln(aa.a / pf.f + 1.0) AS idf FROM pf CROSS JOIN aa),
nrm AS (SELECT topic_nr, sum(weight * weight) AS s FROM w GROUP BY 1),
sim AS (SELECT dc.topic_nr, dc.doc_id, round(CASE WHEN sum(n * idf * n * idf) > 0 AND max(nrm.s) > 0
          THEN sum(n * idf * weight) / (sqrt(sum(n * idf * n * idf)) * sqrt(max(nrm.s))) ELSE 0.0 END, 9) AS similarity
        FROM dc JOIN idf USING (term) JOIN w ON w.topic_nr = dc.topic_nr AND w.term = dc.term JOIN nrm ON nrm.topic_nr = dc.topic_nr
        GROUP BY 1, 2)
SELECT topic_nr, CAST(row_number() OVER (PARTITION BY topic_nr ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank, doc_id,
       round(similarity, 6) AS similarity FROM sim QUALIFY rank <= 3
"""


def q_kmeans_topics(spark, sf_dir):
    """X5 (re-aimed): k-means topics with small clusters as outliers."""
    t = topics.assign_topics(fx.embedding(spark, sf_dir), k=10, min_size=25)
    return t.groupBy("topic_nr").agg(F.count("*").alias("n"), R6(F.avg("membership")).alias("mean_membership"))


def q_nearest_neighbours(spark, sf_dir):
    """The ten nearest other vectors of every vector, by cosine distance."""
    near = neighbours.knn(fx.embedding(spark, sf_dir), k=10)
    return near.select(F.col("id").alias("doc_id"), "neighbour", R6("dist").alias("dist"), "rank")


SQL_NEAREST_NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len
           FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS doc_id, b.vec_id AS neighbour,
             round(greatest(1.0 - CASE WHEN a.len * b.len > 0 THEN list_inner_product(a.e, b.e) / (a.len * b.len) ELSE 0.0 END, 0.0), 9) AS dist
      FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT doc_id, neighbour, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY dist, neighbour) AS INTEGER) AS rank
FROM p QUALIFY rank <= 10
"""


def q_density_topics(spark, sf_dir):
    """The density topic of every vector, -1 for outliers, and its membership."""
    t = density.density_topics(fx.embedding(spark, sf_dir), min_size=25)
    return t.select("doc_id", "topic_nr", R6("membership").alias("membership"))


def q_density_reassigned(spark, sf_dir):
    """X5 + X6: outliers of the density topics take the topic with the largest share of their neighbours, if at least 0.05."""
    emb = fx.embedding(spark, sf_dir)
    near = cut_lineage(neighbours.knn(emb, k=15))
    t = cut_lineage(density.density_topics(emb, min_size=25, near=near))
    r = topics.reassign_outliers(density.neighbour_weights(near, t), threshold=0.05)
    return r.select("doc_id", "topic_nr_orig", "topic_nr")


def q_project_2d(spark, sf_dir):
    """X10 + A3: 2-D coordinates, then size and mean position per topic."""
    p = topics.project_2d(fx.embedding(spark, sf_dir)).join(fx.doc_topic(spark, sf_dir), "doc_id")
    prof = p.groupBy("topic_nr").agg(F.count("*").alias("size"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    return prof.select("topic_nr", "size", R6("mean_x").alias("mean_x"), R6("mean_y").alias("mean_y"),
                       R6(F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(1)))).alias("proportion"))


def q_reassigned_topics(spark, sf_dir):
    """X5 + X6: outliers of the k-means topics take their most likely topic
    when its weight >= 0.05 (rows-only)."""
    t = topics.assign_topics(fx.embedding(spark, sf_dir), k=10, min_size=60, with_weights=True)
    cand = t.select("doc_id", "topic_nr", F.posexplode("weights").alias("candidate", "weight"))
    r = topics.reassign_outliers(cand, threshold=0.05)
    return r.groupBy("topic_nr_orig", "topic_nr").agg(F.count("*").alias("n"))


def q_top_bigrams(spark, sf_dir):
    """X1 options + X2 + O2: 1..2-grams after removing stop words; stop words
    are the tokens found in at least half of all documents."""
    stop = fx.frequent_tokens(spark, sf_dir, min_df=0.5)
    counts = topics.term_counts(fx.doc_texts(spark, sf_dir), fx.doc_topic(spark, sf_dir), ngram_max=2,
                                stop_words=stop)
    tw = topics.top_words(topics.c_tf_idf(counts), k=10)
    return tw.select("topic_nr", "rank", "term", R6("weight").alias("weight"))


SQL_TOP_BIGRAMS = r"""
WITH ndocs AS (SELECT count(*) AS n FROM documents),
dtok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))) AS word FROM documents),
stop AS (SELECT word FROM dtok GROUP BY word HAVING count(*) >= 0.5 * (SELECT n FROM ndocs)),
sw AS (SELECT coalesce(list(word), []) AS sw FROM stop),
dt AS (SELECT e.label AS topic_nr,
              list_filter(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}'), lambda w: NOT list_contains(sw.sw, w)) AS t
       FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id CROSS JOIN sw WHERE e.label IS NOT NULL),
g AS (SELECT topic_nr, t || CASE WHEN len(t) >= 2
                               THEN list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])
                               ELSE [] END AS grams FROM dt),
toks AS (SELECT topic_nr, unnest(grams) AS term FROM g),
tf AS (SELECT topic_nr, term, count(*) AS tf FROM toks GROUP BY ALL),
pt AS (SELECT topic_nr, CAST(sum(tf) AS BIGINT) AS words FROM tf GROUP BY ALL),
aa AS (SELECT floor(avg(words)) AS a FROM pt),
pf AS (SELECT term, CAST(sum(tf) AS BIGINT) AS f FROM tf GROUP BY ALL),
w AS (SELECT tf.topic_nr, tf.term, (tf.tf / pt.words) * ln(aa.a / pf.f + 1.0) AS weight
      FROM tf JOIN pt ON tf.topic_nr = pt.topic_nr JOIN pf ON tf.term = pf.term CROSS JOIN aa),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_nr ORDER BY weight DESC, term) AS rank FROM w)
SELECT topic_nr, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 10
"""


def q_topic_kernel_vendi2(spark, sf_dir):
    """V6 at order 2, all topics and without the outlier topic: T^2 / sum k^2."""
    k = _kernel_with_outliers(spark, sf_dir)
    inner = k.where((F.col("item_i") >= 0) & (F.col("item_j") >= 0))
    sets = k.withColumn("topics", F.lit("all")).unionByName(inner.withColumn("topics", F.lit("without_outliers")))
    n = F.count_if(F.col("item_i") == F.col("item_j"))
    return sets.groupBy("topics").agg(n.alias("n"), R6(n * n / F.sum(F.col("k") * F.col("k"))).alias("vs2"))


_SQL_KERNEL_ALL_CTE = r"""
toks AS (SELECT coalesce(e.label, -1) AS topic_nr, unnest(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}')) AS term
         FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
tf AS (SELECT topic_nr, term, count(*) AS tf FROM toks GROUP BY ALL),
pt AS (SELECT topic_nr, CAST(sum(tf) AS BIGINT) AS words FROM tf GROUP BY ALL),
aa AS (SELECT floor(avg(words)) AS a FROM pt),
pf AS (SELECT term, CAST(sum(tf) AS BIGINT) AS f FROM tf GROUP BY ALL),
w AS (SELECT tf.topic_nr, tf.term, tf.tf, (tf.tf / pt.words) * ln(aa.a / pf.f + 1.0) AS weight
      FROM tf JOIN pt ON tf.topic_nr = pt.topic_nr JOIN pf ON tf.term = pf.term CROSS JOIN aa),
g AS (SELECT a.topic_nr AS topic_i, b.topic_nr AS topic_j, sum(a.weight * b.weight) AS g
      FROM w a JOIN w b ON a.term = b.term GROUP BY ALL),
ra AS (SELECT topic_i, avg(g) AS ra FROM g GROUP BY ALL),
gm AS (SELECT avg(g) AS gm FROM g),
c AS (SELECT g.topic_i, g.topic_j, g.g - x.ra - y.ra + gm.gm AS c
      FROM g JOIN ra x ON g.topic_i = x.topic_i JOIN ra y ON g.topic_j = y.topic_i CROSS JOIN gm),
dg AS (SELECT topic_i, c AS cd FROM c WHERE topic_i = topic_j),
ker AS (SELECT c.topic_i, c.topic_j, CASE WHEN sqrt(di.cd) * sqrt(dj.cd) > 0 THEN c.c / (sqrt(di.cd) * sqrt(dj.cd)) ELSE 0.0 END AS k
        FROM c JOIN dg di ON c.topic_i = di.topic_i JOIN dg dj ON c.topic_j = dj.topic_i)
"""

SQL_TOPIC_KERNEL_VENDI2 = "WITH " + _SQL_KERNEL_ALL_CTE + """
SELECT 'all' AS topics, count_if(topic_i = topic_j)::BIGINT AS n,
       round(count_if(topic_i = topic_j) * count_if(topic_i = topic_j) / sum(k * k), 6) AS vs2 FROM ker
UNION ALL
SELECT 'without_outliers', count_if(topic_i = topic_j)::BIGINT,
       round(count_if(topic_i = topic_j) * count_if(topic_i = topic_j) / sum(k * k), 6) FROM ker WHERE topic_i >= 0 AND topic_j >= 0
"""


QUERIES = {
    "coherence_mean": q_coherence_mean,
    "topic_representatives": q_topic_representatives,
    "topic_kernel_vendi2": q_topic_kernel_vendi2,
    "top_bigrams": q_top_bigrams,
    "reassigned_topics": q_reassigned_topics,
    "c_tf_idf": q_c_tf_idf,
    "top_words": q_top_words,
    "topic_labels": q_topic_labels,
    "centred_topic_cosine": q_centred_topic_cosine,
    "topic_kernel_vendi": q_topic_kernel_vendi,
    "topic_subsample_scores": q_topic_subsample_scores,
    "coherence_cv": q_coherence_cv,
    "kmeans_topics": q_kmeans_topics,
    "nearest_neighbours": q_nearest_neighbours,
    "density_topics": q_density_topics,
    "density_reassigned": q_density_reassigned,
    "project_2d": q_project_2d,
}

ORACLE = {
    "nearest_neighbours": SQL_NEAREST_NEIGHBOURS,
    "topic_representatives": SQL_TOPIC_REPRESENTATIVES,
    "topic_kernel_vendi2": SQL_TOPIC_KERNEL_VENDI2,
    "top_bigrams": SQL_TOP_BIGRAMS,
    "c_tf_idf": SQL_C_TF_IDF,
    "top_words": SQL_TOP_WORDS,
    "topic_labels": SQL_TOPIC_LABELS,
    "centred_topic_cosine": SQL_CENTRED_TOPIC_COSINE,
}


# Brute-force twin of X8: every occurrence of a top word is expanded into the
# sliding windows that contain it; window counts come from DISTINCT (doc, window).
SQL_COHERENCE_CV = "WITH " + _SQL_CTFIDF_CTE + r""",
r AS (SELECT *, row_number() OVER (PARTITION BY topic_nr ORDER BY weight DESC, term) AS rank FROM w),
tw AS (SELECT topic_nr, term AS word FROM r WHERE rank <= 10),
rel AS (SELECT DISTINCT word FROM tw),
dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ts FROM documents),
occ AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS word, generate_subscripts(ts, 1) - 1 AS p FROM dt),
hit AS (SELECT o.doc_id, o.l, o.word, o.p, greatest(o.l - 110 + 1, 1) AS nwin FROM occ o JOIN rel ON o.word = rel.word),
docs AS (SELECT DISTINCT doc_id, nwin FROM hit),
nw AS (SELECT sum(nwin) AS n_windows FROM docs),
win AS (SELECT DISTINCT doc_id, word, unnest(generate_series(greatest(p - 109, 0), least(p, nwin - 1))) AS s FROM hit),
oc AS (SELECT word, count(*) AS c FROM win GROUP BY word),
co AS (SELECT a.word AS wi, b.word AS wj, count(*) AS c FROM win a JOIN win b ON a.doc_id = b.doc_id AND a.s = b.s
       GROUP BY ALL),
grid AS (SELECT a.topic_nr, a.word AS wi, b.word AS wj FROM tw a JOIN tw b ON a.topic_nr = b.topic_nr),
g AS (SELECT grid.*, coalesce(co.c, 0) AS cij, coalesce(oi.c, 0) AS ci, coalesce(oj.c, 0) AS cj, nw.n_windows AS n
      FROM grid LEFT JOIN co ON grid.wi = co.wi AND grid.wj = co.wj
      LEFT JOIN oc oi ON grid.wi = oi.word LEFT JOIN oc oj ON grid.wj = oj.word CROSS JOIN nw),
np AS (SELECT topic_nr, wi, wj,
         ln((cij / n + 1e-12) / ((ci / n) * (cj / n))) / (-ln(cij / n + 1e-12)) AS npmi FROM g),
sv AS (SELECT topic_nr, wj, sum(npmi) AS v FROM np GROUP BY ALL),
seg AS (SELECT np.topic_nr, np.wi, sum(np.npmi * sv.v) / (sqrt(sum(np.npmi * np.npmi)) * sqrt(sum(sv.v * sv.v))) AS c
        FROM np JOIN sv ON np.topic_nr = sv.topic_nr AND np.wj = sv.wj GROUP BY ALL)
SELECT topic_nr, round(avg(c), 6) AS coherence FROM seg GROUP BY topic_nr
"""

SQL_COHERENCE_MEAN = "SELECT round(avg(c), 6) AS coherence, count(*) AS n_topics FROM (" + SQL_COHERENCE_CV.replace(
    "round(avg(c), 6) AS coherence", "avg(c) AS c") + ")"
ORACLE["coherence_mean"] = SQL_COHERENCE_MEAN


ORACLE["coherence_cv"] = SQL_COHERENCE_CV
