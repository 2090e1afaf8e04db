"""Topics: c-TF-IDF, centred topic cosine, top words, outlier reassignment,
labels, c_v coherence, k-means topics and 2-D projection (X1-X3, X5-X8, X10, O2).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from varietas.operators.diversity import gram_partials
from varietas.session import cut_lineage

#: Copies of a topic's row over which documents are dealt, and topic words up to which they are broadcast.
SALTS, BROADCAST_WORDS = 8, 100_000


def term_counts(doc_tokens: DataFrame, doc_topic: DataFrame, topic: str = "topic_nr",
                tokens: str = "tokens", ngram_max: int = 1, stop_words: DataFrame | None = None) -> DataFrame:
    """(topic, term, tf): term counts per topic over whole texts (NULL topics dropped).

    ``doc_tokens`` holds (doc_id, tokens) or (doc_id, text); texts are joined to
    the topic table first and only documents with a topic are tokenized.
    """
    t = doc_tokens.join(doc_topic.where(F.col(topic).isNotNull()), "doc_id")
    if tokens not in doc_tokens.columns:
        from varietas.functions.text import tokenize
        t = t.withColumn(tokens, tokenize("text"))
    if stop_words is not None:
        # stop words leave before n-grams are formed; the list is one bounded row
        sw = stop_words.agg(F.collect_set("word").alias("_sw"))
        t = t.crossJoin(F.broadcast(sw)).withColumn(
            tokens, F.filter(tokens, lambda w: ~F.array_contains(F.col("_sw"), w))).drop("_sw")
    if ngram_max > 1:
        from varietas.functions.text import ngrams
        t = t.withColumn(tokens, ngrams(tokens, ngram_max))
    # explode_outer + null filter: an inner explode makes the optimizer infer
    # size(tokens) > 0 and push that second tokenization down to the scan
    return (t.select(topic, F.explode_outer(tokens).alias("term")).where(F.col("term").isNotNull())
            .groupBy(topic, "term").agg(F.count("*").alias("tf")))


def c_tf_idf(counts: DataFrame, topic: str = "topic_nr") -> DataFrame:
    """weight = (tf / sum_t tf) * ln(1 + A / f_term).

    A = integer part of the mean number of words per topic; f_term = the term's
    count over all topics.  Three aggregates, no pivot.
    """
    counts = cut_lineage(counts)  # read by three aggregates below
    per_topic = counts.groupBy(topic).agg(F.sum("tf").alias("_words"))
    avg_words = per_topic.agg(F.floor(F.avg("_words")).alias("_A"))
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("_f"))
    w = (counts.join(per_topic, topic).join(per_term, "term").crossJoin(F.broadcast(avg_words))
         .withColumn("weight", (F.col("tf") / F.col("_words")) * F.log(F.col("_A") / F.col("_f") + 1.0)))
    return w.select(topic, "term", "tf", "weight")


def top_words(topic_term: DataFrame, k: int = 10, topic: str = "topic_nr") -> DataFrame:
    """O2: the k terms of highest weight per topic (ties by term)."""
    w = Window.partitionBy(topic).orderBy(F.desc("weight"), "term")
    return topic_term.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_gram(topic_term: DataFrame, topic: str = "topic_nr") -> DataFrame:
    """Topic x topic inner products of c-TF-IDF rows: (i, j, g) over topic indexes.

    Each term becomes one dense vector over the T topics; every map task sums
    the outer products of the terms it holds (Gram partials), Spark adds them.
    No pair of topics is formed per term.
    """
    topic_term = cut_lineage(topic_term.select(topic, "term", "weight"))
    idx = topic_term.select(topic).distinct().withColumn(
        "_ti", (F.dense_rank().over(Window.orderBy(topic)) - 1).cast("int"))
    n_t = idx.agg(F.count("*").alias("_T"))
    tt = topic_term.join(F.broadcast(idx), topic)
    per_term = tt.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("_ti", "weight"))).alias("_m"))
    per_term = per_term.crossJoin(F.broadcast(n_t)).withColumn(
        "_u", F.transform(F.sequence(F.lit(0), F.col("_T") - 1),
                          lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))))
    g = gram_partials(per_term.select("_u"), keys=[]).groupBy("i", "j").agg(F.sum("g").alias("g"))
    g = g.where(F.col("i") >= 0)
    g = cut_lineage(g)  # T x T numbers, reused several times below
    sym = g.unionByName(g.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    a = idx.select(F.col("_ti").alias("i"), F.col(topic).alias("topic_i"))
    b = idx.select(F.col("_ti").alias("j"), F.col(topic).alias("topic_j"))
    return cut_lineage(sym.join(F.broadcast(a), "i").join(F.broadcast(b), "j"))


def centred_cosine(gram: DataFrame) -> DataFrame:
    """Cosine of mean-centred topic rows from the Gram matrix (double centring).

    Full-rank PCA after centring is a rotation, so this equals the cosine of
    the PCA-transformed rows.
    """
    rows = gram.groupBy("topic_i").agg(F.avg("g").alias("_ra"))
    cols = rows.select(F.col("topic_i").alias("topic_j"), F.col("_ra").alias("_rb"))
    grand = gram.agg(F.avg("g").alias("_gm"))
    c = (gram.join(rows, "topic_i").join(cols, "topic_j").crossJoin(F.broadcast(grand))
         .withColumn("c", F.col("g") - F.col("_ra") - F.col("_rb") + F.col("_gm")))
    diag = c.where(F.col("topic_i") == F.col("topic_j")).select("topic_i", F.col("c").alias("_cd"))
    c = (c.join(diag.select(F.col("topic_i"), F.col("_cd").alias("_ci")), "topic_i")
         .join(diag.select(F.col("topic_i").alias("topic_j"), F.col("_cd").alias("_cj")), "topic_j"))
    den = F.sqrt(F.col("_ci")) * F.sqrt(F.col("_cj"))
    return c.select("topic_i", "topic_j", F.when(den > 0, F.col("c") / den).otherwise(F.lit(0.0)).alias("cosine"))


def reassign_outliers(doc_topic_weights: DataFrame, threshold: float = 0.05, topic: str = "topic_nr") -> DataFrame:
    """An outlier (-1) takes its most likely topic when that weight >= threshold.

    ``doc_topic_weights``: (doc_id, topic_nr, candidate, weight) one row per
    candidate topic; of equal weights the smallest candidate counts.
    """
    best = doc_topic_weights.groupBy("doc_id", topic).agg(
        F.min_by("candidate", F.struct(-F.col("weight"), "candidate")).alias("_best"), F.max("weight").alias("_w"))
    new = F.when((F.col(topic) == -1) & (F.col("_w") >= threshold), F.col("_best")).otherwise(F.col(topic))
    return best.select("doc_id", F.col(topic).alias(f"{topic}_orig"), new.alias(topic))


def label_topics(topic_term: DataFrame, labels: DataFrame | None = None, k: int = 4,
                 topic: str = "topic_nr") -> DataFrame:
    """Name per topic: the given label, else '<nr>_<top words>'; -1 -> NULL."""
    tw = top_words(topic_term, k, topic)
    names = tw.groupBy(topic).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), "_").alias("_words"))
    default = F.concat_ws("_", F.col(topic).cast("string"), F.col("_words"))
    out = names.withColumn("topic", default)
    if labels is not None:
        from varietas.functions.text import first_line
        out = out.join(labels.select(topic, first_line("label").alias("_lab")), topic, "left") \
                 .withColumn("topic", F.coalesce("_lab", "topic"))
    return out.select(topic, F.when(F.col(topic) == -1, F.lit(None)).otherwise(F.col("topic")).alias("topic"))


def representative_docs(doc_texts: DataFrame, doc_topic: DataFrame, topic_term: DataFrame, k: int = 3,
                        topic: str = "topic_nr", id_col: str = "doc_id") -> DataFrame:
    """(topic, rank, id, similarity), the ``k`` documents of each topic nearest to its c-TF-IDF row.

    A document's vector has its term counts times the terms' idf, and similarity is the cosine with the topic's row of
    ``topic_term`` (:func:`c_tf_idf`), to nine digits; ties go to the smallest id.  A document of a topic has only terms of its row, so one
    sparse join on (topic, term) gives product and norm.  Topics' rows are ``SALTS`` times in the join, so that
    a large topic's frequent term is not one task's; the top k is taken before the shuffle.
    """
    from varietas.functions.text import tokenize
    rows = doc_texts.join(doc_topic.where(F.col(topic).isNotNull()).select(id_col, topic), id_col)
    counts = (rows.select(id_col, topic, F.explode_outer(tokenize("text")).alias("term")).where(F.col("term").isNotNull())
              .groupBy(id_col, topic, "term").agg(F.count("*").alias("n")))
    # weight = tf / words * idf, and the topic's words do not change a cosine: idf ~ weight / tf
    terms = topic_term.select(topic, "term", "weight", (F.col("weight") / F.col("tf")).alias("_idf"))
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = counts.withColumn("_salt", F.pmod(F.hash(id_col), F.lit(SALTS))).join(salted, [topic, "term", "_salt"])
    x = F.col("n") * F.col("_idf")
    docs = met.groupBy(topic, id_col).agg(F.sum(x * F.col("weight")).alias("_dot"), F.sum(x * x).alias("_own"))
    norms = topic_term.groupBy(topic).agg(F.sum(F.col("weight") * F.col("weight")).alias("_norm"))
    cos = F.col("_dot") / F.sqrt(F.col("_own") * F.col("_norm"))
    sim = docs.join(norms, topic).select(topic, id_col, F.round(F.when((F.col("_own") > 0) & (F.col("_norm") > 0), cos)
                                                                .otherwise(0.0), 9).alias("similarity"))
    order = Window.partitionBy(topic).orderBy(F.desc("similarity"), id_col)
    return sim.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(topic, "rank", id_col, "similarity")


# --------------------------------------------------------------------------- X8
def window_cooccurrence(doc_tokens: DataFrame, relevant: DataFrame, window: int = 110,
                        tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Boolean sliding-window counts for the relevant words.

    Returns (pair_counts (i, j, c) with i <= j and the diagonal holding the
    word's own window count, n_windows).  A text shorter than the window is one
    window; texts without any relevant word are skipped.  Each document's windows
    are counted in its own task with prefix sums; Spark adds the counts.
    """
    rel = cut_lineage(relevant.select("word", F.col("idx").cast("int").alias("idx")))
    few = rel.count() <= BROADCAST_WORDS
    pos = doc_tokens.select("doc_id", F.size(tokens).alias("_len"), F.posexplode_outer(tokens).alias("_p", "word")) \
        .where(F.col("word").isNotNull())
    hits = pos.join(F.broadcast(rel) if few else rel, "word")
    per_doc = hits.groupBy("doc_id", "_len").agg(F.collect_list(F.struct("_p", "idx")).alias("_hits"))
    schema = StructType([StructField("i", IntegerType()), StructField("j", IntegerType()),
                         StructField("c", LongType())])

    def count(batches):
        for pdf in batches:
            out_i, out_j, out_c = [], [], []
            nwin_total = 0
            for length, hl in zip(pdf["_len"].to_numpy(), pdf["_hits"].to_numpy()):
                nwin = max(1, int(length) - window + 1)
                nwin_total += nwin
                p = np.array([h["_p"] for h in hl], dtype=np.int64)
                w = np.array([h["idx"] for h in hl], dtype=np.int64)
                words = np.unique(w)
                cover = np.zeros((nwin + 1, len(words)), dtype=np.int32)
                col = np.searchsorted(words, w)
                lo = np.clip(p - window + 1, 0, nwin - 1)
                hi = np.clip(p, 0, nwin - 1)
                np.add.at(cover, (lo, col), 1)
                np.add.at(cover, (hi + 1, col), -1)
                m = (np.cumsum(cover[:-1], axis=0) > 0).astype(np.float64)
                co = m.T @ m
                iu, ju = np.triu_indices(len(words))
                vals = co[iu, ju]
                nz = vals > 0
                out_i.append(words[iu[nz]])
                out_j.append(words[ju[nz]])
                out_c.append(vals[nz].astype(np.int64))
            frame = pd.DataFrame({
                "i": np.concatenate(out_i + [np.array([-1])]).astype(np.int32),
                "j": np.concatenate(out_j + [np.array([-1])]).astype(np.int32),
                "c": np.concatenate(out_c + [np.array([nwin_total])]).astype(np.int64)})
            yield frame

    raw = cut_lineage(per_doc.mapInPandas(count, schema).groupBy("i", "j").agg(F.sum("c").alias("c")))
    n_windows = raw.where(F.col("i") == -1).select(F.col("c").alias("n_windows"))
    return raw.where(F.col("i") >= 0), n_windows


def mean_coherence(coherence: DataFrame, topic: str = "topic_nr") -> DataFrame:
    """The arithmetic mean of the topics' coherence, and their number."""
    return coherence.agg(F.avg("coherence").alias("coherence"), F.count("coherence").alias("n_topics"))


def coherence_cv(doc_tokens: DataFrame, topic_words: DataFrame, window: int = 110,
                 topic: str = "topic_nr", eps: float = 1e-12) -> DataFrame:
    """c_v coherence per topic (Roeder et al. 2015).

    Boolean sliding window probabilities, NPMI, indirect cosine of each top
    word's context vector against the whole set's, arithmetic mean.
    ``topic_words``: (topic, word) for the topics' top words (outlier excluded).
    """
    words = topic_words.select("word").distinct().withColumn(
        "idx", (F.dense_rank().over(Window.orderBy("word")) - 1).cast("int"))
    pairs, nwin = window_cooccurrence(doc_tokens, words, window)
    sym = pairs.unionByName(pairs.where(F.col("i") != F.col("j")).select(
        F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    occ = pairs.where(F.col("i") == F.col("j")).select(F.col("i").alias("_w"), F.col("c").alias("_o"))
    tw = topic_words.join(F.broadcast(words), "word").select(topic, "idx")
    a = tw.select(topic, F.col("idx").alias("i"))
    b = tw.select(topic, F.col("idx").alias("j"))
    grid = a.join(b, topic)   # k x k per topic, k = number of top words (bounded)
    g = (grid.join(sym, ["i", "j"], "left").fillna({"c": 0})
         .join(occ.select(F.col("_w").alias("i"), F.col("_o").alias("_oi")), "i", "left")
         .join(occ.select(F.col("_w").alias("j"), F.col("_o").alias("_oj")), "j", "left")
         .crossJoin(F.broadcast(nwin)).fillna({"_oi": 0, "_oj": 0}))
    pij = F.col("c") / F.col("n_windows")
    pi = F.col("_oi") / F.col("n_windows")
    pj = F.col("_oj") / F.col("n_windows")
    npmi = F.log((pij + eps) / (pi * pj)) / (-F.log(pij + eps))
    g = g.withColumn("npmi", npmi)
    # context vector of the whole set: V_j = sum_i npmi(i, j)
    setv = g.groupBy(topic, "j").agg(F.sum("npmi").alias("_V"))
    g = g.join(setv, [topic, "j"])
    seg = g.groupBy(topic, "i").agg(
        (F.sum(F.col("npmi") * F.col("_V")) /
         (F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))) * F.sqrt(F.sum(F.col("_V") * F.col("_V"))))).alias("_cos"))
    return seg.groupBy(topic).agg(F.avg("_cos").alias("coherence"))


# --------------------------------------------------------------------------- X5 / X10
def assign_topics(emb: DataFrame, k: int = 10, min_size: int = 25, seed: int = 42,
                  vec: str = "embedding", with_weights: bool = False) -> DataFrame:
    """X5 (re-aimed): k-means topics on the vectors; clusters smaller than
    ``min_size`` become -1 (outliers); membership = softmax of -distance.

    Stands in for density clustering on a 2-D manifold; cluster shapes differ.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = emb.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="_c").fit(x)
    centers = model.clusterCenters()
    cen = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    pred = model.transform(x).withColumn("_xs", vector_to_array("_f"))
    dists = F.transform(cen, lambda c: F.sqrt(F.aggregate(
        F.zip_with(c, F.col("_xs"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    pred = pred.withColumn("_d", dists)
    m = F.array_min("_d")
    ex = F.transform("_d", lambda d: F.exp(m - d))
    pred = pred.withColumn("_ex", ex)
    total = F.aggregate("_ex", F.lit(0.0), lambda s, v: s + v)
    pred = pred.withColumn("membership", F.element_at("_ex", F.col("_c") + 1) / total)
    sizes = pred.groupBy("_c").agg(F.count("*").alias("_size"))  # k rows
    pred = pred.join(F.broadcast(sizes), "_c")
    cols = ["doc_id", F.when(F.col("_size") >= min_size, F.col("_c")).otherwise(F.lit(-1)).alias("topic_nr"),
            "membership"]
    if with_weights:
        # one weight per candidate topic (softmax of -distance), for X6
        cols.append(F.transform("_ex", lambda e: e / total).alias("weights"))
    return pred.select(*cols)


def project_2d(emb: DataFrame, vec: str = "embedding") -> DataFrame:
    """X10 (re-aimed): two coordinates per row by PCA on centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = emb.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_f", outputCol="_c").fit(x).transform(x)
    out = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    arr = vector_to_array("_p")
    return out.select("doc_id", arr[0].alias("x"), arr[1].alias("y"))
