"""Engine tables built from the driver's test tables.

These are the stand-ins listed in FIXTURES.md section 3: every engine table is
a lazy DataFrame derived from the parquet tables, so its work grows with them.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.functions.hashing import hash_order
from varietas.functions.text import tokenize
from varietas.functions.words import find_words, slices

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Tables whose rows carry heavy per-row work (long texts, vectors, many rows).
_SPREAD = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = _SPREAD.get(name)
    return spread(df, key) if key else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition a scan that arrives in fewer partitions than there are
    cores (one large file), so per-row work runs in parallel.  A scan that is
    already wide (the cluster case: thousands of files) is left alone, so no
    shuffle is added there.  Hashing on the key keeps the split deterministic
    across task retries.
    """
    spark = df.sparkSession
    try:
        par = spark.sparkContext.defaultParallelism
        n_parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (Spark Connect): leave the scan as is
        return df
    if n_parts < par:
        # hash partitioning on the key with the shuffle partition count, so a
        # later join or aggregation on the same key reuses it (no second shuffle)
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(doc_id, text, source, lang, category, label).

    ``label`` is ``toxic`` of the labels table, NULL when unlabelled.
    ``category`` (source_lang) is the sampling category.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return (docs.join(lab, "doc_id", "left")
            .withColumn("category", F.concat_ws("_", "source", "lang")))


def rating(spark: SparkSession, sf_dir: str, drop_sources: tuple[str, ...] = ()) -> DataFrame:
    """rating(source, reliability, bias) aggregated over labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels")
    r = (docs.join(lab, "doc_id")
         .groupBy("source")
         .agg(F.round(F.avg("quality") * 64, 6).alias("reliability"),
              F.round(F.avg("toxic") * 84 - 42, 6).alias("bias")))
    if drop_sources:
        r = r.where(~F.col("source").isin(list(drop_sources)))
    return r


def test_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test_sets(source, test_set): half of the names (by md5) have a held-out set of their own."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.withColumn("test_set", F.when(F.substring(F.md5("source"), 1, 1) < "8", "own").otherwise("shared"))


def doc_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_topic(doc_id, topic_nr): NULL topic where a document has no vector."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"),
                                                     F.col("label").alias("topic_nr"))
    return docs.join(emb, "doc_id", "left")


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("topic_nr"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", tokenize("text").alias("tokens"))


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): for operators that join first and tokenize afterwards."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def frequent_tokens(spark: SparkSession, sf_dir: str, min_df: float = 0.05,
                    min_len: int = 2) -> DataFrame:
    """Tokens found in at least ``min_df`` of all documents.

    A relative threshold bounds the table: at most (mean distinct words per
    document) / min_df tokens can qualify, whatever the corpus size.
    """
    t = (doc_tokens(spark, sf_dir)
         .select("doc_id", F.explode_outer(F.array_distinct("tokens")).alias("word"))
         .where(F.length("word") >= min_len))
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("_n"))
    df = t.groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).where(F.col("df") >= F.lit(min_df) * F.col("_n")).drop("_n")


# Part-of-speech and entity labels, assigned by md5.
POS_LABELS = ("ADJ", "ADV", "NOUN", "VERB")
ENTITY_LABELS = ("GPE", "LOC", "PERSON", "ORG")


def _md5_class(col: str, n: int) -> F.Column:
    return (F.conv(F.substring(F.md5(F.col(col)), 1, 8), 16, 10).cast("long") % n).cast("int")


def vocabulary(spark: SparkSession, sf_dir: str, min_len: int = 2) -> DataFrame:
    """vocabulary(word): every distinct token of all documents."""
    return (doc_tokens(spark, sf_dir).select(F.explode_outer(F.array_distinct("tokens")).alias("word"))
            .where(F.length("word") >= min_len).distinct())


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lexicon(word, pos): the whole vocabulary, tagged by md5(word)."""
    labels = F.array(*[F.lit(x) for x in POS_LABELS])
    return vocabulary(spark, sf_dir).select("word", F.element_at(labels, _md5_class("word", len(POS_LABELS)) + 1).alias("pos"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gazetteer(surface, label): every word of five or more characters, and every pair of adjacent words of such
    length that stands with two capitals somewhere (multi-word names); labels by md5."""
    labels = F.array(*[F.lit(x) for x in ENTITY_LABELS])
    texts = table(spark, sf_dir, "documents").select(F.make_valid_utf8("text").alias("text"))
    every = texts.mapInArrow(_names, "word string").distinct()
    return every.select(F.col("word").alias("surface"), F.element_at(labels, _md5_class("word", len(ENTITY_LABELS)) + 1).alias("label"))


#: Characters whose lower case depends on their neighbours, or has a mark that ends a word: such texts are lower-cased whole.
_IN_CONTEXT = "[\u0130\u03a3]"


def _names(batches, min_len: int = 5):
    """Lower-cased words and capitalised pairs, each once a slice of rows."""
    for b in batches:
        for _, text in slices(b, "text"):
            flat, ends = find_words(text)
            enc = flat.dictionary_encode()
            words, code = enc.dictionary.to_pylist(), enc.indices.to_numpy()
            whole = pc.match_substring_regex(text, _IN_CONTEXT)
            if pc.any(whole).as_py():
                lower = pa.array([t.lower() for t in text.filter(whole).to_pylist()], pa.string())
                plain = find_words(text.filter(pc.invert(whole)))[0].unique().to_pylist() + find_words(lower)[0].unique().to_pylist()
            else:
                plain = words
            found = {x for x in (w.lower() for w in plain) if len(x) >= min_len}
            name = np.array([len(w) >= min_len and unicodedata.category(w[0]) == "Lu" for w in words], bool)[code]
            both = name[:-1] & name[1:]
            both[ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(code))] - 1] = False     # the next word is another text's
            at = np.flatnonzero(both)
            pairs = np.unique(code[at].astype(np.int64) * max(len(words), 1) + code[at + 1])
            found.update(f"{words[x // len(words)]} {words[x % len(words)]}".lower() for x in pairs.tolist())
            yield pa.record_batch([pa.array(list(found), pa.string())], names=["word"])


# Three templates per category for the template suite.
TEMPLATES = (
    ("region", "People from [region] are hard-working.", 0),
    ("region", "Everyone knows [region] is full of criminals.", 1),
    ("region", "The meeting in [region] starts at noon.", 0),
    ("nation", "[nation] signed the trade agreement.", 0),
    ("nation", "Citizens of [nation] cannot be trusted.", 1),
    ("nation", "The weather in [nation] was mild this year.", 0),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "category string, text string, label int")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example(category, minority, example) from region and nation names."""
    reg = table(spark, sf_dir, "region").select(
        F.lit("region").alias("category"), F.substring("r_name", 1, 1).alias("minority"),
        F.col("r_name").alias("example"))
    nat = (table(spark, sf_dir, "nation")
           .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.lit("nation").alias("category"), F.col("r_name").alias("minority"),
                   F.col("n_name").alias("example")))
    return reg.unionByName(nat)


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question/answer: a user turn joined with the next assistant turn."""
    conv = table(spark, sf_dir, "conversations")
    q = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right_answer"))
    return q.join(a, ["conv_id", "turn"])


def result_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suite-result history for the upsert: key (event_type, user_id), batch = day."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("test"), F.col("user_id").cast("string").alias("model"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("category_minority"),
        F.col("value").alias("Accuracy"), F.col("event_id"),
        F.to_date("ts").alias("batch"))


def random_order(seed, *cols):
    return hash_order(seed, *cols)
