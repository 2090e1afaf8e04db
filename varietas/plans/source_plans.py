"""Registered queries for the sources and sinks (S1, S2, S4-S7) and for small helpers.

A given table is written in the format under the shared folder, read back
through the operator and returned, so the result can be checked against the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from varietas.functions import text as T
from varietas.operators import joins, reshape
from varietas.plans.sampling_plans import _SQL_UNIFORM_MEMBERS_CTE, uniform_members_df
from varietas.session import ensure_checkpoint_dir
from varietas.sources import fixtures as fx
from varietas.sources import io

ARTICLES_PER_FILE = 1000


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/varietas-io/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- S1
def q_articles_scan(spark, sf_dir):
    """Conversations written as nested article files (turns are sentences, an assistant's turn is annotated as
    lexical bias) and scanned; counts per outlet and label."""
    c = fx.table(spark, sf_dir, "conversations")
    note = F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("Lexical").alias("bias")))).otherwise(
        F.array(F.struct(F.lit("Informational").alias("bias"))))
    body = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("sentence"), note.alias("annotations"))))
    code = F.element_at(F.array(*[F.lit(x) for x in ("NYT", "fox", "hpo")]), (F.col("conv_id") % 3).cast("int") + 1)
    arts = c.groupBy("conv_id").agg(body.alias("_b"), F.array_sort(F.collect_set("role")).alias("main-entities"))
    arts = arts.select("conv_id", F.struct(
        code.alias("source"), "main-entities", F.lit("2020-01-02").alias("date"),
        F.transform("_b", lambda b: F.struct(b["sentence"].alias("sentence"), b["turn"].cast("int").alias("sentence-index"),
                                             b["annotations"].alias("annotations"))).alias("body")).alias("a"))
    files = max(1, -(-arts.count() // ARTICLES_PER_FILE))
    path = _folder(spark, "articles")
    # a file holds one JSON value: an array of about ARTICLES_PER_FILE articles
    (arts.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(files)).alias("bucket"))
     .agg(F.to_json(F.collect_list("a")).alias("value")).write.partitionBy("bucket").text(path))
    sents, _ = io.scan_articles(spark, path)
    return sents.groupBy("source", "label", T.join_list("main_entities").alias("roles")).agg(
        F.count("*").alias("n"), F.sum("sentence_index").cast("long").alias("places"),
        F.sum(F.length("text")).cast("long").alias("chars"))


SQL_ARTICLES_SCAN = """
WITH a AS (SELECT *, ['the-new-york-times', 'fox-news', 'huffpost'][conv_id % 3 + 1] AS source,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
r AS (SELECT conv_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles FROM conversations GROUP BY 1)
SELECT source, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS label, roles, count(*) AS n,
       CAST(sum(pos) AS BIGINT) AS places, CAST(sum(length(text)) AS BIGINT) AS chars
FROM a JOIN r USING (conv_id) WHERE length(text) > 0 GROUP BY 1, 2, 3
"""


# --------------------------------------------------------------------------- S2, S6
def q_csv_round_trip(spark, sf_dir):
    """S6 + S2: documents written as CSV (texts with line breaks) and read with a declared schema."""
    path = _folder(spark, "csv")
    io.write_table(fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "csv")
    back = io.scan_csv(spark, path, "doc_id long, text string, lang string")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


SQL_CSV_ROUND_TRIP = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"


# --------------------------------------------------------------------------- S4
def q_keyed_folder(spark, sf_dir):
    """Files per source and language (a large pair has several), the keys only in the file names."""
    path, out = _folder(spark, "parts"), _folder(spark, "keyed")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    d.write.partitionBy("source", "lang").option("header", True).csv(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(out))
    for st in fs.globStatus(hadoop(f"{path}/source=*/lang=*/part-*.csv")):
        p = st.getPath()
        source, lang = (x.getName().split("=", 1)[1] for x in (p.getParent().getParent(), p.getParent()))
        part = p.getName().split("-")[1]      # every task writes a pair once, so the part makes the name unique
        if not fs.rename(p, hadoop(f"{out}/results_{source}_{lang}.{part}.csv")):
            raise OSError(f"could not rename {p.toString()}")
    keyed = io.scan_folder_keyed(spark, out, "doc_id long, n_chars long", key_regex=r"^[a-z]+_([a-z0-9]+)_([a-z]+)\.",
                                 keys=("source", "lang"))
    return keyed.select("doc_id", "n_chars", "source", "lang")


SQL_KEYED_FOLDER = "SELECT doc_id, n_chars, source, lang FROM documents"


# --------------------------------------------------------------------------- S5
def q_template_store(spark, sf_dir):
    """The example tables per category and the template table, written and read back, then expanded."""
    path = _folder(spark, "templates")
    io.write_template_store(fx.examples(spark, sf_dir), fx.templates(spark), path)
    example, template = io.scan_template_store(spark, path)
    return joins.expand_templates(template, example)


SQL_TEMPLATE_STORE = """
WITH ex AS (SELECT 'region' AS category, substr(r_name, 1, 1) AS minority, r_name AS example FROM region
            UNION ALL SELECT 'nation', r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
t(category, text, label) AS (VALUES """ + ", ".join(
    f"('{c}', '{t}', {x})" for c, t, x in fx.TEMPLATES) + """)
SELECT t.category, minority AS category_minority, replace(text, '[' || t.category || ']', example) AS text, label
FROM t JOIN ex ON t.category = ex.category
"""


# --------------------------------------------------------------------------- S7
def q_subsample_sink(spark, sf_dir):
    """Members and scores written partitioned; one subsample read back (partition pruning)."""
    path = _folder(spark, "subsamples")
    m = uniform_members_df(spark, sf_dir).select(F.lit("documents").alias("dataset"), F.lit("source").alias("dimension"),
                                                 "subsample", "category", "doc_id")
    scores = m.groupBy("dataset", "dimension", "subsample").agg(F.count("*").alias("n"))
    io.write_subsamples(m, scores, path)
    back = io.scan_parquet(spark, f"{path}/members").where(F.col("subsample") == "alpha_inf_idx_2")
    n = io.scan_parquet(spark, f"{path}/scores").select("subsample", "n")
    return back.join(n, "subsample").select("subsample", "category", F.col("doc_id").cast("long").alias("doc_id"), "n")


SQL_SUBSAMPLE_SINK = "WITH " + _SQL_UNIFORM_MEMBERS_CTE + """
SELECT subsample, category, doc_id, count(*) OVER () AS n FROM members WHERE subsample = 'alpha_inf_idx_2'
"""


# --------------------------------------------------------------------------- P7, F6, O4, R2
def q_last_lines(spark, sf_dir):
    """P7 + O4 keep-last + F6: the last line of every order, columns without their prefix, names with an outlier marker as NULL."""
    li = T.strip_column_prefix(fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_")
    last = joins.keep_last(li.withColumn("place", F.struct("linenumber", "partkey")), ["orderkey"], "place")
    name = F.concat((F.col("linenumber") - 2).cast("string"), F.lit("_topic"))
    return last.select("orderkey", "linenumber", "partkey", T.null_if_contains(name).alias("name"))


SQL_LAST_LINES = """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber - 2 AS VARCHAR) || '_topic' END AS name
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1
"""


def q_sentences(spark, sf_dir):
    """R2 + P4: a document's lines as an array, one row per line, flagged if any word of it is 'the'."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("body"))
    s = reshape.explode_sentences(d)
    flag = T.any_annotation(F.split("sentence", " "), lambda w: F.lower(w) == "the")
    return s.select("doc_id", "sentence_pos", F.md5("sentence").alias("sentence_md5"), flag.alias("has_the"))


SQL_SENTENCES = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS s
           FROM documents)
SELECT doc_id, CAST(pos AS INTEGER) AS sentence_pos, md5(s) AS sentence_md5,
       CASE WHEN list_contains(string_split(lower(s), ' '), 'the') THEN 1 ELSE 0 END AS has_the FROM l
"""


QUERIES = {"articles_scan": q_articles_scan, "csv_round_trip": q_csv_round_trip, "keyed_folder": q_keyed_folder,
           "template_store": q_template_store, "subsample_sink": q_subsample_sink, "last_lines": q_last_lines,
           "sentences": q_sentences}

ORACLE = {"articles_scan": SQL_ARTICLES_SCAN, "csv_round_trip": SQL_CSV_ROUND_TRIP, "keyed_folder": SQL_KEYED_FOLDER,
          "template_store": SQL_TEMPLATE_STORE, "subsample_sink": SQL_SUBSAMPLE_SINK, "last_lines": SQL_LAST_LINES,
          "sentences": SQL_SENTENCES}
