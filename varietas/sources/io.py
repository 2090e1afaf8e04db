"""Sources and sinks.

All readers declare their schema; nothing is inferred from the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Nested article schema.  ``author-sentiment`` has keys that differ only in
# case, so it must be a map (struct inference fails on it).
ARTICLE_DDL = (
    "source string, `main-entities` array<string>, `main-event` string, title string, url string, "
    "`word-count` int, date date, "
    "`article-level-annotations` struct<`author-sentiment`: map<string,string>, stance: string>, "
    "annotators array<string>, "
    "body array<struct<sentence: string, `sentence-index`: int, "
    "annotations: array<struct<start: int, `end`: int, target: string, polarity: string, aim: string, "
    "`indirect-target-name`: string, `indirect-ally-opponent-sentiment`: string, bias: string, "
    "quote: string, speaker: string, text: string>>>>, "
    "_corrupt_record string"
)

# Short outlet codes of the article corpus and their names.
ARTICLE_SOURCES = {"fox": "fox-news", "nyt": "the-new-york-times", "hpo": "huffpost"}


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Whole articles, one row per file; unparsable files keep ``_corrupt_record``."""
    return (spark.read.schema(ARTICLE_DDL).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .withColumn("_file", F.col("_metadata.file_name")))


def scan_articles(spark: SparkSession, path: str, mapping: Mapping[str, str] = ARTICLE_SOURCES) -> tuple[DataFrame, DataFrame]:
    """S1 + R2 + P4 + P2 + F2: one row per non-empty sentence.

    Returns (sentences(file, sentence_index, text, source, date, main_entities, label), audit)
    where ``audit`` counts files read, files skipped (unparsable), sentences
    and empty sentences (A20).  label = 1 when any annotation has bias 'Lexical'.
    """
    from varietas.functions.text import any_annotation, remap

    arts = read_articles(spark, path)
    good = arts.where(F.col("_corrupt_record").isNull())
    sents = good.select("_file", F.lower("source").alias("_src"), "date", F.col("`main-entities`").alias("main_entities"),
                        F.posexplode_outer("body").alias("_pos", "b"))
    sents = sents.select(
        F.col("_file").alias("file"), F.col("_pos").alias("sentence_index"), F.col("b.sentence").alias("text"),
        remap("_src", mapping).alias("source"), "date", "main_entities",
        any_annotation("b.annotations", lambda a: a["bias"] == "Lexical").alias("label"))
    # reference a parsed column too: Spark refuses queries on the corrupt column alone
    audit = arts.agg(F.count("*").alias("files"),
                     F.count_if(F.col("_corrupt_record").isNotNull() & F.col("body").isNull()).alias("skipped"))
    stats = sents.agg(F.count_if(F.col("text").isNotNull()).alias("sentences"),
                      F.count_if(F.col("text").isNull() | (F.length("text") == 0)).alias("empty"))
    kept = sents.where(F.length("text") > 0)
    return kept, audit.crossJoin(stats)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Header CSV, comma or ';', quoted fields may hold line breaks."""
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("multiLine", True).option("escape", '"').csv(path))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.parquet(path)


def scan_folder_keyed(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.csv",
                      key_regex: str = r"^[a-z]+_([a-z]+)_([a-z]+)\.", keys: Sequence[str] = ("dataset", "dimension"),
                      fmt: str = "csv") -> DataFrame:
    """Every file of a folder; parts of the file name become key columns.

    Default: ``results_<dataset>_<dimension>.csv``.
    """
    reader = spark.read.schema(schema).option("header", True) if fmt == "csv" else spark.read.schema(schema)
    df = reader.format(fmt).load(f"{folder.rstrip('/')}/{pattern}")
    name = F.col("_metadata.file_name")
    return df.select("*", *[F.regexp_extract(name, key_regex, i + 1).alias(k) for i, k in enumerate(keys)])


def write_template_store(example: DataFrame, template: DataFrame, path: str) -> None:
    """Writes one folder per category (``category=<name>``) and ``template_sentences``."""
    example.write.mode("overwrite").partitionBy("category").parquet(f"{path}/examples")
    template.write.mode("overwrite").parquet(f"{path}/template_sentences")


def scan_template_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All category tables unioned with the category name as a column
    (partition discovery), and the template table split off."""
    examples = spark.read.parquet(f"{path}/examples")
    templates = spark.read.parquet(f"{path}/template_sentences")
    return examples, templates


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """CSV with header, or Parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_subsamples(members: DataFrame, scores: DataFrame, path: str) -> None:
    """Members partitioned by (dataset, dimension, subsample) and the score table.

    Partition pruning applies when one subsample is read back.
    """
    members.write.mode("overwrite").partitionBy("dataset", "dimension", "subsample").parquet(f"{path}/members")
    scores.write.mode("overwrite").partitionBy("dataset", "dimension").parquet(f"{path}/scores")
