"""The training-data pipeline: five stages, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.

In every stage a null text is empty, a null id or source is a value like others, repeated rows are judged alike, an empty table
gives an empty result, further columns of whatever name are kept (but by the last stage); the operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import decontaminate, mixing, quality_rules, simhash
from varietas.llm.common import column, cut, n_words, read
from varietas.llm.queries_layout import sharded
from varietas.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, lines that are frequent on their host go from the others."""
    prepare(spark)
    kept = quality_rules.apply_rules(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*[column(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (3-word shingles, at most 2 differing bits): the smallest doc_id of each group stays."""
    prepare(spark)
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with a window of 10 words of a benchmark item go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix of the sources to weights 3, 1, 2: every document as often as the mix takes it (not at all, once or twice)."""
    prepare(spark)
    return mixing.take(docs, n_words(F.col("text")), F.xxhash64("text"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """K-d tree shards of near-equal bytes; a document taken twice has two slots."""
    prepare(spark)
    return sharded(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark),
          ("mixing sources", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: XXH64 fingerprints, balanced sampling and tree cuts have no SQL form; the stages are tested one by one.
ORACLE_SQL = None
