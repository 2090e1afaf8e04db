"""Registered queries of the operators with a model: language identification and quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import classifier, langid
from varietas.llm.common import crc_mod, read


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model learns from ids with crc32 mod 3 other than 1."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; the model learns from ids with crc32 mod 4 other than 2."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = classifier.fit(docs, labels, ~held_out)
    got = classifier.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return got.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES = {"op2_langid": op2_langid, "op8_factorisation_machine": op8_factorisation_machine}
ORACLE: dict[str, str] = {}
