"""Registered query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import bottomk
from varietas.llm.common import read


def op11_bottomk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-128 sketch (five-word shingles) of every document and of its edited text, and their likeness."""
    got = bottomk.fingerprints(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", bottomk.as_text(F.col("sketch")).alias("fingerprint"),
                      bottomk.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
                      "held_edited", "n_shingles")


QUERIES = {"op11_bottomk_fingerprints": op11_bottomk_fingerprints}
#: XXH64 has no DuckDB form; the whole query is tested against brute force.
ORACLE: dict[str, str] = {}
