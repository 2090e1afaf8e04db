"""Registered queries of the scanning operators: PII surrogates and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import licenses, pii
from varietas.llm.common import read

#: Key of the registered query; a deployment passes its own secret to :func:`varietas.llm.pii.replace_pii`.
KEY = "registered-query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with keyed surrogates for what it says about persons."""
    got = pii.replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return got.withColumn("pii_kinds", F.concat_ws(",", "pii_kinds"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: of its entire text and of its lines."""
    known = licenses.known_licences(spark).unionByName(licenses.standard_licences(spark))
    got = licenses.scan(read(spark, sf_dir, "documents"), known)
    return got.select(F.col("id").alias("doc_id"), "text_digest", "whole_license",
                      F.concat_ws(",", "line_licenses").alias("line_licenses"), "n_license_lines")


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates, "op5_license_scan": op5_license_scan}


#: The notice pattern looks around itself, which DuckDB's patterns cannot; both queries are tested against brute force.
ORACLE: dict[str, str] = {}
