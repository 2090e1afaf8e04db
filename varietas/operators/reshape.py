"""Reshape (R1-R3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, id_col: str, text_cols: Sequence[str], score_cols: Sequence[str] | None = None,
                 title_col: str | None = None, title_score_col: str | None = None) -> DataFrame:
    """One row per non-empty cell of ``text_cols`` (with its score), plus an
    optional title row (idx = -1) with the score of ``title_score_col``.  Output (id, idx, text[, score])."""
    parts = [F.struct(F.lit(i).alias("idx"), F.col(c).cast("string").alias("text"),
                      *([F.col(score_cols[i]).cast("double").alias("score")] if score_cols else []))
             for i, c in enumerate(text_cols)]
    long = df.select(id_col, F.explode(F.array(*parts)).alias("_r")).select(id_col, "_r.*")
    long = long.where(F.col("text").isNotNull() & (F.length("text") > 0))
    if title_col:
        title = df.select(id_col, F.lit(-1).alias("idx"), F.col(title_col).alias("text"))
        if score_cols:
            title = df.select(id_col, F.lit(-1).alias("idx"), F.col(title_col).alias("text"),
                              (F.col(title_score_col) if title_score_col else F.lit(None)).cast("double").alias("score"))
        long = long.unionByName(title)
    return long


def explode_sentences(df: DataFrame, arr: str = "body") -> DataFrame:
    """R2: one row per array element with its position."""
    return df.select("*", F.posexplode_outer(arr).alias("sentence_pos", "sentence")).drop(arr)


def repeat_k(df: DataFrame, k: int) -> DataFrame:
    """Every row k times with rep = 0..k-1."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
