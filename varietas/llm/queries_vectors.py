"""Registered queries of the operators on embeddings: hard negatives and whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import negatives, whitening
from varietas.llm.common import read


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 5 hard negatives for each of the first 5 positives of every anchor (ids divisible by 100)."""
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), flipped.alias("label"),
                                                    negatives.integer_vector(F.col("embedding")).alias("x"))
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 4 whitened principal components of the distinct vectors."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), negatives.integer_vector(F.col("embedding")).alias("x"))
    return whitening.whiten(rows, 4).withColumnRenamed("id", "vec_id")


QUERIES = {"op12_hard_negatives": op12_hard_negatives, "op13_feast_whitening": op13_feast_whitening}

ORACLE = {
    "op12_hard_negatives": """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.id AS a, r.id AS id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2]))::BIGINT AS s
    FROM r AS a JOIN r ON a.id % 100 = 0 AND a.id <> r.id),
pos AS (SELECT a, id AS p, s AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, id) <= 5),
neg AS (SELECT pos.a, p, ps, id, s, row_number() OVER (PARTITION BY pos.a, p ORDER BY s DESC, id) AS rank
    FROM pos JOIN scored ON pos.a = scored.a AND NOT same AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, id AS negative_id, ps AS positive_score, s AS negative_score
FROM neg WHERE rank <= 5""",
}
