"""Registered queries of the filtering operators: quality rules, near duplicates, decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import decontaminate, quality_rules, simhash
from varietas.llm.common import read


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (3-word shingles) and component (at most 2 differing bits) of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_removed_words", "base_failed", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document hit by windows of 10 words of the benchmark's items."""
    got = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op3_simhash_golay": op3_simhash_golay, "op4_quality_rules": op4_quality_rules,
           "op6_decontaminate": op6_decontaminate}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, source, generate_subscripts(string_split(t, chr(10)), 1) AS pos, unnest(string_split(t, chr(10))) AS line FROM d),
real AS (SELECT r, source, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hashed AS (SELECT *, md5(norm) AS h, row_number() OVER (PARTITION BY r, line ORDER BY pos) AS nth FROM (SELECT *,
    regexp_replace(translate(list_aggregate(lw, 'string_agg', ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm FROM real)),
texts AS (SELECT r, md5(t) AS th FROM d),
hosts AS (SELECT source, count(DISTINCT th) AS host_docs FROM hashed JOIN texts USING (r) GROUP BY 1),
cand AS (SELECT s, h FROM (SELECT source AS s, h, count(DISTINCT th) AS n FROM hashed JOIN texts USING (r) GROUP BY 1, 2)
    JOIN hosts ON s IS NOT DISTINCT FROM source WHERE n > 10 AND n > 0.02::DOUBLE * host_docs),
lost AS (SELECT r, sum(len(lw)) AS lost FROM hashed JOIN cand ON hashed.h = cand.h AND source IS NOT DISTINCT FROM s
    GROUP BY 1),
dups AS (SELECT r, count_if(nth > 1) AS n_dup FROM hashed GROUP BY 1),
win AS (SELECT r, unnest(range(0, len(w) - 7)) AS i,
    unnest(list_transform(range(0, len(w) - 7), lambda k: list_aggregate(w[k + 1:k + 8], 'string_agg', ' '))) AS s
    FROM d WHERE len(w) > 8),
rep_win AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM rep_win CROSS JOIN range(0, 8) t(o) GROUP BY 1),
base AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS wc,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS sym, coalesce(n_dup, 0) AS n_dup,
    coalesce(covered.n, 0) AS rep, coalesce(lost, 0) AS lost
    FROM d LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, sym::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines,
    rep::BIGINT AS n_repeat_words, lost::BIGINT AS n_removed_words,
    (n_words < 20 OR 100 * rep > 30 * n_words) AS base_failed,
    NOT (n_words < 20 OR 100 * rep > 30 * n_words) AND NOT (lost > 0 AND (lost > 0.6::DOUBLE * n_words OR n_words - lost < 10)) AS kept
FROM base""",
    "op6_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, list_aggregate(w[i + 1:i + k], 'string_agg', ' ') AS s
    FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, unnest(range(0, len(w) - k + 1)) AS i,
    unnest(list_transform(range(0, len(w) - k + 1), lambda j: list_aggregate(w[j + 1:j + k], 'string_agg', ' '))) AS s
    FROM d, ks WHERE len(w) >= k),
hit AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
}
