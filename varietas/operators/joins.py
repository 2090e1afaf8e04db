"""Joins (J1-J8, J11).

Dimension sides (ratings, topic vectors, templates) are aggregates or literal
tables whose size is bounded by the number of outlets / topics / categories,
not by documents.  The planner's size check decides broadcast: AQE turns a
sort-merge join into a broadcast join at run time when the materialised side is
under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, and keeps the
shuffle join beyond it.  Explicit ``broadcast`` hints are used only for
literal tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_left(df: DataFrame, dim: DataFrame, on: str | Sequence[str] | None = None,
                left_on: str | None = None, right_on: str | None = None) -> DataFrame:
    """Many-to-one left join, same or different key names."""
    if on is not None:
        return df.join(dim, on, "left")
    cond = df[left_on] == dim[right_on]
    return df.join(dim, cond, "left").drop(dim[right_on])


def unmatched(df: DataFrame, dim: DataFrame, key: str = "source") -> DataFrame:
    """Distinct keys of ``df`` without a row in ``dim``."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")


def attach(result: DataFrame, score: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner multi-key equi-join."""
    return result.join(score, list(keys), "inner")


def whole_vs_subset(whole: DataFrame, subset: DataFrame, key: str, value: str = "n",
                    suffixes: tuple[str, str] = ("_whole", "_subset")) -> DataFrame:
    """Left join of per-category counts, suffixed, missing -> 0."""
    a = whole.select(key, F.col(value).alias(value + suffixes[0]))
    b = subset.select(key, F.col(value).alias(value + suffixes[1]))
    return a.join(b, key, "left").fillna({value + suffixes[1]: 0})


def keep_originally_correct(variants: DataFrame, correct: DataFrame, keys: Sequence[str] = ("text_orig",)) -> DataFrame:
    """Keep the variants whose original was predicted right.

    ``correct`` lists the ``keys`` (the original's text or its digest, and the model) of
    originals predicted right, each distinct original scored once (W2).
    """
    return variants.join(correct.select(*keys).distinct(), list(keys), "left_semi")


def expand_templates(template: DataFrame, example: DataFrame) -> DataFrame:
    """Every template x every example of its category (equi-join on category).

    ``[category]`` in the template text is replaced by the example.  Both
    sides are per-category dimension tables (templates x minority examples).
    """
    j = template.join(example, "category")
    placeholder = F.concat(F.lit("["), F.col("category"), F.lit("]"))
    return j.select("category", F.col("minority").alias("category_minority"),
                    F.replace(F.col("text"), placeholder, F.col("example")).alias("text"), "label")


def pick_test_set(df: DataFrame, mapping: DataFrame, key: str = "dataset") -> DataFrame:
    """Dataset name -> test set name (small corpora share one held-out set).

    A name that ``mapping`` does not list is an error.
    """
    found = df.join(mapping, key, "left")
    missing = F.raise_error(F.concat(F.lit("no test set for "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    return found.withColumn("test_set", F.coalesce("test_set", missing.cast("string")))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W1 / W2 / O4 keep-first: the row with the smallest ``order`` per key.

    An aggregate (min_by over a struct, partial before the shuffle) rather than
    a window, so a key shared by a third of all rows (copies of one text) never
    lands whole in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return agg.select(*keys, "_r.*")


def keep_last(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """O4 keep-last on a key subset (NULL keys are one group)."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_r"))
    return agg.select(*keys, "_r.*")


def prefer_variant(df: DataFrame, col: str = "source", suffix: str = "-website",
                   exact: bool = False) -> DataFrame:
    """drop rows whose name contains the base name of a ``suffix`` row
    (unless they are one), then strip the suffix.

    A base is found by its first ``GRAM`` characters (all, if it has fewer), which a name that contains it
    has somewhere: distinct names and bases meet on that key and are then compared.
    ``exact=True`` compares whole names.
    """
    variants = df.where(F.col(col).endswith(suffix))
    base = F.expr(f"substring({col}, 1, length({col}) - {len(suffix)})")
    bases = variants.select(base.alias("_base")).distinct()
    others = df.where(~F.col(col).endswith(suffix) | F.col(col).isNull())
    if exact:
        lost = bases.select(F.col("_base").alias("_name"))
    else:
        keyed = bases.withColumn("_key", F.substring("_base", 1, GRAM))
        name = F.col("_name")
        starts = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
        grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.substring(name, i, n)))))
        names = others.select(F.col(col).alias("_name")).where(name.isNotNull()).distinct()
        lost = names.select("_name", F.explode(grams).alias("_key")).join(keyed, "_key")
        lost = lost.where(F.col("_name").contains(F.col("_base"))).select("_name").distinct()
    kept = others.join(lost, F.col(col) == F.col("_name"), "left_anti")
    return kept.unionByName(variants.withColumn(col, base))


#: Characters of a base name by which names that may contain it are found.
GRAM = 4
