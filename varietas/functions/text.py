"""Scalar column functions (projections, filters, text helpers).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word pattern of the topic vectoriser (words of two or more
# word characters), expressed with Unicode classes so Spark and DuckDB agree.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c) -> Column:
    """Lower-case, every space becomes '-'."""
    return F.replace(F.lower(_c(c)), F.lit(" "), F.lit("-"))


def remap(c, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the rest (small literal map)."""
    if not mapping:
        return _c(c)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(c)), _c(c))


def map_label(c, mapping: Mapping) -> Column:
    """Listed values map, everything else becomes NULL."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(_c(c) == F.lit(k), F.lit(v)) if expr is None else expr.when(_c(c) == F.lit(k), F.lit(v))
    return expr if expr is not None else F.lit(None)


def any_annotation(arr, predicate) -> Column:
    """1 when any element satisfies ``predicate`` (a Column lambda), else 0."""
    return F.coalesce(F.exists(_c(arr), predicate).cast("int"), F.lit(0))


def join_list(arr, sep: str = ", ") -> Column:
    """P5."""
    return F.array_join(_c(arr), sep)


def strip_column_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Rename columns that start with ``prefix``."""
    ren = {c: c[len(prefix):] for c in df.columns if c.startswith(prefix)}
    return df.withColumnsRenamed(ren) if ren else df


def strip_marker(c) -> Column:
    """Delete ``[digits]: `` markers."""
    return F.regexp_replace(_c(c), r"(\[[0-9]*\]: )", "")


def outlet_from_event_id(c) -> Column:
    """Drop text up to the first '_', drop '_digits', lower, blanks -> '-'."""
    rest = F.regexp_replace(_c(c), r"^[^_]*_", "")
    rest = F.regexp_replace(rest, r"_[0-9]+", "")
    return F.regexp_replace(F.lower(rest), r"\s+", "-")


def parse_model_name(c) -> list[Column]:
    """P10: last path part -> (model, dataset, dimension, subsample).

    Model names look like ``<dataset>_<dimension>_subsamples_model_alpha_<a>_idx_<i>``.
    """
    name = F.substring_index(_c(c), "/", -1)
    return [
        name.alias("model"),
        F.regexp_extract(name, r"^([^_]+)_", 1).alias("dataset"),
        F.regexp_extract(name, r"^[^_]+_([^_]+)_", 1).alias("dimension"),
        F.regexp_replace(name, r".*alpha_", "alpha_").alias("subsample"),
    ]


def parse_alpha(c) -> Column:
    """``alpha_0_05_idx_2`` -> 0.05; ``alpha_inf_idx_1`` -> +inf."""
    raw = F.regexp_extract(_c(c), r"_(\d+(?:_\d+)?|inf)_", 1)
    return F.when(raw == "", F.lit(None).cast("double")).otherwise(
        F.replace(raw, F.lit("_"), F.lit(".")).cast("double"))


def subsample_name(alpha_text: str, idx: int) -> str:
    """Inverse of P11 for a Python alpha value rendered as text."""
    return f"alpha_{alpha_text.replace('.', '_')}_idx_{idx}"


def split_embedding_key(c) -> list[Column]:
    """``<dataset>_x_<topic words>`` -> (dataset, topic)."""
    parts = F.split(_c(c), "_")
    return [parts.getItem(0).alias("dataset"),
            F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "_").alias("topic")]


def first_line(c) -> Column:
    """P13."""
    return F.split(_c(c), "\n").getItem(0)


def concat_qa(q, a) -> Column:
    """P15."""
    return F.concat_ws(" ", _c(q), _c(a))


def tokenize(c, lower: bool = True) -> Column:
    """Words of >= 2 word characters (after lower-casing)."""
    src = F.lower(_c(c)) if lower else _c(c)
    return F.regexp_extract_all(src, F.lit(TOKEN_PATTERN), 0)


def ngrams(tokens, n_max: int = 1) -> Column:
    """1..n_max word n-grams joined with a blank."""
    t = _c(tokens)
    out = t
    for n in range(2, n_max + 1):
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))),
            lambda i: F.array_join(F.slice(t, i, n), " "))
        out = F.concat(out, F.when(F.size(t) >= n, grams).otherwise(F.array()))
    return out


def remove_stop_words(tokens, stop_words: Iterable[str]) -> Column:
    """Drop stop words before n-grams are formed."""
    sw = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(sw, t))


def truncate_tokens(tokens, k: int = 128) -> Column:
    """Keep the first k word tokens (word level, not sub-word)."""
    return F.slice(_c(tokens), 1, k)


def strip_article(c, legacy: bool = False) -> Column:
    """Drop a leading 'the '.

    ``legacy=True`` keeps the character-set rule of a plain left strip of the
    characters {t, h, e, blank}: 'the theatre' -> 'atre'.
    """
    if legacy:
        return F.regexp_replace(_c(c), r"^[the ]+", "")
    return F.regexp_replace(_c(c), r"^the ", "")


def bin_edges(c, low: float = 0.1, high: float = 0.9) -> Column:
    """P20: right-closed bins (-inf, low], (low, high], (high, inf)."""
    x = _c(c)
    return (F.when(x.isNull(), F.lit(None))
            .when(x <= low, F.lit("low"))
            .when(x <= high, F.lit("middle"))
            .otherwise(F.lit("high")))


def stars(p, inclusive: bool = False) -> Column:
    """P21: '**' / '*' / '' by p-value; strict '<' or inclusive '<='."""
    x = _c(p)
    if inclusive:
        return F.when(x <= 0.01, "**").when(x <= 0.05, "*").otherwise("")
    return F.when(x < 0.01, "**").when(x < 0.05, "*").otherwise("")


def format_num(c, fmt: str = "%.3f") -> Column:
    """P22."""
    return F.format_string(fmt, _c(c))


def not_in_list(c, values: Iterable, keep_null: bool = True) -> Column:
    """null-safe NOT IN (pandas keeps NaN rows in ``~isin``)."""
    cond = ~_c(c).isin(list(values))
    return F.coalesce(cond, F.lit(keep_null))


def contains_any(c, subs: Iterable[str]) -> Column:
    """F4."""
    out = None
    for s in subs:
        e = _c(c).contains(s)
        out = e if out is None else (out | e)
    return out if out is not None else F.lit(False)


def null_if_contains(c, marker: str = "-1") -> Column:
    """names containing the outlier marker become NULL."""
    return F.when(_c(c).contains(marker), F.lit(None)).otherwise(_c(c))


def drop_empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """drop NULL and empty texts."""
    return df.where(F.length(F.col(col)) > 0)
