"""Aggregations and statistics.

All groups are computed in one pass with built-in aggregates (partial
aggregation before the shuffle).  Order statistics (ranks, quantiles) avoid
window partitions over whole groups: a group may hold a third of all rows, so
values are first collapsed to distinct (group, value) counts, range-partitioned
across tasks, and each task contributes its cumulative counts; small per-task
offsets then give every distinct value its global position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions.pvalues import f_pvalue, t_pvalue
from varietas.functions.text import stars as stars_expr
from varietas.session import cut_lineage


def _part(keys):
    keys = list(keys or [])
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


# --------------------------------------------------------------------------- A1 / A5 / A6 / A8 / W3
def value_counts(df: DataFrame, keys: Sequence[str], dropna: bool = False) -> DataFrame:
    """A1: counts per key; NULL is a group unless ``dropna``."""
    src = df
    if dropna:
        for k in keys:
            src = src.where(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(F.count("*").alias("count"))


def share_of_total(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "share") -> DataFrame:
    """Value / sum(value) over the partition."""
    return df.withColumn(out, F.col(value) / F.sum(value).over(_part(keys)))


def summary(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population std, min, max (NumPy's std is the population one)."""
    return df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                                 F.min(col).alias("min"), F.max(col).alias("max"),
                                 F.count(col).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] per key; the last bin is closed.

    min / max come from an aggregate joined back (not a window over the group).
    """
    keys = list(keys)
    src = df.where(F.col(col).isNotNull())
    rng = src.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = src.join(rng, keys) if keys else src.crossJoin(F.broadcast(rng))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col(col) - F.col("_lo")) / width * bins), F.lit(bins - 1)).cast("int")
    return j.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def min_max_scale(c: str, keys: Sequence[str] = ()) -> Column:
    """P18 as a window expression, for small (already aggregated) tables only;
    use ``with_min_max`` on data rows."""
    part = _part(keys)
    lo, hi = F.min(c).over(part), F.max(c).over(part)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))


def with_min_max(df: DataFrame, c: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """(x - min) / (max - min) per key, 0 when max = min (as sklearn).

    min / max per key are an aggregate (partial before the shuffle) joined back
    (one row per group: the planner's size check decides how; without keys it is one row).
    """
    keys = list(keys)
    out = out or f"{c}_scaled"
    rng = df.groupBy(*keys).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    j = df.join(rng, keys) if keys else df.crossJoin(F.broadcast(rng))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(c) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))) \
        .otherwise(F.lit(0.0))
    return j.withColumn(out, scaled).drop("_lo", "_hi")


def scale_by_max(c: str, k: float = 50.0, keys: Sequence[str] = ()) -> Column:
    """X / max(x) * k per partition."""
    return F.col(c) / F.max(c).over(_part(keys)) * k


# --------------------------------------------------------------------------- A9 / A10 / A11
def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Tp, fp, fn, tn per key in one pass."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*keys).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def metrics_from_confusion(conf: DataFrame) -> DataFrame:
    """A10: mcc, f1, precision, recall, roc_auc (hard labels), accuracy.

    Undefined precision / recall / F1 are 0; MCC is 0 when any margin is 0;
    roc_auc = (recall + specificity) / 2, NULL when one class is absent.
    Counts are cast to double and each margin is square-rooted separately.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    mcc = F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)
    spec = tn / (tn + fp)
    auc = F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + spec) / 2)
    acc = (tp + tn) / (tp + fp + fn + tn)
    return conf.withColumns({"mcc": mcc, "f1": f1, "precision": prec, "recall": rec,
                             "roc_auc": auc, "accuracy": acc})


def binary_metrics(df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    return metrics_from_confusion(confusion(df, keys, label, pred))


def group_metrics(pred: DataFrame, per_minority_tests: Sequence[str] = ("PrejudiceTest",)) -> DataFrame:
    """Per (test, model, category, category_minority) for the template
    suite, one row with NULL categories for the other suites.

    Output columns follow the suite-result table: MCC, F1, Accuracy.
    """
    is_per = F.col("test").isin(list(per_minority_tests))
    p = pred.withColumn("category", F.when(is_per, F.col("category")).cast("string")) \
            .withColumn("category_minority", F.when(is_per, F.col("category_minority")).cast("string"))
    m = binary_metrics(p, ["test", "model", "category", "category_minority"])
    return m.select("test", "model", "category", "category_minority", F.col("mcc").alias("MCC"),
                    F.col("f1").alias("F1"), F.col("accuracy").alias("Accuracy"))


# --------------------------------------------------------------------------- ranks and quantiles
def _sliced_values(df: DataFrame, value: str, keys: list[str], n_parts: int | None) -> tuple[DataFrame, DataFrame]:
    """(values, slices): distinct (keys, value) with their count ``cnt``, slice ``_pid`` and count before
    them in the slice ``_local``; and per (keys, _pid) the counts before (``_off``) and in it (``_tot``) and
    the group's size ``n``.

    The slices come from one range partitioning.  Its borders are sampled, so they
    differ between two evaluations: the table is written once and everything else reads that copy.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    if n_parts is None:
        n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = cut_lineage(d.repartitionByRange(n_parts, *keys, value).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    values = cut.withColumn("_local", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    slices = cut.groupBy(*keys, "_pid").agg(F.sum("cnt").alias("_tot"))
    kw = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))   # slices x groups rows
    slices = slices.withColumn("_off", F.coalesce(F.sum("_tot").over(
        kw.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return values, slices.withColumn("n", F.sum("_tot").over(kw))


def distinct_value_positions(df: DataFrame, value: str, keys: Sequence[str] = (),
                             n_parts: int | None = None) -> DataFrame:
    """(keys..., value, cnt, lo, n): the distinct values of each group with their
    0-based first position ``lo`` in ascending order and the group size ``n``.

    Distinct (group, value) counts are range-partitioned over tasks; a window
    inside each slice gives the count before each value, and per-slice offsets
    (slices x groups rows) are added.  No task ever holds a whole group.
    """
    keys = list(keys)
    values, slices = _sliced_values(df, value, keys, n_parts)
    out = values.join(slices.select(*keys, "_pid", "_off", "n"), [*keys, "_pid"])
    return out.select(*keys, value, "cnt", (F.col("_off") + F.col("_local")).alias("lo"), "n")


def position_spans(df: DataFrame, value: str) -> tuple[DataFrame, int]:
    """((value, _lo, _hi, _bucket), width): the positions [_lo, _hi) of every value in the sorted column (repeats counted),
    a row for each bucket of ``width`` positions that they reach.

    The width is a value's mean count, so there are at most three rows a value, and a position meets about three.
    """
    values, slices = _sliced_values(df, value, [], None)
    size = values.agg(F.count("*").alias("d"), F.sum("cnt").alias("n")).first()
    width = max(1, (size["n"] or 0) // max(1, size["d"]))
    spans = values.join(F.broadcast(slices.select("_pid", "_off")), "_pid").withColumn("_lo", F.col("_off") + F.col("_local"))
    spans = spans.withColumn("_hi", F.col("_lo") + F.col("cnt"))
    buckets = F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))
    return spans.select(value, "_lo", "_hi", F.explode(buckets).alias("_bucket")), width


def value_at(df: DataFrame, value: str, wanted: DataFrame, place: str, more: DataFrame | None = None) -> DataFrame:
    """``wanted`` with the ``value`` at 0-based position ``place`` of the sorted column (repeats counted).

    A position meets the values of its bucket only (:func:`position_spans`).  ``more`` may hold a row of further
    columns for a value, which come with it (null where there is none): it meets the values, not ``wanted``.
    """
    spans, width = position_spans(df, value)
    if more is not None:
        spans = spans.join(more, value, "left")
    hit = wanted.withColumn("_bucket", F.floor(F.col(place) / width)).join(spans, "_bucket")
    return hit.where((F.col(place) >= F.col("_lo")) & (F.col(place) < F.col("_hi"))).drop("_bucket", "_lo", "_hi")


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """1-based average rank of ``value`` within keys (ties share the mean rank)."""
    out = out or f"{value}_rank"
    pos = distinct_value_positions(df, value, keys)
    pos = pos.select(*keys, value, (F.col("lo") + (F.col("cnt") + 1) / 2.0).alias(out))
    return df.join(pos, [*keys, value], "left")


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (NumPy default).

    Position h = q (n - 1); result = v[floor h] + (h - floor h)(v[ceil h] - v[floor h]).
    A position is first located in a slice by the slices' offsets; only that
    slice's values meet it, so a large group is never joined on its key alone.
    """
    keys = list(keys)
    values, slices = _sliced_values(df, value, keys, None)
    sizes = slices.select(*keys, "n").distinct()
    qs = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    qs = qs.withColumn("_h", F.col("q") * (F.col("n") - 1)).drop("n")
    want = qs.withColumn("_k", F.explode(F.array(F.floor("_h"), F.ceil("_h"))))
    at = want.join(slices.drop("n"), keys) if keys else want.crossJoin(slices.drop("n"))
    at = at.where((F.col("_k") >= F.col("_off")) & (F.col("_k") < F.col("_off") + F.col("_tot")))
    at = at.withColumn("_in", F.col("_k") - F.col("_off")).drop("_off", "_tot")
    hit = values.join(at, [*keys, "_pid"]).where((F.col("_in") >= F.col("_local")) & (F.col("_in") < F.col("_local") + F.col("cnt")))
    lo_hi = hit.groupBy(*keys, "q", "_h").agg(F.min(value).alias("_vf"), F.max(value).alias("_vc"))
    val = F.col("_vf") + (F.col("_h") - F.floor("_h")) * (F.col("_vc") - F.col("_vf"))
    return lo_hi.select(*keys, "q", val.alias("value"))


# --------------------------------------------------------------------------- A12 / A13 / A14 / A15
def pearson(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """R, n, t = r sqrt((n-2)/(1-r^2)) and the two-sided p."""
    keys = list(keys)
    r = df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    r = r.withColumn("t", t)
    if with_p:
        r = r.withColumn("p", t_pvalue(F.col("t"), F.col("n") - 2))
    return r


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), id_col: str | None = None,
             with_p: bool = True) -> DataFrame:
    """Pearson on average ranks."""
    keys = list(keys)
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_rank(src, x, keys, "_rx")
    both = average_rank(rx, y, keys, "_ry")
    res = pearson(both, "_rx", "_ry", keys, with_p)
    return res.withColumnRenamed("r", "rho")


def ols(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Y ~ x per group: slope, intercept, r2, std error of the slope, t, p, n."""
    keys = list(keys)
    a = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_count(y, x).alias("n"))
    sse = F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")
    se = F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("n") - 2) / F.col("_sxx"))
    a = a.withColumn("stderr", se).withColumn("t", F.col("slope") / F.col("stderr"))
    if with_p:
        a = a.withColumn("p", t_pvalue(F.col("t"), F.col("n") - 2))
    return a.drop("_sxx", "_syy")


def anova(df: DataFrame, value: str, group: str, keys: Sequence[str] = (),
          groups: Sequence[str] | None = None, with_p: bool = True) -> DataFrame:
    """One-way ANOVA F over ``group`` (optionally only the listed groups)."""
    keys = list(keys)
    src = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    if groups is not None:
        src = src.where(F.col(group).isin(list(groups)))
    g = src.groupBy(*keys, group).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"),
                                      F.var_pop(value).alias("_v"))
    part = _part(keys)
    g = g.withColumn("_ntot", F.sum("_n").over(part)).withColumn(
        "_grand", F.sum(F.col("_n") * F.col("_m")).over(part) / F.col("_ntot"))
    a = g.groupBy(*keys).agg(
        F.sum(F.col("_n") * (F.col("_m") - F.col("_grand")) ** 2).alias("ssb"),
        F.sum(F.col("_n") * F.col("_v")).alias("ssw"), F.count("*").alias("k"), F.first("_ntot").alias("n"))
    a = a.withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
    a = a.withColumn("f", (F.col("ssb") / F.col("df1")) / (F.col("ssw") / F.col("df2")))
    if with_p:
        a = a.withColumn("p", f_pvalue(F.col("f"), F.col("df1"), F.col("df2")))
    return a


def regression_pivot(df: DataFrame, y: str, x: str, row_keys: Sequence[str], sub_key: str,
                     col_keys: Sequence[str], with_stars: bool = True, inclusive: bool = True,
                     scale: float = 10.0) -> DataFrame:
    """Slope x scale (+ stars) per row group and, below it, per sub-group;
    columns are the combinations of ``col_keys``; empty cells are 'N/A'.

    One aggregation with GROUPING SETS computes both levels in one pass.
    """
    row_keys, col_keys = list(row_keys), list(col_keys)
    sets = [[*row_keys, *col_keys], [*row_keys, sub_key, *col_keys]]
    cols = row_keys + [sub_key] + col_keys
    agg = df.groupingSets(sets, *cols).agg(
        F.grouping(sub_key).alias("_lvl"), F.regr_slope(y, x).alias("slope"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_count(y, x).alias("n"))
    sse = F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")
    t = F.col("slope") / F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("n") - 2) / F.col("_sxx"))
    cell = F.format_string("%.3f", F.col("slope") * scale)
    if with_stars:
        agg = agg.withColumn("_p", t_pvalue(t, F.col("n") - 2))
        cell = F.concat(cell, F.coalesce(stars_expr("_p", inclusive), F.lit("")))
    agg = agg.withColumn("cell", F.when(F.col("slope").isNull(), F.lit("N/A")).otherwise(cell))
    agg = agg.withColumn("column", F.concat_ws("_", *col_keys))
    agg = agg.withColumn("row_minority", F.when(F.col("_lvl") == 0, F.col(sub_key)))
    return agg.select(*row_keys, "row_minority", "column", "cell")


def pivot_cells(cells: DataFrame, row_cols: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A16 layout: one column per value of ``column`` (listed, so no extra job), 'N/A' when empty."""
    wide = cells.groupBy(*row_cols).pivot("column", list(columns)).agg(F.first("cell"))
    return wide.fillna("N/A", subset=list(columns))
