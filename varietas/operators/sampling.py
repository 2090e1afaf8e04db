"""Diversity-controlled sampling.

Design notes for scale:

* Category sizes come from one ``groupBy`` (m rows, m = number of
  categories); all allocation logic runs as windows over those m rows per
  subsample, never over documents.  m is checked in the plan
  (``raise_error``) so the allocation side of the draw join has a proven bound
  of ``subsamples x m`` rows and may be broadcast.
* The draw ranks rows inside (subsample, category) by md5(seed|subsample|id).
  The filter carries the literal bound ``rn <= N`` so Spark plans a
  ``WindowGroupLimit`` (partial top-k before the shuffle): a category holding a
  third of the corpus ships at most N rows per map task, not the category.
* Randomness is a pure function of (seed, keys): reruns after executor loss
  give the same members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions.hashing import hash_order, hash_u32
from varietas.functions.text import subsample_name
from varietas.session import cut_lineage

# The alpha grid, repetitions and subsample size of a sweep.
DEFAULT_ALPHAS = ("0.001", "0.005", "0.01", "0.05", "0.08", "0.1", "0.5", "1", "10", "100", "1000")
DEFAULT_REPS = 3
DEFAULT_N = 500
MAX_CATEGORIES = 100_000


def _keys(keys: Sequence[str] | None) -> list[str]:
    return list(keys or [])


def category_caps(df: DataFrame, category: str = "category", keys: Sequence[str] | None = None,
                  include_null: bool = False, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """(keys..., category, cap): rows per category; checks m <= max_categories."""
    k = _keys(keys)
    src = df if include_null else df.where(F.col(category).isNotNull())
    caps = src.groupBy(*k, F.col(category).alias("category")).agg(F.count("*").alias("cap"))
    w = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(1))
    m = F.count("*").over(w)
    return caps.withColumn(
        "cap", F.when(m > max_categories,
                      F.raise_error(F.lit(f"more than {max_categories} categories"))
                      .cast("long")).otherwise(F.col("cap")))


def allocate_uniform(caps: DataFrame, n_total: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Equal shares, capped, remainder +1 round-robin in category order.

    Closed form of the round-robin loop (water filling): level
    L = max_i floor((N - S_i) / (m - i)) over caps sorted ascending, S_i the
    sum of the i smallest; n = min(cap, L); the N - sum(n) categories first in
    name order with cap > L get one more.  If N >= sum(cap) every category is
    taken whole.
    """
    k = _keys(keys)
    part = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(1))
    by_cap = part.orderBy("cap", "category")
    prev = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = (caps
         .withColumn("_i", F.row_number().over(by_cap) - 1)
         .withColumn("_s", F.coalesce(F.sum("cap").over(prev), F.lit(0)))
         .withColumn("_m", F.count("*").over(part))
         .withColumn("_total", F.sum("cap").over(part)))
    s = s.withColumn("_lvl", F.max(F.floor((F.lit(n_total) - F.col("_s")) / (F.col("_m") - F.col("_i"))))
                     .over(part))
    s = s.withColumn("_base", F.when(F.col("_total") <= n_total, F.col("cap"))
                     .otherwise(F.least(F.col("cap"), F.col("_lvl"))))
    s = s.withColumn("_rem", F.lit(n_total) - F.sum("_base").over(part))
    s = s.withColumn("_open", (F.col("_total") > n_total) & (F.col("cap") > F.col("_lvl")))
    s = s.withColumn("_ord", F.row_number().over(Window.partitionBy(*k, "_open").orderBy("category")))
    n = F.col("_base") + F.when(F.col("_open") & (F.col("_ord") <= F.col("_rem")), 1).otherwise(0)
    return s.select(*k, "category", "cap", n.cast("long").alias("n"))


def allocate_dirichlet(weights: DataFrame, caps: DataFrame, n_total: int, seed: int = 42,
                       keys: Sequence[str] = ("subsample",), carry: Sequence[str] = ()) -> DataFrame:
    """D3: n = min(floor(N*w), cap); the whole remainder goes to one random
    category with n + rem < cap (strict); if none can take it the subsample
    stays short.

    ``weights``: (keys..., category, w); ``caps``: (category, cap).  ``carry``
    names extra weight columns passed through unchanged.
    """
    k = list(keys)
    part = Window.partitionBy(*k)
    a = weights.join(caps, "category")
    a = a.withColumn("_n0", F.when(F.col("w").isNull() | F.isnan("w") | (F.col("w") <= 0), F.lit(0))
                     .otherwise(F.least(F.floor(F.lit(n_total) * F.col("w")), F.col("cap"))))
    a = a.withColumn("_rem", F.lit(n_total) - F.sum("_n0").over(part))
    a = a.withColumn("_ok", (F.col("_n0") + F.col("_rem")) < F.col("cap"))
    a = a.withColumn("_pick", F.row_number().over(
        Window.partitionBy(*k, "_ok").orderBy(hash_order(seed, *k, "category"), "category")))
    extra = F.when(F.col("_ok") & (F.col("_pick") == 1) & (F.col("_rem") > 0), F.col("_rem")).otherwise(0)
    return a.select(*k, *carry, "category", "cap", "w", (F.col("_n0") + extra).cast("long").alias("n"))


def draw(pool: DataFrame, allocation: DataFrame, n_total: int, seed: int = 42,
         id_col: str = "doc_id", category: str = "category",
         keys: Sequence[str] = ("subsample",)) -> DataFrame:
    """Sample n rows per (subsample, category) without replacement.

    ``allocation`` has at most (subsamples x categories) rows, bounded by the
    check in ``category_caps``; it is broadcast.  The pool is never shuffled
    whole: ``rn <= N`` lets the planner cut each map task to N rows per group.
    """
    k = list(keys)
    alloc = F.broadcast(allocation.where(F.col("n") > 0).select(*k, F.col("category").alias(category), "n"))
    joined = pool.join(alloc, category)
    w = Window.partitionBy(*k, category).orderBy(hash_order(seed, *k, id_col), id_col)
    ranked = joined.withColumn("_rn", F.row_number().over(w))
    return ranked.where((F.col("_rn") <= n_total) & (F.col("_rn") <= F.col("n"))).drop("_rn", "n")


def alpha_grid(alphas: Sequence[str] = DEFAULT_ALPHAS, reps: int = DEFAULT_REPS) -> Column:
    """Literal array of (alpha_text, alpha, rep, subsample) structs for explode."""
    items = []
    for a in alphas:
        for r in range(1, reps + 1):
            items.append(F.struct(F.lit(a).alias("alpha_text"), F.lit(float(a)).alias("alpha"),
                                  F.lit(r).alias("rep"), F.lit(subsample_name(a, r)).alias("subsample")))
    return F.array(*items)


#: Tries of a gamma draw; one is refused in less than a twentieth of all cases, so all are in less than 1e-40.
GAMMA_TRIES = 32


def _uniforms(seed, *cols) -> Column:
    """Four uniforms in (0, 1): the 32-bit quarters of one md5."""
    h = hash_order(seed, *cols)
    return F.transform(F.array(*[F.substring(h, 8 * q + 1, 8) for q in range(4)]),
                       lambda x: (F.conv(x, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0))


def log_gamma_draw(alpha: Column, seed, *cols) -> Column:
    """ln of a Gamma(alpha) variate, a pure function of (seed, cols).

    Marsaglia and Tsang's rejection for alpha + 1: try i has its own md5, hence its own normal (Box and
    Muller) and uniform; the first accepted try counts.  ln G(a) = ln G(a + 1) + ln(U) / a keeps tiny alphas finite
    (plain draws underflow to 0 at 1e-3).
    """
    d = alpha + F.lit(2.0 / 3.0)
    c = 1.0 / F.sqrt(9.0 * d)

    def drawn(i: Column) -> Column:
        return F.transform(F.array(_uniforms(seed, *cols, i)), lambda u: F.struct(
            (F.sqrt(-2.0 * F.log(u[0])) * F.cos(F.lit(2.0 * math.pi) * u[1])).alias("z"),
            u[2].alias("u"), u[3].alias("boost")))[0]

    tries = F.transform(F.transform(F.sequence(F.lit(0), F.lit(GAMMA_TRIES - 1)), drawn), lambda x: F.struct(
        x["z"].alias("z"), x["u"].alias("u"), x["boost"].alias("boost"), F.pow(1.0 + c * x["z"], 3.0).alias("v")))
    taken = F.filter(tries, lambda x: F.when(x["v"] > 0, F.log(x["u"]) < x["z"] * x["z"] / 2.0 + d * (
        1.0 - x["v"] + F.log(x["v"]))).otherwise(False))
    return F.transform(F.array(F.coalesce(F.get(taken, F.lit(0)), F.raise_error(F.lit("no gamma draw")).cast(
        "struct<z:double,u:double,boost:double,v:double>"))),
        lambda x: F.log(d) + F.log(x["v"]) + F.log(x["boost"]) / alpha)[0]


def dirichlet_weights(categories: DataFrame, alphas: Sequence[str] = DEFAULT_ALPHAS,
                      reps: int = DEFAULT_REPS, seed: int = 42) -> DataFrame:
    """One Dirichlet(alpha, ..., alpha) draw per (alpha, rep) over categories.

    ``categories``: (category).  Output (subsample, alpha_text, alpha, rep,
    category, w) with sum(w) = 1 per subsample.  One row per cell (categories x draws), never over documents.
    """
    g = categories.select("category").distinct().withColumn("_d", F.explode(alpha_grid(alphas, reps)))
    g = g.select("category", "_d.*")
    g = g.withColumn("_lg", log_gamma_draw(F.col("alpha"), seed, "subsample", "category"))
    part = Window.partitionBy("subsample")
    g = g.withColumn("_e", F.exp(F.col("_lg") - F.max("_lg").over(part)))
    return g.select("subsample", "alpha_text", "alpha", "rep", "category",
                    (F.col("_e") / F.sum("_e").over(part)).alias("w"))


def flat_dirichlet_weights(categories: DataFrame, subsamples: Sequence[str], seed: int = 42) -> DataFrame:
    """Dirichlet(1, ..., 1) draws from normalised exponential spacings.

    Expressible in plain SQL (-ln U with U from md5), so it is the weight
    source of the SQL-checked allocation query.
    """
    g = categories.select("category").distinct().withColumn(
        "subsample", F.explode(F.array(*[F.lit(s) for s in subsamples])))
    u = (hash_u32(seed, "subsample", "category").cast("double") + 0.5) / 4294967296.0
    g = g.withColumn("_e", -F.log(u))
    return g.select("subsample", "category",
                    (F.col("_e") / F.sum("_e").over(Window.partitionBy("subsample"))).alias("w"))


def create_subsets(pool: DataFrame, n_total: int = DEFAULT_N, alphas: Sequence[str] = DEFAULT_ALPHAS,
                   reps: int = DEFAULT_REPS, seed: int = 42, category: str = "category",
                   id_col: str = "doc_id", include_missing_uniform: bool = True) -> tuple[DataFrame, DataFrame]:
    """All Dirichlet subsamples plus the uniform ones (alpha = inf) in one plan.

    Returns (members, allocation).  ``members`` keeps every pool column plus
    (subsample, alpha).  Dirichlet draws skip rows without a category (the
    reference's 'missing'); uniform draws keep them as their own category when
    ``include_missing_uniform``.
    """
    base = pool.withColumn("category", F.col(category)) if category != "category" else pool
    caps_d = category_caps(base, include_null=False)
    weights = dirichlet_weights(caps_d, alphas, reps, seed)
    # alpha is constant within a subsample, so it rides along as a key
    alloc_d = allocate_dirichlet(weights, caps_d, n_total, seed, carry=("alpha",))

    uni_pool = base.withColumn("category", F.coalesce(F.col("category"), F.lit("missing"))) \
        if include_missing_uniform else base
    caps_u = category_caps(uni_pool, include_null=False)
    alloc_u = allocate_uniform(caps_u, n_total).withColumn(
        "_s", F.explode(F.array(*[F.lit(subsample_name("inf", r)) for r in range(1, reps + 1)])))
    alloc_u = alloc_u.select(F.col("_s").alias("subsample"), "category", "cap",
                             F.lit(None).cast("double").alias("w"), "n",
                             F.lit(float("inf")).alias("alpha"))
    alloc = alloc_d.select("subsample", "category", "cap", "w", "n", "alpha").unionByName(alloc_u)
    # (subsamples x categories) rows, read by both draws and the final join:
    # materialise once so the gamma draws and windows are not re-run
    alloc = cut_lineage(alloc)
    is_inf = F.col("alpha") == float("inf")
    m_d = draw(base, alloc.where(~is_inf).select("subsample", "category", "n"), n_total, seed, id_col)
    m_u = draw(uni_pool, alloc.where(is_inf).select("subsample", "category", "n"), n_total, seed, id_col)
    members = m_d.unionByName(m_u)
    members = members.join(F.broadcast(alloc.select("subsample", "alpha").distinct()), "subsample")
    return members, alloc


def stratified_split(df: DataFrame, label: str = "label", test_fraction: float | None = None,
                     test_size: int | None = None, seed: int = 42, id_col: str = "doc_id",
                     keys: Sequence[str] | None = None) -> DataFrame:
    """Adds ``is_test``; test size exact, per-label quota by largest remainder.

    n_test = ceil(fraction * n) or ``test_size``; quota_c = floor(n_test * n_c / n)
    plus one for the labels with the largest remainders (ties by label).  The
    test rows of a label are its ``quota`` rows first in md5(seed|id) order.

    No label is ever ranked whole in one task: rows fall into 65,536 buckets by
    the first 16 bits of their hash (uniform, so no bucket is hot); bucket
    counts locate the boundary bucket per label, and only the rows of that one
    bucket are ranked.
    """
    k = _keys(keys)
    whole = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(1))
    h = df.withColumn("_h", hash_order(seed, id_col)) \
          .withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    # a row without a label belongs to no quota and stays a training row
    counts = h.where(F.col(label).isNotNull()).groupBy(*k, label, "_b").agg(F.count("*").alias("_cnt"))
    per_label = counts.groupBy(*k, label).agg(F.sum("_cnt").alias("_nc"))
    per_label = per_label.withColumn("_n", F.sum("_nc").over(whole))
    if test_size is not None:
        n_test = F.least(F.lit(test_size), F.col("_n"))
    else:
        n_test = F.ceil(F.lit(float(test_fraction)) * F.col("_n"))
    per_label = per_label.withColumn("_nt", n_test)
    exact = F.col("_nt") * F.col("_nc") / F.col("_n")
    per_label = per_label.withColumn("_q", F.floor(exact)).withColumn("_frac", exact - F.floor(exact))
    per_label = per_label.withColumn("_left", F.col("_nt") - F.sum("_q").over(whole))
    per_label = per_label.withColumn("_r", F.row_number().over(whole.orderBy(F.desc("_frac"), label)))
    per_label = per_label.withColumn(
        "quota", F.col("_q") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0))
    lw = Window.partitionBy(*k, label).orderBy("_b")
    cum = counts.withColumn("_cum", F.sum("_cnt").over(lw.rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.join(per_label.select(*k, label, "quota"), [*k, label])
    bound = (cum.where(F.col("_cum") >= F.col("quota"))
             .groupBy(*k, label, "quota")
             .agg(F.min(F.struct("_b", "_cum", "_cnt")).alias("_x"))
             .select(*k, label, "quota", F.col("_x._b").alias("_bb"),
                     (F.col("quota") - (F.col("_x._cum") - F.col("_x._cnt"))).alias("_need")))
    # labels whose quota is 0 have no boundary bucket: every row is training
    bound = per_label.select(*k, label, "quota").join(bound, [*k, label, "quota"], "left")
    t = h.join(F.broadcast(bound), [*k, label], "left")
    bb = F.coalesce(F.col("_bb"), F.lit(-1))
    outside = t.where(F.col("_b") != bb).withColumn("is_test", F.col("_b") < bb)
    inside = t.where(F.col("_b") == bb)
    inside = inside.withColumn("is_test", F.row_number().over(
        Window.partitionBy(*k, label).orderBy("_h", id_col)) <= F.col("_need"))
    return outside.unionByName(inside).drop("_h", "_b", "_bb", "_need", "quota")


def random_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """N rows in md5 order (a top-k, not a full sort)."""
    return df.orderBy(hash_order(seed, id_col), id_col).limit(n)


def create_scored_subsets(pool: DataFrame, score: Callable[[DataFrame], DataFrame], **options) -> tuple[DataFrame, DataFrame]:
    """D6 with a score: (members, scores).

    ``score`` takes the members of all subsamples and returns (subsample, vs, ...), one row per subsample, for instance
    :func:`varietas.operators.diversity.vendi_features`; scores are normalised by the largest (V5).
    ``options`` are those of :func:`create_subsets`.
    """
    from varietas.operators.diversity import score_table

    members, _ = create_subsets(pool, **options)
    members = cut_lineage(members)     # the score and the caller read it
    return members, score_table(score(members))
