"""Mixing sources to target weights by balanced (cube-method) sampling.

Every document of a source gets the same expected number of copies; whole
copies are certain, the fraction is an inclusion probability.  The flight phase
moves these probabilities inside the null-space of two constraints (documents
and words) until they are 0 or 1, block by block; the few left over in each
block meet again in larger blocks, and the last one or two of a source are
landed on the nearest total (with one exchange of two documents).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import column, cut, numbered, packed

_EPS = 1e-9


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """Add ``target`` to ``totals(source, source_size)``, one row per source (null is one).

    Sources by code point, null last, have the repeating ``weights``.  Targets
    share ``share`` times all sizes by weight; a target stops at ``cap`` times
    its source's size, and the excess is reshared by weight among the rest until
    none is above.  The loop runs one aggregation per round; no table passes
    through one task (the source number is a distributed index).
    """
    keyed = totals.withColumn("_last", F.col("source").isNull())
    ranked = numbered(keyed, [], ["_last", "source"], "_i").drop("_last")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    t = cut(ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap))))
    whole = float(t.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = None, None
    while True:
        # the sources that reach their cap at this level leave with it; the rest share what remains
        is_full = F.lit(False) if level is None else F.col("_cap") <= F.lit(level) * F.col("_w")
        r = t.agg(F.sum(F.when(is_full, F.col("_cap")).otherwise(0.0)).alias("used"),
                  F.sum(F.when(is_full, 0.0).otherwise(F.col("_w"))).alias("w"),
                  F.sum(is_full.cast("int")).alias("full")).first()
        if not r["w"] or r["full"] == full:
            break
        full, level = r["full"], max(0.0, whole - r["used"]) / r["w"]
    lev = F.lit(float("inf") if level is None else level)
    return t.withColumn("target", F.when(F.col("_cap") <= lev * F.col("_w"), F.col("_cap"))
                        .otherwise(lev * F.col("_w"))).drop("_i", "_w", "_cap")


def _flight(pi: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> list[int]:
    """Move ``pi`` in place until at most two entries are fractional; returns their places.

    Three units are active at a time.  The null-space of (1, 1, 1) and of
    their sizes is the cross product of both rows; each step ends with one of
    them at 0 or 1, and the next unit takes its place.
    """
    p, draws, at, n = pi.tolist(), rng.random(2 * len(pi) + 4).tolist(), 0, len(pi)
    sizes, nxt, active = z.tolist(), 0, []
    while True:
        while len(active) < 3 and nxt < n:
            if _EPS < p[nxt] < 1 - _EPS:
                active.append(nxt)
            nxt += 1
        if len(active) < 2:
            break
        if len(active) == 3:
            a, b, c = (sizes[k] for k in active)
            u = [c - b, a - c, b - a]
            if a == b == c:
                u = [1.0, -1.0, 0.0]
        elif sizes[active[0]] == sizes[active[1]]:
            u = [1.0, -1.0]
        else:
            break                       # two units of different size: left for the landing
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(active, u) if x)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(active, u) if x)
        step = up if draws[at % len(draws)] * (up + down) < down else -down
        at += 1
        for k, x in zip(active, u):
            v = p[k] + step * x
            p[k] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
        active = [k for k in active if _EPS < p[k] < 1 - _EPS]
    pi[:] = p
    return [k for k in active if _EPS < p[k] < 1 - _EPS]


def _land(pi: np.ndarray, z: np.ndarray, left: list[int]) -> None:
    """The last units of a source: of all roundings the one with the nearest word total, then document total.

    One exchange of a chosen and an unchosen unit follows where it brings the words nearer (documents stay).
    """
    want = float(pi @ z)
    want_n = float(pi[left].sum())
    pi[left] = 0
    rest = want - float(pi @ z)
    best = min(range(1 << len(left)), key=lambda m: (
        abs(sum(z[k] for i, k in enumerate(left) if m >> i & 1) - rest), abs(bin(m).count("1") - want_n), m))
    for i, k in enumerate(left):
        pi[k] = best >> i & 1
    ones, zeros = np.flatnonzero(pi > 0.5), np.flatnonzero(pi < 0.5)
    if not len(ones) or not len(zeros):
        return
    over = float(pi @ z) - want
    zeros = zeros[np.argsort(z[zeros], kind="stable")]
    sought = z[ones] - over                       # size of the unit to take instead
    near = np.searchsorted(z[zeros], sought)
    pairs = [(abs(sought[i] - z[zeros[j]]), i, j) for i in range(len(ones))
             for j in (near[i] - 1, near[i]) if 0 <= j < len(zeros)]
    gap, i, j = min(pairs)
    if gap < abs(over):
        pi[ones[i]], pi[zeros[j]] = 0, 1


def _block(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # largest first, so that what stays fractional is small
        pdf = pdf.sort_values(["size", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        pi, z = pdf["pi"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        name = f"{seed}/{level}/{pdf['source'].iloc[0]!r}/{pdf['block'].iloc[0]}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        left = _flight(pi, z, rng)
        if pdf["blocks"].iloc[0] == 1:
            _land(pi, z, left)
        pdf["pi"] = pi
        return pdf[["row", "uid", "source", "size", "pi"]]
    return run


def balanced_sample(units: DataFrame, seed: int = 7, block_rows: int = 4096) -> DataFrame:
    """``units(row, uid, source, size, pi)`` with ``0 <= pi <= 1`` to (row, taken 0 / 1).

    ``row`` names a row, ``uid`` (a hash of its content) deals it to a block.
    Blocks hold about ``block_rows`` rows, so a source with a third of all rows
    is spread like any other; each round leaves at most two rows per block, and
    the rounds end when every source fits one block.
    """
    fixed = (F.col("pi") <= _EPS) | (F.col("pi") >= 1 - _EPS)
    out = units.where(fixed).select("row", (F.col("pi") > 0.5).cast("int").alias("taken"))
    open_units, level = units.where(~fixed), 0
    while True:
        n = open_units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        n = n.select(F.col("source").alias("_s"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"))
        most = n.agg(F.max("blocks")).first()[0] or 0
        if not most:
            return out
        dealt = open_units.join(n, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
            "block", F.pmod(F.xxhash64("uid", F.lit(level)), F.col("blocks")))
        moved = cut(dealt.groupBy("source", "block").applyInPandas(
            _block(seed, level), "row long, uid long, source string, size long, pi double"))
        out = out.unionByName(moved.where(fixed).select("row", (F.col("pi") > 0.5).cast("int").alias("taken")))
        if most == 1:
            return out
        open_units, level = moved.where(~fixed), level + 1


def mix(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", text_hash: Column | None = None,
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7,
        block_rows: int = 4096) -> DataFrame:
    """How many copies of every row the mix takes.

    Returns one row per row of ``docs``: id, source, size (long),
    source_size (long), target (double), copies (long, 0 .. ceil(cap)).
    Reruns agree: the draws depend on ``seed``, the source and the rows' content only.

    Cases: null text or size counts 0; a null source is one source, last in
    order; a source of size 0 has target 0 and no copies; repeated rows are
    rows of their own; an empty table gives an empty result; further columns
    are ignored.
    """
    uid = F.xxhash64(F.col(id_col).cast("string"), text_hash if text_hash is not None else size)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                           F.coalesce(size, F.lit(0)).cast("long").alias("size"), uid.alias("uid"))
               .withColumn("row", F.monotonically_increasing_id()))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(cut(totals), weights, share, cap))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    with_t = rows.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    with_t = with_t.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    units = with_t.select("row", "uid", "source", "size", (F.col("rate") - F.col("whole")).alias("pi"))
    taken = balanced_sample(units, seed, block_rows).select(F.col("row").alias("_r"), "taken")
    return (with_t.join(taken, F.col("row") == F.col("_r"))
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                    (F.col("whole") + F.col("taken")).alias("copies")))


def take(docs: DataFrame, size: Column, text_hash: Column, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, all columns kept.

    Rows equal in id, source and text hash are interchangeable: the first of them stands for all, as often as they are taken
    together.  The other cases are those of :func:`mix`.
    """
    rows = docs.select(packed(docs), size.alias("size"), text_hash.alias("hash"), column(source_col).cast("string").alias("source"),
                       F.struct(column(id_col).alias("i"), text_hash.alias("h"), column(source_col).alias("s")).cast("string").alias("key"))
    got = mix(rows, F.col("size"), id_col="key", text_hash=F.col("hash"), **options)
    taken = cut(got.groupBy(F.col("key").alias("of")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0"))
    met = rows.join(taken, F.col("key") == F.col("of"))
    if taken.where("n > 1").limit(1).count():
        met = met.dropDuplicates(["key"])
    out = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
