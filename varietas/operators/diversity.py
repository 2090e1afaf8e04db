"""Vendi scores and distance profiles.

Vendi score of a sample with similarity matrix K (n x n):
exp(-sum(l * ln l)) over the eigenvalues l > 0 of K / n.

The n x n matrix is never built:

* Feature kernels (V1): rows with the same feature vector are identical, so
  the spectrum of K / n equals that of sqrt(p) K_g sqrt(p) over the g distinct
  feature vectors with weights p = count / n.  Spark groups to distinct
  features; one g x g eigenproblem per subsample runs in ``applyInPandas``.
  Above ``MAX_FEATURE_GROUPS`` the kernel is cut into blocks of columns.
* Cosine kernels (V2): with unit rows X, K = X X^T has the same non-zero
  spectrum as X^T X (d x d).  Each map task sums X^T X for the rows it holds
  (``mapInPandas``); Spark adds the partial Gram entries by key; one d x d
  eigenproblem per key.  A key holding a third of all rows is spread over all
  map tasks; the shuffle is (tasks x keys x d^2 / 2) numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StructField,
                               StructType)

from varietas.operators import spectrum
from varietas.session import cut_lineage

#: Distinct feature vectors up to which a kernel is one task's, and items up to which one goes to all tasks (larger ones
#: are cut into blocks); dimensions of V2.
MAX_FEATURE_GROUPS = 5_000
MAX_ITEMS = 2_048
MAX_DIM = 2_048


# --------------------------------------------------------------------------- numpy kernels
def entropy_score(eigenvalues: np.ndarray, q: float = 1.0) -> float:
    lam = np.asarray(eigenvalues, dtype=np.float64)
    lam = lam[lam > 1e-12]
    if lam.size == 0:
        return 0.0
    if q == 1.0:
        return float(np.exp(-np.sum(lam * np.log(lam))))
    return float(np.exp(np.log(np.sum(lam ** q)) / (1.0 - q)))


def feature_kernel(features: np.ndarray, metric: str = "l1") -> np.ndarray:
    diff = features[:, None, :] - features[None, :, :]
    if metric == "l1":
        dist = np.abs(diff).sum(-1)
    elif metric == "l2":
        dist = np.sqrt((diff ** 2).sum(-1))
    else:
        raise ValueError(f"unknown metric {metric}")
    return 1.0 / (1.0 + dist)


def weighted_vendi(kernel: np.ndarray, weights: np.ndarray, q: float = 1.0) -> float:
    """Vendi score of a sample given distinct-item kernel and item weights (sum 1)."""
    s = np.sqrt(np.asarray(weights, dtype=np.float64))
    m = kernel * s[:, None] * s[None, :]
    return entropy_score(np.linalg.eigvalsh(m), q)


def dense_vendi(kernel: np.ndarray, q: float = 1.0) -> float:
    """Plain n x n formula, for tests."""
    n = kernel.shape[0]
    return entropy_score(np.linalg.eigvalsh(kernel / n), q)


# --------------------------------------------------------------------------- V1
def vendi_features(df: DataFrame, keys: Sequence[str] = ("subsample",),
                   features: Sequence[str] = ("reliability", "bias"), metric: str = "l1",
                   q: float = 1.0, max_groups: int = MAX_FEATURE_GROUPS,
                   block_bytes: int = spectrum.BLOCK_BYTES) -> DataFrame:
    """V1 / V8: Vendi score with K = 1 / (1 + distance(features)) per key.

    Rows with a NULL feature are left out and counted in ``n_unrated``.  A key of more than ``max_groups`` distinct
    feature vectors is scored from blocks of its kernel (:mod:`varietas.operators.spectrum`), with the same result.
    Output: keys..., vs, n, n_groups, n_unrated.
    """
    if metric not in ("l1", "l2"):
        raise ValueError(f"unknown metric {metric}")
    keys = list(keys)
    feats = list(features)
    gkeys = keys if keys else ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(1))
    # one aggregation: rows with a NULL feature form their own groups and are counted apart (no second pass over the input)
    rated = F.lit(True)
    for f in feats:
        rated = rated & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    part = Window.partitionBy(*gkeys)
    grouped = cut_lineage(src.groupBy(*gkeys, *feats).agg(F.count("*").alias("_cnt"))
                          .withColumn("_rated", rated).withColumn("_g", F.count(F.when(F.col("_rated"), 1)).over(part)))
    key_fields = [f for f in grouped.schema.fields if f.name in gkeys]
    out_schema = StructType(key_fields + [StructField("vs", DoubleType()),
                                          StructField("n", LongType()),
                                          StructField("n_groups", IntegerType()),
                                          StructField("n_unrated", LongType())])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        rated = pdf["_rated"].to_numpy()
        n_unrated = int(pdf["_cnt"].to_numpy()[~rated].sum())
        r = pdf[rated]
        g = len(r)
        cnt = r["_cnt"].to_numpy(dtype=np.float64)
        n = cnt.sum()
        vs = weighted_vendi(feature_kernel(r[feats].to_numpy(dtype=np.float64), metric), cnt / n, q) \
            if g else float("nan")
        row = {k: pdf[k].iloc[0] for k in gkeys}
        row.update(vs=vs, n=int(n), n_groups=g, n_unrated=n_unrated)
        return pd.DataFrame([row])

    res = grouped.where(F.col("_g") <= max_groups).groupBy(*gkeys).applyInPandas(score, out_schema)
    largest = grouped.agg(F.max("_g")).first()[0] or 0
    if largest > max_groups:
        wide = grouped.where(F.col("_g") > max_groups)
        totals = wide.groupBy(*gkeys).agg(F.sum(F.when(F.col("_rated"), F.col("_cnt"))).alias("n"),
                                          F.first("_g").cast("int").alias("n_groups"),
                                          F.coalesce(F.sum(F.when(~F.col("_rated"), F.col("_cnt"))), F.lit(0)).alias("n_unrated"))
        blocks = spectrum.n_blocks(largest, block_bytes)
        make = spectrum.feature_blocks(wide.where("_rated"), gkeys, feats, "_cnt", metric, blocks)
        scores = spectrum.spectral_vendi(make, totals.select(*gkeys, F.lit(1.0).alias("trace")), gkeys, blocks, q)
        res = res.unionByName(_meet(scores, totals, gkeys).select([f.name for f in out_schema.fields]))
    return res.drop("_all") if not keys else res


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which some may be null; each key once."""
    b = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(b, same).drop(*[f"_r_{k}" for k in keys])


def feature_kernel_table(df: DataFrame, keys: Sequence[str] = (),
                         features: Sequence[str] = ("reliability", "bias"),
                         metric: str = "l1") -> DataFrame:
    """Kernel table (keys, features_i, features_j, p_i, p_j, k) over distinct features.

    Pairs are formed between the distinct feature vectors of one key only
    (g^2 rows, g bounded by the number of outlets), never between documents.
    """
    keys = list(keys)
    feats = list(features)
    rated = df.where(F.greatest(*[F.col(f).isNull().cast("int") for f in feats]) == 0) if len(feats) > 1 \
        else df.where(F.col(feats[0]).isNotNull())
    g = rated.groupBy(*keys, *feats).agg(F.count("*").alias("_cnt"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    g = g.withColumn("p", F.col("_cnt") / F.sum("_cnt").over(part)).drop("_cnt")
    a = g.select(*keys, *[F.col(f).alias(f + "_i") for f in feats], F.col("p").alias("p_i"))
    b = g.select(*keys, *[F.col(f).alias(f + "_j") for f in feats], F.col("p").alias("p_j"))
    if keys:
        pairs = a.join(b, keys)
    else:
        pairs = a.crossJoin(F.broadcast(b))
    if metric == "l1":
        dist = sum(F.abs(F.col(f + "_i") - F.col(f + "_j")) for f in feats)
    else:
        dist = F.sqrt(sum((F.col(f + "_i") - F.col(f + "_j")) ** 2 for f in feats))
    return pairs.withColumn("k", 1.0 / (1.0 + dist))


def vendi2_from_kernel(kernel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-2 Vendi score 1 / sum(p_i p_j k^2): plain SQL, used as the oracle twin."""
    keys = list(keys)
    agg = F.sum(F.col("p_i") * F.col("p_j") * F.col("k") * F.col("k"))
    return kernel.groupBy(*keys).agg((1.0 / agg).alias("vs2"))


# --------------------------------------------------------------------------- V2
def unit_rows(df: DataFrame, vec: str = "embedding", out: str = "_u") -> DataFrame:
    """Row-normalise a vector column (zero vectors stay zero)."""
    v = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    return df.withColumn(out, F.when(norm > 0, F.transform(v, lambda x: x / norm))
                         .otherwise(F.transform(v, lambda x: x * 0.0)))


def gram_partials(df: DataFrame, keys: Sequence[str], vec: str = "_u") -> DataFrame:
    """Upper-triangle Gram sums X^T X per key (i <= j) and the row count per key.

    Per map task: numpy X^T X over the rows it holds, then Spark sums the
    partials by (key, i, j).  Rows with i = -1 carry the count in ``g``.
    """
    keys = list(keys)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = StructType(key_fields + [StructField("i", IntegerType()), StructField("j", IntegerType()),
                                      StructField("g", DoubleType())])

    def part(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            grp = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for kv, sub in grp:
                kv = kv if isinstance(kv, tuple) else (kv,)
                x = np.stack(sub[vec].to_numpy()).astype(np.float64)
                if x.shape[1] > MAX_DIM:
                    raise ValueError(f"vector dimension {x.shape[1]} exceeds {MAX_DIM}; reduce it first")
                gm = x.T @ x
                if kv in acc:
                    acc[kv][0] += gm
                    acc[kv][1] += len(sub)
                else:
                    acc[kv] = [gm, len(sub)]
        for kv, (gm, cnt) in acc.items():
            iu, ju = np.triu_indices(gm.shape[0])
            frame = pd.DataFrame({"i": np.concatenate([[-1], iu]).astype(np.int32),
                                  "j": np.concatenate([[-1], ju]).astype(np.int32),
                                  "g": np.concatenate([[float(cnt)], gm[iu, ju]])})
            for name, val in zip(keys, kv):
                frame.insert(0, name, val)
            yield frame[[*keys, "i", "j", "g"]]

    return df.select(*keys, vec).mapInPandas(part, schema)


def gram_table(df: DataFrame, keys: Sequence[str] = (), vec: str = "embedding") -> DataFrame:
    """(keys..., i, j, g): sum over unit rows of x_i x_j, i <= j, plus i = j = -1 count."""
    keys = list(keys)
    u = unit_rows(df, vec)
    return gram_partials(u, keys).groupBy(*keys, "i", "j").agg(F.sum("g").alias("g"))


def vendi2_from_gram(gram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-2 score from a Gram table (upper triangle and count row): 1 / sum (g / n)^2.  Output keys, vs2, n."""
    keys = list(keys)
    body, size = F.col("i") >= 0, F.sum(F.when(F.col("i") < 0, F.col("g")))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    agg = gram.groupBy(*keys).agg(F.sum(F.when(body, twice * F.col("g") * F.col("g"))).alias("_s"), size.alias("_n"))
    return agg.select(*keys, (F.col("_n") * F.col("_n") / F.col("_s")).alias("vs2"), F.col("_n").cast("long").alias("n"))


def vendi_cosine(df: DataFrame, keys: Sequence[str] = (), vec: str = "embedding",
                 q: float = 1.0) -> DataFrame:
    """V2 / V3: Vendi score with cosine similarity, per key.  Output keys, vs, n."""
    keys = list(keys)
    gram = gram_table(df, keys, vec)
    gkeys = keys if keys else ["_all"]
    if not keys:
        gram = gram.withColumn("_all", F.lit(1))
    key_fields = [f for f in gram.schema.fields if f.name in gkeys]
    schema = StructType(key_fields + [StructField("vs", DoubleType()), StructField("n", LongType())])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        cnt_row = pdf[pdf["i"] == -1]
        n = float(cnt_row["g"].iloc[0])
        body = pdf[pdf["i"] >= 0]
        d = int(body["j"].max()) + 1
        gm = np.zeros((d, d))
        gm[body["i"].to_numpy(), body["j"].to_numpy()] = body["g"].to_numpy()
        gm = gm + np.triu(gm, 1).T
        vs = entropy_score(np.linalg.eigvalsh(gm / n), q)
        row = {k: pdf[k].iloc[0] for k in gkeys}
        row.update(vs=vs, n=int(n))
        return pd.DataFrame([row])

    out = gram.groupBy(*gkeys).applyInPandas(score, schema)
    return out.drop("_all") if not keys else out


def vendi_kernel_weights(weights: DataFrame, kernel: DataFrame, keys: Sequence[str] = ("subsample",),
                         item: str = "topic_nr", q: float = 1.0, max_items: int = MAX_ITEMS,
                         block_bytes: int = spectrum.BLOCK_BYTES) -> DataFrame:
    """V6: Vendi score of samples over items with a fixed item x item kernel.

    ``weights``: (keys..., item, cnt), one row an item; ``kernel``: (item_i, item_j, k) for all
    ordered pairs.  Used for topic subsamples: every member of a topic shares the
    topic vector, so only the t x t topic kernel and the counts matter.  A pair
    without a kernel entry is an error.  Items with a count of zero weigh nothing.

    A kernel of at most ``max_items`` items (counted first) goes to every task, which meets the keys' counts; a larger
    one is joined with them and scored from blocks (:mod:`varietas.operators.spectrum`), with the same result.
    """
    keys = list(keys)
    kernel = cut_lineage(kernel.select("item_i", "item_j", "k"))
    known = kernel.agg(F.count_distinct("item_i").alias("i"), F.count_distinct("item_j").alias("j")).first()
    key_fields = [f for f in weights.schema.fields if f.name in keys]
    schema = StructType(key_fields + [StructField("vs", DoubleType()), StructField("n", LongType())])
    if max(known["i"], known["j"]) <= max_items:
        table = kernel.dropDuplicates(["item_i", "item_j"]).toPandas()          # at most max_items^2 numbers
        rows = {v: t for t, v in enumerate(sorted(set(table["item_i"]) | set(table["item_j"])))}
        whole = np.full((len(rows), len(rows)), np.nan)
        whole[table["item_i"].map(rows).to_numpy(int), table["item_j"].map(rows).to_numpy(int)] = table["k"].to_numpy(np.float64)
        shared = weights.sparkSession.sparkContext.broadcast((rows, whole))

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            rows, whole = shared.value
            pdf = pdf.groupby(item, dropna=False, as_index=False).agg({"cnt": "sum", **{k: "first" for k in keys}})
            items, cnt = pdf[item].to_list(), pdf["cnt"].to_numpy(np.float64)
            at = np.array([rows.get(v, -1) for v in items])
            km = whole[np.ix_(at, at)].copy()
            km[at < 0, :] = np.nan
            km[:, at < 0] = np.nan
            lost = np.argwhere(np.isnan(km))
            if len(lost):
                raise ValueError(f"no kernel entry for items {items[lost[0][0]]}, {items[lost[0][1]]}")
            n = cnt.sum()
            vs = weighted_vendi(km, cnt / n, q) if n else float("nan")
            return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "vs": vs, "n": int(n)}])

        return weights.select(*keys, item, "cnt").groupBy(*keys).applyInPandas(score, schema)
    w = cut_lineage(weights.groupBy(*keys, item).agg(F.sum("cnt").alias("cnt")))
    wi = w.select(*keys, F.col(item).alias("item_i"), F.col("cnt").alias("c_i"))
    wj = w.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(item).alias("item_j"), F.col("cnt").alias("c_j"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    pairs = wi.join(wj, same).drop(*[f"_r_{k}" for k in keys]).join(kernel, ["item_i", "item_j"], "left")
    lost = F.raise_error(F.concat(F.lit("no kernel entry for items "), F.col("item_i").cast("string"), F.lit(", "),
                                  F.col("item_j").cast("string"))).cast("double")
    pairs = cut_lineage(pairs.withColumn("k", F.coalesce("k", lost)))
    totals = w.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    trace = _meet(pairs.where(F.col("item_i") == F.col("item_j")).groupBy(*keys).agg(F.sum(F.col("c_i") * F.col("k")).alias("_t")),
                  totals, keys).select(*keys, (F.col("_t") / F.col("n")).alias("trace"))
    blocks = spectrum.n_blocks(max(known["i"], known["j"]), block_bytes)
    scores = spectrum.spectral_vendi(spectrum.pair_blocks(pairs, keys, blocks), trace, keys, blocks, q)
    return _meet(scores, totals, keys).select(*keys, "vs", "n")


# --------------------------------------------------------------------------- V5
def score_table(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """V5: subsample, alpha, vs (3 dp), normalized_vs = round(vs / max(vs), 5)."""
    from varietas.functions.text import parse_alpha

    keys = list(keys)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    s = scores.withColumn("vs", F.round("vs", 3))
    return s.select(*keys, "subsample", parse_alpha("subsample").alias("alpha"), "vs",
                    F.round(F.col("vs") / F.max("vs").over(part), 5).alias("normalized_vs"))


# --------------------------------------------------------------------------- J9 / D7
def cosine_expr(a, b):
    """Cosine similarity of two array<double> columns (built-in higher-order functions)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    nb = F.sqrt(F.aggregate(F.transform(b, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def l2_expr(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda s, x: s + x))


#: Pivots of the distance index, and points among which the far ones are chosen.
PIVOTS, PIVOT_SAMPLE = 16, 512
#: Slack of the bounds for rounding.
_SLACK = 1e-7


def _straight(v, metric: str) -> np.ndarray | None:
    """The vector whose straight distances are searched: itself, or of length one under cosine (none for zero)."""
    x = np.asarray(v, np.float64)
    if metric == "l2":
        return x
    n = np.sqrt((x * x).sum())
    return x / n if n > 0 else None


class PivotIndex:
    """Points with their distances from a few pivots; the triangle inequality rules most others out.

    ``points`` has the columns of the input and _pd (distances from the pivots; null for a point that has
    none: no vector, or a zero vector under cosine), _cell (nearest pivot) and _near (distance from it).  Cosine is searched as the straight
    distance of unit vectors, sqrt(2 x cosine distance), which is a metric.
    """

    def __init__(self, points: DataFrame, metric: str = "cosine", vec: str = "embedding", id_col: str = "doc_id", seed: int = 42):
        from varietas.functions.hashing import hash_order

        if metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric {metric}")
        self.metric, self.vec, self.id_col = metric, vec, id_col
        some = (points.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
                .orderBy(hash_order(seed, F.lit("pivot"), id_col)).limit(PIVOT_SAMPLE).collect())     # a bounded sample
        self.pivots = self._far_apart([u for r in some if (u := _straight(r["v"], metric)) is not None])
        self.points = cut_lineage(self.measured(points))

    @staticmethod
    def _far_apart(sample: list[np.ndarray]) -> np.ndarray:
        """Each further pivot is the sample's point farthest from those before."""
        if not sample:
            return np.zeros((0, 0))
        x, chosen = np.stack(sample), [0]
        least = np.sqrt(((x - x[0]) ** 2).sum(1))
        while len(chosen) < min(PIVOTS, len(x)) and least.max() > 0:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
        return x[chosen]

    def measured(self, df: DataFrame) -> DataFrame:
        pivots, metric = self.pivots, self.metric

        def distances(vectors: pd.Series) -> pd.Series:
            units = [None if v is None or not len(pivots) else _straight(v, metric) for v in vectors]
            return pd.Series([None if u is None else np.sqrt(((pivots - u) ** 2).sum(1)) for u in units], dtype=object)
        pd_of = F.pandas_udf(distances, "array<double>")
        out = df.withColumn("_pd", pd_of(F.col(self.vec).cast("array<double>")))
        return out.withColumn("_near", F.array_min("_pd")).withColumn("_cell", (F.array_position("_pd", F.col("_near")) - 1).cast("int"))

    def candidates(self, anchors: DataFrame, radius: float) -> DataFrame:
        """(anchor_id, _a, id, _p): the pairs that no pivot rules out, by an equi-join on (cell, range of distances).

        An anchor asks, of every cell, for the ranges between its distance from the pivot less and plus the radius;
        a cell whose pivot is farther from it than another by over twice the radius holds nothing near.
        """
        r = float(np.sqrt(2 * radius) if self.metric == "cosine" else radius) + _SLACK if radius >= 0 else -1.0
        width = max(r, 1e-6)
        a = self.measured(anchors).select(F.col(self.id_col).alias("anchor_id"), F.col(self.vec).cast("array<double>").alias("_a"),
                                          F.col("_pd").alias("_ad"), F.col("_near").alias("_an"))
        p = self.points.select(self.id_col, F.col(self.vec).cast("array<double>").alias("_p"), "_pd", "_cell",
                               F.floor(F.col("_near") / width).alias("_range"))
        asks = a.where(F.col("_ad").isNotNull() & F.lit(r >= 0)).select("*", F.posexplode("_ad").alias("_cell", "_d"))
        asks = asks.where(F.col("_d") - F.col("_an") <= 2 * r)
        asks = asks.withColumn("_range", F.explode(F.sequence(F.floor(F.greatest(F.col("_d") - r, F.lit(0.0)) / width),
                                                              F.floor((F.col("_d") + r) / width))))
        met = p.join(asks, ["_cell", "_range"])
        possible = F.forall(F.zip_with("_pd", "_ad", lambda x, y: F.abs(x - y)), lambda d: d <= r)
        found = met.where(possible).select("anchor_id", "_a", self.id_col, "_p")
        if self.metric == "cosine" and radius >= 1.0:
            # a zero vector is at distance 1 from all: such pairs are part of the result, not a search
            every = self.points.where(F.col(self.vec).isNotNull())
            zero = a.where(F.col("_ad").isNull() & F.col("_a").isNotNull())
            for left, right in ((zero, every), (a.where(F.col("_ad").isNotNull()), every.where(F.col("_pd").isNull()))):
                found = found.unionByName(left.select("anchor_id", "_a").join(right.select(
                    self.id_col, F.col(self.vec).cast("array<double>").alias("_p")), how="cross"))
        return found


def within_radius(points: DataFrame | PivotIndex, anchors: DataFrame, radius: float, metric: str = "cosine",
                  vec: str = "embedding", id_col: str = "doc_id") -> DataFrame:
    """(anchor_id, id, dist) for every point within ``radius`` of an anchor, any number of anchors.

    The pivots' bounds choose the pairs, the distance itself decides.  ``points`` may be an index made before.
    """
    index = points if isinstance(points, PivotIndex) else PivotIndex(points, metric, vec, id_col)
    pairs = index.candidates(anchors, radius)
    dist = 1.0 - cosine_expr(F.col("_p"), F.col("_a")) if index.metric == "cosine" else l2_expr(F.col("_p"), F.col("_a"))
    return pairs.select("anchor_id", index.id_col, dist.alias("dist")).where(F.col("dist") <= radius)


def radius_sample(points: DataFrame, n: int, radius: float, seed: int = 42, batch: int = 32,
                  metric: str = "cosine", vec: str = "embedding", id_col: str = "doc_id") -> DataFrame:
    """First anchor (md5 order) with >= n points within r; n of them in md5 order.

    Candidates are tried ``batch`` at a time (doubling) until one qualifies or all points
    were tried.  If none qualifies, one status row has NULL ids and the largest number
    of points within the radius of any anchor.
    """
    from varietas.functions.hashing import hash_order

    tried, best_seen = None, 0
    index = PivotIndex(points, metric, vec, id_col)
    order = points.withColumn("_h", hash_order(seed, F.lit("anchor"), id_col))
    while True:
        rest = order if tried is None else order.where(
            (F.col("_h") > tried[0]) | ((F.col("_h") == tried[0]) & (F.col(id_col) > tried[1])))
        anchors = cut_lineage(rest.orderBy("_h", id_col).limit(batch))
        last = anchors.agg(F.max(F.struct("_h", id_col)).alias("m")).first()["m"]
        if last is None:
            kind = {f.name: f.dataType.simpleString() for f in points.schema.fields}[id_col]
            return points.sparkSession.createDataFrame([(None, None, None, best_seen)],
                                                       f"anchor_id {kind}, {id_col} {kind}, dist double, n_within long")
        near = within_radius(index, anchors, radius)
        counts = cut_lineage(near.groupBy("anchor_id").agg(F.count("*").alias("n_within")).join(
            anchors.select(F.col(id_col).alias("anchor_id"), "_h"), "anchor_id"))   # at most ``batch`` rows
        best_seen = max(best_seen, counts.agg(F.max("n_within")).first()[0] or 0)
        best = counts.where(F.col("n_within") >= n).orderBy("_h", "anchor_id").limit(1)
        if best.count():
            break
        tried, batch = (last["_h"], last[id_col]), batch * 2
    chosen = anchors.join(F.broadcast(best.select(F.col("anchor_id").alias(id_col))), id_col, "left_semi")
    near = within_radius(index, chosen, radius).join(F.broadcast(best.select("anchor_id", "n_within")), "anchor_id")
    w = Window.partitionBy("anchor_id").orderBy(hash_order(seed, F.lit("pick"), id_col), id_col)
    return (near.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= n))
            .select("anchor_id", id_col, "dist", "n_within"))
