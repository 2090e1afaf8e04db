"""Hard-negative mining with Kronecker-packed products.

Vectors are integers.  Several candidates' components, biased to be non-negative, are packed
into separated fields of one wide integer per dimension; one
multiplication by an anchor's (biased) component multiplies all fields at once, and the
sum over the dimensions holds every candidate's inner product in its own
field, so wide that no field reaches the next.  Unpacking and taking the bias
off gives exact scores.

A wide integer of at most 53 bits is held in a double, where sums and products of
integers are exact and the multiplication is a matrix product; larger
fields use Python's integers of any width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varietas.llm.common import cut, numbered

#: Bits that a double's integers have exactly.
EXACT_BITS = 53
#: Candidates in one integer where fields need more than that.
WIDE_FIELDS = 16
#: Anchors scored by one job, and candidate rows scored at a time.
ANCHOR_BLOCK = 2048
ROW_BLOCK = 2048
#: Hits that are ranked at a time.
HIT_BLOCK = 1 << 18
_LONG = (1 << 63) - 1


def integer_vector(c: Column, scale: int = 256) -> Column:
    """floor(scale * component) of a vector as bigint; null if the vector or a component is null or not finite."""
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(good, F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("bigint")))


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of ``dim`` int64 components; what a shorter vector lacks is 0."""
    out = np.zeros((len(vectors), dim), np.int64)
    sizes = np.fromiter((len(v) for v in vectors), np.int64, len(vectors))
    if len(sizes) and sizes.min() == sizes.max() == dim and dim:
        out[:] = np.stack([np.asarray(v, np.int64) for v in vectors])
    else:
        for i, v in enumerate(vectors):
            out[i, :len(v)] = v
    return out


class Packing:
    """Layout of the fields for components between ``low`` and ``high`` in ``dim`` dimensions."""

    def __init__(self, low: int, high: int, dim: int):
        self.low, self.dim = int(low), int(dim)
        most = max(1, self.dim) * (int(high) - self.low) ** 2      # largest biased inner product
        self.width = max(1, most.bit_length())
        self.wide = self.width > EXACT_BITS
        self.fields = WIDE_FIELDS if self.wide else EXACT_BITS // self.width
        self.large = max(1, self.dim) * max(abs(int(high)), abs(self.low)) ** 2 >= 1 << 62

    def biased(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(object) if self.wide else x) - self.low

    def pack(self, x: np.ndarray) -> np.ndarray:
        """(rows, dim) -> (ceil(rows / fields), dim) wide integers."""
        b = self.biased(x)
        lacking = -len(b) % self.fields
        if lacking:
            b = np.concatenate([b, np.zeros((lacking, self.dim), b.dtype)])
        b = b.reshape(-1, self.fields, self.dim)
        shift = [1 << (self.width * f) for f in range(self.fields)]
        packed = sum(b[:, f] * shift[f] for f in range(self.fields))
        return packed if self.wide else packed.astype(np.float64)

    def scores(self, packed: np.ndarray, n: int, row_sums: np.ndarray, anchors: np.ndarray, anchor_sums: np.ndarray) -> np.ndarray:
        """Exact inner products (n rows x anchors) from packed rows and biased anchors (anchors x dim)."""
        if self.wide:
            products = packed.dot(anchors.T)
        else:
            products = (packed @ anchors.T.astype(np.float64)).astype(np.int64)
        mask = (1 << self.width) - 1
        out = np.empty((len(packed), self.fields, anchors.shape[0]), products.dtype)
        for f in range(self.fields):
            out[:, f] = (products >> (self.width * f)) & mask
        # sum (x-l)(a-l) = sum xa - l sum x - l sum a + dim l^2
        out = out.reshape(-1, anchors.shape[0])[:n]
        out = out + self.low * (row_sums[:, None] + anchor_sums[None, :]) - self.dim * self.low ** 2
        if self.wide:
            out = np.clip(out, -_LONG - 1, _LONG) if self.large else out
            out = out.astype(np.int64)
        return out


class Anchors:
    """A bounded block of anchors, ready to be scored against any rows."""

    def __init__(self, ids, labels, x: np.ndarray, packing: Packing):
        self.ids = np.asarray(ids, np.int64)
        self.codes = {v: i for i, v in enumerate(sorted(set(labels)))}
        self.labels = np.array([self.codes[v] for v in labels], np.int64)
        self.packing = packing
        self.x = packing.biased(x)
        self.sums = x.astype(object).sum(axis=1) if packing.wide else x.sum(axis=1)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, label codes, scores) of at most ``ROW_BLOCK`` rows at a time; a label no anchor has is -1."""
        p = self.packing
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                rows = batch.slice(at, ROW_BLOCK).to_pandas()
                x = matrix(rows["x"], p.dim)
                sums = x.astype(object).sum(axis=1) if p.wide else x.sum(axis=1)
                codes = rows["label"].map(self.codes).fillna(-1).to_numpy(np.int64)
                yield rows["id"].to_numpy(np.int64), codes, p.scores(p.pack(x), len(x), sums, self.x, self.sums)


def _best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k of every group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, ~scores, group))     # ~s = -s-1 falls as s rises and cannot overflow
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[nth < k]


class _Running:
    """The best k of every group so far, and the score from which a new one can count."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, -_LONG - 1, np.int64)
        self.group = self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        group, ids, scores = np.r_[self.group, group], np.r_[self.ids, ids], np.r_[self.scores, scores]
        keep = _best(group, ids, scores, self.k)
        self.group, self.ids, self.scores = group[keep], ids[keep], scores[keep]
        full = np.bincount(self.group, minlength=len(self.floor)) >= self.k
        last = np.flatnonzero(np.r_[self.group[1:] != self.group[:-1], True]) if len(self.group) else []
        lowest = np.full(len(self.floor), -_LONG - 1, np.int64)
        lowest[self.group[last]] = self.scores[last]
        self.floor = np.where(full, lowest, self.floor)


def _positives(anchors: Anchors, k: int):
    """Task function: the best k rows of every anchor's label among the task's rows."""
    def run(batches):
        best = _Running(len(anchors.ids), k)
        for ids, codes, s in anchors.blocks(batches):
            hit = (codes[:, None] == anchors.labels[None, :]) & (s >= best.floor[None, :]) & (ids[:, None] != anchors.ids[None, :])
            r, a = np.nonzero(hit)
            for i in range(0, len(r), HIT_BLOCK):
                rr, aa = r[i:i + HIT_BLOCK], a[i:i + HIT_BLOCK]
                best.add(aa, ids[rr], s[rr, aa])
        yield pa.record_batch([pa.array(anchors.ids[best.group]), pa.array(best.ids), pa.array(best.scores)],
                              names=["anchor_id", "id", "score"])
    return run


def _negatives(anchors: Anchors, pos_anchor: np.ndarray, pos_id: np.ndarray, pos_score: np.ndarray, least: np.ndarray, k: int):
    """Task function: the best k rows of another label in the band of every (anchor, positive)."""
    n_a, n_p = len(anchors.ids), len(pos_id)
    # positives of an anchor side by side; an empty place has an empty band
    nth = np.arange(n_p) - np.searchsorted(pos_anchor, pos_anchor)
    most = int(nth.max()) + 1 if n_p else 1
    high = np.full((n_a, most), -_LONG - 1, np.int64)
    low, pair = np.full((n_a, most), _LONG, np.int64), np.zeros((n_a, most), np.int64)
    high[pos_anchor, nth], low[pos_anchor, nth], pair[pos_anchor, nth] = pos_score, least, np.arange(n_p)
    top, bottom = high.max(axis=1), low.min(axis=1)

    def run(batches):
        best = _Running(n_p, k)
        for ids, codes, s in anchors.blocks(batches):
            r, a = np.nonzero((s <= top[None, :]) & (s >= bottom[None, :]) & (codes[:, None] != anchors.labels[None, :]))
            for i in range(0, len(r), HIT_BLOCK):
                rr, aa = r[i:i + HIT_BLOCK], a[i:i + HIT_BLOCK]
                v = s[rr, aa]
                h, j = np.nonzero((v[:, None] <= high[aa]) & (v[:, None] >= np.maximum(low[aa], best.floor[pair[aa]])))
                best.add(pair[aa[h], j], ids[rr[h]], v[h])
        g = best.group
        yield pa.record_batch([pa.array(anchors.ids[pos_anchor[g]]), pa.array(pos_id[g]), pa.array(pos_score[g]),
                               pa.array(best.ids), pa.array(best.scores)],
                              names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


_OUT = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, 
         low_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows(id bigint, label, x array<bigint>)``.

    A score is the integer inner product with the anchor; higher scores come first, ties by smaller id.  Positives
    are the first ``n_positives`` other rows of the anchor's label; for each, the first ``n_negatives`` rows of another label with
    low_percent * positive <= 100 * negative <= 100 * positive are returned.  ``is_anchor`` is a condition on the columns.

    Cases: rows with a null id, label or vector take no part; an id stands for one row (of several, that with the smallest
    label, then vector); a shorter vector lacks components, which count as 0; an anchor without positives, and a positive without
    negatives (each with a negative score), give no rows; scores beyond 64 bits are held at the limits of a
    bigint; an empty table gives an empty result; further columns are ignored.

    Scale: anchors are the stated query set, scored against all rows in blocks of ``ANCHOR_BLOCK`` anchors, a few MB that
    go to every task; a task keeps at most ``n_positives * n_negatives`` rows an anchor, and
    only those are shuffled.  Every block makes two passes over the rows: for the positives and for the bands they set.
    """
    rows = rows.select("id", F.col("label").cast("string").alias("label"), "x", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = cut(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = cut(rows.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.*"))
    spark = rows.sparkSession
    seen = rows.agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"), F.max(F.size("x")).alias("dim"),
                    F.count_if("anchor").alias("anchors")).first()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    empty = spark.createDataFrame([], f"{_OUT}, rank int").select(*columns)
    if not seen["anchors"]:
        return empty
    # 0 is a component of shorter vectors
    packing = Packing(min(seen["low"] or 0, 0), max(seen["high"] or 0, 0), seen["dim"])
    placed = cut(numbered(rows.where("anchor"), [], ["id"], "place"))
    parts = rows.select("id", "label", "x")
    made = []
    for at in range(0, seen["anchors"], ANCHOR_BLOCK):
        block = placed.where(F.col("place").between(at, at + ANCHOR_BLOCK - 1)).orderBy("id").collect()   # at most ANCHOR_BLOCK rows
        anchors = Anchors([r["id"] for r in block], [r["label"] for r in block],
                          matrix(pd.Series([r["x"] for r in block]), packing.dim), packing)
        near = parts.mapInArrow(_positives(anchors, n_positives), "anchor_id bigint, id bigint, score bigint")
        order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
        near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n_positives)
        pos = near.orderBy("anchor_id", "nth").collect()          # at most ANCHOR_BLOCK * n_positives rows
        pos = [(r["anchor_id"], r["id"], r["score"]) for r in pos if r["score"] >= 0]
        if not pos:
            continue
        a, p, s = (np.array(c, np.int64) for c in zip(*pos, strict=True))
        least = np.array([-(-low_percent * v // 100) for v in s.tolist()], np.int64)
        task = _negatives(anchors, np.searchsorted(anchors.ids, a), p, s, least, n_negatives)
        best = parts.mapInArrow(task, _OUT)
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).select(*columns)
        made.append(best if seen["anchors"] <= ANCHOR_BLOCK else cut(best))
    out = made[0] if made else empty
    for more in made[1:]:
        out = out.unionByName(more)
    return out
