"""Vendi scores of kernels too large for one task: parallel one-sided block Jacobi (V1, V6, V8).

The kernel M = sqrt(p) K sqrt(p) of n items lives in Spark as blocks of columns, at most ``block_bytes`` each.  A round
pairs every block with another one; each pair is one task, which turns its columns until they are orthogonal to each other
(the rotation comes from the singular value decomposition of their triangular factor, so small values keep their digits).
A sweep lets every block meet every other; when no task of a sweep finds two columns that still overlap, M V = U S holds
and the lengths of the columns are the singular values.  All n of them are found, none is estimated or left out.

For a kernel without negative eigenvalues these are its eigenvalues.  Otherwise their sum exceeds the trace; then
M + s I with s = the largest singular value, which has no negative ones, is decomposed and s taken off.

A task holds two blocks and their factor, a round moves the n x n numbers once, and a sweep has as many rounds as
blocks.  Each round is a written table, so a lost executor costs the tasks it ran, and the driver reads one number a sweep.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from varietas.session import cut_lineage

#: Bytes and columns of a block at most (narrow blocks make more tasks and less work), overlap (of the trace) below which
#: columns count as orthogonal, sweeps before giving up.
BLOCK_BYTES, WIDTH, OVERLAP, MAX_SWEEPS = 32 << 20, 256, 1e-11, 40


def n_blocks(n: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of columns for n items: n x width doubles fit ``block_bytes`` (a block has 1 to ``WIDTH`` columns)."""
    width = max(1, min(WIDTH, block_bytes // (8 * max(n, 1))))
    return max(1, -(-n // width))


def _block_schema(df: DataFrame, keys: Sequence[str]) -> StructType:
    fields = {f.name: f for f in df.schema.fields}
    return StructType([fields[k] for k in keys] + [StructField("_blk", IntegerType()), StructField("_cols", BinaryType()),
                                                   StructField("_n", IntegerType()), StructField("_off", DoubleType())])


def _row(pdf: pd.DataFrame, keys: Sequence[str], blk: int, cols: np.ndarray, off: float = 0.0) -> dict:
    return {**{k: pdf[k].iloc[0] for k in keys}, "_blk": blk, "_cols": cols.tobytes(), "_n": cols.shape[1], "_off": off}


def feature_blocks(items: DataFrame, keys: Sequence[str], features: Sequence[str], weight: str, metric: str,
                   blocks: int) -> Callable[[float], DataFrame]:
    """Column blocks of sqrt(p_i p_j) / (1 + distance) over distinct feature vectors; made from the features in the tasks."""
    keys, feats = list(keys), list(features)
    schema = _block_schema(items, keys)

    def make(shift: float) -> DataFrame:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            blk = int(pdf["_blk"].iloc[0])
            pdf = pdf.sort_values(feats)                 # the same order in every block
            x = pdf[feats].to_numpy(np.float64)
            s = np.sqrt(pdf[weight].to_numpy(np.float64) / pdf[weight].sum())
            own = np.arange(blk, len(x), blocks)
            dist = np.zeros((len(own), len(x)))
            for f in range(x.shape[1]):
                gap = np.abs(x[own, f][:, None] - x[None, :, f])
                dist += gap if metric == "l1" else gap * gap
            m = s[own][:, None] * s[None, :] / (1.0 + (dist if metric == "l1" else np.sqrt(dist)))
            m[np.arange(len(own)), own] += shift
            return pd.DataFrame([_row(pdf, keys, blk, m)])

        spread = items.select(*keys, *feats, weight, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_blk"))
        return spread.repartition(blocks, *keys, "_blk").groupBy(*keys, "_blk").applyInPandas(build, schema)

    return make


def pair_blocks(pairs: DataFrame, keys: Sequence[str], blocks: int) -> Callable[[float], DataFrame]:
    """Column blocks from kernel rows (keys..., item_i, item_j, c_i, c_j, k), every ordered pair of a key's items once."""
    keys = list(keys)
    schema = _block_schema(pairs, keys)

    def make(shift: float) -> DataFrame:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            wide = pdf.pivot(index="item_j", columns="item_i", values="k").sort_index(axis=1)
            counts = pdf.drop_duplicates("item_i").set_index("item_i")["c_i"].reindex(wide.columns).to_numpy(np.float64)
            s = pd.Series(np.sqrt(counts / counts.sum()), index=wide.columns)
            m = wide.to_numpy(np.float64) * s.loc[wide.index].to_numpy()[:, None] * s.to_numpy()[None, :]
            m[np.arange(len(wide)), wide.columns.get_indexer(wide.index)] += shift
            return pd.DataFrame([_row(pdf, keys, int(pdf["_blk"].iloc[0]), np.ascontiguousarray(m))])

        cut = pairs.withColumn("_blk", F.pmod(F.xxhash64("item_j"), F.lit(blocks)).cast("int"))
        return cut.repartition(blocks, *keys, "_blk").groupBy(*keys, "_blk").applyInPandas(build, schema)

    return make


def _turn(columns: np.ndarray) -> tuple[np.ndarray, float]:
    """The columns (as rows) turned to be orthogonal, longest first, and the largest overlap they had.

    The overlap of two columns is the length of the shorter one's projection on the longer one.
    """
    g = np.abs(columns @ columns.T)
    length = np.sqrt(np.diag(g))
    longer = np.maximum(length[:, None], length[None, :])
    np.fill_diagonal(g, 0.0)
    overlap = float((g / np.where(longer > 0, longer, 1.0)).max())
    _, _, vt = np.linalg.svd(np.linalg.qr(columns.T, mode="r"))
    return vt @ columns, overlap


def singular_values(table: DataFrame, keys: Sequence[str], blocks: int, overlap: float = OVERLAP,
                    max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """(keys..., value): all singular values of each key's matrix, from a table of column blocks."""
    keys = list(keys)
    schema = table.schema
    table = cut_lineage(table)
    last = blocks - 1 if blocks % 2 == 0 else blocks      # of an odd number one block rests in each round

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        parts = [np.frombuffer(c).reshape(-1, n) for c, n in zip(pdf["_cols"], pdf["_n"])]
        turned, off = _turn(np.concatenate(parts))
        off, at, out = max(off, float(pdf["_off"].max())), 0, []
        for blk, part in zip(pdf["_blk"], parts):
            out.append(_row(pdf, keys, int(blk), turned[at:at + len(part)], off))
            at += len(part)
        return pd.DataFrame(out)

    for _ in range(max_sweeps):
        table = table.withColumn("_off", F.lit(0.0))
        for r in range(last):
            # blocks x and y meet in round r if x + y = r (mod last); the one that would meet itself meets the last
            x = F.col("_blk")
            mirror = F.pmod(F.lit(r) - x, F.lit(last))
            mate = F.when(x == last, r * ((last + 1) // 2) % last).when(mirror == x, last).otherwise(mirror)
            met = table.withColumn("_pair", F.least(x, mate).cast("int"))
            met = met.repartition((blocks + 1) // 2, *keys, "_pair")
            table = cut_lineage(met.groupBy(*keys, "_pair").applyInPandas(meet, schema))
        if blocks <= 2 or (table.agg(F.max("_off")).first()[0] or 0.0) <= overlap:
            break
    else:
        raise RuntimeError(f"columns still overlap after {max_sweeps} sweeps")
    out_schema = StructType([f for f in schema.fields if f.name in keys] + [StructField("value", DoubleType())])

    def lengths(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                c = np.frombuffer(row["_cols"]).reshape(-1, row["_n"])
                frame = pd.DataFrame({"value": np.sqrt((c * c).sum(1))})
                for k in reversed(keys):
                    frame.insert(0, k, row[k])
                yield frame

    return cut_lineage(table.select(*keys, "_cols", "_n").mapInPandas(lengths, out_schema))


def spectral_vendi(make: Callable[[float], DataFrame], trace: DataFrame, keys: Sequence[str], blocks: int, q: float = 1.0,
                   overlap: float = OVERLAP) -> DataFrame:
    """(keys..., vs): Vendi score of order ``q`` from all eigenvalues; ``trace`` holds (keys..., trace) of each matrix."""
    keys = list(keys)
    values = singular_values(make(0.0), keys, blocks, overlap)
    sums = values.groupBy(*keys).agg(F.sum("value").alias("_sum"), F.max("value").alias("_top"))
    same = None
    for k in keys:
        one = F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
        same = one if same is None else same & one
    over = sums.alias("s").join(trace.alias("t"), same).where(F.col("_sum") > F.col("trace") * (1 + 1e-8) + 1e-9)
    shift = over.agg(F.max("_top")).first()[0]
    if shift is not None:                                # negative eigenvalues somewhere
        values = singular_values(make(float(shift)), keys, blocks, overlap).withColumn("value", F.col("value") - shift)
    lam = F.when(F.col("value") > 1e-12, F.col("value"))
    score = F.exp(-F.sum(lam * F.log(lam))) if q == 1.0 else F.exp(F.log(F.sum(F.pow(lam, F.lit(float(q))))) / (1.0 - q))
    return values.groupBy(*keys).agg(F.coalesce(score, F.lit(0.0)).alias("vs"))
