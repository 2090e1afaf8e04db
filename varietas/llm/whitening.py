"""Embedding whitening: principal components by FEAST contour integration.

Spark makes the fit list, its sums, its covariance, the solves of the quadrature's points, and the
projection of every row.  FEAST then finds all eigenpairs in an interval of the spectrum: the
contour integral of (zI - V)^-1 Y around the interval, by quadrature, projects random vectors Y onto
the wanted eigenvectors; Rayleigh-Ritz takes eigenpairs from that subspace; the number
in the interval is known beforehand from inertia (Sylvester: the signs of a
factorisation of V - sI count the eigenvalues on either side of s), so none is missed.

Only matrices of the vectors' dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm.common import cut
from varietas.llm.negatives import matrix

#: The covariance has this many dimensions at most (128 MB as doubles).
MAX_DIM = 4096
#: Points of the quadrature on the upper half of the contour.
POINTS = 8
_CHUNK = 4096
_LONG = (1 << 63) - 1


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(at, _CHUNK)
            yield part, matrix(part.column(part.schema.get_field_index("x")).to_pandas(), dim)


def totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension of ``fit(x array<bigint>)``."""
    def run(batches):
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, object)
        for _, x in _chunks(batches, dim):
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)                  # lower and upper halves: no sum overflows
            high += (x >> 32).sum(axis=0).astype(object)
            high, low = high + (low >> 32).astype(object), low & 0xFFFFFFFF
        yield pa.record_batch([pa.array(range(-1, dim), pa.int32()),
                               pa.array([str(n)] + [str((h << 32) + int(v)) for h, v in zip(high.tolist(), low.tolist(), strict=True)])],
                              names=["i", "v"])
    got = fit.select("x").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    by = {r["i"]: int(r["v"]) for r in got.collect()}            # dim + 1 rows
    return by.get(-1, 0), [by.get(i, 0) for i in range(dim)]


def covariance(rows: DataFrame, mean: np.ndarray, n: int, to: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of ``rows(x)``, centred on ``mean`` before multiplying; with ``to``, of (x - mean) @ to."""
    dim, out = len(mean), len(mean) if to is None else to.shape[1]
    upper = np.triu_indices(out)

    def run(batches):
        total = np.zeros((out, out))
        for _, x in _chunks(batches, dim):
            c = x - mean
            c = c if to is None else c @ to
            total += c.T @ c
        yield pa.record_batch([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["i", "v"])
    got = rows.select("x").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    cells = np.zeros(len(upper[0]))                               # at most dim * (dim + 1) / 2
    for r in got:
        cells[r["i"]] = r["v"]
    v = np.zeros((out, out))
    v[upper] = cells / n
    return v + np.triu(v, 1).T


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        u = x / np.linalg.norm(x)
        s = a[k + 1:, k:]
        s -= 2 * np.outer(u, u @ s)
        s = a[k:, k + 1:]
        s -= 2 * np.outer(s @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diag: np.ndarray, off: np.ndarray, s: float) -> int:
    """Inertia count: eigenvalues greater than ``s``, the positive pivots of the factorisation of T - sI."""
    tiny = np.finfo(float).eps * max(np.abs(diag).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    n, pivot = 0, 1.0
    for i in range(len(diag)):
        pivot = diag[i] - s - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        n += pivot > 0
    return n


def interval_of_largest(v: np.ndarray, want: int) -> tuple[float, float, int]:
    """(low, high, count): an interval with the ``want`` largest eigenvalues and the number that it holds.

    Its lower end lies in a gap of the spectrum, so eigenvalues that (nearly) equal the last one wanted are inside.
    """
    diag, off = tridiagonal(v)
    pad = np.r_[0.0, np.abs(off), 0.0]
    top = float((diag + pad[:-1] + pad[1:]).max())
    bottom = float((diag - pad[:-1] - pad[1:]).min())
    spread = max(top - bottom, np.finfo(float).tiny)
    top, bottom = top + 0.01 * spread, bottom - 0.01 * spread

    def nth(k: int) -> float:                 # the k-th largest eigenvalue, by bisection on the count
        low, high = bottom, top
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if above(diag, off, mid) >= k else (low, mid)
        return (low + high) / 2
    k, last = want, nth(want)
    while k < len(v):
        after = nth(k + 1)
        if last - after > 1e-4 * spread:
            return (last + after) / 2, top, k
        k, last = k + 1, after
    return bottom, top, len(v)


def quadrature_points(spark: SparkSession, points: int) -> DataFrame:
    """(id): a task a point, without a shuffle: the partitions are the points, whatever the session's shuffle partitions."""
    return spark.range(0, points, 1, points)


def feast(spark: SparkSession, v: np.ndarray, low: float, high: float, count: int, points: int = POINTS,
          rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of ``v`` in (low, high), largest first.

    ``count`` is their number by inertia; another number, or residuals that do not fall to rounding, are an error.
    Each round solves the ``points`` shifted systems as Spark tasks.
    """
    dim = len(v)
    block = min(dim, count + max(4, count // 2))
    y = np.random.default_rng(20).standard_normal((dim, block))
    nodes, weights = np.polynomial.legendre.leggauss(points)
    centre, radius = (low + high) / 2, (high - low) / 2
    frame = quadrature_points(spark, points)
    scale = max(float(np.abs(v).sum(axis=1).max()), np.finfo(float).tiny)
    best = (np.inf, None, None)
    for _ in range(rounds):
        def solve(parts, y=y):
            for part in parts:
                for point in part["id"].tolist():
                    turn = np.exp(1j * np.pi / 2 * (1 - nodes[point]))        # upper half circle
                    x = np.linalg.solve((centre + radius * turn) * np.eye(dim) - v, y.astype(complex))
                    q = (weights[point] / 2 * radius * turn * x).real
                    yield pd.DataFrame({"point": point, "column": range(block), "q": list(q.T)})
        got = frame.mapInPandas(solve, "point int, column int, q array<double>").collect()    # points x block vectors
        q = np.zeros((dim, block))
        for r in sorted(got, key=lambda r: (r["point"], r["column"])):
            q[:, r["column"]] += r["q"]
        q, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(q.T @ v @ q)                           # Rayleigh-Ritz
        order = np.argsort(values)[::-1]
        values, vectors = values[order], q @ small[:, order]
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max(initial=0.0) / scale
        if inside.sum() == count:
            if residual >= best[0] / 2 and best[0] < 1e-12:                   # no longer falls: rounding
                return best[1], best[2]
            if residual < best[0]:
                best = (residual, values[inside], vectors[:, inside])
            if residual < 1e-16:
                return best[1], best[2]
        y = vectors
    if best[0] < 1e-12:
        return best[1], best[2]
    raise ArithmeticError(f"{count} eigenvalues are in the interval; the subspace has {int(inside.sum())}, residual {residual:.1e}")


def components(spark: SparkSession, v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues above rounding and their unit eigenvectors; each vector's largest entry is positive."""
    if not len(v) or not np.abs(v).max():
        return np.zeros(0), np.zeros((len(v), 0))
    want = min(want, len(v))
    values, vectors = feast(spark, v, *interval_of_largest(v, want))
    keep = np.flatnonzero(values > len(v) * 1e-14 * values[0])[:want]
    values, vectors = values[keep], vectors[:, keep]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(keep))]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def whiten(rows: DataFrame, want: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row of ``rows(id, x array<bigint>)``.

    The fit list is each distinct vector once.  ``deviation`` is the sum over the dimensions of (n * x - S)^2, exact (null beyond 64 bits);
    ``whitened`` the centred vector on the component over the root of its eigenvalue; ``identity_error`` the largest
    absolute entry of the whitened fit list's covariance minus the identity.

    Cases: rows with a null vector take no part; null and repeated ids are rows like others; a shorter vector's lacking components are 0;
    components without variance (fewer distinct vectors than components, equal vectors, vectors without entries) are left out, so
    a table of one distinct vector gives no rows, as does an empty one; further columns are ignored.

    Scale: three passes over the distinct vectors and one over the rows; copies are made distinct
    before they are shuffled.  The driver holds matrices of the dimension (at most ``MAX_DIM``).
    """
    spark = rows.sparkSession
    rows = rows.select("id", "x").where(F.col("x").isNotNull())
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions; a covariance of more than {MAX_DIM} does not fit a task")
    schema = ("id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
              .replace("id bigint", f"id {dict(rows.dtypes)['id']}", 1))
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("x")))
    fit = cut(rows.select(padded.alias("x")).distinct())
    n, sums = totals(fit, dim)
    if not n or not dim:
        return spark.createDataFrame([], schema)
    mean = np.array([s / n for s in sums])
    v = covariance(fit, mean, n)
    values, vectors = components(spark, v, want)
    if not len(values):
        return spark.createDataFrame([], schema)
    to = vectors / np.sqrt(values)
    error = float(np.abs(covariance(fit, mean, n, to) - np.eye(len(values))).max())
    explained = values / np.trace(v)
    largest = fit.agg(F.max(F.greatest(F.abs(F.array_max("x").cast("decimal(20,0)")), F.abs(F.array_min("x").cast("decimal(20,0)"))))).first()[0]
    fits = dim * (2 * n * int(largest)) ** 2 <= _LONG
    k = len(values)

    def project(batches):
        for part, x in _chunks(batches, dim):
            d = (x if fits else x.astype(object)) * n - np.array(sums, np.int64 if fits else object)
            deviation = (d * d).sum(axis=1)
            z = (x - mean) @ to
            row = np.repeat(np.arange(len(x)), k)
            ids = part.column(part.schema.get_field_index("id")).take(pa.array(row))
            dev = [int(i) if i <= _LONG else None for i in np.repeat(deviation, k)]
            yield pa.record_batch([ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(row), n)),
                                   pa.array(dev, pa.int64()), pa.array(z.reshape(-1)), pa.array(np.tile(explained, len(x))),
                                   pa.array(np.full(len(row), error))],
                                  names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, schema)
