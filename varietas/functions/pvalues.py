"""P-values of t and F statistics (SciPy is not available).

The regularised incomplete beta function I_x(a, b) is evaluated with the
continued fraction of DLMF 8.17.22.  These run in
Arrow-batched pandas UDFs on aggregated rows only (one row per group), never on
data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _continued_fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))) of DLMF 8.17.22, from the innermost kept term outwards.

    For x below (a + 1) / (a + b + 2) the terms needed grow with the square root of max(a, b).
    """
    depth = 64 + 8 * math.isqrt(int(max(a, b)) + 1)
    tail = 1.0
    for k in range(depth, 0, -1):
        m = k // 2
        if k % 2:
            term = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        tail = 1.0 + term * x / tail
    return 1.0 / tail


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b); beyond the peak by I_x(a, b) = 1 - I_{1-x}(b, a)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x * (a + b + 2.0) > a + 1.0:
        return 1.0 - _lower(b, a, 1.0 - x)
    return _lower(a, b, x)


def _lower(a: float, b: float, x: float) -> float:
    log_power = a * math.log(x) + b * math.log1p(-x)
    log_norm = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return math.exp(log_power - log_norm) * _continued_fraction(a, b, x) / a


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or not np.isfinite(df) or df <= 0 or (isinstance(t, float) and math.isnan(t)):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _t_series(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(t, df)], dtype="float64")


def _f_series(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper(a, b, c) if pd.notna(a) and pd.notna(b) and pd.notna(c) else float("nan")
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


def t_pvalue(t, df) -> Column:
    """Two-sided p of Student's t with ``df`` degrees of freedom."""
    from pyspark.sql.functions import pandas_udf
    fn = pandas_udf(_t_series, DoubleType())
    return fn(F.col(t).cast("double") if isinstance(t, str) else t.cast("double"),
              F.col(df).cast("double") if isinstance(df, str) else df.cast("double"))


def f_pvalue(f, d1, d2) -> Column:
    """Upper tail p of the F distribution."""
    from pyspark.sql.functions import pandas_udf
    fn = pandas_udf(_f_series, DoubleType())
    cast = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return fn(cast(f), cast(d1), cast(d2))
