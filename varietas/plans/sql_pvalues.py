"""SQL twin of ``functions.pvalues`` for the oracle queries.

The regularised incomplete beta I_x(a, b) is evaluated with the same
continued fraction (modified Lentz), one recursion step per half-step, in a
recursive CTE over the (few) aggregated rows that need a p-value.
"""

from __future__ import annotations

STEPS = 2000  # half-steps; converged long before for the degrees of freedom used here


def _g(v: str) -> str:
    return f"(CASE WHEN abs({v}) < 1e-300 THEN 1e-300 ELSE {v} END)"


def betainc_ctes(src: str, out: str) -> str:
    """``src``(id, a0, b0, x0) -> ``out``(id, p) with p = I_x0(a0, b0).

    Returns CTE text to splice into a ``WITH RECURSIVE`` list.
    """
    aa = (f"(CASE WHEN (k + 1) % 2 = 1 "
          f"THEN ((k + 2) // 2) * (b - ((k + 2) // 2)) * x / ((a - 1.0 + 2 * ((k + 2) // 2)) * (a + 2 * ((k + 2) // 2))) "
          f"ELSE -(a + ((k + 1) // 2)) * (a + b + ((k + 1) // 2)) * x "
          f"/ ((a + 2 * ((k + 1) // 2)) * (a + 1.0 + 2 * ((k + 1) // 2))) END)")
    return f"""
{out}_in AS (
  SELECT id, a0, b0, x0, direct,
         CASE WHEN direct THEN a0 ELSE b0 END AS a, CASE WHEN direct THEN b0 ELSE a0 END AS b,
         CASE WHEN direct THEN x0 ELSE 1.0 - x0 END AS x
  FROM (SELECT *, x0 < (a0 + 1.0) / (a0 + b0 + 2.0) AS direct FROM {src} WHERE x0 > 0 AND x0 < 1)),
{out}_cf AS (
  SELECT id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(x AS DOUBLE) AS x, 0 AS k,
         CAST(1.0 AS DOUBLE) AS c, CAST(1.0 / {_g('1.0 - (a + b) * x / (a + 1.0)')} AS DOUBLE) AS d,
         CAST(1.0 / {_g('1.0 - (a + b) * x / (a + 1.0)')} AS DOUBLE) AS h
  FROM {out}_in
  UNION ALL
  SELECT id, a, b, x, k + 1,
         {_g('1.0 + aa / c')} AS c,
         1.0 / {_g('1.0 + aa * d')} AS d,
         h * ((1.0 / {_g('1.0 + aa * d')}) * {_g('1.0 + aa / c')}) AS h
  FROM (SELECT *, {aa} AS aa FROM {out}_cf WHERE k < {STEPS})),
{out} AS (
  SELECT s.id,
    CASE WHEN s.x0 <= 0 THEN 0.0 WHEN s.x0 >= 1 THEN 1.0
         WHEN i.direct THEN fr * f.h / i.a ELSE 1.0 - fr * f.h / i.a END AS p
  FROM {src} s
  LEFT JOIN {out}_in i ON s.id = i.id
  LEFT JOIN (SELECT id, h FROM {out}_cf WHERE k = {STEPS}) f ON s.id = f.id
  LEFT JOIN (SELECT id, exp(lgamma(a0 + b0) - lgamma(a0) - lgamma(b0) + a0 * ln(x0) + b0 * ln(1.0 - x0)) AS fr
             FROM {out}_in) e ON s.id = e.id)
"""


def t_src(rows: str, t: str, df: str, name: str) -> str:
    """CTE ``name``(id, a0, b0, x0) for the two-sided t test of ``rows``(id, t, df)."""
    return (f"{name} AS (SELECT id, CAST({df} AS DOUBLE) / 2.0 AS a0, CAST(0.5 AS DOUBLE) AS b0, "
            f"CAST({df} AS DOUBLE) / ({df} + CAST({t} AS DOUBLE) * {t}) AS x0 FROM {rows})")


def f_src(rows: str, f: str, d1: str, d2: str, name: str) -> str:
    """CTE ``name``(id, a0, b0, x0) for the upper tail of F(d1, d2)."""
    return (f"{name} AS (SELECT id, CAST({d2} AS DOUBLE) / 2.0 AS a0, CAST({d1} AS DOUBLE) / 2.0 AS b0, "
            f"CASE WHEN {f} <= 0 THEN CAST(1.0 AS DOUBLE) "
            f"ELSE CAST({d2} AS DOUBLE) / ({d2} + CAST({d1} AS DOUBLE) * {f}) END AS x0 FROM {rows})")
