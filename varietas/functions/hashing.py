"""Reproducible randomness from md5 of (seed, keys).

``rand()`` depends on partitioning and changes when a task is retried; these
expressions depend only on the row's keys, so a lost executor recomputes the
same picks.  The SQL twins in comments are what the oracle SQL uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def hash_order(seed, *cols) -> Column:
    """Full md5 hex string; order by it (plus a unique id) for random order.

    SQL: ``md5(concat_ws('|', '<seed>', k1, k2 ...))``
    """
    return F.md5(_key(seed, *cols))


def hash_u32(seed, *cols) -> Column:
    """First 32 bits of the md5 as a non-negative long.

    SQL (DuckDB): ``('0x' || substr(md5(...), 1, 8))::BIGINT``
    """
    return F.conv(F.substring(hash_order(seed, *cols), 1, 8), 16, 10).cast("long")


def hash_uniform(seed, *cols) -> Column:
    """Uniform in the open interval (0, 1): (h + 0.5) / 2^32."""
    return (hash_u32(seed, *cols).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
