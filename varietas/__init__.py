"""varietas: corpus diversity and classifier audit as Spark DataFrame operators.

Every public operator takes and returns DataFrames.  Heavy work runs as
Spark joins, windows and aggregations; NumPy only touches bounded per-group
matrices (eigenvalues of a g x g or d x d kernel).  Randomness is derived from
md5 of (seed, keys), so results never depend on partitioning or task retries.
"""

from varietas.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
