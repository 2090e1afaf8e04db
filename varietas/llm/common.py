"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varietas.session import cut_lineage, prepare

WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Python-side batches are cut into chunks of about this many text bytes, so
#: the memory of a task depends on the longest single text, not on the batch.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark itself (any file system it knows)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back."""
    return cut_lineage(df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (null id: null)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(m))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless 0-based row number per ``group`` in ``order``, without a window over a whole group.

    Rows are range-partitioned on (group, order) and written once; each
    partition numbers its own rows and adds the counts of the partitions
    before it.  The offsets have at most (partitions + groups) rows.
    """
    pid, n, off, p, rn = (fresh(df, x) for x in ("_pid", "_count", "_before", "_part", "_nth"))
    own = [fresh(df, f"_by{i}") for i in range(len(group))]
    placed = cut(df.repartitionByRange(*[F.col(c) for c in group + order])
                 .sortWithinPartitions(*group, *order).withColumn(pid, F.spark_partition_id()))
    counts = placed.groupBy(*group, pid).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn(off, F.coalesce(F.sum(n).over(before), F.lit(0)))
    offs = offs.select(*[F.col(c).alias(o) for c, o in zip(group, own, strict=True)], F.col(pid).alias(p), off)
    same = F.col(pid) == F.col(p)
    for c, o in zip(group, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    inner = Window.partitionBy(*group, pid).orderBy(*order)
    return (placed.withColumn(rn, F.row_number().over(inner).cast("long"))
            .join(offs, same, "left")
            .withColumn(name, F.col(rn) - 1 + F.col(off))
            .drop(rn, off, p, pid, *own))


def column(name: str) -> Column:
    """A top-level column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The columns of ``df`` (but some) as one struct, so that no helper column can meet a name of theirs."""
    rest = [column(c).alias(c) for c in df.columns if c not in but]
    return (F.struct(*rest) if rest else F.struct(F.lit(True).alias("none"))).alias("row")
