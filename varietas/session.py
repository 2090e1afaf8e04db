"""Session helpers.

The library never hard-codes cluster settings.  ``get_spark`` only fills in
defaults that are unset, so a cluster's own configuration (shuffle partitions,
checkpoint dir, broadcast thresholds) always wins.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults applied only when the session does not already define them.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, app: str = "varietas",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session (filling in only unset defaults) or build one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in _DEFAULTS.items():
            if k.startswith("spark.sql.") and active.conf.get(k, None) is None:
                active.conf.set(k, v)
        return prepare(active)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


#: Rows here carry whole texts and arrays of their words, so an Arrow batch has a tenth of Spark's default number of rows
#: (unless the deployment says otherwise): two tasks' batches must fit beside each other.
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Make ``varietas`` importable in the Python workers of every executor.

    Pandas UDFs refer to functions of this package; the workers import them.
    The package is zipped once per SparkContext and handed to ``addPyFile``,
    which distributes it to all executors (the programmatic ``--py-files``).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: ship with the client's artifacts instead
        return
    if getattr(sc, "_varietas_shipped", False):      # a mark on the context itself: a later one has none
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="varietas-pkg-")
    archive = shutil.make_archive(os.path.join(out, "varietas"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    sc._varietas_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and make sure a checkpoint folder is set."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    if spark.conf.get(_ARROW_ROWS, None) is None:
        spark.conf.set(_ARROW_ROWS, "1000")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and must be shared
    storage; it is only read here.  When it is unset a scratch folder is made if
    the master is local (tests); on a cluster that is an error, since executors
    would write to their own disks.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="varietas-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is None:
        return conf_dir
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df):
    """Cut the lineage of a table that later stages read several times.

    The table is written once as parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read back: a lost executor re-reads files
    instead of recomputing the plan, the plan runs once (``checkpoint()``
    would run it twice unless cached), and the planner sees the real size.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/varietas-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
