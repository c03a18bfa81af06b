"""Session construction and lineage cutting.

Library code never creates a session on its own; tests and ``bench.py`` use
``get_spark``.  The checkpoint folder is read from the session
(``spark.checkpoint.dir``); a private folder is set only when the session has
none, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "mixlens") -> SparkSession:
    master = master or os.environ.get("MIXLENS_MASTER", "local[*]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MIXLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="mixlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SCRATCH: list[tuple[SparkSession, str]] = []


def _drop_scratch() -> None:
    """At interpreter exit, delete the intermediate tables this process wrote
    (Hadoop FileSystem API, so shared storage works too).  Outputs written to
    user paths are never touched.  Runs before PySpark's own exit handlers
    (registered earlier, run later), while the JVM is still up."""
    for spark, path in reversed(_SCRATCH):
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - best effort at shutdown
            pass
    _SCRATCH.clear()


def _scratch_path(spark: SparkSession, name: str) -> str:
    import atexit
    if not _SCRATCH:
        atexit.register(_drop_scratch)
    path = f"{checkpoint_dir(spark).rstrip('/')}/mixlens-tables/{name}"
    _SCRATCH.append((spark, path))
    return path


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared checkpoint folder, deleted at exit."""
    import uuid
    return _scratch_path(spark, f"{kind}-{uuid.uuid4().hex}")


def bucketed_table(df: DataFrame, key: str, sort_by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` (files under the shared
    checkpoint folder) and read it back: every later window, join or aggregate
    on ``key`` finds its input already hash-distributed by ``key`` and adds no
    exchange.  There are as many buckets as ``spark.sql.shuffle.partitions``,
    which is what sizes every other exchange of the job too."""
    import uuid
    spark = df.sparkSession
    if not buckets:
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"mixlens_t_{uuid.uuid4().hex}"
    path = _scratch_path(spark, name)
    w = df.write.mode("errorifexists").option("path", path).format("parquet").bucketBy(buckets, key)
    if sort_by:
        w = w.sortBy(*sort_by)
    w.saveAsTable(name)
    return spark.table(name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table under the shared checkpoint folder and
    read it back: the lineage ends there (never ``localCheckpoint``), the files
    survive executor loss, and readers get columnar pruning."""
    import uuid
    path = _scratch_path(df.sparkSession, uuid.uuid4().hex)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
