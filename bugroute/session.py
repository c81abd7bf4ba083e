"""Session and scratch-space helpers.

The library never builds its own session in library code: callers pass one.
``local_session`` exists for tests and ``bench.py`` only.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_FALLBACK_CHECKPOINT_DIR = "/tmp/bugroute-checkpoints"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "bugroute") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BUGROUTE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # broadcast joins only from measured sizes: the static, estimate-based
        # rule is off; AQE converts a join at runtime when the shuffled side
        # is measured below 32 MB.  Explicit broadcasts in the library are
        # size-checked before they are requested.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # small test files have one row group: deal their rows to all cores
        .config("spark.bugroute.spreadScans", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset (local tests) do we set our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = conf_dir or _FALLBACK_CHECKPOINT_DIR
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder.

    Used for written intermediate tables (lineage cuts) and round-trip files,
    so that they survive executor loss and are visible to every executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    return f"{base}/bugroute/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path`` (in any store that Spark knows)?"""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing names any more: its
    cleaner hears of them when the driver's JVM collects garbage."""
    spark._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``bugroute`` importable in executor Python workers (once per
    application): zip the package on the driver and ``addPyFile`` it; Spark
    distributes the file to every executor."""
    import shutil
    import tempfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="bugroute-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "bugroute"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="bugroute")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
