"""Session and scratch-space helpers.

Library code never builds its own session: every operator takes the caller's
DataFrames.  ``local_session`` exists for tests and the bench script only.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app_name: str = "quadrant") -> SparkSession:
    """A local session with the settings the tests and bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, gets a folder of
    its own if none is set.  On a cluster that is an error: a folder on the driver's disk would hide
    what executors write, and reads would come back partial.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="quadrant-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, under the shared checkpoint folder.

    Each call gets its own sub-folder, so concurrent jobs never collide and
    nothing is ever overwritten or cleared.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quadrant-tables/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like a reliable checkpoint, computes ``df`` exactly once
    (``checkpoint(eager=True)`` runs it twice: once to count, once to write),
    and gives the optimizer real file sizes for later broadcast decisions.
    A lost executor never forces the input to be recomputed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no job looks for it


def layout_path(df, name: str, *settings) -> tuple[str, bool]:
    """Where the layout ``name`` of ``df`` with ``settings`` lies in this application, and whether it is complete.

    The key holds the input files, the plan over them and the settings.  A layout counts as
    complete once its ``meta`` table is there, which builders write last.
    """
    spark = df.sparkSession
    key = hashlib.sha256(repr((sorted(df.inputFiles()), df.semanticHash(), settings)).encode()).hexdigest()[:24]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quadrant-layouts/{name}-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return path, done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


@contextmanager
def persisted(df, level=None):
    """L4: keep ``df`` cached while several queries reuse it, and release it after.

    ``level`` defaults to MEMORY_AND_DISK, so partitions that do not fit spill
    instead of being recomputed.  Cached blocks lost with an executor are
    recomputed from lineage; for results that must outlive executors use
    ``materialize``.
    """
    from pyspark import StorageLevel
    cached = df.persist(level or StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()


__all__ = ["local_session", "ensure_checkpoint_dir", "scratch_path", "materialize", "layout_path", "persisted"]
