"""Session for local runs, and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. Cluster sessions come from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("calltrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # small local tables: keep the cores busy instead of merging to 1 MB partitions
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder named by spark.checkpoint.dir, in the one of this application.

    Only a local session may go without the setting; it then gets a temporary folder, removed at the end,
    because driver and executors are one process there.
    """
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Removes the intermediate tables of this application. Call it once the results are written: they may still be read before."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def _scratch_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="calltrail-")
            atexit.register(shutil.rmtree, _LOCAL_ROOTS[context.applicationId], ignore_errors=True)
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/{context.applicationId}"


def materialize(df, name: str):
    """Write `df` to the shared folder and read it back: one computation, short lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
