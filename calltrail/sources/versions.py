"""Tables that are replaced as a whole: readers see the old version until the new one is complete.

A version is a folder of its own. The manifest, one small file that names the current version, is
replaced by an atomic rename once the version is written, so a job that dies half-way changes nothing.
Versions that no manifest names are removed by the next write that succeeds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_current"


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of `path` and a maker of paths below it; any store Spark writes to has one."""
    jvm = spark._jvm
    make = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
    return make().getFileSystem(spark._jsc.hadoopConfiguration()), make


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the current version, None where nothing was written yet."""
    files, at = _files(spark, path)
    if not files.exists(at(MANIFEST)):
        return None
    stream = files.open(at(MANIFEST))
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[str]:
    """All version folders, complete or not."""
    files, at = _files(spark, path)
    if not files.exists(at()):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(at()) if s.getPath().getName().startswith("version-"))


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 1) -> str:
    """Replaces the table at `path` by `df`, which may read the version it replaces; returns the new version's name.

    The last `keep` versions before it stay for readers that have begun; older ones and leftovers of
    failed writes go. One writer at a time.
    """
    spark = df.sparkSession
    files, at = _files(spark, path)
    old = current_version(spark, path)
    number = int(old.split("-")[1]) + 1 if old else 0
    name = f"version-{number:010}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path.rstrip('/')}/{name}")
    draft = f"{MANIFEST}-{uuid.uuid4().hex}"
    stream = files.create(at(draft), True)
    stream.write(name.encode())
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at().toUri(), spark._jsc.hadoopConfiguration())
    option = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(at(draft), at(MANIFEST), option)
    for other in versions(spark, path):
        age = number - int(other.split("-")[1])
        if other != name and (age > keep or other.split("-")[1] == f"{number:010}" or (age == 1 and other != old)):
            files.delete(at(other), True)
    return name


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The current version of the table, or a named one."""
    version = version or current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")
