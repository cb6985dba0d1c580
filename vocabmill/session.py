"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for large runs. AQE starts from many small shuffle partitions and
#: merges them up to the advisory size, so one value serves every data size.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.ansi.enabled": "true",
}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of this application on the default file
    system, which on a cluster must not be that of a single machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    default = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if default.startswith("file:") and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"/tmp/checkpoints/{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_root(spark)}/vocabmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage with data that survives the loss of executors. The table
    stays until the owner of the scratch folder clears it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(folder))


def rename_path(spark: SparkSession, old: str, new: str) -> None:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new)]
    paths[0].getFileSystem(spark._jsc.hadoopConfiguration()).rename(*paths)


def make_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def age_files(spark: SparkSession, path: str, days: int) -> None:
    """Make all files below ``path`` look as if they were ``days`` older."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listFiles(folder, True)
    while files.hasNext():
        file = files.next()
        system.setTimes(file.getPath(), file.getModificationTime() - days * 86_400_000, -1)


def remove_path(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
