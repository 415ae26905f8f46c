"""Numbered folders that readers see whole or not at all."""

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether a folder was written to its end."""
    path, files = _path(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def committed(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of folders folder/name=n in which Spark's writer left its mark of success, which it does last; ascending.

    A missing folder has none. A writer that dies leaves no mark, so what it wrote is not seen.
    """
    path, files = _path(spark, f"{folder}/{name}=*/_SUCCESS")
    found = files.globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])
