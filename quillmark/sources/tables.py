"""Parquet tables as the jobs' sources and questions."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """sources: source_id, text (null: empty), lang, origin."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", F.col("source").alias("origin"))


def write_table(df: DataFrame, folder: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet, for tables that several jobs use, and read again. by: columns, the last of df, that name its folders."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}.parquet")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one where it is unset and Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillmark-{name}-{uuid.uuid4().hex}"
