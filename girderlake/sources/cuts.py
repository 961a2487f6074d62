"""Cutting a long lineage with files in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on one machine may that be unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The rows of ``df`` by keys in so many tasks, which Spark doesn't merge afterwards; without a number as they lie."""
    return df.repartition(tasks, *keys) if tasks else df


def stored(df: DataFrame, buckets: int | None = None, key: str | None = None) -> DataFrame:
    """The rows of ``df`` as columns of files, of which a reader takes only what it needs; they go when the driver ends.

    With ``key`` they are stored in so many buckets by it, and readers find them dealt by it without a shuffle.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path = f"{_folder(spark)}/{name.replace('_', '-')}"
    if key:
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    else:
        df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.table(name) if key else spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, stored: a checkpoint keeps what the plan knew of columns that it dropped, and Spark 4.1 stops where such a plan is put under another."""
    return stored(df)
