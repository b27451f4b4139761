"""Intermediate tables of plans: written to the folder that all executors share, so that they survive the loss of executors."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, whose executors are the driver, may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="verbatrix-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it takes it; they serve whatever store Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once and read back, however often it is used."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing reads any more.

    It does so when the driver's collector finds that their plans are gone, which on a driver with little to do may take half an
    hour; until then the disks hold the files of all phases together. The first collection lets go of what Python's names stood
    for, the second of the plans; files are deleted in the background, for which there is a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as shuffles have: rows that are small in bytes but not in work would be a few tasks.

    A file of one row group is one task, however many rows it has.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def following(rows: DataFrame, group: str, order: str) -> DataFrame:
    """a and b of each row but a group's last: its ``order``, and that of the next row of its group.

    Rows are dealt by ranges of group and order, so that a group may be in many tasks; what follows a range's last row of a group
    is the first of the group's next range, of which there is one row each.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.select(F.col(group).alias("g"), F.col(order).alias("a")).repartitionByRange(parts, "g", "a").withColumn("part", F.spark_partition_id()), "ranges")
    inner = dealt.withColumn("b", F.lead("a").over(Window.partitionBy("part", "g").orderBy("a")))
    firsts = dealt.groupBy("part", "g").agg(F.min("a").alias("first"))
    after = firsts.select(F.col("part").alias("p"), F.col("g").alias("h"), F.lead("first").over(Window.partitionBy("g").orderBy("part")).alias("after"))
    met = inner.join(F.broadcast(after), (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("h")))
    return met.select("a", F.coalesce("b", "after").alias("b")).filter("b is not null")
