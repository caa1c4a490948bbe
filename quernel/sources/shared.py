"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. A temporary folder serves only where the session names none and runs in one process; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = top or _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quernel-"))
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read again."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a costly step is to come and its few files or row groups would leave most of them idle. A table of
    as many partitions as the cluster has cores stays as it is, so large inputs aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
