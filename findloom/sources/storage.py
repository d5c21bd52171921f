"""The folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session in one process that names none (a local test) gets a temporary folder;
    on a cluster that is an error, since executors do not share such folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="findloom-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that what follows has a short plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out if it comes from fewer files than there are cores, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    For loops of joins: unlike ``cut``, what is read has the size of its files,
    where a checkpoint carries on the product of the sizes of all joins before it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that nothing holds any more.

    It does so once the driver has collected its garbage, which a long loop of
    joins may not bring about by itself, since it needs little of its memory.
    """
    gc.collect()
    spark._jvm.System.gc()
