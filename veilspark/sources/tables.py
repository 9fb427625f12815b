"""Read the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder all executors share, which ``spark.checkpoint.dir`` names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{purpose}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library has written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def spread(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Use all cores for a costly step over an input that came in few splits.

    A small or unsplittable file is dealt out evenly.  An input with at least as
    many splits as cores, as any large one has, is left as it is: no shuffle.
    Splits of a Parquet file without a row group of their own are empty, so ``narrow``
    rows, which cost little to move, are dealt out then as well, in four parts per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df.repartition(4 * cores) if narrow else df
