"""Parquet scans with a loud column contract, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DAILY = ("date", "stable_id", "open", "high", "low", "close", "volume")
INTRADAY = ("date", "time", "stable_id", "open", "high", "low", "close", "volume")


def read(spark: SparkSession, root: str, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One table of a data folder; only `columns`, which must all exist (ValueError otherwise)."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    if columns is None:
        return df
    return require(df, columns, name).select(*columns)


def require(df: DataFrame, columns: tuple[str, ...], name: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}; it has {df.columns}")
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only where that is
    unset and all runs in one process (tests) a temporary folder is made and set. A cluster without it is an error: a
    folder of one machine would be lost with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidepath-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, which cuts their lineage and keeps columns apart."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores, for costly work row by row: a few small files
    would keep the rest idle. Inputs of many files or splits are left where they are, and so is what comes out of a shuffle, which
    has its own partitions and would be run a second time to count them."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = int(df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(2 * n)
