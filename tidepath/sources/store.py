"""Feature store: parquet by kind, branch and date, a manifest beside it, and resumable builds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.sources import files

HALF_MAX = 65504.0  # largest half-precision number


def built_dates(spark: SparkSession, root: str, kind: str, branch: str) -> DataFrame:
    """(date) already in the store; none if it does not exist."""
    try:
        return spark.read.parquet(f"{root}/{kind}").where(F.col("branch") == branch).select("date").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "date date")


def missing_dates(dates: DataFrame, built: DataFrame) -> DataFrame:
    return dates.select("date").distinct().join(built.select("date"), "date", "left_anti")


def narrowed(df: DataFrame, column: str) -> DataFrame:
    """An array column as floats; the job fails where a number lies beyond half precision, which a store of halves would
    turn into infinity. The check is part of the write and reads nothing twice."""
    most = F.array_max(F.transform(column, lambda x: F.abs(x)))
    told = F.raise_error(F.concat(F.lit(f"{column} goes beyond half precision ({HALF_MAX:g}): "), most.cast("string")))
    return df.withColumn(column, F.when(F.coalesce(most, F.lit(0.0)) > HALF_MAX, told.cast("array<float>")).otherwise(F.col(column).cast("array<float>")))


def date_features(spark: SparkSession, root: str, kind: str, branch: str, day: str) -> DataFrame:
    """One date of one branch; only its folder is read. FileNotFoundError if it was not built."""
    x = spark.read.parquet(f"{root}/{kind}").where((F.col("branch") == branch) & (F.col("date") == F.lit(day).cast("date")))
    if not x.limit(1).count():
        raise FileNotFoundError(f"{kind}/{branch} has no {day} in {root}")
    return x


def write_features(df: DataFrame, root: str, kind: str, branch: str, overwrite: bool = False, half: str | None = None) -> DataFrame:
    """Writes df(date, ..) under kind/branch/date: dates already there are skipped, or replaced with `overwrite`. One
    shuffle puts a date's rows together so that a date is one file. `half` names an array column to be stored as floats that half precision can hold."""
    df = df if half is None else narrowed(df, half)
    spark = df.sparkSession
    if not overwrite:
        df = df.join(built_dates(spark, root, kind, branch), "date", "left_anti")
    out = df.withColumn("branch", F.lit(branch)).repartition("date")
    mode = out.write.partitionBy("branch", "date").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    mode.mode("overwrite" if overwrite else "append").parquet(f"{root}/{kind}")
    return spark.read.parquet(f"{root}/{kind}").where(F.col("branch") == branch)


def write_manifest(spark: SparkSession, root: str, **facts) -> dict:
    """Merges facts into the manifest."""
    path = f"{root}/manifest.json"
    old = json.loads(files.read_text(spark, path)) if files.exists(spark, path) else {}
    old |= facts
    files.write_text(spark, path, json.dumps(old, indent=1, sort_keys=True))
    return old


def read_manifest(spark: SparkSession, root: str) -> dict:
    path = f"{root}/manifest.json"
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no feature store at {root}: build it first")
    return json.loads(files.read_text(spark, path))


def write_factor(factor: DataFrame, path: str) -> DataFrame:
    """Factor rows by year, sorted by date and id within files, and all years read back as one table."""
    x = factor.withColumn("year", F.year("date")).repartition("year").sortWithinPartitions("date", "stable_id")
    x.write.mode("overwrite").partitionBy("year").option("compression", "zstd").parquet(path)
    return factor.sparkSession.read.parquet(path).select(*factor.columns)
