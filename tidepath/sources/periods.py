"""Stores of one file per period, exports with a coverage report, and keyed tables on a panel's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.sources.tables import require

KEYS = ("date", "stable_id")


def period_store(spark: SparkSession, root: str, columns: tuple[str, ...] | None = None, file: str = "data.pq") -> DataFrame:
    """All periods of a store, root/<period>/<file> and root/<part>/<period>/<file>, as one table; columns that a file lacks
    are refused by name. FileNotFoundError if the store has no period."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for pattern in (f"{root}/*/{file}", f"{root}/*/*/{file}"):
        path = hadoop.Path(pattern)
        found += [s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]
    if not found:
        raise FileNotFoundError(f"no {file} below {root}")
    df = spark.read.parquet(*sorted(found))
    return df if columns is None else require(df, columns, root).select(*columns)


def coverage_report(df: DataFrame) -> DataFrame:
    """(first, last, dates, names, n_rows) of a keyed table."""
    return df.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("dates"), F.countDistinct("stable_id").alias("names"), F.count(F.lit(1)).alias("n_rows"))


def export(df: DataFrame, path: str) -> DataFrame:
    """Writes a keyed table, each file sorted by date and name, and gives the coverage of what was written."""
    require(df, KEYS, path).repartitionByRange("date").sortWithinPartitions(*KEYS).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return coverage_report(df.sparkSession.read.parquet(path))


def regressors(df: DataFrame, other: tuple[str, ...] = ("ingested_at",)) -> list[str]:
    """Exposure columns: all of the header but the keys and what `other` names."""
    return [c for c in df.columns if c not in (*KEYS, *other)]


def on_keys(panel: DataFrame, rows: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """panel(date, stable_id, ..) with columns of a keyed table; ValueError if they share no key at all."""
    x = require(rows, (*KEYS, *columns), name).select(*KEYS, *columns)
    if not panel.select(*KEYS).join(x.select(*KEYS), list(KEYS), "left_semi").limit(1).count():
        raise ValueError(f"{name} has no date and name in common with the panel")
    return panel.join(x, list(KEYS), "left")
