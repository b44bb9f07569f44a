"""Totals and averages over trailing calendar periods, days without a row included.

Method. Each day's total is exploded onto every output day it influences (itself and the days after it within
the longest period), grouped by entity and output day, and joined to calendar rows, which give the zeros.

Scale. Days are made unique under a distribution by (entity, block of days): the exploded rows of a block
meet in the same task, so partial aggregation folds them from thirty per day to about one and a half before
they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.functions.cols import finite

BLOCK_DAYS = 64


def trailing_totals(rows: DataFrame, entity: str = "stable_id", day: str = "date", fields: tuple[str, ...] = ("volume", "close"), periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per entity and calendar day from its first to its last row.

    For each field f and period p: f_sum_p (0 where no day of the period has a finite value), f_avg_p (the mean
    over the days that have one; NULL if none) and f_days_p (how many have one). A key repeated counts once
    (the greatest finite value). NULL, NaN and infinite values count as no value; rows with a null entity or day
    count nowhere. Empty input gives no rows; other columns are ignored."""
    longest = max(periods)
    keyed = rows.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d"), *[finite(F.col(f)).alias(f"f_{f}") for f in fields]).where("e is not null and d is not null")
    keyed = keyed.withColumn("block", F.floor(F.datediff("d", F.lit("1970-01-01")) / BLOCK_DAYS))
    once = keyed.groupBy("e", "block", "d").agg(*[F.max(f"f_{f}").alias(f"f_{f}") for f in fields])
    spread = once.repartition("e", "block").select("d", "e", *[f"f_{f}" for f in fields], F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("back"))
    aggs = []
    for f in fields:
        for p in periods:
            v = F.when(F.col("back") < p, F.col(f"f_{f}"))
            aggs += [F.sum(v).alias(f"{f}_sum_{p}"), F.count(v).alias(f"{f}_days_{p}")]
    sums = spread.select("e", F.date_add("d", F.col("back")).alias("d"), "back", *[f"f_{f}" for f in fields]).groupBy("e", "d").agg(*aggs)
    span = keyed.groupBy("e").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = span.select("e", F.explode(F.sequence("a", "b")).alias("d"))
    out = days.join(sums, ["e", "d"], "left")
    cols = []
    for f in fields:
        for p in periods:
            total, n = F.coalesce(F.col(f"{f}_sum_{p}"), F.lit(0.0)), F.coalesce(F.col(f"{f}_days_{p}"), F.lit(0))
            cols += [total.alias(f"{f}_sum_{p}"), F.when(n > 0, total / n).alias(f"{f}_avg_{p}"), n.cast("long").alias(f"{f}_days_{p}")]
    return out.select(F.col("e").alias(entity), F.col("d").alias(day), *cols)
