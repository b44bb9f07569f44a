"""Irregular readings onto a regular grid: harmonic regression with trend, residuals bridged.

Method. Per source the log close and log1p volume of the observed grid cells are regressed on 1, time and
sine and cosine of the time of day (periods of one day and its halves and thirds). The normal equations are
sums, made by one partial aggregation, so a source with a third of all rows costs no more than others after
it; solving them is a vectorised Arrow function over one small matrix per source. A missing cell gets the
regression's value plus the residual interpolated between the nearest observed cells around it (carried flat
beyond the first and last).

Scale. Readings are reduced to cells (source, date, period) before anything else; a source has one row per
period of its calendar then, whatever its readings, which bounds every later window. The sums are made of the
observed cells alone, by days since a fixed date, and moved to each source's start when they are solved: the
optimiser takes the grid for as small as the sources it is exploded from, so it is no side of a join that may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.functions.cols import finite

BAR_US = 300_000_000
SESSIONS = ((34_200_000_000, 41_400_000_000), (46_800_000_000, 54_000_000_000))  # 09:30-11:30, 13:00-15:00
HARMONICS = 3
TERMS = 2 + 2 * HARMONICS
ORIGIN = "2000-01-01"


def bar_starts(sessions: tuple = SESSIONS, bar_us: int = BAR_US) -> list[int]:
    return [t for a, b in sessions for t in range(a, b, bar_us)]


def bar_of(time: Column, sessions: tuple = SESSIONS, bar_us: int = BAR_US) -> Column:
    """Start of the period that holds a time of day, NULL outside the sessions."""
    out = F.lit(None).cast("long")
    for a, b in sessions:
        out = F.when((time >= a) & (time < b), F.lit(a) + F.floor((time - a) / bar_us) * bar_us).otherwise(out)
    return out


def bars(intraday: DataFrame, sessions: tuple = SESSIONS, bar_us: int = BAR_US) -> DataFrame:
    """(stable_id, date, bar_us, close, volume): the last finite close of a period and the sum of its finite
    volumes, rows repeated at one time counted once. Periods without a finite close have no row."""
    x = intraday.select("stable_id", "date", "time", finite(F.col("close")).alias("close"), finite(F.col("volume")).alias("volume")).where("stable_id is not null and date is not null")
    # one exchange for both groupings and the join to the grid
    x = x.withColumn("bar_us", bar_of(F.col("time"), sessions, bar_us)).where("bar_us is not null").repartition("stable_id", "date", "bar_us")
    once = x.groupBy("stable_id", "date", "bar_us", "time").agg(F.max("close").alias("close"), F.max("volume").alias("volume"))
    # a close at or below zero stands only where its period has no other
    best = F.expr("max_by(close, struct(close > 0, time)) filter (where close is not null)")
    return once.groupBy("stable_id", "date", "bar_us").agg(best.alias("close"), F.sum("volume").alias("volume")).where("close is not null")


def spans(intraday: DataFrame) -> DataFrame:
    """(stable_id, first, last): a source's first and last date with any row."""
    return intraday.select("stable_id", "date").where("stable_id is not null and date is not null").groupBy("stable_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def calendar(span: DataFrame, trading_days: DataFrame) -> DataFrame:
    """(stable_id, date): the trading days from a source's first to its last date."""
    days = span.select("stable_id", F.explode(F.sequence("first", "last")).alias("date"))
    return days.join(trading_days.select("date").where("date is not null").distinct(), "date", "left_semi").select("stable_id", "date")


def _features(first: Column, date: Column, bar: Column) -> list[Column]:
    """1, years since the date `first`, and the harmonics of the time of day."""
    of_day = bar / F.lit(86_400_000_000.0)
    out = [F.lit(1.0), (F.datediff(date, first) + of_day) / 365.25]
    for k in range(1, HARMONICS + 1):
        # sessions fill about a quarter of the day; periods of 6, 3 and 2 hours tell them apart
        out += [F.sin(of_day * (2 * np.pi * 4 * k)), F.cos(of_day * (2 * np.pi * 4 * k))]
    return out


def normal_equations(cells: DataFrame) -> DataFrame:
    """Per source the sums of x x', x y and n for y = log close and y = log1p volume, as flat arrays, the trend counted
    from ORIGIN. cells: stable_id, date, bar_us, y_close, y_volume; a NULL y leaves its cell out of its own sums."""
    terms = _features(F.lit(ORIGIN).cast("date"), F.col("date"), F.col("bar_us"))
    cells = cells.select("stable_id", "y_close", "y_volume", *[t.alias(f"x{i}") for i, t in enumerate(terms)])
    x = [F.col(f"x{i}") for i in range(TERMS)]
    sums = []
    for y in ("y_close", "y_volume"):
        has = F.col(y).isNotNull()
        sums.append(F.array(*[F.sum(F.when(has, x[i] * x[j])) for i in range(TERMS) for j in range(i, TERMS)]).alias(f"xx_{y}"))
        sums.append(F.array(*[F.sum(x[i] * F.col(y)) for i in range(TERMS)]).alias(f"xy_{y}"))
        sums.append(F.count(y).alias(f"n_{y}"))
    return cells.groupBy("stable_id").agg(*sums)


def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coefficients by ridge-guarded solves of all sources of a batch at once, the trend moved from ORIGIN to the source's
    start (`years` after it); fewer readings than terms give the mean alone, none gives nulls."""
    upper = np.triu_indices(TERMS)
    for b in batches:
        out, years = {"stable_id": b["stable_id"], "first": b["first"]}, b["years"].to_numpy(float)[:, None]
        for y in ("y_close", "y_volume"):
            n = b[f"n_{y}"].fillna(0).to_numpy()
            fill = lambda c, size: np.nan_to_num(np.array([[np.nan if v is None else v for v in (r if r is not None else [None] * size)] for r in b[c]], dtype=float).reshape(len(b), -1))
            m = np.zeros((len(b), TERMS, TERMS))
            m[:, upper[0], upper[1]] = fill(f"xx_{y}", len(upper[0]))
            m[:, upper[1], upper[0]] = m[:, upper[0], upper[1]]
            r = fill(f"xy_{y}", TERMS)
            r[:, 1] -= years[:, 0] * r[:, 0]
            m[:, 1, :] -= years * m[:, 0, :]
            m[:, :, 1] -= years * m[:, :, 0]
            ridge = 1e-6 * np.maximum(n, 1)
            m += ridge[:, None, None] * np.eye(TERMS)
            few = n < 3 * TERMS
            m[few, 0, 1:] = m[few, 1:, 0] = 0
            r[few, 1:] = 0
            beta = np.linalg.solve(m, r[:, :, None])[:, :, 0]
            out[f"beta_{y}"] = [list(v) if k else None for v, k in zip(beta, n, strict=True)]
        yield pd.DataFrame(out)


def regrid(intraday: DataFrame, trading_days: DataFrame, sessions: tuple = SESSIONS, bar_us: int = BAR_US) -> DataFrame:
    """One row per source, trading day between its first and last date, and period of the sessions.

    Columns stable_id, date, bar_us, close, volume, close_status, volume_status. close_status: `observed`
    (the period has a finite close; it stands as read), `bridged` (regression plus residuals between two
    observed cells), `carried` (observed cells on one side only) or `empty` (the source has no usable close:
    close is NULL). volume_status likewise; a period without a reading gets the estimated volume.
    Rows with null source or date count nowhere; rows with null time or outside the sessions extend the
    calendar only. Empty input gives no rows. Columns besides those named are ignored."""
    span = spans(intraday)
    grid = calendar(span, trading_days).withColumn("bar_us", F.explode(F.array(*[F.lit(t).cast("long") for t in bar_starts(sessions, bar_us)])))
    seen = bars(intraday, sessions, bar_us)
    y = [F.when(F.col("close") > 0, F.log("close")).alias("y_close"), F.when(F.col("volume") >= 0, F.log1p("volume")).alias("y_volume")]
    fitted = seen.join(trading_days.select("date").where("date is not null").distinct(), "date", "left_semi").select("stable_id", "date", "bar_us", *y)
    sums = span.select("stable_id", "first", (F.datediff("first", F.lit(ORIGIN).cast("date")) / 365.25).alias("years")).join(normal_equations(fitted.where("y_close is not null or y_volume is not null")), "stable_id", "left")
    beta = sums.mapInPandas(solve, "stable_id long, first date, beta_y_close array<double>, beta_y_volume array<double>")
    # a source's cells are bounded by its calendar
    x = grid.join(seen, ["stable_id", "date", "bar_us"], "left").join(beta, "stable_id", "left")
    x = x.select(
        "stable_id", "date", "bar_us", F.col("close").alias("seen"), F.col("volume").alias("seen_volume"), *y, "beta_y_close", "beta_y_volume",
        *[t.alias(f"x{i}") for i, t in enumerate(_features(F.col("first"), F.col("date"), F.col("bar_us")))],
    )
    at = F.datediff("date", F.lit("1970-01-01")) * 288.0 + F.col("bar_us") / 300_000_000.0
    fit = {y: sum((F.get(f"beta_{y}", F.lit(i)) * F.col(f"x{i}") for i in range(1, TERMS)), F.get(f"beta_{y}", F.lit(0)) * F.col("x0")) for y in ("y_close", "y_volume")}
    x = x.select("stable_id", "date", "bar_us", "seen", "seen_volume", "y_close", "y_volume", at.alias("at"), *[f.alias(f"fit_{y}") for y, f in fit.items()])
    up = Window.partitionBy("stable_id").orderBy("date", "bar_us").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("stable_id").orderBy(F.desc("date"), F.desc("bar_us")).rowsBetween(Window.unboundedPreceding, 0)
    known = {y: F.when(F.col(y).isNotNull(), F.struct("at", (F.col(y) - F.col(f"fit_{y}")).alias("e"))) for y in fit}
    x = x.select("*", *[F.last(k, True).over(up).alias(f"p_{y}") for y, k in known.items()], *[F.last(k, True).over(down).alias(f"n_{y}") for y, k in known.items()])
    est, status = {}, {}
    for y in fit:
        p, n = F.col(f"p_{y}"), F.col(f"n_{y}")
        part = F.when(n["at"] > p["at"], (F.col("at") - p["at"]) / (n["at"] - p["at"])).otherwise(F.lit(0.0))
        est[y] = F.col(f"fit_{y}") + F.coalesce(p["e"] + (n["e"] - p["e"]) * part, p["e"], n["e"])
        status[y] = F.when(p.isNotNull() & n.isNotNull() & est[y].isNotNull(), "bridged").when(est[y].isNotNull(), "carried").otherwise("empty")
    return x.select(
        "stable_id", "date", "bar_us",
        F.coalesce("seen", F.exp(est["y_close"])).alias("close"),
        F.when(F.col("seen").isNotNull() & F.col("seen_volume").isNotNull(), F.col("seen_volume")).otherwise(F.greatest(F.expm1(est["y_volume"]), F.lit(0.0))).alias("volume"),
        F.when(F.col("seen").isNotNull(), "observed").otherwise(status["y_close"]).alias("close_status"),
        F.when(F.col("seen").isNotNull() & F.col("seen_volume").isNotNull(), "observed").otherwise(status["y_volume"]).alias("volume_status"),
    )
