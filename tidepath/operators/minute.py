"""The minute branch: windows of whole days of bars, and their signatures from one element per source and day.

A signature of a path end to end is the product of its pieces' signatures, so each day of a source is scanned once and
the overlapping windows multiply day elements: a window of K days of 48 bars takes K products in place of 48 K steps.
Scaling a channel scales each word by its letters' factors and a shift changes nothing, so windows are normalised after
the product. A window begins at its first day's first bar; between days lies the step from last bar to first bar.

A window is valid where the source has bars on each of the calendar's last K dates. Bars of a day without a reading hold the
last value before them (the past only); days before a source's first reading have no element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepath.operators import signature as S
from tidepath.sources.tables import spread


def day_slice(bars: DataFrame, day: str, grid: list[int], fields: tuple[str, ...]) -> DataFrame:
    """(stable_id, bar_us, fields..) of one date: a row per source of the table and bar of the grid, NULL where there is no
    reading. The filter on the date reaches the scan. A date without bars gives no rows."""
    x = bars.where(F.col("date") == F.lit(day).cast("date"))
    keys = x.select("stable_id").distinct().select("stable_id", F.explode(F.array(*[F.lit(int(g)).cast("long") for g in grid])).alias("bar_us"))
    return keys.join(x.select("stable_id", "bar_us", *fields), ["stable_id", "bar_us"], "left")


def filled_bars(bars: DataFrame, cal: DataFrame, grid: list[int]) -> DataFrame:
    """(stable_id, date, date_idx, bar_us, close, volume): on each date with bars of a source, every bar of the grid, the close
    carried forward and a missing volume 0. bars: unique (stable_id, date, bar_us) with close and volume. A day's bars are
    packed to one row and laid on the grid there, so bars that come partitioned by source are not shuffled again."""
    at = F.map_from_entries(F.collect_list(F.struct("bar_us", F.struct(F.when(F.col("close") > 0, F.col("close")).alias("close"), "volume"))))
    days = bars.groupBy("stable_id", "date").agg(at.alias("at")).join(F.broadcast(cal), "date")  # a row per date
    x = days.select("stable_id", "date", "date_idx", "at", F.explode(F.array(*[F.lit(int(g)).cast("long") for g in grid])).alias("bar_us"))
    x = x.withColumn("b", F.try_element_at("at", F.col("bar_us"))).select("stable_id", "date", "date_idx", "bar_us", F.col("b.close").alias("close"), F.col("b.volume").alias("volume"))
    past = Window.partitionBy("stable_id").orderBy("date", "bar_us").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("stable_id", "date", "date_idx", "bar_us", F.last("close", True).over(past).alias("close"), F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)).alias("volume")).where("close is not null")


def sql_window_signature(points: DataFrame, k: int, channels: list[str]) -> DataFrame:
    """(stable_id, date, s_<word>..) to depth 2 of the last k calendar dates' points, inside the JVM: sums per day, then one
    frame of days. points: stable_id, date, date_idx, bar_us and the channels, no NULLs."""
    c = range(len(channels))
    order = "over (partition by stable_id order by date, bar_us)"
    x = points.selectExpr("stable_id", "date", "date_idx", "bar_us", *[f"{n} as x{i}" for i, n in enumerate(channels)], *[f"{n} - lag({n}) {order} as step{i}" for i, n in enumerate(channels)], "row_number() over (partition by stable_id, date order by bar_us) as rn")
    inner = "over (partition by stable_id, date order by bar_us rows between unbounded preceding and 1 preceding)"
    x = x.selectExpr("*", *[f"if(rn = 1, 0D, step{i}) as d{i}" for i in c]).selectExpr("*", *[f"coalesce(sum(d{i}) {inner}, 0D) as a{i}" for i in c])
    two = [(i, j) for i in c for j in c]
    # a day's own element, and the step over night that comes before it
    day = x.groupBy("stable_id", "date", "date_idx").agg(*[F.expr(f"sum(d{i}) as e{i}") for i in c], *[F.expr(f"sum(a{i} * d{j} + d{i} * d{j} / 2) as e{i}_{j}") for i, j in two], *[F.expr(f"max(if(rn = 1, coalesce(step{i}, 0D), null)) as o{i}") for i in c])
    day = day.selectExpr("*", *[f"o{i} + e{i} as f{i}" for i in c], *[f"o{i} * o{j} / 2 + o{i} * e{j} + e{i}_{j} as f{i}_{j}" for i, j in two])
    before = "over (partition by stable_id order by date_idx rows between unbounded preceding and 1 preceding)"
    day = day.selectExpr("*", *[f"coalesce(sum(f{i}) {before}, 0D) as c{i}" for i in c])
    frame = f"over (partition by stable_id order by date_idx range between {k - 1} preceding and current row)"
    w = day.selectExpr("stable_id", "date", "date_idx", f"count(1) {frame} as days", *[f"first(o{i}) {frame} as o{i}" for i in c], *[f"sum(f{i}) {frame} as t{i}" for i in c], *[f"sum(f{i}_{j} + c{i} * f{j}) {frame} - first(c{i}) {frame} * sum(f{j}) {frame} as t{i}_{j}" for i, j in two])
    # the step before the first day taken off again, from the left
    return w.where(f"days = {k} and date_idx >= {k - 1}").selectExpr("stable_id", "date", *[f"t{i} - o{i} as s_{i}" for i in c], *[f"t{i}_{j} - o{i} * t{j} + o{i} * o{j} / 2 as s_{i}{j}" for i, j in two])


CHANNELS = 3  # time, close, log volume


def day_elements(filled: DataFrame, depth: int) -> DataFrame:
    """(stable_id, date, date_idx, n, element, first, last, sums, squares): a day's signature over (bar number, close, log1p
    volume), its end points, and the channels' sums for normalising."""
    day = filled.groupBy("stable_id", "date", "date_idx").agg(F.array_sort(F.collect_list(F.struct("bar_us", "close", F.log1p("volume").alias("v")))).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["stable_id", "date", "date_idx"]].copy()
            cols: dict[str, list] = {c: [None] * len(b) for c in ("n", "element", "first", "last", "sums", "squares")}
            paths = [np.column_stack([np.arange(len(c)), c, v]).astype(float) for c, v in zip(b["c"], b["v"], strict=True)]
            for n in {len(p) for p in paths}:  # days of one length together
                at = [i for i, p in enumerate(paths) if len(p) == n]
                x = np.stack([paths[i] for i in at])
                e = np.concatenate(S.signature_levels(x, depth), axis=1) if n > 1 else np.zeros((len(at), S.width(CHANNELS, depth, "signature")))
                for r, i in enumerate(at):
                    cols["n"][i], cols["element"][i], cols["first"][i], cols["last"][i], cols["sums"][i], cols["squares"][i] = n, e[r], x[r, 0], x[r, -1], x[r].sum(0), (x[r] ** 2).sum(0)
            for c, v in cols.items():
                out[c] = v
            yield out

    flat = day.select("stable_id", "date", "date_idx", F.col("p.close").alias("c"), F.col("p.v").alias("v"))
    arrays = ", ".join(f"{c} array<double>" for c in ("element", "first", "last", "sums", "squares"))
    return spread(flat).mapInPandas(run, f"stable_id long, date date, date_idx int, n int, {arrays}")


def _levels(flat: np.ndarray, depth: int) -> list[np.ndarray]:
    ends = np.cumsum([CHANNELS**k for k in range(1, depth + 1)])
    return np.split(flat, ends[:-1], axis=1)


def _segment(step: np.ndarray, depth: int) -> list[np.ndarray]:
    return S.signature_levels(np.stack([np.zeros_like(step), step], axis=1), depth)


def window_product(elements: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, depth: int) -> np.ndarray:
    """Log-signature features (windows, words) from day elements (windows, days, ..): products of days and the steps between
    them, then each channel over its deviation in the window, time over its length, and the start from a base point at 0.
    The time between two days is one bar."""
    total = _levels(elements[:, 0], depth)
    for k in range(1, elements.shape[1]):
        step = first[:, k] - last[:, k - 1]
        step[:, 0] = 1.0
        total = S.multiply(S.multiply(total, _segment(step, depth)), _levels(elements[:, k], depth))
    count = n.sum(1, keepdims=True).astype(float)
    mean, dev = sums.sum(1) / count, np.sqrt(np.maximum(squares.sum(1) / count - (sums.sum(1) / count) ** 2, 0.0))
    factor = 1 / np.maximum(dev, 1e-8)
    factor[:, 0] = 1 / np.maximum(count[:, 0] - 1, 1.0)
    start = (first[:, 0] - mean) * factor
    start[:, 0] = 0.0
    whole = S.multiply(_segment(start, depth), S.scale_channels(total, factor))
    return S.flat(whole, CHANNELS, "logsignature") * S.level_factorials(CHANNELS, depth, "logsignature")


def minute_features(bars: DataFrame, cal: DataFrame, grid: list[int], k: int = 20, depth: int = 5) -> DataFrame:
    """(date, stable_id, feature): k-day windows of the minute branch, one row per source and date with a valid window."""
    days = day_elements(filled_bars(bars, cal, grid), depth)
    over = Window.partitionBy("stable_id").orderBy("date_idx").rangeBetween(-(k - 1), 0)
    parts = ("n", "element", "first", "last", "sums", "squares")
    w = days.withColumn("w", F.collect_list(F.struct(*parts)).over(over)).where((F.size("w") == k) & (F.col("date_idx") >= k - 1)).select("date", "stable_id", *[F.col(f"w.{p}").alias(p) for p in parts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = {p: np.array([np.stack(v) if p != "n" else np.asarray(v) for v in b[p]], dtype=float) for p in parts}
                yield pd.DataFrame({"date": b["date"], "stable_id": b["stable_id"], "feature": list(window_product(x["element"], x["first"], x["last"], x["n"], x["sums"], x["squares"], depth))})

    return w.mapInPandas(run, "date date, stable_id long, feature array<double>")
