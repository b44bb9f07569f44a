"""Panels: calendar positions, liquidity screen, lookback windows, fills and normalisation.

Lookbacks count positions of the panel's calendar, not a source's own rows. A panel is unique by (date,
stable_id); its values are doubles or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.functions.cols import finite

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")


def panel(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Unique (date, stable_id) rows; of repeated rows the greatest finite value of each field stands. NaN and
    infinities become NULL; null keys are left out."""
    return rows.where("date is not null and stable_id is not null").groupBy(F.col("date").cast("date").alias("date"), "stable_id").agg(*[F.max(finite(F.col(f))).alias(f) for f in fields])


def calendar(rows: DataFrame) -> DataFrame:
    """(date, date_idx): the distinct dates numbered from 0. One window over the dates alone, a few thousand rows
    however many sources there are."""
    days = rows.select("date").where("date is not null").distinct()
    return days.select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).cast("int").alias("date_idx"))


def indexed(rows: DataFrame, cal: DataFrame) -> DataFrame:
    return rows.join(cal, "date")


def dense(rows: DataFrame, cal: DataFrame) -> DataFrame:
    """rows with date_idx and a row for each source on every calendar date; missing values are NULL. Dates are
    exploded from a sequence of positions: no product of tables."""
    last = cal.agg(F.max("date_idx").alias("n")).scalar()
    keys = rows.select("stable_id").distinct().select("stable_id", F.explode(F.sequence(F.lit(0), last)).alias("date_idx")).join(cal, "date_idx")
    return keys.join(rows, ["date", "stable_id"], "left")


def dollar_volume(p: DataFrame) -> DataFrame:
    return p.select("date", "stable_id", (F.col("close") * F.col("volume")).alias("dollar_volume"))


def trailing(k: int) -> Window:
    """Frame of the last k calendar positions of a source."""
    return Window.partitionBy("stable_id").orderBy("date_idx").rangeBetween(-(k - 1), 0)


def universe(d: DataFrame, n: int, lookback: int = 20) -> DataFrame:
    """(date, stable_id, score) of the n most liquid names of each date: the median over the trailing calendar
    dates of positive close x volume. Ties at the cutoff are kept, scores need to be above 0. d: a dense panel."""
    dv = F.col("close") * F.col("volume")
    scored = d.withColumn("dv", F.when(dv > 0, dv)).withColumn("score", F.percentile("dv", F.lit(0.5)).over(trailing(lookback))).where("score > 0")
    rank = F.rank().over(Window.partitionBy("date").orderBy(F.desc("score")))
    return scored.withColumn("rk", rank).where(F.col("rk") <= n).select("date", "stable_id", "score")


def coverage(d: DataFrame, k: int, least: float = 0.5) -> DataFrame:
    """(date, stable_id, present, valid) for each date with k calendar positions behind it: valid if the share of
    present closes, before any filling, reaches `least` and the last close is present. d: a dense panel."""
    share = F.count("close").over(trailing(k)) / F.lit(float(k))
    out = d.withColumn("present", share).where(F.col("date_idx") >= k - 1)
    return out.select("date", "stable_id", "present", ((F.col("present") >= least) & F.col("close").isNotNull()).alias("valid"))


def windows(d: DataFrame, k: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(date, stable_id, one array of k values per field), oldest first, for each date with k positions behind it.
    Nulls stay in place. d: a dense panel."""
    packed = F.collect_list(F.struct(*fields)).over(trailing(k))
    out = d.withColumn("w", packed).where(F.col("date_idx") >= k - 1)
    return out.select("date", "stable_id", *[F.col(f"w.{f}").alias(f) for f in fields])


def fill_forward(a: Column) -> Column:
    """Array with each NULL replaced by the last value before it within the array."""
    step = lambda acc, x: F.array_append(acc, F.coalesce(x, F.when(F.size(acc) > 0, F.element_at(acc, -1))))
    return F.aggregate(a, F.array().cast("array<double>"), step)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where a filter pulls the expression apart."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fill_window(a: Column) -> Column:
    """Forward fill, then the leading gap from the first value. An array of NULLs stays so."""
    first = F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))
    return let(first, lambda f: F.transform(fill_forward(a), lambda x: F.coalesce(x, f)))


def filled(w: DataFrame, fields: tuple[str, ...] = FIELDS, backward: bool = True) -> DataFrame:
    return w.select("date", "stable_id", *[(fill_window if backward else fill_forward)(F.col(f)).alias(f) for f in fields])


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _moments(a: Column, eps: float) -> Column:
    """Mean and population deviation, floored at eps, in two passes."""
    square = lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return let(_mean(a), lambda m: F.struct(m.alias("m"), F.greatest(F.sqrt(square(m) / F.size(a)), F.lit(eps)).alias("s")))


def _zscore(values: Column, moments: Column) -> Column:
    return let(moments, lambda z: F.transform(values, lambda x: (x - z["m"]) / z["s"]))


def scaled(w: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Filled windows with prices over the window's last close (1 where that is next to 0), log1p of volumes
    floored at 0, and 0 for what stays missing."""
    zero = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(0.0)))
    x = w.select("date", "stable_id", *[zero(F.col(f)).alias(f) for f in FIELDS])
    last = F.element_at("close", -1)
    by = F.when(F.abs(last) < eps, F.lit(1.0)).otherwise(last)
    over = lambda f: let(by, lambda b: F.transform(f, lambda v: v / b)).alias(f)
    return x.select("date", "stable_id", *[over(f) for f in PRICES], F.transform("volume", lambda v: F.log1p(F.greatest(v, F.lit(0.0)))).alias("volume"))


def normalised(w: DataFrame, prices: str = "joint", eps: float = 1e-8) -> DataFrame:
    """Filled windows, scaled and standardised along time: prices by one mean and deviation over all four series
    (`joint`) or each by its own (`per_channel`), volume by its own; deviations are floored at eps."""
    if prices not in ("joint", "per_channel"):
        raise ValueError(f"prices is joint or per_channel, not {prices!r}")
    x = scaled(w, eps)
    of = {f: F.concat(*PRICES) if prices == "joint" else F.col(f) for f in PRICES} | {"volume": F.col("volume")}
    shared = _moments(of["close"], eps) if prices == "joint" else F.lit(None)
    x = x.withColumn("of_prices", shared)
    moments = {f: F.col("of_prices") if prices == "joint" and f in PRICES else _moments(of[f], eps) for f in FIELDS}
    return x.select("date", "stable_id", *[_zscore(F.col(f), moments[f]).alias(f) for f in FIELDS])


def long_form(w: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per window position: date, stable_id, step and the fields."""
    return w.select("date", "stable_id", F.posexplode(F.arrays_zip(*fields)).alias("step", "v")).select("date", "stable_id", "step", *[F.col(f"v.{f}").alias(f) for f in fields])


def forward_return(p: DataFrame, cal: DataFrame, horizon: int, field: str = "close") -> DataFrame:
    """(date, stable_id, ret): value[t + horizon] / value[t] - 1 by calendar position, NULL where the base is not
    above 0 or the future is missing. Every panel row has one row."""
    x = indexed(p.select("date", "stable_id", field), cal)
    ahead = x.select("stable_id", (F.col("date_idx") - horizon).alias("date_idx"), F.col(field).alias("ahead"))
    return x.join(ahead, ["stable_id", "date_idx"], "left").select("date", "stable_id", F.when(F.col(field) > 0, F.col("ahead") / F.col(field) - 1).alias("ret"))


def trailing_return(p: DataFrame, cal: DataFrame, k: int) -> DataFrame:
    """(date, stable_id, factor): the return over the last k positions; rows without one are left out."""
    x = indexed(p.select("date", "stable_id", "close"), cal)
    past = x.select("stable_id", (F.col("date_idx") + k).alias("date_idx"), F.col("close").alias("past"))
    return x.join(past, ["stable_id", "date_idx"]).where("past > 0 and close is not null").select("date", "stable_id", (F.col("close") / F.col("past") - 1).alias("factor"))


def month_ends(cal: DataFrame) -> DataFrame:
    """Calendar with is_month_end: the last panel date of each month; the final date always counts."""
    month = F.date_format("date", "yyyyMM")
    last = F.max("date").over(Window.partitionBy(month))
    return cal.withColumn("is_month_end", F.col("date") == last)


def date_range(cal: DataFrame, start: str | None = None, end: str | None = None, warmup: int = 1) -> DataFrame:
    """Calendar dates from `start` to `end`, both included, that have `warmup` positions behind them, themselves included.
    The calendar keeps its positions, so a start before the warm-up moves to its end."""
    x = cal.where(F.col("date_idx") >= warmup - 1)
    x = x if start is None else x.where(F.col("date") >= F.lit(start).cast("date"))
    return x if end is None else x.where(F.col("date") <= F.lit(end).cast("date"))


def stride(cal: DataFrame, n: int, warmup: int = 1) -> DataFrame:
    """Every n-th calendar date from the first that has `warmup` positions behind it, itself included."""
    return cal.where((F.col("date_idx") >= warmup - 1) & ((F.col("date_idx") - (warmup - 1)) % n == 0))


def year_split(cal: DataFrame, predict_year: int, lookback_years: int = 4, validation_years: int = 1, drop_last_month: bool = True) -> DataFrame:
    """(date, split): `train`, `val` or `predict` around a predicted year, others left out. The December of the last
    train and validation year is dropped, so a forward label cannot reach past the split."""
    y, december = F.year("date"), F.month("date") == 12
    val_lo = predict_year - validation_years
    ends = F.lit(drop_last_month) & december & y.isin(val_lo - 1, predict_year - 1)
    split = F.when(y == predict_year, "predict").when(~ends & y.between(val_lo, predict_year - 1), "val").when(~ends & y.between(predict_year - lookback_years, val_lo - 1), "train")
    return cal.select("date", split.alias("split")).where("split is not null")


def grid_probe(intraday: DataFrame, bar: Column, probes: int = 8) -> DataFrame:
    """(bar_us) of the times of day with a present close on any of `probes` dates spread evenly (half-even
    positions) over the table's dates."""
    x = intraday.where("date is not null and time is not null")
    cal = calendar(x)
    n = F.lit(probes - 1)
    picks = cal.agg((F.max("date_idx")).alias("m")).select(F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.bround(i * F.col("m") / n).cast("int"))).alias("date_idx")).distinct()
    days = cal.join(picks, "date_idx", "left_semi").select("date")
    return x.join(days, "date", "left_semi").groupBy(bar.alias("bar_us")).agg(F.bool_or(finite(F.col("close")).isNotNull()).alias("any")).where("any and bar_us is not null").select("bar_us")


def bars(intraday: DataFrame, bar: Column) -> DataFrame:
    """(date, stable_id, bar_us, open, high, low, close, volume) of readings with a finite close: first and last by
    time, extremes, and summed volume; repeated (date, time, stable_id) rows count once."""
    x = intraday.where("date is not null and stable_id is not null and time is not null")
    once = x.groupBy("date", "stable_id", "time").agg(*[F.max(finite(F.col(f))).alias(f) for f in FIELDS]).where("close is not null").withColumn("bar_us", bar).where("bar_us is not null")
    return once.groupBy("date", "stable_id", "bar_us").agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))


def exposures_one_hot(rows: DataFrame, categories: DataFrame, prefix: str = "ind_", levels: tuple[str, ...] | None = None) -> DataFrame:
    """rows(date, stable_id, cap) joined to categories(stable_id, code): log of positive caps and one 0/1 column for
    each code but the first in sorted order. The codes are `levels`, or those found; their number bounds the columns. Rows of a
    code that `levels` lacks have NULL columns, so they are not taken for the dropped class."""
    codes = sorted(levels) if levels else [r[0] for r in categories.where("code is not null").select("code").distinct().orderBy("code").collect()]
    x = rows.where("cap > 0").join(categories.where("code is not null"), "stable_id")
    return x.select("date", "stable_id", F.log("cap").alias("log_cap"), *[F.when(F.col("code").isin(codes), (F.col("code") == c).cast("double")).alias(f"{prefix}{c}") for c in codes[1:]])
