"""Cross-sections: standardising, neutralising, ranks, weights, rank correlation, buckets and significance.

Ranks break ties by stable_id, so results do not depend on row order. A cross-section is one date's names; the
many-regressor fit is the one operator that brings a date's names to one task (a few thousand rows).
"""

from __future__ import annotations

import warnings
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
YEAR_DAYS = 244  # trading days a year


def by_date():
    return Window.partitionBy("date")


def standardise(df: DataFrame, value: str, eps: float = 1e-8, clip: float | None = None) -> DataFrame:
    """(.., value) as the date's z-score by the population deviation floored at eps, limited to +-clip; NULL where
    the date has fewer than two values."""
    n, m, s = F.count(value).over(by_date()), F.avg(value).over(by_date()), F.stddev_pop(value).over(by_date())
    z = F.when(n >= 2, (F.col(value) - m) / F.greatest(s, F.lit(eps)))
    if clip is not None:
        z = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))
    return df.withColumn(value, z)


def winsorise(df: DataFrame, value: str, sigma: float = 3.0) -> DataFrame:
    return standardise(df, value, clip=sigma)


def neutralise_single(df: DataFrame, value: str, regressor: str) -> DataFrame:
    """(date, stable_id, residual) of a date's fit on [1, regressor]; needs more than two usable names. A constant
    regressor leaves the deviation from the mean."""
    x = df.where(F.col(value).isNotNull() & F.col(regressor).isNotNull())
    slope = F.covar_pop(regressor, value).over(by_date()) / F.nullif(F.var_pop(regressor).over(by_date()), F.lit(0.0))
    resid = F.col(value) - F.avg(value).over(by_date()) - F.coalesce(slope, F.lit(0.0)) * (F.col(regressor) - F.avg(regressor).over(by_date()))
    return x.select("date", "stable_id", F.when(F.count(F.lit(1)).over(by_date()) > 2, resid).alias("residual"))


def neutralise(df: DataFrame, value: str, regressors: list[str]) -> DataFrame:
    """(date, stable_id, residual) of each date's least squares on [1, regressors] over names with all values;
    residual NULL where the names do not exceed the regressors by more than one. Collinear dummies are fine."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(pdf), np.nan)
        x, y = pdf[regressors].to_numpy(float), pdf[value].to_numpy(float)
        if len(pdf) > len(regressors) + 1:
            design = np.hstack([np.ones((len(pdf), 1)), x])
            out = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return pd.DataFrame({"date": pdf["date"], "stable_id": pdf["stable_id"], "residual": out})

    x = df.select("date", "stable_id", value, *regressors).dropna()
    out = x.groupBy("date").applyInPandas(fit, "date date, stable_id long, residual double")
    return out.withColumn("residual", F.when(~F.isnan("residual"), F.col("residual")))


def ordinal(value: str, descending: bool = False) -> Column:
    """Rank from 1 within the date, ties by stable_id."""
    return F.row_number().over(by_date().orderBy(F.desc(value) if descending else F.col(value), "stable_id"))


def average_rank(value: str) -> Column:
    """Rank within the date, ties sharing their mean."""
    return F.rank().over(by_date().orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy("date", value)) - 1) / 2.0


def scored(factor: DataFrame, forward: DataFrame, n_groups: int = 5) -> DataFrame:
    """Names with both factor and forward return on dates that have at least five per group."""
    x = factor.join(forward, ["date", "stable_id"]).where("factor is not null and ret is not null")
    return x.withColumn("n", F.count(F.lit(1)).over(by_date())).where(F.col("n") >= 5 * n_groups)


def rank_ic(x: DataFrame) -> DataFrame:
    """(date, rank_ic, n) of scored names: the correlation of ordinal ranks."""
    r = x.select("date", "n", ordinal("factor").alias("a"), ordinal("ret").alias("b"))
    return r.groupBy("date").agg(F.corr("a", "b").alias("rank_ic"), F.max("n").alias("n"))


def group_returns(x: DataFrame, n_groups: int = 5) -> DataFrame:
    """(date, bucket, ret): mean forward return by bucket of the factor; edges are linear quantiles, and a value on
    an inner edge belongs above it."""
    probs = [g / n_groups for g in range(1, n_groups)]
    edges = x.groupBy("date").agg(F.percentile("factor", F.array(*[F.lit(p) for p in probs])).alias("e"))
    y = x.join(edges, "date").withColumn("bucket", F.size(F.filter("e", lambda e: F.col("factor") >= e)) + 1)
    return y.groupBy("date", "bucket").agg(F.avg("ret").alias("ret"))


def long_short(groups: DataFrame, n_groups: int = 5) -> DataFrame:
    """(date, top, bottom, mean_group, long_short)."""
    pick = lambda g: F.max(F.when(F.col("bucket") == g, F.col("ret")))
    x = groups.groupBy("date").agg(pick(n_groups).alias("top"), pick(1).alias("bottom"), F.avg("ret").alias("mean_group"))
    return x.withColumn("long_short", F.col("top") - F.col("bottom"))


def _ratio(value: Column, sd: Column, periods: float) -> Column:
    return F.when(sd > 0, value / sd * F.sqrt(F.lit(periods)))


def summary(ic: DataFrame, ls: DataFrame, horizon: int) -> DataFrame:
    """One row of n_periods, rank_ic, icir, ic_win_rate, long_short_annual, long_short_vol, long_short_sharpe,
    top_group_annual and top_minus_equal_weight; ratios are NULL where their deviation is."""
    p = YEAR_DAYS / horizon
    x = ic.join(ls, "date", "left")
    sd, lsd = F.stddev_samp("rank_ic"), F.stddev_samp("long_short")
    return x.agg(
        F.count("rank_ic").alias("n_periods"), F.avg("rank_ic").alias("rank_ic"), _ratio(F.avg("rank_ic"), sd, p).alias("icir"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("ic_win_rate"), (F.avg("long_short") * p).alias("long_short_annual"),
        (lsd * F.sqrt(F.lit(p))).alias("long_short_vol"), _ratio(F.avg("long_short"), lsd, p).alias("long_short_sharpe"),
        (F.avg("top") * p).alias("top_group_annual"), (F.avg(F.col("top") - F.col("mean_group")) * p).alias("top_minus_equal_weight"),
    )


def by_year(ic: DataFrame, ls: DataFrame, horizon: int) -> DataFrame:
    p = YEAR_DAYS / horizon
    x = ic.join(ls, "date", "left").groupBy(F.year("date").alias("year"))
    return x.agg(F.avg("rank_ic").alias("rank_ic"), _ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic"), p).alias("icir"), (F.avg("long_short") * p).alias("long_short_annual"))


def rank_weights(df: DataFrame, value: str, halflife: float = 0.5) -> DataFrame:
    """(date, stable_id, weight): halves every halflife x n places from the best down, sums to 1 per date."""
    n = F.count(F.lit(1)).over(by_date())
    raw = F.pow(F.lit(0.5), (ordinal(value, True) - 1) / F.greatest(n * halflife, F.lit(1.0)))
    x = df.where(F.col(value).isNotNull()).withColumn("raw", raw)
    return x.withColumn("weight", F.col("raw") / F.sum("raw").over(by_date())).drop("raw")


def weighted_correlation(x: DataFrame, a: str, b: str, w: str = "weight", eps: float = 1e-8) -> DataFrame:
    """(date, wcorr) in one pass; variances are floored at eps; w sums to 1 per date."""
    wt, p, q = F.col(w), F.col(a), F.col(b)
    s = x.groupBy("date").agg(F.sum(wt * p).alias("ma"), F.sum(wt * q).alias("mb"), F.sum(wt * p * q).alias("ab"), F.sum(wt * p * p).alias("aa"), F.sum(wt * q * q).alias("bb"))
    va, vb = F.greatest(F.expr("aa - ma * ma"), F.lit(eps)), F.greatest(F.expr("bb - mb * mb"), F.lit(eps))
    return s.select("date", (F.expr("ab - ma * mb") / F.sqrt(va * vb)).alias("wcorr"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date, rho, n) of two factor tables over their common names; ties share their mean rank."""
    x = a.select("date", "stable_id", F.col("factor").alias("fa")).join(b.select("date", "stable_id", F.col("factor").alias("fb")), ["date", "stable_id"]).where("fa is not null and fb is not null")
    r = x.select("date", average_rank("fa").alias("ra"), average_rank("fb").alias("rb"))
    return r.groupBy("date").agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def ensemble(factors: list[DataFrame]) -> DataFrame:
    """(date, stable_id, factor): mean of the tables' z-scores over the names all of them have."""
    out = None
    for i, f in enumerate(factors):
        f = f.select("date", "stable_id", F.col("factor").alias(f"f{i}"))
        out = f if out is None else out.join(f, ["date", "stable_id"])
    for i in range(len(factors)):
        out = standardise(out, f"f{i}", eps=0.0 + 1e-300)
    return out.select("date", "stable_id", (sum(F.col(f"f{i}") for i in range(len(factors))) / len(factors)).alias("factor"))


def paired_t(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, mean_diff, t, lo, hi) of b - a over common dates, with the 95 % band by 1.96 standard errors."""
    d = a.select("date", F.col("rank_ic").alias("a")).join(b.select("date", F.col("rank_ic").alias("b")), "date").select((F.col("b") - F.col("a")).alias("d")).dropna()
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"))
    return s.select("n", "mean_diff", F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se")).alias("t"), (F.col("mean_diff") - 1.96 * F.col("se")).alias("lo"), (F.col("mean_diff") + 1.96 * F.col("se")).alias("hi"))


def newey_west(series: DataFrame, value: str, lag: int = 20) -> DataFrame:
    """(n, mean, se, t) of a series(date, value) with Bartlett weights. A row per date: its own few thousand rows
    are numbered in one window and joined to themselves by the lags."""
    x = series.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("i"))
    stats = x.agg(F.struct(F.avg("v").alias("m"), F.count("v").alias("n")).alias("s")).scalar()
    c = x.select("i", "v", stats.alias("s")).select("i", (F.col("v") - F.col("s.m")).alias("c"), F.col("s.m").alias("m"), F.col("s.n").alias("n"))
    later = c.select(F.explode(F.sequence(F.lit(0), F.lit(lag))).alias("lag"), "i", F.col("c").alias("c2")).select("lag", (F.col("i") - F.col("lag")).alias("i"), "c2")
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (lag + 1)))
    g = c.join(later, "i").agg(F.sum(weight * F.col("c") * F.col("c2") / F.col("n")).alias("g"), F.max("m").alias("mean"), F.max("n").alias("n"))
    se = F.sqrt(F.col("g") / F.col("n"))
    return g.select("n", "mean", F.when(F.col("g") > 0, se).alias("se"), F.when(F.col("g") > 0, F.col("mean") / se).alias("t"))


def seed_spread(runs: DataFrame, metric: str) -> DataFrame:
    """(arm, mean, sd, n) of runs(arm, seed, metric)."""
    return runs.groupBy("arm").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"))


def gauss_rank(df: DataFrame, features: list[str], edge: float = 0.999999) -> DataFrame:
    """Each feature as the normal score of its rank within the date, (rank + 0.5) / n; missing values stay NULL and
    a date with one name scores 0. Ranks are built in; only the inverse normal runs in Python, batch by batch."""
    x = df
    for f in features:
        n = F.count(f).over(by_date())
        rk = F.row_number().over(by_date().orderBy(F.col(f).asc_nulls_last(), "stable_id"))
        p = F.when(n < 2, F.lit(0.5)).otherwise((rk - 0.5) / n)
        x = x.withColumn(f"__p_{f}", F.when(F.col(f).isNotNull(), p))
    lo = (1 - edge) / 2

    @F.pandas_udf("double")
    def probit(s: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        p = s.to_numpy(float)
        u, back = np.unique(np.clip(p[~np.isnan(p)], lo, 1 - lo), return_inverse=True)
        out = np.full(len(p), np.nan)
        out[~np.isnan(p)] = np.array([inv(v) for v in u])[back] if len(u) else []
        return pd.Series(out)

    score = lambda f: F.when(F.col(f"__p_{f}").isNotNull(), probit(F.col(f"__p_{f}")))
    return x.select(*[score(c).alias(c) if c in features else F.col(c) for c in df.columns])


def evaluate(factor: DataFrame, forward: DataFrame, dates: DataFrame | None = None, horizon: int = 20, n_groups: int = 5) -> dict[str, DataFrame]:
    """summary, by_year, ic and groups of a factor; `dates` limits the rebalance dates."""
    if dates is not None:
        factor = factor.join(dates.select("date"), "date", "left_semi")
    x = scored(factor, forward, n_groups)
    ic, groups = rank_ic(x), group_returns(x, n_groups)
    ls = long_short(groups, n_groups)
    return {"summary": summary(ic, ls, horizon), "by_year": by_year(ic, ls, horizon), "ic": ic, "groups": groups, "long_short": ls}


def labels(p: DataFrame, cal: DataFrame, horizon: int = 20, precomputed: DataFrame | None = None, exposures: DataFrame | None = None, regressors: list[str] | None = None, clip: float = 3.0) -> DataFrame:
    """(date, stable_id, label): a precomputed forward column standardised as it is, or the forward return,
    neutralised where exposures are given, then standardised; limited to +-clip. Both at once is an error; neither gives
    labels that are standardised only, with a warning."""
    from tidepath.operators.panel import forward_return

    if precomputed is not None and exposures is not None:
        raise ValueError("a precomputed label is never neutralised again")
    if precomputed is not None:
        x = precomputed.select("date", "stable_id", "label")
    else:
        x = forward_return(p, cal, horizon).withColumnRenamed("ret", "label")
        if exposures is None:
            warnings.warn("labels are standardised but not neutralised: no exposures are given", stacklevel=2)
        else:
            if not regressors:
                raise ValueError("regressors are required with exposures")
            x = neutralise(x.join(exposures, ["date", "stable_id"]), "label", regressors).withColumnRenamed("residual", "label")
    return standardise(x, "label", clip=clip).where("label is not null")


def require_label(rows: DataFrame) -> DataFrame:
    """Rows with a label; a date with fewer than three labelled names keeps all."""
    return rows.withColumn("__n", F.count("label").over(by_date())).where("label is not null or __n < 3").drop("__n")
