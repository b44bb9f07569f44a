"""Evaluation with options, comparison of arms, runs by year, significance as one call, and the text report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepath.operators import factor as X


def neutralise_grouped(df: DataFrame, value: str, regressor: str, dummies: list[str]) -> DataFrame:
    """(date, stable_id, residual) of each date's least squares on [1, regressor, dummies], the dummies being 0/1 and
    exclusive: the same as factor.neutralise, since such dummies take out group means (Frisch-Waugh). Value and regressor are
    freed of their group's mean and one slope is left, so all of it is window sums. Rows with a missing value are left out;
    residual NULL where the names do not exceed the regressors by more than one."""
    x = df.select("date", "stable_id", F.col(value).cast("double").alias("y"), F.col(regressor).cast("double").alias("x"), F.concat_ws(",", *[F.col(c).cast("int").cast("string") for c in dummies]).alias("g"), *dummies)
    x = x.dropna()
    group = Window.partitionBy("date", "g")
    x = x.select("date", "stable_id", (F.col("y") - F.avg("y").over(group)).alias("y"), (F.col("x") - F.avg("x").over(group)).alias("x"))
    by = X.by_date()
    xx = F.sum(F.col("x") * F.col("x")).over(by)
    slope = F.when(xx > 1e-12, F.sum(F.col("x") * F.col("y")).over(by) / xx).otherwise(F.lit(0.0))
    return x.select("date", "stable_id", F.when(F.count(F.lit(1)).over(by) > len(dummies) + 2, F.col("y") - slope * F.col("x")).alias("residual"))


def neutral_factor(factor: DataFrame, exposures: DataFrame, regressor: str, dummies: list[str], sigma: float = 3.0) -> DataFrame:
    """The factor standardised, limited to +-sigma and residualised against the exposures; not standardised again."""
    x = X.winsorise(factor, "factor", sigma).join(exposures, ["date", "stable_id"])
    return neutralise_grouped(x, "factor", regressor, dummies).withColumnRenamed("residual", "factor")


def evaluate(factor: DataFrame, forward: DataFrame, dates: DataFrame | None = None, horizon: int = 20, n_groups: int = 5, label: DataFrame | None = None, exposures: DataFrame | None = None, regressor: str = "", dummies: list[str] | None = None, sigma: float = 3.0) -> dict[str, DataFrame]:
    """As factor.evaluate; against `label` (date, stable_id, ret) in place of the forward return where one is given, and
    neutralised first where exposures are."""
    if exposures is not None:
        if not regressor:
            raise ValueError("exposures need the name of their regressor")
        factor = neutral_factor(factor, exposures, regressor, dummies or [], sigma)
    return X.evaluate(factor, forward if label is None else label, dates, horizon, n_groups)


def report(result: dict[str, DataFrame]) -> str:
    """The summary and the years as text. One row and a row per year reach the driver."""
    number = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"{k:<24}{number(v):>12}" for k, v in result["summary"].first().asDict().items()]
    years = [r.asDict() for r in result["by_year"].orderBy("year").collect()]
    if years:
        lines += ["", "".join(f"{k:>18}" for k in years[0]), *["".join(f"{number(v):>18}" for v in y.values()) for y in years]]
    return "\n".join(lines)


def compare_arms(arms: dict[str, DataFrame], published: DataFrame) -> DataFrame:
    """(arm, year, rank_ic, icir, long_short_annual, published_rank_ic, difference) of by_year tables, joined to a small table
    (year, published_rank_ic) of figures to compare with. An arm that is None, one that could not be made, is left out."""
    tables = [t.withColumn("arm", F.lit(a)) for a, t in arms.items() if t is not None]
    if not tables:
        raise ValueError("no arm has results")
    x = reduce(DataFrame.unionByName, tables).join(published, "year", "left")
    return x.select("arm", "year", "rank_ic", "icir", "long_short_annual", "published_rank_ic", (F.col("rank_ic") - F.col("published_rank_ic")).alias("difference"))


def runs_by_year(runs: DataFrame, horizon: int) -> DataFrame:
    """(arm, year, runs, rank_ic, rank_ic_sd, long_short_vol, long_short_sharpe) over runs(arm, seed, date, rank_ic,
    long_short): each run's figures of a year, then their mean over the runs; the deviation needs two of them, a run's
    volatility two dates."""
    p = X.YEAR_DAYS / horizon
    sd = F.stddev_samp("long_short")
    one = runs.groupBy("arm", "seed", F.year("date").alias("year")).agg(F.avg("rank_ic").alias("ic"), (sd * F.sqrt(F.lit(p))).alias("vol"), F.when(sd > 0, F.avg("long_short") / sd * F.sqrt(F.lit(p))).alias("sharpe"))
    return one.groupBy("arm", "year").agg(F.count("ic").alias("runs"), F.avg("ic").alias("rank_ic"), F.stddev_samp("ic").alias("rank_ic_sd"), F.avg("vol").alias("long_short_vol"), F.avg("sharpe").alias("long_short_sharpe"))


def significance(arms: dict[str, DataFrame], forward: DataFrame, month_ends: DataFrame, base: str, lag: int = 20, n_groups: int = 5) -> dict[str, DataFrame]:
    """Of factor tables by name: `paired` (arm, n, mean_diff, t, lo, hi: monthly rank ICs against those of `base`), `newey_west`
    (arm, n, mean, se, t: daily ones), `rho` (a, b, rho: mean rank correlation of two arms) and `blend` (their equal-weight mean)."""
    if base not in arms:
        raise ValueError(f"{base!r} is none of {sorted(arms)}")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    daily = {a: X.rank_ic(X.scored(f, forward, n_groups)) for a, f in arms.items()}
    monthly = {a: ic.join(month_ends.select("date"), "date", "left_semi") for a, ic in daily.items()}
    names = sorted(arms)
    others = [a for a in names if a != base] or [base]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]] or [(base, base)]
    return {
        "paired": union([X.paired_t(monthly[base], monthly[a]).withColumn("arm", F.lit(a)) for a in others]),
        "newey_west": union([X.newey_west(daily[a], "rank_ic", lag).withColumn("arm", F.lit(a)) for a in names]),
        "rho": union([X.spearman(arms[a], arms[b]).agg(F.avg("rho").alias("rho")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho") for a, b in pairs]),
        "blend": X.ensemble([arms[a] for a in names]),
    }
