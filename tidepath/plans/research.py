"""Queries of the evaluation options, arms, exports, date ranges and the minute branch, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.functions.cols import finite
from tidepath.operators import factor as X
from tidepath.operators import minute as M
from tidepath.operators import network as N
from tidepath.operators import panel as P
from tidepath.operators import research as R
from tidepath.operators import signature as S
from tidepath.operators import training as T
from tidepath.operators.regrid import bar_of, bar_starts
from tidepath.plans import reference as Q
from tidepath.sources import periods
from tidepath.sources.tables import read, written

H, GROUPS, DAYS = Q.H, Q.GROUPS, 3
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


_DT, _P, _E, _IC, _SCORED, _FAC, _FWD, _G = Q._DT, Q._P, Q._E, Q._IC, Q._SCORED, Q._FAC, Q._FWD, Q._G
_INDS = tuple(f"ind_{c}" for c in Q._CODES)
_FULL = "ex AS (SELECT date, stable_id, max(CASE WHEN isfinite(log_mktcap) AND log_mktcap BETWEEN 5 AND 60 THEN log_mktcap END) AS size, " + ", ".join(f"max(CASE WHEN isfinite({c}) THEN {c}::INT END) AS {c}" for c in _INDS) + f" FROM exposures WHERE date IS NOT NULL AND stable_id IS NOT NULL GROUP BY 1, 2), eg AS (SELECT date, stable_id, size, concat_ws(',', {', '.join(_INDS)}) AS g FROM ex WHERE size IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _INDS)})"


def _residual(source: str, value: str, name: str = "res") -> str:
    return f"dm AS (SELECT s.date, s.stable_id, s.{value} - avg(s.{value}) OVER q AS y, e.size - avg(e.size) OVER q AS x FROM {source} s JOIN eg e ON s.date = e.date AND s.stable_id = e.stable_id WHERE s.{value} IS NOT NULL WINDOW q AS (PARTITION BY s.date, e.g)), sl AS (SELECT date, CASE WHEN sum(x * x) > 1e-12 THEN sum(x * y) / sum(x * x) ELSE 0 END AS b, count(*) AS n FROM dm GROUP BY 1), {name} AS (SELECT dm.date, dm.stable_id, CASE WHEN n > {len(_INDS) + 2} THEN y - b * x END AS residual FROM dm JOIN sl ON dm.date = sl.date)"


@query(f"WITH {Q._EXP}, {_FULL}, {_residual('lab', 'label')} SELECT {_DT}, stable_id, round(residual, 6) + 0.0 AS residual FROM res")
def neutralise_multi(spark, d):
    x = Q._labels(spark, d).join(Q._exposures(spark, d), ["date", "stable_id"])
    r = R.neutralise_grouped(x, "label", "log_mktcap", [c for c in x.columns if c.startswith("ind_")])
    return Q.out(r).withColumn("residual", F.col("residual") + F.lit(0.0))


_NEUTRAL = f"{_P}, {_FAC(5, 'raw')}, z AS (SELECT date, stable_id, {Q._Z('factor', '3.0')} AS factor FROM raw), {_FULL}, {_residual('z', 'factor')}, fac AS (SELECT date, stable_id, residual AS factor FROM res), {_FWD}"


def _neutral(spark, d):
    e = Q._exposures(spark, d)
    return R.neutral_factor(Q._factor(spark, d), e, "log_mktcap", [c for c in e.columns if c.startswith("ind_")])


@query(f"WITH {_NEUTRAL}, {_SCORED()}, {_IC()} SELECT {_DT}, round(rank_ic, 6) AS rank_ic, n FROM ic")
def rank_ic_neutralised(spark, d):
    """The factor clipped, standardised and residualised against all exposures before it is scored."""
    return Q.out(X.evaluate(_neutral(spark, d), Q._forward(spark, d), None, H, GROUPS)["ic"])


@query(f"WITH {_NEUTRAL}, {Q._EXP}, scored AS (SELECT * FROM (SELECT f.date, f.stable_id, f.factor, label AS ret, count(*) OVER (PARTITION BY f.date) AS n FROM fac f JOIN lab l ON f.date = l.date AND f.stable_id = l.stable_id WHERE label IS NOT NULL AND f.factor IS NOT NULL) WHERE n >= {5 * GROUPS}), {_IC()} SELECT count(rank_ic) AS n_periods, round(avg(rank_ic), 6) AS rank_ic, round(avg((rank_ic > 0)::INT), 6) AS ic_win_rate FROM ic")
def evaluate_neutral_against_label(spark, d):
    e = Q._exposures(spark, d)
    label = Q._labels(spark, d).withColumnRenamed("label", "ret")
    got = R.evaluate(Q._factor(spark, d), Q._forward(spark, d), None, 20, GROUPS, label, e, "log_mktcap", [c for c in e.columns if c.startswith("ind_")])
    return Q.out(got["summary"].select("n_periods", "rank_ic", "ic_win_rate"))


# --- arms and runs
_PUBLISHED = ((2020, 0.1284), (2021, 0.1080), (2022, 0.1002), (2023, 0.1247), (2024, 0.1049))  # fixed values: published rank ICs by year
_ARM = lambda k: f"{_FAC(k, f'f{k}')}, {_SCORED(f'f{k}', f's{k}')}, {_IC(f's{k}', f'i{k}')}"
_LS = lambda k: f"e{k} AS (SELECT date, {', '.join(f'quantile_cont(factor, {g / GROUPS}) AS q{g}' for g in range(1, GROUPS))} FROM s{k} GROUP BY 1), g{k} AS (SELECT date, {' + '.join(f'(factor >= q{g})::INT' for g in range(1, GROUPS))} + 1 AS bucket, avg(ret) AS ret FROM s{k} JOIN e{k} USING (date) GROUP BY 1, 2), l{k} AS (SELECT date, max(ret) FILTER (bucket = {GROUPS}) - max(ret) FILTER (bucket = 1) AS ls FROM g{k} GROUP BY 1)"
_PY = X.YEAR_DAYS / H


@query("WITH " + _P + f", {_FWD}, " + ", ".join(f"{_ARM(k)}, {_LS(k)}" for k in (5, 10)) + ", pub(year, p) AS (VALUES " + ", ".join(f"({y}, {v}::DOUBLE)" for y, v in _PUBLISHED) + "), arms AS (" + " UNION ALL ".join(f"SELECT '{n}' AS arm, year(date)::INT AS year, avg(rank_ic) AS rank_ic, avg(rank_ic) / stddev_samp(rank_ic) * sqrt({_PY}) AS icir, avg(ls) * {_PY} AS long_short_annual FROM i{k} JOIN l{k} USING (date) GROUP BY 2" for n, k in (("five", 5), ("ten", 10))) + ") SELECT arm, arms.year, round(rank_ic, 6) AS rank_ic, round(icir, 6) AS icir, round(long_short_annual, 6) AS long_short_annual, p AS published_rank_ic, round(rank_ic - p, 6) AS difference FROM arms LEFT JOIN pub ON arms.year = pub.year")
def arm_comparison(spark, d):
    arms = {n: X.evaluate(Q._factor(spark, d, k), Q._forward(spark, d), None, H, GROUPS)["by_year"] for n, k in (("five", 5), ("ten", 10))}
    return Q.out(R.compare_arms(arms | {"failed": None}, spark.createDataFrame(list(_PUBLISHED), "year int, published_rank_ic double")))


_SEEDS = (("short", 1), ("short", 2), ("long", 8), ("long", 10))


@query("WITH " + _P + f", {_FWD}, " + ", ".join(f"{_ARM(k)}, {_LS(k)}" for _, k in _SEEDS) + ", runs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, {k} AS seed, year(date)::INT AS year, avg(rank_ic) AS ic, stddev_samp(ls) * sqrt({_PY}) AS vol, avg(ls) / nullif(stddev_samp(ls), 0) * sqrt({_PY}) AS sharpe FROM i{k} JOIN l{k} USING (date) GROUP BY 3" for a, k in _SEEDS) + ") SELECT arm, year, count(ic) AS runs, round(avg(ic), 6) AS rank_ic, round(stddev_samp(ic), 6) AS rank_ic_sd, round(avg(vol), 6) AS long_short_vol, round(avg(sharpe), 6) AS long_short_sharpe FROM runs GROUP BY 1, 2")
def seed_by_year(spark, d):
    def run(a, k):
        e = X.evaluate(Q._factor(spark, d, k), Q._forward(spark, d), None, H, GROUPS)
        return e["ic"].join(e["long_short"], "date").select(F.lit(a).alias("arm"), F.lit(k).alias("seed"), "date", "rank_ic", "long_short")

    return Q.out(R.runs_by_year(reduce(DataFrame.unionByName, [run(a, k) for a, k in _SEEDS]), H))


@query("WITH " + _P + f", {_FWD}, " + ", ".join(_ARM(k) for k in (5, 10)) + f", ends AS (SELECT max(date) AS date FROM cal GROUP BY strftime(date, '%Y%m')), dd AS (SELECT b.rank_ic - a.rank_ic AS d FROM i5 a JOIN i10 b ON a.date = b.date WHERE a.date IN (SELECT date FROM ends)), rh AS (SELECT date, corr(ra, rb) AS rho FROM (SELECT date, {Q._AVG('fa')} AS ra, {Q._AVG('fb')} AS rb FROM (SELECT a.date, a.factor AS fa, b.factor AS fb FROM f5 a JOIN f10 b ON a.date = b.date AND a.stable_id = b.stable_id)) GROUP BY 1) SELECT 'paired' AS part, 'ten' AS arm, round(avg(d), 6) AS value FROM dd UNION ALL SELECT 'daily', 'five', round(avg(rank_ic), 6) FROM i5 UNION ALL SELECT 'daily', 'ten', round(avg(rank_ic), 6) FROM i10 UNION ALL SELECT 'rho', 'five-ten', round(avg(rho), 6) FROM rh")
def significance_suite(spark, d):
    p = Q._panel(spark, d)
    got = R.significance({"five": Q._factor(spark, d, 5), "ten": Q._factor(spark, d, 10)}, Q._forward(spark, d), P.month_ends(P.calendar(p)).where("is_month_end"), "five", 5, GROUPS)
    part = lambda df, name, arm, v: df.select(F.lit(name).alias("part"), arm.alias("arm"), F.round(v, 6).alias("value"))
    x = part(got["paired"], "paired", F.col("arm"), "mean_diff").unionByName(part(got["newey_west"], "daily", F.col("arm"), "mean"))
    return x.unionByName(part(got["rho"], "rho", F.concat_ws("-", "a", "b"), "rho"))


# --- exports and dates
@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, count(DISTINCT date) AS dates, count(DISTINCT stable_id) AS names, count(*) AS n_rows FROM (SELECT DISTINCT date, stable_id FROM {t} WHERE date IS NOT NULL AND stable_id IS NOT NULL)" for t in ("exposures", "labels")))
def export_coverage(spark, d):
    parts = [periods.coverage_report(t(spark, d)).withColumn("table_name", F.lit(n)) for n, t in (("exposures", Q._exposures), ("labels", Q._labels))]
    return Q.out(parts[0].unionByName(parts[1]))


@query(f"WITH {_P} SELECT {_DT}, date_idx FROM cal WHERE date BETWEEN DATE '2021-02-01' AND DATE '2021-03-31' AND date_idx >= {Q.K - 1}")
def date_range_samples(spark, d):
    return Q.out(P.date_range(P.calendar(Q._panel(spark, d)), "2021-02-01", "2021-03-31", Q.K))


_BARS = f"once AS (SELECT date, stable_id, time, max(CASE WHEN isfinite(close) THEN close::DOUBLE END) AS close, max(CASE WHEN isfinite(volume) THEN volume::DOUBLE END) AS volume FROM intraday WHERE date IS NOT NULL AND stable_id IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2, 3), bb AS (SELECT date, stable_id, {Q._BAR('time')} AS bar_us, arg_max(close, time) AS close, sum(volume) AS volume FROM once WHERE close IS NOT NULL AND {Q._BAR('time')} IS NOT NULL GROUP BY 1, 2, 3)"
_GRID = "grid AS (SELECT 34200000000 + 300000000 * i AS bar_us, i AS bar FROM range(24) r(i) UNION ALL SELECT 46800000000 + 300000000 * i, 24 + i FROM range(24) r(i))"


def _bars(spark, d):
    """By source, so that one shuffle serves the sums over times and bars and the fills along a source."""
    return P.bars(read(spark, d, "intraday", ("date", "time", "stable_id", *P.FIELDS)).repartition("stable_id"), bar_of(F.col("time")))


@query(f"WITH {_BARS}, {_GRID}, last_day AS (SELECT max(date) AS date FROM bb), ids AS (SELECT DISTINCT stable_id FROM bb WHERE date = (SELECT date FROM last_day)) SELECT i.stable_id, g.bar_us::BIGINT AS bar_us, round(close, 4) AS close, round(volume, 4) AS volume FROM ids i CROSS JOIN grid g LEFT JOIN bb ON bb.stable_id = i.stable_id AND bb.bar_us = g.bar_us AND bb.date = (SELECT date FROM last_day)")
def intraday_day_slice(spark, d):
    """The last day's dense grid."""
    bars = _bars(spark, d)
    last = bars.agg(F.max("date").cast("string")).first()[0]
    return Q.out(M.day_slice(bars, last or "1970-01-01", bar_starts(), ("close", "volume")), 4)


# --- minute branch
def _minute_calendar(spark, d):
    """The dates that have bars, without making the bars: one usable reading is enough."""
    x = read(spark, d, "intraday", ("date", "time", "stable_id", "close"))
    return P.calendar(x.where(F.col("stable_id").isNotNull() & finite(F.col("close")).isNotNull() & bar_of(F.col("time")).isNotNull()))


_PTS = f"{_BARS}, {_GRID}, mcal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS date_idx FROM (SELECT DISTINCT date FROM bb)), dd AS (SELECT DISTINCT stable_id, date FROM bb), cells AS (SELECT dd.stable_id, dd.date, g.bar_us, g.bar FROM dd CROSS JOIN grid g), fl AS (SELECT c.stable_id, c.date, c.bar, c.bar_us, last_value(CASE WHEN bb.close > 0 THEN bb.close END IGNORE NULLS) OVER (PARTITION BY c.stable_id ORDER BY c.date, c.bar_us ROWS UNBOUNDED PRECEDING) AS close FROM cells c LEFT JOIN bb ON bb.stable_id = c.stable_id AND bb.date = c.date AND bb.bar_us = c.bar_us), pts AS (SELECT stable_id, fl.date, date_idx, bar_us, (date_idx * 48 + bar) / 100.0::DOUBLE AS x0, ln(close) * 10 AS x1 FROM fl JOIN mcal ON fl.date = mcal.date WHERE close IS NOT NULL), days AS (SELECT stable_id, date, date_idx, count(*) OVER (PARTITION BY stable_id ORDER BY date_idx RANGE BETWEEN {DAYS - 1} PRECEDING AND CURRENT ROW) AS n FROM (SELECT DISTINCT stable_id, date, date_idx FROM pts))"


@query(f"WITH {_PTS}, w AS (SELECT v.stable_id, v.date, p.date AS pdate, p.bar_us, x0, x1 FROM days v JOIN pts p ON p.stable_id = v.stable_id AND p.date_idx BETWEEN v.date_idx - {DAYS - 1} AND v.date_idx WHERE v.n = {DAYS} AND v.date_idx >= {DAYS - 1}), i AS (SELECT stable_id, date, " + ", ".join(f"x{c} - lag(x{c}) OVER o AS d{c}, lag(x{c}) OVER o - first_value(x{c}) OVER o AS a{c}" for c in (0, 1)) + f" FROM w WINDOW o AS (PARTITION BY stable_id, date ORDER BY pdate, bar_us)) SELECT {_DT}, stable_id, " + ", ".join(f"round(sum(d{c}), 5) AS s_{c}" for c in (0, 1)) + ", " + ", ".join(f"round(sum(a{a} * d{b} + d{a} * d{b} / 2), 5) AS s_{a}{b}" for a in (0, 1) for b in (0, 1)) + " FROM i WHERE d0 IS NOT NULL GROUP BY stable_id, date")
def minute_signature_d2(spark, d):
    """Depth-2 signatures of time and log close over whole days of bars, from day sums."""
    cal = _minute_calendar(spark, d)
    x = M.filled_bars(_bars(spark, d), cal, bar_starts())
    bar = F.when(F.col("bar_us") < 43_200_000_000, (F.col("bar_us") - 34_200_000_000) / 300_000_000).otherwise(24 + (F.col("bar_us") - 46_800_000_000) / 300_000_000)
    pts = x.select("stable_id", "date", "date_idx", "bar_us", ((F.col("date_idx") * 48 + bar) / 100.0).alias("t"), (F.log("close") * 10).alias("c"))
    s = M.sql_window_signature(pts, DAYS, ["t", "c"])
    return s.select(Q.day(F.col("date")).alias("date"), "stable_id", *[F.round(c, 5).alias(c) for c in s.columns[2:]])


@query(f"WITH {_PTS} SELECT {_DT}, stable_id FROM days WHERE n = {DAYS} AND date_idx >= {DAYS - 1}")
def minute_mask(spark, d):
    """Sources and dates whose minute branch is valid."""
    cal = _minute_calendar(spark, d)
    days = M.filled_bars(_bars(spark, d), cal, bar_starts()).select("stable_id", "date", "date_idx").distinct()
    n = days.withColumn("n", F.count(F.lit(1)).over(P.trailing(DAYS)))
    return Q.out(n.where((F.col("n") == DAYS) & (F.col("date_idx") >= DAYS - 1)).select("date", "stable_id"))


def _minute_features(spark, d, depth):
    return M.minute_features(_bars(spark, d), _minute_calendar(spark, d), bar_starts(), DAYS, depth)


@query()
def minute_features_d5(spark, d):
    """The minute branch's 80 features from day elements."""
    return _minute_features(spark, d, 5).select(Q.day(F.col("date")).alias("date"), "stable_id", F.transform("feature", lambda v: F.round(v, 4)).alias("feature"))


@query()
def two_branch_factor(spark, d):
    """The seeded network on both branches, names valid in both."""
    # the minute branch covers few of the daily dates
    daily = Q._features(spark, d, 2, _minute_calendar(spark, d).select("date")).withColumnRenamed("feature", "daily")
    both = daily.join(_minute_features(spark, d, 3).withColumnRenamed("feature", "minute"), ["date", "stable_id"])
    widths = {"daily": S.feature_count(5, Q.K, 2, Q._PAIRS), "minute": S.width(M.CHANNELS, 3)}
    return Q.out(N.predict(both, N.factor_network(widths), {"daily": "daily", "minute": "minute"}))


# --- yearly refits, on a panel of monthly supplier prices over several years
_YEARS, _RIDGE = (1997, 1998), 5.0
_MP = "px AS (SELECT date_trunc('month', l_shipdate::DATE)::DATE AS date, l_suppkey AS stable_id, sum(l_extendedprice::DOUBLE) / sum(l_quantity::DOUBLE) AS close FROM lineitem GROUP BY 1, 2), mc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM px)), pi AS (SELECT px.*, i FROM px JOIN mc USING (date)), fx AS (SELECT a.date, a.stable_id, a.close / b.close - 1 AS f, c.close / a.close - 1 AS r FROM pi a LEFT JOIN pi b ON a.stable_id = b.stable_id AND b.i = a.i - 1 LEFT JOIN pi c ON a.stable_id = c.stable_id AND c.i = a.i + 1), lb AS (SELECT date, stable_id, f, CASE WHEN r IS NULL THEN NULL WHEN count(r) OVER w >= 2 THEN least(greatest((r - avg(r) OVER w) / greatest(stddev_pop(r) OVER w, 1e-8), -3), 3) END AS y FROM fx WINDOW w AS (PARTITION BY date))"


def _monthly(spark, d):
    x = read(spark, d, "lineitem", ("l_shipdate", "l_suppkey", "l_extendedprice", "l_quantity"))
    by = x.groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("date"), F.col("l_suppkey").cast("long").alias("stable_id"))
    p = by.agg((F.sum(F.col("l_extendedprice").cast("double")) / F.sum(F.col("l_quantity").cast("double"))).alias("close"))
    cal = P.calendar(p)
    label = X.standardise(P.forward_return(p, cal, 1).withColumnRenamed("ret", "label"), "label", clip=3.0)
    rows = P.trailing_return(p, cal, 1).join(label, ["date", "stable_id"], "left")
    return rows.select("date", "stable_id", "label", F.array("factor").alias("feature")), cal


@query("WITH " + _MP + ", tr(yr, y, f) AS (" + " UNION ALL ".join(f"SELECT {v}, y, f FROM lb WHERE f IS NOT NULL AND y IS NOT NULL AND year(date) BETWEEN {v - 3} AND {v - 1} AND NOT (month(date) = 12 AND year(date) IN ({v - 2}, {v - 1}))" for v in _YEARS) + f"), sm AS (SELECT yr, sum(f * f) + {_RIDGE} AS xx, sum(f) AS x, count(*) + {_RIDGE} * 1e-9 AS n, sum(f * y) AS xy, sum(y) AS y FROM tr GROUP BY 1), co AS (SELECT yr, (xy * n - x * y) / (xx * n - x * x) AS b, (xx * y - x * xy) / (xx * n - x * x) AS a FROM sm) SELECT {_DT}, stable_id, round(a + b * f, 5) AS factor FROM lb JOIN co ON year(date) = yr WHERE f IS NOT NULL")
def rolling_ridge_factor(spark, d):
    """A ridge fit for each year on the years before it, predicting that year."""
    rows, cal = _monthly(spark, d)
    return Q.out(T.rolling_ridge(rows, cal, list(_YEARS), "feature", 1, _RIDGE, 3, 1), 5)


@query()
def rolling_network_factor(spark, d):
    """The network trained by distributed gradients, by the whole default plan, for each year that has train dates among the four
    years before it, predicting that year."""
    rows, cal = _monthly(spark, d)
    cal = written(cal)  # a row per date
    years = sorted(r[0] for r in cal.select(F.year("date")).distinct().collect())
    # many epochs would make visible differences of the last digits, in which sums of doubles differ from run to run
    rows = rows.select("date", "stable_id", F.round("label", 9).alias("label"), F.transform("feature", lambda v: F.round(v, 9)).alias("feature"))
    return Q.out(T.rolling(written(rows), cal, years, {"daily": "feature"})[0])
