"""Queries of the panel, window, signature, cross-section and evaluation operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.functions.cols import day, finite
from tidepath.operators import factor as X
from tidepath.operators import network as N
from tidepath.operators import panel as P
from tidepath.operators import signature as S
from tidepath.operators.regrid import bar_of
from tidepath.sources import store
from tidepath.sources.tables import read

K, H, GROUPS = 10, 5, 5
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[day(F.col(c)).alias(c) if kinds[c] == "date" else F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return P.panel(read(spark, d, "daily", ("date", "stable_id", *P.FIELDS)))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    return P.dense(p, P.calendar(p))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return P.windows(_dense(spark, d), K)


def _factor(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    p = _panel(spark, d)
    return P.trailing_return(p, P.calendar(p), k)


def _forward(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    return P.forward_return(p, P.calendar(p), H)


def _exposures(spark: SparkSession, d: str) -> DataFrame:
    """Unique exposures with plausible sizes."""
    e = read(spark, d, "exposures")
    size = finite(F.col("log_mktcap"))
    names = [c for c in e.columns if c.startswith("ind_")]
    x = e.where("date is not null and stable_id is not null").groupBy("date", "stable_id")
    return x.agg(F.max(F.when(size.between(5, 60), size)).alias("log_mktcap"), *[F.max(finite(F.col(c))).alias(c) for c in names])


def _labels(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "labels", ("date", "stable_id", "resid_fwd_20")).where("date is not null and stable_id is not null")
    return x.groupBy("date", "stable_id").agg(F.max(finite(F.col("resid_fwd_20"))).alias("label"))


# --- SQL fragments
_FIN = lambda f: f"max(CASE WHEN isfinite({f}) THEN {f}::DOUBLE END) AS {f}"
_P = f"panel AS (SELECT date, stable_id, {', '.join(map(_FIN, P.FIELDS))} FROM daily WHERE date IS NOT NULL AND stable_id IS NOT NULL GROUP BY 1, 2), cal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS date_idx FROM (SELECT DISTINCT date FROM panel))"
_D = _P + ", dense AS (SELECT s.stable_id, c.date, c.date_idx, p.open, p.high, p.low, p.close, p.volume FROM (SELECT DISTINCT stable_id FROM panel) s CROSS JOIN cal c LEFT JOIN panel p ON p.stable_id = s.stable_id AND p.date = c.date)"
_W = _D + f", win AS (SELECT c.date, d.stable_id, (d.date_idx - c.date_idx + {K - 1})::INT AS step, d.open, d.high, d.low, d.close, d.volume FROM dense d JOIN cal c ON d.date_idx BETWEEN c.date_idx - {K - 1} AND c.date_idx WHERE c.date_idx >= {K - 1})"
_FF = ", ".join(f"last_value({f} IGNORE NULLS) OVER (PARTITION BY date, stable_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS {f}" for f in P.FIELDS)
_WF = _W + f", ff AS (SELECT date, stable_id, step, {_FF} FROM win), fb AS (SELECT date, stable_id, step, " + ", ".join(f"coalesce({f}, first_value({f} IGNORE NULLS) OVER (PARTITION BY date, stable_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {f}" for f in P.FIELDS) + " FROM ff)"
_SC = _WF + ", z AS (SELECT date, stable_id, step, " + ", ".join(f"coalesce({f}, 0) AS {f}" for f in P.FIELDS) + " FROM fb), s0 AS (SELECT *, last_value(close) OVER (PARTITION BY date, stable_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM z), sc AS (SELECT date, stable_id, step, " + ", ".join(f"{f} / CASE WHEN abs(lc) < 1e-8 THEN 1 ELSE lc END AS {f}" for f in P.PRICES) + ", ln(1 + greatest(volume, 0)) AS volume FROM s0)"
_R = lambda cols, digits=6: ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
_DT = "strftime(date, '%Y-%m-%d') AS date"
_FAC = lambda k, name="fac": f"{name} AS (SELECT x.date, x.stable_id, x.close / y.close - 1 AS factor FROM (SELECT * FROM panel JOIN cal USING (date)) x JOIN (SELECT * FROM panel JOIN cal USING (date)) y ON x.stable_id = y.stable_id AND y.date_idx = x.date_idx - {k} WHERE y.close > 0 AND x.close IS NOT NULL)"
_FWD = f"fwd AS (SELECT x.date, x.stable_id, CASE WHEN x.close > 0 THEN y.close / x.close - 1 END AS ret FROM (SELECT * FROM panel JOIN cal USING (date)) x LEFT JOIN (SELECT * FROM panel JOIN cal USING (date)) y ON x.stable_id = y.stable_id AND y.date_idx = x.date_idx + {H})"
_SCORED = lambda fac="fac", name="scored": f"{name} AS (SELECT * FROM (SELECT f.date, f.stable_id, f.factor, r.ret, count(*) OVER (PARTITION BY f.date) AS n FROM {fac} f JOIN fwd r ON f.date = r.date AND f.stable_id = r.stable_id WHERE f.factor IS NOT NULL AND r.ret IS NOT NULL) WHERE n >= {5 * GROUPS})"
_IC = lambda s="scored", name="ic": f"{name} AS (SELECT date, corr(a, b) AS rank_ic, max(n) AS n FROM (SELECT date, n, row_number() OVER (PARTITION BY date ORDER BY factor, stable_id) AS a, row_number() OVER (PARTITION BY date ORDER BY ret, stable_id) AS b FROM {s}) GROUP BY 1)"
_E = _P + f", {_FAC(5)}, {_FWD}, {_SCORED()}, {_IC()}"
_G = _E + f", edges AS (SELECT date, {', '.join(f'quantile_cont(factor, {g / GROUPS}) AS e{g}' for g in range(1, GROUPS))} FROM scored GROUP BY 1), grp AS (SELECT date, ({' + '.join(f'(factor >= e{g})::INT' for g in range(1, GROUPS))} + 1)::INT AS bucket, avg(ret) AS ret FROM scored JOIN edges USING (date) GROUP BY 1, 2), ls AS (SELECT date, max(ret) FILTER (bucket = {GROUPS}) AS top, max(ret) FILTER (bucket = 1) AS bottom, avg(ret) AS mean_group FROM grp GROUP BY 1)"
_PERIODS = X.YEAR_DAYS / H
_EXP = "expo AS (SELECT date, stable_id, max(CASE WHEN isfinite(log_mktcap) AND log_mktcap BETWEEN 5 AND 60 THEN log_mktcap END) AS log_mktcap FROM exposures WHERE date IS NOT NULL AND stable_id IS NOT NULL GROUP BY 1, 2), lab AS (SELECT date, stable_id, max(CASE WHEN isfinite(resid_fwd_20) THEN resid_fwd_20::DOUBLE END) AS label FROM labels WHERE date IS NOT NULL AND stable_id IS NOT NULL GROUP BY 1, 2)"
_BAR = lambda t: f"CASE WHEN ({t} >= 34200000000 AND {t} < 41400000000) OR ({t} >= 46800000000 AND {t} < 54000000000) THEN {t} // 300000000 * 300000000 END"


# --- panels
@query(f"WITH {_P} SELECT {_DT}, stable_id, {_R(P.FIELDS, 4)} FROM panel")
def daily_ohlc_panel(spark, d):
    return out(_panel(spark, d), 4)


@query(f"WITH once AS (SELECT date, stable_id, time, {', '.join(map(_FIN, P.FIELDS))} FROM intraday WHERE date IS NOT NULL AND stable_id IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2, 3), x AS (SELECT *, {_BAR('time')} AS bar_us FROM once WHERE close IS NOT NULL) SELECT {_DT}, stable_id, bar_us, round(arg_min(open, time), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low, round(arg_max(close, time), 4) AS close, round(sum(volume), 4) AS volume FROM x WHERE bar_us IS NOT NULL GROUP BY date, stable_id, bar_us")
def intraday_bars(spark, d):
    return out(P.bars(read(spark, d, "intraday", ("date", "time", "stable_id", *P.FIELDS)), bar_of(F.col("time"))), 4)


@query(f"WITH {_P} SELECT {_DT}, date_idx FROM cal")
def calendar_index(spark, d):
    return out(P.calendar(_panel(spark, d)))


@query(f"WITH days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM intraday WHERE date IS NOT NULL AND time IS NOT NULL)), picks AS (SELECT DISTINCT round_even(p * (SELECT max(i) FROM days) / 7.0, 0)::INT AS i FROM range(8) t(p)) SELECT DISTINCT {_BAR('time')} AS bar_us FROM intraday JOIN days USING (date) JOIN picks ON days.i = picks.i WHERE time IS NOT NULL AND isfinite(close) AND {_BAR('time')} IS NOT NULL")
def trading_grid_probe(spark, d):
    return P.grid_probe(read(spark, d, "intraday", ("date", "time", "close")), bar_of(F.col("time")))


@query(f"WITH {_P} SELECT {_DT}, stable_id, round(close * volume, 2) AS dollar_volume FROM panel")
def dollar_volume(spark, d):
    return out(P.dollar_volume(_panel(spark, d)), 2)


@query(f"WITH {_D}, s AS (SELECT date, stable_id, quantile_cont(CASE WHEN close * volume > 0 THEN close * volume END, 0.5) OVER (PARTITION BY stable_id ORDER BY date_idx RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS score FROM dense), r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY score DESC) AS rk FROM s WHERE score > 0) SELECT {_DT}, stable_id, round(score, 2) AS score FROM r WHERE rk <= 20")
def universe_topn_liquidity(spark, d):
    return out(P.universe(_dense(spark, d), 20), 2)


@query(f"WITH {_D}, c AS (SELECT date, date_idx, stable_id, close, count(close) OVER (PARTITION BY stable_id ORDER BY date_idx ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) / {K}.0 AS present FROM dense) SELECT {_DT}, stable_id, round(present::DOUBLE, 6) AS present, present >= 0.5 AND close IS NOT NULL AS valid FROM c WHERE date_idx >= {K - 1}")
def coverage_mask(spark, d):
    return out(P.coverage(_dense(spark, d), K))


@query(f"WITH {_W} SELECT {_DT}, stable_id, step, {_R(P.FIELDS, 4)} FROM win")
def rolling_window_collect(spark, d):
    return out(P.long_form(_windows(spark, d)), 4)


@query(f"WITH {_WF} SELECT {_DT}, stable_id, step, {_R(P.FIELDS, 4)} FROM ff")
def forward_fill(spark, d):
    return out(P.long_form(P.filled(_windows(spark, d), backward=False)), 4)


@query(f"WITH {_WF} SELECT {_DT}, stable_id, step, {_R(P.FIELDS, 4)} FROM fb")
def backward_fill(spark, d):
    return out(P.long_form(P.filled(_windows(spark, d))), 4)


@query(f"WITH {_SC} SELECT {_DT}, stable_id, step, {_R(P.FIELDS, 4)} FROM sc")
def last_close_scale(spark, d):
    return out(P.long_form(P.scaled(P.filled(_windows(spark, d)))), 4)


@query(f"WITH {_SC}, m AS (SELECT date, stable_id, avg(v) AS m, stddev_pop(v) AS s FROM (" + " UNION ALL ".join(f"SELECT date, stable_id, {f} AS v FROM sc" for f in P.PRICES) + f") GROUP BY 1, 2) SELECT strftime(sc.date, '%Y-%m-%d') AS date, sc.stable_id, step, {', '.join(f'round(({f} - m) / greatest(s, 1e-8), 4) AS {f}' for f in P.PRICES)} FROM sc JOIN m ON sc.date = m.date AND sc.stable_id = m.stable_id")
def joint_price_zscore(spark, d):
    return out(P.long_form(P.normalised(P.filled(_windows(spark, d))), P.PRICES), 4)


@query(f"WITH {_SC} SELECT {_DT}, stable_id, step, {', '.join(f'round(({f} - avg({f}) OVER w) / greatest(stddev_pop({f}) OVER w, 1e-8), 4) AS {f}' for f in P.PRICES)} FROM sc WINDOW w AS (PARTITION BY date, stable_id)")
def per_channel_zscore(spark, d):
    return out(P.long_form(P.normalised(P.filled(_windows(spark, d)), "per_channel"), P.PRICES), 4)


@query(f"WITH {_SC} SELECT {_DT}, stable_id, step, round((volume - avg(volume) OVER w) / greatest(stddev_pop(volume) OVER w, 1e-8), 4) AS volume FROM sc WINDOW w AS (PARTITION BY date, stable_id)")
def log1p_volume_zscore(spark, d):
    return out(P.long_form(P.normalised(P.filled(_windows(spark, d))), ("volume",)), 4)


@query(f"WITH {_P}, {_FWD} SELECT {_DT}, stable_id, round(ret, 6) AS ret FROM fwd")
def forward_return_h(spark, d):
    return out(_forward(spark, d))


# --- cross-sections
_Z = lambda v, c: f"CASE WHEN count({v}) OVER (PARTITION BY date) >= 2 THEN {'least(greatest(' if c else ''}({v} - avg({v}) OVER (PARTITION BY date)) / greatest(stddev_pop({v}) OVER (PARTITION BY date), 1e-8){', -' + c + '), ' + c + ')' if c else ''} END"


@query(f"WITH {_P}, {_FAC(5)} SELECT {_DT}, stable_id, round({_Z('factor', '')}, 5) AS factor FROM fac")
def xs_standardise(spark, d):
    return out(X.standardise(_factor(spark, d), "factor"), 5)


@query(f"WITH {_P}, {_FAC(5)} SELECT {_DT}, stable_id, round({_Z('factor', '2.0')}, 5) AS factor FROM fac")
def winsorise_clip(spark, d):
    return out(X.winsorise(_factor(spark, d), "factor", 2.0), 5)


@query(f"WITH {_EXP}, x AS (SELECT l.date, l.stable_id, label, log_mktcap FROM lab l JOIN expo e ON l.date = e.date AND l.stable_id = e.stable_id WHERE label IS NOT NULL AND log_mktcap IS NOT NULL), f AS (SELECT date, regr_slope(label, log_mktcap) AS b, avg(label) AS my, avg(log_mktcap) AS mx, count(*) AS n FROM x GROUP BY 1) SELECT strftime(x.date, '%Y-%m-%d') AS date, x.stable_id, CASE WHEN n > 2 THEN round(label - my - coalesce(b, 0) * (log_mktcap - mx), 6) END AS residual FROM x JOIN f ON x.date = f.date")
def neutralise_single(spark, d):
    x = _labels(spark, d).join(_exposures(spark, d), ["date", "stable_id"])
    return out(X.neutralise_single(x, "label", "log_mktcap"))


_CODES = ("b15", "c20", "d25", "e30", "f45", "g50", "h60")


@query(f"WITH {_EXP}, s AS (SELECT stable_id, min(industry_code) AS code FROM securities GROUP BY 1) SELECT {_DT}, e.stable_id, round(log_mktcap, 6) AS log_cap, {', '.join(f'(code = {chr(39)}{c}{chr(39)})::INT::DOUBLE AS ind_{c}' for c in _CODES)} FROM expo e JOIN s ON e.stable_id = s.stable_id WHERE code IS NOT NULL AND log_mktcap IS NOT NULL")
def one_hot_exposures(spark, d):
    caps = _exposures(spark, d).select("date", "stable_id", F.exp("log_mktcap").alias("cap"))
    codes = read(spark, d, "securities", ("stable_id", "industry_code")).groupBy("stable_id").agg(F.min("industry_code").alias("code"))
    return out(P.exposures_one_hot(caps, codes, levels=("a10", *_CODES)))


@query("WITH c AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem), s AS (SELECT date, year(date) AS y, month(date) AS m FROM c) SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN y = 2000 THEN 'predict' WHEN y = 1999 THEN 'val' ELSE 'train' END AS split FROM s WHERE y = 2000 OR (y BETWEEN 1996 AND 1999 AND NOT (m = 12 AND y IN (1998, 1999)))")
def rolling_year_split(spark, d):
    cal = read(spark, d, "lineitem", ("l_shipdate",)).select(F.to_date("l_shipdate").alias("date")).distinct()
    return out(P.year_split(cal, 2000))


@query(f"WITH {_P} SELECT {_DT}, date_idx FROM cal WHERE date_idx >= {K - 1} AND (date_idx - {K - 1}) % 5 = 0")
def stride_sample(spark, d):
    return out(P.stride(P.calendar(_panel(spark, d)), 5, K))


@query(f"WITH {_P} SELECT {_DT}, date_idx, date = max(date) OVER (PARTITION BY strftime(date, '%Y%m')) AS is_month_end FROM cal")
def month_end_flag(spark, d):
    return out(P.month_ends(P.calendar(_panel(spark, d))))


# --- evaluation
def _evaluated(spark, d, monthly=False):
    dates = P.month_ends(P.calendar(_panel(spark, d))).where("is_month_end") if monthly else None
    return X.evaluate(_factor(spark, d), _forward(spark, d), dates, H, GROUPS)


def flagship(spark, d, n_groups=2):
    """Daily rank IC of the trailing return, for small universes too."""
    return out(X.evaluate(_factor(spark, d), _forward(spark, d), None, H, n_groups)["ic"])


@query(f"WITH {_E} SELECT {_DT}, round(rank_ic, 6) AS rank_ic, n FROM ic")
def rank_ic_daily(spark, d):
    return out(_evaluated(spark, d)["ic"])


@query(f"WITH {_E} SELECT {_DT}, round(rank_ic, 6) AS rank_ic, n FROM ic WHERE date IN (SELECT max(date) FROM cal GROUP BY strftime(date, '%Y%m'))")
def rank_ic_monthly(spark, d):
    return out(_evaluated(spark, d, True)["ic"])


@query(f"WITH {_G} SELECT {_DT}, bucket, round(ret, 6) AS ret FROM grp")
def quantile_groups(spark, d):
    return out(_evaluated(spark, d)["groups"])


@query(f"WITH {_G} SELECT {_DT}, {_R(('top', 'bottom', 'mean_group'))}, round(top - bottom, 6) AS long_short FROM ls")
def quantile_long_short(spark, d):
    return out(_evaluated(spark, d)["long_short"])


@query(f"WITH {_G} SELECT count(rank_ic) AS n_periods, round(avg(rank_ic), 6) AS rank_ic, round(avg(rank_ic) / stddev_samp(rank_ic) * sqrt({_PERIODS}), 6) AS icir, round(avg((rank_ic > 0)::INT), 6) AS ic_win_rate, round(avg(top - bottom) * {_PERIODS}, 6) AS long_short_annual, round(stddev_samp(top - bottom) * sqrt({_PERIODS}), 6) AS long_short_vol, round(avg(top - bottom) / stddev_samp(top - bottom) * sqrt({_PERIODS}), 6) AS long_short_sharpe, round(avg(top) * {_PERIODS}, 6) AS top_group_annual, round(avg(top - mean_group) * {_PERIODS}, 6) AS top_minus_equal_weight FROM ic JOIN ls USING (date)")
def factor_summary(spark, d):
    return out(_evaluated(spark, d)["summary"])


@query(f"WITH {_G} SELECT year(date)::INT AS year, round(avg(rank_ic), 6) AS rank_ic, round(avg(rank_ic) / stddev_samp(rank_ic) * sqrt({_PERIODS}), 6) AS icir, round(avg(top - bottom) * {_PERIODS}, 6) AS long_short_annual FROM ic JOIN ls USING (date) GROUP BY 1")
def factor_by_year(spark, d):
    return out(_evaluated(spark, d)["by_year"])


_WT = "w AS (SELECT date, stable_id, factor, ret, raw / sum(raw) OVER (PARTITION BY date) AS weight FROM (SELECT *, pow(0.5::DOUBLE, (row_number() OVER (PARTITION BY date ORDER BY factor DESC, stable_id) - 1) / greatest(count(*) OVER (PARTITION BY date) * 0.5::DOUBLE, 1)) AS raw FROM scored))"


@query(f"WITH {_E}, {_WT} SELECT {_DT}, stable_id, round(weight, 8) AS weight FROM w")
def exp_rank_weights(spark, d):
    x = X.scored(_factor(spark, d), _forward(spark, d), GROUPS)
    return out(X.rank_weights(x, "factor").select("date", "stable_id", "weight"), 8)


@query(f"WITH {_E}, {_WT}, s AS (SELECT date, sum(weight * factor) AS ma, sum(weight * ret) AS mb, sum(weight * factor * ret) AS ab, sum(weight * factor * factor) AS aa, sum(weight * ret * ret) AS bb FROM w GROUP BY 1) SELECT {_DT}, round((ab - ma * mb) / sqrt(greatest(aa - ma * ma, 1e-8) * greatest(bb - mb * mb, 1e-8)), 5) AS wcorr FROM s")
def weighted_correlation(spark, d):
    x = X.rank_weights(X.scored(_factor(spark, d), _forward(spark, d), GROUPS), "factor")
    return out(X.weighted_correlation(x, "factor", "ret"), 5)


_AVG = lambda v: f"rank() OVER (PARTITION BY date ORDER BY {v}) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0"


@query(f"WITH {_P}, {_FAC(5)}, {_FAC(10, 'fac2')}, x AS (SELECT a.date, a.factor AS fa, b.factor AS fb FROM fac a JOIN fac2 b ON a.date = b.date AND a.stable_id = b.stable_id), r AS (SELECT date, {_AVG('fa')} AS ra, {_AVG('fb')} AS rb FROM x) SELECT {_DT}, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY date")
def spearman_pair(spark, d):
    return out(X.spearman(_factor(spark, d, 5), _factor(spark, d, 10)))


_ENS = f"x AS (SELECT a.date, a.stable_id, a.factor AS f0, b.factor AS f1 FROM fac a JOIN fac2 b ON a.date = b.date AND a.stable_id = b.stable_id)"


@query(f"WITH {_P}, {_FAC(5)}, {_FAC(10, 'fac2')}, {_ENS} SELECT {_DT}, stable_id, CASE WHEN count(*) OVER (PARTITION BY date) >= 2 THEN round(((f0 - avg(f0) OVER (PARTITION BY date)) / stddev_pop(f0) OVER (PARTITION BY date) + (f1 - avg(f1) OVER (PARTITION BY date)) / stddev_pop(f1) OVER (PARTITION BY date)) / 2, 5) END AS factor FROM x")
def ensemble_equal_weight(spark, d):
    return out(X.ensemble([_factor(spark, d, 5), _factor(spark, d, 10)]), 5)


_TWO = _E + f", {_FAC(10, 'fac2')}, {_SCORED('fac2', 'scored2')}, {_IC('scored2', 'ic2')}"


def _ics(spark, d, *ks):
    fwd = _forward(spark, d)
    return [X.rank_ic(X.scored(_factor(spark, d, k), fwd, GROUPS)) for k in ks]


@query(f"WITH {_TWO}, d AS (SELECT b.rank_ic - a.rank_ic AS d FROM ic a JOIN ic2 b ON a.date = b.date), s AS (SELECT count(d) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(d)) AS se FROM d WHERE d IS NOT NULL) SELECT n, round(m, 6) AS mean_diff, round(m / se, 4) AS t, round(m - 1.96 * se, 6) AS lo, round(m + 1.96 * se, 6) AS hi FROM s")
def paired_t_ic(spark, d):
    x = X.paired_t(*_ics(spark, d, 5, 10))
    return x.select("n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "lo", "hi")], F.round("t", 4).alias("t"))


@query(f"WITH {_E}, x AS (SELECT row_number() OVER (ORDER BY date) AS i, rank_ic - avg(rank_ic) OVER () AS c, avg(rank_ic) OVER () AS m, count(*) OVER () AS n FROM ic WHERE rank_ic IS NOT NULL), g AS (SELECT sum(CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / 6.0::DOUBLE) END * a.c * b.c / a.n) AS g, max(a.m) AS m, max(a.n) AS n FROM x a JOIN range(6) t(l) ON true JOIN x b ON b.i = a.i + l) SELECT n, round(m, 6) AS mean, round(sqrt(g / n), 6) AS se, round(m / sqrt(g / n), 4) AS t FROM g")
def newey_west_t(spark, d):
    x = X.newey_west(_ics(spark, d, 5)[0], "rank_ic", 5)
    return x.select("n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


_ARMS = (("short", 1), ("short", 2), ("short", 3), ("long", 6), ("long", 8), ("long", 10))


@query("WITH " + _P + f", {_FWD}, " + ", ".join(f"{_FAC(k, f'f{k}')}, {_SCORED(f'f{k}', f's{k}')}, {_IC(f's{k}', f'i{k}')}" for _, k in _ARMS) + ", runs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, {k} AS seed, avg(rank_ic) AS rank_ic FROM i{k}" for a, k in _ARMS) + ") SELECT arm, round(avg(rank_ic), 6) AS mean, round(stddev_samp(rank_ic), 6) AS sd, count(rank_ic) AS n FROM runs GROUP BY 1")
def seed_mean_sd(spark, d):
    ics = _ics(spark, d, *[k for _, k in _ARMS])
    runs = reduce(DataFrame.unionByName, [ic.agg(F.avg("rank_ic").alias("rank_ic")).select(F.lit(a).alias("arm"), F.lit(k).alias("seed"), "rank_ic") for (a, k), ic in zip(_ARMS, ics, strict=True)])
    return out(X.seed_spread(runs, "rank_ic"))


@query("WITH " + _P + ", " + ", ".join(_FAC(k, f"f{k}") for k in (1, 2, 8, 10)) + ", rho AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, avg(rho) AS rho FROM (SELECT date, corr(ra, rb) AS rho FROM (SELECT date, {_AVG('fa')} AS ra, {_AVG('fb')} AS rb FROM (SELECT a.date, a.factor AS fa, b.factor AS fb FROM f{a} a JOIN f{b} b ON a.date = b.date AND a.stable_id = b.stable_id)) GROUP BY 1)" for kind, a, b in (("within", 1, 2), ("within", 8, 10), ("between", 1, 8), ("between", 2, 10))) + ") SELECT kind, round(avg(rho), 6) AS rho, count(*) AS pairs FROM rho GROUP BY 1")
def arm_distance(spark, d):
    """Mean rank correlation within an arm's runs and between arms."""
    f = {k: _factor(spark, d, k) for k in (1, 2, 8, 10)}
    pairs = (("within", 1, 2), ("within", 8, 10), ("between", 1, 8), ("between", 2, 10))
    x = reduce(DataFrame.unionByName, [X.spearman(f[a], f[b]).agg(F.avg("rho").alias("rho")).select(F.lit(kind).alias("kind"), "rho") for kind, a, b in pairs])
    return out(x.groupBy("kind").agg(F.avg("rho").alias("rho"), F.count("*").alias("pairs")))


@query(f"WITH {_P}, {_FAC(5)}, {_EXP}, x AS (SELECT * FROM (SELECT f.date, f.stable_id, f.factor, label AS ret, count(*) OVER (PARTITION BY f.date) AS n FROM fac f JOIN lab l ON f.date = l.date AND f.stable_id = l.stable_id WHERE label IS NOT NULL) WHERE n >= {5 * GROUPS}), {_IC('x')} SELECT {_DT}, round(rank_ic, 6) AS rank_ic, n FROM ic")
def rank_ic_against_label(spark, d):
    return out(X.evaluate(_factor(spark, d), _labels(spark, d).withColumnRenamed("label", "ret"), None, 20, GROUPS)["ic"])


@query(f"WITH {_EXP}, z AS (SELECT date, stable_id, CASE WHEN label IS NOT NULL THEN {_Z('label', '3.0')} END AS z FROM lab) SELECT {_DT}, stable_id, round(z, 5) AS label FROM z WHERE z IS NOT NULL")
def label_builder(spark, d):
    return out(X.labels(None, None, precomputed=_labels(spark, d)), 5)


@query(f"WITH {_EXP} SELECT {_DT}, stable_id, round(label, 6) AS label FROM (SELECT *, count(label) OVER (PARTITION BY date) AS n FROM lab) WHERE label IS NOT NULL OR n < 3")
def require_label(spark, d):
    return out(X.require_label(_labels(spark, d)))


# --- signatures
_PTS = _P + ", pts AS (SELECT stable_id, date_idx, date_idx / 100.0::DOUBLE AS x0, ln(close) AS x1, ln(1 + volume) / 10 AS x2 FROM panel JOIN cal USING (date) WHERE close > 0 AND volume >= 0), inc AS (SELECT stable_id, date_idx, " + ", ".join(f"x{i} - lag(x{i}) OVER w AS d{i}, lag(x{i}) OVER w - first_value(x{i}) OVER w AS a{i}" for i in range(3)) + " FROM pts WINDOW w AS (PARTITION BY stable_id ORDER BY date_idx)), i2 AS (SELECT * FROM inc WHERE d0 IS NOT NULL), ids AS (SELECT DISTINCT stable_id FROM pts)"
_S1 = [f"coalesce(sum(d{i}), 0) AS s_{i}" for i in range(3)]
_S2 = [f"coalesce(sum(a{i} * d{j} + d{i} * d{j} / 2), 0) AS s_{i}{j}" for i in range(3) for j in range(3)]


def _points(spark, d):
    p = _panel(spark, d)
    x = P.indexed(p, P.calendar(p)).where("close > 0 and volume >= 0")
    return x.select("stable_id", "date_idx", (F.col("date_idx") / 100.0).alias("t"), F.log("close").alias("c"), (F.log1p("volume") / 10).alias("v"))


@query(f"WITH {_PTS}, s AS (SELECT ids.stable_id, {', '.join(_S1 + _S2)} FROM ids LEFT JOIN i2 ON ids.stable_id = i2.stable_id GROUP BY 1) SELECT stable_id, {_R([e.rpartition(' ')[2] for e in _S1 + _S2], 5)} FROM s")
def signature_d2(spark, d):
    return out(S.sql_signature(_points(spark, d), "stable_id", "date_idx", ["t", "c", "v"], 2), 5)


@query(f"WITH {_PTS}, s AS (SELECT ids.stable_id, {', '.join(_S1 + _S2)} FROM ids LEFT JOIN i2 ON ids.stable_id = i2.stable_id GROUP BY 1) SELECT stable_id, {', '.join(f'round(s_{i}, 5) AS l_{i}' for i in range(3))}, {', '.join(f'round((s_{i}{j} - s_{j}{i}) / 2, 5) AS l_{i}{j}' for i in range(3) for j in range(i + 1, 3))} FROM s")
def logsignature_d2(spark, d):
    return out(S.sql_logsignature(S.sql_signature(_points(spark, d), "stable_id", "date_idx", ["t", "c", "v"], 2), "stable_id", 3, 2), 5)


_L2 = _P + ", pts AS (SELECT stable_id, date_idx, date_idx / 100.0::DOUBLE AS x0, ln(close) AS x1 FROM panel JOIN cal USING (date) WHERE close > 0 AND volume >= 0), inc AS (SELECT stable_id, date_idx, x0 - lag(x0) OVER w AS d0, x1 - lag(x1) OVER w AS d1, lag(x0) OVER w - first_value(x0) OVER w AS a0, lag(x1) OVER w - first_value(x1) OVER w AS a1 FROM pts WINDOW w AS (PARTITION BY stable_id ORDER BY date_idx)), i2 AS (SELECT *, " + ", ".join(f"coalesce(sum(a{i} * d{j} + d{i} * d{j} / 2) OVER (PARTITION BY stable_id ORDER BY date_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM inc WHERE d0 IS NOT NULL), s AS (SELECT stable_id, sum(d0) AS s_0, sum(d1) AS s_1, " + ", ".join(f"sum(a{i} * d{j} + d{i} * d{j} / 2) AS s_{i}{j}" for i in (0, 1) for j in (0, 1)) + ", " + ", ".join(f"sum(p{i}{j} * d{m} + a{i} * d{j} * d{m} / 2 + d{i} * d{j} * d{m} / 6) AS s_{i}{j}{m}" for i in (0, 1) for j in (0, 1) for m in (0, 1)) + " FROM i2 GROUP BY 1)"


@query(f"WITH {_L2} SELECT stable_id, round(s_0, 6) AS l_0, round(s_1, 6) AS l_1, round((s_01 - s_10) / 2, 6) AS l_01, round(s_001 - (s_0 * s_01 + s_00 * s_1) / 2 + s_0 * s_0 * s_1 / 3, 5) AS l_001, round(s_011 - (s_0 * s_11 + s_01 * s_1) / 2 + s_0 * s_1 * s_1 / 3, 5) AS l_011 FROM s")
def logsignature_d3(spark, d):
    x = S.sql_logsignature(S.sql_signature(_points(spark, d), "stable_id", "date_idx", ["t", "c"], 3), "stable_id", 2, 3)
    return x.select("stable_id", *[F.round(c, 5 if len(c) == 5 else 6).alias(c) for c in x.columns[1:]])


def _scaled_windows(spark, d):
    return P.scaled(P.filled(_windows(spark, d)))


def _named(df, names, digits=5):
    return df.select(day(F.col("date")).alias("date"), "stable_id", *[F.round(F.get("feature", F.lit(i)), digits).alias(n) for i, n in enumerate(names)])


_STEPS = _SC + ", pt AS (SELECT date, stable_id, step, close AS x, close - lag(close) OVER (PARTITION BY date, stable_id ORDER BY step) AS dx FROM sc)"
_AT = lambda i: f"max(x) FILTER (step = {i})"
_CUT = lambda ranges: ", ".join(f"round({_AT(b - 1)} - {_AT(a)}, 5) AS w{k}" for k, (a, b) in enumerate(ranges))


@query(f"WITH {_STEPS} SELECT {_DT}, stable_id, round({_AT(K - 1)} - {_AT(0)}, 5) AS lead, round({_AT(K - 1)} - {_AT(0)}, 5) AS lag, round(sum(dx * dx) / 2, 5) AS area FROM pt GROUP BY date, stable_id")
def lead_lag_area(spark, d):
    return _named(S.window_features(_scaled_windows(spark, d), ("close",), depth=2, stages=("lead_lag",), rescale="none"), ("lead", "lag", "area"))


@query(f"WITH {_STEPS} SELECT {_DT}, stable_id, round({_AT(K - 1)} - {_AT(0)}, 5) AS plain, round({_AT(K - 1)}, 5) AS based FROM pt GROUP BY date, stable_id")
def basepoint_sensitivity(spark, d):
    w = _scaled_windows(spark, d)
    a = _named(S.window_features(w, ("close",), depth=1, stages=(), rescale="none"), ("plain",))
    b = _named(S.window_features(w, ("close",), depth=1, stages=("basepoint",), rescale="none"), ("based",))
    return a.join(b, ["date", "stable_id"])


@query(f"WITH {_STEPS} SELECT {_DT}, stable_id, {_CUT([(0, 10), (0, 5), (5, 10), (0, 2), (2, 5), (5, 8), (8, 10)])} FROM pt GROUP BY date, stable_id")
def dyadic_windows(spark, d):
    return _named(S.window_features(_scaled_windows(spark, d), ("close",), depth=1, stages=(), rescale="none", window="dyadic"), [f"w{i}" for i in range(7)])


@query(f"WITH {_STEPS} SELECT {_DT}, stable_id, {_CUT([(0, 4), (2, 6), (4, 8), (6, 10)])} FROM pt GROUP BY date, stable_id")
def sliding_windows(spark, d):
    return _named(S.window_features(_scaled_windows(spark, d), ("close",), depth=1, stages=(), rescale="none", window="sliding", size=4, step=2), [f"w{i}" for i in range(4)])


@query(f"WITH {_STEPS} SELECT {_DT}, stable_id, {_CUT([(0, 4), (0, 7), (0, 10)])} FROM pt GROUP BY date, stable_id")
def expanding_windows(spark, d):
    return _named(S.window_features(_scaled_windows(spark, d), ("close",), depth=1, stages=(), rescale="none", window="expanding", size=4, step=3), [f"w{i}" for i in range(3)])


@query(f"WITH {_STEPS}, e AS (SELECT date, stable_id, {_AT(K - 1)} - {_AT(0)} AS s FROM pt GROUP BY 1, 2) SELECT {_DT}, stable_id, round(s, 5) AS l1, round(s * s, 5) AS l2, round(s * s * s, 5) AS l3 FROM e")
def post_rescale(spark, d):
    return _named(S.window_features(_scaled_windows(spark, d), ("close",), depth=3, stages=(), transform="signature"), ("l1", "l2", "l3"))


_PAIRS = (["coordinate_projection", {"size": 2}], "time", "basepoint")


def _features(spark, d, depth, dates=None):
    """dates: a table of the dates wanted, all if None; only they and the positions of their windows are made then."""
    p = _panel(spark, d)
    if dates is None:
        dense = P.dense(p, P.calendar(p))
    else:
        cal = P.calendar(read(spark, d, "daily", ("date", "stable_id")).where("stable_id is not null").select(F.col("date").cast("date").alias("date")))
        dates = F.broadcast(cal.join(F.broadcast(dates), "date", "left_semi"))  # a row per date, as all these
        near = F.broadcast(dates.select(F.explode(F.sequence(F.col("date_idx") - (K - 1), "date_idx")).alias("date_idx")).distinct())
        p = p.join(F.broadcast(cal.join(near, "date_idx", "left_semi")), "date", "left_semi")
        dense = P.dense(p, cal).join(near, "date_idx", "left_semi")
    only = (lambda x: x) if dates is None else lambda x: x.join(dates, "date", "left_semi")
    keep = only(P.coverage(dense, K).where("valid").select("date", "stable_id"))
    # screened before the costly part
    w = only(P.windows(dense, K)).join(keep, ["date", "stable_id"], "left_semi")
    return S.window_features(P.normalised(P.filled(w)), P.FIELDS, depth=depth, stages=_PAIRS)


_JOINT = "m AS (SELECT date, stable_id, avg(v) AS m, stddev_pop(v) AS s FROM (" + " UNION ALL ".join(f"SELECT date, stable_id, {f} AS v FROM sc" for f in P.PRICES) + ") GROUP BY 1, 2)"
_NZ = f"nz AS (SELECT sc.date, sc.stable_id, step, step / {K - 1}.0::DOUBLE AS t, {', '.join(f'({f} - m) / greatest(s, 1e-8) AS {f}' for f in P.PRICES)}, (volume - avg(volume) OVER w) / greatest(stddev_pop(volume) OVER w, 1e-8) AS volume FROM sc JOIN m ON sc.date = m.date AND sc.stable_id = m.stable_id WINDOW w AS (PARTITION BY sc.date, sc.stable_id)), lg AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in ('t', *P.FIELDS))} FROM nz WINDOW w AS (PARTITION BY date, stable_id ORDER BY step))"
_TWOS = [(a, b) for i, a in enumerate(P.FIELDS) for b in P.FIELDS[i + 1 :]]
_AREAS = f"ar AS (SELECT date, stable_id, {', '.join(f'max({f}) FILTER (step = {K - 1}) AS x_{f}, sum(p_t * ({f} - p_{f}) - p_{f} * (t - p_t)) AS t_{f}' for f in P.FIELDS)}, {', '.join(f'sum(p_{a} * ({b} - p_{b}) - p_{b} * ({a} - p_{a})) AS a_{a}_{b}' for a, b in _TWOS)} FROM lg WHERE p_t IS NOT NULL GROUP BY 1, 2)"
_VALID = f"va AS (SELECT date, stable_id FROM (SELECT date, date_idx, stable_id, close, count(close) OVER (PARTITION BY stable_id ORDER BY date_idx ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) / {K}.0 AS present FROM dense) WHERE date_idx >= {K - 1} AND present >= 0.5 AND close IS NOT NULL)"


@query(f"WITH {_SC}, {_JOINT}, {_NZ}, {_AREAS}, {_VALID} SELECT strftime(ar.date, '%Y-%m-%d') AS date, ar.stable_id, 60 AS width, round(10 + 4 * ({' + '.join(f'x_{f} * x_{f} + t_{f} * t_{f}' for f in P.FIELDS)}) + {' + '.join(f'a_{a}_{b} * a_{a}_{b}' for a, b in _TWOS)}, 3) AS energy FROM ar JOIN va ON ar.date = va.date AND ar.stable_id = va.stable_id")
def coordinate_pairs_features(spark, d):
    """Width and size of depth-2 features of all channel pairs."""
    x = _features(spark, d, 2)
    return x.select(day(F.col("date")).alias("date"), "stable_id", F.size("feature").alias("width"), F.round(F.aggregate("feature", F.lit(0.0), lambda s, v: s + v * v), 3).alias("energy"))


@query()
def logsignature_d5_features(spark, d):
    """The 800 features of a name and date: ten channel pairs, depth 5."""
    x = _features(spark, d, 5)
    return x.select(day(F.col("date")).alias("date"), "stable_id", F.transform("feature", lambda v: F.round(v, 4)).alias("feature"))


@query()
def gauss_rank(spark, d):
    return out(X.gauss_rank(_factor(spark, d), ["factor"]))


# --- store, branches, models
@query(f"WITH {_D}, v AS (SELECT date, date_idx, stable_id, close, count(close) OVER (PARTITION BY stable_id ORDER BY date_idx ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) / {K}.0 AS present FROM dense), b AS (SELECT date, stable_id, count(DISTINCT {_BAR('time')}) AS bars FROM intraday WHERE isfinite(close) AND stable_id IS NOT NULL GROUP BY 1, 2) SELECT strftime(v.date, '%Y-%m-%d') AS date, v.stable_id, bars FROM v JOIN b ON v.date = b.date AND v.stable_id = b.stable_id WHERE date_idx >= {K - 1} AND present >= 0.5 AND close IS NOT NULL AND bars >= 24")
def branch_join(spark, d):
    daily = P.coverage(_dense(spark, d), K).where("valid").select("date", "stable_id")
    bars = P.bars(read(spark, d, "intraday", ("date", "time", "stable_id", *P.FIELDS)), bar_of(F.col("time"))).groupBy("date", "stable_id").agg(F.count(F.lit(1)).alias("bars"))
    return out(daily.join(bars.where("bars >= 24"), ["date", "stable_id"]))


@query(f"WITH {_P} SELECT {_DT} FROM cal ANTI JOIN (SELECT DISTINCT date FROM intraday) USING (date)")
def cached_date_anti_join(spark, d):
    return out(store.missing_dates(P.calendar(_panel(spark, d)), read(spark, d, "intraday", ("date",)).distinct()))


@query("SELECT stride::INT AS stride, round((700 + 233 * 0.35::DOUBLE) / stride * 0.5 * 8 * 5 / 3600, 6) AS hours FROM (VALUES (1), (2), (5)) t(stride)")
def schedule_projection(spark, d):
    """Hours of a training schedule: steps of fits and predictions by stride, at half a second, 8 epochs and 5 fits."""
    x = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in (1, 2, 5)])).alias("stride"))
    return x.select("stride", F.round((700 + 233 * 0.35) / F.col("stride") * 0.5 * 8 * 5 / 3600, 6).alias("hours"))


@query()
def network_factor(spark, d):
    """Seeded branch network on depth-2 features, one date's names together."""
    x = _features(spark, d, 2)
    n = S.feature_count(5, K, 2, _PAIRS)
    return out(N.predict(x, N.factor_network({"daily": n}), {"daily": "feature"}))


@query()
def mixer_factor(spark, d):
    """Seeded time-mixing network on normalised windows."""
    w = P.normalised(P.filled(_windows(spark, d)))
    return out(N.predict_windows(w, N.mixer_network(K, 5), P.FIELDS))


@query()
def ridge_factor(spark, d):
    """A ridge fit of standardised forward returns on depth-2 features, predicted for the same names."""
    x = _features(spark, d, 2)
    p = _panel(spark, d)
    y = X.labels(p, P.calendar(p), H)
    n = S.feature_count(5, K, 2, _PAIRS)
    coef = N.ridge_fit(x.join(y, ["date", "stable_id"]), "feature", "label", n, 10.0)
    return out(N.ridge_predict(x, "feature", coef), 4)
