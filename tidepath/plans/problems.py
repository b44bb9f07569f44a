"""Queries p1 to p5 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.functions.cols import day
from tidepath.operators import impute, orphans, regrid, spikes, trailing
from tidepath.sources.tables import read


def _flags(spark: SparkSession, d: str) -> DataFrame:
    daily = read(spark, d, "daily", ("date", "stable_id", "close", "volume"))
    intraday = read(spark, d, "intraday", ("date", "time", "stable_id", "close", "volume"))
    return spikes.flag_daily(daily).unionByName(spikes.flag_intraday(intraday))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).drop("rule").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings per field and rule."""
    return _flags(spark, d).groupBy("table_name", "field", "rule").agg(F.count(F.lit(1)).alias("readings"), F.countDistinct("stable_id").alias("sources"))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    intraday = read(spark, d, "intraday", ("date", "time", "stable_id", "close", "volume"))
    return regrid.regrid(intraday, read(spark, d, "trading_days", ("date",)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_grid(spark, d).where("close_status <> 'observed'").select("stable_id", day(F.col("date")).alias("date"), "bar_us")


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    return impute.fill_daily(read(spark, d, "daily"), read(spark, d, "securities", ("stable_id", "industry_code")))


def p3_exposures(spark: SparkSession, d: str) -> DataFrame:
    return impute.fill_exposures(read(spark, d, "exposures"), read(spark, d, "securities", ("stable_id", "industry_code")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    daily, expo = p3_daily(spark, d), p3_exposures(spark, d)
    fields = lambda table, *names: F.explode(F.filter(F.array(*[F.when(F.col(f"{n}_is_filled"), F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("field"))) for n in names]), lambda s: s.isNotNull())).alias("case")
    rows = daily.select("stable_id", "date", fields("daily", "open", "close")).unionByName(expo.select("stable_id", "date", fields("exposures", "log_mktcap")))
    rows = rows.where("stable_id is not null and date is not null")
    return rows.select("case.table_name", "case.field", "stable_id", day(F.col("date")).alias("date")).distinct()


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    out = trailing.trailing_totals(read(spark, d, "daily", ("date", "stable_id", "close", "volume")))
    return out.select("stable_id", day(F.col("date")).alias("date"), *[F.round(F.col(c), 3).alias(c) if "_days_" not in c else F.col(c) for c in out.columns[2:]])


def _orphans(spark: SparkSession, d: str) -> orphans.OrphanState:
    return orphans.panel_orphans(read(spark, d, "exposures", ("date", "stable_id")), read(spark, d, "labels", ("date", "stable_id")), read(spark, d, "securities", ("stable_id", "listed_on", "deleted_on")), read(spark, d, "trading_days", ("date",)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    open_refs = orphans.pending(_orphans(spark, d)).where("date is not null and (field = 'stable_id' or row_id != '')")
    own = F.when(F.col("field") == "stable_id", F.col("key")).otherwise(F.col("row_id"))
    return open_refs.select("table_name", "field", own.cast("long").alias("stable_id"), day(F.col("date")).alias("date"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows with orphan and with held references per table, field and month."""
    return orphans.snapshot(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_grid, p3_found, p3_daily, p3_exposures, p4_trailing, p5_found, p5_counts)}

_COVERED = "s.stable_id IS NOT NULL AND (s.listed_on IS NULL OR x.date >= s.listed_on) AND (s.deleted_on IS NULL OR x.date < s.deleted_on)"


def _refs(table: str) -> str:
    return f"SELECT DISTINCT stable_id, date FROM {table} WHERE date IS NOT NULL"


_BARS = " UNION ALL ".join(f"SELECT {a}::BIGINT + 300000000::BIGINT * i AS bar_us FROM range(24) r(i)" for a in (34200000000, 46800000000))

_P4 = "WITH once AS (SELECT stable_id, date, max(CASE WHEN NOT isnan(volume) AND NOT isinf(volume) THEN volume::DOUBLE END) AS volume, max(CASE WHEN NOT isnan(close) AND NOT isinf(close) THEN close::DOUBLE END) AS close FROM daily WHERE stable_id IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2), days AS (SELECT stable_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM once GROUP BY 1), grid AS (SELECT d.stable_id, d.date, o.volume, o.close FROM days d LEFT JOIN once o USING (stable_id, date)) SELECT stable_id, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(
    f"round(coalesce(sum({f}) OVER w{p}, 0), 3) AS {f}_sum_{p}, round(avg({f}) OVER w{p}, 3) AS {f}_avg_{p}, count({f}) OVER w{p} AS {f}_days_{p}" for f in ("volume", "close") for p in (7, 30)
) + " FROM grid WINDOW " + ", ".join(f"w{p} AS (PARTITION BY stable_id ORDER BY date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)" for p in (7, 30))

SQL = {
    "p2_found": f"WITH grid AS ({_BARS}), span AS (SELECT stable_id, min(date) AS a, max(date) AS b FROM intraday WHERE stable_id IS NOT NULL AND date IS NOT NULL GROUP BY 1), cells AS (SELECT s.stable_id, t.date, g.bar_us FROM span s JOIN (SELECT DISTINCT date FROM trading_days) t ON t.date BETWEEN s.a AND s.b CROSS JOIN grid g), seen AS (SELECT DISTINCT stable_id, date, time // 300000000 * 300000000 AS bar_us FROM intraday WHERE close IS NOT NULL AND NOT isnan(close) AND NOT isinf(close) AND time IS NOT NULL) SELECT c.stable_id, strftime(c.date, '%Y-%m-%d') AS date, c.bar_us FROM cells c ANTI JOIN seen s ON c.stable_id = s.stable_id AND c.date = s.date AND c.bar_us = s.bar_us",
    "p4_trailing": _P4,
    "p5_found": " UNION ALL ".join(f"SELECT '{t}' AS table_name, 'stable_id' AS field, x.stable_id, strftime(x.date, '%Y-%m-%d') AS date FROM ({_refs(t)}) x LEFT JOIN securities s ON x.stable_id = s.stable_id WHERE x.stable_id IS NOT NULL AND NOT coalesce({_COVERED}, false)" for t in ("exposures", "labels"))
    + f" UNION ALL SELECT 'exposures' AS table_name, 'date' AS field, x.stable_id, strftime(x.date, '%Y-%m-%d') AS date FROM ({_refs('exposures')}) x ANTI JOIN trading_days t ON x.date = t.date WHERE x.stable_id IS NOT NULL",
}

_MONTH = "coalesce(strftime(date, '%Y-%m'), '(none)') AS month"
_STATES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, 'stable_id' AS field, {_MONTH}, NOT CASE WHEN x.date IS NULL THEN s.stable_id IS NOT NULL ELSE coalesce({_COVERED}, false) END AS open FROM (SELECT DISTINCT stable_id, date FROM {t} WHERE stable_id IS NOT NULL) x LEFT JOIN securities s ON x.stable_id = s.stable_id" for t in ("exposures", "labels")
)
SQL["p5_counts"] = f"WITH st AS ({_STATES} UNION ALL SELECT 'exposures', 'date', {_MONTH}, t.d IS NULL FROM (SELECT DISTINCT stable_id, date FROM exposures WHERE date IS NOT NULL) x LEFT JOIN (SELECT DISTINCT date AS d FROM trading_days) t ON x.date = t.d) SELECT table_name, field, month, count(*) FILTER (open) AS orphans, count(*) FILTER (NOT open) AS held FROM st GROUP BY 1, 2, 3"

_POS = lambda c: f"CASE WHEN isfinite({c}) AND {c} > 0 THEN {c}::DOUBLE END"
SQL["p3_found"] = (
    f"WITH lv AS (SELECT stable_id, quantile_disc(c, 0.5) AS level FROM (SELECT stable_id, date, max({_POS('close')}) AS c FROM daily WHERE stable_id IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2) GROUP BY 1), "
    f"d AS (SELECT x.stable_id, x.date, x.close, {_POS('x.open')} AS o, {_POS('x.high')} AS h, {_POS('x.low')} AS l, level FROM daily x LEFT JOIN lv USING (stable_id) WHERE x.stable_id IS NOT NULL AND x.date IS NOT NULL), "
    f"op AS (SELECT 'daily' AS table_name, 'open' AS field, stable_id, date FROM d WHERE o IS NULL OR coalesce(CASE WHEN h IS NOT NULL OR l IS NOT NULL THEN o > coalesce(h, l) * {impute.FAR} OR o < coalesce(l, h) / {impute.FAR} ELSE o > level * {impute.FAR_LEVEL} OR o < level / {impute.FAR_LEVEL} END, false)), "
    "cl AS (SELECT 'daily', 'close', stable_id, date FROM d WHERE close IS NULL OR isnan(close)), "
    "e AS (SELECT stable_id, date, CASE WHEN isfinite(log_mktcap) THEN log_mktcap END AS v FROM exposures), q AS (SELECT quantile_disc(v, 0.05) AS a, quantile_disc(v, 0.95) AS b FROM e), "
    "ex AS (SELECT 'exposures', 'log_mktcap', stable_id, date FROM e, q WHERE stable_id IS NOT NULL AND date IS NOT NULL AND (v IS NULL OR v < a - 3 * (b - a) - 1 OR v > b + 3 * (b - a) + 1)) "
    "SELECT DISTINCT table_name, field, stable_id, strftime(date, '%Y-%m-%d') AS date FROM (SELECT * FROM op UNION ALL SELECT * FROM cl UNION ALL SELECT * FROM ex)"
)
