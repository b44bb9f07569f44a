import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepath.operators import factor as X
from tidepath.operators import minute as M
from tidepath.operators import panel as P
from tidepath.operators import research as R
from tidepath.operators import signature as S
from tidepath.plans import reference as Q
from tidepath.sources import periods
from tidepath.sources.tables import spread

D0 = dt.date(2021, 1, 4)
GRID = [34_200_000_000 + 300_000_000 * i for i in range(6)]


def bars(days=6, seed=0, skip=()):
    rng, out = np.random.default_rng(seed), []
    for s in (1, 2):
        for d in range(days):
            for i, b in enumerate(GRID):
                if (s, d, i) not in skip and (s, d) not in skip:
                    out.append((D0 + dt.timedelta(d), s, b, float(10 * s * np.exp(rng.normal(0, 0.01))), float(rng.integers(0, 1000))))
    return out


SCHEMA = "date date, stable_id long, bar_us long, close double, volume double"


def test_day_elements_equal_the_direct_scan(spark):
    rows = bars(skip={(1, 1, 2), (1, 3, 0)})
    b = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cal = P.calendar(b)
    got = {(r.date, r.stable_id): r.feature for r in M.minute_features(b, cal, GRID, 3, 4).collect()}
    assert len(got) == 8
    filled = M.filled_bars(b, cal, GRID).toPandas().sort_values(["stable_id", "date", "bar_us"])
    for (day, sid), f in got.items():
        w = filled[(filled.stable_id == sid) & (filled.date <= day) & (filled.date > day - dt.timedelta(3))]
        x = np.column_stack([np.linspace(0, 1, len(w)), w["close"], np.log1p(w["volume"])])
        x[:, 1:] = (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0)
        want = S.features(x[None], 4, ("basepoint",))[0]
        assert np.allclose(f, want, rtol=1e-9, atol=1e-9)


def test_a_missing_day_suspends_the_branch(spark):
    b = spark.createDataFrame(bars(skip={(2, 2)}), SCHEMA)
    got = {(r.date, r.stable_id) for r in M.minute_features(b, P.calendar(b), GRID, 2, 2).collect()}
    assert {d for d, s in got if s == 2} == {D0 + dt.timedelta(i) for i in (1, 4, 5)}
    assert {d for d, s in got if s == 1} == {D0 + dt.timedelta(i) for i in range(1, 6)}
    empty = b.where("false")
    assert M.minute_features(empty, P.calendar(empty), GRID, 2, 2).count() == 0


def test_window_sums_equal_numpy(spark):
    b = spark.createDataFrame(bars(), SCHEMA)
    x = M.filled_bars(b, P.calendar(b), GRID)
    got = {(r.date, r.stable_id): r for r in M.sql_window_signature(x, 3, ["close", "volume"]).collect()}
    p = x.toPandas().sort_values(["stable_id", "date", "bar_us"])
    for (day, sid), r in got.items():
        w = p[(p.stable_id == sid) & (p.date <= day) & (p.date > day - dt.timedelta(3))][["close", "volume"]].to_numpy()
        want = np.concatenate(S.signature_levels(w[None], 2), axis=1)[0]
        assert np.allclose([r.s_0, r.s_1, r.s_00, r.s_01, r.s_10, r.s_11], want, rtol=1e-8, atol=1e-6)
    assert len(got) == 8


def test_day_slice_is_dense(spark):
    b = spark.createDataFrame(bars(skip={(1, 1, 2)}), SCHEMA)
    got = M.day_slice(b, "2021-01-05", GRID, ("close",)).collect()
    assert len(got) == 12 and sum(r.close is None for r in got) == 1
    assert M.day_slice(b, "2020-01-05", GRID, ("close",)).count() == 0


def test_grouped_residuals_equal_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = [(D0 + dt.timedelta(d), s, float(rng.normal()), float(rng.normal()), float(s % 3 == 1), float(s % 3 == 2)) for d in range(2) for s in range(30)]
    rows += [(D0, 99, None, 1.0, 0.0, 0.0), (D0 + dt.timedelta(5), 1, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "date date, stable_id long, y double, x double, a double, b double")
    one = {(r.date, r.stable_id): r.residual for r in R.neutralise_grouped(df, "y", "x", ["a", "b"]).collect()}
    two = {(r.date, r.stable_id): r.residual for r in X.neutralise(df, "y", ["x", "a", "b"]).collect()}
    assert one.keys() == two.keys() and one[D0 + dt.timedelta(5), 1] is None
    assert all(two[k] is None and one[k] is None or one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_report_and_arms(spark):
    rng = np.random.default_rng(0)
    rows = [(D0 + dt.timedelta(d), s, float(rng.normal()), float(rng.normal())) for d in range(4) for s in range(30)]
    x = spark.createDataFrame(rows, "date date, stable_id long, factor double, ret double")
    e = R.evaluate(x.drop("ret"), x.drop("factor"), None, 20, 5)
    assert "rank_ic" in R.report(e) and "2021" in R.report(e)
    published = spark.createDataFrame([(2021, 0.1)], "year int, published_rank_ic double")
    r = R.compare_arms({"a": e["by_year"], "broken": None}, published).first()
    assert r.arm == "a" and r.difference == pytest.approx(r.rank_ic - 0.1)
    with pytest.raises(ValueError):
        R.compare_arms({"a": None}, published)
    with pytest.raises(ValueError):
        R.evaluate(x, x, exposures=x)


def test_period_store_and_exports(spark, tmp_path):
    x = spark.createDataFrame([(D0, 1, 2.0), (D0, 2, 3.0), (D0 + dt.timedelta(1), 1, None)], "date date, stable_id long, size double")
    for p in ("2021", "more/2022"):
        x.toPandas().to_parquet((tmp_path / p).mkdir(parents=True) or tmp_path / p / "data.pq")
    got = periods.period_store(spark, str(tmp_path), ("date", "stable_id"))
    assert got.count() == 6 and got.columns == ["date", "stable_id"]
    with pytest.raises(ValueError):
        periods.period_store(spark, str(tmp_path), ("gone",))
    with pytest.raises(FileNotFoundError):
        periods.period_store(spark, str(tmp_path / "none"))
    r = periods.export(x, str(tmp_path / "out")).first()
    assert (r.dates, r.names, r.n_rows) == (2, 2, 3)
    assert periods.regressors(x.withColumn("ingested_at", F.current_timestamp())) == ["size"]
    assert periods.on_keys(x.drop("size"), x, ["size"]).where("size = 3").count() == 1
    with pytest.raises(ValueError):
        periods.on_keys(x, x.withColumn("stable_id", F.col("stable_id") + 100).withColumnRenamed("size", "s2"), ["s2"])


def test_date_range_waits_for_the_warm_up(spark):
    cal = spark.createDataFrame([(D0 + dt.timedelta(i), i) for i in range(10)], "date date, date_idx int")
    assert [r.date_idx for r in P.date_range(cal, "2021-01-01", "2021-01-08", 3).orderBy("date").collect()] == [2, 3, 4]
    assert P.date_range(cal).count() == 10


def test_codes_outside_the_levels_and_labels_alone(spark):
    caps = spark.createDataFrame([(D0, 1, 2.0), (D0, 2, 3.0), (D0, 3, 4.0)], "date date, stable_id long, cap double")
    codes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "stable_id long, code string")
    got = {r.stable_id: r.ind_b for r in P.exposures_one_hot(caps, codes, levels=("a", "b")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None}
    p = spark.createDataFrame([(D0 + dt.timedelta(i), s, float(s + i * s)) for i in range(3) for s in (1, 2, 3)], "date date, stable_id long, close double")
    with pytest.warns(UserWarning, match="not neutralised"):
        assert X.labels(p, P.calendar(p), 1).count() == 6


def test_two_branches_make_the_wanted_dates_only_and_nothing_twice(spark, data):
    """Work before the last join: features of the dates named equal those of all dates, and what a shuffle gave is not run to count its partitions."""
    every = Q._features(spark, data, 2)
    last = [r.date for r in every.select("date").distinct().orderBy("date").collect()][-3:]
    dates = spark.createDataFrame([(d,) for d in last], "date date")
    key = lambda rows: sorted((r.date, r.stable_id, tuple(r.feature or ())) for r in rows)
    assert key(Q._features(spark, data, 2, dates).collect()) == key(every.join(dates, "date").collect())
    shuffled, sc = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), spark.sparkContext
    sc.setJobGroup("spread", "spread")
    try:
        x = spread(shuffled)
        assert not sc.statusTracker().getJobIdsForGroup("spread")
    finally:
        sc._jsc.clearJobGroup()
    assert x.count() == 7
