import datetime as dt

import numpy as np

from tidepath.operators import spikes

D0 = dt.date(2021, 1, 4)
DAILY = "date date, stable_id long, close double, volume double"


def series(n=60, seed=0, sid=1):
    rng = np.random.default_rng(seed)
    close = 20 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    volume = np.round(1e5 * np.exp(rng.normal(0, 0.3, n)))
    return [[D0 + dt.timedelta(i), sid, float(np.round(c, 4)), float(v)] for i, (c, v) in enumerate(zip(close, volume))]


def found(spark, rows):
    f = spikes.flag_daily(spark.createDataFrame(rows, DAILY)).collect()
    return {(r.field, r.stable_id, r.date, r.rule) for r in f}


def day(i):
    return str(D0 + dt.timedelta(i))


def test_spike_of_one_and_three_but_no_level_shift(spark):
    rows = series()
    rows[20][2] *= 1.4
    for i in (30, 31, 32):
        rows[i][2] *= 0.6
    for i in range(45, 60):
        rows[i][2] *= 1.5
    got = found(spark, rows)
    assert {d for f, _, d, r in got if r == "spike" and f == "close"} == {day(20), day(30), day(31), day(32)}


def test_four_readings_off_are_a_level(spark):
    rows = series()
    for i in (30, 31, 32, 33):
        rows[i][2] *= 0.6
    assert not {x for x in found(spark, rows) if x[3] == "spike"}


def test_impossible_stuck_and_volume(spark):
    rows = series()
    rows[5][2], rows[6][2], rows[7][3], rows[8][3] = -1.0, float("inf"), -5.0, rows[8][3] * 60
    for i in range(40, 47):
        rows[i][2] = rows[40][2]
    for i in range(50, 56):  # no activity: genuine
        rows[i][2], rows[i][3] = rows[50][2], 0.0
    got = found(spark, rows)
    assert {(f, d) for f, _, d, r in got if r == "impossible"} == {("close", day(5)), ("close", day(6)), ("volume", day(7))}
    assert {d for f, _, d, r in got if r == "spike"} == {day(8)}
    assert {d for f, _, d, r in got if r == "stuck"} == {day(i) for i in range(41, 47)}


def test_nulls_repeats_and_empty(spark):
    rows = series()
    rows[20][2] *= 1.5
    again = [list(r) for r in rows]
    extra = [[None, 1, 5.0, 1.0], [D0, None, 5.0, 1.0], [D0 + dt.timedelta(70), 1, None, None], [D0 + dt.timedelta(71), 1, float("nan"), float("nan")]]
    assert found(spark, rows + again + extra) == found(spark, rows) != set()
    assert found(spark, []) == set()
    assert spikes.flag_daily(spark.createDataFrame([(D0, 1, 1.0, 1.0)], DAILY)).count() == 0


def test_intraday_across_dates_equals_one_block(spark):
    rng = np.random.default_rng(3)
    rows, price = [], 0.0
    for d in range(4):
        for k in range(40):
            price += rng.normal(0, 0.001)
            rows.append([D0 + dt.timedelta(d), 34_200_000_000 + k * 60_000_000, 7, float(30 * np.exp(price)), 100.0])
    for i in (39, 40, 80, 100):  # at the ends of dates too
        rows[i][3] *= 1.1
    f = spikes.flag_intraday(spark.createDataFrame(rows, "date date, time long, stable_id long, close double, volume double"))
    assert {(r.date, r.time) for r in f.where("rule = 'spike'").collect()} == {(str(rows[i][0]), rows[i][1]) for i in (39, 40, 80, 100)}


def tails(spark, scales, n, shape=0.0, rate=0.08, spoiled=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for sid, scale in enumerate(scales):
        m = int(n * rate)
        x = rng.exponential(1, m)
        x = x if shape == 0 else np.expm1(shape * x) / shape
        z = 2 + scale * x
        z[: int(m * spoiled)] += 60
        rows += [(sid, float(v), n) for v in z]
    return spark.createDataFrame(rows, "sid long, z double, size long")


def test_fitted_tails_reach_the_true_quantiles(spark):
    t = spikes.Tail(risk=1e-6, threshold=2.0)
    for shape, slack in ((0.0, 0.15), (0.15, 0.35)):
        scales = np.linspace(0.7, 1.3, 12)
        got = {r.sid: r.cutoff for r in spikes.fit_tails(tails(spark, scales, 20_000, shape), t).collect()}
        far = np.log(0.08 / 1e-6)
        reach = far if shape == 0 else np.expm1(shape * far) / shape
        for sid, scale in enumerate(scales):
            assert abs(got[sid] / (2 + scale * reach) - 1) < slack


def test_wrong_readings_do_not_bend_the_tails(spark):
    clean = spikes.fit_tails(tails(spark, [1.0] * 10, 5000), spikes.CLOSE).toPandas()["cutoff"].mean()
    spoiled = spikes.fit_tails(tails(spark, [1.0] * 10, 5000, spoiled=0.1), spikes.CLOSE).toPandas()["cutoff"].mean()
    assert abs(spoiled / clean - 1) < 0.1


def test_no_peaks_give_no_cutoffs(spark):
    assert spikes.fit_tails(spark.createDataFrame([], "sid long, z double, size long"), spikes.CLOSE).count() == 0


def test_levels_reach_over_thin_blocks(spark):
    """Blocks of one or two readings: the level takes as many blocks on either side as it needs."""
    rows = [[D0 + dt.timedelta(i), 40_000_000_000 + k, 1, 30.0 * float(np.exp(0.001 * ((i * 7 + 3 * k) % 5))), 1.0] for i in range(80) for k in range(1 + i // 40)]
    for i in (20, 21, 22):
        rows[i][3] *= 1.3
    f = spikes.flag_intraday(spark.createDataFrame(rows, "date date, time long, stable_id long, close double, volume double"))
    assert {r.date for r in f.where("rule = 'spike'").collect()} == {str(rows[i][0]) for i in (20, 21, 22)}
