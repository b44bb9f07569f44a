import datetime as dt

import numpy as np
import pytest

from tidepath.operators import regrid, trailing

D0 = dt.date(2021, 1, 4)
INTRA = "date date, time long, stable_id long, close double, volume double, x0 string"


def test_grid_marks_and_bridges(spark):
    rows, truth = [], {}
    for d in range(5):
        for i, b in enumerate(regrid.bar_starts()):
            v = float(np.exp(3 + 0.01 * np.sin(i / 48 * 6.28) + 0.002 * d))
            truth[d, b] = v
            if (d, i) not in {(2, 10), (2, 11), (4, 47)}:
                rows.append((D0 + dt.timedelta(d), b + 1000, 1, v, 50.0, "clash"))
    rows += [(D0, None, 1, 5.0, 1.0, None), (None, 34_200_000_000, 1, 5.0, 1.0, None), (D0, 34_200_000_000, None, 5.0, 1.0, None), (D0, 30_000_000_000, 1, 99.0, 1.0, None)]
    days = spark.createDataFrame([(D0 + dt.timedelta(d),) for d in range(9)], "date date")
    g = regrid.regrid(spark.createDataFrame(rows + rows[:3], INTRA), days).collect()
    assert len(g) == 5 * 48
    gaps = {((r.date - D0).days, r.bar_us): r for r in g if r.close_status != "observed"}
    b = regrid.bar_starts()
    assert set(gaps) == {(2, b[10]), (2, b[11]), (4, b[47])}
    assert gaps[2, b[10]].close_status == "bridged" and gaps[4, b[47]].close_status == "carried"
    for k, r in gaps.items():
        assert abs(r.close / truth[k] - 1) < 0.005 and r.volume == pytest.approx(50, rel=0.05)
    assert all(r.volume == 50.0 for r in g if r.close_status == "observed")  # repeated rows count once


def test_grid_edges(spark):
    days = spark.createDataFrame([(D0,), (D0 + dt.timedelta(1),)], "date date")
    assert regrid.regrid(spark.createDataFrame([], INTRA), days).count() == 0
    only_bad = spark.createDataFrame([(D0, 34_200_000_000, 1, float("nan"), None, ""), (D0 + dt.timedelta(1), 34_200_000_000, 1, None, 1.0, "")], INTRA)
    g = regrid.regrid(only_bad, days)
    assert g.count() == 96 and g.where("close_status = 'empty' and close is null").count() == 96
    wrong = spark.createDataFrame([(D0, 34_200_000_000, 1, -3.0, 1.0, "")], INTRA)
    assert regrid.regrid(wrong, days).where("close_status = 'observed' and close = -3").count() == 1


def test_grid_is_never_broadcast(spark):
    """The optimiser takes the grid for as small as its sources; one with as few as these was sent to the driver whole."""
    rows = [(D0 + dt.timedelta(d), b, s, 10.0 + s, 5.0, "") for s in range(20) for d in (0, 29) for b in regrid.bar_starts()[:3]]
    days = spark.createDataFrame([(D0 + dt.timedelta(d),) for d in range(30)], "date date")
    g = regrid.regrid(spark.createDataFrame(rows, INTRA), days)
    assert len(g.collect()) == 20 * 30 * 48
    lines = g._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    sent = [i for i, x in enumerate(lines) if "BroadcastExchange" in x]
    under = [x for i in sent for x in lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]]
    assert sent and not [x for x in under if "Generate explode([34200000000" in x]


def test_trailing_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(D0 + dt.timedelta(int(d)), int(s), float(rng.integers(1, 100)), float(rng.integers(1, 9))) for s in (1, 2) for d in sorted(rng.choice(120, 40, replace=False))]
    dirty = rows + rows[:7] + [(None, 1, 1.0, 1.0), (D0, None, 1.0, 1.0), (rows[0][0] + dt.timedelta(200), 1, float("nan"), None)]
    t = trailing.trailing_totals(spark.createDataFrame(dirty, "date date, stable_id long, volume double, close double")).collect()
    got = {(r.stable_id, r.date): r for r in t}
    for s in (1, 2):
        mine = {d: (v, c) for d, i, v, c in rows if i == s}
        last = max(mine) if s == 2 else rows[0][0] + dt.timedelta(200)
        day = min(mine)
        assert sum(1 for k in got if k[0] == s) == (last - day).days + 1
        while day <= last:
            for p in (7, 30):
                vs = [mine[day - dt.timedelta(i)][0] for i in range(p) if day - dt.timedelta(i) in mine]
                r = got[s, day]
                assert r[f"volume_sum_{p}"] == sum(vs) and r[f"volume_days_{p}"] == len(vs)
                assert r[f"volume_avg_{p}"] == (pytest.approx(sum(vs) / len(vs)) if vs else None)
            day += dt.timedelta(1)
    assert trailing.trailing_totals(spark.createDataFrame([], "date date, stable_id long, volume double, close double")).count() == 0
