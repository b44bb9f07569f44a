import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidepath.operators import impute, orphans

D0 = dt.date(2021, 1, 4)


def test_posterior_equals_enumeration():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (400, 4))
    x[:, 1] = (x[:, 0] + (rng.random(400) < 0.1)) % 3
    x[:, 3] = (x[:, 1] + (rng.random(400) < 0.2)) % 3
    counts = [(i, j, a, b, int(((x[:, i] == a) & (x[:, j] == b)).sum())) for i in range(4) for j in range(i, 4) for a in range(3) for b in range(3)]
    tree = impute.chow_liu(counts, list("abcd"), [3] * 4)
    assert {frozenset(e) for e in tree.edges} >= {frozenset((0, 1)), frozenset((1, 3))}
    joint = np.ones((3,) * 4)
    for s in np.ndindex(*joint.shape):
        p = tree.joint[tree.edges[0]].sum(1)[s[tree.edges[0][0]]]
        for a, b in tree.edges:
            t = tree.joint[a, b]
            p *= t[s[a], s[b]] / t.sum(1)[s[a]]
        joint[s] = p
    for states in ([-1, -1, 2, 1], [0, -1, -1, -1], [-1] * 4):
        at = tuple(slice(None) if v < 0 or k == 1 else v for k, v in enumerate(states))
        want = joint[at]
        keep = [k for k in range(4) if isinstance(at[k], slice)]
        want = want.sum(tuple(i for i, k in enumerate(keep) if k != 1))
        got = impute.posterior(tree, np.array([states]), 1)[0]
        assert np.allclose(got, want / want.sum(), atol=0.02)


def daily(n=80, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for s in (1, 2, 3):
        c = 10 * s * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i in range(n):
            o = c[i] * np.exp(rng.normal(0, 0.003))
            out.append([D0 + dt.timedelta(i), s, float(o), float(max(o, c[i]) * 1.004), float(min(o, c[i]) * 0.996), float(c[i]), 1000.0, "extra"])
    return out


SCHEMA = "date date, stable_id long, open double, high double, low double, close double, volume double, open_value string"


def test_fill_daily(spark):
    rows = daily()
    truth = [list(r) for r in rows]
    for k, v in ((5, None), (25, float("nan")), (45, -1.0), (100, 99999.0), (120, float("inf")), (150, 0.01)):
        rows[k][2] = v
    rows[60][5] = None
    rows[61][5] = float("nan")
    rows[62][5] = -4.0  # a wrong close is no missing one
    rows += [list(rows[5]), [None, 1, None, 10.2, 10.0, 10.1, 1.0, ""], [D0, None, 9.0, 9.1, 8.9, None, 1.0, ""]]
    ids = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "stable_id long, industry_code string")
    got = impute.fill_daily(spark.createDataFrame(rows, SCHEMA), ids).collect()
    assert len(got) == len(rows)
    by = {(r.date, r.stable_id): r for r in got if r.date and r.stable_id}
    filled = {(r.date, r.stable_id) for r in got if r.open_is_filled and r.date and r.stable_id}
    assert filled == {(rows[k][0], rows[k][1]) for k in (5, 25, 45, 100, 120, 150)}
    assert {(r.date, r.stable_id) for r in got if r.close_is_filled and r.stable_id} == {(rows[k][0], rows[k][1]) for k in (60, 61)}
    for k in (5, 25, 45, 100, 120, 150):
        assert abs(by[rows[k][0], rows[k][1]].open_value / truth[k][2] - 1) < 0.02
    for k in (60, 61):
        assert abs(by[rows[k][0], rows[k][1]].close_value / truth[k][5] - 1) < 0.02
    assert by[rows[62][0], rows[62][1]].close_value == -4.0
    assert impute.fill_daily(spark.createDataFrame([], SCHEMA), ids).count() == 0


def test_fill_exposures(spark):
    rng = np.random.default_rng(2)
    rows = [[D0 + dt.timedelta(i), s, float(18 + s + 0.01 * i + rng.normal(0, 0.005))] for s in range(1, 7) for i in range(50)]
    truth = rows[70][2]
    rows[10][2], rows[70][2], rows[120][2], rows[130][2] = None, 999.0, -99.0, float("inf")
    rows += [[D0, 99, None], [None, 1, 20.0], [D0, None, float("nan")]]
    ids = spark.createDataFrame([(s, "a" if s < 4 else "b") for s in range(1, 7)] + [(99, "b")], "stable_id long, industry_code string")
    got = impute.fill_exposures(spark.createDataFrame(rows, "date date, stable_id long, log_mktcap double"), ids).collect()
    assert len(got) == len(rows) and sum(r.log_mktcap_is_filled for r in got) == 6
    assert all(r.log_mktcap_value is not None for r in got)
    v = {(r.date, r.stable_id): r.log_mktcap_value for r in got}
    assert abs(v[rows[70][0], rows[70][1]] - truth) < 0.1
    assert 20 < v[D0, 99] < 26  # from its industry
    assert impute.fill_exposures(spark.createDataFrame([], "date date, stable_id long, log_mktcap double"), ids).count() == 0


def refs(spark, rows):
    return spark.createDataFrame(rows, "table_name string, field string, key string, date date")


def parents(spark, rows):
    return spark.createDataFrame(rows, "field string, key string, since date, until date")


def keys(state):
    return {(r.key, (r.date - D0).days) for r in orphans.pending(state).collect()}


def test_orphans_wait_resolve_and_reopen(spark, tmp_path):
    day = lambda i: D0 + dt.timedelta(i)
    s = orphans.advance(orphans.empty_state(spark), new_refs=refs(spark, [("t", "id", "1", day(1)), ("t", "id", "2", day(1)), ("t", "id", "2", day(9)), ("t", "id", "2", day(9)), ("t", "id", None, day(1))]))
    assert keys(s) == {("1", 1), ("2", 1), ("2", 9)}
    s = orphans.save(orphans.advance(s, new_parents=parents(spark, [("id", "2", day(5), None), ("id", "2", day(3), None)])), f"file://{tmp_path}", 1)
    assert keys(s) == {("1", 1), ("2", 1)}
    s = orphans.save(orphans.advance(s, deletions=spark.createDataFrame([("id", "2", day(8)), ("id", "7", day(8))], "field string, key string, until date")), f"file://{tmp_path}", 2)
    assert keys(s) == {("1", 1), ("2", 1), ("2", 9)}
    s = orphans.advance(s, new_refs=refs(spark, [("t", "id", "2", day(6)), ("t", "id", "2", day(8)), ("t", "id", "2", day(9))]))
    assert keys(s) == {("1", 1), ("2", 1), ("2", 8), ("2", 9)}
    assert {(r.month, r.orphans, r.held) for r in orphans.snapshot(s).collect()} == {("2021-01", 4, 1)}


def test_orphan_counts_are_rows(spark):
    day = lambda i: D0 + dt.timedelta(i)
    exposures = spark.createDataFrame([(day(0), 1), (day(0), 2), (day(5), 1), (day(5), 1), (day(5), 2), (day(5), None), (None, 1), (None, 9), (None, 9), (day(0), 9)], "date date, stable_id long")
    labels = spark.createDataFrame([(None, 8), (day(0), 1), (None, None)], "date date, stable_id long")
    securities = spark.createDataFrame([(1, None, None), (2, day(-9), day(90))], "stable_id long, listed_on date, deleted_on date")
    s = orphans.panel_orphans(exposures, labels, securities, spark.createDataFrame([(day(0),)], "date date"))
    got = {(r.table_name, r.field, r.month): (r.orphans, r.held) for r in orphans.snapshot(s).collect()}
    assert got == {("exposures", "date", "2021-01"): (3, 3), ("exposures", "stable_id", "2021-01"): (1, 4), ("exposures", "stable_id", "(none)"): (1, 1), ("labels", "stable_id", "2021-01"): (0, 1), ("labels", "stable_id", "(none)"): (1, 0)}
    more = spark.createDataFrame([(day(5), 2), (day(5), 3), (None, 9)], "date date, stable_id long").withColumn("day_key", F.date_format("date", "yyyy-MM-dd"))
    new = orphans.references(more, "exposures", "date", "day_key", "date", "stable_id").unionByName(orphans.references(more, "exposures", "stable_id", "stable_id", "date"))
    s = orphans.advance(s, new_refs=new)
    got = {(r.table_name, r.field, r.month): (r.orphans, r.held) for r in orphans.snapshot(s).collect()}
    assert got["exposures", "date", "2021-01"] == (4, 3) and got["exposures", "stable_id", "(none)"] == (1, 1)


def test_increments_equal_one_batch(spark, tmp_path):
    """References first, parents and deletions late and in any order, step by step through a saved state."""
    rng = np.random.default_rng(5)
    day = lambda i: D0 + dt.timedelta(int(i))
    named = [("t", "id", str(k), day(d)) for k, d in rng.integers(0, 40, (300, 2))]
    there = [("id", str(k), day(rng.integers(0, 10)) if k % 2 else None, None) for k in range(0, 40, 3)]
    gone = [("id", str(k), day(rng.integers(10, 30))) for k in range(0, 40, 4)]
    ends = lambda rows: spark.createDataFrame(rows, "field string, key string, until date")
    whole = orphans.advance(orphans.advance(orphans.empty_state(spark), refs(spark, named), parents(spark, there)), deletions=ends(gone))
    steps = [(named[:100], [], []), (named[100:150], [], gone[:6]), ([], there[:7], gone[6:]), (named[150:], there[7:], [])]
    state, folder = orphans.empty_state(spark), f"file://{tmp_path}/state"
    for n, (r, p, g) in enumerate(steps):
        state = orphans.save(orphans.advance(state, refs(spark, r) if r else None, parents(spark, p) if p else None, ends(g) if g else None), folder, n)
    assert keys(state) == keys(whole) and {k for k, _ in keys(whole)} != set()
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v2", "v3"]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    state = orphans.save(orphans.advance(orphans.empty_state(spark), refs(spark, [("t", "id", str(k), D0) for k in range(50)])), folder, 0)
    new = refs(spark, [("t", "id", "7", D0 + dt.timedelta(1))])
    touched = [r[0] for r in new.select(orphans.bucket()).collect()]
    part = orphans.advance(orphans.load(spark, folder, 0, touched), new)
    assert orphans.save(part, folder, 1, touched).refs.count() == 51
    assert len(list((tmp_path / "state" / "v1" / "refs").glob("bucket=*"))) == 1


def test_categories_are_filled_however_many(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(6000):
        k = int(rng.integers(0, 200))
        rows.append((float(k + rng.normal(0, 0.1)), f"c{k:03d}", None if i % 10 == 0 else f"c{k:03d}", f"g{k // 20}"))
    df = spark.createDataFrame(rows, "x double, truth string, c string, g string")
    got, _ = impute.impute(df, ["c"], ["x"], ["c", "g"], 200)
    seen = got.where("c is null").select("truth", "c__filled").toPandas()
    assert (seen["truth"] == seen["c__filled"]).mean() > 0.5 and got.where("c is not null and c__filled is not null").count() == 0
    many = spark.range(impute.CATEGORIES + 5).selectExpr("cast(id as double) as x", "cast(id as string) as c")
    try:
        impute.impute(many, ["c"], ["x"], ["c"])
        raise AssertionError
    except ValueError as e:
        assert "category" in str(e)


def test_filled_sizes_are_no_worse_than_the_neighbours_mean(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for s in range(30):
        x = 20 + s / 10 + np.cumsum(rng.normal(0, 0.01, 80)) + rng.normal(0, 0.02, 80)
        for i in range(80):
            rows.append([D0 + dt.timedelta(i), s, float(x[i])])
    for k in range(40, len(rows) - 40, 11):
        if 0 < k % 80 < 79:
            truth[rows[k][0], rows[k][1]] = (rows[k][2], (rows[k - 1][2] + rows[k + 1][2]) / 2)
            rows[k][2] = None
    ids = spark.createDataFrame([(s, None if s % 7 == 0 else "ab"[s % 2]) for s in range(30)], "stable_id long, industry_code string")
    got = {(r.date, r.stable_id): r for r in impute.fill_exposures(spark.createDataFrame(rows, "date date, stable_id long, log_mktcap double"), ids).collect()}
    err = np.mean([abs(got[k].log_mktcap_value - t) for k, (t, _) in truth.items()])
    assert err < 1.02 * np.mean([abs(n - t) for t, n in truth.values()])
    assert all(r.industry_value in ("a", "b") and r.industry_is_filled == (r.stable_id % 7 == 0) for r in got.values())
