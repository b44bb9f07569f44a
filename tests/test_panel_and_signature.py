import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepath import cli, config
from tidepath.operators import factor as X
from tidepath.operators import network as N
from tidepath.operators import orphans
from tidepath.operators import panel as P
from tidepath.operators import signature as S
from tidepath.sources import store
from tidepath.sources.tables import require
from tidepath.streaming.orphans import watch

RNG = np.random.default_rng(0)
D0 = dt.date(2021, 1, 4)


def test_word_counts():
    assert [len(S.lyndon_words(d, n)) for d, n in ((3, 5), (2, 4), (5, 3))] == [80, 8, 55]
    assert all(S.is_lyndon(w) for w in S.lyndon_words(3, 5))
    assert S.feature_count(5, 60, 5, (["coordinate_projection", {"size": 2}], "time", "basepoint")) == 800
    assert S.feature_count(5, 32, 2, (["coordinate_projection", {"size": 2}], "time", "basepoint")) == 60


def test_chen_scaling_and_exponential():
    x = RNG.normal(size=(3, 9, 3))
    whole = S.signature_levels(x, 5)
    parts = S.multiply(S.signature_levels(x[:, :5], 5), S.signature_levels(x[:, 4:], 5))
    for a, b in zip(whole, parts):
        assert np.allclose(a, b)
    f = RNG.uniform(0.5, 2, (3, 3))
    for a, b in zip(S.signature_levels(x * f[:, None], 4), S.scale_channels(S.signature_levels(x, 4), f)):
        assert np.allclose(a, b)
    line = S.signature_levels(np.array([[[0.0, 0.0], [2.0, 3.0]]]), 3)
    v = np.array([2.0, 3.0])
    assert np.allclose(line[2][0], np.einsum("i,j,k->ijk", v, v, v).ravel() / 6)
    assert np.allclose(np.concatenate(S.log_levels(line)[1:], axis=1), 0)
    again = np.repeat(x, 2, axis=1)  # standing still changes nothing
    assert np.allclose(S.features(x, 3, (), rescale="none"), S.features(again, 3, (), rescale="none"))


def test_windows_and_augmentations():
    assert [len(S.window_ranges(k, 12, 4, s)) for k, s in (("sliding", 2), ("expanding", 3))] == [5, 4]
    assert S.window_ranges("dyadic", 16)[:4] == [(0, 16), (0, 8), (8, 16), (0, 4)]
    assert [b for _, b in S.window_ranges("dyadic", 10)][3:] == [2, 5, 8, 10]
    with pytest.raises(ValueError):
        S.window_ranges("sliding", 3, 4, 1)
    x = np.arange(6.0).reshape(1, 3, 2)
    assert S.augment(x, ["lead_lag"])[0, 0].tolist() == [[0, 1, 0, 1], [2, 3, 0, 1], [2, 3, 2, 3], [4, 5, 2, 3], [4, 5, 4, 5]]
    assert S.augment(x, ["invisibility_reset"])[0, 0].tolist() == [[1, 0, 1], [1, 2, 3], [1, 4, 5], [0, 4, 5], [0, 0, 0]]
    assert S.augment(x, ["time", "basepoint"])[0, 0].tolist() == [[0, 0, 0], [0, 0, 1], [0.5, 2, 3], [1, 4, 5]]
    assert S.augment(np.zeros((1, 4, 3)), [["coordinate_projection", {"size": 2, "ordered": True}]]).shape == (1, 6, 4, 2)
    r = [S.augment(x, [["random_projection", {"seed": 3}]]) for _ in range(2)]
    assert np.array_equal(*r)
    S.register_augmentation("double", lambda: lambda y: 2 * y)
    assert S.augment(x, ["double"]).max() == 10
    a, b = (S.features(x, 3, (), transform="signature", rescale=m) for m in ("none", "post"))
    assert np.allclose(b / np.where(a == 0, 1, a), np.where(a == 0, 0, S.level_factorials(2, 3, "signature")))


def test_jvm_and_numpy_signatures_agree(spark):
    x = RNG.normal(size=(4, 7, 2))
    rows = [(k, i, float(p[0]), float(p[1])) for k in range(4) for i, p in enumerate(x[k])]
    df = spark.createDataFrame(rows + [(9, 0, 1.0, 1.0)], "id long, i int, a double, b double")
    sig = S.sql_signature(df, "id", "i", ["a", "b"], 3)
    got = S.sql_logsignature(sig, "id", 2, 3).where("id < 9").orderBy("id").toPandas().to_numpy()[:, 1:]
    assert np.allclose(got, S.features(x, 3, (), rescale="none"))
    assert set(sig.where("id = 9").first()[1:]) == {0.0}


def frame(spark, closes):
    rows = [(D0 + dt.timedelta(i), s, c, c, c, c, 10.0) for s, cs in closes.items() for i, c in enumerate(cs) if c is not None]
    return spark.createDataFrame(rows, "date date, stable_id long, open double, high double, low double, close double, volume double")


def test_fill_forward_return_and_no_lookahead(spark):
    nan = float("nan")
    p = P.panel(frame(spark, {1: [nan, 1.0, nan, 3.0, nan], 2: [10.0, 11.0, 12.0, 13.0, 14.0]}))
    cal = P.calendar(p)
    w = P.filled(P.windows(P.dense(p, cal), 5))
    assert w.where("stable_id = 1").first()["close"] == [1, 1, 1, 3, 3]
    assert P.coverage(P.dense(p, cal), 5, 0.4).where("stable_id = 1 and valid").count() == 0  # not there on its own date
    f = {(r.stable_id, (r.date - D0).days): r.ret for r in P.forward_return(p, cal, 2).collect()}
    assert f[2, 0] == pytest.approx(0.2) and f[2, 1] == pytest.approx(2 / 11) and f[2, 3] is None and f[1, 1] == pytest.approx(2.0)
    z = P.normalised(P.filled(P.windows(P.dense(p, cal), 4)))
    changed = P.panel(frame(spark, {1: [nan, 1.0, nan, 3.0, nan], 2: [10.0, 11.0, 12.0, 13.0, 99.0]}))
    z2 = P.normalised(P.filled(P.windows(P.dense(changed, cal), 4)))
    pick = lambda v: v.where("stable_id = 2").orderBy("date").first()["close"]
    assert pick(z) == pick(z2)
    assert np.mean(pick(z)) == pytest.approx(0, abs=1e-9)


def test_empty_panel_and_contract(spark):
    e = P.panel(frame(spark, {}))
    cal = P.calendar(e)
    assert P.windows(P.dense(e, cal), 3).count() == 0 and P.forward_return(e, cal, 2).count() == 0 and P.universe(P.dense(e, cal), 3).count() == 0
    assert X.rank_ic(X.scored(P.trailing_return(e, cal, 1), P.forward_return(e, cal, 1))).count() == 0
    with pytest.raises(ValueError):
        require(e, ("nothing",))


def test_row_order_does_not_matter(spark, data):
    rows = spark.read.parquet(f"{data}/daily.parquet")
    ic = []
    for x in (rows, rows.orderBy(F.desc("close")).repartition(7)):
        p = P.panel(x)
        cal = P.calendar(p)
        ic.append(sorted(map(tuple, X.evaluate(P.trailing_return(p, cal, 5), P.forward_return(p, cal, 5), None, 5, 2)["ic"].collect())))
    assert ic[0] == ic[1] and ic[0]


def cross(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    size = rng.normal(size=n)
    y = 2.5 * size + rng.normal(size=n)
    ind = rng.integers(0, 3, n)
    return pd.DataFrame({"date": D0, "stable_id": range(n), "y": y, "size": size, "i1": (ind == 1) * 1.0, "i2": (ind == 2) * 1.0, "i3": (ind > 0) * 1.0})


def test_neutralise_and_gauss_rank(spark):
    pdf = cross(spark)
    df = spark.createDataFrame(pdf)
    r = X.neutralise(df, "y", ["size", "i1", "i2", "i3"]).orderBy("stable_id").toPandas()["residual"].to_numpy()  # collinear dummies
    for c in ("size", "i1", "i2"):
        assert abs(np.corrcoef(r, pdf[c])[0, 1]) < 1e-8
    one = X.neutralise_single(df, "y", "size").orderBy("stable_id").toPandas()["residual"].to_numpy()
    x = np.column_stack([np.ones(60), pdf["size"]])
    assert np.allclose(one, pdf["y"] - x @ np.linalg.lstsq(x, pdf["y"], rcond=None)[0])
    g = X.gauss_rank(spark.createDataFrame([(D0, i, v) for i, v in enumerate([1.0, None, 3.0, 2.0])] + [(D0 + dt.timedelta(1), 5, 8.0)], "date date, stable_id long, v double"), ["v"]).orderBy("date", "stable_id").collect()
    inv = NormalDist().inv_cdf
    assert [r.v if r.v is None else round(r.v, 9) for r in g] == [round(inv(0.5 / 3), 9), None, round(inv(2.5 / 3), 9), 0.0, 0.0]


def test_weights_and_newey_west(spark):
    df = spark.createDataFrame([(D0, i, float(-i)) for i in range(100)], "date date, stable_id long, v double")
    w = [r.weight for r in X.rank_weights(df, "v").orderBy("stable_id").collect()]
    assert sum(w) == pytest.approx(1) and w[50] / w[0] == pytest.approx(0.5)
    x = np.random.default_rng(4).normal(0.1, 1, 50)
    got = X.newey_west(spark.createDataFrame([(D0 + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "date date, v double"), "v", 3).first()
    c = x - x.mean()
    g = c @ c / 50 + sum(2 * (1 - k / 4) * (c[k:] @ c[:-k]) / 50 for k in (1, 2, 3))
    assert got.se == pytest.approx(math.sqrt(g / 50)) and got.t == pytest.approx(x.mean() / math.sqrt(g / 50))


def test_networks(spark):
    n = N.mixer_network(8, 5)
    x = RNG.normal(size=(6, 8, 5))
    assert N.mixer_forward(n, x).shape == (6,) and all(np.allclose(w, np.tril(w)) for pair in n["time"].values() for w in pair)
    late = x.copy()
    late[:, 6:] += 1.0  # a step sees itself and the past only
    for scale, z in N.mixer_steps(n, late).items():
        assert np.allclose(z[:, : 6 // scale], N.mixer_steps(n, x)[scale][:, : 6 // scale]) and not np.allclose(z, N.mixer_steps(n, x)[scale])
    net = N.factor_network({"a": 4, "b": 3}, hidden=4, heads=2)
    v = {"a": RNG.normal(size=(5, 4)), "b": RNG.normal(size=(5, 3))}
    order = np.array([3, 1, 0, 4, 2])
    assert np.allclose(N.forward(net, v)[order], N.forward(net, {k: u[order] for k, u in v.items()}))
    with pytest.raises(ValueError):
        N.factor_network({"a": 4}, hidden=5, heads=2)
    xs = RNG.normal(size=(200, 3))
    df = spark.createDataFrame([(D0, i, [float(a) for a in r], float(r @ [1, -2, 3] + 4)) for i, r in enumerate(xs)], "date date, stable_id long, f array<double>, y double")
    coef = N.ridge_fit(df, "f", "y", 3, 1e-6)
    assert np.allclose(coef, [1, -2, 3, 4], atol=1e-4)
    assert N.ridge_predict(df, "f", coef).count() == 200


def test_store_config_and_cli(spark, tmp_path, data):
    c = config.load(None, ("data.daily_days=6", "signature.depth=2", "data.universe_size=5"))
    root = str(tmp_path / "store")
    cli.build(spark, data, root, c)
    x = spark.read.parquet(f"{root}/features")
    assert x.select(F.size("feature")).first()[0] == 60 == store.read_manifest(spark, root)["features"]["daily"]
    files = sorted(p.name for p in (tmp_path / "store").rglob("*.parquet"))
    cli.build(spark, data, root, c)  # nothing is built twice
    assert sorted(p.name for p in (tmp_path / "store").rglob("*.parquet")) == files
    with pytest.raises(ValueError):
        config.load(None, ("data.nothing=1",))
    with pytest.raises(FileNotFoundError):
        store.read_manifest(spark, str(tmp_path / "none"))
    wide = spark.createDataFrame([(D0, 1, [1.0, -264216.0])], "date date, stable_id long, feature array<double>")
    with pytest.raises(Exception, match="beyond half precision"):
        store.write_features(wide, root, "halves", "daily", half="feature")
    fine = store.write_features(wide.withColumn("feature", F.array(F.lit(1.0), F.lit(None).cast("double"))), root, "halves", "daily", True, "feature")
    assert dict(fine.dtypes)["feature"] == "array<float>" and fine.count() == 1
    assert store.date_features(spark, root, "halves", "daily", str(D0)).count() == 1
    with pytest.raises(FileNotFoundError):
        store.date_features(spark, root, "halves", "daily", "1999-01-01")
    factor = spark.createDataFrame([(D0, 2, 0.5), (D0, 1, 0.25), (D0.replace(year=2020), 1, 1.0)], "date date, stable_id long, factor double")
    assert store.write_factor(factor, root + "/factor").columns == factor.columns and (tmp_path / "store" / "factor" / "year=2020").exists()
    cli.main(["evaluate", data, root + "/factor", "--rebalance", "daily", "--neutralise", "--against-label", data + "/labels.parquet"])


def test_orphan_stream(spark, tmp_path):
    schema = "kind string, table_name string, field string, key string, date date, since date, until date"
    source = str(tmp_path / "in")
    batches = [[("reference", "t", "id", "1", D0, None, None), ("reference", "t", "id", "2", D0, None, None)], [("parent", None, "id", "1", None, None, None)], [("deletion", None, "id", "1", None, None, D0)]]
    counts = []
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        q = watch(spark.readStream.schema(schema).parquet(source), f"file://{tmp_path}/state", str(tmp_path / "ck"), lambda n, s: counts.append(s.first()["orphans"]))
        q.awaitTermination()
    assert counts == [2, 1, 2]
    assert orphans.pending(orphans.load(spark, f"file://{tmp_path}/state", 2)).count() == 2
