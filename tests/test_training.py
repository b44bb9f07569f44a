import datetime as dt
import inspect
import math
import tracemalloc

import numpy as np
import pytest

from tidepath.operators import network as N
from tidepath.operators import panel as P
from tidepath.operators import training as T
from tidepath.plans import research

COLUMNS = {"daily": "a", "minute": "b"}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = N.factor_network({"daily": 3, "minute": 2}, hidden=4, heads=2, seed=1)
    inputs = {"daily": rng.normal(size=(7, 3)), "minute": rng.normal(size=(7, 2))}
    label = rng.normal(size=7)
    label[2] = np.nan

    def at(w):
        v = {k: T.Value(x) for k, x in w.items()}
        out = T.loss(T.forward(net, v, inputs), label)
        return out, v

    w = T.flatten(net)
    assert np.allclose(T.forward(net, {k: T.Value(x) for k, x in w.items()}, inputs).data, N.forward(net, inputs))
    out, v = at(w)
    out.backward()
    for k in w:
        for i in list(np.ndindex(*w[k].shape))[:6]:
            step = np.zeros_like(w[k])
            step[i] = 1e-6
            want = (at({**w, k: w[k] + step})[0].data - at({**w, k: w[k] - step})[0].data) / 2e-6
            assert abs(v[k].grad[i] - want) < 1e-5, (k, i)


def plain(x, net):
    """Attention with all scores at once."""
    n, dim = x.shape
    h = net["heads"]
    q, k, v = (N.apply(net[c], x).reshape(n, h, dim // h).transpose(1, 0, 2) for c in "qkv")
    return N.apply(net["o"], (N.softmax(q @ k.transpose(0, 2, 1) / math.sqrt(dim // h)) @ v).transpose(1, 0, 2).reshape(n, dim))


def test_attention_in_blocks_equals_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    net = N.factor_network({"daily": 3, "minute": 2}, hidden=4, heads=2, seed=3)
    x, inputs, label = rng.normal(size=(11, 8)) * 3, {"daily": rng.normal(size=(11, 3)), "minute": rng.normal(size=(11, 2))}, rng.normal(size=11)
    w, grads = T.flatten(net), []
    for block in (1, 30, 1 << 20):  # one row, two rows and a rest, all
        monkeypatch.setattr(N, "BLOCK", block)
        assert np.allclose(N.attention(x, net), plain(x, net), rtol=1e-12, atol=1e-12)
        v = {k: T.Value(a) for k, a in w.items()}
        T.loss(T.forward(net, v, inputs), label).backward()
        grads.append(v)
    assert all(np.allclose(grads[0][k].grad, g[k].grad, rtol=1e-9, atol=1e-12) for g in grads[1:] for k in w)
    assert N.attention(x[:0], net).shape == (0, 8)


@pytest.mark.parametrize("widths", [{"daily": 3}, {"daily": 3, "minute": 2}])
def test_memory_of_a_prediction_grows_with_the_names_only(widths):
    """All scores of 3,000 names at once would be 144 MB."""
    rng = np.random.default_rng(0)
    inputs = {b: rng.normal(size=(3000, n)) for b, n in widths.items()}
    tracemalloc.start()
    N.forward(N.factor_network(widths), inputs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_memory_of_a_gradient_grows_with_the_names_only():
    rng = np.random.default_rng(0)
    net = N.factor_network({"daily": 1}, hidden=4)
    tracemalloc.start()
    w = {k: T.Value(x) for k, x in T.flatten(net).items()}
    T.loss(T.forward(net, w, {"daily": rng.normal(size=(3000, 1))}), rng.normal(size=3000)).backward()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_loss_of_too_few_names_is_zero_with_a_live_gradient():
    p = T.Value([1.0, 2.0, 3.0])
    out = T.loss(p, np.array([1.0, np.nan, 2.0]))
    out.backward()
    assert out.data == 0 and np.allclose(p.grad, 0)
    assert T.loss(T.Value([1.0, 2.0, 3.0]), np.array([1.0, 2.0, 3.0])).data < -0.99
    assert np.isnan(T.rank_ic(np.array([1.0, 2.0]), np.array([1.0, 2.0])))


def rows(spark, years, per_year=6, names=25, seed=0):
    rng, out = np.random.default_rng(seed), []
    for y in years:
        for m in range(1, per_year + 1):
            for s in range(names):
                a, b = rng.normal(size=3), rng.normal(size=2)
                out.append((dt.date(y, m, 3), s, float(2 * a[0] - b[1] + 0.3 * rng.normal()), a.tolist(), b.tolist()))
    return spark.createDataFrame(out, "date date, stable_id long, label double, a array<double>, b array<double>").cache()


def test_yearly_refits_learn_and_predict_unseen_years(spark):
    x = rows(spark, (2017, 2018, 2019, 2020))
    cal = P.calendar(x)
    factor, fits = T.rolling(x, cal, [2016, 2019, 2020], COLUMNS, T.Plan(epochs=12, rate=0.05), lookback=3)
    assert sorted(fits) == [2019, 2020]  # nothing comes before 2016
    got = factor.join(x, ["date", "stable_id"]).toPandas()
    assert {d.year for d in got["date"]} == {2019, 2020} and len(got) == 2 * 6 * 25
    assert np.mean([T.rank_ic(g["factor"].to_numpy(), g["label"].to_numpy()) for _, g in got.groupby("date")]) > 0.6
    h = fits[2020].history
    assert h[-1][1] < h[0][1] and max(e[2] for e in h) > h[0][2]


def test_early_stop_keeps_the_best_and_no_validation_is_minus_infinity(spark):
    x = rows(spark, (2018,), 2, 8).selectExpr("*", "if(month(date) = 1, 'train', 'val') as part")
    f = T.fit(x, COLUMNS, T.Plan(epochs=30, patience=1, rate=0.8))
    assert len(f.history) < 30
    best = max(range(len(f.history)), key=lambda i: f.history[i][2])
    assert len(f.history) - 1 - best >= 1
    alone = T.fit(x.where("part = 'train'"), COLUMNS, T.Plan(epochs=2))
    assert alone.history[0][2] == -np.inf
    assert T.fit(x.where("false"), COLUMNS).history[0][1] == 0.0


def test_the_registered_refits_are_whole(spark, data, monkeypatch):
    """The source's hundred epochs, patience, width and heads, and every year that has train dates before it."""
    rolling, got = inspect.signature(T.rolling), []

    def untrained(*args, **more):
        b = rolling.bind(*args, **more)
        b.apply_defaults()
        got.append(b.arguments)
        return b.arguments["rows"].selectExpr("date", "stable_id", "0D as factor"), {}

    monkeypatch.setattr(T, "rolling", untrained)
    research.rolling_network_factor(spark, data)
    a = got[0]
    assert (a["plan"].epochs, a["plan"].patience, a["plan"].hidden, a["plan"].heads) == (100, 30, 128, 4)
    assert (a["lookback"], a["validation"]) == (4, 1) and set(a["years"]) >= {1997, 1998, 1999, 2000, 2001}
    assert len(a["rows"].select("date").distinct().collect()) > 80


def test_fits_side_by_side_equal_fits_alone(spark):
    x = rows(spark, (2017, 2018, 2019), 3, 9)
    months = sorted(r.date for r in x.select("date").distinct().collect())
    uses = {1: {d: "val" if d.year == 2018 else "train" for d in months if d.year < 2019}, 2: {d: "val" if d.year == 2019 else "train" for d in months}}
    plan = T.Plan(epochs=6, patience=2, rate=0.3, hidden=8)
    both = T.fit_all(x, COLUMNS, uses, plan)
    for k, parts in uses.items():
        alone = T.fit_all(x, COLUMNS, {k: parts}, plan)[k]
        assert len(alone.history) == len(both[k].history)
        assert np.allclose(alone.history, both[k].history, rtol=1e-12)
        a, b = T.flatten(alone.net), T.flatten(both[k].net)  # other dates share the tasks, which alters no digit
        assert all((a[n] == b[n]).all() for n in a) and [h[2:] for h in alone.history] == [h[2:] for h in both[k].history]


def test_erf_of_arrays():
    x = np.concatenate([np.linspace(-7, 7, 2001), [0.0, 0.46875, -0.46875, np.inf, -np.inf]])
    assert np.abs(T.erf(x) - [math.erf(v) for v in x]).max() < 1e-15 and np.isnan(T.erf(np.array([np.nan])))[0]


def test_rolling_ridge_is_out_of_sample(spark):
    x = rows(spark, (2018, 2019, 2020))
    cal = P.calendar(x)
    base = {(r.date, r.stable_id): r.factor for r in T.rolling_ridge(x, cal, [2020], "a", 3, lookback=2).collect()}
    spoiled = x.selectExpr("date", "stable_id", "if(year(date) = 2020, -label, label) as label", "a", "b")
    again = {(r.date, r.stable_id): r.factor for r in T.rolling_ridge(spoiled, cal, [2020], "a", 3, lookback=2).collect()}
    assert base == pytest.approx(again) and len(base) == 6 * 25


def test_build_and_train_on_the_command_line(spark, tmp_path, data):
    """Both branches stored, fitted and stitched; the log has a line per epoch. The test tables hold one year, so there is no
    year to fit on before it."""
    from tidepath import cli

    root = str(tmp_path / "store")
    small = ["--set", "data.daily_days=10", "--set", "signature.depth=2", "--set", "data.minute_days=2", "--set", "labels.horizon=2", "--set", "training.hidden=4", "--set", "training.heads=2"]
    cli.main(["build", data, root, *small])
    cli.main(["build-minute", data, root, *small])
    with pytest.raises(ValueError):
        cli.main(["train", data, root, str(tmp_path / "factor"), "--years", "2021", *small])
    x = spark.read.parquet(root + "/features")
    assert {r.branch for r in x.select("branch").distinct().collect()} == {"daily", "minute"}
