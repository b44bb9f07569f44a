"""Training of the factor network by distributed gradients, with yearly refits, early stopping and the best weights kept.

A small reverse-mode differentiator on NumPy arrays gives the gradient of the network's forward pass. A date's names are
one group (they attend to each other), dates are independent: a step of Adam sums the gradients of the train dates, so
a task holds one date's names at a time and the driver the weights alone. The fits of several years go side by side, one job
an epoch over rows that are shuffled once. The loss is minus the weighted correlation of
prediction and label, weights falling by half every `halflife` of the names from the best prediction down.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.operators import network as N
from tidepath.operators import panel as P


class Value:
    """An array with the rule that sends its gradient to what it was made of."""

    def __init__(self, data: np.ndarray, parents: tuple = (), back: Callable | None = None):
        self.data, self.parents, self.back, self.grad = np.asarray(data, dtype=float), parents, back, None

    def backward(self) -> None:
        order, seen = [], set()
        waiting = [(self, False)]
        while waiting:
            v, done = waiting.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                waiting.append((v, True))
                waiting += [(p, False) for p in v.parents]
        for v in order:
            v.grad = None
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v.back is not None:
                for p, g in zip(v.parents, v.back(v.grad), strict=True):
                    g = _reduced(g, p.data.shape)
                    p.grad = g if p.grad is None else p.grad + g
                if v.parents:
                    v.grad = None  # passed on; only the weights' gradients are asked for

    def __add__(self, o):
        o = lift(o)
        return Value(self.data + o.data, (self, o), lambda g: (g, g))

    def __mul__(self, o):
        o = lift(o)
        return Value(self.data * o.data, (self, o), lambda g: (g * o.data, g * self.data))

    def __sub__(self, o):
        return self + lift(o) * -1.0

    def __truediv__(self, o):
        return self * lift(o) ** -1.0

    def __pow__(self, p: float):
        return Value(self.data**p, (self,), lambda g: (g * p * self.data ** (p - 1),))

    def __matmul__(self, o):
        swap = lambda x: np.swapaxes(x, -1, -2)
        return Value(self.data @ o.data, (self, o), lambda g: (g @ swap(o.data), swap(self.data) @ g))

    def mean(self):
        """Over the last axis, kept."""
        n = self.data.shape[-1]
        return Value(self.data.mean(-1, keepdims=True), (self,), lambda g: (np.broadcast_to(g / n, self.data.shape),))

    def sum(self):
        return Value(self.data.sum(), (self,), lambda g: (np.broadcast_to(g, self.data.shape),))

    def reshape(self, *shape):
        return Value(self.data.reshape(shape), (self,), lambda g: (g.reshape(self.data.shape),))

    def transpose(self, *axes):
        return Value(self.data.transpose(axes), (self,), lambda g: (g.transpose(np.argsort(axes)),))


def lift(x) -> Value:
    return x if isinstance(x, Value) else Value(x)


def _reduced(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over the axes its array was spread along."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


# W. J. Cody's rational approximations of erf (up to 0.46875) and of erfc (above), highest powers first
_ERF = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)


def erf(x: np.ndarray) -> np.ndarray:
    """math.erf of an array, to 1e-15."""
    ratio = lambda c, y: np.polyval(c[0], y) / np.polyval(c[1], y)
    y = np.minimum(np.abs(x), 6.0)  # erf(6) is 1; NaN stays
    out = np.copysign(1 - np.exp(-y * y) * ratio(_ERFC, y), x)
    near = y <= 0.46875
    out[near] = x[near] * ratio(_ERF, x[near] ** 2)
    return out


def gelu(x: Value) -> Value:
    cdf = 0.5 * (1 + erf(x.data / math.sqrt(2)))
    slope = cdf + x.data * np.exp(-(x.data**2) / 2) / math.sqrt(2 * math.pi)
    return Value(x.data * cdf, (x,), lambda g: (g * slope,))


def attend(q: Value, k: Value, v: Value) -> Value:
    """network.attend; the way back makes the scores again, some rows at a time."""
    out, top = N.attend(q.data, k.data, v.data)

    def back(g):
        dq, dk, dv = np.empty_like(q.data), np.zeros_like(k.data), np.zeros_like(v.data)
        less, more = np.concatenate([g, -(g * out).sum(-1, keepdims=True)], -1), np.concatenate([v.data, np.ones_like(top)], -1)
        for i, at, p, _ in N.exp_scores(q.data, k.data, top):
            dv[i] += p.T @ g[i, at]
            d = less[i, at] @ more[i].T
            d *= p
            dq[i, at] = d @ k.data[i]
            dk[i] += d.T @ q.data[i, at]
        scale = 1 / math.sqrt(q.data.shape[2])
        return dq * scale, dk * scale, dv

    return Value(out, (q, k, v), back)


def layer_norm(x: Value, eps: float = 1e-5) -> Value:
    c = x - x.mean()
    return c / ((c * c).mean() + eps) ** 0.5


def side_by_side(parts: list[Value]) -> Value:
    ends = np.cumsum([p.data.shape[-1] for p in parts])[:-1]
    return Value(np.concatenate([p.data for p in parts], -1), tuple(parts), lambda g: tuple(np.split(g, ends, -1)))


def forward(net: dict, w: dict[str, Value], inputs: dict[str, np.ndarray]) -> Value:
    """The network of network.forward on differentiable weights w, which flatten() names."""
    apply = lambda at, x: x @ w[f"{at}.w"] + w[f"{at}.b"]
    mixed = []
    for b in net["branches"]:
        p = apply(f"branches.{b}.project", lift(inputs[b]))
        mixed.append(p + apply(f"branches.{b}.down", gelu(apply(f"branches.{b}.up", layer_norm(p)))))
    x = side_by_side(mixed)
    n, dim = x.data.shape
    h = net["heads"]
    q, k, v = (apply(c, x).reshape(n, h, dim // h).transpose(1, 0, 2) for c in "qkv")
    x = x + layer_norm(apply("o", attend(q, k, v).transpose(1, 0, 2).reshape(n, dim)))
    return apply("head", x).reshape(n)


def flatten(net: dict, at: str = "") -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for k, v in net.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{at}{k}.")
        elif isinstance(v, np.ndarray):
            out[at + k] = v
    return out


def with_weights(net: dict, w: dict[str, np.ndarray], at: str = "") -> dict:
    return {k: with_weights(v, w, f"{at}{k}.") if isinstance(v, dict) else w.get(at + k, v) for k, v in net.items()}


def rank_weights(pred: np.ndarray, halflife: float = 0.5) -> np.ndarray:
    place = np.empty(len(pred))
    place[np.argsort(-pred, kind="stable")] = np.arange(len(pred))
    raw = 0.5 ** (place / max(halflife * len(pred), 1.0))
    return raw / raw.sum()


def loss(pred: Value, label: np.ndarray, halflife: float = 0.5, floor: float = 1e-8) -> Value:
    """Minus the weighted correlation over names whose prediction and label are finite; fewer than three give 0 with a
    gradient of 0. The weights are taken as given."""
    ok = np.isfinite(pred.data) & np.isfinite(label)
    if ok.sum() < 3:
        return (pred * 0.0).sum()
    w = np.zeros(len(label))
    w[ok] = rank_weights(pred.data[ok], halflife)
    y = np.where(ok, label, 0.0)
    y = y - (w * y).sum()
    c = pred - (pred * w).sum()
    var = (c * c * w).sum()
    var = var if var.data > floor else var * 0.0 + floor
    return (c * (w * y)).sum() * -1.0 / (var * max(float((w * y * y).sum()), floor)) ** 0.5


def rank_ic(pred: np.ndarray, label: np.ndarray) -> float:
    """Correlation of ordinal ranks over names with both finite, NaN for fewer than three."""
    ok = np.isfinite(pred) & np.isfinite(label)
    if ok.sum() < 3:
        return float("nan")
    place = lambda x: np.argsort(np.argsort(x, kind="stable"), kind="stable")
    return float(np.corrcoef(place(pred[ok]), place(label[ok]))[0, 1])


@dataclass(frozen=True)
class Plan:
    """Settings of a fit, by default the source's: up to 100 epochs. patience: epochs without a better validation rank IC before it stops."""

    epochs: int = 100
    patience: int = 30
    rate: float = 0.01
    decay: float = 1e-4
    hidden: int = 128
    heads: int = 4
    seed: int = 42


@dataclass
class Fit:
    """net: the weights of the best epoch. history: (epoch, loss, validation rank IC, its ICIR by the population deviation); the
    rank IC is minus infinity where no validation date has one."""

    net: dict
    history: list[tuple[int, float, float, float]]


GRID = 2.0**36  # a date's gradient is taken in steps of 1 / GRID, so that sums are exact and no placing of dates alters them


class _State:
    """A fit on its way: weights, Adam's moments, the best weights so far."""

    def __init__(self, net: dict, plan: Plan):
        self.net, self.plan, self.w, self.open = net, plan, flatten(net), True
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.best, self.best_ic, self.since, self.history = net, -math.inf, 0, []

    def step(self, epoch: int, n: int, loss: float, ics: list[float], grads: list[dict]) -> None:
        """The end of an epoch with the sums of n train dates and the rank ICs of the validation dates."""
        ok = np.sort([i for i in ics if i is not None and np.isfinite(i)])
        ic = float(ok.mean()) if len(ok) else -math.inf
        icir = float(ok.mean() / ok.std()) if len(ok) and ok.std() > 0 else 0.0
        self.history.append((epoch, loss / n if n else 0.0, ic, icir))
        if ic > self.best_ic or epoch == 1:
            self.best, self.best_ic, self.since = with_weights(self.net, self.w), ic, 0
        else:
            self.since += 1
        self.open = n > 0 and self.since < self.plan.patience and epoch < self.plan.epochs
        if not self.open:
            return
        for k in self.w:
            g = sum(part[k] for part in grads) / n + self.plan.decay * self.w[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            self.w[k] = self.w[k] - self.plan.rate * (self.m[k] / (1 - 0.9**epoch)) / (np.sqrt(self.s[k] / (1 - 0.999**epoch)) + 1e-8)


def _placed(x: DataFrame, uses: dict[int, dict]) -> DataFrame:
    """x by date, a date's names in order and in one partition. Dates are dealt to as many partitions as there are cores, the most used
    first and each to the partition with the least to do (a gradient takes three times a validation date's time)."""
    spark, cost = x.sparkSession, {}
    for parts in uses.values():
        for date, part in parts.items():
            cost[date] = cost.get(date, 0) + (3 if part == "train" else 1)
    n = max(1, min(len(cost), int(spark.sparkContext.defaultParallelism)))
    load, place = [0] * n, []
    for date in sorted(cost, key=lambda d: (-cost[d], d)):
        i = min(range(n), key=load.__getitem__)
        load[i] += cost[date]
        place.append((date, i))
    at = spark.createDataFrame(place, "date date, place int")
    return x.join(F.broadcast(at), "date").repartitionById(n, F.col("place")).drop("place").sortWithinPartitions("date", "stable_id")  # a row per date


def _dates(batches) -> Iterator[pd.DataFrame]:
    """One frame for each date of batches in order of dates."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for date, g in b.groupby("date", sort=False):
            if held and held[0]["date"].iloc[0] != date:
                yield pd.concat(held)
                held = []
            held.append(g)
    if held:
        yield pd.concat(held)


def _epoch(held: DataFrame, net: dict, weights: dict[int, dict[str, np.ndarray]], uses: dict[int, dict], columns: dict[str, str]) -> list:
    """(fit, n, loss, ics, grad) of each task and fit: number, loss and pickled gradient of its train dates, summed where they are made,
    and the rank ICs of its validation dates."""
    sent = held.sparkSession.sparkContext.broadcast((net, weights, uses))

    def run(batches):
        net, weights, uses = sent.value
        acc: dict[int, list] = {}
        for g in _dates(batches):
            label = g["label"].to_numpy(float)
            inputs = {b: np.stack(g[c]) for b, c in columns.items()}
            for key, ws in weights.items():
                part = uses[key].get(g["date"].iloc[0])
                if part is None:
                    continue
                a = acc.setdefault(key, [0, 0.0, [], None])
                w = {k: Value(v) for k, v in ws.items()}
                pred = forward(net, w, inputs)
                if part == "val":
                    a[2].append(rank_ic(pred.data, label))
                    continue
                out = loss(pred, label)
                out.backward()
                grad = {k: np.round(v.grad * GRID) / GRID if v.grad is not None else np.zeros_like(v.data) for k, v in w.items()}
                a[0], a[1], a[3] = a[0] + 1, a[1] + float(out.data), grad if a[3] is None else {k: a[3][k] + grad[k] for k in grad}
        if acc:
            yield pd.DataFrame([{"fit": k, "n": a[0], "loss": a[1], "ics": a[2], "grad": pickle.dumps(a[3])} for k, a in acc.items()])

    got = held.mapInPandas(run, "fit int, n long, loss double, ics array<double>, grad binary").toArrow().to_pylist()  # a row for each task and fit
    sent.destroy()
    return got


def fit_all(rows: DataFrame, columns: dict[str, str], uses: dict[int, dict], plan: Plan = Plan()) -> dict[int, Fit]:
    """A fit for each key of `uses`, which has the part (`train` or `val`) of each date it uses, side by side: an epoch is one job for all
    that still go on. rows(date, stable_id, label, one array column for each branch); those with a missing feature are left out. They are
    shuffled once and held for the epochs. Without train dates the seeded weights are kept."""
    x = rows.select("date", "stable_id", "label", *columns.values()).dropna(subset=list(columns.values()))
    first = x.select(*columns.values()).first()
    widths = {b: len(first[c]) for b, c in columns.items()} if first else {b: 1 for b in columns}
    net = N.factor_network(widths, plan.hidden, plan.heads, plan.seed)
    states = {k: _State(net, plan) for k in uses}
    held = _placed(x, uses).persist() if any(uses.values()) else None
    try:
        for epoch in range(1, plan.epochs + 1):
            going = {k: s for k, s in states.items() if s.open}
            if not going:
                break
            got = _epoch(held, net, {k: s.w for k, s in going.items()}, uses, columns) if held is not None else []
            for k, s in going.items():
                own = [r for r in got if r["fit"] == k]
                s.step(epoch, sum(r["n"] for r in own), sum(r["loss"] for r in own), [i for r in own for i in r["ics"]], [pickle.loads(r["grad"]) for r in own if r["n"]])
    finally:
        if held is not None:
            held.unpersist()
    return {k: Fit(s.best, s.history) for k, s in states.items()}


def fit(rows: DataFrame, columns: dict[str, str], plan: Plan = Plan()) -> Fit:
    """One fit on rows(date, stable_id, part, label, one array column for each branch); part is `train` or `val`, one for a date."""
    parts = {r["date"]: r["part"] for r in rows.select("date", "part").distinct().collect()}  # a row per date
    return fit_all(rows, columns, {0: parts}, plan)[0]


def rolling(rows: DataFrame, cal: DataFrame, years: list[int], columns: dict[str, str], plan: Plan = Plan(), lookback: int = 4, validation: int = 1) -> tuple[DataFrame, dict[int, Fit]]:
    """The stitched factor (date, stable_id, factor) of yearly refits: for each year a fit on the years before it, by
    panel.year_split, and the prediction of its own dates. A year without train dates is left out. rows are read several times: give
    them written or cached."""
    there = {r["date"] for r in rows.select("date").distinct().collect()}  # a row per date, as the splits
    uses = {}
    for year in years:
        parts = {r["date"]: r["split"] for r in P.year_split(cal, year, lookback, validation).where("split <> 'predict'").collect() if r["date"] in there}
        if "train" in parts.values():
            uses[year] = parts
    if not uses:
        raise ValueError(f"no train dates for any of {years}")
    fits = fit_all(rows, columns, uses, plan)
    parts = [N.predict(rows.where(F.year("date") == year), fits[year].net, columns) for year in fits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fits


def rolling_ridge(rows: DataFrame, cal: DataFrame, years: list[int], feature: str, width: int, ridge: float = 1.0, lookback: int = 4, validation: int = 1) -> DataFrame:
    """(date, stable_id, factor) of ridge fits refitted each year on the train and validation years before it, which the year's
    own dates are no part of. rows: date, stable_id, label and an array column."""
    out = None
    for year in years:
        x = rows.join(F.broadcast(P.year_split(cal, year, lookback, validation)), "date")
        coef = N.ridge_fit(x.where("split <> 'predict'"), feature, "label", width, ridge)
        part = N.ridge_predict(x.where("split = 'predict'"), feature, coef)
        out = part if out is None else out.unionByName(part)
    return out
