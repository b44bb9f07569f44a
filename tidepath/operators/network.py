"""Learned operators over one date's cross-section: networks in NumPy, a ridge fit. Training and yearly refits are in `training`.

A date's names are mixed by attention, so a date is one group; dates are independent. Each name attends to all names of its
date, but BLOCK scores are held at once, so memory grows with the names and only time with their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.operators.signature import gelu


BLOCK = 1 << 18  # 2 MB


def linear(rng: np.random.Generator, n_in: int, n_out: int) -> dict[str, np.ndarray]:
    return {"w": rng.normal(0, 1 / math.sqrt(n_in), (n_in, n_out)), "b": np.zeros(n_out)}


def apply(layer: dict, x: np.ndarray) -> np.ndarray:
    return x @ layer["w"] + layer["b"]


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    m, v = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - m) / np.sqrt(v + eps)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def factor_network(widths: dict[str, int], hidden: int = 16, heads: int = 2, seed: int = 0) -> dict:
    """Weights of the branch network: each branch is projected and mixed, the branches side by side attend over the
    names, and a head gives one number. The joined width must divide by the heads."""
    rng, branches = np.random.default_rng(seed), sorted(widths)
    dim = hidden * len(branches)
    if dim % heads:
        raise ValueError(f"width {dim} does not divide by {heads} heads")
    mixers = {b: {"project": linear(rng, widths[b], hidden), "up": linear(rng, hidden, hidden), "down": linear(rng, hidden, hidden)} for b in branches}
    return {"branches": mixers, "heads": heads, **{k: linear(rng, dim, dim) for k in ("q", "k", "v", "o")}, "head": linear(rng, dim, 1)}


def exp_scores(q: np.ndarray, k: np.ndarray, top: np.ndarray | None = None) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray | None]]:
    """(head, rows, exponentials, maxima) of the scaled scores of q and k (heads, names, width), some rows at a time: each row's
    exponentials over all names, less its maximum, or less `top` where it is given. The array is good until the next one."""
    rows = max(1, BLOCK // max(1, k.shape[1]))
    for i in range(len(q)):
        scaled, other = q[i] / math.sqrt(q.shape[2]), np.ascontiguousarray(k[i].T)
        if top is not None:  # taken off by the product
            scaled, other = np.hstack([scaled, -top[i]]), np.vstack([other, np.ones((1, len(k[i])))])
        for a in range(0, q.shape[1], rows):
            at, m = slice(a, a + rows), None
            e = scaled[at] @ other
            if top is None:
                m = e.max(-1, keepdims=True)
                e -= m
            yield i, at, np.exp(e, out=e), m


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """softmax(q k' / sqrt(width)) v of (heads, names, width), with the logarithms of the rows' sums of exponentials."""
    out, top = np.empty_like(v), np.empty((*v.shape[:2], 1))
    more = np.concatenate([v, np.ones_like(top)], -1)
    for i, at, e, m in exp_scores(q, k):
        x = e @ more[i]
        out[i, at], top[i, at] = x[:, :-1] / x[:, -1:], m + np.log(x[:, -1:])
    return out, top


def attention(x: np.ndarray, net: dict) -> np.ndarray:
    n, dim = x.shape
    h = net["heads"]
    q, k, v = (apply(net[c], x).reshape(n, h, dim // h).transpose(1, 0, 2) for c in "qkv")
    return apply(net["o"], attend(q, k, v)[0].transpose(1, 0, 2).reshape(n, dim))


def forward(net: dict, inputs: dict[str, np.ndarray]) -> np.ndarray:
    mixed = []
    for b, m in net["branches"].items():
        p = apply(m["project"], inputs[b])
        mixed.append(p + apply(m["down"], gelu(apply(m["up"], layer_norm(p)))))
    x = np.concatenate(mixed, axis=1)
    x = x + layer_norm(attention(x, net))
    return apply(net["head"], x)[:, 0]


def mixer_network(steps: int, channels: int, market: int = 8, width: int = 16, seed: int = 0) -> dict:
    """Weights of the time-mixing network on raw windows: channels, then two causal layers of time mixing at scales 1, 2 and 4,
    all steps projected to `width` numbers a name, then pooling of the names through a few market states."""
    rng = np.random.default_rng(seed)
    scales = [s for s in (1, 2, 4) if steps // s >= 2]
    lower = lambda n: np.tril(rng.normal(0, 1 / math.sqrt(n), (n, n)))
    time = {s: (lower(steps // s), lower(steps // s)) for s in scales}
    return {"channel": [linear(rng, channels, channels) for _ in range(2)], "time": time, "project": linear(rng, channels * sum(steps // s for s in scales), width), "to_market": linear(rng, width, market), "from_market": linear(rng, width, width), "head": linear(rng, 2 * width, 1)}


def mixer_steps(net: dict, x: np.ndarray) -> dict[int, np.ndarray]:
    """The mixed steps (names, steps // scale, channels) of each scale for x (names, steps, channels). Coarser scales are means of
    neighbouring steps, the last ones complete; both layers are lower triangular, so a step sees itself and the past only."""
    y = x + apply(net["channel"][1], gelu(apply(net["channel"][0], layer_norm(x))))
    out = {}
    for s, (first, second) in net["time"].items():
        n = y.shape[1] // s
        z = y[:, y.shape[1] - n * s :].reshape(len(y), n, s, -1).mean(2)
        mixed = gelu(np.einsum("ts,nsc->ntc", first, layer_norm(z)))
        out[s] = z + np.einsum("ts,nsc->ntc", second, mixed)
    return out


def mixer_forward(net: dict, x: np.ndarray) -> np.ndarray:
    own = apply(net["project"], np.concatenate([z.reshape(len(x), -1) for z in mixer_steps(net, x).values()], axis=1))
    state = softmax(apply(net["to_market"], own).T) @ own  # market states, each a weighted mean of the names
    back = softmax(own @ state.T / math.sqrt(own.shape[1])) @ apply(net["from_market"], state)
    return apply(net["head"], np.concatenate([own, back], axis=1))[:, 0]


def predict(rows: DataFrame, net: dict, columns: dict[str, str]) -> DataFrame:
    """(date, stable_id, factor) of rows with one feature array per branch; columns: branch to column. Names with a
    missing feature are left out."""
    x = rows.select("date", "stable_id", *columns.values()).dropna()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stable_id")
        return pd.DataFrame({"date": pdf["date"], "stable_id": pdf["stable_id"], "factor": forward(net, {b: np.stack(pdf[c]) for b, c in columns.items()})})

    return x.groupBy("date").applyInPandas(run, "date date, stable_id long, factor double")


def predict_windows(rows: DataFrame, net: dict, fields: tuple[str, ...]) -> DataFrame:
    """As predict, for the time-mixing network on windows held as one array per field."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stable_id")
        x = np.stack([np.stack(pdf[f]) for f in fields], axis=2).astype(float)
        return pd.DataFrame({"date": pdf["date"], "stable_id": pdf["stable_id"], "factor": mixer_forward(net, np.nan_to_num(x))})

    return rows.select("date", "stable_id", *fields).dropna().groupBy("date").applyInPandas(run, "date date, stable_id long, factor double")


def ridge_fit(rows: DataFrame, feature: str, label: str, width: int, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the last one the constant, by normal equations: each batch gives its sums, whose size depends on
    the width only. No rows give zeros."""
    n = width + 1

    def sums(batches):
        acc = np.zeros((n, n + 1))
        for b in batches:
            if len(b):
                x = np.hstack([np.stack(b[feature]), np.ones((len(b), 1))])
                acc += x.T @ np.hstack([x, b[label].to_numpy(float)[:, None]])
        yield pd.DataFrame({"i": range(n), "v": [list(r) for r in acc]})

    parts = rows.select(feature, label).dropna().mapInPandas(sums, "i int, v array<double>")
    total = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # width^2 numbers
    m = np.zeros((n, n + 1))
    for r in total:
        m[r["i"], r["j"]] = r["x"]
    return np.linalg.solve(m[:, :n] + ridge * np.diag([*[1.0] * width, 1e-9]), m[:, n])


def ridge_predict(rows: DataFrame, feature: str, coef: np.ndarray) -> DataFrame:
    """(date, stable_id, factor) inside the JVM."""
    w = F.array(*[F.lit(float(c)) for c in coef[:-1]])
    dot = F.aggregate(F.zip_with(feature, w, lambda a, b: a * b), F.lit(float(coef[-1])), lambda s, x: s + x)
    return rows.where(F.col(feature).isNotNull()).select("date", "stable_id", dot.alias("factor"))
