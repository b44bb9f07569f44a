"""Path signatures and log-signatures: augmentations, windows, and two engines.

`numpy` works on batches of equal-length paths to any depth and runs in Arrow batches. `sql` gives depths 1 to 3
of long-form points with window sums inside the JVM, for paths of any length. Both agree to rounding.

The tensor of level k is flat, row-major. Features are ordered stream, then window, then channel.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepath.sources.tables import spread

# --- words -------------------------------------------------------------------------------------------------


def is_lyndon(word: tuple[int, ...]) -> bool:
    """Strictly smaller than each of its proper suffixes."""
    return all(word < word[i:] for i in range(1, len(word)))


def lyndon_words(d: int, depth: int) -> list[tuple[int, ...]]:
    """By length, then in order. A Lyndon word longer than one letter is a product u v of Lyndon words u < v, so
    each length is made of the shorter ones."""
    if d < 1 or depth < 1:
        raise ValueError("letters and depth start at 1")
    by_length = {1: {(i,) for i in range(d)}}
    for n in range(2, depth + 1):
        by_length[n] = {u + v for k in range(1, n) for u in by_length[k] for v in by_length[n - k] if u < v}
    return [w for n in range(1, depth + 1) for w in sorted(by_length[n])]


def signature_words(d: int, depth: int) -> list[tuple[int, ...]]:
    return [w for k in range(1, depth + 1) for w in itertools.product(range(d), repeat=k)]


def width(d: int, depth: int, transform: str = "logsignature") -> int:
    return len(lyndon_words(d, depth)) if transform == "logsignature" else sum(d**k for k in range(1, depth + 1))


# --- augmentations: arrays (paths, streams, points, channels) -----------------------------------------------


def _time(x: np.ndarray) -> np.ndarray:
    t = np.linspace(0.0, 1.0, x.shape[2]).reshape(1, 1, -1, 1)
    return np.concatenate([np.broadcast_to(t, (*x.shape[:3], 1)), x], axis=3)


def _basepoint(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, 0), (1, 0), (0, 0)))


def _invisibility_reset(x: np.ndarray) -> np.ndarray:
    flag = np.pad(x, ((0, 0), (0, 0), (0, 0), (1, 0)), constant_values=1.0)
    gone = flag[:, :, -1:].copy()
    gone[..., 0] = 0.0
    return np.concatenate([flag, gone, np.zeros_like(gone)], axis=2)


def _lead_lag(x: np.ndarray) -> np.ndarray:
    n = x.shape[2]
    i = np.arange(2 * n - 1)
    return np.concatenate([x[:, :, (i + 1) // 2], x[:, :, i // 2]], axis=3)


def _projection(size: int, ordered: bool = False) -> Callable:
    def apply(x: np.ndarray) -> np.ndarray:
        d = x.shape[3]
        if size > d:
            raise ValueError(f"cannot project {d} channels on {size}")
        pick = itertools.permutations if ordered and size > 1 else itertools.combinations
        parts = [x[..., list(c)] for c in pick(range(d), size)]
        return np.stack(parts, axis=2).reshape(x.shape[0], -1, x.shape[2], size)  # a stream's parts stay together

    return apply


def _random_projection(streams: int, channels: int, seed: int) -> Callable:
    def apply(x: np.ndarray) -> np.ndarray:
        d = x.shape[3]
        m = np.random.default_rng(seed).normal(0.0, 1 / math.sqrt(d), (streams, d, channels))
        return np.einsum("bsld,pde->bsple", x, m).reshape(x.shape[0], -1, x.shape[2], channels)

    return apply


def _pointwise_heads(heads: int, hidden: int, channels: int, seed: int) -> Callable:
    """Point by point networks (linear, GELU, linear) with seeded weights, one stream for each."""

    def apply(x: np.ndarray) -> np.ndarray:
        rng, d, out = np.random.default_rng(seed), x.shape[3], []
        for _ in range(heads):
            a, b = rng.normal(0, 1 / math.sqrt(d), (d, hidden)), rng.normal(0, 1 / math.sqrt(hidden), (hidden, channels))
            out.append(gelu(x @ a) @ b)
        return np.stack(out, axis=2).reshape(x.shape[0], -1, x.shape[2], channels)

    return apply


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2))) if x.size else x


AUGMENTATIONS: dict[str, Callable] = {
    "identity": lambda: lambda x: x,
    "time": lambda: _time,
    "basepoint": lambda: _basepoint,
    "invisibility_reset": lambda: _invisibility_reset,
    "lead_lag": lambda: _lead_lag,
    "coordinate_projection": lambda size=2, ordered=False: _projection(size, ordered),
    "random_projection": lambda streams=4, channels=2, seed=0: _random_projection(streams, channels, seed),
    "pointwise_heads": lambda heads=2, hidden=8, channels=2, seed=0: _pointwise_heads(heads, hidden, channels, seed),
}


def register_augmentation(name: str, maker: Callable) -> None:
    """Adds a named stage: maker(**options) gives a function on arrays (paths, streams, points, channels)."""
    AUGMENTATIONS[name] = maker


def augment(x: np.ndarray, stages: list) -> np.ndarray:
    """(paths, points, channels) through named stages, each a name or (name, options), to (paths, streams, ..)."""
    y = x[:, None]
    for s in stages:
        name, options = (s, {}) if isinstance(s, str) else s
        if name not in AUGMENTATIONS:
            raise ValueError(f"unknown augmentation {name!r}; there are {sorted(AUGMENTATIONS)}")
        y = AUGMENTATIONS[name](**options)(y)
    return y


# --- windows ------------------------------------------------------------------------------------------------


def window_ranges(kind: str, length: int, size: int = 0, step: int = 0, depth: int = 3) -> list[tuple[int, int]]:
    """Half-open ranges of points. Sliding and expanding windows longer than the path are an error."""
    if kind == "global":
        return [(0, length)]
    if kind == "dyadic":
        cut = lambda i, n: round(i * length / n)  # half to even
        all_ = [(cut(i, 2**q), cut(i + 1, 2**q)) for q in range(depth) for i in range(2**q)]
        return [r for r in all_ if r[1] - r[0] >= 2]
    if kind not in ("sliding", "expanding"):
        raise ValueError(f"unknown window {kind!r}")
    if size <= 0 or step <= 0:
        raise ValueError(f"{kind} windows need a size and a step")
    if size > length:
        raise ValueError(f"a window of {size} points does not fit a path of {length}")
    if kind == "sliding":
        return [(a, a + size) for a in range(0, length - size + 1, step)]
    ends = sorted({*range(size, length + 1, step), length})
    return [(0, b) for b in ends]


# --- tensor algebra on batches ------------------------------------------------------------------------------


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


def signature_levels(path: np.ndarray, depth: int) -> list[np.ndarray]:
    """Levels 1 to depth of (paths, points, channels). One pass over the steps; each level takes a step by Horner's
    scheme, so memory is one tensor per path whatever the length."""
    if path.ndim != 3 or path.shape[1] < 2 or depth < 1:
        raise ValueError("paths are (paths, points >= 2, channels) and depth is at least 1")
    b, _, d = path.shape
    s = [np.zeros((b, d**k)) for k in range(1, depth + 1)]
    for dx in np.moveaxis(np.diff(path.astype(float), axis=1), 1, 0):
        for k in range(depth, 0, -1):
            h = dx / k
            for i in range(1, k):
                h = _outer(s[i - 1] + h, dx / (k - i))
            s[k - 1] = s[k - 1] + h
    return s


def multiply(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Product of two elements with constant term 1: the signature of two paths end to end."""
    return [a[k] + b[k] + sum((_outer(a[i], b[k - 1 - i]) for i in range(k)), np.zeros_like(a[k])) for k in range(len(a))]


def scale_channels(levels: list[np.ndarray], factor: np.ndarray) -> list[np.ndarray]:
    """The levels after each channel of the path is scaled; factor (paths, channels)."""
    out, f = [], np.ones((len(factor), 1))
    for s in levels:
        f = _outer(f, factor)
        out.append(s * f)
    return out


def log_levels(s: list[np.ndarray]) -> list[np.ndarray]:
    """Levels of the logarithm of 1 + s, by Horner's scheme on the series."""
    n = len(s)

    def times(a: list[np.ndarray]) -> list[np.ndarray]:
        return [sum((_outer(s[i], a[k - 1 - i]) for i in range(k)), np.zeros_like(s[k])) for k in range(n)]

    acc = [x / n for x in s]
    for m in range(n - 1, 0, -1):
        acc = [x / m - p for x, p in zip(s, times(acc), strict=True)]
    return acc


def flat(levels: list[np.ndarray], d: int, transform: str) -> np.ndarray:
    if transform == "signature":
        return np.concatenate(levels, axis=1)
    if transform != "logsignature":
        raise ValueError(f"unknown transform {transform!r}")
    logs = log_levels(levels)
    place = lambda w: sum(c * d ** (len(w) - 1 - i) for i, c in enumerate(w))
    return np.stack([logs[len(w) - 1][:, place(w)] for w in lyndon_words(d, len(levels))], axis=1)


def level_factorials(d: int, depth: int, transform: str) -> np.ndarray:
    words = lyndon_words(d, depth) if transform == "logsignature" else signature_words(d, depth)
    return np.array([float(math.factorial(len(w))) for w in words])


DEFAULT_STAGES = ("time", "basepoint")


def features(x: np.ndarray, depth: int = 3, stages: tuple = DEFAULT_STAGES, transform: str = "logsignature", window: str = "global", rescale: str = "post", **window_options) -> np.ndarray:
    """(paths, streams x windows x channels) of (paths, points, channels). rescale: `post` multiplies level k by k!,
    `pre` the path by depth!^(1/depth), `none` nothing. Windows are cut after the augmentation."""
    if rescale not in ("pre", "post", "none"):
        raise ValueError(f"unknown rescaling {rescale!r}")
    y = augment(x, list(stages))
    b, p, n, d = y.shape
    if rescale == "pre":
        y = y * math.factorial(depth) ** (1 / depth)
    ranges = window_ranges(window, n, **window_options)
    rows = y.reshape(b * p, n, d)
    parts = [flat(signature_levels(rows[:, i:j], depth), d, transform) for i, j in ranges]
    if rescale == "post":
        by = level_factorials(d, depth, transform)
        parts = [q * by for q in parts]
    return np.stack([q.reshape(b, p, -1) for q in parts], axis=2).reshape(b, -1)


def feature_count(channels: int, points: int, depth: int = 3, stages: tuple = DEFAULT_STAGES, transform: str = "logsignature", window: str = "global", **window_options) -> int:
    y = augment(np.zeros((1, points, channels)), list(stages))
    return y.shape[1] * len(window_ranges(window, y.shape[2], **window_options)) * width(y.shape[3], depth, transform)


def window_features(w: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ("date", "stable_id"), **options) -> DataFrame:
    """keep.. and `feature` array<double> of windows held as one equally long array per field. Windows with a missing
    value have a NULL feature. Runs batch by batch where the windows are; nothing is grouped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(keep)].copy()
            if len(b):
                x = np.stack([np.array([np.asarray(v, dtype=float) for v in b[f]]) for f in fields], axis=2)
                ok = np.isfinite(x).all(axis=(1, 2))
                got: list = [None] * len(b)
                if ok.any():
                    for i, v in zip(np.flatnonzero(ok), features(x[ok], **options), strict=True):
                        got[i] = v
                out["feature"] = got
            else:
                out["feature"] = []
            yield out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in w.schema.fields if f.name in keep)
    order = [f.name for f in w.schema.fields if f.name in keep]
    return spread(w.select(*order, *fields)).mapInPandas(lambda it: (x[[*order, "feature"]] for x in run(it)), f"{kinds}, feature array<double>")


# --- inside the JVM, depths 1 to 3 ----------------------------------------------------------------------------


def sql_signature(points: DataFrame, key: str, order: str, channels: list[str], depth: int = 2) -> DataFrame:
    """(key, s_<word>..) of long-form points, words as channel numbers, by window sums: level 2 adds
    A_i D_j + D_i D_j / 2 for each step D from a point whose distance from the start is A; level 3 adds
    P_ij D_l + A_i D_j D_l / 2 + D_i D_j D_l / 6 with P the level 2 so far. One row per key and order, no NULLs; a
    key with one point has zeros."""
    if depth not in (1, 2, 3):
        raise ValueError("inside the JVM depths go from 1 to 3")
    k = range(len(channels))
    by = f"over (partition by {key} order by {order})"
    x = points.selectExpr(key, order, *[f"{c} as x{i}" for i, c in enumerate(channels)])
    x = x.selectExpr(key, order, *[f"coalesce(x{i} - lag(x{i}) {by}, 0D) as d{i}" for i in k], *[f"coalesce(lag(x{i}) {by}, x{i}) - first(x{i}) {by} as a{i}" for i in k])
    sums = [f"sum(d{i}) as s_{i}" for i in k]
    two = {(i, j): f"a{i} * d{j} + d{i} * d{j} / 2" for i in k for j in k}
    if depth >= 2:
        sums += [f"sum({e}) as s_{i}{j}" for (i, j), e in two.items()]
    if depth == 3:
        x = x.selectExpr("*", *[f"coalesce(sum({e}) over (partition by {key} order by {order} rows between unbounded preceding and 1 preceding), 0D) as p{i}{j}" for (i, j), e in two.items()])
        sums += [f"sum(p{i}{j} * d{m} + a{i} * d{j} * d{m} / 2 + d{i} * d{j} * d{m} / 6) as s_{i}{j}{m}" for i in k for j in k for m in k]
    return x.groupBy(key).agg(*[F.expr(s) for s in sums])


def sql_logsignature(sig: DataFrame, key: str, d: int, depth: int = 2) -> DataFrame:
    """(key, l_<word>..) at the Lyndon words, from sql_signature: log2 = S2 - S1 S1 / 2 and
    log3 = S3 - (S1 S2 + S2 S1) / 2 + S1 S1 S1 / 3."""
    out = [key]
    for w in lyndon_words(d, depth):
        s = "".join(map(str, w))
        if len(w) == 1:
            e = f"s_{s}"
        elif len(w) == 2:
            e = f"s_{s} - s_{w[0]} * s_{w[1]} / 2"
        else:
            i, j, m = w
            e = f"s_{s} - (s_{i} * s_{j}{m} + s_{i}{j} * s_{m}) / 2 + s_{i} * s_{j} * s_{m} / 3"
        out.append(f"{e} as l_{s}")
    return sig.selectExpr(*out)
