"""Missing values from a Chow-Liu dependency tree over discretised and categorical fields.

Method. Every numeric field becomes bins at quantiles, every category a code. One partial aggregation counts
the joint values of all pairs of fields; their mutual information gives the maximum spanning tree (Chow-Liu),
their counts its conditional tables. For a row with a missing target, messages from the row's known fields run
along the tree to the target. The posterior of a category is decoded to its mode, that of a numeric field to its median:
the point between bin medians at which half of the posterior lies below. (The mode's own bin median, tried first, is
further off: it jumps by whole bins where the posterior is flat.)

Scale. The count table has at most fields^2 / 2 * states^2 rows whatever the input; only it reaches the
driver. Rows without a gap never leave the JVM. References of a row (its source's neighbouring days, its
source's and group's medians) come from one row per (source, day), so repeated rows cannot pile up. What is read several
times is written once as parquet to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepath.functions.cols import finite, positive
from tidepath.sources.tables import written

BINS = 24
CATEGORIES = 4096  # a field of more distinct values is no category and is refused


@dataclass
class Tree:
    """fields: names. sizes: states of each. prior: state probabilities of each. edges: (parent, child).
    joint: joint probabilities of each edge, parent by child, smoothed."""

    fields: list[str]
    sizes: list[int]
    prior: list[np.ndarray]
    edges: list[tuple[int, int]]
    joint: dict[tuple[int, int], np.ndarray]


def pair_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(i, j, a, b, n): how many rows have state a in field i and b in field j, both known, for i <= j."""
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(fields[i]).alias("a"), F.col(fields[j]).alias("b")) for i in range(len(fields)) for j in range(i, len(fields))]
    x = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("a is not null and b is not null")
    return x.groupBy("i", "j", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def chow_liu(counts: list, fields: list[str], sizes: list[int]) -> Tree:
    """The tree of largest total mutual information. Fields without any count hang on by zero information."""
    k = len(fields)
    tab = {(i, j): np.full((sizes[i], sizes[j]), 0.05) for i in range(k) for j in range(i, k)}
    for i, j, a, b, n in counts:
        tab[i, j][a, b] += n
    prior = [np.diag(tab[i, i]) / np.diag(tab[i, i]).sum() for i in range(k)]
    info = {}
    for i in range(k):
        for j in range(i + 1, k):
            p = tab[i, j] / tab[i, j].sum()
            info[i, j] = float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
    edges, joined = [], {0}
    while len(joined) < k:
        best = max(((i, j) for i, j in info if (i in joined) != (j in joined)), key=lambda e: (info[e], e))
        edges.append(best if best[0] in joined else best[::-1])
        joined |= set(best)
    joint = {(i, j): (t := tab[min(i, j), max(i, j)] if i < j else tab[j, i].T) / t.sum() for i, j in edges}
    return Tree(fields, sizes, prior, edges, joint)


def posterior(tree: Tree, states: np.ndarray, target: int) -> np.ndarray:
    """Probabilities of the target's states for each row. states: rows x fields, -1 where unknown; the target's
    own state counts as unknown. With nothing known the posterior is the prior."""
    near: dict[int, list[int]] = {}
    for a, b in tree.edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    def given(child: int, parent: int) -> np.ndarray:
        """P(child | parent), parent by child."""
        t = tree.joint[parent, child] if (parent, child) in tree.joint else tree.joint[child, parent].T
        return t / t.sum(1, keepdims=True)

    def message(node: int, to: int) -> np.ndarray:
        """What the subtree behind `node` says about `to`, rows x states of `to`."""
        m = evidence(node)
        for other in near.get(node, []):
            if other != to:
                m = m * message(other, node)
        m = m @ given(node, to).T
        return m / np.maximum(m.sum(1, keepdims=True), 1e-300)

    def evidence(node: int) -> np.ndarray:
        s = states[:, node]
        m = np.ones((len(s), tree.sizes[node]))
        seen = s >= 0
        m[seen] = 0
        m[seen, s[seen]] = 1
        return m

    p = np.repeat(tree.prior[target][None, :], len(states), 0)
    for other in near.get(target, []):
        p = p * message(other, target)
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


def bin_of(name: str, edges: list[float]) -> str:
    """SQL of the number of inner edges at or below a column, which is its bin's code, NULL for NULL: nested halves, so that
    a value costs a handful of comparisons in generated code."""

    def half(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if({name} < {edges[mid]!r}D, {half(lo, mid)}, {half(mid + 1, hi)})"

    return f"if({name} is null, cast(null as int), {half(0, len(edges))})"


def posterior_median(p: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Where half of each posterior lies below, between the medians of its bins. Bins without a median count for nothing."""
    known = np.isfinite(centre)
    p, centre = p[:, known], centre[known]
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    middle = np.cumsum(p, 1) - p / 2  # of the mass up to each bin's median
    k = np.clip((middle < 0.5).sum(1), 1, max(len(centre) - 1, 1))
    i = np.arange(len(p))
    if len(centre) == 1:
        return np.full(len(p), centre[0])
    lo, hi = middle[i, k - 1], middle[i, k]
    part = np.clip((0.5 - lo) / np.maximum(hi - lo, 1e-12), 0, 1)
    return centre[k - 1] + part * (centre[k] - centre[k - 1])


def impute(rows: DataFrame, targets: list[str], numeric: list[str], categorical: list[str], bins: int = BINS) -> tuple[DataFrame, Tree | None]:
    """Rows with t__filled added for each target t: NULL where t is known, else the decoded estimate (NULL when
    no row knows t): a double for a numeric target, a string for a categorical one. targets must be among `numeric` and
    `categorical`; a categorical field may have up to CATEGORIES distinct values (ValueError otherwise). Columns of the same
    names must not exist yet. The rows are read several times, so they are written once to the shared folder first."""
    rows = written(rows)
    spec = [F.percentile_approx(c, [i / bins for i in range(1, bins)], F.lit(5000)).alias(c) for c in numeric]
    found = rows.agg(*spec).first()
    edges = {c: sorted(set(found[c] or [])) for c in numeric}
    names: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])).alias("x")).select("x.*").where("v is not null").groupBy("c", "v").count()
        for r in values.orderBy(F.desc("count"), "v").limit(len(categorical) * CATEGORIES + 1).collect():
            names[r["c"]].append(r["v"])
    for c in categorical:
        if len(names[c]) > CATEGORIES:
            raise ValueError(f"{c} has more than {CATEGORIES} distinct values: no category")
    fields = [f"{c}__s" for c in numeric + categorical]
    sizes = [len(edges[c]) + 1 for c in numeric] + [max(len(names[c]), 1) for c in categorical]
    coded = rows.select("*", *[F.expr(bin_of(c, edges[c])).alias(f"{c}__s") for c in numeric])
    for c in categorical:  # a table of CATEGORIES rows at most
        table = rows.sparkSession.createDataFrame(list(zip(names[c], range(len(names[c])), strict=True)), f"{c}__v string, {c}__s int")
        coded = coded.join(F.broadcast(table), F.col(c).cast("string") == F.col(f"{c}__v"), "left").drop(f"{c}__v")
    counts = [tuple(r) for r in pair_counts(coded, fields).collect()]  # bounded by fields and states
    kinds = {t: "string" if t in categorical else "double" for t in targets}
    if not counts:
        return rows.select("*", *[F.lit(None).cast(kinds[t]).alias(f"{t}__filled") for t in targets]), None
    tree = chow_liu(counts, fields, sizes)
    centre = {t: np.full(sizes[fields.index(f"{t}__s")], np.nan) for t in targets if t in numeric}
    if centre:
        known = coded.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"{t}__s").alias("s"), F.col(t).cast("double").alias("v")) for t in centre])).alias("x")).select("x.*").where("v is not null")
        for r in known.groupBy("t", "s").agg(F.percentile_approx("v", 0.5, F.lit(5000)).alias("m")).collect():  # a row per target and bin
            centre[r["t"]][r["s"]] = r["m"]
    gap = F.lit(False)
    for t in targets:
        gap = gap | F.col(t).isNull()

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = b[fields].astype("float64").fillna(-1).to_numpy().astype(int)
            for t in targets:
                k = fields.index(f"{t}__s")
                need = states[:, k] < 0
                p = posterior(tree, states[need], k)
                if t in centre:
                    got = np.full(len(b), np.nan)
                    if need.any() and np.isfinite(centre[t]).any():
                        got[need] = posterior_median(p, centre[t])
                else:
                    got = np.full(len(b), None, dtype=object)
                    if names[t]:
                        got[need] = np.array(names[t], dtype=object)[p.argmax(1)]
                b[f"{t}__filled"] = got
            yield b.drop(columns=fields)

    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"{t}__filled", T.StringType() if t in categorical else T.DoubleType()) for t in targets]])
    holes = coded.where(gap).mapInPandas(fill, schema)
    holes = holes.select(*rows.columns, *[(F.col(f"{t}__filled") if t in categorical else finite(F.col(f"{t}__filled"))).alias(f"{t}__filled") for t in targets])
    whole = rows.where(~gap).select("*", *[F.lit(None).cast(kinds[t]).alias(f"{t}__filled") for t in targets])
    return whole.unionByName(holes), tree


def _around(once: DataFrame, v: str) -> DataFrame:
    """once(sid, d, v..) with the source's last known value before and next after the day."""
    up, down = Window.partitionBy("sid").orderBy("d").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("sid").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    return once.select("*", F.last(v, True).over(up).alias("prev"), F.last(v, True).over(down).alias("next"))


FAR = 3.0  # an open beyond this factor of the row's low or high is a placeholder
FAR_LEVEL = 20.0  # the same against the source's own usual close, for rows without low and high


def usable_open(level: Column) -> Column:
    """The open, or NULL if missing, infinite, not above 0, or far outside the row's low and high."""
    o, hi, lo = positive(F.col("open")), positive(F.col("high")), positive(F.col("low"))
    far = F.when(F.coalesce(hi, lo).isNotNull(), (o > F.coalesce(hi, lo) * FAR) | (o < F.coalesce(lo, hi) / FAR)).otherwise((o > level * FAR_LEVEL) | (o < level / FAR_LEVEL))
    return F.when(~F.coalesce(far, F.lit(False)), o)


def fill_daily(daily: DataFrame, securities: DataFrame, bins: int = BINS) -> DataFrame:
    """All rows of daily with open_value, open_is_filled, close_value, close_is_filled added.

    Filled are opens that are NULL, NaN, infinite or placeholders and closes that are NULL or NaN; other wrong
    closes stay. A value nothing is known for (an empty source) stays NULL with the mark set. Rows with a null
    key are kept and filled from their own high and low. Repeated rows stay repeated. Columns that have the names of
    the added ones are replaced."""
    added = ("open_value", "open_is_filled", "close_value", "close_is_filled")
    daily = daily.drop(*added)
    ids = securities.where("stable_id is not null").groupBy("stable_id").agg(F.min("industry_code").alias("ind"))
    x = daily.select(*[F.col(c).alias(f"r_{c}") for c in daily.columns], *["stable_id", "date", "open", "high", "low", "close", "volume"])
    once = daily.where("stable_id is not null and date is not null").groupBy(F.col("stable_id").alias("sid"), F.col("date").alias("d")).agg(F.max(positive(F.col("close"))).alias("c"))
    level = once.groupBy("sid").agg(F.percentile_approx("c", 0.5, F.lit(1000)).alias("level"))
    ref = _around(once, "c").join(level, "sid").drop("c")
    x = x.join(ref, (F.col("stable_id") == F.col("sid")) & (F.col("date") == F.col("d")), "left").join(ids.withColumnRenamed("stable_id", "s2"), F.col("stable_id") == F.col("s2"), "left")
    hi, lo = positive(F.col("high")), positive(F.col("low"))
    hi, lo = F.when(hi < F.col("level") * FAR_LEVEL, hi), F.when(lo > F.col("level") / FAR_LEVEL, lo)
    base = F.coalesce(F.sqrt(hi * lo), lo, hi, F.sqrt(F.col("prev") * F.col("next")), "prev", "next", "level", positive(F.col("close")), positive(F.col("open")))
    x = x.withColumn("base", base).withColumn("o", usable_open(F.col("level")))
    c = positive(F.col("close"))
    rel = lambda a: F.log(a / F.col("base"))
    x = x.select(
        *[f"r_{k}" for k in daily.columns], "base", "o", F.col("close").alias("c_raw"), "ind", F.dayofweek("date").alias("dow"),
        rel(F.col("o")).alias("t_open"), rel(c).alias("t_close"), rel(F.col("prev")).alias("t_prev"), rel(F.col("next")).alias("t_next"), F.log(hi / lo).alias("t_range"), F.log1p(positive(F.col("volume"))).alias("t_vol"),
    )
    done, _ = impute(x, ["t_open", "t_close"], ["t_open", "t_close", "t_prev", "t_next", "t_range", "t_vol"], ["ind", "dow"], bins)
    miss = F.col("c_raw").isNull() | F.isnan("c_raw")
    return done.select(
        *[F.col(f"r_{k}").alias(k) for k in daily.columns],
        F.coalesce("o", F.col("base") * F.exp("t_open__filled")).cast("double").alias("open_value"), F.col("o").isNull().alias("open_is_filled"),
        F.when(miss, F.col("base") * F.exp("t_close__filled")).otherwise(F.col("c_raw").cast("double")).alias("close_value"), miss.alias("close_is_filled"),
    )


def fill_exposures(exposures: DataFrame, securities: DataFrame, bins: int = BINS) -> DataFrame:
    """All rows of exposures with log_mktcap_value, log_mktcap_is_filled, industry_value and industry_is_filled added.

    Filled are values that are NULL, NaN, infinite or placeholders (beyond the 5 and 95 % quantiles of all
    names by more than three times the distance between them). A source without any value is filled from its
    industry and date; with no usable value anywhere the value is NULL and the mark set. The industry is the security's code; where it has
    none, the posterior's mode. Null keys: kept, filled from what else the row has. Columns that have the names of the added ones are replaced."""
    exposures = exposures.drop("log_mktcap_value", "log_mktcap_is_filled", "industry_value", "industry_is_filled")
    v = finite(F.col("log_mktcap"))
    q = exposures.agg(F.percentile_approx(v, [0.05, 0.95], F.lit(10000)).alias("q")).first()["q"] or [0.0, 0.0]
    lo, hi = q[0] - 3 * (q[1] - q[0]) - 1, q[1] + 3 * (q[1] - q[0]) + 1
    ok = F.when((v >= lo) & (v <= hi), v)
    ids = securities.where("stable_id is not null").groupBy(F.col("stable_id").alias("s2")).agg(F.min("industry_code").alias("ind"))
    x = exposures.select(*[F.col(c).alias(f"r_{c}") for c in exposures.columns], ok.alias("y"), F.col("stable_id").alias("sid_"), F.col("date").alias("d_"))
    once = x.where("sid_ is not null and d_ is not null").groupBy(F.col("sid_").alias("sid"), F.col("d_").alias("d")).agg(F.max("y").alias("y1"))
    level = once.groupBy("sid").agg(F.percentile_approx("y1", 0.5, F.lit(1000)).alias("level")).join(ids, F.col("sid") == F.col("s2"), "left").drop("s2")
    by_ind = level.groupBy(F.col("ind").alias("ind2")).agg(F.percentile_approx("level", 0.5, F.lit(1000)).alias("ind_level"))
    level = level.join(by_ind, F.col("ind").eqNullSafe(F.col("ind2")), "left").select("sid", "ind", "level", "ind_level")
    near = _around(once, "y1").join(level, "sid")
    shift = near.groupBy("d").agg(F.percentile_approx(F.col("y1") - F.col("level"), 0.5, F.lit(1000)).alias("shift"))
    near = near.join(shift, "d").select("sid", "d", "prev", "next", "ind", F.coalesce("level", "ind_level").alias("base"), "shift")
    x = x.join(near, (F.col("sid_") == F.col("sid")) & (F.col("d_") == F.col("d")), "left")
    base = F.coalesce("base", F.lit((q[0] + q[1]) / 2))
    # close steps to the neighbours say most: relative to them where they exist
    mid = F.coalesce((F.col("prev") + F.col("next")) / 2, "prev", "next", base)
    x = x.select(*[f"r_{k}" for k in exposures.columns], "y", "ind", mid.alias("mid"), (F.col("y") - mid).alias("t_y"), (base - mid).alias("t_base"), (F.col("prev") - F.col("next")).alias("t_slope"), "shift", F.dayofweek("d_").alias("dow"), base.alias("size"))
    done, _ = impute(x, ["t_y", "ind"], ["t_y", "t_base", "t_slope", "shift", "size"], ["ind", "dow"], bins)
    return done.select(
        *[F.col(f"r_{k}").alias(k) for k in exposures.columns],
        F.coalesce("y", F.when(F.col("t_y__filled").isNotNull(), F.col("mid") + F.col("t_y__filled"))).alias("log_mktcap_value"), F.col("y").isNull().alias("log_mktcap_is_filled"),
        F.coalesce("ind", "ind__filled").alias("industry_value"), F.col("ind").isNull().alias("industry_is_filled"),
    )
