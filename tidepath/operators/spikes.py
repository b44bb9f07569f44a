"""Implausible readings: tail cutoffs by peaks over threshold, stuck runs and plausibility rules.

Method. A reading's residual is its distance from the nearer of its source's levels before and after it (medians of
five readings each) where it lies outside both, else 0; it is taken in usual steps (the source's median absolute log
step) and freed of the season (weekday of a daily table, hour of an intraday one): of the usual size of steps in that
season, where it is larger than in others, and, for volumes, of the season's level. Residuals over a threshold are the peaks. Their excesses over it give a
generalised Pareto tail: the shape is fitted to the peaks of all sources together after suspected readings (beyond ten
median excesses) are set aside, the scale and the rate of peaks to each source's own, drawn towards the whole by a weight
of PRIOR peaks. A source's cutoff is where its tail has the fixed risk; there is no band around it. A reading beyond the
cutoff in an excursion of at most three readings is a spike. Stuck and plausibility rules stand beside it.

The shape is not let below 0: a negative one means an end no reading could pass, which peaks this near to the usual
course cannot tell. It is drawn towards 0 by SHAPE_PRIOR peaks.

Scale. A source may hold a third of all rows, so long series are cut in blocks (one date of an intraday
source). Each block gets the last and first five readings of its neighbours from a small block table; no
window spans a whole intraday source. Peaks, a few percent of the readings, are written to the shared folder once and read from there by
the fit and by the verdict; two rows of statistics reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.functions.cols import day, present
from tidepath.sources.tables import written

SIDE = 5  # readings of a level on either side
SPAN = 3  # readings in an excursion at most
PRIOR = 100.0  # peaks of the whole that count beside a source's own
SHAPE_PRIOR = 1000.0
FIRST = 30.0


@dataclass(frozen=True)
class Tail:
    """risk: chance that a reading of the usual course passes the cutoff. threshold: residuals above it are peaks, in
    usual steps (in_steps) or in log units. scale: mean excess that is expected before any peak is seen; it counts as
    FIRST peaks and matters to small tables only. level_season: whether levels have a season, too."""

    risk: float = 1e-7
    threshold: float = 2.0
    scale: float = 1.0
    in_steps: bool = True
    level_season: bool = False


CLOSE = Tail()
VOLUME = Tail(threshold=0.4, scale=0.16, in_steps=False, level_season=True)


def fit_tails(peaks: DataFrame, tail: Tail) -> DataFrame:
    """(sid, cutoff) of peaks(sid, z, size): z above the threshold, and the source's number of readings. Every source with
    peaks has a row; others have no reading that could pass a cutoff."""
    excess = F.col("z") - tail.threshold
    half = peaks.agg(F.percentile_approx(excess, 0.5, F.lit(10_000)).alias("m")).first()["m"]
    own = peaks.withColumn("x", excess).withColumn("x", F.when(F.col("x") <= 10 * min(half or 0.0, 2 * tail.scale), F.col("x")))
    q = F.percentile_approx("x", [0.5, 0.75], F.lit(10_000))
    whole = own.agg(F.count("x").alias("m"), F.avg("x").alias("mean"), q.alias("q")).first()
    own = own.groupBy("sid").agg(F.max("size").alias("n"), F.count("x").alias("m"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("s"))
    readings = own.agg(F.sum("n").alias("n")).first()["n"] or 1
    m, (mid, three) = whole["m"], whole["q"] or (tail.scale * math.log(2), tail.scale * math.log(4))
    blend = lambda v, first: (m * v + FIRST * first) / (m + FIRST)
    mean = blend(whole["mean"] or 0.0, tail.scale)
    shape = max(0.0, math.log2(max(three / mid - 1, 1.0)) * m / (m + SHAPE_PRIOR))
    scale = blend(mid, tail.scale * math.log(2)) * (shape / (2**shape - 1) if shape > 1e-6 else 1 / math.log(2))
    x = own.withColumn("scale", (F.col("s") + PRIOR * mean) / ((F.col("m") + PRIOR) * mean) * scale)
    x = x.withColumn("far", (F.col("m") + PRIOR) / (F.col("n") + PRIOR * readings / max(m, 1)) / tail.risk)
    reach = (F.pow("far", F.lit(shape)) - 1) / shape if shape > 1e-6 else F.log("far")
    return x.select("sid", (tail.threshold + F.col("scale") * reach).alias("cutoff"))


def seasons(own: DataFrame, tail: Tail) -> DataFrame:
    """(season, size, level) of own(sid, season, q, n, mean): how much larger steps are in a season than usual, and how
    much higher readings lie, over all sources. One row per season."""
    by = Window.partitionBy("sid")
    share = lambda c: F.sum(F.col(c) * F.col("n")).over(by) / F.sum("n").over(by)
    x = own.select("season", F.col("q"), share("q").alias("mid"), (F.col("mean") - share("mean")).alias("off"))
    size = F.avg(F.when(F.col("mid") > 0, F.col("q") / F.col("mid"))) if tail.in_steps else F.lit(1.0)
    level = F.avg("off") if tail.level_season else F.lit(0.0)
    return x.groupBy("season").agg(size.alias("size"), level.alias("level")).select("season", F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(1.0)).alias("size"), F.coalesce("level", F.lit(0.0)).alias("level"))


def median_sql(v: list[str]) -> str:
    """SQL of the median of five columns: a short network where none is NULL, else of those that are not, NULL if all are."""
    a, b, c, d, e = v
    low, high = f"greatest(least({a}, {b}), least({c}, {d}))", f"least(greatest({a}, {b}), greatest({c}, {d}))"
    five = f"greatest(least({e}, {low}), least(greatest({e}, {low}), {high}))"
    some = f"get(transform(array(array_sort(filter(array({', '.join(v)}), x -> x is not null))), v -> if(size(v) > 0, (get(v, cast((size(v) - 1) div 2 as int)) + get(v, cast(size(v) div 2 as int))) / 2, null)), 0)"
    return f"if({' and '.join(f'{x} is not null' for x in v)}, {five}, {some})"


def peaks(readings: DataFrame, tail: Tail) -> DataFrame:
    """(sid, block, ord, z, run, size): readings whose residual z, in usual steps or log units, passes the threshold; run is
    the length of their excursion, size the source's number of readings.

    readings: sid, block, ord, season, lx (the log of a possible reading, no NULLs), one row per
    (sid, block, ord); blocks of a source follow each other in order. Empty input gives no rows; readings at either
    end of a source have no level on one side and are no peaks; a source that never has two readings in a block has no usual step and no peaks."""
    within = "over (partition by sid, block order by ord)"
    steps = readings.selectExpr("sid", "season", "lx", f"abs(lx - lag(lx) {within}) as step")
    own = steps.groupBy("sid", "season").agg(F.percentile_approx("step", 0.5, F.lit(2000)).alias("q"), F.count("step").alias("n"), F.avg("lx").alias("mean"))
    sizes = own.groupBy("sid").agg(F.sum("n").alias("n"), F.greatest(F.sum(F.col("q") * F.col("n")) / F.sum("n"), F.lit(1e-6)).alias("usual"))
    # a row per season: a table of a few rows at any size
    timed = readings.join(F.broadcast(seasons(own.where("n > 0"), tail)), "season", "left")
    placed = timed.selectExpr("sid", "block", "ord", "lx - coalesce(level, 0D) as lx", "coalesce(size, 1D) as size", f"row_number() {within} as rn", "count(1) over (partition by sid, block) as many").selectExpr("*", "many - rn + 1 as left")
    # a block's first and last readings, and those of the blocks around it
    ends = (
        placed.where(f"rn <= {SIDE} or left <= {SIDE}")
        .groupBy("sid", "block")
        .agg(*[F.expr(f"array_sort(collect_list(if({n} <= {SIDE}, struct(ord, lx), null)))").alias(side) for n, side in (("rn", "head"), ("left", "tail"))])
        .selectExpr("sid", "block", "head.lx as head", "tail.lx as tail")
    )
    along = "over (partition by sid order by block)"
    # every block has a reading, so five blocks on either side hold the five nearest
    near = lambda f, c, ks: "concat(" + ", ".join(f"coalesce({f}({c}, {k}) {along}, cast(array() as array<double>))" for k in ks) + ")"
    edge = ends.selectExpr("sid", "block", f"{near('lag', 'tail', range(SIDE, 0, -1))} as before", f"{near('lead', 'head', range(1, SIDE + 1))} as after")
    edge = edge.join(sizes, "sid", "left")
    ks = range(1, SIDE + 1)
    back = [f"coalesce(lag(lx, {k}) {within}, if(rn <= {k}, get(before, size(before) + rn - {k + 1}), null)) as b{k}" for k in ks]
    ahead = [f"coalesce(lead(lx, {k}) {within}, if(left <= {k}, get(after, cast({k} - left as int)), null)) as a{k}" for k in ks]
    unit = "usual * greatest(size, 1D)" if tail.in_steps else "1D"
    x = placed.join(edge.where("usual is not null"), ["sid", "block"]).selectExpr("sid", "block", "ord", "lx", "n as readings", f"{unit} as unit", *back, *ahead)

    def apart(s: str) -> str:
        """Whether half of the readings of a side are far enough for their median to be; cheap, and needed for a peak."""
        far = " + ".join(f"if(abs(lx - {s}{k}) > {tail.threshold}D * unit, 1, 0)" for k in ks)
        return f"2 * ({far}) >= {' + '.join(f'if({s}{k} is null, 0, 1)' for k in ks)}"

    x = x.where(f"{apart('b')} and {apart('a')}").selectExpr("*", *[f"{median_sql([f'{s}{k}' for k in ks])} as m{s}" for s in "ba"])
    x = x.where("(lx > mb and lx > ma) or (lx < mb and lx < ma)").selectExpr("*", "least(abs(lx - mb), abs(lx - ma)) as dev", "if(lx > mb, 1, -1) as side", "(mb + ma) / 2 as mid")

    def run(s: str) -> str:
        """Readings next to this one, up to SPAN, that lie out on its side."""
        n = "0"
        for k in range(SPAN, 0, -1):
            n = f"if(coalesce(side * ({s}{k} - mid) >= dev / 2, false), 1 + {n}, 0)"
        return n

    return x.where(f"dev > {tail.threshold}D * unit").selectExpr("sid", "block", "ord", "dev / unit as z", f"1 + {run('b')} + {run('a')} as run", "readings as size")


def beyond(high: DataFrame, tail: Tail) -> DataFrame:
    """The peaks that are spikes: (sid, block, ord, z, cutoff). high: peaks, best written already, as it is read several times."""
    found = high.where(F.col("run") <= SPAN).join(fit_tails(high, tail), "sid")
    return found.where("z >= cutoff").select("sid", "block", "ord", "z", "cutoff")


def stuck(readings: DataFrame, least: int) -> DataFrame:
    """Readings that repeat the one before them with activity, in a row of at least `least` equal readings.

    readings: sid, block, ord, x (no NULLs), active (boolean). A row counts the first reading and those
    repeats that have activity: quotes that stand still without activity are genuine. Returns (sid, block,
    ord)."""
    at = Window.partitionBy("sid", "block").orderBy("ord")
    new = F.coalesce((F.col("x") != F.lag("x").over(at)).cast("int"), F.lit(1))
    x = readings.withColumn("new", new).withColumn("run", F.sum("new").over(at))
    again = (F.col("new") == 0) & F.coalesce(F.col("active"), F.lit(False))
    n = F.sum(again.cast("int")).over(Window.partitionBy("sid", "block", "run"))
    return x.withColumn("again", again).withColumn("n", n).where(F.col("again") & (F.col("n") >= least - 1)).select("sid", "block", "ord")


def flag_daily(daily: DataFrame, close: Tail = CLOSE, volume: Tail = VOLUME, least: int = 6) -> DataFrame:
    """(table_name, field, stable_id, date, time, rule) of wrong closes and volumes of a daily table.

    Rows with a null key are left out; repeated rows of a key count once. Missing values (NULL, NaN) are no
    cases. Rules: `impossible`, `spike`, `stuck`; a reading may have several."""
    keyed = daily.select("stable_id", "date", present(F.col("close")).alias("close"), present(F.col("volume")).alias("volume")).where("stable_id is not null and date is not null")
    # one row per day and source: bounded by the calendar however often keys repeat
    once = keyed.groupBy("stable_id", "date").agg(F.max("close").alias("close"), F.max("volume").alias("volume"))
    base = once.select(F.col("stable_id").alias("sid"), F.lit(0).alias("block"), F.col("date").alias("ord"), F.dayofweek("date").alias("season"), "close", "volume")
    fin = lambda c: F.col(c) < F.lit(float("inf"))
    parts, high = [], []
    for field, tail, bad in (("close", close, ~fin("close") | (F.col("close") <= 0)), ("volume", volume, F.col("volume") < 0)):
        parts.append(base.where(bad).select(F.lit(field).alias("field"), "sid", "ord", F.lit("impossible").alias("rule")))
        good = base.where(fin(field) & (F.col(field) > 0)).withColumn("lx", F.log(field))
        high.append(peaks(good.select("sid", "block", "ord", "season", "lx"), tail).withColumn("field", F.lit(field)))
        still = base.where(F.col(field).isNotNull()).select("sid", "block", "ord", F.col(field).alias("x"), (F.col("volume") > 0).alias("active"))
        parts.append(stuck(still, least).select(F.lit(field).alias("field"), "sid", "ord", F.lit("stuck").alias("rule")))
    both = written(high[0].unionByName(high[1]))
    for field, tail in (("close", close), ("volume", volume)):
        parts.append(beyond(both.where(F.col("field") == field), tail).select(F.lit(field).alias("field"), "sid", "ord", F.lit("spike").alias("rule")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit("daily").alias("table_name"), "field", F.col("sid").alias("stable_id"), day(F.col("ord")).alias("date"), F.lit(-1).cast("long").alias("time"), "rule")


def flag_intraday(intraday: DataFrame, close: Tail = CLOSE, least: int = 12) -> DataFrame:
    """As flag_daily for the closes of an intraday table, keyed (stable_id, date, time); a block is one date.
    Rows with a null time are left out."""
    keyed = intraday.select("stable_id", "date", "time", present(F.col("close")).alias("close"), present(F.col("volume")).alias("volume")).where("stable_id is not null and date is not null and time is not null and close is not null")
    spread = keyed.repartition("stable_id", "date")
    once = spread.groupBy("stable_id", "date", "time").agg(F.max("close").alias("close"), F.max("volume").alias("volume"))
    base = once.select(F.col("stable_id").alias("sid"), F.col("date").alias("block"), F.col("time").alias("ord"), F.floor(F.col("time") / 3_600_000_000).cast("int").alias("season"), "close", "volume")
    fin = F.col("close") < F.lit(float("inf"))
    bad = base.where(~fin | (F.col("close") <= 0)).select("sid", "block", "ord", F.lit("impossible").alias("rule"))
    good = base.where(fin & (F.col("close") > 0)).select("sid", "block", "ord", "season", F.log("close").alias("lx"))
    high = beyond(written(peaks(good, close)), close).select("sid", "block", "ord", F.lit("spike").alias("rule"))
    still = stuck(base.select("sid", "block", "ord", F.col("close").alias("x"), (F.col("volume") > 0).alias("active")), least).select("sid", "block", "ord", F.lit("stuck").alias("rule"))
    out = bad.unionByName(high).unionByName(still)
    return out.select(F.lit("intraday").alias("table_name"), F.lit("close").alias("field"), F.col("sid").alias("stable_id"), day(F.col("block")).alias("date"), F.col("ord").cast("long").alias("time"), "rule")
