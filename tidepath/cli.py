"""python -m tidepath.cli build|build-minute|train|evaluate|info|project: features of a data folder, yearly refits, scores of a factor file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidepath import config as C
from tidepath.operators import factor as X
from tidepath.operators import minute as M
from tidepath.operators import panel as P
from tidepath.operators import research as R
from tidepath.operators import signature as S
from tidepath.operators import training as T
from tidepath.operators.regrid import bar_of, bar_starts
from tidepath.sources import files, periods, store
from tidepath.sources.tables import read, written


def build(spark: SparkSession, root: str, to: str, c: C.Config, overwrite: bool = False, kind: str = "features") -> None:
    """Daily-branch features (or normalised windows) of a data folder into a store; dates already there are skipped."""
    p = P.panel(read(spark, root, "daily", ("date", "stable_id", *P.FIELDS)))
    cal = P.calendar(p)
    d = P.dense(p, cal)
    keep = P.coverage(d, c.data.daily_days, c.data.min_valid_fraction).where("valid").select("date", "stable_id")
    keep = keep.join(P.universe(d, c.data.universe_size, c.data.universe_lookback).select("date", "stable_id"), ["date", "stable_id"])
    if not overwrite:
        keep = keep.join(store.built_dates(spark, to, kind, "daily"), "date", "left_anti")
    w = P.normalised(P.filled(P.windows(d, c.data.daily_days).join(keep, ["date", "stable_id"], "left_semi")), c.data.price_zscore)
    stages = tuple(tuple(s) if isinstance(s, list) else s for s in c.signature.stages)
    out = w if kind == "windows" else S.window_features(w, P.FIELDS, depth=c.signature.depth, stages=stages, transform=c.signature.transform, window=c.signature.window, rescale=c.signature.rescale)
    store.write_features(out, to, kind, "daily", overwrite, None if kind == "windows" else "feature")
    width = 5 * c.data.daily_days if kind == "windows" else S.feature_count(5, c.data.daily_days, c.signature.depth, stages, c.signature.transform, c.signature.window)
    there = store.read_manifest(spark, to).get(kind, {}) if files.exists(spark, f"{to}/manifest.json") else {}
    store.write_manifest(spark, to, **{kind: there | {"daily": width}, "days": c.data.daily_days})


def build_minute(spark: SparkSession, root: str, to: str, c: C.Config, overwrite: bool = False) -> None:
    """Minute-branch features of a data folder into a store; dates already there are skipped when written."""
    bars = P.bars(read(spark, root, "intraday", ("date", "time", "stable_id", *P.FIELDS)), bar_of(F.col("time")))
    out = M.minute_features(bars, P.calendar(bars), bar_starts(), c.data.minute_days, c.signature.depth)
    store.write_features(out, to, "features", "minute", overwrite, "feature")
    store.write_manifest(spark, to, features=store.read_manifest(spark, to).get("features", {}) | {"minute": S.width(M.CHANNELS, c.signature.depth)})


def train(spark: SparkSession, root: str, features: str, to: str, c: C.Config, years: list[int]) -> None:
    """Yearly refits on a store's branches, names and dates that all of them hold, and the stitched factor."""
    p = P.panel(read(spark, root, "daily", ("date", "stable_id", *P.FIELDS)))
    cal = P.calendar(p)
    rows = X.labels(p, cal, c.labels.horizon, clip=c.labels.clip)
    branches = sorted(store.read_manifest(spark, features)["features"])
    stored = None
    for b in branches:
        x = spark.read.parquet(f"{features}/features").where(F.col("branch") == b).select("date", "stable_id", F.col("feature").cast("array<double>").alias(b))
        stored = x if stored is None else stored.join(x, ["date", "stable_id"])
    rows = written(stored.join(rows, ["date", "stable_id"], "left").select("date", "stable_id", "label", *branches))
    t = c.training
    plan = T.Plan(epochs=t.epochs, patience=t.patience, rate=t.rate, hidden=t.hidden, heads=t.heads, seed=t.seed)
    factor, fits = T.rolling(rows, cal, years, {b: b for b in branches}, plan, t.lookback_years, t.validation_years)
    store.write_factor(factor, to)
    for year, f in fits.items():
        files.write_text(spark, f"{to}-log/{year}.csv", "epoch,loss,rank_ic,icir\n" + "".join(f"{e},{a:.6f},{ic:.6f},{r:.6f}\n" for e, a, ic, r in f.history))


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="tidepath")
    sub = a.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("data"), b.add_argument("store"), b.add_argument("--config"), b.add_argument("--set", action="append", default=[]), b.add_argument("--overwrite", action="store_true"), b.add_argument("--kind", default="features", choices=("features", "windows"))
    e = sub.add_parser("evaluate")
    e.add_argument("data"), e.add_argument("factor"), e.add_argument("--horizon", type=int, default=20), e.add_argument("--groups", type=int, default=5), e.add_argument("--rebalance", default="monthly", choices=("monthly", "daily")), e.add_argument("--against-label"), e.add_argument("--neutralise", action="store_true"), e.add_argument("--winsorise", type=float, default=3.0)
    m = sub.add_parser("build-minute")
    m.add_argument("data"), m.add_argument("store"), m.add_argument("--config"), m.add_argument("--set", action="append", default=[]), m.add_argument("--overwrite", action="store_true")
    t = sub.add_parser("train")
    t.add_argument("data"), t.add_argument("store"), t.add_argument("factor"), t.add_argument("--years", type=int, nargs="+", required=True), t.add_argument("--config"), t.add_argument("--set", action="append", default=[])
    i = sub.add_parser("info")
    i.add_argument("store")
    j = sub.add_parser("project")
    j.add_argument("--step", type=float, required=True), j.add_argument("--stride", type=int, default=1), j.add_argument("--epochs", type=int, default=8), j.add_argument("--fits", type=int, default=5)
    o = a.parse_args(args)
    if o.what == "project":
        return print(f"{(700 + 233 * 0.35) / o.stride * o.step * o.epochs * o.fits / 3600:.2f} hours")
    spark = SparkSession.builder.getOrCreate()
    if o.what == "info":
        return print(store.read_manifest(spark, o.store))
    if o.what == "build-minute":
        return build_minute(spark, o.data, o.store, C.load(o.config, tuple(o.set)), o.overwrite)
    if o.what == "train":
        return train(spark, o.data, o.store, o.factor, C.load(o.config, tuple(o.set)), o.years)
    if o.what == "build":
        return build(spark, o.data, o.store, C.load(o.config, tuple(o.set)), o.overwrite, o.kind)
    p = P.panel(read(spark, o.data, "daily", ("date", "stable_id", *P.FIELDS)))
    cal = P.calendar(p)
    dates = P.month_ends(cal).where("is_month_end") if o.rebalance == "monthly" else None
    options: dict = {}
    if o.against_label:  # a keyed table with one forward column
        t = spark.read.parquet(o.against_label)
        options["label"] = t.select("date", "stable_id", F.col(periods.regressors(t)[0]).cast("double").alias("ret"))
    if o.neutralise:
        t = read(spark, o.data, "exposures")
        size, *dummies = periods.regressors(t)
        options |= {"exposures": t.dropDuplicates(["date", "stable_id"]), "regressor": size, "dummies": dummies, "sigma": o.winsorise}
    got = R.evaluate(spark.read.parquet(o.factor).select("date", "stable_id", "factor"), P.forward_return(p, cal, o.horizon), dates, o.horizon, o.groups, **options)
    print(R.report(got))


if __name__ == "__main__":
    main()
