"""Mixing sources to target weights by soft membership and projected-gradient least squares.

Method. A classifier (naive Bayes on hashed words, fitted on the documents whose source is known) gives each
document without a usable source its posterior over the sources; a document with a source belongs to it. How far words
may move the posterior from the prior is set on a fifth of the labelled sample held out of the fit: where words tell
nothing of the source there, the posterior is the prior. Rates,
the expected uses of a document, are fitted by least squares on the expected token totals per source with
projected gradients: each step sums rate x tokens x membership over the corpus and projects the rates on
[0, cap]. Documents of equal membership have equal gradients throughout, so they are summed to one row per
distinct membership (rounded to 1/64) before the steps. Rates then become whole uses: the whole part for each
document, one more for a share of them chosen by hash until the share's tokens are met.

The total is the largest at which every source that has documents still reaches its share of the rest, unless
one is given; with one given, a source that cannot supply its share within max_repeats gives all it may.

Scale. One pass counts tokens and words; the class-word table has classes x FEATURES rows at most and the
membership table at most one row per distinct rounded posterior. No document-level data reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.llm import TOKENIZERS
from tidepath.llm.abuse import plain_source
from tidepath.llm.tokens import PATTERN, ranks
from tidepath.sources.tables import shared_dir, spread

FEATURES = 4096
SAMPLE = 20_000  # labelled documents per class the classifier is fitted on at most
STEPS = 60
SLICES = 4096
TRUST = (0.0, 0.03, 0.1, 0.2, 0.4, 0.7, 1.0)  # weights of the words' evidence that are tried
SALT = 32


def with_tokens(documents: DataFrame, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """documents(doc_id, source, text) to doc_id, source, tokens: the number of tokens of the whole text, 0 for NULL and
    empty ones."""
    table, words = ranks(path, name), PATTERN

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        kept = tiktoken.__dict__.setdefault("_kept_encodings", {})  # a worker serves many tasks
        if name not in kept:
            kept[name] = tiktoken.Encoding(name, pat_str=words, mergeable_ranks=table, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(kept[name].encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(count, "doc_id long, source string, tokens long")


def hashed_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 1), lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int")))


def posteriors(documents: DataFrame, classes: list[str]) -> DataFrame:
    """(doc_id, q): posterior over `classes` of documents whose source is not in the labelled table's usable names.

    documents: doc_id, name (plain source or NULL), text. Fitted on up to SAMPLE documents of each class (those of
    smallest id hash); with no labelled document every posterior is uniform."""
    k = len(classes)
    labelled = documents.where(F.col("name").isin(classes))
    # a bounded sample per class: an upper share of ids by hash, from the counts of the classes
    n = {r["name"]: r["count"] for r in labelled.groupBy("name").count().collect()}  # at most one row per class
    share = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(min(1.0, SAMPLE / max(1, n.get(c, 0)))))])
    kept = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("name")] * (1 << 20))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    words = kept.where(~held).select("name", F.explode(hashed_words(F.col("text"))).alias("w")).groupBy("name", "w").count()
    table = np.full((k, FEATURES), 0.5)
    for r in words.collect():  # at most classes x FEATURES rows
        table[classes.index(r["name"]), r["w"]] += r["count"]
    weight = np.log(table / table.sum(1, keepdims=True))
    # a class without labelled documents gets no posterior, unless none has any
    seen = np.array([float(n.get(c, 0)) for c in classes])
    with np.errstate(divide="ignore"):
        prior = np.log(seen / seen.sum()) if seen.sum() else np.zeros(k)

    def evidence(ws) -> np.ndarray:
        ws = np.asarray(ws, dtype=int)
        return weight[:, ws].sum(1) / max(1.0, np.sqrt(len(ws)))

    def given(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max())
        return p / p.sum()

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(len(TRUST))
        for b in batches:
            for name, ws in zip(b["name"], b["ws"], strict=True):
                e = evidence(ws)
                got += [np.log(max(given(prior + t * e)[classes.index(name)], 1e-12)) for t in TRUST]
        yield pd.DataFrame({"t": range(len(TRUST)), "fit": got})

    fits = kept.where(held).select("name", hashed_words(F.col("text")).alias("ws")).mapInPandas(tried, "t int, fit double").groupBy("t").agg(F.sum("fit").alias("fit"))
    by = {r["t"]: r["fit"] for r in fits.collect()}  # a row per weight
    trust = TRUST[max(by, key=lambda t: (by[t], -t))] if by else 0.0

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "q": [given(prior + trust * evidence(ws)).tolist() for ws in b["ws"]]})

    open_ = documents.where(F.col("name").isNull()).select("doc_id", hashed_words(F.col("text")).alias("ws"))
    return open_.mapInPandas(predict, "doc_id long, q array<double>")


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = TOKENIZERS, name: str = "byte_bpe_50k", steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mixture.

    uses: doc_id, source (plain), tokens, rate, copies for every document with copies > 0; copies is at most the
    source's max_repeats. shares: source, target_share, reached_share, tokens, available, max_repeats of every
    target. Sources outside the targets and documents without tokens are not used. Documents without a source
    count by their posterior. Targets with a NULL source or share are ignored, repeated targets add up. Empty
    documents give no uses and shares of NULL."""
    spark = documents.sparkSession
    shared_dir(spark)
    goal = targets.where("source is not null and target_share is not null").groupBy(plain_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    rows = goal.orderBy("source").collect()  # a row per target source
    classes, share, cap = [r["source"] for r in rows], np.array([r["share"] for r in rows]), np.array([float(r["cap"] or 1) for r in rows])
    k = len(classes)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(F.length(F.trim("source")) > 0, plain_source(F.col("source"))).alias("name"))
    sized = with_tokens(docs.select("doc_id", "text", F.col("name").alias("source")), path, name).withColumnRenamed("source", "name").where("tokens > 0 or name is null")
    onehot = F.array(*[(F.col("name") == c).cast("double") for c in classes])
    soft = posteriors(docs, classes).select(F.col("doc_id").alias("d2"), F.transform("q", lambda v: F.round(v * 64) / 64).alias("soft"))
    x = sized.join(soft, (F.col("doc_id") == F.col("d2")) & F.col("name").isNull(), "left").where(F.col("name").isin(classes) | F.col("soft").isNotNull())
    x = x.select("doc_id", "name", "tokens", F.coalesce("soft", onehot).alias("q")).checkpoint()
    limit = F.aggregate(F.zip_with("q", F.array(*[F.lit(float(c)) for c in cap]), lambda q, c: F.when(q > 0, c)), F.lit(float(cap.max()) if k else 1.0), lambda a, c: F.when(c < a, c).otherwise(a))
    groups = x.groupBy("q").agg(F.sum("tokens").alias("tokens")).withColumn("cap", limit).withColumn("r", F.lit(0.0)).checkpoint()
    most = groups.agg(*[F.sum(F.col("tokens") * F.col("cap") * F.get("q", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    able = np.array([m or 0.0 for m in most])
    live = able > 0
    want = np.where(live, share, 0)
    want = want / want.sum() if want.sum() else want
    size = total if total is not None else float(min((able[i] / want[i] for i in range(k) if want[i] > 0), default=0.0))
    goal_tokens = want * size
    rates = _projected_gradient(groups, goal_tokens, steps)
    # all documents of a source share one membership: its rate is spread over SALT keys, so no task gets a source
    salted = rates.select("q", "rate", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rated = x.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["q", "salt"]).drop("salt").where("rate > 0")
    # whole uses: one more for the documents of lowest hash, up to the share's tokens of each group
    h = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES * SLICES))
    rated = rated.withColumn("s1", F.floor(h / SLICES)).withColumn("s2", h % SLICES).withColumn("part", F.col("rate") - F.floor("rate"))
    slices = rated.groupBy("q", "s1").agg(F.sum("tokens").alias("t"), F.first("part").alias("part"))
    by = Window.partitionBy("q")
    slices = slices.select("q", "s1", "t", (F.sum("t").over(by) * F.col("part")).alias("due"), (F.sum("t").over(by.orderBy("s1")) - F.col("t")).alias("before"))
    rated = rated.join(slices.select("q", "s1", "due", "before", F.col("t").alias("slice")), ["q", "s1"])
    inner = F.coalesce(F.sum("tokens").over(Window.partitionBy("q", "s1").orderBy("s2", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = (F.col("before") + inner + F.col("tokens") / 2.0 <= F.col("due")).cast("int")
    uses = rated.select("doc_id", F.coalesce("name", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("q", F.array_max("q")).cast("int"))).alias("source"), "tokens", F.round("rate", 6).alias("rate"), (F.floor("rate").cast("int") + extra).alias("copies")).where("copies > 0")
    reached = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    there = x.where("name is not null").groupBy(F.col("name").alias("source")).agg(F.sum("tokens").alias("available"))
    shares = goal.join(reached, "source", "left").join(there, "source", "left")
    shares = shares.select("source", F.col("share").alias("target_share"), F.round(F.coalesce("used", F.lit(0)) / F.sum(F.coalesce("used", F.lit(0))).over(Window.partitionBy(F.lit(1))), 6).alias("reached_share"), F.coalesce("used", F.lit(0)).alias("tokens"), F.coalesce("available", F.lit(0)).alias("available"), F.col("cap").alias("max_repeats"))
    return uses, shares


def _projected_gradient(groups: DataFrame, goal: np.ndarray, steps: int) -> DataFrame:
    """(q, rate): least squares of expected totals. The steps walk in the dual: rates are the projection on [0, cap]
    of a running value that moves along the gradient of each group, q . (goal - reached), so a step sends the k
    totals to the groups and k sums back."""
    k = len(goal)
    sums = np.zeros(k)
    scale = np.maximum(np.array([s or 0.0 for s in groups.agg(*[F.sum(F.col("tokens") * F.get("q", F.lit(i))) for i in range(k)]).first()]), 1.0) if k else np.zeros(0)
    prices = np.zeros(k)
    for _ in range(steps):
        gap = (goal - sums) / scale
        if np.abs(gap).max(initial=0.0) < 1e-6:
            break
        prices = prices + gap
        value = sum((F.get("q", F.lit(i)) * float(prices[i]) for i in range(k)), F.lit(0.0))
        rate = F.least(F.greatest(value, F.lit(0.0)), F.col("cap"))
        got = groups.agg(*[F.sum(F.col("tokens") * rate * F.get("q", F.lit(i))) for i in range(k)]).first()
        last, sums = sums, np.array([g or 0.0 for g in got])
        if np.abs((sums - last) / scale).max(initial=0.0) < 1e-9:  # what is still short is at its cap
            break
    value = sum((F.get("q", F.lit(i)) * float(prices[i]) for i in range(k)), F.lit(0.0))
    return groups.select("q", F.least(F.greatest(value, F.lit(0.0)), F.col("cap")).alias("rate"))
