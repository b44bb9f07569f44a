"""References to records that do not exist, kept as pending state that is advanced by increments.

Method. The state is one row per reference (table, field, key, date, row_id) with the status `open` (an orphan
waiting) or `held` (a parent holds it), next to the parent index, one row per key with the days it covers.
`advance` takes what is new: new references probe the parent index; arriving parents resolve waiting
references of their keys; deletions reopen references they no longer cover. Only keys that the increment
touches are judged again. `snapshot` counts the open ones per table, field and month.

`row_id` tells apart the rows that name the same key on the same date: it is empty where key and date are the
row's own key, and the row's stable_id where the key is a day, so a stray day counts once per row that names it.

Scale. References are made unique before they move, so repeated rows are shuffled once. The index is joined by
key; no side is broadcast by hand.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.sources import files

REFS = "table_name string, field string, key string, date date, row_id string, status string"
KNOWN = ["table_name", "field", "key", "date", "row_id"]
PARENTS = "field string, key string, since date, until date, known boolean"
BUCKETS = 64  # parts of a saved state, by hash of the key


@dataclass
class OrphanState:
    """refs: REFS, unique by KNOWN; a NULL date is a row without one, row_id is never NULL. parents: PARENTS, unique by (field, key); a NULL
    `since` or `until` means no limit. `until` is the first day the parent is gone. A row not `known` is a deletion that came
    before its parent and waits for it."""

    refs: DataFrame
    parents: DataFrame


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS))


def references(rows: DataFrame, table: str, field: str, key: str, date: str, row_id: str | None = None) -> DataFrame:
    """Distinct references of a table: a null key refers to nothing and is left out. A reference without a date
    stays: its key may be unknown all the same."""
    own = F.lit("") if row_id is None else F.coalesce(F.col(row_id).cast("string"), F.lit(""))
    return rows.select(F.lit(table).alias("table_name"), F.lit(field).alias("field"), F.col(key).cast("string").alias("key"), F.col(date).cast("date").alias("date"), own.alias("row_id")).where("key is not null").distinct()


def _judge(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References with the status the parent index gives them now. Without a date only the key is looked for."""
    p = parents.where("known").select(F.col("field").alias("p_field"), F.col("key").alias("p_key"), "since", "until")
    x = refs.join(p, (F.col("field") == F.col("p_field")) & (F.col("key") == F.col("p_key")), "left")
    covered = F.col("p_key").isNotNull() & (F.col("date").isNull() | (F.col("since").isNull() | (F.col("date") >= F.col("since"))) & (F.col("until").isNull() | (F.col("date") < F.col("until"))))
    return x.select(*KNOWN, F.when(covered, "held").otherwise("open").alias("status"))


def advance(state: OrphanState, new_refs: DataFrame | None = None, new_parents: DataFrame | None = None, deletions: DataFrame | None = None) -> OrphanState:
    """The state after an increment. new_refs: as from references(), row_id may be missing. new_parents: PARENTS, which add keys or
    replace those of the index. deletions: field, key, until. Several rows of a key in one increment: the
    earliest `since` and the latest `until` of parents, the earliest `until` of deletions. A deletion that comes before its
    parent is kept and ends the parent when it arrives. References seen before change nothing."""
    parents, refs, touched = state.parents, state.refs, None
    if new_parents is not None:
        lo, hi = F.min(F.coalesce("since", F.lit("0001-01-01").cast("date"))), F.max(F.coalesce("until", F.lit("9999-12-31").cast("date")))
        add = new_parents.where("key is not null").groupBy("field", "key").agg(lo.alias("lo"), hi.alias("hi"))
        add = add.select("field", F.col("key").cast("string").alias("key"), F.when(F.col("lo") > "0001-01-01", F.col("lo")).alias("since"), F.when(F.col("hi") < "9999-12-31", F.col("hi")).alias("until"))
        early = parents.where("not known").select("field", "key", F.col("until").alias("gone"))
        arrived = add.join(early, ["field", "key"], "left").select("field", "key", "since", F.least("until", "gone").alias("until"), F.lit(True).alias("known"))
        parents = parents.join(add.select("field", "key"), ["field", "key"], "left_anti").unionByName(arrived)
        touched = add.select("field", "key")
    if deletions is not None:
        gone = deletions.where("key is not null and until is not null").groupBy("field", F.col("key").cast("string").alias("key")).agg(F.min("until").alias("gone"))
        parents = parents.join(gone, ["field", "key"], "full").select("field", "key", "since", F.least("until", "gone").alias("until"), F.coalesce("known", F.lit(False)).alias("known"))
        touched = gone.select("field", "key") if touched is None else touched.unionByName(gone.select("field", "key")).distinct()
    if touched is not None:
        again = refs.join(touched, ["field", "key"], "left_semi")
        rest = refs.join(touched, ["field", "key"], "left_anti")
        refs = rest.unionByName(_judge(again.drop("status"), parents))
    if new_refs is not None:
        own = F.coalesce("row_id", F.lit("")) if "row_id" in new_refs.columns else F.lit("")
        fresh = new_refs.withColumn("row_id", own).select(*KNOWN).where("key is not null").distinct().alias("n")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in KNOWN]
        fresh = fresh.join(refs.select(*KNOWN).alias("o"), same, "left_anti")
        refs = refs.unionByName(_judge(fresh, parents))
    return OrphanState(refs, parents)


def pending(state: OrphanState) -> DataFrame:
    return state.refs.where("status = 'open'").drop("status")


def snapshot(state: OrphanState) -> DataFrame:
    """(table_name, field, month, orphans, held) of the state, in rows; the month is `(none)` where there is no date."""
    by = state.refs.groupBy("table_name", "field", F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("(none)")).alias("month"))
    return by.agg(F.count(F.when(F.col("status") == "open", 1)).alias("orphans"), F.count(F.when(F.col("status") == "held", 1)).alias("held"))


def bucket() -> Column:
    """The part of a saved state that a key belongs to."""
    return F.pmod(F.xxhash64("field", "key"), F.lit(BUCKETS)).cast("int")


def _index(spark: SparkSession, folder: str, version: int) -> dict[str, int]:
    """Which version holds each bucket, as of a version; none before the first."""
    return json.loads(files.read_text(spark, f"{folder}/v{version}/index.json")) if version >= 0 else {}


def save(state: OrphanState, folder: str, version: int, touched: list[int] | None = None) -> OrphanState:
    """Writes the buckets `touched` of a version (all of them by default), which the state must hold in whole, and points to the
    version before for the rest. Versions that neither this one nor the one before points to are removed. Returns the version in whole as read back, which cuts its lineage."""
    spark = state.refs.sparkSession
    touched = list(range(BUCKETS)) if touched is None else touched
    for name, df in (("refs", state.refs), ("parents", state.parents)):
        df.withColumn("bucket", bucket()).where(F.col("bucket").isin(touched)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v{version}/{name}")
    before = _index(spark, folder, version - 1) if version > 0 and files.exists(spark, f"{folder}/v{version - 1}/index.json") else {}
    index = before | {str(b): version for b in touched}
    files.write_text(spark, f"{folder}/v{version}/index.json", json.dumps(index))
    kept = {f"v{v}" for v in {version, version - 1, *index.values(), *before.values()}}
    for name in files.names(spark, folder):
        if name.startswith("v") and name not in kept:
            files.delete(spark, f"{folder}/{name}")
    return load(spark, folder, version)


def load(spark: SparkSession, folder: str, version: int, buckets: list[int] | None = None) -> OrphanState:
    """A version of the state, or the buckets asked for."""
    index = {b: v for b, v in _index(spark, folder, version).items() if buckets is None or int(b) in buckets}
    state = []
    for name, schema in (("refs", REFS), ("parents", PARENTS)):
        paths = [p for b, v in index.items() if files.exists(spark, p := f"{folder}/v{v}/{name}/bucket={b}")]
        state.append(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))
    return OrphanState(state[0].fillna("", ["row_id"]), state[1])


def panel_orphans(exposures: DataFrame, labels: DataFrame, securities: DataFrame, trading_days: DataFrame) -> OrphanState:
    """The panel's references judged in the order of events: parents arrive, references probe them, deletions
    reopen what they no longer cover."""
    ids = securities.select(F.lit("stable_id").alias("field"), F.col("stable_id").cast("string").alias("key"), F.col("listed_on").cast("date").alias("since"), F.lit(None).cast("date").alias("until"))
    days = trading_days.where("date is not null").select(F.lit("date").alias("field"), F.date_format("date", "yyyy-MM-dd").alias("key"), F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until"))
    refs = references(exposures, "exposures", "stable_id", "stable_id", "date").unionByName(references(labels, "labels", "stable_id", "stable_id", "date"))
    refs = refs.unionByName(references(exposures.withColumn("day_key", F.date_format("date", "yyyy-MM-dd")), "exposures", "date", "day_key", "date", "stable_id"))
    state = advance(empty_state(exposures.sparkSession), new_refs=refs, new_parents=ids.unionByName(days))
    gone = securities.where("deleted_on is not null").select(F.lit("stable_id").alias("field"), F.col("stable_id").cast("string").alias("key"), F.col("deleted_on").cast("date").alias("until"))
    return advance(state, deletions=gone)
