"""Records over time: idempotent appends, baselines, promotion, checkpoints, retention, ledger."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vocabulary import (
    DELIVERY_FAILURE,
    LEDGER_RETENTION_DAYS,
    REPORTED_ID,
    RETENTION_COUNTS,
    SCOPE_RETENTION_DAYS,
)
from tidemark.session import stored


# --- idempotent append -----------------------------------------------------------


def content_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class AppendPlan:
    inserts: DataFrame
    conflicts: DataFrame


def append_idempotent(existing: DataFrame, incoming: DataFrame, id_col: str) -> AppendPlan:
    """Rows to insert and ids whose content differs from what is stored or from each other.

    Copies inside the batch are combined before the join. Of a stored table that
    :func:`write_inserts` wrote, only the id and ``content_hash`` columns are read.
    """
    columns = [c for c in incoming.columns if c != id_col]
    stored_hash = F.col("content_hash") if "content_hash" in existing.columns else content_hash(columns)
    stored = existing.select(id_col, stored_hash.alias("stored_hash"))
    batch = (
        incoming.withColumn("content", content_hash(columns))
        .groupBy(id_col)
        .agg(
            F.min_by(F.struct(*columns), "content").alias("row"),
            F.min("content").alias("low"),
            F.max("content").alias("high"),
        )
    )
    matched = batch.join(stored, id_col, "left")
    clash = (F.col("low") != F.col("high")) | (F.col("stored_hash").isNotNull() & (F.col("stored_hash") != F.col("low")))
    inserts = matched.filter(F.col("stored_hash").isNull() & ~clash).select(id_col, "row.*").select(*incoming.columns)
    conflicts = matched.filter(clash).select(
        id_col, F.when(F.col("stored_hash").isNull(), "batch").otherwise("stored").alias("conflict_with")
    )
    return AppendPlan(inserts, conflicts)


def write_inserts(plan: AppendPlan, path: str, id_col: str) -> None:
    columns = [c for c in plan.inserts.columns if c != id_col]
    plan.inserts.withColumn("content_hash", content_hash(columns)).write.mode("append").parquet(path)


# --- promotion, baselines, listings ---------------------------------------------


def promotable_runs(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Runs whose results become current: succeeded, or partial by delivery failures only."""
    flags = errors.groupBy("run_id").agg(
        F.count("*").alias("errors"), F.count_if(~F.col("code").eqNullSafe(DELIVERY_FAILURE)).alias("source_errors")
    )
    joined = runs.join(flags, "run_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("bigint")))
    delivery_only = (F.col("status") == "partial") & (F.col("errors") > 0) & (F.col("source_errors") == 0)
    return joined.filter((F.col("status") == "succeeded") | delivery_only).drop("source_errors")


def promote_runs(runs: DataFrame, errors: DataFrame, records: DataFrame) -> DataFrame:
    """Records (run_id, ...) of promotable runs."""
    return records.join(promotable_runs(runs, errors).select("run_id"), "run_id", "left_semi")


def previous_baseline(probes: DataFrame, runs: DataFrame, bucket: str = "day") -> DataFrame:
    """Latest run of the account that completed before each probe time.

    ``probes``: account_id, probe_id, before; ``runs``: account_id, run_id,
    completed_at. The as-of match runs inside (account, time bucket), so one hot
    account is split over its buckets; earlier buckets arrive as one carried row
    each. Nothing is paired row by row.
    """
    runs = runs.select("account_id", "run_id", "completed_at").withColumn("bucket", F.date_trunc(bucket, "completed_at"))
    value = F.struct(F.col("completed_at").alias("at"), F.col("run_id").alias("id"))
    per_bucket = runs.groupBy("account_id", "bucket").agg(F.max(value).alias("last"))
    marks = per_bucket.select("account_id", "bucket", "last").unionByName(
        probes.select("account_id", F.date_trunc(bucket, "before").alias("bucket")).distinct(), allowMissingColumns=True
    ).groupBy("account_id", "bucket").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("account_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("carried", F.max("last").over(earlier)).select("account_id", "bucket", "carried")

    no_run = F.lit(None).cast(f"struct<at: timestamp, id: {dict(runs.dtypes)['run_id']}>")
    timeline = probes.select(
        "account_id", F.date_trunc(bucket, "before").alias("bucket"), F.col("before").alias("ts"), F.lit(0).alias("is_run"),
        "probe_id", no_run.alias("run"),
    ).unionByName(
        runs.select("account_id", "bucket", F.col("completed_at").alias("ts"), F.lit(1).alias("is_run"), value.alias("run")),
        allowMissingColumns=True,
    )
    # a probe sorts before runs of the same instant: only strictly earlier runs count
    upto = Window.partitionBy("account_id", "bucket").orderBy("ts", "is_run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = timeline.withColumn("seen", F.max("run").over(upto)).filter("is_run = 0")
    baseline = F.coalesce("seen", "carried")
    return matched.join(carried, ["account_id", "bucket"], "left").select(
        "account_id", "probe_id", F.col("ts").alias("before"), baseline["id"].alias("run_id"), baseline["at"].alias("completed_at")
    )


def list_records(
    records: DataFrame, time_col: str, id_col: str, account_id: str | None = None, run_id: str | None = None, promoted: DataFrame | None = None
) -> DataFrame:
    """Stored records, newest first; with ``promoted`` only those of promoted runs."""
    chosen = records
    if account_id is not None:
        chosen = chosen.filter(F.col("account_id") == account_id)
    if run_id is not None:
        chosen = chosen.filter(F.col("run_id") == run_id)
    if promoted is not None:
        chosen = chosen.join(promoted.select("run_id"), "run_id", "left_semi")
    return chosen.orderBy(F.desc(time_col), id_col)


def checkpoint_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest cursor per (account_id, source); at equal times the stored one stays.

    Incoming rows lacking a required field are refused.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    valid = incoming.filter(filled("account_id") & filled("source") & filled("run_id") & F.col("captured_at").isNotNull())
    both = existing.withColumn("stored", F.lit(1)).unionByName(valid.withColumn("stored", F.lit(0)))
    best = F.max_by(F.struct("cursor", "captured_at", "run_id"), F.struct("captured_at", "stored", "run_id"))
    return both.groupBy("account_id", "source").agg(best.alias("c")).select("account_id", "source", "c.*")


# --- retention --------------------------------------------------------------------


#: A histogram slice of order keys that are microseconds: a second. Slices are counted by the day first.
SLICE_WIDTH = 1_000_000
SLICES_A_DAY = 86_400
#: Parts in which the rows of the slice at the cut are ranked before they are ranked together.
CUT_PARTS = 256


def newest_per_collection(records: DataFrame, limits: Mapping[str, int] | None = None, widths: Mapping[str, int] | None = None) -> DataFrame:
    """Exactly the newest N records of each collection, in two scans.

    ``records``: collection, record_id, order_key (BIGINT, larger is newer; NULL is the oldest); ``widths``: order keys a
    slice, for collections whose keys are no microseconds. The first scan counts rows by slice, combined on the map side;
    in that small table the limit is found in a day and then in a slice. The second scan keeps what is newer
    than the slice, and ranks what is in it: in parts, each cut to what is still wanted, and those together. No task sorts
    a collection, even if all its rows have one key. Equal keys are kept by the hash of their id.
    """
    limits = RETENTION_COUNTS if limits is None else limits
    wanted, width = F.lit(None).cast("bigint"), F.lit(SLICE_WIDTH)
    for name, limit in limits.items():
        wanted = F.when(F.col("collection") == name, F.lit(limit).cast("bigint")).otherwise(wanted)
        width = F.when(F.col("collection") == name, F.lit((widths or {}).get(name, SLICE_WIDTH))).otherwise(width)
    key = F.coalesce("order_key", F.lit(-(2**62)))
    keyed = records.filter(F.col("collection").isin(*limits)).withColumn("slice", -F.floor(key / width))
    slices = stored(keyed.groupBy("collection", "slice").agg(F.count("*").alias("n")), "slices").withColumn("day", F.floor(F.col("slice") / SLICES_A_DAY))

    def first_reached(counts: DataFrame, level: str) -> DataFrame:
        """The step in which a collection reaches its quota, and how many of its rows are wanted."""
        running = F.sum("n").over(Window.partitionBy("collection").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        reached = counts.withColumn("upto", running).filter(F.col("upto") >= F.col("quota"))
        step = F.min(F.struct(level, (F.col("quota") - F.col("upto") + F.col("n")).alias("quota")))
        return reached.groupBy("collection").agg(step.alias("c")).select("collection", "c.*")

    days = slices.groupBy("collection", "day").agg(F.sum("n").alias("n")).withColumn("quota", wanted)
    inside = slices.join(first_reached(days, "day"), ["collection", "day"]).select("collection", "slice", "n", "quota")
    # one row per limited collection, so the broadcast is bounded by the number of limits
    cut = stored(first_reached(inside, "slice").withColumnRenamed("slice", "cut"), "cut")

    near = keyed.join(F.broadcast(cut), "collection", "left").filter(F.col("cut").isNull() | (F.col("slice") <= F.col("cut")))
    near = near.withColumns({"at": F.coalesce(F.col("slice") == F.col("cut"), F.lit(False)), "part": F.pmod(F.xxhash64("record_id"), F.lit(CUT_PARTS)), "digest": F.md5("record_id"), "key": key})
    order = [F.desc("key"), "digest", "record_id"]
    for parts in (["part"], [F.when(F.col("at"), 0).otherwise(F.col("part"))]):
        rank = F.row_number().over(Window.partitionBy("collection", "at", *parts).orderBy(*order))
        near = near.withColumn("rank", rank).filter(~F.col("at") | (F.col("rank") <= F.col("quota")))
    return near.select(*records.columns)


def retention_by_age(records: DataFrame, uses: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Adds ``last_used_at`` and ``expired`` to records (record_id, created_at).

    ``uses``: record_id, used_at. A record lives ``days`` after its last use.
    """
    last = uses.groupBy("record_id").agg(F.max("used_at").alias("last_use"))
    return (
        records.join(last, "record_id", "left")
        .withColumn("last_used_at", F.greatest("created_at", F.coalesce("last_use", "created_at")))
        .withColumn("expired", F.col("last_used_at") < now - F.expr(f"INTERVAL {days} DAYS"))
        .drop("last_use")
    )


def cascade_delete(children: DataFrame, expired_parents: DataFrame, key: str) -> DataFrame:
    """Children that survive when their expired parents are deleted."""
    return children.join(expired_parents.select(key).distinct(), key, "left_anti")


def retention_policy(records: DataFrame, uses: DataFrame, scope: DataFrame, links: DataFrame, now: Column, days: Mapping[str, int], scope_days: int = SCOPE_RETENTION_DAYS) -> DataFrame:
    """What the whole policy deletes: (record_id, kind, reason, depth).

    ``records``: record_id, kind, created_at; ``uses``: record_id, used_at; ``scope``: record_id of an account's mapping and
    left_at, when it left the scope; ``links``: parent_id, child_id, where a child goes with its parent.

    A record goes by ``age`` when its last use (or its creation) is more than ``days`` of its kind ago; kinds without days have
    no age. A mapping goes by ``scope``, ``scope_days`` after it has left. What is linked to something that goes is ``linked``,
    at any depth: rounds follow the links from what was found last, until nothing new is found, so there are as many
    rounds as the longest chain has links, and cycles end. depth counts them; a record is named once, by its first reason.
    """
    limit = F.lit(None).cast("int")
    for kind, count in days.items():
        limit = F.when(F.col("kind") == kind, F.lit(count)).otherwise(limit)
    last = uses.groupBy("record_id").agg(F.max("used_at").alias("last_use"))
    aged = records.join(last, "record_id", "left").withColumn("last_used_at", F.greatest("created_at", "last_use"))
    old = F.col("last_used_at") < now - F.make_dt_interval(days=limit)
    left = scope.filter(F.col("left_at") < now - F.make_dt_interval(days=F.lit(scope_days))).select("record_id", F.lit(True).alias("out")).distinct()
    reason = F.when(F.col("out"), "scope").when(old, "age")
    judged = stored(aged.join(left, "record_id", "left").select("record_id", "kind", reason.alias("reason")), "judged")
    found = judged.filter("reason IS NOT NULL").select("record_id", "reason", F.lit(0).alias("depth"))
    # a link to what goes by itself leads to nothing new; the rounds read the others only
    ends = links.select("parent_id", "child_id").join(found.select(F.col("record_id").alias("child_id")), "child_id", "left_anti")
    edges = stored(ends.distinct(), "links")
    newest, depth = found, 0
    while True:
        depth += 1
        children = edges.join(newest.select(F.col("record_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("child_id").alias("record_id")).distinct()
        newest = stored(children.join(found, "record_id", "left_anti").select("record_id", F.lit("linked").alias("reason"), F.lit(depth).alias("depth")), "linked")
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
    return found.join(judged.select("record_id", "kind"), "record_id").select("record_id", "kind", "reason", "depth")


# --- delivery ledger ---------------------------------------------------------------


def ledger_prune(ledger: DataFrame, now: Column, days: int = LEDGER_RETENTION_DAYS) -> DataFrame:
    return ledger.filter(F.col("reported_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def ledger_record(ledger: DataFrame, deliveries: DataFrame, now: Column, ids_per_call: int | None = None) -> DataFrame:
    """Ids to add to the (pruned) ledger, with the call that adds them.

    ``deliveries``: call_id, signal_id, position, delivered_at. Invalid ids are
    ignored, an id is added once and by its earliest call. Recording the same calls
    again adds nothing. With ``ids_per_call`` a call adds only its first so many ids;
    by default it adds all, as an id that is not recorded is delivered again.
    """
    valid = deliveries.filter(F.col("signal_id").rlike(REPORTED_ID))
    distinct = valid.groupBy("call_id", "signal_id").agg(F.min("position").alias("position"), F.min("delivered_at").alias("delivered_at"))
    taken = distinct
    if ids_per_call is not None:
        order = Window.partitionBy("call_id").orderBy("position", "signal_id")
        taken = distinct.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= ids_per_call)
    fresh = taken.join(ledger_prune(ledger, now).select("signal_id"), "signal_id", "left_anti")
    first = F.min(F.struct("delivered_at", "call_id"))
    return fresh.groupBy("signal_id").agg(first.alias("f")).select(
        "signal_id", F.col("f.delivered_at").alias("reported_at"), F.col("f.call_id").alias("call_id")
    )


def ledger_added(recorded: DataFrame) -> DataFrame:
    """Number of ids each call added."""
    return recorded.groupBy("call_id").agg(F.count("*").alias("added"))
