"""Collection runs: metrics, status, failures, deliveries, replays, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import iso_millis, trim_all
from tidemark.functions.vocabulary import DELIVERY_FAILURE, SOURCE_SYSTEMS
from tidemark.operators.gates import redact_text


def ratio(numerator: Column, denominator: Column) -> Column:
    """Four decimals; nothing out of nothing counts as complete."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(F.round(numerator / denominator, 4))


def run_metrics(runs: DataFrame, attempts: DataFrame, expected: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Coverage, source success, signal totals by source, delivery ratio and duration per run.

    ``runs``: run_id, started_at, completed_at; ``attempts``: run_id, account_id,
    source_system, status, signal_count; ``expected``: run_id, account_id;
    ``deliveries``: run_id, attempted, delivered, failed. Attempts are first
    reduced to (run, account), so distinct accounts are plain counts.
    """
    per_account = attempts.groupBy("run_id", "account_id").agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.coalesce("signal_count", F.lit(0))).alias("signals"),
        *[F.sum(F.when(F.col("source_system") == s, F.coalesce("signal_count", F.lit(0)))).alias(f"by_{s}") for s in SOURCE_SYSTEMS],
    )
    wanted = expected.select("run_id", "account_id").distinct().withColumn("expected", F.lit(1))
    joined = per_account.join(wanted, ["run_id", "account_id"], "full_outer")
    totals = joined.groupBy("run_id").agg(
        F.count("expected").alias("expected_accounts"),
        F.count("attempted").alias("attempted_accounts"),
        F.count_if((F.col("succeeded") > 0) & (F.col("expected") == 1)).alias("covered_accounts"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attempted", "succeeded", "failed", "signals")],
        *[F.sum(f"by_{s}").alias(f"by_{s}") for s in SOURCE_SYSTEMS],
    )
    by_source = F.array_join(
        F.array_compact(F.array(*[F.concat(F.lit(f"{s}="), F.col(f"by_{s}").cast("string")) for s in sorted(SOURCE_SYSTEMS)])), ","
    )
    sent = deliveries.groupBy("run_id").agg(
        F.sum("attempted").alias("d_attempted"), F.sum("delivered").alias("d_delivered"),
        F.sum(F.coalesce("failed", F.greatest(F.lit(0), F.col("attempted") - F.col("delivered")))).alias("d_failed"),
    )
    zero = F.lit(0).cast("bigint")
    counted = ["expected_accounts", "attempted_accounts", "covered_accounts", "attempted", "succeeded", "failed", "signals", "d_attempted", "d_delivered", "d_failed"]
    full = runs.join(totals, "run_id", "left").join(sent, "run_id", "left").withColumns({c: F.coalesce(c, zero) for c in counted})
    return full.select(
        "run_id",
        F.when(
            F.col("completed_at").isNotNull(),
            F.greatest(zero, F.unix_millis("completed_at") - F.unix_millis("started_at")),
        ).alias("duration_ms"),
        "expected_accounts", "attempted_accounts", "covered_accounts",
        ratio(F.col("covered_accounts"), F.col("expected_accounts")).alias("coverage_ratio"),
        F.col("attempted").alias("source_attempts"), F.col("succeeded").alias("source_succeeded"), F.col("failed").alias("source_failed"),
        ratio(F.col("succeeded"), F.col("attempted")).alias("source_ratio"),
        F.col("signals").alias("signal_total"),
        F.coalesce(by_source, F.lit("")).alias("signals_by_source"),
        F.col("d_attempted").alias("delivery_attempted"), F.col("d_delivered").alias("delivery_delivered"), F.col("d_failed").alias("delivery_failed"),
        F.when(F.col("d_attempted") > 0, ratio(F.col("d_delivered"), F.col("d_attempted"))).alias("delivery_ratio"),
    )


def failure_summary(errors: DataFrame) -> DataFrame:
    """Errors counted by source, code, redacted message and retryability."""
    return (
        errors.select(
            "source_system", redact_text("code").alias("code"), redact_text("message").alias("message"), "retryable"
        )
        .groupBy("source_system", "code", "message", "retryable")
        .agg(F.count("*").alias("n"))
    )


def run_status(attempts: DataFrame, delivery_failures: DataFrame) -> DataFrame:
    """Status of each run out of its attempts, and whether its results may be promoted.

    A failed delivery makes a run partial, but does not hold its results back.
    """
    per_run = attempts.groupBy("run_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    undelivered = delivery_failures.filter(F.col("code") == DELIVERY_FAILURE).groupBy("run_id").agg(F.lit(True).alias("undelivered"))
    collected = (
        F.when(F.col("failed") == 0, "succeeded").when(F.col("succeeded") > 0, "partial").otherwise("failed")
    )
    lost = F.coalesce("undelivered", F.lit(False)) & (F.col("collected_status") != "failed")
    return (
        per_run.join(undelivered, "run_id", "left")
        .withColumn("collected_status", collected)
        .withColumn("status", F.when(lost, "partial").otherwise(F.col("collected_status")))
        .withColumn("promotable", F.col("collected_status") == "succeeded")
        .drop("undelivered")
    )


def stale_runs(runs: DataFrame, now: Column, threshold_ms: int) -> DataFrame:
    if threshold_ms < 0:
        raise ValueError("threshold_ms must not be negative")
    age = F.greatest(F.lit(0).cast("bigint"), F.unix_millis(now) - F.unix_millis("started_at"))
    return (
        runs.withColumn("age_ms", age)
        .withColumn("stale", F.col("age_ms") > threshold_ms)
        .withColumn(
            "stale_reason",
            F.when(F.col("stale"), F.when(F.col("completed_at").isNotNull(), "completed-after-threshold").otherwise("running-too-long")),
        )
    )


def delivery_key(channel: Column, generated_at: Column, window_start: Column, window_end: Column) -> Column:
    joined = F.concat_ws("\u0000", channel, iso_millis(generated_at), iso_millis(window_start), iso_millis(window_end))
    return F.concat(F.lit("digest_"), F.substring(F.sha2(joined, 256), 1, 32))


def delivery_dedupe(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Final state per delivery key (delivery_key, attempt, http_status, transient, claimed_by, at).

    The first claimant owns the key, other claimants are duplicates. Of the
    owner's attempts the first that is delivered or fails for good decides;
    transient failures are retried up to ``max_attempts``.
    """
    owner = attempts.groupBy("delivery_key").agg(
        F.min_by("claimed_by", F.struct("at", "attempt", "claimed_by")).alias("owner"), F.count("*").alias("rows")
    )
    delivered = F.col("http_status").between(200, 299)
    soft = ~delivered & (F.coalesce("transient", F.lit(False)) | (F.col("http_status") == 429) | (F.col("http_status") >= 500))
    decisive = delivered | ~soft
    reduced = attempts.groupBy("delivery_key", "claimed_by").agg(
        F.min(F.when(decisive, F.struct(F.col("attempt"), delivered.alias("ok")))).alias("end"),
        F.max("attempt").alias("last_attempt"),
    )
    mine = reduced.join(owner, "delivery_key").filter(F.col("claimed_by") == F.col("owner"))
    in_time = F.col("end").isNotNull() & (F.col("end.attempt") <= max_attempts)
    status = (
        F.when(in_time & F.col("end.ok"), "delivered")
        .when(in_time | (F.col("last_attempt") >= max_attempts), "failed")
        .otherwise("sending")
    )
    used = F.when(in_time, F.col("end.attempt")).otherwise(F.least(F.lit(max_attempts), F.col("last_attempt")))
    return mine.select(
        "delivery_key", "owner", status.alias("status"), used.cast("bigint").alias("attempts"),
        (F.col("rows") - used).cast("bigint").alias("ignored_rows"),
    )


def replay_requests(requests: DataFrame, runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Audit of replay requests: requested, deduplicated, or rejected with a reason.

    ``requests``: request_no, run_id, account_id, source_system, requested_by,
    requested_at, reason, approved_by, override_reason. Only failed or partial
    runs can be replayed, and only with a retryable error of that source or an
    override that names approver and reason.
    """
    def blank(name: str) -> Column:
        return F.coalesce(trim_all(name) == "", F.lit(True))

    retryable = errors.groupBy("run_id", "source_system").agg(F.max("retryable").alias("retryable"))
    override = F.col("approved_by").isNotNull() | F.col("override_reason").isNotNull()
    judged = (
        requests.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id", "left")
        .join(retryable, ["run_id", "source_system"], "left")
        .withColumn(
            "rejection",
            F.when(F.col("run_status").isNull(), "unknown_run")
            .when(F.col("run_status") == "succeeded", "run_succeeded")
            .when(blank("account_id") | blank("requested_by") | blank("reason"), "incomplete_request")
            .when(override & (blank("approved_by") | blank("override_reason")), "incomplete_override")
            .when(~(F.coalesce("retryable", F.lit(False)) | override), "not_retryable"),
        )
        .withColumn("replay_id", F.concat_ws(":", F.lit("replay"), "run_id", "account_id", "source_system"))
    )
    place = F.struct("requested_at", "request_no")
    first = judged.filter(F.col("rejection").isNull()).groupBy("replay_id").agg(F.min(place).alias("first_place"))
    return judged.join(first, "replay_id", "left").select(
        "request_no", "replay_id",
        F.when(F.col("rejection").isNotNull(), "rejected")
        .when(place == F.col("first_place"), "replay_requested").otherwise("replay_deduplicated").alias("event"),
        "rejection",
        redact_text("requested_by").alias("requested_by"),
        redact_text("reason").alias("reason"),
    )
