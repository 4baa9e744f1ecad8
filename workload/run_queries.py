"""Run metrics, status, failures, deliveries, replays, staleness, validators of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import roster, runs
from tidemark.sources.tables import read_table
from workload.change_queries import acct
from workload.registry import query

SYSTEMS = ["careers_page", "ats_feed", "company_news", "usage_metrics", "project_inventory", "manual", "sitemap"]


def system():
    return F.element_at(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("l_linenumber"))


SYSTEM_SQL = "list_extract([" + ", ".join(f"'{s}'" for s in SYSTEMS) + "], l_linenumber)"


def attempts(spark, folder):
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), acct("l_suppkey").alias("account_id"), system().alias("source_system"),
        F.when(F.col("l_returnflag") == "A", "succeeded").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped").alias("status"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("bigint")).alias("signal_count"),
        "l_quantity", "l_linestatus",
    )


ATTEMPTS_SQL = f"""
attempts AS (SELECT l_orderkey AS run_id, 'acct-' || l_suppkey AS account_id, {SYSTEM_SQL} AS source_system,
  CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status,
  CASE WHEN l_discount > 0 THEN CAST(l_quantity AS BIGINT) END AS signal_count, l_quantity, l_linestatus FROM lineitem)"""


def run_times(spark, folder):
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")).alias("completed_at"),
        "o_orderstatus", "o_orderpriority", "o_totalprice",
    )


@query(
    "run_metrics",
    f"""WITH {ATTEMPTS_SQL},
    wanted AS (SELECT DISTINCT run_id, account_id FROM attempts WHERE l_quantity > 10 UNION SELECT o_orderkey, 'acct-none' FROM orders WHERE o_orderpriority = '1-URGENT'),
    covered AS (SELECT run_id, count(*) AS covered FROM (SELECT DISTINCT run_id, account_id FROM attempts WHERE status = 'succeeded') SEMI JOIN wanted USING (run_id, account_id) GROUP BY ALL),
    expected AS (SELECT run_id, count(*) AS expected FROM wanted GROUP BY ALL),
    tried AS (SELECT run_id, count(DISTINCT account_id) AS accounts, count(*) AS n, count(*) FILTER (status = 'succeeded') AS ok, count(*) FILTER (status = 'failed') AS bad,
      sum(coalesce(signal_count, 0))::BIGINT AS signals FROM attempts GROUP BY ALL),
    by_source AS (SELECT run_id, string_agg(source_system || '=' || n, ',' ORDER BY source_system) AS txt
      FROM (SELECT run_id, source_system, sum(coalesce(signal_count, 0))::BIGINT AS n FROM attempts GROUP BY ALL) GROUP BY run_id),
    sent AS (SELECT o_orderkey AS run_id, 10 AS attempted, CAST(floor(o_totalprice / 50000) AS BIGINT) AS delivered FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'P' THEN 5400000 END AS duration_ms, coalesce(expected, 0) AS expected_accounts,
      coalesce(accounts, 0) AS attempted_accounts, coalesce(covered, 0) AS covered_accounts,
      CASE WHEN coalesce(expected, 0) = 0 THEN 1.0::DOUBLE ELSE round(coalesce(covered, 0) / expected::DOUBLE, 4) END AS coverage_ratio,
      coalesce(n, 0) AS source_attempts, coalesce(ok, 0) AS source_succeeded, coalesce(bad, 0) AS source_failed,
      CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE round(ok / n::DOUBLE, 4) END AS source_ratio, coalesce(signals, 0) AS signal_total,
      coalesce(txt, '') AS signals_by_source, coalesce(attempted, 0) AS delivery_attempted, coalesce(delivered, 0) AS delivery_delivered,
      coalesce(greatest(0, attempted - delivered), 0) AS delivery_failed, CASE WHEN attempted > 0 THEN round(delivered / attempted::DOUBLE, 4) END AS delivery_ratio
    FROM orders LEFT JOIN expected e ON e.run_id = o_orderkey LEFT JOIN tried t ON t.run_id = o_orderkey LEFT JOIN covered c ON c.run_id = o_orderkey
      LEFT JOIN by_source b ON b.run_id = o_orderkey LEFT JOIN sent s ON s.run_id = o_orderkey""",
)
def _metrics(spark, folder):
    tried, times = attempts(spark, folder), run_times(spark, folder)
    expected = tried.filter("l_quantity > 10").select("run_id", "account_id").unionByName(
        times.filter("o_orderpriority = '1-URGENT'").select("run_id", F.lit("acct-none").alias("account_id"))
    )
    deliveries = times.filter("o_orderpriority <> '5-LOW'").select(
        "run_id", F.lit(10).cast("bigint").alias("attempted"), F.floor(F.col("o_totalprice") / 50_000).alias("delivered"),
        F.lit(None).cast("bigint").alias("failed"),
    )
    return runs.run_metrics(times.select("run_id", "started_at", "completed_at"), tried, expected, deliveries)


@query(
    "run_status",
    f"""WITH {ATTEMPTS_SQL}, folded AS (SELECT run_id, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM attempts GROUP BY ALL),
    judged AS (SELECT *, CASE WHEN failed = 0 THEN 'succeeded' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS collected_status FROM folded)
    SELECT run_id, succeeded, failed, collected_status, CASE WHEN o_orderpriority = '1-URGENT' AND collected_status <> 'failed' THEN 'partial' ELSE collected_status END AS status,
      collected_status = 'succeeded' AS promotable FROM judged JOIN orders ON o_orderkey = run_id""",
)
def _status(spark, folder):
    lost = run_times(spark, folder).filter("o_orderpriority = '1-URGENT'").select("run_id", F.lit("slack_delivery_failed").alias("code"))
    return runs.run_status(attempts(spark, folder), lost)


@query(
    "failure_summary",
    r"""WITH raw AS (SELECT role AS source_system, CASE WHEN turn < 2 THEN 'timeout' ELSE 'http_500' END AS code,
        text || ' ?token=' || conv_id || ' Bearer abc' || turn || '.def' AS message, turn % 2 = 0 AS retryable FROM conversations),
    safe AS (SELECT source_system, code, retryable, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
        '(?i)\b(?:bearer|basic)\s+[A-Za-z0-9+/_=.-]+', '[REDACTED]', 'g'),
        '(?i)((?:[?&]|\b)(?:token|key|secret|password|signature|auth)\s*=\s*)[^&#\s]+', '\1[REDACTED]', 'g'),
        '(?i)\b(?:sk|pk|ghp|xox[baprs])-?[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g'),
        '[\x00-\x1f\x7f]', ' ', 'g')), 500) AS message FROM raw)
    SELECT source_system, code, message, retryable, count(*) AS n FROM safe GROUP BY ALL""",
)
def _failures(spark, folder):
    talk = read_table(spark, folder, "conversations", spread=True)
    errors = talk.select(
        F.col("role").alias("source_system"), F.when(F.col("turn") < 2, "timeout").otherwise("http_500").alias("code"),
        F.concat(F.col("text"), F.lit(" ?token="), F.col("conv_id"), F.lit(" Bearer abc"), F.col("turn"), F.lit(".def")).alias("message"),
        (F.col("turn") % 2 == 0).alias("retryable"),
    )
    return runs.failure_summary(errors)


@query(
    "stale_runs",
    """WITH aged AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 90 MINUTE END AS completed_at,
      greatest(0, epoch_ms(TIMESTAMP '2000-01-01') - epoch_ms(o_orderdate)) AS age_ms FROM orders)
    SELECT run_id, age_ms, age_ms > 31536000000 AS stale,
      CASE WHEN age_ms > 31536000000 THEN CASE WHEN completed_at IS NULL THEN 'running-too-long' ELSE 'completed-after-threshold' END END AS stale_reason FROM aged""",
)
def _stale(spark, folder):
    found = runs.stale_runs(run_times(spark, folder), F.lit("2000-01-01").cast("timestamp"), 31_536_000_000)
    return found.select("run_id", "age_ms", "stale", "stale_reason")


@query(
    "delivery_dedupe",
    """WITH a AS (SELECT 'digest-' || l_orderkey AS delivery_key, l_linenumber AS attempt, l_returnflag AS claimed_by, l_shipdate + to_minutes(l_linenumber) AS "at",
        CASE WHEN l_quantity < 15 THEN 200 WHEN l_quantity < 25 THEN 429 WHEN l_quantity < 45 THEN 503 ELSE 400 END AS http_status FROM lineitem),
    owner AS (SELECT delivery_key, arg_min(claimed_by, row("at", attempt, claimed_by)) AS owner, count(*) AS n FROM a GROUP BY ALL),
    mine AS (SELECT a.*, n FROM a JOIN owner o ON a.delivery_key = o.delivery_key AND claimed_by = owner),
    folded AS (SELECT delivery_key, claimed_by AS owner, any_value(n) AS n, min(attempt) FILTER (http_status IN (200, 400)) AS last_word, max(attempt) AS last_attempt FROM mine GROUP BY ALL),
    ended AS (SELECT f.*, (SELECT min(http_status = 200) FROM mine m WHERE m.delivery_key = f.delivery_key AND attempt = last_word AND http_status IN (200, 400)) AS ok FROM folded f),
    used AS (SELECT *, CASE WHEN last_word <= 3 THEN last_word ELSE least(3, last_attempt) END AS attempts FROM ended)
    SELECT delivery_key, owner, CASE WHEN last_word <= 3 AND ok THEN 'delivered' WHEN last_word <= 3 OR last_attempt >= 3 THEN 'failed' ELSE 'sending' END AS status,
      attempts, n - attempts AS ignored_rows FROM used""",
)
def _deliveries(spark, folder):
    quantity = F.col("l_quantity")
    tried = read_table(spark, folder, "lineitem").select(
        F.concat(F.lit("digest-"), F.col("l_orderkey")).alias("delivery_key"), F.col("l_linenumber").alias("attempt"), F.col("l_returnflag").alias("claimed_by"),
        (F.col("l_shipdate") + F.make_dt_interval(mins=F.col("l_linenumber"))).alias("at"),
        F.when(quantity < 15, 200).when(quantity < 25, 429).when(quantity < 45, 503).otherwise(400).alias("http_status"),
        F.lit(None).cast("boolean").alias("transient"),
    )
    return runs.delivery_dedupe(tried)


@query(
    "replay_requests",
    f"""WITH req AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_no, l_orderkey AS run_id, 'acct-' || (l_suppkey % 3) AS account_id,
        {SYSTEM_SQL} AS source_system, CASE WHEN l_tax = 0 THEN ' ' ELSE 'user-' || l_suppkey END AS requested_by, l_shipdate AS requested_at, 'flag ' || l_returnflag AS reason,
        CASE WHEN l_discount > 0.07 THEN 'lead' END AS approved_by, CASE WHEN l_discount > 0.085 THEN 'checked' END AS override_reason FROM lineitem),
    err AS (SELECT l_orderkey AS run_id, {SYSTEM_SQL} AS source_system, bool_or(l_linestatus = 'O') AS retryable FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    judged AS (SELECT req.*, CASE WHEN o_orderstatus = 'O' THEN 'run_succeeded' WHEN requested_by = ' ' THEN 'incomplete_request'
        WHEN approved_by IS NOT NULL AND override_reason IS NULL THEN 'incomplete_override'
        WHEN NOT (coalesce(retryable, false) OR approved_by IS NOT NULL) THEN 'not_retryable' END AS rejection,
        'replay:' || req.run_id || ':' || account_id || ':' || req.source_system AS replay_id
      FROM req JOIN orders ON o_orderkey = req.run_id LEFT JOIN err ON err.run_id = req.run_id AND err.source_system = req.source_system),
    placed AS (SELECT *, row_number() OVER (PARTITION BY replay_id, rejection IS NULL ORDER BY requested_at, request_no) AS rn FROM judged)
    SELECT request_no, replay_id, CASE WHEN rejection IS NOT NULL THEN 'rejected' WHEN rn = 1 THEN 'replay_requested' ELSE 'replay_deduplicated' END AS event,
      rejection, trim(requested_by) AS requested_by, reason FROM placed""",
)
def _replays(spark, folder):
    items = read_table(spark, folder, "lineitem")
    requests = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("request_no"), F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("acct-"), F.col("l_suppkey") % 3).alias("account_id"), system().alias("source_system"),
        F.when(F.col("l_tax") == 0, " ").otherwise(F.concat(F.lit("user-"), F.col("l_suppkey"))).alias("requested_by"), F.col("l_shipdate").alias("requested_at"),
        F.concat(F.lit("flag "), F.col("l_returnflag")).alias("reason"), F.when(F.col("l_discount") > 0.07, "lead").alias("approved_by"),
        F.when(F.col("l_discount") > 0.085, "checked").alias("override_reason"),
    )
    errors = items.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), system().alias("source_system"), (F.col("l_linestatus") == "O").alias("retryable"))
    status = F.when(F.col("o_orderstatus") == "O", "succeeded").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed")
    known = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"))
    return runs.replay_requests(requests, known, errors)


@query(
    "validate_runs",
    """WITH err AS (SELECT l_orderkey AS run_id, count(*) AS errors FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'succeeded' WHEN 'P' THEN 'paused' ELSE 'failed' END AS status,
      o_totalprice < 30000 AS early, o_totalprice > 400000 AS reversed, coalesce(errors, 0) AS errors FROM orders LEFT JOIN err ON run_id = o_orderkey)
    SELECT run_id, errors, array_to_string(list_filter([CASE WHEN status = 'paused' THEN 'status' END, CASE WHEN early THEN 'completed_at' END, CASE WHEN reversed THEN 'window' END,
      CASE WHEN status = 'succeeded' AND errors > 0 THEN 'succeeded_with_errors' END, CASE WHEN status = 'failed' AND errors = 0 THEN 'failed_without_errors' END],
      lambda x: x IS NOT NULL), ',') AS violations FROM r""",
)
def _validate(spark, folder):
    status = F.when(F.col("o_orderstatus") == "O", "succeeded").when(F.col("o_orderstatus") == "P", "paused").otherwise("failed")
    shifted = F.when(F.col("o_totalprice") < 30_000, F.col("started_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("started_at"))
    known = run_times(spark, folder).select(
        "run_id", status.alias("status"), "started_at", shifted.alias("completed_at"), F.col("started_at").alias("window_start"),
        F.when(F.col("o_totalprice") > 400_000, F.col("started_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("started_at")).alias("window_end"),
    )
    errors = read_table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    found = roster.validate_runs(known, errors)
    return found.select("run_id", "errors", F.array_join("violations", ",").alias("violations"))
