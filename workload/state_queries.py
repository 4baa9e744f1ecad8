"""Appends, baselines, promotion, checkpoints, retention and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vocabulary import RECORD_RETENTION_DAYS
from tidemark.operators import state
from tidemark.sources.tables import read_table
from workload.change_queries import acct
from workload.registry import query

# --- append ---------------------------------------------------------------------


def _records(orders):
    return orders.select(
        F.concat(F.lit("ord-"), F.col("o_orderkey")).alias("record_id"), "o_orderstatus", "o_orderpriority", "o_totalprice"
    )


APPEND_SQL = """
existing AS (SELECT 'ord-' || o_orderkey AS record_id, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')),
base AS (SELECT 'ord-' || o_orderkey AS record_id, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus IN ('P', 'O')),
incoming AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT * REPLACE (o_totalprice + 7 AS o_totalprice) FROM base WHERE o_orderpriority = '3-MEDIUM'),
batch AS (SELECT i.record_id, min(i.o_orderstatus) AS o_orderstatus, min(i.o_orderpriority) AS o_orderpriority, min(i.o_totalprice) AS o_totalprice,
  count(DISTINCT (i.o_orderstatus, i.o_orderpriority, i.o_totalprice)) > 1 AS mixed, any_value(e.record_id) IS NOT NULL AS stored,
  bool_or(e.record_id IS NOT NULL AND i.o_totalprice <> e.o_totalprice) AS differs
  FROM incoming i LEFT JOIN existing e USING (record_id) GROUP BY i.record_id)"""


def _plan(spark, folder):
    orders = read_table(spark, folder, "orders")
    existing = _records(orders.filter("o_orderstatus IN ('F', 'P')"))
    base = _records(orders.filter("o_orderstatus IN ('P', 'O')")).withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    altered = base.filter("o_orderpriority = '3-MEDIUM'").withColumn("o_totalprice", F.col("o_totalprice") + 7)
    incoming = base.unionByName(base.filter("o_orderpriority = '2-HIGH'")).unionByName(altered)
    return state.append_idempotent(existing, incoming, "record_id")


@query("append_idempotent", f"WITH {APPEND_SQL} SELECT record_id, o_orderstatus, o_orderpriority, o_totalprice FROM batch WHERE NOT stored AND NOT mixed")
def _inserts(spark, folder):
    return _plan(spark, folder).inserts


@query(
    "append_conflicts",
    f"WITH {APPEND_SQL} SELECT record_id, CASE WHEN stored THEN 'stored' ELSE 'batch' END AS conflict_with FROM batch WHERE mixed OR (stored AND differs)",
)
def _conflicts(spark, folder):
    return _plan(spark, folder).conflicts


# --- baselines, promotion, listings ------------------------------------------------


@query(
    "previous_baseline",
    """WITH run AS (SELECT 'acct-' || o_custkey AS account_id, o_orderkey AS run_id, o_orderdate AS completed_at FROM orders WHERE o_orderstatus <> 'F'),
    probe AS (SELECT 'acct-' || o_custkey AS account_id, o_orderkey AS probe_id, o_orderdate AS before FROM orders),
    last AS (SELECT probe_id, max((completed_at, run_id)) AS r FROM probe JOIN run USING (account_id) WHERE completed_at < before GROUP BY ALL)
    SELECT account_id, probe_id, before, r[2] AS run_id, r[1] AS completed_at FROM probe LEFT JOIN last USING (probe_id)""",
)
def _baseline(spark, folder):
    orders = read_table(spark, folder, "orders").withColumn("account_id", acct("o_custkey"))
    runs = orders.filter("o_orderstatus <> 'F'").select("account_id", F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"))
    probes = orders.select("account_id", F.col("o_orderkey").alias("probe_id"), F.col("o_orderdate").alias("before"))
    return state.previous_baseline(probes, runs, bucket="quarter")


def run_tables(spark, folder):
    """orders as runs, returned line items as their errors, line items as their records."""
    orders, items = read_table(spark, folder, "orders"), read_table(spark, folder, "lineitem")
    status = F.when(F.col("o_orderstatus") == "O", "succeeded").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("completed_at"))
    errors = items.filter("l_returnflag = 'A' AND l_quantity > 25").select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", "slack_delivery_failed").otherwise("timeout").alias("code")
    )
    records = items.select(
        F.col("l_orderkey").alias("run_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        F.col("l_shipdate").alias("observed_at"),
    )
    return runs, errors, records


RUNS_SQL = """
run AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'succeeded' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status, o_orderdate AS completed_at FROM orders),
error AS (SELECT l_orderkey AS run_id, CASE l_linestatus WHEN 'F' THEN 'slack_delivery_failed' ELSE 'timeout' END AS code FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25),
flag AS (SELECT run_id, count(*) AS errors, count(*) FILTER (code <> 'slack_delivery_failed') AS source_errors FROM error GROUP BY ALL),
promoted AS (SELECT run_id, status, completed_at, coalesce(errors, 0) AS errors FROM run LEFT JOIN flag USING (run_id)
  WHERE status = 'succeeded' OR (status = 'partial' AND errors > 0 AND source_errors = 0))"""


@query("promotable_runs", f"WITH {RUNS_SQL} SELECT * FROM promoted")
def _promotable(spark, folder):
    runs, errors, _ = run_tables(spark, folder)
    return state.promotable_runs(runs, errors)


@query(
    "promote_runs",
    f"WITH {RUNS_SQL} SELECT l_orderkey AS run_id, count(*) AS records FROM lineitem WHERE l_orderkey IN (SELECT run_id FROM promoted) GROUP BY ALL",
)
def _promote(spark, folder):
    return state.promote_runs(*run_tables(spark, folder)).groupBy("run_id").agg(F.count("*").alias("records"))


@query(
    "list_records",
    f"""WITH {RUNS_SQL} SELECT l_orderkey AS run_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS record_id, l_shipdate AS observed_at
    FROM lineitem WHERE l_orderkey IN (SELECT run_id FROM promoted)""",
)
def _list(spark, folder):
    runs, errors, records = run_tables(spark, folder)
    return state.list_records(records, "observed_at", "record_id", promoted=state.promotable_runs(runs, errors))


@query(
    "checkpoint_merge",
    """WITH stored AS (SELECT 'acct-' || o_custkey AS account_id, o_orderpriority AS source, 'c-' || o_orderkey AS cursor, o_orderdate AS captured_at, 'run-' || o_orderkey AS run_id, 1 AS s
      FROM orders WHERE o_orderstatus = 'F'),
    arriving AS (SELECT 'acct-' || o_custkey AS account_id, o_orderpriority AS source, 'c-' || o_orderkey AS cursor, o_orderdate AS captured_at,
      CASE WHEN o_totalprice < 50000 THEN '' ELSE 'run-' || o_orderkey END AS run_id, 0 AS s FROM orders WHERE o_orderstatus <> 'F'),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY account_id, source ORDER BY captured_at DESC, s DESC, run_id DESC) AS rn
      FROM (SELECT * FROM stored UNION ALL SELECT * FROM arriving WHERE run_id <> ''))
    SELECT account_id, source, cursor, captured_at, run_id FROM ordered WHERE rn = 1""",
)
def _checkpoints(spark, folder):
    rows = read_table(spark, folder, "orders").select(
        acct("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("c-"), F.col("o_orderkey")).alias("cursor"),
        F.col("o_orderdate").alias("captured_at"), F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), "o_orderstatus", "o_totalprice",
    )
    columns = ["account_id", "source", "cursor", "captured_at", "run_id"]
    arriving = rows.filter("o_orderstatus <> 'F'").withColumn("run_id", F.when(F.col("o_totalprice") < 50_000, "").otherwise(F.col("run_id")))
    return state.checkpoint_merge(rows.filter("o_orderstatus = 'F'").select(columns), arriving.select(columns))


# --- retention --------------------------------------------------------------------


@query(
    "retention_by_count",
    """WITH rec AS (
      SELECT 'accounts' AS collection, 'cust-' || c_custkey AS record_id, -c_custkey AS order_key FROM customer
      UNION ALL SELECT 'runs', 'ord-' || o_orderkey, epoch_us(o_orderdate) FROM orders
      UNION ALL SELECT 'signals', l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, epoch_us(l_shipdate) FROM lineitem
      UNION ALL SELECT 'snapshots', 'doc-' || doc_id, doc_id FROM documents
      UNION ALL SELECT 'checkpoints', 'event-' || event_id, epoch_us(ts) FROM events),
    cap AS (SELECT unnest(['accounts', 'runs', 'signals', 'snapshots', 'checkpoints']) AS collection, unnest([1000, 1000, 50000, 10000, 5000]) AS n),
    placed AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY order_key DESC, md5(record_id), record_id) AS rn FROM rec JOIN cap USING (collection))
    SELECT collection, record_id, order_key FROM placed WHERE rn <= n""",
)
def _retain_count(spark, folder):
    def part(table, collection, record, key):
        return read_table(spark, folder, table).select(F.lit(collection).alias("collection"), record.alias("record_id"), key.cast("bigint").alias("order_key"))

    records = (
        part("customer", "accounts", F.concat(F.lit("cust-"), F.col("c_custkey")), -F.col("c_custkey"))
        .unionByName(part("orders", "runs", F.concat(F.lit("ord-"), F.col("o_orderkey")), F.unix_micros("o_orderdate")))
        .unionByName(part("lineitem", "signals", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.unix_micros("l_shipdate")))
        .unionByName(part("documents", "snapshots", F.concat(F.lit("doc-"), F.col("doc_id")), F.col("doc_id")))
        .unionByName(part("events", "checkpoints", F.concat(F.lit("event-"), F.col("event_id")), F.unix_micros("ts")))
    )
    limits = {"accounts": 1_000, "runs": 1_000, "signals": 50_000, "snapshots": 10_000, "checkpoints": 5_000}
    # ids count by ones, times by microseconds
    return state.newest_per_collection(records, limits, {"accounts": 1, "snapshots": 1})


AGE_SQL = """
used AS (SELECT l_orderkey AS record_id, max(l_shipdate) AS last_use FROM lineitem GROUP BY ALL),
aged AS (SELECT o_orderkey AS record_id, o_orderdate AS created_at, greatest(o_orderdate, coalesce(last_use, o_orderdate)) AS last_used_at
  FROM orders LEFT JOIN used ON record_id = o_orderkey),
marked AS (SELECT *, last_used_at < TIMESTAMP '2000-06-01' - INTERVAL 90 DAY AS expired FROM aged)"""


def _aged(spark, folder):
    records = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("created_at"))
    uses = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_shipdate").alias("used_at"))
    return state.retention_by_age(records, uses, F.lit("2000-06-01").cast("timestamp"))


@query("retention_by_age", f"WITH {AGE_SQL} SELECT * FROM marked")
def _retain_age(spark, folder):
    return _aged(spark, folder)


@query(
    "retention_cascade",
    f"WITH {AGE_SQL} SELECT l_suppkey, count(*) AS kept FROM lineitem WHERE l_orderkey NOT IN (SELECT record_id FROM marked WHERE expired) GROUP BY ALL",
)
def _cascade(spark, folder):
    children = read_table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "record_id")
    kept = state.cascade_delete(children, _aged(spark, folder).filter("expired"), "record_id")
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("kept"))


@query(
    "retention_policy",
    """WITH RECURSIVE line AS (SELECT 'line-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS record_id, l_orderkey, l_shipdate FROM lineitem),
    rec AS (SELECT 'cust-' || c_custkey AS record_id, 'account' AS kind, NULL::TIMESTAMP AS last_used_at, c_nationkey FROM customer
      UNION ALL SELECT 'ord-' || o_orderkey, 'run', greatest(o_orderdate, coalesce(last_use, o_orderdate)), NULL FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_use FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
      UNION ALL SELECT record_id, 'evidence', l_shipdate, NULL FROM line),
    links AS (SELECT 'cust-' || o_custkey AS parent_id, 'ord-' || o_orderkey AS child_id FROM orders UNION ALL SELECT 'ord-' || l_orderkey, record_id FROM line
      UNION ALL SELECT 'line-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'doc-' || l_orderkey FROM lineitem WHERE l_linenumber = 1),
    all_rec AS (SELECT record_id, kind, last_used_at, c_nationkey FROM rec UNION ALL SELECT 'doc-' || doc_id, 'excerpt', NULL, NULL FROM documents),
    direct AS (SELECT record_id, CASE WHEN kind = 'account' AND c_nationkey < 12 THEN 'scope' WHEN kind IN ('run', 'evidence') AND last_used_at < TIMESTAMP '2000-06-01' - INTERVAL 90 DAY THEN 'age' END AS reason FROM all_rec),
    gone(record_id, depth) AS (SELECT record_id, 0 FROM direct WHERE reason IS NOT NULL UNION SELECT child_id, depth + 1 FROM gone JOIN links ON parent_id = record_id),
    first AS (SELECT record_id, min(depth) AS depth FROM gone GROUP BY ALL)
    SELECT record_id, kind, CASE WHEN depth = 0 THEN reason ELSE 'linked' END AS reason, depth FROM first JOIN all_rec USING (record_id) JOIN direct USING (record_id)""",
)
def _policy(spark, folder):
    """Mappings of accounts, their runs, the runs' evidence and its excerpts: three levels of links."""
    customer, orders, lines = (read_table(spark, folder, name) for name in ("customer", "orders", "lineitem"))
    account, run = F.concat(F.lit("cust-"), F.col("c_custkey")), F.concat(F.lit("ord-"), F.col("o_orderkey"))
    line = F.concat(F.lit("line-"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    never = F.lit(None).cast("timestamp")
    records = (
        customer.select(account.alias("record_id"), F.lit("account").alias("kind"), never.alias("created_at"))
        .unionByName(orders.select(run.alias("record_id"), F.lit("run").alias("kind"), F.col("o_orderdate").alias("created_at")))
        .unionByName(lines.select(line.alias("record_id"), F.lit("evidence").alias("kind"), F.col("l_shipdate").alias("created_at")))
        .unionByName(read_table(spark, folder, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"), F.lit("excerpt").alias("kind"), never.alias("created_at")))
    )
    uses = lines.select(F.concat(F.lit("ord-"), F.col("l_orderkey")).alias("record_id"), F.col("l_shipdate").alias("used_at"))
    scope = customer.select(account.alias("record_id"), (F.lit("2000-04-20").cast("timestamp") + F.make_dt_interval(days=F.col("c_nationkey"))).alias("left_at"))
    links = (
        orders.select(F.concat(F.lit("cust-"), F.col("o_custkey")).alias("parent_id"), run.alias("child_id"))
        .unionByName(lines.select(F.concat(F.lit("ord-"), F.col("l_orderkey")).alias("parent_id"), line.alias("child_id")))
        .unionByName(lines.filter("l_linenumber = 1").select(line.alias("parent_id"), F.concat(F.lit("doc-"), F.col("l_orderkey")).alias("child_id")))
    )
    days = {"run": RECORD_RETENTION_DAYS, "evidence": RECORD_RETENTION_DAYS}
    return state.retention_policy(records, uses, scope, links, F.lit("2000-06-01").cast("timestamp"), days)


# --- ledger -----------------------------------------------------------------------


LEDGER_SQL = """
ledger AS (SELECT 'sig-' || p_partkey AS signal_id, CASE WHEN p_size < 5 THEN TIMESTAMP '2001-10-20' ELSE TIMESTAMP '2001-01-01' END AS reported_at FROM part WHERE p_size < 10),
deliveries AS (SELECT 'call-' || l_suppkey AS call_id, CASE WHEN l_discount = 0 THEN 'bad id' ELSE 'sig-' || l_partkey END AS signal_id,
  l_orderkey * 8 + l_linenumber AS position, l_shipdate AS delivered_at FROM lineitem),
uniq AS (SELECT call_id, signal_id, min(position) AS position, min(delivered_at) AS delivered_at FROM deliveries WHERE signal_id <> 'bad id' GROUP BY ALL),
added AS (SELECT signal_id, min((delivered_at, call_id)) AS f FROM uniq
  WHERE signal_id NOT IN (SELECT signal_id FROM ledger WHERE reported_at >= TIMESTAMP '2001-11-05' - INTERVAL 21 DAY) GROUP BY ALL)"""


def _recorded(spark, folder):
    ledger = read_table(spark, folder, "part").filter("p_size < 10").select(
        F.concat(F.lit("sig-"), F.col("p_partkey")).alias("signal_id"),
        F.when(F.col("p_size") < 5, F.lit("2001-10-20").cast("timestamp")).otherwise(F.lit("2001-01-01").cast("timestamp")).alias("reported_at"),
    )
    deliveries = read_table(spark, folder, "lineitem").select(
        F.concat(F.lit("call-"), F.col("l_suppkey")).alias("call_id"),
        F.when(F.col("l_discount") == 0, "bad id").otherwise(F.concat(F.lit("sig-"), F.col("l_partkey"))).alias("signal_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"),
        F.col("l_shipdate").alias("delivered_at"),
    )
    return state.ledger_record(ledger, deliveries, F.lit("2001-11-05").cast("timestamp"))


@query("ledger_record", f"WITH {LEDGER_SQL} SELECT signal_id, f[1] AS reported_at, f[2] AS call_id FROM added")
def _ledger(spark, folder):
    return _recorded(spark, folder)


@query("ledger_added", f"WITH {LEDGER_SQL} SELECT f[2] AS call_id, count(*) AS added FROM added GROUP BY ALL")
def _added(spark, folder):
    return state.ledger_added(_recorded(spark, folder))
