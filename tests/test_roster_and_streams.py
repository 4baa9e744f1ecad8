from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import roster
from tidemark.streaming import jobs

ROWS = "row_index BIGINT, source_record_id STRING, name STRING, domains ARRAY<STRING>, careers_url STRING, linkedin_url STRING, owner_name STRING, owner_role STRING, source_owner_id STRING"


def test_roster(spark):
    rows = [
        (0, "001", "Acme", ["https://www.Acme.example/", "bad"], "https://acme.example/jobs#x", None, "Ann", "AE", "o1"),
        (1, " 001 ", "Acme", ["shop.acme.example", "acme.example"], None, None, "Bob", "SA", "o2"),
        (2, "002", "Beta", ["beta.example"], "nope", None, "Ann", "intern", "o1"),
        (3, "003", "Gamma", ["gamma.example"], None, None, "Ann", "AE", "o1"),
        (4, "003", "Gamma Inc", ["gamma.example"], None, None, "Ann", "AE", "o1"),
        (5, "", "No id", ["x.example"], None, None, "Ann", "AE", "o1"),
        (6, "004", "Named", ["n.example"], "ftp://n.example", None, "Known Person", None, None),
        (7, "005", "Named", ["n.example"], None, None, "Known Person", "SA", None),
        (8, "006", "Nothing", [" ", "x"], None, None, "Ann", "AE", "o1"),
    ]
    result = roster.roster_normalize(spark.createDataFrame(rows, ROWS), {"known person": "account_executive"})
    accounts = {r.source_record_id: r for r in result.accounts.collect()}
    assert set(accounts) == {"001", "004"} and accounts["001"].careers_url == "https://acme.example/jobs"
    domains = [r.domain for r in result.domains.filter(F.col("account_id") == accounts["001"].account_id).orderBy("first_row", "first_pos").collect()]
    assert domains == ["acme.example", "shop.acme.example"]
    assert result.owners.filter(F.col("account_id") == accounts["001"].account_id).count() == 2
    warnings = sorted((r.row_index, r.code) for r in result.warnings.collect())
    assert warnings == [(0, "invalid_domain"), (2, "unmapped_owner"), (4, "conflicting_account_field"), (5, "missing_source_record_id"), (6, "invalid_url"), (7, "unmapped_owner"), (8, "invalid_domain"), (8, "missing_domain")]


USAGE = "account_id STRING, metric STRING, value DOUBLE, unit STRING, observed_at TIMESTAMP, received_at TIMESTAMP"


def stage(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_usage_buckets_are_final_once(spark, tmp_path):
    first = datetime(2026, 1, 1)
    days = [("a", "m", 1.0, "requests", first + timedelta(hours=h), first + timedelta(hours=h)) for h in range(72)]
    slow = [("a", "m", 100.0, "requests", first + timedelta(hours=30), first + timedelta(hours=60))]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (days[:36], days[36:] + slow):
        writer = jobs.stream_usage(stage(spark, source, part, USAGE)).writeStream.outputMode("append").format("parquet").option("path", out)
        jobs.run_available(writer, checkpoint)
    found = spark.read.parquet(out).orderBy("bucket_start").collect()
    assert [(r.value, r.points) for r in found] == [(24.0, 24), (24.0, 24)]
    assert jobs.late_usage(spark.createDataFrame(slow, USAGE)).count() == 1


def test_replayed_delivery_batch_changes_nothing(spark, tmp_path):
    schema = "signal_id BIGINT, signal_at TIMESTAMP"
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    handle = jobs.deliver_undelivered(ledger, out)
    first = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 1))], schema)
    second = spark.createDataFrame([(2, datetime(2026, 1, 1)), (3, datetime(2026, 1, 2))], schema)
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        handle(batch, batch_id)
    assert sorted(r.signal_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert spark.read.parquet(ledger).count() == 3


@pytest.mark.parametrize("name", ["usage_series", "rank_opportunities", "new_jobs", "careers_diff", "previous_baseline", "run_metrics", "intent_signal_brief", "robots_filter", "project_inventory"])
def test_plans_have_no_cross_joins(spark, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_window_reaches_the_scan_and_top_k_is_limited_early(spark):
    from __spark_entry__ import queries

    plan = queries()["snapshot_build"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
    brief = queries()["intent_signal_brief"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in brief and "Partial" in brief


def test_every_query_has_an_entry_and_entry_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 75
    assert entry(spark).count() > 0


def test_live_sessions_only_get_modifiable_settings(spark):
    from tidemark.session import RUNTIME_CONF, prepare

    assert all(spark.conf.isModifiable(key) for key in RUNTIME_CONF)
    prepare(spark)
