from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import usage
from tidemark.operators.usage import GrowthConfig, UsageWindows

START, END = datetime(2026, 1, 8), datetime(2026, 1, 15)
SCHEMA = "account_id STRING, metric STRING, grain STRING, value DOUBLE, unit STRING, observed_at TIMESTAMP, received_at TIMESTAMP"


def daily(account, values, first=datetime(2026, 1, 1), unit="requests", delay=timedelta(0)):
    return [(account, "requests", None, float(v), unit, first + timedelta(days=d), first + timedelta(days=d) + delay) for d, v in enumerate(values)]


def series(spark, rows, expected=None, **options):
    settings = {"current_finality": "final", "comparison_finality": "final", **options}
    config = UsageWindows(START, END, **settings)
    accounts = spark.createDataFrame([(a,) for a in expected], "account_id STRING") if expected else None
    found = usage.usage_series(spark.createDataFrame(rows, SCHEMA), config, accounts).collect()
    return {(r.account_id, r.metric): r for r in found}


def test_statuses(spark):
    rows = daily("stable", [10] * 14) + daily("rising", [10] * 7 + [20] * 7) + daily("sparse", [10], datetime(2026, 1, 9)) + daily("zero", [0] * 7 + [5] * 7)
    found = series(spark, rows, expected=["stable", "silent"])
    assert found["stable", "requests"].status == "stable" and found["stable", "requests"].change_ratio == 0
    assert found["rising", "requests"].status == "rising" and found["rising", "requests"].change_ratio == 1
    assert found["sparse", "requests"].status == "sparse" and found["sparse", "requests"].previous_value is None
    assert found["zero", "requests"].status == "incomplete" and found["zero", "requests"].change_ratio is None
    missing = found["silent", "consumption"]
    assert missing.status == "missing" and missing.current_value is None and missing.unit == "unknown"


def test_not_final_is_incomplete(spark):
    found = series(spark, daily("a", [10] * 14), current_finality="provisional")
    assert found["a", "requests"].status == "incomplete"


def test_latest_receipt_wins_and_ties_go_to_smaller_text(spark):
    when = datetime(2026, 1, 9)
    rows = [("a", "requests", None, 2.0, "requests", when, when), ("a", "requests", None, 3.0, "requests", when, when + timedelta(hours=1))]
    rows += [("b", "requests", None, 10.0, "requests", when, when), ("b", "requests", None, 9.0, "requests", when, when)]
    found = series(spark, rows)
    assert found["a", "requests"].current_value == 3
    assert found["b", "requests"].current_value == 10  # "10" < "9" as text


def test_units_and_lateness(spark):
    first = datetime(2026, 1, 9)
    rows = [("a", "io", None, 2.0, "KB", first, first + timedelta(hours=28)), ("a", "io", None, 1.0, " MB ", first + timedelta(days=1), first + timedelta(days=1))]
    row = series(spark, rows)["a", "io"]
    assert (row.current_value, row.unit) == (1_002_000, "bytes")
    assert (row.late_points, row.max_latency_ms, row.average_latency_ms) == (1, 100_800_000, 50_400_000)


def test_incompatible_units_fail(spark):
    rows = daily("a", [1], START) + daily("a", [1], START + timedelta(days=1), unit="KB")
    with pytest.raises(Exception, match="incompatible units"):
        series(spark, rows)


def test_strict_gate_raises_and_quarantine_keeps_reasons(spark):
    rows = daily("a", [1, -1, 2], START) + daily("b", [3], START, delay=timedelta(hours=-1)) + daily("c", [1], START) + daily("c", [1], START, unit="KB")
    frame = spark.createDataFrame(rows, SCHEMA)
    config = UsageWindows(START, END)
    good, bad = usage.usage_row_gate(frame, config)
    assert {r.account_id for r in good.collect()} == {"a"}
    assert sorted(r.violations[0] for r in bad.collect()) == ["mixed_units", "mixed_units", "received_at", "value"]
    with pytest.raises(Exception, match="invalid usage row"):
        usage.usage_row_gate(frame, config, mode="strict")[0].collect()


def test_window_rules():
    with pytest.raises(ValueError):
        UsageWindows(END, START)
    with pytest.raises(ValueError):
        UsageWindows("2024-01-01T00:00:00Z", "2026-01-01T00:00:00Z")
    assert UsageWindows(START, START + timedelta(days=2)).comparison_start == UsageWindows(START, END).start_at - timedelta(days=2)


def window(start, days, value, completeness=1.0, complete=True, late=None):
    return (start, start + timedelta(days=days), float(value), completeness, complete, None, late)


CASES = {
    "detected": (window(datetime(2026, 1, 1), 7, 100), window(START, 7, 150), {}),
    "below_threshold": (window(datetime(2026, 1, 1), 7, 100), window(START, 7, 150), {"minimum_absolute": 60}),
    "window_mismatch": (window(datetime(2026, 1, 1), 6, 100), window(START, 6, 150), {}),
    "incomplete_data": (window(datetime(2026, 1, 1), 7, 100, 0.5), window(START, 7, 150), {}),
    "late_data": (window(datetime(2026, 1, 1), 7, 100), window(START, 7, 150, late=True), {}),
    "tiny_base": (window(datetime(2026, 1, 1), 7, 1), window(START, 7, 150), {}),
    "invalid_input": (window(datetime(2026, 1, 1), 7, -1), window(START, 7, 150), {}),
}
WINDOW = "STRUCT<start: TIMESTAMP, end: TIMESTAMP, value: DOUBLE, completeness: DOUBLE, complete: BOOLEAN, received_at: TIMESTAMP, late: BOOLEAN>"
PAIR = f"account_id STRING, account_name STRING, source_system STRING, source_record_id STRING, source_url STRING, collected_at TIMESTAMP, metric_name STRING, unit STRING, previous {WINDOW}, current {WINDOW}"


def pair(spark, previous, current):
    return spark.createDataFrame([("acct", "Acme", "usage_metrics", "r1", None, END, "requests", "requests", previous, current)], PAIR)


@pytest.mark.parametrize("reason", CASES)
def test_growth_reasons(spark, reason):
    previous, current, options = CASES[reason]
    assert usage.consumption_growth(pair(spark, previous, current), GrowthConfig(**options)).first().reason == reason


def test_unverified_completeness_is_not_complete(spark):
    found = usage.consumption_growth(pair(spark, window(datetime(2026, 1, 1), 7, 100, complete=None), window(START, 7, 150)))
    assert found.first().reason == "incomplete_data"


def test_growth_signal_fields_and_determinism(spark):
    previous, current, _ = CASES["detected"]
    frame = pair(spark, previous, current)
    one, two = (usage.growth_signals(usage.consumption_growth(frame)).first() for _ in range(2))
    assert one.signal_id == two.signal_id and one.detail == "requests increased from 100 to 150 requests (50.0%, +50)."
    assert one.confidence == 1 and len(one.evidence) == 2 and one.received_at == END


def test_partitioning_does_not_change_the_series(spark):
    rows = daily("a", range(14)) + daily("b", range(14, 28))
    frame = spark.createDataFrame(rows, SCHEMA)
    config = UsageWindows(START, END, current_finality="final", comparison_finality="final")
    one = usage.usage_series(frame.coalesce(1), config).orderBy("account_id").collect()
    many = usage.usage_series(frame.orderBy(F.rand(7)).repartition(7), config).orderBy("account_id").collect()
    assert one == many
