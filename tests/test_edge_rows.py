"""Rows that a join, a cap or a clash of names would lose."""

import sys
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import changes, greedy, news, state, usage
from tidemark.streaming import jobs

NOW = datetime(2026, 1, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_names_of_other_scripts_hide_no_name(spark):
    watched = spark.createDataFrame(
        [("a", "株式会社", ["Acme Robotics"]), ("b", "Beta", ["東京", "Acme Robotics", None]), ("c", "東京", []), ("d", "Zeta Works", None)],
        "account_id string, search_name string, aliases array<string>",
    )
    items = spark.createDataFrame([(x, "Acme Robotics opens a plant 東京") for x in "abcd"], "account_id string, title string")
    got = {r["account_id"]: r["mentioned"] for r in news.mentions_account(items, watched, "title").collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


ITEMS = "account_id string, item_id string, input_ord long, title string, publisher string, published_at timestamp, excerpt string"


def judged_items(spark, n):
    return spark.createDataFrame([("a", f"n{k}", k, f"Acme opens plant number {k}", "p", NOW, "x") for k in range(n)], ITEMS)


def verdict(batch, ids, impact="opportunity"):
    rows = batch[batch["item_id"].isin(ids)]
    return pd.DataFrame({
        "account_id": rows["account_id"], "item_id": rows["item_id"], "about_account": True, "dated_event": True, "duplicate_of": None, "repeats_known_event": False,
        "impact": impact, "confidence": "high", "evidence": rows["title"], "what_happened": rows["title"], "why_it_matters": "Because.", "next_step": "",
    })


def test_items_count_once_with_or_without_a_verdict(spark):
    def judge(batch):
        told = [f"n{k}" for k in range(10) if k != 3]  # n3 is left out, n4 is judged twice
        return pd.concat([verdict(batch, told), verdict(batch, ["n4"], "neutral")])

    items = judged_items(spark, 10)
    events = news.material_events(news.judge_batches(items, judge), items).collect()
    assert {r["item_id"]: r["material"] for r in events} == {f"n{k}": k != 3 for k in range(10)} and len(events) == 10


def test_foreign_verdicts_are_reduced_by_their_order(spark):
    items = judged_items(spark, 2)
    made = news.judge_batches(items, lambda batch: verdict(batch, ["n0", "n1"]))
    twice = made.withColumn("verdict_ord", F.lit(1)).unionByName(made.withColumn("impact", F.lit("neutral")).withColumn("verdict_ord", F.lit(0)))
    assert [r["material"] for r in news.material_events(twice, items).collect()] == [False, False]


def test_failed_batches_stay_unjudged_and_known_events_reach_the_judge(spark):
    told = spark.createDataFrame(
        [("a", "Old", "material", "It happened"), ("a", "Dull", "neutral", None), ("b", "Else", "material", "No")],
        "account_id string, title string, verdict string, event_text string",
    )

    def judge(batch):
        if "n12" in set(batch["item_id"]):
            raise RuntimeError
        assert batch.attrs["known_events"] == [{"title": "Old", "what_happened": "It happened"}]
        return verdict(batch, list(batch["item_id"]))

    items = judged_items(spark, 25)
    made = news.judge_batches(items, judge, state=told)
    events = {r["item_id"]: r["material"] for r in news.material_events(made, items).collect()}
    # the account stops at its second batch, the third is not asked about
    assert events == {f"n{k}": True for k in range(10)}


POSTING = "account_id string, job_id string, title string, department string, location string, url string, posted_at timestamp, input_ord long"


def test_accounts_without_a_fetch_keep_their_jobs(spark):
    jobs_before = spark.createDataFrame([("a", "1", "t", None, None, None, NOW, 1), ("b", "2", "t", None, None, None, NOW, 2)], POSTING)
    fetches = spark.createDataFrame([("a", "failed")], "account_id string, fetch_status string")
    got = changes.careers_carry_forward(fetches, jobs_before.limit(0), jobs_before).collect()
    assert sorted((r["account_id"], r["fetch_status"], r["carried"]) for r in got) == [("a", "failed", True), ("b", None, True)]


def test_null_keys_conflict_with_nothing(spark):
    rows = [(1, "g", 1, None, "x"), (2, "g", 2, None, "x"), (3, "g", 3, "u", None), (4, "g", 4, "u", None), (5, None, 5, "u", "x"), (6, None, 6, "u", "y")]
    frame = spark.createDataFrame(rows, "id long, g string, ord long, a string, b string")
    got = {r["id"]: r["kept"] for r in greedy.first_by_two_keys(frame, "g", "id", "ord", "a", "b").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_shared_teams_count_for_nobody(spark):
    usage_rows = spark.createDataFrame([("t1", 1.0), ("t2", 2.0)], "team_id string, quantity double")
    bridge = spark.createDataFrame([("a", "t1", True), ("b", "t1", True), ("a", "t2", True), ("b", "t2", False)], "account_id string, team_id string, verified boolean")
    mapped, left_out = changes.resolve_usage_teams(usage_rows, bridge)
    assert [(r["team_id"], r["account_id"]) for r in mapped.collect()] == [("t2", "a")]
    assert [tuple(r) for r in left_out.collect()] == [("t1", 1)]


def test_a_call_records_all_its_ids(spark):
    calls = spark.createDataFrame([("c", f"sig-{k}", k, NOW) for k in range(250)], "call_id string, signal_id string, position long, delivered_at timestamp")
    empty = spark.createDataFrame([], "signal_id string, reported_at timestamp")
    assert state.ledger_record(empty, calls, F.lit(NOW)).count() == 250
    assert state.ledger_record(empty, calls, F.lit(NOW), ids_per_call=100).count() == 100


def test_long_comparisons_are_refused_not_cut():
    window = {"start": NOW, "end": NOW + timedelta(days=90)}
    with pytest.raises(ValueError):
        usage.UsageWindows(**window, comparison_days=60)
    longer = usage.UsageWindows(**window, comparison_days=60, max_comparison_days=90)
    assert longer.comparison_start == longer.start_at - timedelta(days=60)


USAGE = "account_id string, metric string, value double, unit string, observed_at timestamp, received_at timestamp"


@pytest.mark.parametrize(("mode", "expected"), [("reject", 1_005_000.0), ("allow", 1_105_000.0)])
def test_stream_and_batch_usage_agree(spark, tmp_path, mode, expected):
    first = NOW
    rows = [
        ("a", "m", 1.0, "KB", first, first), ("a", "m", 1.0, "MB", first + timedelta(hours=1), first + timedelta(hours=1)),
        ("a", "m", 5.0, "KB", first, first + timedelta(hours=1, minutes=30)),  # received later for the first instant
        ("a", "m", 100.0, "KB", first + timedelta(hours=2), first + timedelta(hours=30)),  # late
    ]
    tail = [("a", "m", 1.0, "KB", first + timedelta(days=20), first + timedelta(days=20))]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (rows, tail):
        spark.createDataFrame(part, USAGE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(USAGE).parquet(source)
        jobs.run_available(jobs.stream_usage(stream, late_data=mode).writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)
    got = spark.read.parquet(out).collect()
    assert [(r["value"], r["unit"]) for r in got] == [(expected, "bytes")]
    frame = spark.createDataFrame(rows, USAGE)
    late = jobs.late_usage(frame, late_data=mode)
    kept = frame.exceptAll(late)
    batch = usage.latest_points(usage.usage_measures(kept))
    assert batch.agg(F.sum("value")).first()[0] == expected
    assert late.count() + kept.count() == len(rows)


def test_batches_of_an_independent_judge_are_dealt_apart(spark):
    rows = [("a" if k % 7 else None, f"i{k:03}", 9000 * k if k % 11 else None, None if k == 45 else f"launch {k}", "p", None, None) for k in range(120)]
    items = spark.createDataFrame(rows, "account_id STRING, item_id STRING, input_ord BIGINT, title STRING, publisher STRING, published_at TIMESTAMP, excerpt STRING")

    def judge(batch):
        if (batch["title"].isna()).any():
            raise ValueError("no title")
        return news.rule_judge(batch).assign(what_happened=" ".join(batch["item_id"]))

    def found(judge):
        return news.judge_batches(items, judge)

    one_by_one = sorted(map(tuple, found(judge).collect()), key=repr)
    judge.independent = True
    apart = found(judge)
    assert sorted(map(tuple, apart.collect()), key=repr) == one_by_one
    assert {r.judge_error for r in apart.collect()} == {None, "ValueError", news.NOT_ASKED}
    # no task takes an account: the sequential way deals by account alone
    assert "verdicts" in apart.inputFiles()[0]


def test_settings_for_long_texts_give_way_to_others(spark):
    from tidemark.session import TEXT_CONF, prepare

    before = {key: spark.conf.get(key) for key in TEXT_CONF}
    try:
        for key, (default, _) in TEXT_CONF.items():
            spark.conf.set(key, default)
        prepare(spark)
        assert {key: spark.conf.get(key) for key in TEXT_CONF} == {key: value for key, (_, value) in TEXT_CONF.items()}
        for key in TEXT_CONF:
            spark.conf.set(key, "77")
        prepare(spark)
        assert {spark.conf.get(key) for key in TEXT_CONF} == {"77"}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
