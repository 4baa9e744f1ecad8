"""Judging in order, redaction at any depth, the composed retention policy."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes, gates, news, state

NOW = datetime(2026, 1, 1)
FRESH = "account_id STRING, item_id STRING, input_ord BIGINT, title STRING, publisher STRING, published_at TIMESTAMP, excerpt STRING"


@pytest.mark.parametrize("frame_rows", [7, 10_000])
def test_an_account_stops_at_its_first_failed_batch(spark, frame_rows):
    rows = [(account, f"{account}{k:02}", k, f"title {k}", "p", NOW, "text") for account in ("a", "b", None) for k in range(34)]
    fresh = spark.createDataFrame(rows, FRESH).repartition(3)

    def judge(batch):
        first = int(batch["item_id"].iloc[0][-2:])
        if list(batch["batch_index"]) != list(range(len(batch))) or [int(x[-2:]) for x in batch["item_id"]] != list(range(first, first + len(batch))):
            raise KeyError("not in order")
        if first and batch.attrs["judged_before"]["item_id"].iloc[0][-2:] != f"{first - 10:02}":
            raise KeyError("what was judged before is missing")
        if batch["account_id"].iloc[0] == "a" and first == 10:
            raise RuntimeError("no answer")
        if batch["account_id"].iloc[0] == "a" and first > 10:
            raise ValueError("asked after a failure")
        return news.rule_judge(batch)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(frame_rows))
    try:
        found = news.judge_batches(fresh, judge).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    errors = pd.Series([r.judge_error or "" for r in found], index=[r.item_id for r in found])
    assert len(errors) == 102 and set(errors[[f"a{k}" for k in range(10, 20)]]) == {"RuntimeError"}
    assert set(errors[[f"a{k}" for k in range(20, 34)]]) == {news.NOT_ASKED} and (errors != "").sum() == 24


def test_redaction_reaches_any_depth(spark):
    secret = "ghp_" + "a1" * 10
    deep = {"a": {"b": [{"c": f"use {secret} now", "token": {"x": 1}}, ["Bearer abcdef", 3, None, True, 2.5]]}, "Password": ["x"], "ok": "a\u0007b ", "raw_request": 1}
    texts = [json.dumps(deep), f"plain {secret}", None, "{broken", json.dumps([1, "key=abc&x=1"]), '"' + "y" * 900 + '"']
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, details STRING")
    got = {r.id: r.safe for r in frame.select("id", gates.redact_json("details").alias("safe")).collect()}
    assert json.loads(got[0]) == {
        "a": {"b": [{"c": "use [REDACTED] now", "token": "[REDACTED]"}, ["[REDACTED]", 3, None, True, 2.5]]}, "Password": "[REDACTED]", "ok": "a b", "raw_request": "[REDACTED]",
    }
    assert (got[1], got[2], got[3]) == ("plain [REDACTED]", None, "{broken")
    assert json.loads(got[4]) == [1, "key=[REDACTED]&x=1"] and len(json.loads(got[5])) == 500
    # a message is masked as by the column rules
    one = frame.filter("id = 1").select(gates.redact_text("details").alias("safe")).first().safe
    assert one == got[1]


def test_the_policy_follows_links_to_their_end(spark):
    old, new = NOW - timedelta(days=200), NOW - timedelta(days=5)
    records = [("acct", "account", None), ("kept", "account", None), ("r1", "run", new), ("e1", "evidence", new), ("x1", "excerpt", None), ("r2", "run", old), ("r3", "run", old), ("e3", "evidence", new), ("loop", "evidence", new)]
    uses = [("r3", NOW - timedelta(days=1)), ("r3", old)]
    scope = [("acct", NOW - timedelta(days=31)), ("kept", NOW - timedelta(days=29)), ("kept", None)]
    links = [("acct", "r1"), ("r1", "e1"), ("e1", "x1"), ("x1", "loop"), ("loop", "r1"), ("kept", "r3"), ("r3", "e3"), ("r2", "e1"), ("r2", "gone"), ("r1", "e1")]
    found = state.retention_policy(
        spark.createDataFrame(records, "record_id STRING, kind STRING, created_at TIMESTAMP"), spark.createDataFrame(uses, "record_id STRING, used_at TIMESTAMP"),
        spark.createDataFrame(scope, "record_id STRING, left_at TIMESTAMP"), spark.createDataFrame(links, "parent_id STRING, child_id STRING"), F.lit(NOW), {"run": 90, "evidence": 90},
    ).collect()
    assert sorted((r.record_id, r.reason, r.depth) for r in found) == [
        ("acct", "scope", 0), ("e1", "linked", 1), ("loop", "linked", 3), ("r1", "linked", 1), ("r2", "age", 0), ("x1", "linked", 2),
    ]


def test_contracts_of_projects_and_postings(spark):
    rows = [("a", "p1", "One"), ("a", "p2", "Two"), ("a", " p2", "Two again"), ("a", "", "No id"), ("a", None, "Null id"), ("a", "p3", " "), ("b", "p2", "Fine")]
    current = spark.createDataFrame(rows, "account_id STRING, project_id STRING, name STRING")
    nothing = current.limit(0)
    headers = spark.createDataFrame([("a",), ("b",)], "account_id STRING")

    def found(contract):
        return sorted((r.account_id, r.project_id or "-") for r in changes.new_projects(current, nothing, nothing, headers, contract).collect())

    assert len(found("ignore")) == 7 and found("quarantine") == [("a", "p1"), ("b", "p2")]
    with pytest.raises(ValueError, match="contract breached"):
        found("strict")
    with pytest.raises(ValueError, match="contract must be"):
        found("lax")
    jobs = spark.createDataFrame([("a", "j1", ["x"]), ("a", "j1", ["y"]), ("a", "j2", ["z"]), ("b", "j1", ["x"])], "account_id STRING, job_identity STRING, job_aliases ARRAY<STRING>")
    kept = changes.new_jobs(jobs, jobs.limit(0), headers, "quarantine").collect()
    assert sorted((r.account_id, r.job_identity) for r in kept) == [("a", "j2"), ("b", "j1")]
    with pytest.raises(ValueError, match="contract breached"):
        changes.new_jobs(jobs, jobs.limit(0), headers, "strict")
