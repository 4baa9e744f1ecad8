"""The review of rankings and the novelty of postings, each with one meeting by account."""

import random
from datetime import datetime, timedelta

import pytest

from tests.test_changes import jobs
from tests.test_signals_and_state import frame, signal
from tidemark.operators import changes, evaluate, ranking
from tidemark.session import prepare
from tidemark.sources.tables import TABLE_SCHEMAS
from workload import queries, schedule_queries, views  # noqa: F401
from workload.registry import QUERIES


def dealings(spark, make):
    """How often the plan deals rows by a key, where no side is small enough to be sent whole."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def some_signals(spark, n=160):
    pick = random.Random(7)
    rows = []
    for k in range(n):
        account = pick.choice(["a", "b", "c", None])
        category = pick.choice(["new_project", "consumption_growth", "it_hiring", "it_company_news"])
        title = pick.choice(["New SDK", "Results", "Cloud engineer", "Website redesign"])
        row = list(signal(k, account, category, pick.choice(["manual", "careers_page", "ats_feed"]), title, confidence=pick.choice([0.2, 0.9]), days=pick.randrange(5), attributes={"projectId": f"p{pick.randrange(12)}"}))
        if account == "c":
            row[13] = None  # its scores are null
        rows.append(tuple(row))
    return frame(spark, *rows)


LABELS = "case_id STRING, signal_id STRING, relevant BOOLEAN"
CONFIGS = [
    evaluate.PilotConfig("one", threshold=40.0, ranking=ranking.RankingConfig(max_opportunities=1)),
    evaluate.PilotConfig("three", ranking=ranking.RankingConfig(recency=0, confidence=30, max_opportunities=3)),
    evaluate.PilotConfig("off", enabled=False),
]


def test_review_equals_the_ranking_step_by_step(spark):
    signals = some_signals(spark).cache()
    labels = spark.createDataFrame([(f"c{k}", f"s{k % 150}", k % 3 == 0) for k in range(170)] + [("x", "nowhere", True)], LABELS)
    as_of = ranking.newest_observation(signals)
    events = ranking.event_dedupe(signals).cache()
    expected = set()
    for c in CONFIGS:
        ranked = ranking.rank_opportunities(ranking.opportunity_score(ranking.opportunity_features(events), c.ranking, as_of), c.ranking)
        kept = {(r.account_id, r.theme): r for r in ranked.collect() if r.retained and c.enabled and r.account_id is not None}
        of = {e.representative_id: kept.get((e.account_id, e.theme)) for e in events.collect()}
        for label in labels.collect():
            if label.signal_id != "nowhere":
                o = of.get(label.signal_id)
                score = o.score if o else None
                expected.add((c.name, label.case_id, o.opportunity_id if o else None, score, score is not None and score >= c.threshold))
    found = evaluate.pilot_cases(signals, labels, CONFIGS).collect()
    assert len(found) == 510 and {(r.config, r.case_id, r.opportunity_id, r.score, r.selected) for r in found} == expected
    assert any(e[2] is not None and e[3] is None for e in expected)
    # signals that are named beside change nothing
    named = signals.join(labels, "signal_id", "left_semi")
    assert {tuple(r) for r in evaluate.pilot_cases(signals, labels, CONFIGS, named=named).collect()} == {tuple(r) for r in found}


def test_review_deals_signals_by_account_once(spark):
    signals = some_signals(spark, 4)
    labels = spark.createDataFrame([("c1", "s1", True)], LABELS)
    # signals by account; representatives, labels and the signals they name by signal
    assert dealings(spark, lambda: evaluate.pilot_cases(signals, labels, CONFIGS)) == 4


def test_new_jobs_meet_by_account_once(spark):
    previous = jobs(spark, {"provider_id": "R-1"})
    headers = spark.createDataFrame([("a",)], "account_id STRING")
    # distinct headers, then all rows
    assert dealings(spark, lambda: changes.new_jobs(jobs(spark, {"provider_id": "R-2"}), previous, headers)) == 2


def test_new_jobs_with_nulls_and_repeated_rows(spark):
    row = "account_id STRING, job_identity STRING, job_aliases ARRAY<STRING>, title STRING"
    current = spark.createDataFrame(
        [
            ("a", "i1", ["i1", "u1"], "twice"), ("a", "i1", ["i1", "u1"], "twice"),
            ("a", "i2", ["i2", "u2"], "known by one row"), ("a", "i2", ["i2", "u9"], "goes with it"),
            ("a", None, ["u2"], "known, but nobody"), ("a", "i3", [], "no alias"), ("a", "i4", None, "null aliases"),
            (None, "i5", ["u5"], "no account"), ("b", "i6", ["u2"], "no baseline"),
        ], row,
    )
    previous = spark.createDataFrame([("a", "o", ["u2", "u2"], "old"), (None, "o", ["u5"], "old"), ("b", "o", ["u7"], "old")], row)
    headers = spark.createDataFrame([("a",), ("a",), (None,)], "account_id STRING")
    found = sorted(r.title for r in changes.new_jobs(current, previous, headers).collect())
    assert found == ["known, but nobody", "no alias", "null aliases", "twice", "twice"]


def pilot_tables(spark, folder, last_order):
    """Repeated line items, orders and labels, null keys; the newest line item is of ``last_order``."""
    pick = random.Random(3)
    day = datetime(2024, 1, 1)
    items = []
    for k in range(120):
        row = (pick.randrange(12), pick.randrange(8), pick.randrange(3), pick.randrange(1, 8), float(pick.randrange(1, 50)), 1.0, 0.05, pick.choice([0.0, 0.08]), pick.choice("ANR"), pick.choice("OF"), day + timedelta(days=pick.randrange(4)))
        items += [row] * pick.choice([1, 1, 1, 2])
    items += [(None, 1, 1, 1, *row[4:]), (1, None, 1, 1, *row[4:]), (1, 1, None, 1, *row[4:]), (1, 1, 1, None, *row[4:]), (1, 2, -5, 1, *row[4:])]
    items.append((last_order, 1, 1, 2, *row[4:10], day + timedelta(days=9)))
    orders = [(k, k % 3, "F", 1.0, day, "1-URGENT") for k in range(12)] + [(2, 1, "F", 1.0, day, "2-HIGH"), (3, 0, "F", 1.0, day, "1-URGENT"), (4, None, "F", 1.0, day, None), (None, 1, "F", 1.0, day, "2-HIGH")]
    labels = [(0, 1, 0), (1, 0, 0), (2, 1, 0), (2, 0, 1), (3, None, 0), (4, 1, 0), (4, 1, 0), (None, 1, 0), (900, 1, 0)]
    for name, rows in (("lineitem", items), ("orders", orders), ("labels", labels)):
        spark.createDataFrame(rows, TABLE_SCHEMAS[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("last_order", [5, 77])
def test_pilot_queries_deal_labelled_signals_once(spark, tmp_path, last_order):
    folder = str(tmp_path)
    pilot_tables(spark, folder, last_order)
    prepare(spark)
    every = views.signals(spark, folder).cache()
    # the newest line item decides only with an order
    assert every.agg({"observed_at": "max"}).first()[0].day == (10 if last_order == 5 else 4)
    part = schedule_queries.labelled_part("signal_id").try_cast("bigint")
    named = every.select("signal_id", part.alias("doc_id")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    labels = named.selectExpr("signal_id as case_id", "signal_id", "quality = 1 as relevant")
    columns = ["signal_id", "category", "relevant", "opportunity_id", "score", "selected", "outcome"]
    expected = evaluate.pilot_cases(every, labels, [schedule_queries.SWEEP[1]], normalize=False).select(columns)
    found = QUERIES["pilot_cases"](spark, folder)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert found.where("score is not null").count() > 0
    # no side is small here: labelled items and orders by their keys, items by part, signals by account and cases by signal, each once
    assert dealings(spark, lambda: QUERIES["pilot_cases"](spark, folder)) == 14
    config = schedule_queries.SWEEP[1]
    row = QUERIES["pilot_evaluate"](spark, folder).first()
    assert row == evaluate.pilot_metrics(expected.selectExpr(f"'{config.name}' as config", "outcome"), 2).first()
