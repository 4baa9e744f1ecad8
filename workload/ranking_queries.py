"""Themes, events, scores, summaries and digests over the signals view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ranking
from workload.registry import query
from workload.views import EVENTS_SQL, SCORED_SQL, SIGNALS_SQL, signals, sql_theme


def _signals(spark, folder):
    return signals(spark, folder)


@query(
    "opportunity_theme",
    f"""WITH {SIGNALS_SQL}, themed AS (SELECT signal_id, category, {sql_theme()} AS theme
      FROM (SELECT *, lower(title || ' ' || detail || ' ' || summary || ' ') AS txt FROM signals))
    SELECT signal_id, category, theme FROM themed""",
)
def _theme(spark, folder):
    return ranking.with_theme(_signals(spark, folder), normalize=False).select("signal_id", "category", "theme")


@query(
    "event_dedupe",
    f"WITH {EVENTS_SQL} SELECT account_id, theme, category, representative_id, observed_at, source_system, confidence, magnitude, signals, first_ord FROM event",
)
def _event_dedupe(spark, folder):
    return ranking.event_dedupe(_signals(spark, folder), normalize=False).drop("event_key")


@query(
    "opportunity_score",
    f"WITH {SCORED_SQL} SELECT account_id, theme, opportunity_id, latest_category, systems, events, signals, score FROM scored",
)
def _score(spark, folder):
    scored = ranking.score_signals(_signals(spark, folder), normalize=False)
    return scored.select("account_id", "theme", "opportunity_id", "latest_category", "systems", "events", "signals", "score")


@query(
    "rank_opportunities",
    f"""WITH {SCORED_SQL}
    SELECT account_id, max(score) FILTER (opportunity_rank <= 5) AS best_score, count(*) FILTER (opportunity_rank <= 5) AS opportunities,
      count(*) FILTER (opportunity_rank > 5) AS omitted_opportunities,
      coalesce(string_agg(opportunity_id, ',' ORDER BY opportunity_rank) FILTER (opportunity_rank > 5), '') AS omitted_ids,
      coalesce(sum(signals) FILTER (opportunity_rank > 5), 0)::BIGINT AS omitted_signals FROM ranked GROUP BY account_id""",
)
def _rank(spark, folder):
    return ranking.ranked_accounts(ranking.rank_opportunities(ranking.score_signals(_signals(spark, folder), normalize=False)))


_SUMMARY_SQL = f"""{SIGNALS_SQL},
summary AS (SELECT account_id, min(account_name) AS account_name,
   least(100, coalesce(sum(w) FILTER (direction = 'expansion'), 0))::BIGINT AS expansion_score,
   least(100, coalesce(sum(w) FILTER (direction = 'risk'), 0))::BIGINT AS risk_score, max(observed_at) AS latest_signal_at,
   count(*) FILTER (direction = 'expansion') AS expansion_signals, count(*) FILTER (direction = 'risk') AS risk_signals,
   count(*) FILTER (direction = 'neutral') AS neutral_signals
  FROM (SELECT *, CASE severity WHEN 'info' THEN 15 WHEN 'warning' THEN 30 ELSE 50 END AS w FROM signals) GROUP BY account_id)"""


@query("account_summary", f"WITH {_SUMMARY_SQL} SELECT * FROM summary")
def _summary(spark, folder):
    return ranking.account_summary(_signals(spark, folder))


@query("summary_signals", f"WITH {SIGNALS_SQL} SELECT account_id, direction, observed_at, signal_id, title, severity FROM signals")
def _summary_signals(spark, folder):
    return ranking.summary_signals(_signals(spark, folder))


@query("signal_digest", f"WITH {_SUMMARY_SQL} SELECT *, greatest(risk_score, expansion_score) AS strength FROM summary")
def _digest(spark, folder):
    return ranking.signal_digest(ranking.account_summary(_signals(spark, folder)))


_FINDINGS_SQL = f"""{SCORED_SQL},
found AS (SELECT e.account_id, e.theme, r.opportunity_id, representative_id AS signal_id, account_name, title, severity, observed_at,
    source_url AS url, CAST(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END * 100 + floor(confidence * 10 + 0.5) AS BIGINT) AS finding_score
  FROM event e JOIN ranked r USING (account_id, theme) WHERE opportunity_rank <= 5),
placed AS (SELECT *, row_number() OVER (ORDER BY finding_score DESC, observed_at DESC, account_name, signal_id) AS finding_rank FROM found),
firsts AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY finding_rank) AS rn FROM placed WHERE url IS NOT NULL)"""


@query(
    "digest_findings",
    f"""WITH {_FINDINGS_SQL}
    SELECT account_id, signal_id, account_name, title, severity, finding_score, observed_at, url, finding_rank,
      row_number() OVER (ORDER BY finding_rank) AS display_rank FROM firsts WHERE rn = 1 ORDER BY finding_rank LIMIT 3""",
)
def _digest_findings(spark, folder):
    return ranking.digest_findings(ranking.findings(_signals(spark, folder), normalize=False))


@query(
    "digest_totals",
    f"""WITH {_FINDINGS_SQL}
    SELECT count(DISTINCT account_id) AS covered_accounts, count(DISTINCT account_id) AS total_accounts,
      least(3, count(DISTINCT account_id) FILTER (url IS NOT NULL)) AS shown,
      count(*) FILTER (url IS NOT NULL) - least(3, count(DISTINCT account_id) FILTER (url IS NOT NULL)) AS further_findings,
      count(*) FILTER (url IS NULL) AS unlinked_findings, 'Status: PARTIAL — 2 source failures' AS status_label FROM found""",
)
def _digest_totals(spark, folder):
    found = ranking.findings(_signals(spark, folder), normalize=False)
    return ranking.digest_totals(found, run_status="partial", run_errors=2)
