"""Usage series, growth and the flagship chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import usage
from tidemark.operators.usage import GrowthConfig, UsageWindows
from tidemark.plans.growth import growth_opportunities
from tidemark.sources.tables import read_table
from workload.registry import query
from workload.views import USAGE_ROWS_SQL, sql_iso, sql_stable_id, usage_rows

WINDOWS = UsageWindows(
    start="2024-01-15T00:00:00Z", end="2024-01-22T00:00:00Z", interval_hours=84,
    current_finality="final", comparison_finality="final",
)

POINTS_SQL = f"""{USAGE_ROWS_SQL},
scaled AS (SELECT account_id, metric, observed_at, date_trunc('millisecond', received_at) AS received_at,
    value * CASE unit WHEN 'KB' THEN 1000 WHEN 'MB' THEN 1000000 ELSE 1 END AS value,
    CASE WHEN unit IN ('KB', 'MB') THEN 'bytes' ELSE unit END AS unit
  FROM usage_rows WHERE observed_at >= TIMESTAMP '2024-01-08' AND observed_at < TIMESTAMP '2024-01-22'),
point AS (SELECT * EXCLUDE rn, epoch_ms(received_at) - epoch_ms(observed_at) AS latency_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, metric, observed_at ORDER BY received_at DESC,
    CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END, unit) AS rn
  FROM scaled) WHERE rn = 1)"""

SERIES_SQL = f"""{POINTS_SQL},
total AS (SELECT account_id, metric, min(unit) AS unit,
    sum(value) FILTER (observed_at >= TIMESTAMP '2024-01-15') AS current_value,
    sum(value) FILTER (observed_at < TIMESTAMP '2024-01-15') AS previous_value,
    count(DISTINCT (epoch_ms(observed_at) - epoch_ms(TIMESTAMP '2024-01-15')) // 302400000) FILTER (observed_at >= TIMESTAMP '2024-01-15') AS observed_points,
    count(DISTINCT (epoch_ms(observed_at) - epoch_ms(TIMESTAMP '2024-01-08')) // 302400000) FILTER (observed_at < TIMESTAMP '2024-01-15') AS previous_observed_points,
    count(*) FILTER (observed_at >= TIMESTAMP '2024-01-15' AND latency_ms > 0) AS late_points,
    avg(latency_ms) FILTER (observed_at >= TIMESTAMP '2024-01-15') AS average_latency_ms,
    max(latency_ms) FILTER (observed_at >= TIMESTAMP '2024-01-15') AS max_latency_ms,
    max(received_at) FILTER (observed_at >= TIMESTAMP '2024-01-15') AS current_received_at,
    max(received_at) FILTER (observed_at < TIMESTAMP '2024-01-15') AS previous_received_at
  FROM point GROUP BY ALL
  UNION ALL BY NAME
  SELECT n_name AS account_id, 'consumption' AS metric, 'unknown' AS unit, 0 AS observed_points,
    0 AS previous_observed_points, 0 AS late_points FROM nation),
series AS (SELECT *, least(1.0::DOUBLE, observed_points / 2.0::DOUBLE) AS current_completeness,
    least(1.0::DOUBLE, previous_observed_points / 2.0::DOUBLE) AS previous_completeness,
    CASE WHEN previous_value > 0 THEN (current_value - previous_value) / previous_value
         WHEN current_value = 0 AND previous_value = 0 THEN 0.0 END AS change_ratio FROM total),
classified AS (SELECT *, CASE WHEN observed_points = 0 THEN 'missing'
    WHEN current_completeness < 0.8 OR previous_completeness < 0.8 THEN 'sparse'
    WHEN NOT coalesce(current_value IS NOT NULL AND previous_value IS NOT NULL AND (previous_value > 0 OR current_value = 0), false) THEN 'incomplete'
    WHEN change_ratio >= 0.1 THEN 'rising' ELSE 'stable' END AS status FROM series)"""


def _rounded(df):
    """Sums of doubles depend on the order of addition in the last digits."""
    names = ["current_value", "previous_value", "change_ratio", "average_latency_ms", "absolute_growth", "relative_growth"]
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "usage_row_gate",
    f"""WITH {USAGE_ROWS_SQL},
    judged AS (SELECT *, CASE WHEN received_at < observed_at THEN 'received_at' WHEN metric <> 'purchase' THEN 'other_metric' END AS reason
      FROM (SELECT * REPLACE (CASE WHEN value < 5 THEN observed_at - to_hours(1) ELSE received_at END AS received_at) FROM usage_rows))
    SELECT account_id, metric, coalesce(reason, 'accepted') AS outcome, count(*) AS n,
      sum(CASE WHEN received_at < observed_at AND metric <> 'purchase' THEN 1 ELSE 0 END)::BIGINT AS two_rules
    FROM judged GROUP BY ALL""",
)
def _usage_row_gate(spark, folder):
    rows = usage_rows(spark, folder)
    early = F.when(F.col("value") < 5, F.col("observed_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("received_at"))
    config = UsageWindows(start=WINDOWS.start, end=WINDOWS.end, metric="purchase")
    good, bad = usage.usage_row_gate(rows.withColumn("received_at", early), config)
    every = good.withColumn("violations", F.array().cast("array<string>")).unionByName(bad)
    outcome = F.coalesce(F.get("violations", 0), F.lit("accepted"))
    return every.groupBy("account_id", "metric", outcome.alias("outcome")).agg(
        F.count("*").alias("n"), F.count_if(F.size("violations") == 2).alias("two_rules")
    )


@query(
    "usage_points",
    f"WITH {POINTS_SQL} SELECT account_id, metric, observed_at, received_at, round(value, 6) AS value, unit, latency_ms FROM point",
)
def _usage_points(spark, folder):
    return usage.usage_points(usage_rows(spark, folder), WINDOWS).withColumn("value", F.round("value", 6))


@query(
    "usage_series",
    f"""WITH {SERIES_SQL}
    SELECT account_id, metric, unit, status, round(current_value, 6) AS current_value, round(previous_value, 6) AS previous_value,
      round(change_ratio, 6) AS change_ratio, current_completeness, previous_completeness, 'final' AS current_finality,
      'final' AS previous_finality, observed_points, previous_observed_points, 2 AS expected_points, late_points,
      round(average_latency_ms, 6) AS average_latency_ms, max_latency_ms, current_received_at, previous_received_at FROM classified""",
)
def _usage_series(spark, folder):
    expected = read_table(spark, folder, "nation").select(F.col("n_name").alias("account_id"))
    return _rounded(usage.usage_series(usage_rows(spark, folder), WINDOWS, expected))


_PAIR_SQL = f"""{SERIES_SQL},
pair AS (SELECT account_id, metric, unit, current_value, previous_value, current_completeness, previous_completeness,
    coalesce(current_received_at > TIMESTAMP '2024-01-22', false) OR coalesce(previous_received_at > TIMESTAMP '2024-01-15', false) AS late,
    current_received_at, previous_received_at, current_value - previous_value AS absolute,
    (current_value - previous_value) / nullif(previous_value, 0) AS relative FROM classified),
reasoned AS (SELECT *, CASE WHEN current_value IS NULL OR previous_value IS NULL THEN 'invalid_input'
    WHEN current_completeness < 1 OR previous_completeness < 1 THEN 'incomplete_data'
    WHEN late AND @REJECT THEN 'late_data' WHEN previous_value <= 1 THEN 'tiny_base'
    WHEN absolute < 0 OR relative < 0.25 THEN 'below_threshold' ELSE 'detected' END AS reason FROM pair)"""


def _pairs(spark, folder):
    expected = read_table(spark, folder, "nation").select(F.col("n_name").alias("account_id"))
    return usage.series_to_pairs(usage.usage_series(usage_rows(spark, folder), WINDOWS, expected), WINDOWS)


def _growth_sql(reject: str) -> str:
    return f"""WITH {_PAIR_SQL.replace('@REJECT', reject)}
    SELECT account_id, metric AS metric_name, unit, reason,
      CASE WHEN reason IN ('below_threshold', 'detected') THEN round(absolute, 6) END AS absolute_growth,
      CASE WHEN reason IN ('below_threshold', 'detected') THEN round(relative, 6) END AS relative_growth FROM reasoned"""


def _growth(spark, folder, config):
    judged = usage.consumption_growth(_pairs(spark, folder), config)
    return _rounded(judged.select("account_id", "metric_name", "unit", "reason", "absolute_growth", "relative_growth"))


@query("usage_to_growth", _growth_sql("true"))
def _usage_to_growth(spark, folder):
    return _growth(spark, folder, GrowthConfig())


@query("consumption_growth", _growth_sql("false"))
def _consumption_growth(spark, folder):
    return _growth(spark, folder, GrowthConfig(late_data="allow"))


_SIGNAL_ID = sql_stable_id(
    "signal", "account_id", "'consumption_growth'", "'usage_metrics'", "account_id || ':' || metric", sql_iso("TIMESTAMP '2024-01-22'")
)


@query(
    "growth_signals",
    f"""WITH {_PAIR_SQL.replace('@REJECT', 'false')}
    SELECT {_SIGNAL_ID} AS signal_id, account_id, metric AS metric_name, unit AS metric_unit,
      round(current_value, 6) AS metric_value, round(previous_value, 6) AS metric_previous, 1.0::DOUBLE AS confidence,
      metric || ' consumption increased significantly' AS title, 'warning' AS severity,
      greatest(TIMESTAMP '2024-01-22', current_received_at, previous_received_at) AS received_at, 2 AS evidence_rows
    FROM reasoned WHERE reason = 'detected'""",
)
def _growth_signals(spark, folder):
    config = GrowthConfig(late_data="allow")
    found = usage.growth_signals(usage.consumption_growth(_pairs(spark, folder), config), config)
    return found.select(
        "signal_id", "account_id", "metric_name", "metric_unit", F.round("metric_value", 6).alias("metric_value"),
        F.round("metric_previous", 6).alias("metric_previous"), "confidence", "title", "severity", "received_at",
        F.size("evidence").cast("bigint").alias("evidence_rows"),
    )


@query(
    "growth_opportunities",
    f"""WITH {_PAIR_SQL.replace('@REJECT', 'false')},
    found AS (SELECT account_id, count(*) AS events, max(least(1.0::DOUBLE, absolute / previous_value)) AS magnitude
      FROM reasoned WHERE reason = 'detected' GROUP BY ALL)
    SELECT account_id, 'consumption-growth' AS theme, 'opportunity:' || account_id || ':consumption-growth' AS opportunity_id,
      round(round(30 + 15 * magnitude + 15 + 15 + 5 + 5 * least(1.0::DOUBLE, (events - 1) / 2.0::DOUBLE) * 2, 10), 4) AS score,
      1 AS opportunity_rank, true AS retained, events AS signals, events FROM found""",
)
def _growth_opportunities(spark, folder):
    expected = read_table(spark, folder, "nation").select(F.col("n_name").alias("account_id"))
    ranked = growth_opportunities(usage_rows(spark, folder), WINDOWS, expected, GrowthConfig(late_data="allow"))
    return ranked.select("account_id", "theme", "opportunity_id", "score", F.col("opportunity_rank").cast("bigint").alias("opportunity_rank"), "retained", "signals", "events")


@query(
    "usage_daily_rollup",
    """WITH fact AS (SELECT 'team-' || (user_id % 10) AS team_id, 'project-' || user_id AS project_id, event_type AS metric_id,
        CAST(ts AS DATE) AS usage_date, value AS quantity, CASE event_type WHEN 'view' THEN 'pages' ELSE 'requests' END AS unit FROM events
        WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25')
    SELECT team_id, project_id, metric_id, usage_date, unit, round(sum(quantity), 6) AS quantity, count(*) AS source_rows
    FROM fact WHERE team_id IN (SELECT 'team-' || (c_custkey % 10) FROM customer WHERE c_nationkey < 5) GROUP BY ALL""",
)
def _usage_daily_rollup(spark, folder):
    fact = read_table(spark, folder, "events").select(
        F.concat(F.lit("team-"), F.col("user_id") % 10).alias("team_id"),
        F.concat(F.lit("project-"), F.col("user_id")).alias("project_id"),
        F.col("event_type").alias("metric_id"),
        F.col("ts").alias("usage_date"),
        F.col("value").alias("quantity"),
        F.when(F.col("event_type") == "view", "pages").otherwise("requests").alias("unit"),
    )
    verified = read_table(spark, folder, "customer").filter("c_nationkey < 5").select(
        F.concat(F.lit("team-"), F.col("c_custkey") % 10).alias("team_id")
    )
    daily = usage.usage_daily_rollup(fact, verified, "2024-01-05T00:00:00Z", "2024-01-25T00:00:00Z")
    return daily.withColumn("quantity", F.round("quantity", 6))
