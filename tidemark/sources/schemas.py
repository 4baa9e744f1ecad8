"""Column layouts of the records that operators exchange."""

from __future__ import annotations

EVIDENCE = "STRUCT<kind: STRING, summary: STRING, excerpt: STRING, source_system: STRING, source_url: STRING, attributes: MAP<STRING, STRING>>"
OWNER = "STRUCT<id: STRING, name: STRING, role: STRING>"

ACCOUNTS = (
    "account_id STRING, source_record_id STRING, name STRING, domains ARRAY<STRING>, careers_url STRING, "
    f"linkedin_url STRING, owners ARRAY<{OWNER}>"
)

SIGNALS = (
    "signal_id STRING, account_id STRING, account_name STRING, category STRING, source_system STRING, "
    "source_record_id STRING, source_url STRING, observed_at TIMESTAMP, received_at TIMESTAMP, title STRING, "
    "detail STRING, direction STRING, severity STRING, confidence DOUBLE, metric_name STRING, metric_value DOUBLE, "
    f"metric_unit STRING, metric_previous DOUBLE, evidence ARRAY<{EVIDENCE}>, input_ord BIGINT"
)

SIGNAL_COLUMNS = [
    "signal_id", "account_id", "account_name", "category", "source_system", "source_record_id", "source_url",
    "observed_at", "received_at", "title", "detail", "direction", "severity", "confidence", "metric_name",
    "metric_value", "metric_unit", "metric_previous", "evidence", "input_ord",
]

USAGE_ROWS = (
    "account_id STRING, metric STRING, grain STRING, value DOUBLE, unit STRING, observed_at TIMESTAMP, received_at TIMESTAMP"
)

CAREER_JOBS = (
    "account_id STRING, job_id STRING, title STRING, department STRING, location STRING, url STRING, "
    "posted_at TIMESTAMP, observed_at TIMESTAMP"
)
