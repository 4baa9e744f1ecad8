"""Usage time series: row gate, daily rollup, windowed series, growth."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import evidence_id, signal_id
from tidemark.functions.text import WHITESPACE, as_col, iso_millis, number_text, trim_all
from tidemark.functions.vocabulary import MAX_COMPARISON_DAYS, MAX_QUERY_DAYS, USAGE_UNITS

MS_PER_DAY = 86_400_000


def _utc(value: datetime | str) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)


def instant(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


@dataclass(frozen=True)
class UsageWindows:
    """Current window, the comparison window before it, and the thresholds."""

    start: datetime | str
    end: datetime | str
    comparison_days: float = 7
    max_comparison_days: float = MAX_COMPARISON_DAYS
    interval_hours: float = 24
    rising_threshold: float = 0.1
    sparse_threshold: float = 0.8
    current_finality: str = "unknown"
    comparison_finality: str = "unknown"
    metric: str | None = None
    grain: str | None = None

    def __post_init__(self):
        length = self.end_at - self.start_at
        if length <= timedelta(0):
            raise ValueError("window must end after it starts")
        if length > timedelta(days=MAX_QUERY_DAYS):
            raise ValueError(f"window cannot exceed {MAX_QUERY_DAYS} days")
        if self.comparison_days <= 0 or self.interval_hours <= 0:
            raise ValueError("comparison_days and interval_hours must be positive")
        if self.comparison_days > self.max_comparison_days:
            raise ValueError(f"comparison cannot exceed max_comparison_days ({self.max_comparison_days}) days")
        if self.rising_threshold < 0 or not 0 <= self.sparse_threshold <= 1:
            raise ValueError("rising_threshold must be >= 0 and sparse_threshold within 0..1")
        for name in ("metric", "grain"):
            if getattr(self, name) is not None and not getattr(self, name).strip():
                raise ValueError(f"{name} must not be empty")

    @property
    def start_at(self) -> datetime:
        return _utc(self.start)

    @property
    def end_at(self) -> datetime:
        return _utc(self.end)

    @property
    def comparison_start(self) -> datetime:
        length_days = (self.end_at - self.start_at) / timedelta(days=1)
        return self.start_at - timedelta(days=min(self.comparison_days, length_days))

    @property
    def expected_points(self) -> int:
        hours = (self.end_at - self.start_at) / timedelta(hours=1)
        return max(1, math.ceil(hours / self.interval_hours))


def _unit_lookup(index: int) -> Column:
    pairs = []
    for spelling, target in USAGE_UNITS.items():
        pairs += [F.lit(spelling), F.lit(target[index])]
    return F.create_map(*pairs)


def _unit_key(unit: Column) -> Column:
    return F.regexp_replace(F.lower(trim_all(unit)), f"{WHITESPACE}+", "_")


def unit_name(unit: Column | str) -> Column:
    key = _unit_key(as_col(unit))
    return F.coalesce(F.try_element_at(_unit_lookup(0), key), key)


def unit_multiplier(unit: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_unit_lookup(1), _unit_key(as_col(unit))), F.lit(1)).cast("double")


def usage_violations(config: UsageWindows) -> Column:
    """Array of the row rules that fail."""

    def blank(name: str) -> Column:
        return F.col(name).isNull() | (trim_all(name) == "")

    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    rules = [
        (blank("account_id"), "account_id"),
        (blank("metric"), "metric"),
        (blank("unit"), "unit"),
        (~finite | (F.col("value") < 0), "value"),
        (F.col("observed_at").isNull(), "observed_at"),
        (F.col("received_at").isNull() | (F.col("received_at") < F.col("observed_at")), "received_at"),
    ]
    if config.metric:
        rules.append((~F.col("metric").eqNullSafe(config.metric.strip()), "other_metric"))
    if config.grain:
        rules.append((~F.col("grain").eqNullSafe(config.grain.strip()), "other_grain"))
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))


def usage_row_gate(rows: DataFrame, config: UsageWindows, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). ``strict`` raises on the first bad row instead of rejecting it.

    Series that mix units after unit normalisation are rejected as a whole; only
    the keys of such series are joined back, not the fact table with itself.
    """
    checked = rows.withColumn("violations", usage_violations(config))
    mixed = (
        checked.filter(F.size("violations") == 0)
        .withColumn("unit_name", unit_name("unit"))
        .groupBy("account_id", "metric")
        .agg(F.min("unit_name").alias("low"), F.max("unit_name").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("account_id", "metric", F.lit(True).alias("mixed_units"))
    )
    checked = checked.join(mixed, ["account_id", "metric"], "left").withColumn(
        "violations",
        F.when(F.col("mixed_units"), F.array_append("violations", F.lit("mixed_units"))).otherwise(F.col("violations")),
    ).drop("mixed_units")
    if mode == "strict":
        message = F.concat(F.lit("invalid usage row: "), F.array_join("violations", ", "))
        guard = F.when(F.size("violations") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        return checked.filter(guard).drop("violations"), checked.filter(F.lit(False))
    accepted = checked.filter(F.size("violations") == 0).drop("violations")
    return accepted, checked.filter(F.size("violations") > 0)


def usage_points(rows: DataFrame, config: UsageWindows) -> DataFrame:
    """One point per (account, metric, instant): the latest receipt wins.

    A hash-partitionable aggregate, so copies of one instant are combined before
    the shuffle and a hot account spreads over all of its instants. Ties of
    receipt go to the smaller value text, then the smaller unit.
    """
    queried = rows.filter(
        (F.col("observed_at") >= instant(config.comparison_start)) & (F.col("observed_at") < instant(config.end_at))
    )
    return latest_points(usage_measures(queried)).withColumn("latency_ms", F.unix_millis("received_at") - F.unix_millis("observed_at"))


def usage_measures(rows: DataFrame) -> DataFrame:
    """Values in base units, instants in milliseconds."""
    return rows.select(
        "account_id",
        "metric",
        F.timestamp_millis(F.unix_millis("observed_at")).alias("observed_at"),
        F.timestamp_millis(F.unix_millis("received_at")).alias("received_at"),
        (F.col("value") * unit_multiplier("unit")).alias("value"),
        unit_name("unit").alias("unit"),
    )


def latest_points(measures: DataFrame, *keys: Column, instant: str = "observed_at") -> DataFrame:
    """The measure of the latest receipt for each instant (and the further keys), also in a stream."""
    order = F.struct((-F.unix_millis("received_at")).alias("o"), number_text(F.col("value")).alias("t"), F.col("unit"))
    kept = F.min_by(F.struct("value", "unit", "received_at"), order)
    points = measures.groupBy("account_id", "metric", instant, *keys).agg(kept.alias("p"))
    return points.select(*[c for c in points.columns if c != "p"], "p.value", "p.unit", "p.received_at")


def usage_series(rows: DataFrame, config: UsageWindows, expected_accounts: DataFrame | None = None) -> DataFrame:
    """Per (account, metric): sums, coverage, change and trend status of two windows.

    Points are first reduced to interval buckets (a map-side combined aggregate),
    so the distinct bucket count is a plain count and needs no distinct expansion.
    """
    points = usage_points(rows, config)
    current = F.col("observed_at") >= instant(config.start_at)
    interval_ms = int(config.interval_hours * 3_600_000)
    window_start = F.when(current, F.unix_millis(instant(config.start_at))).otherwise(
        F.unix_millis(instant(config.comparison_start))
    )
    buckets = (
        points.withColumn("is_current", current)
        .withColumn("bucket", F.floor((F.unix_millis("observed_at") - window_start) / F.lit(interval_ms)))
        .groupBy("account_id", "metric", "is_current", "bucket")
        .agg(
            F.sum("value").alias("value"),
            F.count("*").alias("points"),
            F.count_if(F.col("latency_ms") > 0).alias("late"),
            F.sum("latency_ms").alias("latency_sum"),
            F.max("latency_ms").alias("latency_max"),
            F.max("received_at").alias("received_at"),
            F.min("unit").alias("unit_low"),
            F.max("unit").alias("unit_high"),
        )
    )
    now, before = F.col("is_current"), ~F.col("is_current")
    totals = buckets.groupBy("account_id", "metric").agg(
        F.sum(F.when(now, F.col("value"))).alias("current_value"),
        F.sum(F.when(before, F.col("value"))).alias("previous_value"),
        F.count_if(now).alias("observed_points"),
        F.count_if(before).alias("previous_observed_points"),
        F.sum(F.when(now, F.col("points"))).alias("current_rows"),
        F.coalesce(F.sum(F.when(now, F.col("late"))), F.lit(0)).alias("late_points"),
        F.sum(F.when(now, F.col("latency_sum"))).alias("latency_sum"),
        F.max(F.when(now, F.col("latency_max"))).alias("max_latency_ms"),
        F.max(F.when(now, F.col("received_at"))).alias("current_received_at"),
        F.max(F.when(before, F.col("received_at"))).alias("previous_received_at"),
        F.min("unit_low").alias("unit"),
        F.max("unit_high").alias("unit_high"),
    )
    mixed = F.raise_error(F.concat(F.lit("incompatible units in "), F.col("account_id"), F.lit(" / "), F.col("metric")))
    totals = totals.withColumn("unit", F.when(F.col("unit") != F.col("unit_high"), mixed.cast("string")).otherwise(F.col("unit")))
    if expected_accounts is not None:
        silent = (
            expected_accounts.select(F.col("account_id"), F.lit("consumption").alias("metric"))
            .distinct()
            .join(totals.select("account_id", "metric"), ["account_id", "metric"], "left_anti")
            .select(
                "account_id", "metric", F.lit(0).cast("bigint").alias("observed_points"),
                F.lit(0).cast("bigint").alias("previous_observed_points"), F.lit(0).cast("bigint").alias("late_points"),
                F.lit("unknown").alias("unit"),
            )
        )
        totals = totals.unionByName(silent, allowMissingColumns=True)
    return _classify(totals, config)


def _classify(totals: DataFrame, config: UsageWindows) -> DataFrame:
    expected = F.lit(config.expected_points)
    cur, prev = F.col("current_value"), F.col("previous_value")
    cur_cover, prev_cover = F.col("current_completeness"), F.col("previous_completeness")
    comparable = (
        (cur_cover >= 1) & (prev_cover >= 1)
        & F.lit(config.current_finality == "final") & F.lit(config.comparison_finality == "final")
        & cur.isNotNull() & prev.isNotNull() & ((prev > 0) | (cur == 0))
    )
    return (
        totals.withColumn("current_completeness", F.least(F.lit(1.0), F.col("observed_points") / expected))
        .withColumn("previous_completeness", F.least(F.lit(1.0), F.col("previous_observed_points") / expected))
        .withColumn(
            "change_ratio",
            F.when(prev > 0, (cur - prev) / prev).when((cur == 0) & (prev == 0), F.lit(0.0)),
        )
        .withColumn(
            "status",
            F.when(F.col("observed_points") == 0, "missing")
            .when((cur_cover < config.sparse_threshold) | (prev_cover < config.sparse_threshold), "sparse")
            .when(~F.coalesce(comparable, F.lit(False)), "incomplete")
            .when(F.col("change_ratio") >= config.rising_threshold, "rising")
            .otherwise("stable"),
        )
        .select(
            "account_id", "metric", "unit", "status", "current_value", "previous_value", "change_ratio",
            "current_completeness", "previous_completeness",
            F.lit(config.current_finality).alias("current_finality"),
            F.lit(config.comparison_finality).alias("previous_finality"),
            "observed_points", "previous_observed_points",
            F.lit(config.expected_points).cast("bigint").alias("expected_points"),
            "late_points",
            (F.col("latency_sum") / F.col("current_rows")).alias("average_latency_ms"),
            "max_latency_ms", "current_received_at", "previous_received_at",
        )
    )


def usage_daily_rollup(usage: DataFrame, verified_teams: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Daily quantity per team, project, metric and unit; units are never added up."""
    in_window = usage.filter((F.col("usage_date") >= instant(_utc(start))) & (F.col("usage_date") < instant(_utc(end))))
    return (
        in_window.join(verified_teams.select("team_id").distinct(), "team_id", "left_semi")
        .groupBy("team_id", "project_id", "metric_id", F.to_date("usage_date").alias("usage_date"), "unit")
        .agg(F.sum("quantity").alias("quantity"), F.count("*").alias("source_rows"))
    )


@dataclass(frozen=True)
class GrowthConfig:
    comparison_window_ms: int | None = None
    minimum_completeness: float = 1.0
    tiny_base: float = 1.0
    minimum_absolute: float = 0.0
    minimum_relative: float = 0.25
    late_data: str = "reject"
    severity: str = "warning"


def _window_invalid(side: str) -> Column:
    """Also true when a needed field is absent."""
    w = F.col(side)
    ok = (
        (w["end"] > w["start"])
        & ~F.isnan(w["value"]) & (w["value"] >= 0) & (w["value"] < float("inf"))
        & ~F.isnan(w["completeness"]) & w["completeness"].between(0, 1)
    )
    return ~F.coalesce(ok, F.lit(False))


def consumption_growth(pairs: DataFrame, config: GrowthConfig = GrowthConfig()) -> DataFrame:
    """Adds ``reason``, ``absolute_growth`` and ``relative_growth`` to window pairs.

    ``previous`` and ``current`` are structs (start, end, value, completeness,
    complete, received_at, late). Only an explicit ``complete = true`` counts.
    One projection: no shuffle, the first rule that applies names the reason.
    """
    previous, current = F.col("previous"), F.col("current")

    def blank(name: str) -> Column:
        return F.col(name).isNull() | (trim_all(name) == "")

    def length(window: Column) -> Column:
        return F.unix_millis(window["end"]) - F.unix_millis(window["start"])

    mismatch = (length(previous) != length(current)) | (current["start"] != previous["end"])
    if config.comparison_window_ms is not None:
        mismatch = mismatch | (length(current) != config.comparison_window_ms)
    incomplete = (
        (previous["completeness"] < config.minimum_completeness)
        | (current["completeness"] < config.minimum_completeness)
        | ~previous["complete"].eqNullSafe(True)
        | ~current["complete"].eqNullSafe(True)
    )
    late = previous["late"].eqNullSafe(True) | current["late"].eqNullSafe(True)
    absolute = current["value"] - previous["value"]
    relative = absolute / F.nullif(previous["value"], F.lit(0.0))
    reason = (
        F.when(_window_invalid("previous") | _window_invalid("current") | blank("metric_name") | blank("unit"), "invalid_input")
        .when(mismatch, "window_mismatch")
        .when(incomplete, "incomplete_data")
        .when(late & F.lit(config.late_data == "reject"), "late_data")
        .when(previous["value"] <= config.tiny_base, "tiny_base")
        .when((absolute < config.minimum_absolute) | (relative < config.minimum_relative), "below_threshold")
        .otherwise("detected")
    )
    measured = F.col("reason").isin("below_threshold", "detected")
    return (
        pairs.withColumn("reason", reason)
        .withColumn("absolute_growth", F.when(measured, absolute))
        .withColumn("relative_growth", F.when(measured, relative))
    )


def growth_signals(judged: DataFrame, config: GrowthConfig = GrowthConfig()) -> DataFrame:
    """Signals for the pairs whose reason is ``detected``."""
    previous, current = F.col("previous"), F.col("current")
    observed = current["end"]
    value, before = number_text(current["value"]), number_text(previous["value"])

    def evidence(side: str) -> Column:
        w = F.col(side)
        return F.struct(
            F.lit("usage_metric").alias("kind"),
            F.concat(
                F.lit(f"{side.capitalize()} "), F.col("metric_name"), F.lit(": "), number_text(w["value"]), F.lit(" "), F.col("unit"),
                F.lit(" ("), iso_millis(w["start"]), F.lit(" to "), iso_millis(w["end"]), F.lit(")"),
            ).alias("summary"),
            F.lit(None).cast("string").alias("excerpt"),
            F.col("source_system"),
            F.col("source_url"),
            F.create_map(
                F.lit("window"), F.lit(side),
                F.lit("windowStart"), iso_millis(w["start"]),
                F.lit("windowEnd"), iso_millis(w["end"]),
                F.lit("value"), number_text(w["value"]),
                F.lit("unit"), F.col("unit"),
                F.lit("completeness"), number_text(w["completeness"]),
                F.lit("complete"), w["complete"].eqNullSafe(True).cast("string"),
                F.lit("late"), F.coalesce(w["late"], F.lit(False)).cast("string"),
            ).alias("attributes"),
        )

    percent = F.format_string("%.1f", F.col("relative_growth") * 100)
    return judged.filter(F.col("reason") == "detected").select(
        signal_id("account_id", F.lit("consumption_growth"), "source_system", "source_record_id", observed).alias("signal_id"),
        "account_id",
        "account_name",
        F.lit("consumption_growth").alias("category"),
        "source_system",
        "source_record_id",
        "source_url",
        observed.alias("observed_at"),
        F.greatest(
            F.col("collected_at"), observed,
            F.coalesce(previous["received_at"], observed), F.coalesce(current["received_at"], observed),
        ).alias("received_at"),
        F.concat(F.col("metric_name"), F.lit(" consumption increased significantly")).alias("title"),
        F.concat(
            F.col("metric_name"), F.lit(" increased from "), before, F.lit(" to "), value, F.lit(" "), F.col("unit"),
            F.lit(" ("), percent, F.lit("%, +"), number_text(F.col("absolute_growth")), F.lit(")."),
        ).alias("detail"),
        F.lit("expansion").alias("direction"),
        F.lit(config.severity).alias("severity"),
        F.least(previous["completeness"], current["completeness"]).alias("confidence"),
        F.col("metric_name"),
        current["value"].alias("metric_value"),
        F.col("unit").alias("metric_unit"),
        previous["value"].alias("metric_previous"),
        F.array(evidence("previous"), evidence("current")).alias("evidence"),
        F.lit(0).cast("bigint").alias("input_ord"),
    )


def growth_evidence_ids(signals: DataFrame) -> DataFrame:
    """Evidence ids of growth signals: one per compared window."""
    return signals.select("signal_id", "source_system", "source_record_id", F.explode("evidence").alias("e")).select(
        "signal_id",
        evidence_id(
            "source_system",
            F.concat("source_record_id", F.lit(":"), F.col("e.attributes")["window"]),
            F.to_timestamp(F.col("e.attributes")["windowEnd"]),
        ).alias("evidence_id"),
        F.col("e.summary").alias("summary"),
    )


def series_to_pairs(series: DataFrame, config: UsageWindows, source_system: str = "usage_metrics") -> DataFrame:
    """Window pairs out of usage series: complete = final and fully covered, late = received after the window closed."""

    def window(start, end, value, completeness, finality, received):
        return F.struct(
            instant(start).alias("start"),
            instant(end).alias("end"),
            F.col(value).alias("value"),
            F.col(completeness).alias("completeness"),
            ((F.col(finality) == "final") & (F.col(completeness) >= 1)).alias("complete"),
            F.col(received).alias("received_at"),
            (F.col(received) > instant(end)).alias("late"),
        )

    return series.select(
        "account_id",
        F.col("account_id").alias("account_name"),
        F.lit(source_system).alias("source_system"),
        F.concat_ws(":", "account_id", "metric").alias("source_record_id"),
        F.lit(None).cast("string").alias("source_url"),
        instant(config.end_at).alias("collected_at"),
        F.col("metric").alias("metric_name"),
        "unit",
        "status",
        window(config.comparison_start, config.start_at, "previous_value", "previous_completeness", "previous_finality", "previous_received_at").alias("previous"),
        window(config.start_at, config.end_at, "current_value", "current_completeness", "current_finality", "current_received_at").alias("current"),
    )
