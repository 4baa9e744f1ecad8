"""Themes, events, scores, ranking, account summaries and digests of signals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import as_col, clean, contains_any, let
from tidemark.session import forget, stored
from tidemark.functions.vocabulary import (
    CATEGORY_THEMES,
    HIRING_THEME_WORDS,
    MAX_DIGEST_ACCOUNTS,
    MAX_OPPORTUNITIES,
    SEVERITY_FACTOR,
    SEVERITY_RANK,
    SEVERITY_WEIGHT,
    SIGNAL_CATEGORIES,
    THEME_KEYWORDS,
)

MICROS_PER_DAY = 86_400_000_000


@dataclass(frozen=True)
class RankingConfig:
    # Default weights.
    signal_type: dict = field(
        default_factory=lambda: {"new_project": 25, "consumption_growth": 30, "it_hiring": 20, "it_company_news": 15}
    )
    magnitude: float = 15
    recency: float = 15
    confidence: float = 15
    corroboration: float = 10
    recurrence: float = 5
    material_change: float = 5
    half_life_days: float = 30
    max_opportunities: int = MAX_OPPORTUNITIES

    def __post_init__(self):
        numbers = [
            *self.signal_type.values(), self.magnitude, self.recency, self.confidence, self.corroboration,
            self.recurrence, self.material_change, self.half_life_days, self.max_opportunities,
        ]
        if set(self.signal_type) - set(SIGNAL_CATEGORIES):
            raise ValueError("unknown signal category in the ranking weights")
        if any(not math.isfinite(n) or n < 0 for n in numbers) or self.half_life_days == 0:
            raise ValueError("ranking weights must be finite and not negative")
        if not isinstance(self.max_opportunities, int):
            raise ValueError("max_opportunities must be an integer")


def choose(value: Column, table: dict, default=None) -> Column:
    """Small fixed lookup as a CASE expression."""
    result = F.lit(default)
    for key, mapped in reversed(list(table.items())):
        result = F.when(value == key, F.lit(mapped)).otherwise(result)
    return result


def signal_text(normalize: bool = True) -> Column:
    """Lower-case title, detail and evidence text of a signal."""
    quotes = F.array_join(
        F.transform("evidence", lambda e: F.concat(e["summary"], F.lit(" "), F.coalesce(e["excerpt"], F.lit("")))), " "
    )
    return F.lower(clean(F.concat_ws(" ", "title", "detail", quotes), normalize))


def opportunity_theme(category: Column | str, text: Column) -> Column:
    """Theme of a signal; for news the first keyword list that matches."""
    category = as_col(category)
    theme = F.lit("company-news")
    for name, keywords in reversed(THEME_KEYWORDS):
        theme = F.when(contains_any(text, keywords), name).otherwise(theme)
    theme = F.when(contains_any(text, HIRING_THEME_WORDS), "it-hiring").otherwise(theme)
    for name, fixed in CATEGORY_THEMES.items():
        theme = F.when(category == name, fixed).otherwise(theme)
    return theme


def with_theme(signals: DataFrame, normalize: bool = True) -> DataFrame:
    """Adds ``theme``; the text is built once per row however many keywords are tried."""
    return signals.withColumn("theme", let(signal_text(normalize), lambda text: opportunity_theme("category", text)))


def _evidence_identity() -> Column:
    """First of the identifying attributes found on any evidence, else the source record."""

    def attribute(key: str) -> Column:
        first = F.try_element_at(F.get("evidence", 0)["attributes"], F.lit(key))
        found = F.filter(F.transform("evidence", lambda e: F.try_element_at(e["attributes"], F.lit(key))), lambda v: v.isNotNull())
        return F.coalesce(first, F.when(F.size("evidence") > 1, F.get(found, 0)))

    keys = ["projectId", "jobIdentity", "canonicalUrl", "url", "title"]
    return F.coalesce(*[attribute(k) for k in keys], F.concat(F.col("source_system"), F.lit(":"), F.col("source_record_id")))


def _material_content() -> Column:
    """Key-sorted JSON of what makes two signals report the same change."""
    ignored = ["windowStart", "windowEnd", "creationTime"]
    facts = F.transform(
        "evidence",
        lambda e: F.struct(
            e["kind"].alias("kind"),
            e["summary"].alias("summary"),
            F.sort_array(F.map_entries(F.map_filter(e["attributes"], lambda k, v: ~k.isin(ignored)))).alias("attributes"),
        ),
    )
    return F.to_json(
        F.struct("category", "title", "metric_name", "metric_value", "metric_unit", "metric_previous", facts.alias("evidence")),
        {"ignoreNullFields": "false"},
    )


def with_event_key(signals: DataFrame, normalize: bool = True) -> DataFrame:
    """Adds ``theme`` and ``event_key``; all copies of one event share the key."""
    themed = with_theme(signals, normalize)
    return themed.withColumn(
        "event_key",
        F.sha2(F.concat_ws("|", "account_id", "theme", "category", _evidence_identity(), _material_content()), 256),
    )


def event_facts(signals: DataFrame, normalize: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """A signal reduced to what its event, and the score of its opportunity, need, and to the columns ``carried``; ``key`` has the bytes of the event key."""
    magnitude = (
        F.when(
            F.col("metric_value").isNotNull(),
            F.when(
                F.col("metric_previous").isNotNull() & (F.col("metric_previous") != 0),
                F.least(F.lit(1.0), F.abs(F.col("metric_value") - F.col("metric_previous")) / F.abs("metric_previous")),
            ).otherwise(F.least(F.lit(1.0), F.abs("metric_value") / 10)),
        ).otherwise(choose(F.col("severity"), SEVERITY_FACTOR))
    )
    return with_event_key(signals, normalize).select(
        "account_id", "theme", "category", F.unhex("event_key").alias("key"), "signal_id", "input_ord", "observed_at", "source_system",
        "confidence", magnitude.alias("magnitude"), *carried,
    )


def event_dedupe(signals: DataFrame, normalize: bool = True) -> DataFrame:
    """One row per event: newest signal as representative, first in input on ties.

    Text is reduced to fixed-size facts before the shuffle and the aggregate is
    combined on the map side, so copies of one event never meet in one task. The key travels as bytes, and what is
    chosen travels once: its order comes first in the struct that is compared.
    """
    facts = event_facts(signals, normalize)
    chosen = F.max(F.struct("observed_at", (-F.col("input_ord")).alias("r"), "signal_id", "source_system", "confidence", "magnitude"))
    return (
        facts.groupBy("account_id", "theme", "category", "key")
        .agg(chosen.alias("rep"), F.count("*").alias("signals"), F.min("input_ord").alias("first_ord"))
        .select(
            "account_id", "theme", "category", F.lower(F.hex("key")).alias("event_key"),
            F.col("rep.signal_id").alias("representative_id"), F.col("rep.observed_at").alias("observed_at"),
            F.col("rep.source_system").alias("source_system"), F.col("rep.confidence").alias("confidence"),
            F.col("rep.magnitude").alias("magnitude"), "signals", "first_ord",
        )
    )


def opportunity_features(events: DataFrame) -> DataFrame:
    """Per (account, theme): everything a score needs that no weight changes.

    Grouped by source system first, so that the systems are counted without expanding rows.
    """
    place = F.struct("observed_at", (-F.col("first_ord")).alias("r"))
    by_system = events.groupBy("account_id", "theme", "source_system").agg(
        F.max_by("category", place).alias("category"),
        F.max(place).alias("place"),
        F.max("magnitude").alias("magnitude"),
        F.sum("confidence").alias("confidence"),
        F.count("confidence").alias("confidences"),
        F.count("*").alias("events"),
        F.sum("signals").alias("signals"),
    )
    return by_system.groupBy("account_id", "theme").agg(
        F.max_by("category", "place").alias("latest_category"),
        F.max("place.observed_at").alias("latest_at"),
        F.max("magnitude").alias("max_magnitude"),
        (F.sum("confidence") / F.sum("confidences")).alias("mean_confidence"),
        F.count("source_system").alias("systems"),
        F.sum("events").alias("events"),
        F.sum("signals").alias("signals"),
    )


def newest_observation(signals: DataFrame) -> Column:
    """Newest observation of the whole table as a scalar subquery."""
    return signals.select(F.max("observed_at")).scalar()


def score_column(config: RankingConfig, as_of: Column) -> dict[str, Column]:
    """Score parts of a feature row under one configuration."""
    age_days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("latest_at")) / F.lit(MICROS_PER_DAY))
    parts = {
        "signal_type_score": choose(F.col("latest_category"), {k: float(v) for k, v in config.signal_type.items()}),
        "magnitude_score": config.magnitude * F.col("max_magnitude"),
        "recency_score": config.recency * F.pow(F.lit(0.5), age_days / config.half_life_days),
        "confidence_score": config.confidence * F.col("mean_confidence"),
        "corroboration_score": config.corroboration * F.least(F.lit(1.0), F.col("systems") / 2),
        "recurrence_score": config.recurrence * F.least(F.lit(1.0), (F.col("signals") - 1) / 2),
        "material_score": config.material_change * F.least(F.lit(1.0), (F.col("events") - 1) / 2),
    }
    total = F.lit(0.0)
    for part in parts.values():
        total = total + part
    # the inner rounding removes summation noise, so the score does not depend on partition order
    return {**parts, "score": F.round(F.round(total, 10), 4)}


def opportunity_score(features: DataFrame, config: RankingConfig, as_of: Column) -> DataFrame:
    parts = score_column(config, as_of)
    scored = features.select("*", *[column.alias(name) for name, column in parts.items()])
    return scored.withColumn("opportunity_id", F.concat_ws(":", F.lit("opportunity"), "account_id", "theme"))


def rank_order() -> list[Column]:
    return [F.desc("score"), F.desc("events"), F.asc("theme"), F.asc("opportunity_id")]


def rank_opportunities(scored: DataFrame, config: RankingConfig = RankingConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``opportunity_rank`` and ``retained``; an account has at most ten themes, so the window is small."""
    rank = F.row_number().over(Window.partitionBy(*by, "account_id").orderBy(*rank_order()))
    return scored.withColumn("opportunity_rank", rank).withColumn("retained", F.col("opportunity_rank") <= config.max_opportunities)


def ranked_accounts(ranked: DataFrame) -> DataFrame:
    """Per account: best score, kept and omitted opportunities, omitted signals."""
    omitted = ~F.col("retained")
    return ranked.groupBy("account_id").agg(
        F.max(F.when(F.col("retained"), F.col("score"))).alias("best_score"),
        F.count_if(F.col("retained")).alias("opportunities"),
        F.count_if(omitted).alias("omitted_opportunities"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(omitted, F.struct("opportunity_rank", "opportunity_id")))), lambda s: s["opportunity_id"]
            ),
            ",",
        ).alias("omitted_ids"),
        F.coalesce(F.sum(F.when(omitted, F.col("signals"))), F.lit(0)).alias("omitted_signals"),
    )


def score_signals(signals: DataFrame, config: RankingConfig = RankingConfig(), as_of: Column | None = None, normalize: bool = True) -> DataFrame:
    """Signals -> scored opportunities; the reference time defaults to the newest observation."""
    features = opportunity_features(event_dedupe(signals, normalize))
    if as_of is None:
        # events keep their newest signal, so the newest of all is among the features; the signals are built once
        features = stored(features, "features")
        as_of = features.select(F.max("latest_at")).scalar()
    return opportunity_score(features, config, as_of)


def account_summary(signals: DataFrame) -> DataFrame:
    """Scores by direction and the latest signal per account.

    The per-direction signal lists of an account have no bound, so they stay
    rows (:func:`summary_signals`) instead of arrays.
    """
    weight = choose(F.col("severity"), SEVERITY_WEIGHT)

    def capped(direction: str) -> Column:
        return F.least(F.lit(100), F.coalesce(F.sum(F.when(F.col("direction") == direction, weight)), F.lit(0))).cast("bigint")

    def number(direction: str) -> Column:
        return F.count_if(F.col("direction") == direction)

    return signals.groupBy("account_id").agg(
        F.max_by("account_name", F.struct("observed_at", (-F.col("input_ord")).alias("r"), "signal_id")).alias("account_name"),
        capped("expansion").alias("expansion_score"),
        capped("risk").alias("risk_score"),
        F.max("observed_at").alias("latest_signal_at"),
        number("expansion").alias("expansion_signals"),
        number("risk").alias("risk_signals"),
        number("neutral").alias("neutral_signals"),
    )


def summary_signals(signals: DataFrame) -> DataFrame:
    """Signals by account and direction, newest first (a range-partitioned sort)."""
    return signals.select("account_id", "direction", "observed_at", "signal_id", "title", "severity").orderBy(
        "account_id", "direction", F.desc("observed_at"), "signal_id"
    )


def signal_digest(summaries: DataFrame) -> DataFrame:
    """Accounts of a digest, strongest first, then the most recent."""
    return summaries.withColumn("strength", F.greatest("risk_score", "expansion_score")).orderBy(
        F.desc("strength"), F.desc("latest_signal_at"), "account_id"
    )


def finding_score() -> Column:
    """100 x severity rank plus confidence in tenths, rounded half up."""
    return choose(F.col("severity"), SEVERITY_RANK) * 100 + F.floor(F.col("confidence") * 10 + 0.5)


def findings(signals: DataFrame, config: RankingConfig = RankingConfig(), as_of: Column | None = None, normalize: bool = True) -> DataFrame:
    """Representatives of the retained opportunities, with their score and source URL."""
    needed = ("account_id", "theme", "category", "representative_id", "observed_at", "source_system", "confidence", "magnitude", "signals", "first_ord")
    events = stored(event_dedupe(signals, normalize).select(*needed), "events")
    # events keep their newest signal
    as_of = newest_observation(events) if as_of is None else as_of
    ranked = rank_opportunities(opportunity_score(opportunity_features(events), config, as_of), config)
    kept = events.join(ranked.filter("retained").select("account_id", "theme", "opportunity_id"), ["account_id", "theme"])
    kept = stored(kept.select("account_id", "theme", "opportunity_id", "representative_id", "observed_at", "confidence"), "kept")
    forget(events)
    urls = F.concat(F.array("source_url"), F.transform("evidence", lambda e: e["source_url"]))
    usable = F.get(F.filter(urls, lambda u: u.rlike("(?i)^https?://[^/?#]+")), 0)
    facts = signals.select(
        F.col("signal_id").alias("representative_id"), "account_name", "severity", "title",
        finding_score().cast("bigint").alias("finding_score"), usable.alias("url"),
    )
    return kept.join(facts, "representative_id").withColumnRenamed("representative_id", "signal_id")


def _finding_order(prefix: str = "") -> Column:
    """Ascending order of findings as one comparable value."""
    return F.struct(
        (-F.col(f"{prefix}finding_score")).alias("a"), (-F.unix_micros(f"{prefix}observed_at")).alias("b"),
        F.col(f"{prefix}account_name").alias("c"), F.col(f"{prefix}signal_id").alias("d"),
    )


def digest_findings(found: DataFrame, limit: int = MAX_DIGEST_ACCOUNTS) -> DataFrame:
    """Best finding with a URL of the first ``limit`` accounts, with its rank among all findings.

    The best finding per account is a map-side combined minimum; the overall rank
    of the few that are shown comes from counting findings before each of them,
    so no global sort or single-partition window is needed.
    """
    found = stored(found.select("account_id", "signal_id", "account_name", "title", "severity", "finding_score", "observed_at", "url"), "findings")
    best = (
        found.filter(F.col("url").isNotNull())
        .groupBy("account_id")
        .agg(F.min_by(F.struct("signal_id", "account_name", "title", "severity", "finding_score", "observed_at", "url"), _finding_order()).alias("b"))
        .select("account_id", "b.*")
    )
    shown = best.orderBy(_finding_order()).limit(limit)
    places = shown.select(F.sort_array(F.collect_list(_finding_order())).alias("places")).scalar()
    # one count for each place shown, in one pass
    ahead = [F.count_if(_finding_order() <= F.get("places", F.lit(k))) for k in range(limit)]
    ranks = found.withColumn("places", places).agg(F.array(*ahead).alias("ranks")).scalar()
    display = F.array_position(F.transform("places", lambda p: p["d"]), F.col("signal_id"))
    placed = shown.withColumn("places", places).withColumn("display_rank", display).drop("places")
    return placed.withColumn("finding_rank", F.get(ranks, (F.col("display_rank") - 1).cast("int")))


def digest_totals(found: DataFrame, limit: int = MAX_DIGEST_ACCOUNTS, total_accounts: Column | None = None, run_status: str = "succeeded", run_errors: int = 0) -> DataFrame:
    """Counts under a digest: shown, further and URL-less findings, coverage, status line."""
    per_account = found.groupBy("account_id").agg(
        F.count("*").alias("found"), F.count_if(F.col("url").isNotNull()).alias("linked")
    )
    noun = "failure" if run_errors == 1 else "failures"
    label = {
        "succeeded": "Status: complete",
        "partial": f"Status: PARTIAL — {run_errors} source {noun}",
        "failed": f"Status: FAILED — {run_errors} source {noun}",
    }[run_status]
    totals = per_account.agg(
        F.count("*").alias("covered_accounts"),
        F.least(F.count_if(F.col("linked") > 0), F.lit(limit)).cast("bigint").alias("shown"),
        F.coalesce(F.sum("linked"), F.lit(0)).alias("linked_findings"),
        F.coalesce(F.sum(F.col("found") - F.col("linked")), F.lit(0)).alias("unlinked_findings"),
    )
    total = F.col("covered_accounts") if total_accounts is None else total_accounts
    return totals.select(
        "covered_accounts", total.cast("bigint").alias("total_accounts"), "shown",
        (F.col("linked_findings") - F.col("shown")).alias("further_findings"), "unlinked_findings", F.lit(label).alias("status_label"),
    )
