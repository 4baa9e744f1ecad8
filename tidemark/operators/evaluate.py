"""Review of the ranking against labelled signals, for one or many configurations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import computed
from tidemark.functions.vocabulary import SIGNAL_CATEGORIES
from tidemark.operators import ranking
from tidemark.operators.runs import ratio

# Labels of the signal categories.
CATEGORY_LABELS = {
    "new_project": "platform adoption",
    "consumption_growth": "consumption growth",
    "it_hiring": "IT hiring",
    "it_company_news": "IT company news",
}


@dataclass(frozen=True)
class PilotConfig:
    name: str = "default"
    threshold: float = 0.0
    enabled: bool = True
    ranking: ranking.RankingConfig = field(default_factory=ranking.RankingConfig)
    labels: dict = field(default_factory=lambda: dict(CATEGORY_LABELS))

    def __post_init__(self):
        if not self.threshold >= 0 or self.threshold == float("inf"):
            raise ValueError("threshold must be finite and not negative")
        if not self.name.strip():
            raise ValueError("a configuration needs a name")


def _with_opportunity(events: DataFrame) -> DataFrame:
    """Adds to each event whether it is the first one of its opportunity, and the features of its opportunity (account and theme), as :func:`ranking.opportunity_features` has them.

    Windows over rows that already lie together by account: one sort, no exchange. Systems are counted by their place in
    the order, so that no list of them is kept.
    """
    mine = Window.partitionBy("account_id", "theme")
    place = F.struct("observed_at", (-F.col("first_ord")).alias("r"))
    system = F.dense_rank().over(mine.orderBy(F.asc_nulls_last("source_system")))
    first = F.row_number().over(mine.orderBy(F.asc_nulls_last("source_system"))) == 1
    return events.withColumns({"system": F.when(F.col("source_system").isNotNull(), system), "first": first}).select(
        "account_id", "theme", "representative_id", "wanted", "first",
        F.max_by("category", place).over(mine).alias("latest_category"),
        F.max(place).over(mine)["observed_at"].alias("latest_at"),
        F.max("magnitude").over(mine).alias("max_magnitude"),
        (F.sum("confidence").over(mine) / F.count("confidence").over(mine)).alias("mean_confidence"),
        F.coalesce(F.max("system").over(mine), F.lit(0)).cast("bigint").alias("systems"),
        F.count("*").over(mine).alias("events"),
        F.sum("signals").over(mine).alias("signals"),
    )


def placed_signals(signals: DataFrame, configs: list[PilotConfig], as_of: Column, normalize: bool = True, wanted: str | None = None) -> DataFrame:
    """(signal_id, account_id, theme, kept): representatives of events whose opportunity a configuration keeps.

    ``wanted`` names a boolean column of the signals: all of them decide, those where it is true are returned.

    ``kept`` has the number and the score of each configuration that is enabled and ranks the opportunity within its cap.
    Signals meet by account, once: events, features and ranks follow from there without another exchange. An account
    has at most as many opportunities as there are themes, so its scores are a short list; its events are rows, and
    spill. Of the event key 128 bits travel.
    """
    facts = ranking.event_facts(signals, normalize, (wanted,) if wanted else ()).withColumn("key", F.substring("key", 1, 16)).repartition("account_id")
    asked = (F.col(wanted) if wanted else F.lit(True)).alias("wanted")
    chosen = F.max(F.struct("observed_at", (-F.col("input_ord")).alias("r"), "signal_id", "source_system", "confidence", "magnitude", asked))
    events = (
        facts.groupBy("account_id", "theme", "category", "key")
        .agg(chosen.alias("rep"), F.count("*").alias("signals"), F.min("input_ord").alias("first_ord"))
        .select("account_id", "theme", "category", F.col("rep.signal_id").alias("representative_id"), "rep.observed_at", "rep.source_system", "rep.confidence", "rep.magnitude", "rep.wanted", "signals", "first_ord")
    )
    scores = F.array(*[ranking.score_column(c.ranking, as_of)["score"] for c in configs])
    scored = _with_opportunity(events).select("account_id", "theme", "representative_id", "wanted", "first", F.struct("theme", "events", scores.alias("scores")).alias("mine"))
    scored = scored.withColumn("others", F.collect_list(F.when(F.col("first"), F.col("mine"))).over(Window.partitionBy("account_id")))

    def rank(n: int) -> Column:
        """The place by score and events, both from the highest (null last), then by theme."""
        def height(o: Column) -> Column:
            return F.struct(o["scores"][n], o["events"])

        def ahead(o: Column) -> Column:
            own = F.col("mine")
            return (height(o) > height(own)) | (height(o).eqNullSafe(height(own)) & (o["theme"] < own["theme"]))

        return F.size(F.filter("others", ahead)) + 1

    entries = [F.when(rank(n) <= c.ranking.max_opportunities, F.struct(F.lit(n).alias("n"), F.col("mine.scores")[n].alias("score"))) for n, c in enumerate(configs) if c.enabled]
    kept = F.array_compact(F.array(*entries)) if entries else F.array().cast("array<struct<n: int, score: double>>")
    # a null account has no opportunity to be found by
    found = computed(scored.filter(F.col("account_id").isNotNull() & F.col("wanted")), F.struct(kept.alias("kept"))).filter(F.size("kept") > 0)
    return found.select(F.col("representative_id").alias("signal_id"), "account_id", "theme", "kept")


def pilot_cases(
    signals: DataFrame, labels: DataFrame, configs: list[PilotConfig], as_of: Column | None = None, normalize: bool = True, named: DataFrame | None = None, wanted: str | None = None
) -> DataFrame:
    """One row per configuration and labelled signal.

    ``labels``: case_id, signal_id, relevant. A case is selected when its signal
    represents an event of a kept opportunity at or above the threshold. Unselected
    irrelevant cases are called ``true_negative`` and count in no metric.

    ``named``: the signals that labels can name, where they are known for less than a look at all (signal_id, category).
    Labels that carry the ``category`` of their signal are not looked up. ``wanted`` names a boolean column of the
    signals that is true for all that labels name; the others decide as well, but do not travel to the labels.
    """
    as_of = ranking.newest_observation(signals) if as_of is None else as_of
    cases = labels if "category" in labels.columns else labels.join((signals if named is None else named).select("signal_id", "category"), "signal_id")
    # dealt by signal before the configurations are told apart
    placed = placed_signals(signals, configs, as_of, normalize, wanted).repartition("signal_id")
    placed = placed.select(F.col("signal_id").alias("placed_id"), "account_id", "theme", F.inline("kept"))
    settings = F.array(*[
        F.struct(
            F.lit(c.name).alias("config"), F.lit(k).alias("k"), F.lit(float(c.threshold)).alias("threshold"),
            ranking.choose(F.col("category"), {k: c.labels.get(k, k) for k in SIGNAL_CATEGORIES}).alias("label"),
        )
        for k, c in enumerate(configs)
    ])
    every = cases.select("*", F.inline(settings))
    selected = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    # a difference, as an equality would be a second key to deal the rows by
    same = (F.col("signal_id") == F.col("placed_id")) & (F.col("k") - F.col("n") == 0)
    opportunity = F.when(F.col("n").isNotNull(), F.concat_ws(":", F.lit("opportunity"), "account_id", "theme"))
    rest = [c for c in cases.columns if c != "signal_id"]
    return (
        every.join(placed, same, "left")
        .select("config", "signal_id", *rest, "threshold", "label", opportunity.alias("opportunity_id"), "score")
        .withColumn("selected", selected)
        .withColumn(
            "outcome",
            F.when(F.col("selected") & F.col("relevant"), "true_positive")
            .when(F.col("selected"), "false_positive")
            .when(F.col("relevant"), "miss")
            .otherwise("true_negative"),
        )
    )


def pilot_metrics(cases: DataFrame, source_failures: int = 0) -> DataFrame:
    """Precision and coverage per configuration."""
    def number(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    counts = cases.groupBy("config").agg(
        number("true_positive").alias("true_positives"), number("false_positive").alias("false_positives"),
        number("miss").alias("misses"), F.count("*").alias("evaluated_cases"),
    )
    return counts.select(
        "*",
        ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives")).alias("precision"),
        ratio(F.col("true_positives"), F.col("true_positives") + F.col("misses")).alias("coverage"),
        F.lit(source_failures).cast("bigint").alias("source_failures"),
    )


def pilot_evaluate(signals: DataFrame, labels: DataFrame, config: PilotConfig = PilotConfig(), source_failures: int = 0, **options) -> DataFrame:
    return pilot_metrics(pilot_cases(signals, labels, [config], **options), source_failures)


def pilot_sweep(signals: DataFrame, labels: DataFrame, configs: list[PilotConfig], source_failures: int = 0, **options) -> DataFrame:
    return pilot_metrics(pilot_cases(signals, labels, configs, **options), source_failures)


def pilot_thresholds(signals: DataFrame, labels: DataFrame, thresholds: Sequence[float], config: PilotConfig = PilotConfig(), source_failures: int = 0, **options) -> DataFrame:
    """The metrics of one configuration at each of many thresholds, from one review.

    A case is selected at all thresholds up to its score, so cases are counted once by the highest threshold they reach,
    and counts add up from the highest one down. The last step handles one row a threshold, however many cases there are.
    """
    marks = sorted({float(t) for t in thresholds})
    cases = pilot_cases(signals, labels, [replace(config, threshold=0.0)], **options)
    by_score = cases.groupBy("score").agg(F.count_if(F.col("relevant")).alias("hits"), F.count("*").alias("cases"))
    reached = F.size(F.filter(F.lit(marks), lambda t: t <= F.col("score")))
    steps = by_score.groupBy(F.when(F.col("score").isNull(), 0).otherwise(reached).alias("step")).agg(F.sum("hits").alias("hits"), F.sum("cases").alias("cases"))
    every = signals.sparkSession.range(len(marks) + 1).select(F.col("id").cast("int").alias("step")).join(steps, "step", "left").fillna(0)
    all_steps = Window.orderBy(F.desc("step"))
    upward = all_steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = all_steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = every.select(
        "step", F.sum("hits").over(upward).alias("true_positives"), F.sum(F.col("cases") - F.col("hits")).over(upward).alias("false_positives"),
        F.sum("hits").over(whole).alias("relevant"), F.sum("cases").over(whole).alias("evaluated_cases"),
    ).filter("step > 0")
    hits, misses = F.col("true_positives"), F.col("relevant") - F.col("true_positives")
    return counts.select(
        F.lit(config.name).alias("config"), F.element_at(F.lit(marks), F.col("step")).alias("threshold"), "true_positives", "false_positives", misses.alias("misses"), "evaluated_cases",
        ratio(hits, hits + F.col("false_positives")).alias("precision"), ratio(hits, hits + misses).alias("coverage"), F.lit(source_failures).cast("bigint").alias("source_failures"),
    )
