"""Company news: classification, signals, and the account news monitor."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import observation_id, signal_id
from tidemark.functions.text import (
    as_col,
    clean,
    clip,
    clip_ellipsis,
    collapse,
    computed,
    fold_accents,
    instruction_like,
    let,
    matched_terms,
    trim_all,
)
from tidemark.functions.urls import host_in_list, host_of, is_homepage
from tidemark.functions.vocabulary import (
    APP_LISTING_TITLE,
    EXCLUDED_HOSTS,
    LEGAL_SUFFIXES,
    LISTING_HOSTS,
    NEWS_JUDGE_BATCH,
    NEWS_LOOKBACK_DAYS,
    NEWS_MAX_EVENTS,
    NEWS_RETENTION_DAYS,
    NEWS_TAXONOMY,
    REVIEW_HOSTS,
)
from tidemark.operators.gates import first_party, watch_url
from tidemark.operators.ranking import choose
from tidemark.operators.stories import first_of_story, match_known_stories
from tidemark.session import stored as written

LEAD_CHARS = 700
EXCERPT_CHARS = 1500
TITLE_CHARS = 240


# --- classification -----------------------------------------------------------


def news_classify(items: DataFrame, taxonomy=None, normalize: bool = True) -> DataFrame:
    """Adds news_category, confidence, rationale and excerpt (NULL when nothing is certain enough).

    The category with the most keywords wins, ties go by category name; a single
    keyword never reaches the 0.7 that is required.
    """
    entries = NEWS_TAXONOMY if taxonomy is None else taxonomy

    def judge(text: Column) -> Column:
        return let(F.lower(text), lambda lower: let(hits(lower), lambda found: conclude(text, lower, found)))

    def hits(lower: Column) -> Column:
        tried = [
            let(matched_terms(lower, words), lambda m, c=category, n=label: F.struct(
                (-F.size(m)).alias("rank"), F.lit(c).alias("category"), F.lit(n).alias("label"), m.alias("words")))
            for category, label, words, _, _ in entries
        ]
        return F.sort_array(F.filter(F.array(*tried), lambda h: h["rank"] < 0))

    def conclude(text: Column, lower: Column, found: Column) -> Column:
        best = F.get(found, 0)
        count, runner_up = -best["rank"], F.coalesce(-F.get(found, 1)["rank"], F.lit(0))
        confidence = F.least(F.lit(0.99), F.lit(0.45) + count * 0.16 + F.when(count > runner_up, 0.08).otherwise(0.0))
        start = F.greatest(F.lit(1), F.instr(lower, F.get(best["words"], 0)) - 100)
        sure = best.isNotNull() & (confidence >= 0.7) & ~instruction_like(text)
        return F.when(sure, F.struct(
            best["category"].alias("news_category"),
            F.round(confidence, 2).alias("confidence"),
            F.concat(F.lit("Deterministic taxonomy match for "), best["label"], F.lit(": "), F.array_join(best["words"], ", "), F.lit(".")).alias("rationale"),
            trim_all(F.substr(text, start, F.lit(300))).alias("excerpt"),
        ))

    text = clean(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))), normalize)
    return computed(items, let(text, judge))


def news_signals(items: DataFrame, accounts: DataFrame, stored: DataFrame, normalize: bool = True) -> DataFrame:
    """Outcome of each news item: suppressed, skipped_existing, unclassified or signal.

    ``items``: account_id, item_id, source_system, source_url, record_id,
    observed_at, received_at, title, text; ``stored``: observation ids seen before.
    Text is quarantined before anything is derived from it.
    """
    checked = (
        items.join(accounts.select("account_id", "account_name", F.col("domains").alias("account_domains")), "account_id", "left")
        .withColumn("clean_title", clean("title", normalize))
        .withColumn("clean_text", clean(F.concat(F.col("title"), F.lit(". "), F.col("text")), normalize))
        .withColumn(
            "persistable",
            (F.col("source_system") == "company_news")
            & F.coalesce(first_party("source_url", "account_domains"), F.lit(False))
            & ~instruction_like(F.col("clean_text")),
        )
        .withColumn("observation_id", observation_id("account_id", "source_system", "record_id", "observed_at", ascii_only=not normalize))
        .join(stored.select("observation_id", F.lit(True).alias("stored")).distinct(), "observation_id", "left")
    )
    judged = news_classify(checked, normalize=normalize).withColumn(
        "outcome",
        F.when(~F.col("persistable"), "suppressed")
        .when(F.col("stored"), "skipped_existing")
        .when(F.col("news_category").isNull(), "unclassified")
        .otherwise("signal"),
    )
    emitted = F.col("outcome") == "signal"
    labels = {c: label for c, label, _, _, _ in NEWS_TAXONOMY}
    return judged.select(
        "account_id", "account_name", "item_id", "outcome",
        F.when(F.col("outcome").isin("signal", "unclassified"), F.col("observation_id")).alias("observation_id"),
        F.when(emitted, signal_id("account_id", F.lit("it_company_news"), "source_system", "record_id", "observed_at", ascii_only=not normalize)).alias("signal_id"),
        F.when(emitted, F.col("news_category")).alias("news_category"),
        F.when(emitted, F.concat(choose(F.col("news_category"), labels), F.lit(": "), F.col("clean_title"))).alias("title"),
        F.when(emitted, F.concat(F.col("rationale"), F.lit(" Evidence: "), F.col("excerpt"))).alias("detail"),
        F.when(emitted, choose(F.col("news_category"), {c: d for c, _, _, d, _ in NEWS_TAXONOMY})).alias("direction"),
        F.when(emitted, choose(F.col("news_category"), {c: s for c, _, _, _, s in NEWS_TAXONOMY})).alias("severity"),
        F.when(emitted, F.col("confidence")).alias("confidence"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("account_id", "outcome").agg(F.count("*").alias("n"))


# --- naming -----------------------------------------------------------------------


def name_patterns(names: Column) -> Column:
    """Per name: the padded phrase and the padded words that must all occur."""
    ignored = [*LEGAL_SUFFIXES, "and"]

    def pattern(name: Column) -> Column:
        words = F.filter(F.split(name, " "), lambda w: w != "")
        meaningful = F.filter(words, lambda w: ~w.isin(ignored))
        tokens = F.when(F.size(meaningful) > 0, meaningful).otherwise(words)
        needed = F.when(F.size(tokens) == 1, tokens).otherwise(F.filter(tokens, lambda w: F.length(w) >= 2))
        return F.struct(
            F.concat(F.lit(" "), name, F.lit(" ")).alias("phrase"),
            F.transform(needed, lambda w: F.concat(F.lit(" "), w, F.lit(" "))).alias("words"),
        )

    return F.transform(F.filter(names, lambda n: n != ""), pattern)


def watchlist_patterns(watchlist: DataFrame) -> DataFrame:
    """Adds ``patterns`` of the search name and the aliases of each account."""
    names = F.concat(F.array("search_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    folded = _fold_names(watchlist.withColumn("names", names))
    return folded.withColumn("patterns", name_patterns(F.col("names"))).drop("names")


def _fold_names(watchlist: DataFrame) -> DataFrame:
    """Folds the names of an account one by one; a name in another script folds to nothing and matches nothing."""
    each = watchlist.select("account_id", F.posexplode("names").alias("place", "name")).withColumn("name", fold_accents("name"))
    folded = each.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("folded"))
    names = F.transform("folded", lambda x: F.coalesce(x["name"], F.lit("")))
    return watchlist.drop("names").join(folded, "account_id", "left").withColumn("names", names).drop("folded")


def mentions(text: Column, patterns: Column) -> Column:
    """``text`` (folded and padded) holds a name as a phrase, or all of its words."""
    return F.exists(
        patterns,
        lambda p: text.contains(p["phrase"]) | F.forall(p["words"], lambda w: text.contains(w)),
    )


def mentions_account(items: DataFrame, watchlist: DataFrame, *text_columns: str) -> DataFrame:
    """Adds ``mentioned``: the item names the account it was found for.

    Each item meets one watchlist row; the test is row-local.
    """
    patterns = watchlist_patterns(watchlist).select("account_id", "patterns")
    folded = F.concat(F.lit(" "), fold_accents(F.concat_ws(" ", *text_columns)), F.lit(" "))
    return (
        items.join(patterns, "account_id")
        .withColumn("folded", folded)
        .withColumn("mentioned", mentions(F.col("folded"), F.col("patterns")))
        .drop("folded", "patterns")
    )


# --- candidates ---------------------------------------------------------------------


def _segments(highlights: Column, text: Column) -> Column:
    """Trimmed paragraphs of the highlights, or of the text where there are none."""
    body = F.when(F.size(F.coalesce(highlights, F.array().cast("array<string>"))) > 0, highlights).otherwise(F.array(F.coalesce(text, F.lit(""))))
    parts = F.flatten(F.transform(body, lambda t: F.split(t, r"\n\s*\.\.\.\s*\n|\n{2,}")))
    tidy = F.transform(parts, lambda p: collapse(F.regexp_replace(p, r"^[#>*\s-]+", "")))
    return F.filter(tidy, lambda p: p != "")


def news_candidate_gate(results: DataFrame, watchlist: DataFrame, now: Column) -> DataFrame:
    """Search results (account_id, result_id, input_ord, title, url, published_at, highlights, text) with ``drop_reason``.

    NULL means candidate. Rules run cheap first; the account must be named in the
    title or in the first 700 characters of the body.
    """
    patterns = watchlist_patterns(watchlist).select("account_id", "patterns", F.lower("domain").alias("own_domain"), "exclude_own_domain")
    prepared = (
        results.join(patterns, "account_id")
        .withColumn("candidate_url", watch_url("url"))
        .withColumn("title", clip(collapse(F.coalesce("title", F.lit(""))), TITLE_CHARS))
        .withColumn("publisher", host_of("candidate_url"))
        .withColumn("body", F.array_join(_segments(F.col("highlights"), F.col("text")), " "))
    )
    host = F.col("publisher")
    listed = host_in_list(host, [*EXCLUDED_HOSTS, *LISTING_HOSTS, *REVIEW_HOSTS])
    own = F.col("exclude_own_domain") & F.col("own_domain").isNotNull() & (
        (host == F.col("own_domain")) | host.endswith(F.concat(F.lit("."), F.col("own_domain")))
    )
    old = F.col("published_at") < now - F.expr(f"INTERVAL {NEWS_LOOKBACK_DAYS + 1} DAYS")
    cheap = (
        F.when(F.col("candidate_url").isNull() | (F.col("title") == ""), "unusable")
        .when(listed, "excluded_host")
        .when(F.coalesce(own, F.lit(False)), "own_domain")
        .when(is_homepage(F.col("candidate_url")), "homepage")
        .when(F.col("title").rlike(APP_LISTING_TITLE), "app_listing")
        .when(F.coalesce(old, F.lit(False)), "too_old")
    )
    lead = F.concat_ws(" ", "title", F.substring("body", 1, LEAD_CHARS))
    return (
        prepared.withColumn("cheap_reason", cheap)
        .withColumn("lead", F.concat(F.lit(" "), fold_accents(F.when(F.col("cheap_reason").isNull(), lead)), F.lit(" ")))
        .withColumn("drop_reason", F.coalesce("cheap_reason", F.when(~mentions(F.col("lead"), F.col("patterns")), "not_named")))
        .withColumn("item_id", F.concat(F.lit("news:"), F.substring(F.sha2("candidate_url", 256), 1, 16)))
        .withColumn("excerpt", clip_ellipsis(F.col("body"), EXCERPT_CHARS))
        .drop("cheap_reason", "lead", "patterns", "own_domain", "exclude_own_domain", "body", "highlights", "text")
    )


# --- novelty, judgement, state ------------------------------------------------------


def news_novelty(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``novelty``: already_judged, repeated or fresh.

    ``candidates``: account_id, item_id, input_ord, title; ``state``: account_id,
    item_id, title, first_seen_at. An id counts across accounts, a story within
    its account; an id found by several accounts belongs to the first account name.
    """
    known = state.select(
        "account_id", F.col("item_id").alias("known_id"), F.unix_micros("first_seen_at").alias("known_ord"), "title"
    )
    place = F.struct("account_id", "input_ord")
    firsts = candidates.groupBy("item_id").agg(F.min(place).alias("first_place"))
    seen = state.select("item_id", F.lit(True).alias("seen")).distinct()
    with_id = candidates.join(seen, "item_id", "left").join(firsts, "item_id")
    matched = match_known_stories(with_id, known)
    old = F.col("seen") | F.col("known_id").isNotNull()
    staged = matched.withColumn("old", F.coalesce(old, F.lit(False))).withColumn("first_id", place == F.col("first_place"))
    rest = staged.filter("NOT old AND first_id").select("account_id", "item_id", "input_ord", "title")
    kept = first_of_story(rest).select("account_id", "item_id", "input_ord", "kept")
    return (
        staged.join(kept, ["account_id", "item_id", "input_ord"], "left")
        .withColumn(
            "novelty",
            F.when(F.col("old"), "already_judged").when(F.col("kept"), "fresh").otherwise("repeated"),
        )
        .drop("seen", "first_place", "known_id", "known_stories", "old", "first_id", "kept")
    )


def positions(rows: DataFrame, group: str, order: str, tie: str, slice_size: int = 65_536) -> DataFrame:
    """Adds ``position`` (1, 2, ...) within the group along a BIGINT order column.

    A group is numbered in slices of the order column; the offset of a slice is
    the number of rows before it, so a hot group is spread over its slices.
    """
    sliced = rows.withColumn("slice", F.floor(F.col(order) / slice_size))
    counts = sliced.groupBy(group, "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(group, "slice").orderBy(order, tie))
    return (
        sliced.withColumn("within", within).join(offsets, [group, "slice"])
        .withColumn("position", F.col("offset") + F.col("within")).drop("slice", "within", "offset")
    )


VERDICT_SCHEMA = (
    "account_id STRING, item_id STRING, about_account BOOLEAN, dated_event BOOLEAN, duplicate_of BIGINT, "
    "repeats_known_event BOOLEAN, impact STRING, confidence STRING, evidence STRING, what_happened STRING, "
    "why_it_matters STRING, next_step STRING, judge_error STRING"
)
VERDICT_COLUMNS = [part.strip().split(" ")[0] for part in VERDICT_SCHEMA.split(",")]

# Words of the deterministic judge that ships with the package.
RISK_WORDS = "layoffs|restructuring|insolvency|outage|breach|deprecating|consolidation"
OPPORTUNITY_WORDS = "launch|relaunch|acquisition|funding|migration|redesign|announced|released|hiring"


def rule_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic judge: impact by key words, evidence is the title."""
    text = (batch["title"] + " " + batch["excerpt"].fillna("")).str.lower()
    risk = text.str.contains(RISK_WORDS, regex=True)
    chance = text.str.contains(OPPORTUNITY_WORDS, regex=True)
    impact = pd.Series("neutral", index=batch.index).mask(chance, "opportunity").mask(risk, "risk")
    return pd.DataFrame({
        "account_id": batch["account_id"],
        "item_id": batch["item_id"],
        "about_account": True,
        "dated_event": batch["published_at"].notna(),
        "duplicate_of": None,
        "repeats_known_event": False,
        "impact": impact,
        "confidence": pd.Series("medium", index=batch.index).mask(risk, "high"),
        "evidence": batch["title"],
        "what_happened": batch["title"],
        "why_it_matters": impact.map({"risk": "Spending may fall.", "opportunity": "Spending may grow.", "neutral": ""}),
        "next_step": "Review with the account owner.",
    })


#: Its verdict on an item depends on that item alone, so an account's batches need not follow each other.
rule_judge.independent = True


def known_events(state: DataFrame) -> DataFrame:
    """(account_id, known): title and event of each material item that an account's state remembers."""
    told = state.filter((F.col("verdict") == "material") & F.col("event_text").isNotNull())
    return told.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("title", F.col("event_text").alias("what_happened")))).alias("known"))


NOT_ASKED = "account_stopped"


def _verdicts_of(batch: pd.DataFrame, error: str | None, found: pd.DataFrame | None) -> pd.DataFrame:
    rows = batch[["account_id", "item_id"]].copy() if found is None else batch[["account_id", "item_id"]].merge(found, on="item_id", how="left")
    rows["judge_error"] = error
    rows = rows.reindex(columns=VERDICT_COLUMNS).astype(object)
    return rows.where(rows.notna(), None)


def _asked(judge: Callable[[pd.DataFrame], pd.DataFrame], batch: pd.DataFrame, known: list, before: pd.DataFrame | None) -> pd.DataFrame:
    asked = batch[["account_id", "item_id", "title", "publisher", "published_at", "excerpt"]].reset_index(drop=True)
    asked["batch_index"] = range(len(asked))
    asked.attrs.update(known_events=known, judged_before=before)
    return judge(asked).drop(columns="account_id", errors="ignore").drop_duplicates("item_id")


def _judge_apart(fresh: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], batch_size: int, slice_size: int = 8192) -> DataFrame:
    """The verdicts of :func:`judge_batches` by a judge whose batches need not follow each other.

    Items are numbered in slices of the order column, as in :func:`positions`, and dealt by account and batch, so a
    task holds some slices or batches of an account and never the account.
    """
    # items without an account are those of one; those without a place come first
    who, part = F.coalesce("account_id", F.lit("\0")), F.coalesce(F.floor(F.col("input_ord") / slice_size), F.lit(-(1 << 62)))
    plain = fresh.select(who.alias("who"), part.alias("slice"), "account_id", "item_id", "input_ord", "title", "publisher", "published_at", "excerpt")
    before = Window.partitionBy("who").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = plain.groupBy("who", "slice").agg(F.count("*").alias("n")).select("who", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("who", "slice").orderBy("input_ord", "item_id"))
    numbered = plain.withColumn("within", within).join(offsets, ["who", "slice"]).withColumn("place", F.col("offset") + F.col("within") - 1)
    dealt = numbered.withColumn("batch", F.floor(F.col("place") / batch_size)).drop("slice", "within", "offset", "input_ord")

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = _verdicts_of(batch, None, _asked(judge, batch, [], None))
        except Exception as error:
            rows = _verdicts_of(batch, type(error).__name__, None)
        return rows.assign(who=batch["who"].iloc[0], batch=batch["batch"].iloc[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            number = ((held["who"] != held["who"].shift()) | (held["batch"] != held["batch"].shift())).cumsum()
            # whole batches go; the last one may go on in the next frame
            for _, batch in held[number < number.iloc[-1]].groupby(number[number < number.iloc[-1]]):
                yield ask(batch)
            held = held[number == number.iloc[-1]].reset_index(drop=True)
        if held is not None and len(held):
            yield ask(held)

    sorted_batches = dealt.repartition("who", "batch").sortWithinPartitions("who", "batch", "place")
    made = written(sorted_batches.mapInPandas(run, f"{VERDICT_SCHEMA}, who STRING, batch BIGINT"), "verdicts")
    stops = made.filter("judge_error IS NOT NULL").groupBy("who").agg(F.min("batch").alias("stop"))
    late = F.coalesce(F.col("batch") > F.col("stop"), F.lit(False))
    kept = ["account_id", "item_id"]
    columns = [F.when(late, F.lit(NOT_ASKED)).otherwise(F.col(c)).alias(c) if c == "judge_error" else F.when(~late, F.col(c)).alias(c) for c in VERDICT_COLUMNS if c not in kept]
    return made.join(stops, "who", "left").select(*kept, *columns)


def judge_batches(
    fresh: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame] = rule_judge, batch_size: int = NEWS_JUDGE_BATCH, state: DataFrame | None = None
) -> DataFrame:
    """Verdicts of a judge function over batches of ten items of one account, in the items' order.

    ``fresh``: account_id, item_id, input_ord, title, publisher, published_at,
    excerpt. The judge gets one batch as a pandas frame with ``batch_index``; its ``attrs["known_events"]`` lists what
    the (pruned) ``state`` knows of the account, ``attrs["judged_before"]`` is the account's last batch with its verdicts, or None.
    Each item of a batch gets one row: its first verdict, or none (all NULL) if the
    judge left it out. A batch whose judge raises yields rows with the error's name in ``judge_error`` and stops its account:
    the judge is not asked about later batches, whose rows have ``account_stopped`` there.

    Rows are dealt by account and sorted; a task goes through them once and holds one batch. An account's batches follow
    each other by this contract, so an account is one task's work, however many items it has - unless the judge has a
    true attribute ``independent`` and there is no ``state``: it makes no use of what was judged before, so the same
    batches are dealt one by one, written, and what follows an account's first failed batch is taken back.
    """
    if state is None and getattr(judge, "independent", False):
        return _judge_apart(fresh, judge, batch_size)
    # items without an account are those of one
    who = F.coalesce("account_id", F.lit("\0")).alias("who")
    plain = fresh.select(who, "account_id", "item_id", "input_ord", "title", "publisher", "published_at", "excerpt")
    # the list travels with the account's first item only
    nothing = F.lit(None).cast("array<struct<title: string, what_happened: string>>")
    if state is None:
        told = plain.withColumn("known", nothing)
    else:
        first = plain.groupBy("account_id").agg(F.min(F.struct("input_ord", "item_id")).alias("f")).join(known_events(state), "account_id")
        first = first.select("account_id", F.col("f.input_ord").alias("input_ord"), F.col("f.item_id").alias("item_id"), "known")
        told = plain.join(first, ["account_id", "input_ord", "item_id"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, known, stopped, before = None, [], False, None

        def ask(batch: pd.DataFrame) -> pd.DataFrame:
            nonlocal account, known, stopped, before
            if batch["who"].iloc[0] != account:
                account, stopped, before = batch["who"].iloc[0], False, None
                listed = batch["known"].iloc[0]
                known = [] if listed is None else [dict(x) if isinstance(x, dict) else x.asDict() for x in listed]
            if stopped:
                return _verdicts_of(batch, NOT_ASKED, None)
            try:
                before = _verdicts_of(batch, None, _asked(judge, batch, known, before))
                return before
            except Exception as error:
                stopped = True
                return _verdicts_of(batch, type(error).__name__, None)

        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            # whole batches go; the last one may go on in the next frame
            place = held.groupby("who", sort=False).cumcount() // batch_size
            number = ((held["who"] != held["who"].shift()) | (place != place.shift())).cumsum()
            # an account's batches are counted from its first held row, so what is held begins with a batch
            for _, batch in held[number < number.iloc[-1]].groupby(number[number < number.iloc[-1]]):
                yield ask(batch)
            held = held[number == number.iloc[-1]].reset_index(drop=True)
        if held is not None and len(held):
            yield ask(held)

    return told.repartition("who").sortWithinPartitions("who", "input_ord", "item_id").mapInPandas(run, VERDICT_SCHEMA)


def evidence_supported(quote: Column | str, title: Column | str, excerpt: Column | str) -> Column:
    """The folded quote has four or more words and occurs in the folded item."""
    folded = fold_accents(quote)
    return (F.size(F.split(folded, " ")) >= 4) & fold_accents(F.concat_ws(" ", as_col(title), as_col(excerpt))).contains(folded)


def material_events(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Judged items with ``material`` and, for material ones, the event texts.

    An item counts once: with its first verdict (by ``verdict_ord`` where the verdicts have one, else the least row),
    and as not material without any. Items of a batch whose judge failed stay unjudged.
    """
    def line(name: str, limit: int) -> Column:
        return F.substring(collapse(F.coalesce(F.col(name), F.lit(""))), 1, limit)

    keys = ["account_id", "item_id"]
    given = verdicts.filter(F.col("judge_error").isNull()).drop("judge_error").withColumnRenamed("evidence", "quote")
    fields = F.struct(*[c for c in given.columns if c not in (*keys, "verdict_ord")])
    first = given.groupBy(*keys).agg(F.min_by(fields, F.struct("verdict_ord", fields) if "verdict_ord" in given.columns else fields).alias("v"))
    failed = verdicts.filter(F.col("judge_error").isNotNull()).select(*keys).distinct()
    unjudged = failed.join(first, keys, "left_anti")
    joined = items.join(unjudged, keys, "left_anti").join(first.select(*keys, "v.*"), keys, "left")
    passes = (
        F.col("about_account") & F.col("dated_event") & F.col("duplicate_of").isNull() & ~F.coalesce("repeats_known_event", F.lit(False))
        & (F.col("impact") != "neutral") & (F.col("confidence") != "low")
    )
    cheap = joined.withColumn("passes", F.coalesce(passes, F.lit(False)))
    # folding is the expensive part; only the verdicts that pass are folded
    quoted = F.when(F.col("passes"), F.col("quote"))
    material = (
        F.col("passes") & evidence_supported(F.coalesce(quoted, F.lit("")), F.when(F.col("passes"), F.col("title")), F.when(F.col("passes"), F.col("excerpt")))
        & (line("what_happened", 280) != "") & (line("why_it_matters", 220) != "")
    )
    judged = cheap.withColumn("material", material)
    return judged.select(
        *items.columns, "material",
        *[F.when(F.col("material"), column).alias(name) for name, column in (
            ("direction", F.col("impact")), ("event_confidence", F.col("confidence")), ("event_text", line("what_happened", 280)),
            ("reason_text", line("why_it_matters", 220)), ("next_text", line("next_step", 140)),
        )],
    )


STATE_COLUMNS = [
    "item_id", "account_id", "title", "url", "publisher", "published_at", "first_seen_at", "verdict",
    "direction", "event_confidence", "event_text", "reason_text", "next_text",
]


def prune_news_state(state: DataFrame, now: Column, days: int = NEWS_RETENTION_DAYS) -> DataFrame:
    return state.filter(F.col("first_seen_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def news_state_upsert(state: DataFrame, judged: DataFrame, now: Column, days: int = NEWS_RETENTION_DAYS) -> DataFrame:
    """State after a scan: items older than the retention fall, judged items come in.

    ``judged`` has the state columns but verdict and first_seen_at, plus ``material``.
    """
    kept = prune_news_state(state, now, days).select(*STATE_COLUMNS)
    incoming = judged.withColumn("first_seen_at", now).withColumn("verdict", F.when(F.col("material"), "material").otherwise("neutral")).select(*STATE_COLUMNS)
    fresh = incoming.dropDuplicates(["item_id"])
    return kept.join(fresh.select("item_id"), "item_id", "left_anti").select(*STATE_COLUMNS).unionByName(fresh)


def pending_candidates(state: DataFrame, reported: DataFrame, watchlist: DataFrame, now: Column) -> DataFrame:
    """Material, undelivered events of watched accounts first seen within the lookback."""
    return (
        state.filter((F.col("verdict") == "material") & F.col("event_text").isNotNull() & (F.col("first_seen_at") >= now - F.expr(f"INTERVAL {NEWS_LOOKBACK_DAYS} DAYS")))
        .join(reported.select(F.col("signal_id").alias("item_id")).distinct(), "item_id", "left_anti")
        .join(watchlist.select("account_id", F.col("name").alias("account_name")), "account_id")
        .withColumn("carried_over", F.col("first_seen_at") != now)
    )


def news_pending(candidates: DataFrame, limit: int = NEWS_MAX_EVENTS, scan: str | None = None) -> DataFrame:
    """The first events to deliver, oldest first, then the more certain ones; plus what lies beyond."""
    by = [scan] if scan else []
    rank = choose(F.col("event_confidence"), {"high": 2, "medium": 1}, 0)
    order = [F.asc("first_seen_at"), F.desc(rank), F.asc("account_name"), F.asc("item_id")]
    totals = F.greatest(F.lit(0).cast("bigint"), F.count("*") - limit).alias("pending_beyond_limit")
    if not by:
        first = candidates.orderBy(*order).limit(limit)
        return first.withColumn("pending_beyond_limit", candidates.agg(totals).scalar())
    first = candidates.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= limit)
    return first.drop("rn").join(candidates.groupBy(*by).agg(totals), by)


def news_scan_summary(watchlist: DataFrame, searches: DataFrame, failures: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """Counts and status of one scan, one row.

    ``searches``: account_id, ok; ``failures``: account_id, of accounts whose judge failed; ``counts``: what was counted
    while the scan wrote its tables (results, candidates, already_judged, judged, material).
    """
    failed = searches.filter("NOT ok").select("account_id").unionByName(failures.select("account_id")).distinct()
    kinds = {"total_accounts": watchlist, "searched": searches.filter("ok"), "failed_accounts": failed}
    rows = None
    for kind, frame in kinds.items():
        part = frame.select(F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    summary = rows.agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds])
    summary = summary.withColumns({name: F.lit(int(counts[name])).cast("bigint") for name in ("results", "candidates", "already_judged", "judged", "material")})
    return summary.withColumn(
        "status", F.when(F.col("searched") == 0, "failed").when(F.col("failed_accounts") > 0, "partial").otherwise("succeeded")
    )
