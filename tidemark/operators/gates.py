"""Row gates: first-party sources, crawl rules, quarantine, redaction, delivered ids."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import WHITESPACE, as_col, clean, contains_any, instruction_like, let, non_empty, trim_all
from tidemark.functions.urls import canonical_url, host_in_domains, host_of, origin_of, path_of
from tidemark.functions.vocabulary import (
    DELIVERED_STATUS,
    MESSAGE_CHARS,
    RAW_KEY,
    REDACTIONS,
    REPORTED_ID,
    REPORTED_IDS_LINE,
    SECRET_KEY,
    TECHNOLOGY_TERMS,
    TRACKING_PARAMETERS,
    JOB_TRACKING_PARAMETERS,
)


def news_url(url: Column | str) -> Column:
    """Public https page: no credentials, no tracking parameters, no trailing slash."""
    return canonical_url(
        url, schemes=("https",), drop_parameters=TRACKING_PARAMETERS, trim_slashes="all", excluded_host="linkedin.com"
    )


def page_url(url: Column | str) -> Column:
    return canonical_url(url, schemes=("https",), drop_parameters=TRACKING_PARAMETERS, trim_slashes="all")


def watch_url(url: Column | str) -> Column:
    return canonical_url(url, drop_parameters=TRACKING_PARAMETERS)


def job_url(url: Column | str) -> Column:
    """Canonical URL of a posting; text that is no URL is lower-cased without query and fragment."""

    def build(text: Column) -> Column:
        usable = canonical_url(text, drop_parameters=JOB_TRACKING_PARAMETERS, trim_slashes="one", allow_credentials=True)
        plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[?#].*$", ""), "/$", "")
        return F.coalesce(usable, F.nullif(plain, F.lit("")))

    return let(clean(url, False), build)


def url_canonicalize_dedupe(urls: DataFrame, url: str = "url", key: str = "page_id", canonical=news_url) -> DataFrame:
    """One row per canonical URL: the smallest key, the number of copies. Combined before the shuffle."""
    return (
        urls.select(canonical(url).alias("canonical_url"), key)
        .filter(F.col("canonical_url").isNotNull())
        .groupBy("canonical_url")
        .agg(F.min(key).alias(key), F.count("*").alias("copies"))
    )


def first_party(url: Column | str, domains: Column | str) -> Column:
    return host_in_domains(host_of(as_col(url)), as_col(domains))


def first_party_filter(items: DataFrame, accounts: DataFrame, url: str = "url") -> DataFrame:
    """Items on a domain of their own account; one row per account on the build side, no row growth."""
    return (
        items.join(accounts.select("account_id", F.col("domains").alias("account_domains")), "account_id")
        .filter(first_party(url, "account_domains"))
        .drop("account_domains")
    )


def robots_rules(body: Column | str) -> Column:
    """Allow and disallow prefixes of the ``*`` agent, in file order."""
    lines = F.transform(
        F.split(F.coalesce(as_col(body), F.lit("")), "\r?\n"),
        lambda raw: trim_all(F.regexp_replace(raw, "#.*", "")),
    )
    fields = F.transform(
        F.filter(lines, lambda line: line.contains(":")),
        lambda line: F.struct(
            F.lower(trim_all(F.regexp_extract(line, "^([^:]*):", 1))).alias("key"),
            trim_all(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )
    empty = F.array().cast("array<struct<allow: boolean, path: string>>")
    scanned = F.aggregate(
        fields,
        F.struct(F.lit(False).alias("on"), empty.alias("rules")),
        lambda state, field: F.when(
            field["key"] == "user-agent", F.struct((field["value"] == "*").alias("on"), state["rules"].alias("rules"))
        ).when(
            state["on"] & field["key"].isin("allow", "disallow") & (field["value"] != ""),
            F.struct(
                state["on"].alias("on"),
                F.concat(
                    state["rules"],
                    F.array(F.struct((field["key"] == "allow").alias("allow"), F.replace(field["value"], F.lit("*"), F.lit("")).alias("path"))),
                ).alias("rules"),
            ),
        ).otherwise(state),
    )
    return scanned["rules"]


def robots_filter(frontier: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed``: the longest matching prefix decides, the first in the file on ties.

    ``robots`` has one row per origin (origin, status, body); its rules become one
    array per origin, bounded by the size of a robots file, so a URL meets one row
    and is never paired with single rules. Missing files (404, 410) allow, any
    other failure forbids; an origin without a row counts as unavailable.
    """
    rules = robots.select(
        "origin",
        F.when(F.col("status").isin(404, 410), F.lit(True)).otherwise(F.col("status").between(200, 299)).alias("available"),
        F.when(F.col("status").between(200, 299), robots_rules("body")).alias("rules"),
    )
    path = path_of(as_col(url))
    matching = F.filter("rules", lambda r: F.startswith(path, r["path"]))
    longest = F.array_max(F.transform(matching, lambda r: F.length(r["path"])))
    decision = F.get(F.filter(matching, lambda r: F.length(r["path"]) == longest), 0)["allow"]
    return (
        frontier.withColumn("origin", origin_of(url))
        .join(rules, "origin", "left")
        .withColumn("allowed", F.coalesce("available", F.lit(False)) & F.coalesce(decision, F.lit(True)))
        .drop("available", "rules")
    )


def quarantine_instruction_like(rows: DataFrame, *text_columns: str, normalize: bool = True) -> DataFrame:
    """Adds ``quarantined``; both branches stay available to the caller."""
    text = clean(F.concat_ws(" ", *text_columns), normalize)
    return rows.withColumn("quarantined", F.coalesce(instruction_like(text), F.lit(False)))


def news_item_gate(items: DataFrame, accounts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds canonical fields and ``reason``: ``accepted`` or the first rule that fails."""
    joined = items.join(accounts.select("account_id", F.col("domains").alias("account_domains")), "account_id", "left")
    prepared = joined.select(
        *[c for c in items.columns if c not in ("title", "excerpt", "author", "canonical_url", "source_url")],
        news_url("source_url").alias("source_url"),
        news_url(F.coalesce("canonical_url", "source_url")).alias("canonical_url"),
        non_empty("title").alias("title"),
        non_empty("excerpt").alias("excerpt"),
        non_empty("author").alias("author"),
        "account_domains",
    )
    required = ["source_url", "canonical_url", "title", "excerpt", "published_at"]
    malformed = ~F.coalesce(F.col("kind").isin("article", "post"), F.lit(False))
    for name in required:
        malformed = malformed | F.col(name).isNull()
    text = F.lower(F.concat_ws(" ", "title", "excerpt"))
    reason = (
        F.when(malformed, "malformed")
        .when(F.col("author").isNull(), "unattributed")
        .when(~(first_party("source_url", "account_domains") & first_party("canonical_url", "account_domains")), "not_first_party")
        .when(~F.col("published_at").between(start, end), "outside_window")
        .when(~contains_any(text, TECHNOLOGY_TERMS), "irrelevant")
        .otherwise("accepted")
    )
    return prepared.withColumn("reason", reason).drop("account_domains")


def redact_text(message: Column | str, limit: int = MESSAGE_CHARS) -> Column:
    """Credentials masked, control characters blanked, at most ``limit`` characters."""
    text = as_col(message)
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.substring(trim_all(text), 1, limit)


def redact_json(details: Column | str, limit: int = MESSAGE_CHARS) -> Column:
    """JSON text with the rules of :func:`redact_text` and :func:`redact_details` at any depth.

    Under a secret-like or raw-payload-like key the whole value goes, be it text, list or object; every other text is
    masked, in lists too; numbers, booleans, nulls, and the order of keys stay. Text that is no JSON is masked as a
    message, NULL stays NULL.
    """
    secret, raw = (re.compile(pattern, re.ASCII) for pattern in (SECRET_KEY, RAW_KEY))
    masks = [(re.compile(pattern, re.ASCII), replacement.replace("$1", r"\1")) for pattern, replacement in REDACTIONS]
    blank = re.compile(f"^(?:{WHITESPACE})+|(?:{WHITESPACE})+$")

    def message(text: str) -> str:
        for pattern, replacement in masks:
            text = pattern.sub(replacement, text)
        return blank.sub("", text)[:limit]

    def walk(value, key: str = ""):
        if secret.search(key) or raw.search(key):
            return "[REDACTED]"
        if isinstance(value, str):
            return message(value)
        if isinstance(value, list):
            return [walk(item) for item in value]
        if isinstance(value, dict):
            return {name: walk(item, name) for name, item in value.items()}
        return value

    def redacted(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return message(text)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(redacted)

    return mask(as_col(details))


def redact_details(details: Column | str) -> Column:
    """Map of log details: secret-like and raw-payload keys lose their whole value."""
    return F.transform_values(
        as_col(details),
        lambda key, value: F.when(key.rlike(SECRET_KEY) | key.rlike(RAW_KEY), F.lit("[REDACTED]")).otherwise(redact_text(value)),
    )


def extract_reported_ids(messages: DataFrame) -> DataFrame:
    """Delivered ids of brief messages (message_id, text): only finished briefs count.

    One row per (message, id) with the first position of the id in the message.
    """
    finished = messages.filter(F.col("text").rlike(DELIVERED_STATUS))
    lines = finished.select("message_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(
        F.col("line").rlike(REPORTED_IDS_LINE)
    )
    listed = F.regexp_extract("line", REPORTED_IDS_LINE, 1)
    tokens = lines.select("message_id", "line_no", F.posexplode(F.split(listed, r"[,\s]+")).alias("token_no", "token"))
    cleaned = tokens.withColumn("signal_id", trim_all(F.regexp_replace("token", "^`|`$", "")))
    valid = cleaned.filter(F.col("signal_id").rlike(REPORTED_ID) & (F.lower("signal_id") != "none"))
    return (
        valid.groupBy("message_id", "signal_id")
        .agg(F.min(F.struct("line_no", "token_no")).alias("first"))
        .select("message_id", "signal_id", F.col("first.line_no").alias("line_no"), F.col("first.token_no").alias("token_no"))
    )


def item_fingerprint() -> Column:
    """Title, excerpt, day and author of an item, case and white space folded."""

    def folded(name: str) -> Column:
        return F.regexp_replace(F.lower(F.col(name)), f"{WHITESPACE}+", " ")

    day = F.date_format("published_at", "yyyy-MM-dd")
    return F.sha2(F.concat_ws("|", folded("title"), folded("excerpt"), day, F.lower("author")), 256)


def news_item_dedupe(accepted: DataFrame) -> DataFrame:
    """Adds ``kept`` to accepted items (account_id, item_id, input_ord, canonical_url, ...).

    An item falls when an earlier *kept* item of the account has its URL or its
    fingerprint; a fallen item blocks nothing.
    """
    from tidemark.operators.greedy import first_by_two_keys

    keyed = accepted.withColumn("fingerprint", item_fingerprint())
    return first_by_two_keys(keyed, "account_id", "item_id", "input_ord", "canonical_url", "fingerprint")
