"""Deterministic, content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import as_col, iso_millis, trim_all, unicode_normal

STABLE_ID_PATTERN = "^[a-z][a-z0-9_]*_[a-f0-9]{32}$"


def identity_text(*parts: Column | str, ascii_only: bool = False) -> Column:
    """Length-prefixed join of the parts; NULL when a part is missing or empty."""
    pieces = []
    for part in parts:
        text = as_col(part).cast("string")
        text = trim_all(text if ascii_only else unicode_normal(text))
        text = F.when(text != "", text)
        pieces.append(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    joined = pieces[0]
    for piece in pieces[1:]:
        joined = F.concat(joined, F.lit("|"), piece)
    return joined


def stable_id(namespace: str, *parts: Column | str, ascii_only: bool = False, strict: bool = False) -> Column:
    """``namespace_`` + 32 hex digits of the SHA-256 of the identity.

    ``ascii_only`` skips Unicode normalisation for parts known to be plain
    (numeric keys, canonical timestamps, other ids) and keeps the projection
    inside one JVM stage. An empty part gives NULL, or an error when ``strict``.
    """
    identity = identity_text(*parts, ascii_only=ascii_only)
    if strict:
        identity = F.coalesce(identity, F.raise_error(F.lit("stable id parts must not be empty")).cast("string"))
    return F.concat(F.lit(f"{namespace}_"), F.substring(F.sha2(identity, 256), 1, 32))


def account_id(record_id, **kw) -> Column:
    return stable_id("acct", F.lit("salesforce"), record_id, **kw)


def owner_id(role, record_id, **kw) -> Column:
    return stable_id("owner", role, record_id, **kw)


def evidence_id(system, record_id, captured_at, **kw) -> Column:
    return stable_id("evidence", system, record_id, iso_millis(captured_at), **kw)


def observation_id(account, system, record_id, observed_at, **kw) -> Column:
    return stable_id("observation", account, system, record_id, iso_millis(observed_at), **kw)


def snapshot_id(account, system, window_start, window_end, **kw) -> Column:
    return stable_id("snapshot", account, system, iso_millis(window_start), iso_millis(window_end), **kw)


def signal_id(account, category, system, record_id, observed_at, **kw) -> Column:
    return stable_id("signal", account, category, system, record_id, iso_millis(observed_at), **kw)


def run_id(window_start, window_end, started_at, **kw) -> Column:
    return stable_id("run", iso_millis(window_start), iso_millis(window_end), iso_millis(started_at), **kw)


def audit_ids(rows: DataFrame, id_col: str, identity: Column) -> DataFrame:
    """Ids that stand for more than one identity (collisions), with row counts."""
    return (
        rows.select(F.col(id_col), identity.alias("identity"))
        .groupBy(id_col)
        .agg(F.count("*").alias("rows"), F.min("identity").alias("first_identity"), F.max("identity").alias("last_identity"))
        .withColumn("collision", ~F.col("first_identity").eqNullSafe(F.col("last_identity")))
    )
