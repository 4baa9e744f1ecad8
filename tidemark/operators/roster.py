"""Account roster normalisation and record validators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import STABLE_ID_PATTERN, account_id, owner_id
from tidemark.functions.text import clean, computed, let, trim_all
from tidemark.functions.urls import canonical_url, url_parts
from tidemark.functions.vocabulary import (
    DIRECTIONS,
    OWNER_ROLE_ALIASES,
    OWNER_ROLES,
    RUN_STATUSES,
    SEVERITIES,
    SIGNAL_CATEGORIES,
    SOURCE_SYSTEMS,
)
from tidemark.operators.ranking import choose
from tidemark.session import cut_lineage


def normalize_domain(value: Column, normalize: bool = True) -> Column:
    """Bare host of a domain or site URL; NULL unless it is a dotted host without path, query or user."""

    def read(url: Column) -> Column:
        plain = ~url.rlike(r"\?[^#]") & ~url.rlike("#.")
        return let(
            url_parts(url),
            lambda p: F.when(
                plain & p["scheme"].isin("http", "https") & ~p["credentials"] & (p["path"] == "/"),
                F.regexp_replace(F.regexp_replace(p["host"], r"^www\.", ""), r"\.$", ""),
            ),
        )

    text = F.lower(clean(value, normalize))
    host = let(text, lambda t: read(F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))))
    return let(host, lambda h: F.when(h.contains("."), h))


@dataclass(frozen=True)
class RosterResult:
    accounts: DataFrame
    domains: DataFrame
    owners: DataFrame
    warnings: DataFrame


def roster_normalize(rows: DataFrame, named_roles: dict[str, str] | None = None, normalize: bool = True) -> RosterResult:
    """Roster rows -> accounts, their domains and owners, and warnings.

    Input columns: row_index, source_record_id, name, domains (array), careers_url,
    linkedin_url, owner_name, owner_role, source_owner_id. ``named_roles`` maps a
    lower-case owner name to a role that wins and must agree with the row.

    Domains and owners of an account stay child tables ordered by ``first_row``:
    the aggregates hold one value per account however often it repeats.
    """
    named = {k.lower(): v for k, v in (named_roles or {}).items()}

    def role(r: Column) -> Column:
        given = choose(r["role_text"], OWNER_ROLE_ALIASES)
        fixed = choose(F.lower(r["clean_owner"]), named) if named else F.lit(None).cast("string")
        return F.when(fixed.isNotNull(), F.when(given.isNull() | (given == fixed), fixed)).when(r["owner_key"] != "", given)

    def domains(r: Column) -> Column:
        read = F.transform(r["d"], lambda d: F.struct(d.alias("raw"), normalize_domain(d, False).alias("domain")))
        return let(read, lambda found: F.struct(
            F.array_distinct(F.filter(F.transform(found, lambda x: x["domain"]), lambda x: x.isNotNull())).alias("good"),
            F.size(F.filter(found, lambda x: x["domain"].isNull() & (x["raw"] != ""))).alias("bad"),
        ))

    def check(r: Column) -> Column:
        return let(
            F.struct(domains(r).alias("domains"), role(r).alias("role"), canonical_url(r["careers_text"], allow_credentials=True).alias("careers"),
                     canonical_url(r["linkedin_text"], allow_credentials=True).alias("linkedin")),
            lambda c: F.struct(
                *[r[name].alias(name) for name in ("record", "clean_name", "clean_owner", "owner_key")],
                c["role"].alias("role"), c["domains"]["good"].alias("good_domains"), c["domains"]["bad"].alias("bad_domains"),
                c["careers"].alias("careers"), c["linkedin"].alias("linkedin"),
                ((r["careers_text"] != "") & c["careers"].isNull()).alias("careers_bad"), ((r["linkedin_text"] != "") & c["linkedin"].isNull()).alias("linkedin_bad"),
                F.when(r["record"] == "", "missing_source_record_id").when(r["clean_name"] == "", "missing_name")
                .when(F.size(c["domains"]["good"]) == 0, "missing_domain").when((r["clean_owner"] == "") | c["role"].isNull(), "unmapped_owner").alias("fatal"),
            ),
        )

    texts = F.struct(
        clean("source_record_id", normalize).alias("record"), clean("name", normalize).alias("clean_name"), clean("owner_name", normalize).alias("clean_owner"),
        clean("source_owner_id", normalize).alias("owner_key"), clean("careers_url", normalize).alias("careers_text"), clean("linkedin_url", normalize).alias("linkedin_text"),
        F.regexp_replace(F.lower(clean("owner_role", normalize)), "[\\u2013\\u2014]", "-").alias("role_text"),
        F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d: clean(d, False)).alias("d"),
    )
    # four result tables are read from these rows
    checked = cut_lineage(computed(rows.select("row_index", texts.alias("t")), let(F.col("t"), check)).drop("t"))
    has_owner_key = F.col("owner_key") != ""
    identified = F.coalesce(~F.col("fatal").isin("missing_source_record_id", "missing_name"), F.lit(True))
    row_codes = F.concat(
        F.when(identified, F.array_repeat(F.lit("invalid_domain"), F.col("bad_domains"))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.col("fatal"),
            F.when(F.col("fatal").isNull() & F.col("careers_bad"), "invalid_url"),
            F.when(F.col("fatal").isNull() & F.col("linkedin_bad"), "invalid_url"),
        )),
    )
    row_warnings = checked.select("row_index", F.explode(row_codes).alias("code"), F.col("record").alias("source_record_id"))

    usable = checked.filter(F.col("fatal").isNull())
    grouped = usable.groupBy("record").agg(
        F.min_by("clean_name", "row_index").alias("name"),
        (F.min("clean_name") != F.max("clean_name")).alias("name_conflict"),
        F.min_by("careers", F.when(F.col("careers").isNotNull(), F.col("row_index"))).alias("careers_url"),
        F.coalesce(F.min("careers") != F.max("careers"), F.lit(False)).alias("careers_conflict"),
        F.min_by("linkedin", F.when(F.col("linkedin").isNotNull(), F.col("row_index"))).alias("linkedin_url"),
        F.coalesce(F.min("linkedin") != F.max("linkedin"), F.lit(False)).alias("linkedin_conflict"),
    )
    conflict = F.col("name_conflict") | F.col("careers_conflict") | F.col("linkedin_conflict")
    clashing = grouped.filter(conflict).select(
        "record", F.col("name").alias("first_name"), F.col("careers_url").alias("first_careers"), F.col("linkedin_url").alias("first_linkedin")
    )
    conflicts = usable.join(clashing, "record").select(
        "row_index",
        F.explode(F.array_compact(F.array(
            F.when(F.col("clean_name") != F.col("first_name"), "conflicting_account_field"),
            F.when(F.col("careers") != F.col("first_careers"), "conflicting_account_field"),
            F.when(F.col("linkedin") != F.col("first_linkedin"), "conflicting_account_field"),
        ))).alias("code"),
        F.col("record").alias("source_record_id"),
    )
    accounts = grouped.filter(~conflict).select(
        account_id("record", ascii_only=not normalize).alias("account_id"),
        F.col("record").alias("source_record_id"), "name", "careers_url", "linkedin_url",
    )
    kept = usable.join(grouped.filter(conflict).select("record"), "record", "left_anti")
    domains = (
        kept.select("record", "row_index", F.posexplode("good_domains").alias("pos", "domain"))
        .groupBy("record", "domain")
        .agg(F.min(F.struct("row_index", "pos")).alias("first"))
        .select(account_id("record", ascii_only=not normalize).alias("account_id"), "domain",
                F.col("first.row_index").alias("first_row"), F.col("first.pos").alias("first_pos"))
    )
    owner = owner_id("role", F.when(has_owner_key, F.col("owner_key")).otherwise(F.lower("clean_owner")), ascii_only=not normalize)
    owners = (
        kept.select("record", "row_index", owner.alias("owner_id"), "clean_owner", "role")
        .groupBy("record", "owner_id")
        .agg(F.min_by("clean_owner", "row_index").alias("owner_name"), F.first("role").alias("role"), F.min("row_index").alias("first_row"))
        .select(account_id("record", ascii_only=not normalize).alias("account_id"), "owner_id", "owner_name", "role", "first_row")
    )
    return RosterResult(accounts, domains, owners, row_warnings.unionByName(conflicts))


# --- validators -----------------------------------------------------------------


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that do not hold; an unknown outcome counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in rules]))


def _filled(value: Column | str) -> Column:
    return F.coalesce(trim_all(value) != "", F.lit(False))


def _url_or_null(value: str) -> Column:
    return F.col(value).isNull() | F.col(value).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$")


def validate_accounts(accounts: DataFrame) -> DataFrame:
    lowered = F.transform("domains", lambda d: F.lower(d))
    owner_ids = F.transform("owners", lambda o: o["id"])
    return accounts.withColumn("violations", violations([
        ("id", F.col("account_id").rlike(STABLE_ID_PATTERN)),
        ("source_record_id", _filled("source_record_id")),
        ("name", _filled("name")),
        ("domains_empty", F.size("domains") >= 1),
        ("domains_blank", F.forall("domains", lambda d: trim_all(d) != "")),
        ("domains_unique", F.size(F.array_distinct(lowered)) == F.size("domains")),
        ("careers_url", _url_or_null("careers_url")),
        ("linkedin_url", _url_or_null("linkedin_url")),
        ("owners_empty", F.size("owners") >= 1),
        ("owners_unique", F.size(F.array_distinct(owner_ids)) == F.size("owners")),
        ("owner_role", F.forall("owners", lambda o: o["role"].isin(OWNER_ROLES))),
    ]))


def validate_observations(observations: DataFrame) -> DataFrame:
    return observations.withColumn("violations", violations([
        ("id", F.col("observation_id").rlike(STABLE_ID_PATTERN)),
        ("category", F.col("category").isin(SIGNAL_CATEGORIES)),
        ("source_system", F.col("source_system").isin(SOURCE_SYSTEMS)),
        ("evidence_empty", F.size("evidence") >= 1),
        ("evidence_source", F.exists("evidence", lambda e: e["source_system"] == F.col("source_system"))),
        ("received_at", F.col("received_at") >= F.col("observed_at")),
    ]))


def validate_signals(signals: DataFrame) -> DataFrame:
    metric_ok = F.col("metric_name").isNull() | (
        _filled("metric_name") & _filled("metric_unit") & ~F.isnan("metric_value") & (F.abs("metric_value") < float("inf"))
        & (F.col("metric_previous").isNull() | (~F.isnan("metric_previous") & (F.abs("metric_previous") < float("inf"))))
    )
    return signals.withColumn("violations", violations([
        ("category", F.col("category").isin(SIGNAL_CATEGORIES)),
        ("source_system", F.col("source_system").isin(SOURCE_SYSTEMS)),
        ("title", _filled("title")),
        ("detail", _filled("detail")),
        ("direction", F.col("direction").isin(DIRECTIONS)),
        ("severity", F.col("severity").isin(SEVERITIES)),
        ("confidence", ~F.isnan("confidence") & F.col("confidence").between(0, 1)),
        ("evidence_empty", F.size("evidence") >= 1),
        ("evidence_source", F.exists("evidence", lambda e: e["source_system"] == F.col("source_system"))),
        ("metric", metric_ok),
    ]))


def validate_snapshots(headers: DataFrame, observations: DataFrame) -> DataFrame:
    """Headers with the rules they and their children break; children are counted before the join."""
    children = observations.join(
        headers.select("snapshot_id", F.col("account_id").alias("h_account"), F.col("source_system").alias("h_system")), "snapshot_id"
    ).groupBy("snapshot_id").agg(
        F.count("*").alias("observations"),
        F.count_if(F.col("account_id") != F.col("h_account")).alias("foreign_account"),
        F.count_if(F.col("source_system") != F.col("h_system")).alias("foreign_system"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        headers.join(children, "snapshot_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("observations", "foreign_account", "foreign_system")})
        .withColumn("violations", violations([
            ("window", F.col("window_end") >= F.col("window_start")),
            ("observation_account", F.col("foreign_account") == 0),
            ("observation_source", F.col("foreign_system") == 0),
        ]))
    )


def validate_runs(runs: DataFrame, errors: DataFrame) -> DataFrame:
    counted = errors.groupBy("run_id").agg(F.count("*").alias("errors"))
    return (
        runs.join(counted, "run_id", "left")
        .withColumn("errors", F.coalesce("errors", F.lit(0).cast("bigint")))
        .withColumn("violations", violations([
            ("status", F.col("status").isin(RUN_STATUSES)),
            ("completed_at", F.col("completed_at") >= F.col("started_at")),
            ("window", F.col("window_end") >= F.col("window_start")),
            ("succeeded_with_errors", (F.col("status") != "succeeded") | (F.col("errors") == 0)),
            ("failed_without_errors", (F.col("status") != "failed") | (F.col("errors") > 0)),
        ]))
    )
