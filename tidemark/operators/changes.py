"""Snapshot-to-snapshot changes: teams, projects, careers postings, new jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import observation_id, signal_id, snapshot_id, stable_id
from tidemark.functions.text import (
    as_col,
    clean,
    clip,
    computed,
    contains_any,
    fold_plain,
    instruction_like,
    iso_millis,
    let,
    matched_terms,
    non_empty,
    trim_all,
)
from tidemark.functions.vocabulary import JOB_RELEVANCE_MINIMUM, JOB_TAXONOMY, NON_IT_TERMS
from tidemark.operators.gates import job_url

JOB_FIELDS = ["title", "department", "location", "url", "posted_at"]


# --- teams and projects ---------------------------------------------------------


def account_team_resolve(accounts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per account: mapped and verified teams, and whether usage may be collected.

    ``bridge`` has account_id, team_id, verified. No verified team blocks the
    account, some leave it incomplete, all make it complete.
    """
    teams = bridge.groupBy("account_id", "team_id").agg(F.max("verified").alias("verified"))
    counts = teams.groupBy("account_id").agg(F.count("*").alias("teams"), F.count_if(F.col("verified")).alias("verified_teams"))
    zero = F.lit(0).cast("bigint")
    return (
        accounts.select("account_id")
        .join(counts, "account_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("teams", "verified_teams")})
        .withColumn(
            "mapping_status",
            F.when(F.col("verified_teams") == 0, "blocked").when(F.col("verified_teams") < F.col("teams"), "incomplete").otherwise("complete"),
        )
    )


def resolve_usage_teams(usage: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usage of verified teams with its account, per team count of the rows left out).

    A team verified for more than one account is left out as well: its usage would count twice.
    """
    verified = bridge.filter("verified").groupBy("team_id").agg(F.min("account_id").alias("account_id"), F.max("account_id").alias("other")).filter("account_id = other").drop("other")
    unmapped = usage.join(verified, "team_id", "left_anti").groupBy("team_id").agg(F.count("*").alias("unmapped_rows"))
    return usage.join(verified, "team_id"), unmapped


def _first(rows_order: str, *columns: str) -> Column:
    return F.min_by(F.struct(*columns), rows_order)


def project_rows(projects: DataFrame, teams: DataFrame) -> DataFrame:
    """Project rows (account_id, listed_team_id, team_id, project_id, ..., input_ord) with ``in_scope``.

    A row is in scope when it reports the team it was listed for and that team
    belongs to the account.
    """
    mapped = teams.select("account_id", F.col("team_id").alias("listed_team_id"), F.lit(True).alias("mapped")).distinct()
    return projects.join(mapped, ["account_id", "listed_team_id"], "left").withColumn(
        "in_scope", F.coalesce("mapped", F.lit(False)) & (F.col("team_id") == F.col("listed_team_id"))
    ).drop("mapped")


def project_inventory(projects: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects of each account, rejected rows with their reason).

    One map-side combined aggregate per (account, project) finds both the first
    sighting and team conflicts; every copy of a conflicting project is removed.
    """
    scoped = project_rows(projects, teams)
    details = ["name", "environment", "created_at", "updated_at", "url"]
    found = (
        scoped.filter("in_scope")
        .groupBy("account_id", "project_id")
        .agg(_first("input_ord", "team_id", *details).alias("p"), (F.min("team_id") != F.max("team_id")).alias("conflict"))
    )
    inventory = found.filter(~F.col("conflict")).select("account_id", "project_id", "p.*")
    foreign = scoped.filter(~F.col("in_scope")).select("account_id", "project_id", "team_id", F.lit("team_not_mapped").alias("reason"))
    clashing = found.filter("conflict").select("account_id", "project_id", F.col("p.team_id").alias("team_id"), F.lit("conflicting_project_team").alias("reason"))
    return inventory, foreign.unionByName(clashing)


def project_account_status(accounts: DataFrame, inventory: DataFrame, previous: DataFrame, failures: DataFrame) -> DataFrame:
    """Per account: projects, projects not in the previous snapshot, collection status."""
    fresh = inventory.join(previous.select("account_id", "project_id").distinct(), ["account_id", "project_id"], "left_anti")
    total = inventory.groupBy("account_id").agg(F.count("*").alias("project_count"))
    new = fresh.groupBy("account_id").agg(F.count("*").alias("new_project_count"))
    failed = failures.groupBy("account_id").agg(F.lit(True).alias("failed"))
    zero = F.lit(0).cast("bigint")
    return (
        accounts.select("account_id").join(total, "account_id", "left").join(new, "account_id", "left").join(failed, "account_id", "left")
        .select(
            "account_id",
            F.coalesce("project_count", zero).alias("project_count"),
            F.when(F.col("failed"), zero).otherwise(F.coalesce("new_project_count", zero)).alias("new_project_count"),
            F.when(F.col("failed"), "partial").otherwise("succeeded").alias("status"),
        )
    )


def project_violations(projects: DataFrame) -> DataFrame:
    """Empty and repeated project ids and empty names per account."""
    keyed = projects.select("account_id", trim_all("project_id").alias("project_id"), trim_all("name").alias("name"))
    repeated = keyed.groupBy("account_id", "project_id").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("name") == "", F.lit(True))).alias("unnamed"))
    codes = F.array_compact(F.array(
        F.when(F.coalesce(F.col("project_id") == "", F.lit(True)), "empty_id"),
        F.when(F.col("rows") > 1, "duplicate_id"),
        F.when(F.col("unnamed") > 0, "empty_name"),
    ))
    return repeated.select("account_id", "project_id", "rows", F.explode(codes).alias("violation"))


def _held_to(contract: str, rows: DataFrame, breaches: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows under a contract: ``ignore`` takes all, ``quarantine`` leaves out those that breach it, ``strict`` raises.

    ``keys`` names the columns of ``breaches`` that point to rows, and how rows spell them.
    """
    if contract not in ("ignore", "quarantine", "strict"):
        raise ValueError("contract must be ignore, quarantine or strict")
    if contract == "strict":
        found = breaches.limit(3).collect()
        if found:
            raise ValueError(f"contract breached: {[row.asDict() for row in found]}")
    if contract != "quarantine":
        return rows
    bad = breaches.select(*[F.col(name).alias(f"_bad_{name}") for name in keys]).distinct()
    same = None
    for name, spelt in keys.items():
        one = spelt.eqNullSafe(F.col(f"_bad_{name}"))
        same = one if same is None else same & one
    return rows.join(bad, same, "left_anti")


def new_projects(current: DataFrame, previous: DataFrame, known: DataFrame, headers: DataFrame, contract: str = "ignore") -> DataFrame:
    """Projects of ``current`` that are new to an account with a baseline.

    ``contract`` says what happens to projects of :func:`project_violations` (all rows of a repeated id among them).

    ``headers`` lists the accounts whose previous collection succeeded (also with
    zero projects); an account without header and without known ids only sets its
    baseline. ``known`` keeps older ids, so restored projects stay silent.
    """
    current = _held_to(contract, current, project_violations(current), {"account_id": F.col("account_id"), "project_id": trim_all("project_id")})
    keys = ["account_id", "project_id"]
    seen = previous.select(keys).unionByName(known.select(keys)).distinct()
    based = headers.select("account_id").unionByName(known.select("account_id")).distinct()
    return current.join(based, "account_id", "left_semi").join(seen, keys, "left_anti")


def new_project_signals(found: DataFrame, collected_at: Column, system: str = "project_inventory", normalize: bool = True) -> DataFrame:
    """Signals of new projects (account_id, account_name, project_id, name, created_at, url)."""
    name = trim_all("name")
    attributes = F.map_filter(
        F.create_map(
            F.lit("projectId"), F.col("project_id"), F.lit("projectName"), name,
            F.lit("creationTime"), iso_millis("created_at"), F.lit("url"), F.col("url"),
        ),
        lambda key, value: value.isNotNull(),
    )
    return found.select(
        signal_id("account_id", F.lit("new_project"), F.lit(system), "project_id", "created_at", ascii_only=not normalize).alias("signal_id"),
        "account_id", "account_name",
        F.lit("new_project").alias("category"),
        F.lit(system).alias("source_system"),
        F.col("project_id").alias("source_record_id"),
        F.col("url").alias("source_url"),
        F.col("created_at").alias("observed_at"),
        collected_at.alias("received_at"),
        F.lit("New project detected").alias("title"),
        F.concat(F.lit("A new project, "), name, F.lit(", was created for the account.")).alias("detail"),
        F.lit("expansion").alias("direction"),
        F.lit("warning").alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.lit("projects").alias("metric_name"),
        F.lit(1.0).alias("metric_value"),
        F.lit("project").alias("metric_unit"),
        F.lit(0.0).alias("metric_previous"),
        F.array(F.struct(
            F.lit("project_record").alias("kind"),
            F.concat(F.lit("Project "), name, F.lit(" was created")).alias("summary"),
            F.lit(None).cast("string").alias("excerpt"),
            F.lit(system).alias("source_system"),
            F.col("url").alias("source_url"),
            attributes.alias("attributes"),
        )).alias("evidence"),
        F.lit(0).cast("bigint").alias("input_ord"),
    )


# --- careers postings -------------------------------------------------------------


def last_per_job(jobs: DataFrame) -> DataFrame:
    """One row per (account_id, job_id): the last one in input order."""
    rest = [c for c in jobs.columns if c not in ("account_id", "job_id", "input_ord")]
    return (
        jobs.groupBy("account_id", "job_id")
        .agg(F.max_by(F.struct(*rest), "input_ord").alias("j"))
        .select("account_id", "job_id", "j.*")
    )


def careers_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """added / removed / changed / unchanged per (account_id, job_id).

    Both sides hold one row per key after :func:`last_per_job`, so the full outer
    join cannot multiply rows. If both have ``observed_at``, the result has that of
    the job it shows; it is no part of the comparison.
    """
    timed = "observed_at" in previous.columns and "observed_at" in current.columns
    seen = [F.col("observed_at")] if timed else []
    old = last_per_job(previous).select("account_id", "job_id", F.struct(*JOB_FIELDS).alias("before"), *[c.alias("_old_seen") for c in seen])
    new = last_per_job(current).select("account_id", "job_id", F.struct(*JOB_FIELDS).alias("after"), *[c.alias("_new_seen") for c in seen])
    joined = old.join(new, ["account_id", "job_id"], "full_outer")
    if timed:
        shown = F.when(F.col("after").isNull(), F.col("_old_seen")).otherwise(F.col("_new_seen"))
        joined = joined.withColumn("observed_at", shown).drop("_old_seen", "_new_seen")
    return joined.withColumn(
        "change",
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") == F.col("after"), "unchanged")
        .otherwise("changed"),
    )


def careers_carry_forward(fetches: DataFrame, fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Records after a collection: fresh where it succeeded, the previous ones otherwise.

    ``fetches`` has account_id, fetch_status (ok, not_modified, failed, unsupported). An account without a row was
    not collected: its records are kept, with a NULL status.
    """
    columns = ["account_id", "job_id", *JOB_FIELDS]
    status = fetches.select("account_id", "fetch_status")
    kept = last_per_job(previous).select(columns).join(status, "account_id", "left").filter("fetch_status IS NULL OR fetch_status <> 'ok'")
    taken = last_per_job(fresh).select(columns).join(status.filter("fetch_status = 'ok'"), "account_id")
    return taken.withColumn("carried", F.lit(False)).unionByName(kept.withColumn("carried", F.lit(True)))


def careers_changes(fetches: DataFrame, fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Changes of a collection: a failure changes nothing, "not modified" reports its records as unchanged."""
    status = fetches.select("account_id", "fetch_status")
    ok = status.filter("fetch_status = 'ok'")
    changed = careers_diff(previous.join(ok, "account_id", "left_semi"), fresh.join(ok, "account_id", "left_semi"))
    same = last_per_job(previous).join(status.filter("fetch_status = 'not_modified'"), "account_id", "left_semi")
    seen = [c for c in changed.columns if c == "observed_at"]
    return changed.unionByName(
        same.select("account_id", "job_id", F.struct(*JOB_FIELDS).alias("before"), F.struct(*JOB_FIELDS).alias("after"), *seen, F.lit("unchanged").alias("change"))
    )


# --- job identity, novelty, relevance ----------------------------------------------


def with_job_identity(jobs: DataFrame, normalize: bool = True) -> DataFrame:
    """Adds ``job_identity`` and ``job_aliases`` (at most three) to postings.

    Columns: account_id, account_name, provider_id, job_id, title, company, url, ...
    """
    def some(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    def aliases(k: Column) -> Column:
        provider = F.coalesce(some(k["provider"]), some(k["job"]))
        by_title = F.concat(F.lit("title-company:"), some(k["title"]), F.lit(":"), F.coalesce(some(k["company"]), some(k["account"])))
        by_url = F.concat(F.lit("url:"), k["url"])
        by_provider = F.concat(F.lit("provider:"), fold_plain(provider, False))
        return let(
            F.struct(provider.alias("provider"), F.when(provider.isNotNull(), by_provider).alias("own"), by_title.alias("by_title"), by_url.alias("by_url"),
                     (k["title"] != "").alias("titled")),
            identify,
        )

    def identify(m: Column) -> Column:
        identity = F.coalesce(m["own"], F.when(m["titled"], F.coalesce(m["by_title"], m["by_url"])))
        return let(identity, lambda own: F.struct(
            m["provider"].alias("provider_key"), own.alias("job_identity"),
            F.array_distinct(F.array_compact(F.array(own, m["by_url"], m["by_title"]))).alias("job_aliases"),
        ))

    parts = F.struct(
        clean("provider_id", normalize).alias("provider"), clean("job_id", normalize).alias("job"), fold_plain("title", normalize).alias("title"),
        fold_plain("company", normalize).alias("company"), fold_plain("account_name", normalize).alias("account"), job_url("url").alias("url"),
    )
    return computed(jobs, let(parts, aliases))


def duplicate_job_identities(identified: DataFrame) -> DataFrame:
    """Identities that occur more than once in one snapshot of an account (a contract error)."""
    return identified.groupBy("account_id", "job_identity").agg(F.count("*").alias("rows")).filter("rows > 1")


def new_jobs(current: DataFrame, previous: DataFrame, headers: DataFrame, contract: str = "ignore") -> DataFrame:
    """Identified postings none of whose aliases occurs in the previous snapshot of the account.

    ``contract`` says what happens to postings of :func:`duplicate_job_identities`.

    Postings, the aliases known before and the headers meet by account, once; what is known follows from windows over
    (account, alias) and (account, identity) there, without another exchange, and postings are never compared pairwise.
    A posting's columns travel with its first alias only. An alias is told by 128 bits.
    Accounts without a previous snapshot (``headers``) only set their baseline.
    """
    current = _held_to(contract, current, duplicate_job_identities(current), {name: F.col(name) for name in ("account_id", "job_identity")})
    rest = [c for c in current.columns if c not in ("account_id", "job_identity")]
    met = (
        current.withColumn("_kind", F.lit("current"))
        .unionByName(previous.select("account_id", "job_aliases", F.lit("previous").alias("_kind")), allowMissingColumns=True)
        .unionByName(headers.select("account_id").distinct().withColumn("_kind", F.lit("header")), allowMissingColumns=True)
        .filter(F.col("account_id").isNotNull())
        .repartition("account_id")
        .select("*", F.posexplode_outer("job_aliases").alias("_at", "_alias"))
        .withColumn("_first", F.coalesce("_at", F.lit(0)) == 0)
    )
    named = F.col("_alias").isNotNull()
    each = met.select(
        "account_id", "job_identity", "_kind", "_first", F.when(named, F.xxhash64("_alias")).alias("_a1"), F.when(named, F.xxhash64(F.lit(1), "_alias")).alias("_a2"),
        *[F.when(F.col("_first"), F.col(c)).alias(c) for c in rest],
    )
    known = F.col("_a1").isNotNull() & F.max(F.col("_kind") == "previous").over(Window.partitionBy("account_id", "_a1", "_a2"))
    based = F.max(F.col("_kind") == "header").over(Window.partitionBy("account_id"))
    each = each.withColumns({"_known": known, "_based": based}).filter((F.col("_kind") == "current") & F.col("_based") & (F.col("_first") | F.col("_known")))
    old = F.col("job_identity").isNotNull() & F.max("_known").over(Window.partitionBy("account_id", "job_identity"))
    return each.withColumn("_old", old).filter(F.col("_first") & ~F.col("_old")).select("account_id", "job_identity", *rest)


def job_classify(jobs: DataFrame, taxonomy=None, non_it=None, normalize: bool = True) -> DataFrame:
    """Adds relevant, score, matched_terms and rationale; terms match as substrings."""
    rules = JOB_TAXONOMY if taxonomy is None else taxonomy
    rejected = NON_IT_TERMS if non_it is None else non_it

    def judge(text: Column) -> Column:
        points = F.lit(0)
        for _, words, weight in rules:
            points = points + F.when(contains_any(text, words), weight).otherwise(0)
        terms = F.concat(*[matched_terms(text, words) for _, words, _ in rules])
        return let(
            F.struct(
                instruction_like(text).alias("suspicious"), contains_any(text, rejected).alias("non_it"),
                F.least(F.lit(100), points).alias("points"), F.sort_array(F.array_distinct(terms)).alias("terms"),
            ),
            conclude,
        )

    def conclude(c: Column) -> Column:
        relevant = ~c["suspicious"] & ~c["non_it"] & (c["points"] >= JOB_RELEVANCE_MINIMUM)
        out_of = F.concat(c["points"].cast("string"), F.lit("/100"))
        rationale = (
            F.when(c["suspicious"], F.lit("Rejected as untrusted instruction-like job content."))
            .when(relevant, F.concat(F.lit("IT relevance score "), out_of, F.lit(" from "), F.array_join(c["terms"], ", "), F.lit(".")))
            .when(c["non_it"], F.lit("Rejected as non-IT: matched a non-technical role term."))
            .otherwise(F.concat(F.lit("Rejected as non-IT: no IT taxonomy terms matched (score "), out_of, F.lit(").")))
        )
        return F.struct(
            relevant.alias("relevant"), F.when(c["suspicious"], F.lit(0)).otherwise(c["points"]).alias("score"),
            F.when(c["suspicious"], F.array().cast("array<string>")).otherwise(c["terms"]).alias("matched_terms"), rationale.alias("rationale"),
        )

    parts = [clean(c, normalize) for c in ("title", "department", "description")]
    text = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", *parts)), F.lit(" "))
    return computed(jobs, let(text, judge))


def hiring_signals(classified: DataFrame, collected_at: Column, system: str = "careers_page", normalize: bool = True) -> DataFrame:
    """Signals of relevant new postings; the id rests on the identity, not on the time."""
    def some(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    title = F.col("c_title")
    observed = F.coalesce("posted_at", collected_at)
    attributes = F.map_filter(
        F.create_map(
            F.lit("jobIdentity"), F.col("job_identity"), F.lit("title"), title,
            F.lit("company"), F.coalesce(some("c_company"), F.col("account_name")),
            F.lit("relevanceScore"), F.col("score").cast("string"), F.lit("rationale"), F.col("rationale"),
            F.lit("department"), some("c_department"), F.lit("location"), some("c_location"),
        ),
        lambda key, value: value.isNotNull(),
    )
    texts = ("title", "company", "department", "location", "description")
    cleaned = classified.filter("relevant").withColumns({f"c_{name}": clean(name, normalize) for name in texts})
    url = non_empty("url")
    return cleaned.select(
        stable_id("signal", "account_id", F.lit("it_hiring"), F.lit(system), "job_identity", ascii_only=not normalize).alias("signal_id"),
        "account_id", "account_name",
        F.lit("it_hiring").alias("category"),
        F.lit(system).alias("source_system"),
        F.coalesce("provider_key", "job_identity").alias("source_record_id"),
        url.alias("source_url"),
        observed.alias("observed_at"),
        collected_at.alias("received_at"),
        F.concat(F.lit("IT hiring: "), title).alias("title"),
        F.col("rationale").alias("detail"),
        F.lit("expansion").alias("direction"),
        F.when(F.col("score") >= 50, "warning").otherwise("info").alias("severity"),
        (F.col("score") / 100).alias("confidence"),
        F.lit("it_job_postings").alias("metric_name"),
        F.lit(1.0).alias("metric_value"),
        F.lit("job").alias("metric_unit"),
        F.lit(0.0).alias("metric_previous"),
        F.array(F.struct(
            F.lit("job_posting").alias("kind"),
            F.concat(F.lit("IT job posting: "), title).alias("summary"),
            F.nullif(clip(F.col("c_description"), 500), F.lit("")).alias("excerpt"),
            F.lit(system).alias("source_system"),
            url.alias("source_url"),
            attributes.alias("attributes"),
        )).alias("evidence"),
        F.lit(0).cast("bigint").alias("input_ord"),
    )


# --- snapshots ------------------------------------------------------------------


def snapshot_build(headers: DataFrame, observations: DataFrame, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(snapshot headers, observation rows with ids and their snapshot).

    ``headers``: account_id, source_system, window_start, window_end, captured_at -
    also for collections without observations. ``observations``: account_id,
    source_system, record_id, observed_at, category, ... Children stay rows, an
    account's snapshot has no size bound.
    """
    plain = not normalize
    head = headers.withColumn("snapshot_id", snapshot_id("account_id", "source_system", "window_start", "window_end", ascii_only=plain))
    rows = (
        observations.withColumn("observation_id", observation_id("account_id", "source_system", "record_id", "observed_at", ascii_only=plain))
        .join(head.select("account_id", "source_system", "snapshot_id"), ["account_id", "source_system"])
    )
    counts = rows.groupBy("snapshot_id").agg(
        F.count("*").alias("observations"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at")
    )
    built = head.join(counts, "snapshot_id", "left").withColumn("observations", F.coalesce("observations", F.lit(0).cast("bigint")))
    return built, rows


def removed_jobs(diff: DataFrame) -> DataFrame:
    return diff.filter(as_col("change") == "removed")
