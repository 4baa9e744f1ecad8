"""Teams, projects, careers postings, new jobs, hiring signals, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vocabulary import JOB_TAXONOMY, NON_IT_TERMS
from tidemark.operators import changes
from tidemark.session import stored
from tidemark.sources.tables import read_table
from workload.registry import query
from workload.views import QUARANTINE, phrase, sql_iso, sql_phrase, sql_stable_id


def acct(column: str):
    return F.concat(F.lit("acct-"), F.col(column))


# --- teams ------------------------------------------------------------------------


def team():
    return F.concat_ws("-", F.lit("team"), "o_custkey", F.substring("o_orderpriority", 1, 1))


def bridge(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.groupBy(acct("o_custkey").alias("account_id"), team().alias("team_id")).agg(
        (F.max("o_totalprice") > 250_000).alias("verified")
    )


BRIDGE_SQL = """
bridge AS (SELECT 'acct-' || o_custkey AS account_id, 'team-' || o_custkey || '-' || left(o_orderpriority, 1) AS team_id,
  max(o_totalprice) > 250000 AS verified FROM orders GROUP BY ALL)"""


@query(
    "account_team_resolve",
    f"""WITH {BRIDGE_SQL}, counted AS (SELECT account_id, count(*) AS teams, count(*) FILTER (verified) AS verified_teams FROM bridge GROUP BY ALL)
    SELECT 'acct-' || c_custkey AS account_id, coalesce(teams, 0) AS teams, coalesce(verified_teams, 0) AS verified_teams,
      CASE WHEN coalesce(verified_teams, 0) = 0 THEN 'blocked' WHEN verified_teams < teams THEN 'incomplete' ELSE 'complete' END AS mapping_status
    FROM customer LEFT JOIN counted ON account_id = 'acct-' || c_custkey""",
)
def _teams(spark, folder):
    accounts = read_table(spark, folder, "customer").select(acct("c_custkey").alias("account_id"))
    return changes.account_team_resolve(accounts, bridge(spark, folder))


def team_usage(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", team().alias("team_id"))
    items = read_table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("team_id", "quantity")


TEAM_USAGE_SQL = f"""{BRIDGE_SQL},
usage AS (SELECT 'team-' || o_custkey || '-' || left(o_orderpriority, 1) AS team_id, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "usage_team_scope",
    f"""WITH {TEAM_USAGE_SQL}
    SELECT account_id, team_id, count(*) AS rows, sum(quantity) AS quantity FROM usage JOIN bridge USING (team_id) WHERE verified GROUP BY ALL""",
)
def _team_scope(spark, folder):
    mapped, _ = changes.resolve_usage_teams(team_usage(spark, folder), bridge(spark, folder))
    return mapped.groupBy("account_id", "team_id").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"))


@query(
    "usage_unmapped_teams",
    f"""WITH {TEAM_USAGE_SQL}
    SELECT team_id, count(*) AS unmapped_rows FROM usage ANTI JOIN (SELECT * FROM bridge WHERE verified) USING (team_id) GROUP BY ALL""",
)
def _unmapped(spark, folder):
    return changes.resolve_usage_teams(team_usage(spark, folder), bridge(spark, folder))[1]


# --- projects ---------------------------------------------------------------------


def listed_projects(spark, folder):
    orders = read_table(spark, folder, "orders")
    project = F.concat(F.lit("prj-"), F.year("o_orderdate"), F.lit("q"), F.quarter("o_orderdate"))
    return orders.select(
        acct("o_custkey").alias("account_id"),
        team().alias("listed_team_id"),
        F.when(F.col("o_totalprice") > 450_000, "team-foreign").otherwise(team()).alias("team_id"),
        project.alias("project_id"),
        F.concat(F.lit("Project "), project).alias("name"),
        F.lit(None).cast("string").alias("environment"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(None).cast("string").alias("url"),
        F.col("o_orderkey").alias("input_ord"),
    )


LISTED_SQL = f"""{BRIDGE_SQL},
listed AS (SELECT *, EXISTS (SELECT 1 FROM bridge b WHERE b.verified AND b.account_id = p.account_id AND b.team_id = p.listed_team_id)
    AND team_id = listed_team_id AS in_scope
  FROM (SELECT 'acct-' || o_custkey AS account_id, 'team-' || o_custkey || '-' || left(o_orderpriority, 1) AS listed_team_id,
    CASE WHEN o_totalprice > 450000 THEN 'team-foreign' ELSE 'team-' || o_custkey || '-' || left(o_orderpriority, 1) END AS team_id,
    'prj-' || year(o_orderdate) || 'q' || quarter(o_orderdate) AS project_id, o_orderdate AS created_at, o_orderkey AS input_ord FROM orders) p),
grouped AS (SELECT account_id, project_id, arg_min(team_id, input_ord) AS team_id, arg_min(created_at, input_ord) AS created_at,
    count(DISTINCT team_id) > 1 AS conflict FROM listed WHERE in_scope GROUP BY ALL)"""


def _verified(spark, folder):
    return bridge(spark, folder).filter("verified")


@query(
    "project_inventory",
    f"WITH {LISTED_SQL} SELECT account_id, project_id, team_id, 'Project ' || project_id AS name, created_at FROM grouped WHERE NOT conflict",
)
def _inventory(spark, folder):
    found, _ = changes.project_inventory(listed_projects(spark, folder), _verified(spark, folder))
    return found.select("account_id", "project_id", "team_id", "name", "created_at")


@query(
    "project_rejections",
    f"""WITH {LISTED_SQL}
    SELECT account_id, project_id, team_id, 'team_not_mapped' AS reason FROM listed WHERE NOT in_scope
    UNION ALL SELECT account_id, project_id, team_id, 'conflicting_project_team' AS reason FROM grouped WHERE conflict""",
)
def _rejections(spark, folder):
    return changes.project_inventory(listed_projects(spark, folder), _verified(spark, folder))[1]


@query(
    "project_account_status",
    f"""WITH {LISTED_SQL}, kept AS (SELECT * FROM grouped WHERE NOT conflict),
    counted AS (SELECT account_id, count(*) AS project_count, count(*) FILTER (created_at >= TIMESTAMP '1999-01-01') AS new_project_count FROM kept GROUP BY ALL)
    SELECT 'acct-' || c_custkey AS account_id, coalesce(project_count, 0) AS project_count,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE coalesce(new_project_count, 0) END AS new_project_count,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'partial' ELSE 'succeeded' END AS status
    FROM customer LEFT JOIN counted ON account_id = 'acct-' || c_custkey""",
)
def _project_status(spark, folder):
    customers = read_table(spark, folder, "customer")
    accounts = customers.select(acct("c_custkey").alias("account_id"))
    failures = customers.filter("c_mktsegment = 'MACHINERY'").select(acct("c_custkey").alias("account_id"))
    found, _ = changes.project_inventory(listed_projects(spark, folder), _verified(spark, folder))
    previous = found.filter(F.col("created_at") < F.lit("1999-01-01").cast("timestamp"))
    return changes.project_account_status(accounts, found, previous, failures)


def _projects(spark, folder):
    return read_table(spark, folder, "orders").select(
        acct("o_custkey").alias("account_id"), F.concat(F.lit("Account "), F.col("o_custkey")).alias("account_name"),
        F.concat(F.lit("prj-"), F.col("o_orderkey")).alias("project_id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("name"),
        F.col("o_orderdate").alias("created_at"), "o_orderstatus",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("https://projects.example.com/"), F.col("o_orderkey"))).alias("url"),
    )


def _new_projects(spark, folder):
    rows = _projects(spark, folder)
    previous = rows.filter("o_orderstatus <> 'P' AND created_at < TIMESTAMP '1999-01-01'")
    known = rows.filter("o_orderstatus = 'F' AND created_at < TIMESTAMP '2000-01-01'")
    current = rows.filter("o_orderstatus <> 'F' OR created_at >= TIMESTAMP '1999-01-01'")
    headers = previous.select("account_id").distinct()
    return changes.new_projects(current, previous, known.filter("created_at >= TIMESTAMP '1997-01-01'"), headers)


NEW_PROJECTS_SQL = """
p AS (SELECT 'acct-' || o_custkey AS account_id, 'prj-' || o_orderkey AS project_id, o_orderkey, o_orderdate AS created_at, o_orderstatus, o_orderpriority FROM orders),
prev AS (SELECT * FROM p WHERE o_orderstatus <> 'P' AND created_at < TIMESTAMP '1999-01-01'),
known AS (SELECT * FROM p WHERE o_orderstatus = 'F' AND created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '2000-01-01'),
fresh AS (SELECT * FROM p WHERE (o_orderstatus <> 'F' OR created_at >= TIMESTAMP '1999-01-01')
  AND account_id IN (SELECT account_id FROM prev UNION SELECT account_id FROM known)
  AND project_id NOT IN (SELECT project_id FROM prev UNION SELECT project_id FROM known))"""


@query("new_projects", f"WITH {NEW_PROJECTS_SQL} SELECT account_id, project_id, created_at FROM fresh")
def _new(spark, folder):
    return _new_projects(spark, folder).select("account_id", "project_id", "created_at")


@query(
    "new_project_signals",
    f"""WITH {NEW_PROJECTS_SQL}
    SELECT {sql_stable_id('signal', 'account_id', "'new_project'", "'project_inventory'", 'project_id', sql_iso('created_at'))} AS signal_id,
      account_id, project_id AS source_record_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'https://projects.example.com/' || o_orderkey END AS source_url,
      created_at AS observed_at, TIMESTAMP '2001-09-01' AS received_at, 'A new project, Order ' || o_orderkey || ', was created for the account.' AS detail,
      'warning' AS severity, 1.0::DOUBLE AS confidence FROM fresh""",
)
def _new_signals(spark, folder):
    at = F.lit("2001-09-01").cast("timestamp")
    found = changes.new_project_signals(_new_projects(spark, folder), at, normalize=False)
    return found.select("signal_id", "account_id", "source_record_id", "source_url", "observed_at", "received_at", "detail", "severity", "confidence")


# --- postings ---------------------------------------------------------------------


def postings(spark, folder):
    items = read_table(spark, folder, "lineitem", spread=True)
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        acct("o_custkey").alias("account_id"),
        F.concat(F.lit("Account "), F.col("o_custkey")).alias("account_name"),
        F.concat(F.lit("job-"), F.col("l_orderkey")).alias("job_id"),
        F.when(F.col("l_linestatus") == "O", F.concat_ws("-", F.lit("REQ"), "l_orderkey", "l_linenumber", "l_suppkey")).alias("provider_id"),
        F.concat(phrase(F.col("l_partkey")), F.lit(" "), F.col("l_suppkey")).alias("title"),
        F.when(F.col("l_discount") > 0.05, "Acme  Ltd.").alias("company"),
        F.when(F.col("l_linestatus") == "O", "Engineering").otherwise("Marketing and sales").alias("department"),
        F.lit(None).cast("string").alias("location"),
        F.concat(F.lit("https://Jobs.Example.com/jobs//"), F.col("l_partkey"), F.lit("/?utm_source=x&ref=y&lang=en#top")).alias("url"),
        phrase(F.col("l_orderkey")).alias("description"),
        F.when(F.col("l_tax") > 0.01, F.col("l_shipdate")).alias("posted_at"),
        (F.col("l_linenumber") * F.lit(10_000_000_000_000) + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("input_ord"),
        "l_returnflag",
    )


POSTINGS_SQL = f"""
postings AS (SELECT 'acct-' || o_custkey AS account_id, 'Account ' || o_custkey AS account_name, 'job-' || l_orderkey AS job_id,
  CASE WHEN l_linestatus = 'O' THEN 'REQ-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey END AS provider_id,
  {sql_phrase('l_partkey')} || ' ' || l_suppkey AS title, CASE WHEN l_discount > 0.05 THEN 'Acme  Ltd.' END AS company,
  CASE WHEN l_linestatus = 'O' THEN 'Engineering' ELSE 'Marketing and sales' END AS department, NULL::VARCHAR AS location,
  'https://Jobs.Example.com/jobs//' || l_partkey || '/?utm_source=x&ref=y&lang=en#top' AS url, {sql_phrase('l_orderkey')} AS description,
  CASE WHEN l_tax > 0.01 THEN l_shipdate END AS posted_at,
  l_linenumber * 10000000000000 + l_partkey * 1000000 + l_suppkey AS input_ord, l_returnflag, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
prev AS (SELECT * FROM postings WHERE l_returnflag IN ('A', 'R')),
curr AS (SELECT * FROM postings WHERE l_returnflag IN ('R', 'N')),
prev_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, job_id ORDER BY input_ord DESC) AS rn FROM prev) WHERE rn = 1),
curr_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, job_id ORDER BY input_ord DESC) AS rn FROM curr) WHERE rn = 1)"""


def previous_postings(rows):
    return rows.filter("l_returnflag IN ('A', 'R')")


def current_postings(rows):
    return rows.filter("l_returnflag IN ('R', 'N')")


@query(
    "careers_diff",
    f"""WITH {POSTINGS_SQL}
    SELECT coalesce(c.account_id, p.account_id) AS account_id, coalesce(c.job_id, p.job_id) AS job_id, p.title AS old_title, c.title AS new_title,
      CASE WHEN p.job_id IS NULL THEN 'added' WHEN c.job_id IS NULL THEN 'removed'
        WHEN p.title = c.title AND p.department = c.department AND p.url = c.url AND p.posted_at IS NOT DISTINCT FROM c.posted_at THEN 'unchanged'
        ELSE 'changed' END AS change
    FROM prev_last p FULL JOIN curr_last c ON p.account_id = c.account_id AND p.job_id = c.job_id""",
)
def _careers_diff(spark, folder):
    rows = postings(spark, folder)
    diff = changes.careers_diff(previous_postings(rows), current_postings(rows))
    return diff.select("account_id", "job_id", F.col("before.title").alias("old_title"), F.col("after.title").alias("new_title"), "change")


def fetches(spark, folder):
    segment = F.col("c_mktsegment")
    return read_table(spark, folder, "customer").select(
        acct("c_custkey").alias("account_id"),
        F.when(segment == "MACHINERY", "failed").when(segment == "BUILDING", "not_modified").otherwise("ok").alias("fetch_status"),
    )


FETCHES_SQL = """
fetches AS (SELECT 'acct-' || c_custkey AS account_id,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'failed' WHEN 'BUILDING' THEN 'not_modified' ELSE 'ok' END AS fetch_status FROM customer)"""


@query(
    "careers_carry_forward",
    f"""WITH {POSTINGS_SQL}, {FETCHES_SQL}
    SELECT account_id, job_id, title, posted_at, fetch_status, false AS carried FROM curr_last JOIN fetches USING (account_id) WHERE fetch_status = 'ok'
    UNION ALL SELECT account_id, job_id, title, posted_at, fetch_status, true AS carried FROM prev_last JOIN fetches USING (account_id) WHERE fetch_status <> 'ok'""",
)
def _carry(spark, folder):
    rows = postings(spark, folder)
    kept = changes.careers_carry_forward(fetches(spark, folder), current_postings(rows), previous_postings(rows))
    return kept.select("account_id", "job_id", "title", "posted_at", "fetch_status", "carried")


# --- job identity, novelty, classification ------------------------------------------


def _fold(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'))"


ALIASES_SQL = f"""{POSTINGS_SQL},
keyed AS (SELECT *, 'title-company:' || {_fold('title')} || ':' || {_fold("coalesce(company, account_name)")} AS by_title,
    'url:https://jobs.example.com/jobs/' || l_partkey || '?lang=en' AS by_url,
    'provider:' || {_fold('coalesce(provider_id, job_id)')} AS identity FROM postings),
known AS (SELECT account_id, unnest([identity, by_title, by_url]) AS alias FROM keyed WHERE l_returnflag IN ('A', 'R')),
seen AS (SELECT DISTINCT account_id, alias FROM known),
fresh AS (SELECT * FROM keyed k WHERE l_returnflag IN ('R', 'N') AND account_id IN (SELECT account_id FROM seen)
  AND (account_id, identity) NOT IN (SELECT (k2.account_id, k2.identity) FROM keyed k2 JOIN seen s ON s.account_id = k2.account_id
    AND s.alias IN (k2.identity, k2.by_title, k2.by_url) WHERE k2.l_returnflag IN ('R', 'N')))"""


def _fresh_jobs(spark, folder):
    # identified once and written; both snapshots are read from there
    rows = stored(changes.with_job_identity(postings(spark, folder), normalize=False), "postings", compression="zstd")
    previous = previous_postings(rows)
    return changes.new_jobs(current_postings(rows), previous, previous.select("account_id"))


@query("new_jobs", f"WITH {ALIASES_SQL} SELECT account_id, identity AS job_identity, count(*) AS rows, min(title) AS title FROM fresh GROUP BY ALL")
def _new_jobs(spark, folder):
    return _fresh_jobs(spark, folder).groupBy("account_id", "job_identity").agg(F.count("*").alias("rows"), F.min("title").alias("title"))


def _sql_has(column, terms):
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _classified_sql(source: str) -> str:
    terms = sorted({t for _, words, _ in JOB_TAXONOMY for t in words})
    matched = "list_filter([" + ", ".join(f"CASE WHEN contains(txt, '{t}') THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"
    score = " + ".join(f"CASE WHEN {_sql_has('txt', words)} THEN {weight} ELSE 0 END" for _, words, weight in JOB_TAXONOMY)
    return f"""
    texted AS (SELECT *, ' ' || lower(title || ' ' || department || ' ' || description) || ' ' AS txt FROM {source}),
    tested AS (SELECT *, regexp_matches(txt, '{QUARANTINE}') AS suspicious,
      least(100, {score}) AS raw_score, {_sql_has('txt', NON_IT_TERMS)} AS non_it, {matched} AS found FROM texted),
    classified AS (SELECT *, CASE WHEN suspicious THEN 0 ELSE raw_score END AS score, NOT suspicious AND NOT non_it AND raw_score >= 20 AS relevant,
      CASE WHEN suspicious THEN '' ELSE array_to_string(found, ', ') END AS terms FROM tested),
    reasoned AS (SELECT *, CASE WHEN suspicious THEN 'Rejected as untrusted instruction-like job content.'
      WHEN relevant THEN 'IT relevance score ' || score || '/100 from ' || terms || '.'
      WHEN non_it THEN 'Rejected as non-IT: matched a non-technical role term.'
      ELSE 'Rejected as non-IT: no IT taxonomy terms matched (score ' || score || '/100).' END AS rationale FROM classified)"""


@query(
    "job_classify",
    f"""WITH {POSTINGS_SQL}, {_classified_sql('postings')}
    SELECT account_id, job_id, input_ord, title, relevant, score, terms, rationale FROM reasoned""",
)
def _classify(spark, folder):
    found = changes.job_classify(postings(spark, folder), normalize=False)
    return found.select("account_id", "job_id", "input_ord", "title", "relevant", "score", F.array_join("matched_terms", ", ").alias("terms"), "rationale")


@query(
    "hiring_signals",
    f"""WITH {ALIASES_SQL}, {_classified_sql('fresh')}
    SELECT {sql_stable_id('signal', 'account_id', "'it_hiring'", "'careers_page'", 'identity')} AS signal_id, account_id,
      coalesce(provider_id, job_id) AS source_record_id, coalesce(posted_at, TIMESTAMP '2001-12-01') AS observed_at, 'IT hiring: ' || title AS title,
      rationale AS detail, CASE WHEN score >= 50 THEN 'warning' ELSE 'info' END AS severity, score / 100.0::DOUBLE AS confidence FROM reasoned WHERE relevant""",
)
def _hiring(spark, folder):
    at = F.lit("2001-12-01").cast("timestamp")
    found = changes.hiring_signals(changes.job_classify(_fresh_jobs(spark, folder), normalize=False), at, normalize=False)
    return found.select("signal_id", "account_id", "source_record_id", "observed_at", "title", "detail", "severity", "confidence")


# --- snapshots --------------------------------------------------------------------


@query(
    "snapshot_build",
    f"""WITH head AS (SELECT 'acct-' || c_custkey AS account_id, s AS source_system, TIMESTAMP '1998-01-01' AS window_start, TIMESTAMP '1999-01-01' AS window_end,
        {sql_stable_id('snapshot', "'acct-' || c_custkey", 's', "'1998-01-01T00:00:00.000Z'", "'1999-01-01T00:00:00.000Z'")} AS snapshot_id
      FROM customer, (SELECT unnest(['ats_feed', 'careers_page']) AS s)),
    obs AS (SELECT 'acct-' || o_custkey AS account_id, CASE l_returnflag WHEN 'A' THEN 'ats_feed' ELSE 'careers_page' END AS source_system, l_shipdate AS observed_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01')
    SELECT h.account_id, h.source_system, snapshot_id, count(observed_at) AS observations, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at
    FROM head h LEFT JOIN obs o ON h.account_id = o.account_id AND h.source_system = o.source_system GROUP BY ALL""",
)
def _snapshots(spark, folder):
    start, end = F.lit("1998-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")
    headers = read_table(spark, folder, "customer").select(
        acct("c_custkey").alias("account_id"), F.explode(F.array(F.lit("ats_feed"), F.lit("careers_page"))).alias("source_system"),
        start.alias("window_start"), end.alias("window_end"), end.alias("captured_at"),
    )
    items = read_table(spark, folder, "lineitem").filter((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end))
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    observations = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        acct("o_custkey").alias("account_id"),
        F.when(F.col("l_returnflag") == "A", "ats_feed").otherwise("careers_page").alias("source_system"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        F.col("l_shipdate").alias("observed_at"),
    )
    built, _ = changes.snapshot_build(headers, observations, normalize=False)
    return built.select("account_id", "source_system", "snapshot_id", "observations", "first_observed_at", "last_observed_at")
