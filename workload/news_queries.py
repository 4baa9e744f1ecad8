"""News gates, classification, story matching and the account news monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vocabulary import NEWS_TAXONOMY, TECHNOLOGY_TERMS
from tidemark.operators import gates, news, stories
from tidemark.plans.news_scan import news_scan
from tidemark.sources.tables import read_table
from workload.registry import query
from workload.views import QUARANTINE, phrase, sql_iso, sql_phrase, sql_stable_id


def ts(text: str):
    return F.lit(text).cast("timestamp")


# --- first-party news items -----------------------------------------------------------


def located_documents(spark, folder):
    pages = read_table(spark, folder, "pages").select("page_id", F.col("url").alias("page_url"))
    docs = read_table(spark, folder, "documents", spread=True)
    own = F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.org/"), F.col("doc_id"))
    return docs.join(pages, F.col("page_id") == F.col("doc_id"), "left").select(
        F.col("doc_id").alias("page_id"), F.coalesce("page_url", own).alias("url"), "lang", "source", "text", "n_chars"
    )


def news_items(spark, folder):
    """documents as excerpts, at the page of the same id or one of their source; the account is the site without its usual prefix.
    Times are spread by the length of the text, so that the same share of all documents lies in the window at any size."""
    site = F.regexp_replace(F.regexp_extract("url", "^https?://([^/?#]*)", 1), r"^(www|blog|m)\.", "")
    return located_documents(spark, folder).select(
        F.col("page_id").alias("item_id"), F.col("page_id").alias("input_ord"),
        F.when(F.col("source") == "src3", "elsewhere.example").otherwise(site).alias("account_id"),
        F.col("url").alias("source_url"), F.lit(None).cast("string").alias("canonical_url"),
        F.concat(phrase(F.col("page_id")), F.lit(" "), F.col("source")).alias("title"), F.col("text").alias("excerpt"),
        F.when(F.col("lang") != "es", ts("2024-01-01") + F.make_dt_interval(hours=(F.col("n_chars") % 600).cast("int"))).alias("published_at"),
        F.when(F.col("lang") == "fr", "  ").otherwise(F.concat(F.lit("Author "), F.col("source"))).alias("author"),
        F.when(F.col("source") == "src5", "video").when(F.col("source") == "src6", "post").otherwise("article").alias("kind"),
    )


def news_accounts(spark, folder):
    site = F.regexp_replace(F.regexp_extract("url", "^https?://([^/?#]*)", 1), r"^(www|blog|m)\.", "")
    return located_documents(spark, folder).select(site.alias("account_id")).distinct().select(
        "account_id", F.col("account_id").alias("account_name"), F.array(F.concat(F.lit("www."), F.upper("account_id"))).alias("domains")
    )


def _contains(column, terms):
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


NEWS_ITEMS_SQL = f"""
item AS (SELECT page_id AS item_id, url, lang, source, text,
    regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^(www|blog|m)\\.', '') AS site, {sql_phrase('page_id')} || ' ' || source AS title,
    TIMESTAMP '2024-01-01' + to_hours(CAST(n_chars % 600 AS INT)) AS published_at
  FROM (SELECT doc_id AS page_id, coalesce(url, 'https://www.' || source || '.example.org/' || doc_id) AS url, lang, source, text, n_chars FROM documents LEFT JOIN pages ON page_id = doc_id)),
gated AS (SELECT *, CASE WHEN NOT starts_with(url, 'https:') OR lang = 'es' OR source = 'src5' THEN 'malformed' WHEN lang = 'fr' THEN 'unattributed'
    WHEN source = 'src3' THEN 'not_first_party' WHEN published_at < TIMESTAMP '2024-01-02' OR published_at > TIMESTAMP '2024-01-20' THEN 'outside_window'
    WHEN NOT {_contains("lower(title || ' ' || text)", TECHNOLOGY_TERMS)} THEN 'irrelevant' ELSE 'accepted' END AS reason FROM item)"""


@query(
    "news_item_gate",
    f"WITH {NEWS_ITEMS_SQL} SELECT item_id, CASE WHEN source = 'src3' THEN 'elsewhere.example' ELSE site END AS account_id, title, reason FROM gated",
)
def _gate(spark, folder):
    gated = gates.news_item_gate(news_items(spark, folder), news_accounts(spark, folder), ts("2024-01-02"), ts("2024-01-20"))
    return gated.select("item_id", "account_id", "title", "reason")


def repeated_items(spark, folder):
    """documents as accepted items whose URLs and fingerprints repeat across each other."""
    return read_table(spark, folder, "documents").select(
        F.col("lang").alias("account_id"), F.col("doc_id").alias("item_id"), F.col("doc_id").alias("input_ord"),
        F.concat(F.lit("https://news.example.com/"), F.col("n_chars")).alias("canonical_url"), F.col("source").alias("title"), F.col("text").alias("excerpt"),
        (ts("2024-01-01") + F.make_dt_interval(days=(F.col("n_chars") % 7).cast("int"))).alias("published_at"), F.lit("Desk").alias("author"),
    )


@query(
    "news_item_dedupe",
    """WITH RECURSIVE item AS (SELECT lang AS account_id, doc_id AS item_id, 'https://news.example.com/' || n_chars AS canonical_url,
        lower(source) || '|' || regexp_replace(lower(text), '\\s+', ' ', 'g') || '|' || (n_chars % 7) AS fingerprint, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
    coded AS (SELECT account_id, item_id, canonical_url, md5(fingerprint) AS fingerprint, rn FROM item),
    walk AS (SELECT DISTINCT account_id, 0::BIGINT AS rn, NULL::BIGINT AS item_id, NULL::VARCHAR AS canonical_url, NULL::BOOLEAN AS kept, []::VARCHAR[] AS taken FROM coded
      UNION ALL SELECT i.account_id, i.rn, i.item_id, i.canonical_url, NOT list_has_any(taken, [i.canonical_url, i.fingerprint]),
        CASE WHEN list_has_any(taken, [i.canonical_url, i.fingerprint]) THEN taken ELSE list_concat(taken, [i.canonical_url, i.fingerprint]) END
      FROM walk w JOIN coded i ON i.account_id = w.account_id AND i.rn = w.rn + 1)
    SELECT account_id, item_id, canonical_url, kept FROM walk WHERE rn > 0""",
)
def _item_dedupe(spark, folder):
    """Order-dependent: whether a row is kept depends on which earlier rows were kept."""
    return gates.news_item_dedupe(repeated_items(spark, folder)).select("account_id", "item_id", "canonical_url", "kept")


# --- classification ---------------------------------------------------------------------


def classified_items(spark, folder):
    docs = read_table(spark, folder, "documents", spread=True)
    return docs.select(
        "doc_id", F.col("lang"), F.col("source"), phrase(F.col("doc_id")).alias("title"),
        F.concat(phrase(F.col("n_chars")), F.lit(" for the  engineering team. "), F.col("text")).alias("text"),
    )


def _classify_sql() -> str:
    # keyword order matters for the excerpt and the rationale, categories are compared by name on ties
    entries = ", ".join(
        "{'n': len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(low, w))), 'cat': '" + cat + "', 'label': '" + label
        + "', 'words': list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(low, w))}"
        for cat, label, words, _, _ in sorted(NEWS_TAXONOMY)
    )
    return rf"""
    classified AS (SELECT *, hits[1] AS best, hits[1].n AS n, coalesce(hits[2].n, 0) AS n2 FROM (
      SELECT *, list_sort(list_transform(list_filter([{entries}], lambda h: h.n > 0), lambda h: {{'r': -h.n, 'cat': h.cat, 'label': h.label, 'words': h.words, 'n': h.n}})) AS hits
      FROM (SELECT *, lower(txt) AS low FROM texted))),
    sure AS (SELECT *, least(0.99::DOUBLE, 0.45::DOUBLE + n * 0.16::DOUBLE + CASE WHEN n > n2 THEN 0.08::DOUBLE ELSE 0 END) AS conf FROM classified),
    judged AS (SELECT *, coalesce(conf >= 0.7 AND NOT regexp_matches(txt, '{QUARANTINE}'), false) AS ok,
      greatest(1, instr(low, best.words[1]) - 100) AS start_at FROM sure)"""


_TEXTED = rf"""texted AS (SELECT *, trim(regexp_replace(title || '. ' || body, '\s+', ' ', 'g')) AS txt FROM (
  SELECT *, {sql_phrase('doc_id')} AS title, {sql_phrase('n_chars')} || ' for the  engineering team. ' || text AS body FROM documents))"""


@query(
    "news_classify",
    f"""WITH {_TEXTED}, {_classify_sql()}
    SELECT doc_id, CASE WHEN ok THEN best.cat END AS news_category, CASE WHEN ok THEN round(conf, 2) END AS confidence,
      CASE WHEN ok THEN 'Deterministic taxonomy match for ' || best.label || ': ' || array_to_string(best.words, ', ') || '.' END AS rationale,
      CASE WHEN ok THEN trim(substring(txt, start_at, 300)) END AS excerpt FROM judged""",
)
def _news_classify(spark, folder):
    found = news.news_classify(classified_items(spark, folder), normalize=False)
    return found.select("doc_id", "news_category", "confidence", "rationale", "excerpt")


_OBS_ID = sql_stable_id("observation", "account_id", "'company_news'", "'rec-' || doc_id", sql_iso("TIMESTAMP '2024-01-05'"))
_SIG_ID = sql_stable_id("signal", "account_id", "'it_company_news'", "'company_news'", "'rec-' || doc_id", sql_iso("TIMESTAMP '2024-01-05'"))


@query(
    "news_signals",
    f"""WITH {_TEXTED}, {_classify_sql()},
    placed AS (SELECT *, 'acct-' || lang AS account_id, doc_id IN (SELECT doc_id FROM labels) AS stored,
      source NOT IN ('src1', 'src2') AND NOT regexp_matches(txt, '{QUARANTINE}') AS persistable FROM judged),
    out AS (SELECT *, CASE WHEN NOT persistable THEN 'suppressed' WHEN stored THEN 'skipped_existing' WHEN NOT ok THEN 'unclassified' ELSE 'signal' END AS outcome FROM placed)
    SELECT account_id, doc_id AS item_id, outcome, CASE WHEN outcome IN ('signal', 'unclassified') THEN {_OBS_ID} END AS observation_id,
      CASE WHEN outcome = 'signal' THEN {_SIG_ID} END AS signal_id, CASE WHEN outcome = 'signal' THEN best.cat END AS news_category,
      CASE WHEN outcome = 'signal' THEN best.label || ': ' || title END AS title,
      CASE WHEN outcome = 'signal' THEN CASE WHEN best.cat = 'platform_change' THEN 'risk' ELSE 'expansion' END END AS direction,
      CASE WHEN outcome = 'signal' THEN CASE WHEN best.cat = 'hiring' THEN 'info' ELSE 'warning' END END AS severity,
      CASE WHEN outcome = 'signal' THEN round(conf, 2) END AS confidence FROM out""",
)
def _news_signals(spark, folder):
    items = classified_items(spark, folder).select(
        F.concat(F.lit("acct-"), F.col("lang")).alias("account_id"), F.col("doc_id").alias("item_id"),
        F.when(F.col("source") == "src1", "manual").otherwise("company_news").alias("source_system"),
        F.when(F.col("source") == "src2", "https://other.example.com/x").otherwise(F.concat(F.lit("https://news."), F.col("lang"), F.lit(".example.com/"), F.col("doc_id"))).alias("source_url"),
        F.concat(F.lit("rec-"), F.col("doc_id")).alias("record_id"), ts("2024-01-05").alias("observed_at"), ts("2024-01-06").alias("received_at"), "title", "text",
    )
    accounts = read_table(spark, folder, "documents").select(F.col("lang")).distinct().select(
        F.concat(F.lit("acct-"), F.col("lang")).alias("account_id"), F.col("lang").alias("account_name"), F.array(F.concat(F.col("lang"), F.lit(".example.com"))).alias("domains")
    )
    from tidemark.functions.ids import observation_id

    labelled = read_table(spark, folder, "labels").select("doc_id").join(read_table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    stored = labelled.select(
        observation_id(F.concat(F.lit("acct-"), F.col("lang")), F.lit("company_news"), F.concat(F.lit("rec-"), F.col("doc_id")), ts("2024-01-05"), ascii_only=True).alias("observation_id")
    )
    found = news.news_signals(items, accounts, stored, normalize=False)
    return found.select("account_id", "item_id", "outcome", "observation_id", "signal_id", "news_category", "title", "direction", "severity", "confidence")


# --- naming and candidates ------------------------------------------------------------------

NAMES = ["Attion Group", "Thanedble", "Éaux  SA", "Ungen & Co"]


def watchlist(spark, folder):
    """The sources of the documents as watched accounts (a bounded list)."""
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return read_table(spark, folder, "documents").select("source").distinct().select(
        F.concat(F.lit("acct-"), F.col("source")).alias("account_id"), F.concat(F.lit("Account "), F.col("source")).alias("name"),
        F.element_at(F.array(*[F.lit(n) for n in NAMES]), number % 4 + 1).alias("search_name"),
        F.array(F.lit("Onthe Theen"), F.lit("Zwei Drei AG")).alias("aliases"), F.lit("media.example.com").alias("domain"), (number % 2 == 0).alias("exclude_own_domain"),
    )


FOLD = "regexp_replace(strip_accents(lower(@)), '[^a-z0-9]+', ' ', 'g')"
_MENTION = """(CASE CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 4 WHEN 0 THEN contains(folded, ' attion ') WHEN 1 THEN contains(folded, ' thanedble ')
  WHEN 2 THEN contains(folded, ' eaux ') ELSE contains(folded, ' ungen ') END OR (contains(folded, ' onthe ') AND contains(folded, ' theen ')) OR (contains(folded, ' zwei ') AND contains(folded, ' drei ')))"""


@query(
    "mentions_account",
    f"""SELECT doc_id, 'acct-' || source AS account_id, {_MENTION} AS mentioned FROM (SELECT *, ' ' || {FOLD.replace('@', "text")} || ' ' AS folded FROM documents)""",
)
def _mentions(spark, folder):
    items = read_table(spark, folder, "documents", spread=True).select("doc_id", F.concat(F.lit("acct-"), F.col("source")).alias("account_id"), "text")
    return news.mentions_account(items, watchlist(spark, folder), "text").select("doc_id", "account_id", "mentioned")


def search_results(spark, folder):
    """documents as search results for the account of their source."""
    docs = read_table(spark, folder, "documents", spread=True)
    url = (
        F.when(F.col("n_chars") < 300, F.concat(F.lit("https://play.google.com/store/"), F.col("doc_id")))
        .when(F.col("n_chars") < 500, F.concat(F.lit("https://www.media.example.com/story/"), F.col("doc_id")))
        .when(F.col("n_chars") < 600, F.lit("https://news.example.net/en-gb/fr?utm_source=x"))
        .when(F.col("n_chars") < 700, F.lit("ftp://news.example.net/x"))
        .otherwise(F.concat(F.lit("https://WWW.news.example.net/story/"), F.col("doc_id"), F.lit("?utm_source=x&id=1#frag")))
    )
    return docs.select(
        F.concat(F.lit("acct-"), F.col("source")).alias("account_id"), F.col("doc_id").alias("result_id"), F.col("doc_id").alias("input_ord"),
        F.when(F.col("lang") == "de", F.concat(F.lit("  "), phrase(F.col("doc_id")), F.lit(" APK"))).otherwise(phrase(F.col("doc_id"))).alias("title"), url.alias("url"),
        F.when(F.col("lang") != "fr", ts("2024-01-20") - F.make_dt_interval(days=(F.col("n_chars") % 11).cast("int"))).alias("published_at"),
        F.array().cast("array<string>").alias("highlights"), "text",
    )


CANDIDATES_SQL = rf"""
result AS (SELECT doc_id, source, lang, n_chars, CASE WHEN lang = 'de' THEN {sql_phrase('doc_id')} || ' APK' ELSE {sql_phrase('doc_id')} END AS title,
    CASE WHEN n_chars < 300 THEN 'https://play.google.com/store/' || doc_id WHEN n_chars < 500 THEN 'https://www.media.example.com/story/' || doc_id
      WHEN n_chars < 600 THEN 'https://news.example.net/en-gb/fr' WHEN n_chars < 700 THEN NULL ELSE 'https://www.news.example.net/story/' || doc_id || '?id=1' END AS url,
    array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\.\.\.\s*\n|\n{{2,}}'),
      lambda p: trim(regexp_replace(regexp_replace(p, '^[#>*\s-]+', ''), '\s+', ' ', 'g'))), lambda p: p <> ''), ' ') AS body,
    CASE WHEN lang <> 'fr' THEN TIMESTAMP '2024-01-20' - to_days(CAST(n_chars % 11 AS INT)) END AS published_at FROM documents),
candidate AS (SELECT *, CASE WHEN url IS NULL THEN 'unusable' WHEN n_chars < 300 THEN 'excluded_host'
    WHEN n_chars < 500 AND CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'own_domain' WHEN n_chars >= 500 AND n_chars < 600 THEN 'homepage' WHEN lang = 'de' THEN 'app_listing'
    WHEN published_at < TIMESTAMP '2024-01-12' THEN 'too_old' WHEN NOT {_MENTION} THEN 'not_named' END AS drop_reason,
    'news:' || left(sha256(url), 16) AS item_id, CASE WHEN length(body) > 1500 THEN rtrim(left(body, 1499)) || '…' ELSE body END AS excerpt
  FROM (SELECT *, ' ' || {FOLD.replace('@', "(title || ' ' || left(body, 700))")} || ' ' AS folded FROM result))"""


@query(
    "news_candidate_gate",
    f"WITH {CANDIDATES_SQL} SELECT doc_id AS result_id, 'acct-' || source AS account_id, item_id, title, drop_reason, excerpt, published_at FROM candidate",
)
def _candidates(spark, folder):
    gated = news.news_candidate_gate(search_results(spark, folder), watchlist(spark, folder), ts("2024-01-20"))
    return gated.select("result_id", "account_id", "item_id", "title", "drop_reason", "excerpt", "published_at")


# --- stories, novelty ---------------------------------------------------------------------------


def titled(spark, folder):
    return read_table(spark, folder, "documents", spread=True).select(
        F.col("lang").alias("account_id"), F.concat(F.lit("news:"), F.col("doc_id")).alias("item_id"), F.col("doc_id").alias("input_ord"), F.col("text").alias("title"), "doc_id"
    )


@query(
    "same_story_pairs",
    f"""WITH worded AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(string_split({FOLD.replace('@', 'text')}, ' '), lambda w: length(w) > 3))) AS words,
        doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
    mine AS (SELECT lang, words FROM worded WHERE NOT known AND len(words) >= 3 GROUP BY ALL),
    theirs AS (SELECT lang, words, min(doc_id) AS first_id FROM worded WHERE known AND len(words) >= 3 GROUP BY ALL),
    hit AS (SELECT m.lang, m.words, min(first_id) AS known_id, count(*) AS n FROM mine m JOIN theirs t ON m.lang = t.lang
      AND len(list_intersect(m.words, t.words)) / least(len(m.words), len(t.words))::DOUBLE >= 0.7 GROUP BY ALL)
    SELECT w.lang AS account_id, doc_id, known_id, coalesce(n, 0) AS known_stories FROM worded w LEFT JOIN hit h ON w.lang = h.lang AND w.words = h.words WHERE NOT known""",
)
def _pairs(spark, folder):
    every = titled(spark, folder)
    labels = read_table(spark, folder, "labels").select("doc_id")
    known = every.join(labels, "doc_id", "left_semi").select("account_id", F.col("doc_id").alias("known_id"), F.col("doc_id").alias("known_ord"), "title")
    found = stories.match_known_stories(every.join(labels, "doc_id", "left_anti"), known)
    return found.select("account_id", "doc_id", "known_id", "known_stories")


def judged_state(spark, folder):
    """Labelled documents as remembered items."""
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    return titled(spark, folder).join(labels, "doc_id").select(
        "item_id", "account_id", "title", F.concat(F.lit("https://news.example.net/"), F.col("doc_id")).alias("url"), F.lit("news.example.net").alias("publisher"),
        ts("2024-01-10").alias("published_at"), (ts("2024-01-01") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("first_seen_at"),
        F.when(F.col("quality") == 1, "material").otherwise("neutral").alias("verdict"), F.when(F.col("quality") == 1, "opportunity").alias("direction"),
        F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, "high").otherwise("medium")).alias("event_confidence"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Event "), F.col("doc_id"))).alias("event_text"), F.when(F.col("quality") == 1, "Because").alias("reason_text"), F.lit("").alias("next_text"),
    )


@query(
    "news_novelty",
    f"""WITH RECURSIVE worded AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(string_split({FOLD.replace('@', 'text')}, ' '), lambda w: length(w) > 3))) AS words FROM documents),
    known AS (SELECT doc_id, lang, words FROM worded WHERE doc_id IN (SELECT doc_id FROM labels) AND TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) < TIMESTAMP '2024-01-06'),
    old AS (SELECT DISTINCT w.doc_id FROM worded w JOIN known k ON w.lang = k.lang AND (w.doc_id = k.doc_id OR (len(w.words) >= 3 AND len(k.words) >= 3
      AND len(list_intersect(w.words, k.words)) / least(len(w.words), len(k.words))::DOUBLE >= 0.7))),
    open AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM worded WHERE doc_id NOT IN (SELECT doc_id FROM old)),
    walk AS (SELECT DISTINCT lang, 0::BIGINT AS rn, NULL::BIGINT AS doc_id, NULL::BOOLEAN AS kept, []::VARCHAR[][] AS taken FROM open
      UNION ALL SELECT lang, rn, doc_id, NOT hit, CASE WHEN hit OR len(words) < 3 THEN taken ELSE list_append(taken, words) END FROM (
        SELECT o.lang, o.rn, o.doc_id, o.words, taken, len(o.words) >= 3 AND len(list_filter(taken, lambda t: len(list_intersect(t, o.words)) / least(len(t), len(o.words))::DOUBLE >= 0.7)) > 0 AS hit
        FROM walk w JOIN open o ON o.lang = w.lang AND o.rn = w.rn + 1))
    SELECT lang AS account_id, 'news:' || doc_id AS item_id, CASE WHEN kept THEN 'fresh' ELSE 'repeated' END AS novelty FROM walk WHERE rn > 0
    UNION ALL SELECT lang, 'news:' || doc_id, 'already_judged' FROM worded WHERE doc_id IN (SELECT doc_id FROM old)""",
)
def _novelty(spark, folder):
    """Order-dependent greedy selection within each account."""
    state = judged_state(spark, folder).filter(F.col("first_seen_at") < ts("2024-01-06"))
    return news.news_novelty(titled(spark, folder).drop("doc_id"), state).select("account_id", "item_id", "novelty")


@query(
    "evidence_supported",
    f"""WITH t AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN replace(text, ' ', ' - ') WHEN 'de' THEN source || ' of a very other thing' WHEN 'fr' THEN 'Two words' ELSE source || ' ' || text END AS quote FROM documents),
    f AS (SELECT doc_id, trim({FOLD.replace('@', 'quote')}) AS q, trim({FOLD.replace('@', "('The news ' || text)")}) AS body FROM t)
    SELECT doc_id, len(string_split(q, ' ')) >= 4 AND contains(body, q) AS supported FROM f""",
)
def _supported(spark, folder):
    docs = read_table(spark, folder, "documents", spread=True)
    quote = (
        F.when(F.col("lang") == "en", F.replace(F.col("text"), F.lit(" "), F.lit(" - "))).when(F.col("lang") == "de", F.concat("source", F.lit(" of a very other thing")))
        .when(F.col("lang") == "fr", "Two words").otherwise(F.concat_ws(" ", "source", "text"))
    )
    staged = docs.select("doc_id", quote.alias("quote"), F.lit("The news").alias("title"), F.col("text").alias("excerpt"))
    return staged.select("doc_id", news.evidence_supported("quote", "title", "excerpt").alias("supported"))


# --- judgement and events --------------------------------------------------------------------------


def fresh_items(spark, folder):
    docs = read_table(spark, folder, "documents", spread=True)
    return docs.select(
        F.concat(F.lit("acct-"), F.col("lang")).alias("account_id"), F.concat(F.lit("news:"), F.col("doc_id")).alias("item_id"), F.col("doc_id").alias("input_ord"),
        F.concat(phrase(F.col("doc_id")), F.lit(" today")).alias("title"), F.concat(F.lit("https://news.example.net/"), F.col("doc_id")).alias("url"),
        F.lit("news.example.net").alias("publisher"), F.when(F.col("lang") != "fr", ts("2024-01-19")).alias("published_at"), F.col("text").alias("excerpt"),
    )


VERDICT_SQL = f"""
fresh AS (SELECT 'acct-' || lang AS account_id, 'news:' || doc_id AS item_id, {sql_phrase('doc_id')} || ' today' AS title, lang, text AS excerpt, lower({sql_phrase('doc_id')} || ' today ' || text) AS low FROM documents),
verdict AS (SELECT *, CASE WHEN regexp_matches(low, '{news.RISK_WORDS}') THEN 'risk' WHEN regexp_matches(low, '{news.OPPORTUNITY_WORDS}') THEN 'opportunity' ELSE 'neutral' END AS impact,
  CASE WHEN regexp_matches(low, '{news.RISK_WORDS}') THEN 'high' ELSE 'medium' END AS confidence FROM fresh)"""


@query("judge_batches", f"WITH {VERDICT_SQL} SELECT account_id, item_id, impact, confidence, lang <> 'fr' AS dated_event, title AS evidence FROM verdict")
def _judge(spark, folder):
    return news.judge_batches(fresh_items(spark, folder)).select("account_id", "item_id", "impact", "confidence", "dated_event", "evidence")


@query(
    "material_events",
    f"""WITH {VERDICT_SQL}, m AS (SELECT *, lang <> 'fr' AND impact <> 'neutral' AND len(string_split(trim({FOLD.replace('@', 'title')}), ' ')) >= 4 AS material FROM verdict)
    SELECT account_id, item_id, material, CASE WHEN material THEN impact END AS direction, CASE WHEN material THEN confidence END AS event_confidence,
      CASE WHEN material THEN title END AS event_text, CASE WHEN material THEN CASE impact WHEN 'risk' THEN 'Spending may fall.' ELSE 'Spending may grow.' END END AS reason_text FROM m""",
)
def _events(spark, folder):
    fresh = fresh_items(spark, folder)
    found = news.material_events(news.judge_batches(fresh), fresh)
    return found.select("account_id", "item_id", "material", "direction", "event_confidence", "event_text", "reason_text")


_STATE_SQL = """
state AS (SELECT 'news:' || doc_id AS item_id, lang AS account_id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS first_seen_at,
  CASE quality WHEN 1 THEN 'material' ELSE 'neutral' END AS verdict, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'medium' END END AS event_confidence, doc_id
  FROM documents JOIN labels USING (doc_id))"""


@query(
    "news_state_upsert",
    f"""WITH {_STATE_SQL}, {VERDICT_SQL}, m AS (SELECT item_id, account_id, lang <> 'fr' AND impact <> 'neutral' AND len(string_split(trim({FOLD.replace('@', 'title')}), ' ')) >= 4 AS material FROM verdict)
    SELECT item_id, account_id, TIMESTAMP '2024-02-01' AS first_seen_at, CASE WHEN material THEN 'material' ELSE 'neutral' END AS verdict FROM m
    UNION ALL SELECT item_id, account_id, first_seen_at, verdict FROM state WHERE first_seen_at >= TIMESTAMP '2024-02-01' - INTERVAL 21 DAY AND item_id NOT IN (SELECT item_id FROM m)""",
)
def _upsert(spark, folder):
    fresh = fresh_items(spark, folder)
    judged = news.material_events(news.judge_batches(fresh), fresh)
    return news.news_state_upsert(judged_state(spark, folder), judged, ts("2024-02-01")).select("item_id", "account_id", "first_seen_at", "verdict")


@query(
    "news_pending",
    f"""WITH {_STATE_SQL}, pending AS (SELECT state.*, 'Name ' || account_id AS account_name FROM state
      WHERE verdict = 'material' AND first_seen_at >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY first_seen_at, CASE event_confidence WHEN 'high' THEN 2 ELSE 1 END DESC, account_name, item_id) AS rn,
      count(*) OVER (PARTITION BY account_id) AS n FROM pending)
    SELECT account_id, item_id, account_name, first_seen_at, event_confidence, true AS carried_over, greatest(0, n - 6) AS pending_beyond_limit FROM placed WHERE rn <= 6""",
)
def _pending(spark, folder):
    state = judged_state(spark, folder)
    reported = read_table(spark, folder, "labels").filter("toxic = 1").select(F.concat(F.lit("news:"), F.col("doc_id")).alias("signal_id"))
    watched = read_table(spark, folder, "documents").select(F.col("lang").alias("account_id")).distinct().withColumn("name", F.concat(F.lit("Name "), F.col("account_id")))
    found = news.news_pending(news.pending_candidates(state, reported, watched, ts("2024-01-25")), scan="account_id")
    return found.select("account_id", "item_id", "account_name", "first_seen_at", "event_confidence", "carried_over", "pending_beyond_limit")


@query(
    "news_scan_summary",
    f"""WITH RECURSIVE {CANDIDATES_SQL},
    found AS (SELECT * FROM candidate WHERE source <> 'src7'),
    worded AS (SELECT doc_id, source, lang, title, excerpt, list_sort(list_distinct(list_filter(string_split({FOLD.replace('@', 'title')}, ' '), lambda w: length(w) > 3))) AS words
      FROM found WHERE drop_reason IS NULL),
    open AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM worded),
    walk AS (SELECT DISTINCT source, 0::BIGINT AS rn, NULL::BIGINT AS doc_id, NULL::BOOLEAN AS kept, []::VARCHAR[][] AS taken FROM open
      UNION ALL SELECT source, rn, doc_id, NOT hit, CASE WHEN hit OR len(words) < 3 THEN taken ELSE list_append(taken, words) END FROM (
        SELECT o.source, o.rn, o.doc_id, o.words, taken, len(o.words) >= 3 AND len(list_filter(taken, lambda t: len(list_intersect(t, o.words)) / least(len(t), len(o.words))::DOUBLE >= 0.7)) > 0 AS hit
        FROM walk w JOIN open o ON o.source = w.source AND o.rn = w.rn + 1)),
    fresh AS (SELECT doc_id, lang, title, lower(title || ' ' || excerpt) AS low FROM walk JOIN worded USING (doc_id) WHERE kept),
    judged AS (SELECT lang <> 'fr' AND regexp_matches(low, '{news.RISK_WORDS}|{news.OPPORTUNITY_WORDS}') AND len(string_split(trim({FOLD.replace('@', 'title')}), ' ')) >= 4 AS material FROM fresh),
    account AS (SELECT DISTINCT source FROM documents)
    SELECT (SELECT count(*) FROM account) AS total_accounts, (SELECT count(*) FROM account WHERE source <> 'src7') AS searched, (SELECT count(*) FROM account WHERE source = 'src7') AS failed_accounts,
      (SELECT count(*) FROM found) AS results, (SELECT count(*) FROM found WHERE drop_reason IS NULL) AS candidates, 0::BIGINT AS already_judged,
      (SELECT count(*) FROM judged) AS judged, (SELECT count(*) FROM judged WHERE material) AS material,
      CASE WHEN (SELECT count(*) FROM account WHERE source = 'src7') > 0 THEN 'partial' ELSE 'succeeded' END AS status""",
)
def _scan(spark, folder):
    """One whole scan: gate, novelty, judgement, state, pending events, summary."""
    results, watched = search_results(spark, folder), watchlist(spark, folder)
    searches = watched.select("account_id", (F.col("account_id") != "acct-src7").alias("ok"))
    state = judged_state(spark, folder).withColumn("account_id", F.concat(F.lit("acct-"), F.col("account_id")))
    reported = read_table(spark, folder, "labels").filter("toxic = 1").select(F.concat(F.lit("news:"), F.col("doc_id")).alias("signal_id"))
    return news_scan(results, watched, searches, state, reported, ts("2024-01-20")).summary
