"""Job feeds and pages to rows: JSON through VARIANT, HTML through regular expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import as_col, collapse, let, trim_all
from tidemark.functions.urls import canonical_url, path_of, scheme_of
from tidemark.operators.gates import page_url

# Names under which feeds carry their lists and fields.
LIST_KEYS = ["jobs", "jobPostings", "postings", "data", "results", "items", "@graph"]
URL_KEYS = ["url", "absolute_url", "hostedUrl", "applyUrl", "link"]
TITLE_KEYS = ["title", "text", "name", "position"]
ID_KEYS = ["id", "jobId", "requisitionId", "reqId"]
LOCATION_KEYS = ["location", "locations", "locationName"]
DEPARTMENT_KEYS = ["department", "team", "function"]
POSTED_KEYS = ["postedAt", "posted_at", "createdAt", "created_at", "updatedAt", "updated_at", "datePosted"]
ARTICLE_TYPES = ["article", "newsarticle", "blogposting"]

JOBS = "array<struct<job_id: string, title: string, department: string, location: string, url: string, posted_at: timestamp, observed_at: timestamp>>"


def _path(key: str) -> str:
    return f"$['{key}']"


def _get(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, _path(key), kind)


def _defined(value: Column, keys: list[str]) -> Column:
    """First key that is present, even with a JSON null."""
    return F.coalesce(*[_get(value, key) for key in keys])


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _text(value: Column) -> Column:
    """Trimmed text of a JSON string; numbers, lists and objects are no text."""

    def read(found: Column) -> Column:
        trimmed = F.when(_is(found, "STRING"), trim_all(F.try_variant_get(found, "$", "string")))
        return F.nullif(trimmed, F.lit(""))

    return let(value, read)


def _department(value: Column) -> Column:

    def read(found: Column) -> Column:
        parts = F.transform(
            F.try_variant_get(found, "$", "array<variant>"),
            lambda item: F.coalesce(_text(item), F.when(_is(item, "OBJECT"), _text(_get(item, "name")))),
        )
        joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", ")
        return (
            F.when(_is(found, "STRING"), _text(found))
            .when(_is(found, "ARRAY"), F.nullif(joined, F.lit("")))
            .when(_is(found, "OBJECT"), _text(_get(found, "name")))
        )

    return let(value, read)


def parse_date(text: Column) -> Column:
    """Instant of a date text: ISO 8601, or one of a few spelled formats; anything else is NULL."""

    def read(given: Column) -> Column:
        spelled = [
            F.try_to_timestamp(F.when(given.rlike(pattern), given), F.lit(layout))
            for pattern, layout in (
                (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
                (r"^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
            )
        ]
        iso = F.when(given.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), given)
        return F.coalesce(F.try_to_timestamp(iso), *spelled)

    return let(text, read)


def absolute_url(candidate: Column, base: Column) -> Column:
    """``candidate`` resolved against ``base``; NULL when neither gives a usable URL."""

    def resolve(given: Column) -> Column:
        site = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        return (
            F.when(given.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), given)
            .when(given.startswith("//"), F.concat(scheme_of(base), F.lit(":"), given))
            .when(given.startswith("/"), F.concat(site, given))
            .when(given.startswith("?"), F.concat(site, path_of(base), given))
            .when(given.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), given))
            .otherwise(F.concat(site, F.regexp_replace(path_of(base), "[^/]*$", ""), given))
        )

    def finish(resolved: Column) -> Column:
        fragment = F.regexp_replace(F.regexp_extract(resolved, "(#.*)$", 1), "^#$", "")
        return F.concat(canonical_url(resolved, allow_credentials=True), fragment)

    return let(let(candidate, resolve), finish)


def _job(item: Column, base: Column, observed_at: Column) -> Column:
    """Struct of a job out of one feed entry; ``ok`` when id, title and URL are there."""

    def read(url: Column) -> Column:
        nested = _get(item, "categories")
        fields = F.struct(
            F.coalesce(_text(_defined(item, ID_KEYS)), url).alias("job_id"),
            _text(_defined(item, TITLE_KEYS)).alias("title"),
            F.coalesce(_department(_defined(item, DEPARTMENT_KEYS)), _department(_defined(nested, DEPARTMENT_KEYS))).alias("department"),
            F.coalesce(_text(_defined(item, LOCATION_KEYS)), _text(_defined(nested, LOCATION_KEYS[:2]))).alias("location"),
            url.alias("url"),
            parse_date(_text(_defined(item, POSTED_KEYS))).alias("posted_at"),
            F.coalesce(parse_date(_text(_get(item, "observedAt"))), observed_at).alias("observed_at"),
        )
        return let(fields, lambda job: F.when(job["job_id"].isNotNull() & job["title"].isNotNull() & job["url"].isNotNull(), job))

    return let(absolute_url(_text(_defined(item, URL_KEYS)), base), read)


def _kept(jobs: Column) -> Column:
    return F.filter(jobs, lambda job: job.isNotNull())


def _rejects(read: DataFrame, key: str) -> DataFrame:
    return read.filter(F.size("jobs") == 0).select(key, F.lit("malformed").alias("reason"))


def json_jobs(body: Column, url: Column, observed_at: Column) -> Column:
    """Jobs of a JSON feed, empty for an unreadable one.

    The list is the body itself or the first known list key; entries lacking title, URL or any id fall.
    """
    def listing(doc: Column) -> Column:
        return F.coalesce(
            F.when(_is(doc, "ARRAY"), F.try_variant_get(doc, "$", "array<variant>")),
            *[let(_get(doc, k), lambda found: F.when(_is(found, "ARRAY"), F.try_variant_get(found, "$", "array<variant>"))) for k in LIST_KEYS],
        )

    jobs = _kept(F.transform(let(F.try_parse_json(body), listing), lambda item: _job(item, url, observed_at)))
    return F.coalesce(jobs, F.array().cast(JOBS))


def careers_extract_json(feeds: DataFrame, key: str = "account_id") -> tuple[DataFrame, DataFrame]:
    """(job rows, malformed feeds) of JSON feeds (key, url, body, observed_at); a feed without a valid entry is malformed."""
    read = feeds.select(key, json_jobs(F.col("body"), F.col("url"), F.col("observed_at")).alias("jobs"))
    rows = read.select(F.col(key).alias("feed_key"), F.posexplode("jobs").alias("input_ord", "job"))
    jobs = rows.select(F.col("feed_key").alias(key), F.col("input_ord").cast("bigint").alias("input_ord"), "job.*")
    return jobs, _rejects(read, key)


def decode_html(text: Column) -> Column:
    for pattern, plain in (("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        text = F.regexp_replace(text, pattern, plain)
    return text


def plain_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    return decode_html(collapse(F.regexp_replace(bare, "<[^>]*>", " ")))


_LD_JSON = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _ld_candidates(body: Column) -> Column:
    """All objects of the page's JSON-LD blocks; unreadable blocks are skipped."""
    def objects(doc: Column) -> Column:
        entries = F.when(_is(doc, "ARRAY"), F.try_variant_get(doc, "$", "array<variant>")).otherwise(F.array(doc))
        return F.flatten(F.transform(
            entries,
            lambda e: F.when(_is(_get(e, "@graph"), "ARRAY"), _get(e, "@graph", "array<variant>")).otherwise(F.array(e)),
        ))

    blocks = F.regexp_extract_all(body, F.lit(_LD_JSON), 1)
    docs = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda d: d.isNotNull())
    return F.flatten(F.transform(docs, objects))


def html_jobs(body: Column, url: Column, observed_at: Column) -> Column:
    """Jobs of a careers page: JSON-LD postings, then links that carry an id attribute."""
    postings = F.filter(_ld_candidates(body), lambda item: F.coalesce(_text(_get(item, "@type")) == "JobPosting", F.lit(False)))
    anchor = F.lit(r"""(?i)<a\b([^>]*?)href=["']([^"']+)["']([^>]*)>([\s\S]*?)</a>""")
    links = F.arrays_zip(*[F.regexp_extract_all(body, anchor, g).alias(n) for g, n in ((1, "a"), (2, "href"), (3, "b"), (4, "inner"))])
    missing = F.lit(None).cast("string")

    def linked(link: Column) -> Column:
        attributes = F.concat_ws(" ", link["a"], link["b"])
        job_id = F.regexp_extract(attributes, r"""(?i)(?:data-job-id|data-id|id)=["']([^"']+)["']""", 1)
        inner = F.regexp_replace(link["inner"], "<[^>]*>", " ")
        for pattern, plain in (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"')):
            inner = F.regexp_replace(inner, pattern, plain)
        fields = F.struct(
            F.nullif(job_id, F.lit("")).alias("job_id"), collapse(inner).alias("title"), missing.alias("department"), missing.alias("location"),
            absolute_url(trim_all(link["href"]), url).alias("url"), F.lit(None).cast("timestamp").alias("posted_at"), observed_at.alias("observed_at"),
        )
        return let(fields, lambda job: F.when((F.length(job["title"]) >= 2) & job["job_id"].isNotNull() & job["url"].isNotNull(), job))

    jobs = F.concat(_kept(F.transform(postings, lambda item: _job(item, url, observed_at))), _kept(F.transform(links, linked)))
    return F.coalesce(jobs, F.array().cast(JOBS))


def careers_extract_html(pages: DataFrame, key: str = "account_id") -> tuple[DataFrame, DataFrame]:
    """(job rows, malformed pages) of careers pages (key, url, body, observed_at); the last record of a job id wins."""
    read = pages.select(key, html_jobs(F.col("body"), F.col("url"), F.col("observed_at")).alias("jobs"))
    found = read.select(F.col(key).alias("page_key"), F.posexplode("jobs").alias("pos", "job")).select(F.col("page_key").alias(key), "pos", "job.*")
    rest = ["title", "department", "location", "url", "posted_at", "observed_at"]
    jobs = found.groupBy(key, "job_id").agg(F.max_by(F.struct(*rest), "pos").alias("j")).select(key, "job_id", "j.*")
    return jobs, _rejects(read, key)


def careers_collect(responses: DataFrame) -> DataFrame:
    """What each account's response comes to: fetch_status, source_system, error_code, retryable and its ``jobs``.

    ``responses``: account_id, url, http_status, content_type, body, observed_at, source_system (NULL if not declared).
    A body is JSON by its content type or its first character, else a page. A body without a valid posting is
    ``unsupported`` with the code malformed; 401 and 403 are unsupported too; 304 is ``not_modified``; any other
    status outside 200 to 299, or none, is ``failed`` and may be tried again. Only ``ok`` rows have jobs, in input
    order. One pass: each body is read once, rejects and jobs come from the same row.
    """
    status = F.col("http_status")
    fetched = F.coalesce((status >= 200) & (status < 300), F.lit(False))
    body, url, observed_at = F.coalesce("body", F.lit("")), F.col("url"), F.col("observed_at")
    is_json = F.coalesce(F.lower("content_type").contains("json"), F.lit(False)) | body.rlike(r"^\s*[\[{]")
    read = F.when(fetched & is_json, json_jobs(body, url, observed_at)).when(fetched, html_jobs(body, url, observed_at))
    named = F.when(status == 304, "ats_feed").when(fetched & is_json, "ats_feed").otherwise("careers_page")

    def outcome(jobs: Column) -> Column:
        found = F.coalesce(F.size(jobs) > 0, F.lit(False))
        code = F.when(status == 304, None).when(fetched & ~found, "malformed").when(status.isin(401, 403), "unsupported").when(~fetched, "source_unavailable")
        return F.struct(
            F.when(status == 304, "not_modified").when(found, "ok").when(fetched | F.coalesce(status.isin(401, 403), F.lit(False)), "unsupported").otherwise("failed").alias("fetch_status"),
            # what was not read keeps the system it was declared as
            F.coalesce("source_system", F.when(fetched & ~found, "careers_page").otherwise(named)).alias("source_system"),
            code.alias("error_code"), F.coalesce(code == "source_unavailable", F.lit(False)).alias("retryable"), F.when(found, jobs).alias("jobs"),
        )

    # a generator is a barrier: filters on the outcome do not read the body again
    return responses.select("account_id", F.inline(F.array(let(read, outcome))))


def collected_jobs(collected: DataFrame) -> DataFrame:
    """Job rows of :func:`careers_collect`: account_id, input_ord and the job's fields."""
    rows = collected.select("account_id", F.posexplode("jobs").alias("input_ord", "job"))
    return rows.select("account_id", F.col("input_ord").cast("bigint").alias("input_ord"), "job.*")


def _attributes(tag: Column) -> Column:
    pattern = F.lit(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(tag, pattern, 1), lambda n: F.lower(n)).alias("name"),
        F.regexp_extract_all(tag, pattern, 2).alias("double"),
        F.regexp_extract_all(tag, pattern, 3).alias("single"),
    )


def _attribute(tag: Column, name: str) -> Column:
    hits = F.filter(_attributes(tag), lambda a: a["name"] == name)
    last = F.get(hits, F.size(hits) - 1)
    return decode_html(F.when(last["double"] != "", last["double"]).otherwise(last["single"]))


def _non_blank(value: Column) -> Column:
    trimmed = trim_all(value)
    return F.when(trimmed != "", trimmed)


def page_metadata(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds canonical_url, title, excerpt, published_text, author and ``complete``.

    Meta tags come first, then a JSON-LD article, then the title tag and the
    article text; all five fields are required for a complete page.
    """
    body = as_col(html)
    tagged = (
        pages.withColumn(
            "metas",
            F.filter(
                F.transform(
                    F.regexp_extract_all(body, F.lit(r"(?i)<meta\b[^>]*>"), 0),
                    lambda tag: F.struct(
                        F.lower(F.coalesce(_attribute(tag, "property"), _attribute(tag, "name"))).alias("key"),
                        _non_blank(_attribute(tag, "content")).alias("value"),
                    ),
                ),
                lambda m: m["key"].isNotNull() & m["value"].isNotNull(),
            ),
        )
        .withColumn(
            "canonical_link",
            F.get(F.filter(
                F.transform(
                    F.regexp_extract_all(body, F.lit(r"(?i)<link\b[^>]*>"), 0),
                    lambda tag: F.struct(F.lower(_attribute(tag, "rel")).alias("rel"), _attribute(tag, "href").alias("href")),
                ),
                lambda link: F.array_contains(F.split(link["rel"], r"\s+"), "canonical") & (link["href"] != ""),
            ), 0),
        )
        .withColumn("article", F.get(F.filter(_ld_candidates(body), _is_article), 0))
    )
    article = F.col("article")
    author = _get(article, "author")
    title_tag = _non_blank(F.regexp_extract(body, r"(?i)<title\b[^>]*>([\s\S]*?)</title>", 1))
    article_text = _non_blank(F.substring(plain_text(F.regexp_extract(body, r"(?i)<article\b[^>]*>([\s\S]*?)</article>", 1)), 1, 2000))
    staged = (
        tagged.withColumn("title", decode_html(F.coalesce(_meta("og:title"), _text(_get(article, "headline")), title_tag)))
        .withColumn("excerpt", F.coalesce(_meta("description"), _meta("og:description"), _text(_get(article, "description")), article_text))
        .withColumn("excerpt", F.substring(plain_text(F.col("excerpt")), 1, 1000))
        .withColumn("published_text", F.coalesce(_meta("article:published_time"), _meta("datepublished"), _text(_get(article, "datePublished"))))
        .withColumn("author", decode_html(F.coalesce(_meta("author"), _meta("article:author"), _department(author))))
        .withColumn(
            "canonical_url",
            F.when(F.col("canonical_link").isNotNull(), page_url(absolute_url(trim_all("canonical_link.href"), as_col(url)))).otherwise(page_url(url)),
        )
    )
    complete = F.lit(True)
    for name in ("canonical_url", "title", "excerpt", "published_text", "author"):
        complete = complete & F.col(name).isNotNull()
    return staged.withColumn("complete", complete).drop("metas", "canonical_link", "article")


def _meta(key: str) -> Column:
    hits = F.filter("metas", lambda m: m["key"] == key)
    return F.get(hits, F.size(hits) - 1)["value"]


def _is_article(candidate: Column) -> Column:
    kind = _get(candidate, "@type")
    kinds = F.when(_is(kind, "ARRAY"), F.transform(F.try_variant_get(kind, "$", "array<variant>"), lambda k: F.lower(_text(k)))).otherwise(
        F.array(F.lower(_text(kind)))
    )
    return F.coalesce(F.exists(kinds, lambda k: k.isin(ARTICLE_TYPES)), F.lit(False))

