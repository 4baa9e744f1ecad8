"""URL columns built from regular expressions and array functions (no UDF).

Intermediate values that are needed more than once are bound by ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import as_col, let, trim_all

_MARK = "\u0001"
# scheme, authority, path, query; the fragment is dropped
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?.*$"
# an IDN host would need punycode, so only plain host names and IPv4/IPv6 literals are taken
_HOST = r"^(?:[a-z0-9_](?:[a-z0-9_.-]*[a-z0-9_])?\.?|\[[0-9a-f:.]+\])$"


def url_parts(url: Column | str) -> Column:
    """Struct of scheme, host, site (host with a non-default port), path, query, credentials; NULL when unusable."""
    marked = F.split(F.regexp_replace(as_col(url), _PARTS, f"$1{_MARK}$2{_MARK}$3{_MARK}$4"), _MARK)

    def read(parts: Column) -> Column:
        fields = F.struct(
            F.lower(F.get(parts, 0)).alias("scheme"),
            F.lower(F.regexp_replace(F.get(parts, 1), "^.*@", "")).alias("place"),
            F.when(F.get(parts, 2) == "", F.lit("/")).otherwise(F.get(parts, 2)).alias("path"),
            F.get(parts, 3).alias("query"),
            F.get(parts, 1).rlike("^[^@]+@").alias("credentials"),
        )
        return F.when(F.size(parts) == 4, let(fields, finish))

    def finish(p: Column) -> Column:
        host = F.regexp_replace(p["place"], ":[0-9]*$", "")
        default_port = F.when(p["scheme"] == "https", F.lit(":(443)?$")).otherwise(F.lit(":(80)?$"))
        return let(
            host,
            lambda h: F.when(
                h.rlike(_HOST),
                F.struct(
                    p["scheme"].alias("scheme"), h.alias("host"), F.regexp_replace(p["place"], default_port, F.lit("")).alias("site"),
                    p["path"].alias("path"), p["query"].alias("query"), p["credentials"].alias("credentials"),
                ),
            ),
        )

    return let(marked, read)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def path_of(url: Column) -> Column:
    return url_parts(url)["path"]


def host_of(url: Column | str) -> Column:
    """Lower-case host without port and leading ``www.``; NULL when the URL is not usable."""
    return F.regexp_replace(url_parts(url)["host"], r"^www\.", "")


def origin_of(url: Column | str) -> Column:
    return let(url_parts(url), lambda p: F.concat(p["scheme"], F.lit("://"), p["site"]))


def _kept_query(query: Column, drop_parameters: str | None) -> Column:
    if drop_parameters is None:
        return F.when(query == "?", F.lit("")).otherwise(query)
    pairs = F.filter(
        F.split(F.regexp_replace(query, r"^\?", ""), "&"),
        lambda pair: (pair != "") & ~F.regexp_replace(pair, "(?s)=.*$", "").rlike(drop_parameters),
    )
    return let(pairs, lambda kept: F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(kept, "&"))))


def canonical_url(
    url: Column | str,
    *,
    schemes: tuple[str, ...] = ("https", "http"),
    drop_parameters: str | None = None,
    trim_slashes: str = "none",
    excluded_host: str | None = None,
    allow_credentials: bool = False,
) -> Column:
    """Canonical text of a URL, NULL when it is unusable.

    ``trim_slashes``: ``none``, ``all`` (every trailing slash) or ``one``
    (doubled slashes collapse, then one trailing slash goes). Percent escapes
    and dot segments stay as given.
    """

    def build(p: Column) -> Column:
        path = p["path"]
        if trim_slashes == "all":
            path = F.regexp_replace(path, "/+$", "")
        elif trim_slashes == "one":
            path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
        path = F.regexp_replace(path, "^$", "/")
        usable = p["scheme"].isin(*schemes)
        if not allow_credentials:
            usable = usable & ~p["credentials"]
        if excluded_host:
            usable = usable & (p["host"] != excluded_host) & ~p["host"].endswith(f".{excluded_host}")
        return F.when(usable, F.concat(p["scheme"], F.lit("://"), p["site"], path, _kept_query(p["query"], drop_parameters)))

    return let(url_parts(trim_all(as_col(url))), build)


def host_in_domains(host: Column, domains: Column) -> Column:
    """Host equals a domain of the array or is a subdomain of one (row-local, no join)."""

    def covers(h: Column) -> Callable[[Column], Column]:
        return lambda domain: let(
            F.regexp_replace(F.regexp_replace(F.lower(domain), r"^www\.", ""), r"\.$", ""),
            lambda bare: (h == bare) | h.endswith(F.concat(F.lit("."), bare)),
        )

    return F.coalesce(let(host, lambda h: F.exists(domains, covers(h))), F.lit(False))


def host_in_list(host: Column, domains: list[str]) -> Column:
    """As :func:`host_in_domains` for a fixed list: one of the host's own suffixes is listed."""
    labels = F.split(host, r"\.")
    suffixes = let(
        labels,
        lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), ".")),
    )
    return F.coalesce(F.exists(suffixes, lambda s: s.isin(*domains)), F.lit(False))


def is_homepage(url: Column) -> Column:
    from tidemark.functions.vocabulary import HOMEPAGE_PATH_PART

    parts = F.filter(F.split(path_of(url), "/"), lambda part: part != "")
    return F.forall(parts, lambda part: part.rlike(HOMEPAGE_PATH_PART))
