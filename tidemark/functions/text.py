"""Text columns: whitespace, folding, Unicode normalisation, clipping."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the white space that a trim removes (all Unicode space separators,
# line ends and the byte order mark; Spark's own trim removes U+0020 only).
WHITESPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

ASCII_WHITESPACE = r"[\t\n\x0B\f\r ]"

def is_ascii(value: Column) -> Column:
    """As many bytes as characters; cheaper than a regular expression."""
    return F.octet_length(value) == F.length(value)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    Keeps long derived columns small: without it a filter that Catalyst pushes
    below a projection repeats the whole expression for every use of its column.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), 0)


def computed(df: DataFrame, fields: Column) -> DataFrame:
    """Appends the fields of a struct, evaluated once per row at this point of the plan.

    A generator is a barrier: filters and inferred not-null conditions on the new
    columns stay above it instead of being pushed below as repeated evaluations.
    """
    return df.select("*", F.inline(F.array(fields)))


def _utf8_normalizer(form: str):
    @F.arrow_udf(StringType())
    def normalize(values: pa.Array) -> pa.Array:
        # Arrow's own kernel leaves NFKC decomposed, so the Unicode database does it, once for each distinct text
        named = pc.dictionary_encode(values)
        texts = [unicodedata.normalize(form, t) for t in named.dictionary.to_pylist()]
        return pa.array(texts, pa.string()).take(named.indices)

    return normalize


_FORMS = {form: _utf8_normalizer(form) for form in ("NFKC", "NFKD")}


def unicode_normal(value: Column | str, form: str = "NFKC") -> Column:
    """NFKC/NFKD. Spark has no built-in; only non-ASCII values reach Python, in Arrow batches."""
    value = as_col(value)
    non_ascii = F.when(~is_ascii(value), value)
    return F.coalesce(_FORMS[form](non_ascii), value)


def trim_all(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def collapse(value: Column | str) -> Column:
    """Runs of white space become one blank, ends are trimmed."""

    def tidy(text: Column) -> Column:
        # the wide class is slow to test per character and rarely needed
        narrow = F.regexp_replace(text, f"{ASCII_WHITESPACE}+", " ")
        return F.trim(F.when(is_ascii(text), narrow).otherwise(F.regexp_replace(text, f"{WHITESPACE}+", " ")))

    return let(as_col(value), tidy)


def clean(value: Column | str, normalize: bool = True) -> Column:
    """NULL-safe NFKC + collapse; ``normalize=False`` for columns known to be ASCII."""
    value = F.coalesce(as_col(value), F.lit(""))
    return collapse(unicode_normal(value) if normalize else value)


def fold_plain(value: Column | str, normalize: bool = True) -> Column:
    """Lower case, everything but ``a-z0-9`` becomes a blank; accented letters are lost."""
    value = F.coalesce(as_col(value), F.lit(""))
    lower = F.lower(unicode_normal(value) if normalize else value)
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def fold_accents(value: Column | str) -> Column:
    """As :func:`fold_plain`, but accents are stripped first and ``&`` reads as "and"."""
    value = F.coalesce(as_col(value), F.lit(""))
    bare = F.regexp_replace(unicode_normal(value, "NFKD"), r"[\u0300-\u036f]", "")
    spelled = F.regexp_replace(F.lower(bare), "&", " and ")
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def non_empty(value: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    trimmed = trim_all(value)
    return F.when(trimmed != "", trimmed)


def clip(value: Column, limit: int) -> Column:
    return F.substring(value, 1, limit)


def clip_ellipsis(value: Column, limit: int) -> Column:
    """Text longer than ``limit`` ends in an ellipsis, ``limit`` characters in all."""
    shortened = F.concat(F.regexp_replace(F.substring(value, 1, limit - 1), f"{WHITESPACE}+$", ""), F.lit("…"))
    return F.when(F.length(value) > limit, shortened).otherwise(value)


def contains_any(text: Column, terms) -> Column:
    """Substring test against a fixed word list, as one generated predicate."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def matched_terms(text: Column, terms) -> Column:
    """Array of the fixed terms found in ``text``, in list order."""
    return F.array_compact(F.array(*[F.when(text.contains(term), F.lit(term)) for term in terms]))


def instruction_like(text: Column) -> Column:
    from tidemark.functions.vocabulary import INSTRUCTION_PATTERNS

    found = F.lit(False)
    for pattern in INSTRUCTION_PATTERNS:
        found = found | text.rlike(pattern)
    return found


def number_text(value: Column) -> Column:
    """Shortest text of a number: whole numbers print without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def iso_millis(ts: Column | str) -> Column:
    """Canonical UTC text with milliseconds; the session time zone is UTC."""
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
