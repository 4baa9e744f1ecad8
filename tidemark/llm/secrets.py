"""Secret scans: fixed patterns, and candidate strings with windows of high Shannon entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.llm.common import as_text

# The patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"  # at least HEX_CHARS of them
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex")

#: Candidate strings: runs of the characters that keys are made of, long enough for a window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, in the order in which a candidate is tried: alphabet, and the bits per character from which
#: on a window counts as random. A window of 20 characters can reach log2(min(20, alphabet)) bits.
CLASSES = {"hex": ("0123456789abcdef", 3.0), "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.6), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9)}

#: Allow-list: what looks like a candidate and is known to be none.
ALLOWED = (
    r"^[A-Za-z]?[a-z]+$|^[A-Z]+$",  # a word, however long
    r"^[0-9]+$|^[0-9=_+/-]+$",  # numbers, dates, rules
    r"(?i)example|placeholder|changeme|your[_-]?|xxxx|dummy|sample|lorem|abcdefgh|01234567|12345678",
    r"^(.{1,4})\1+.{0,3}$",  # one short piece over and over
    r"^/?([a-z0-9_.=-]*[a-z][a-z0-9_.=-]*/)+[a-z0-9_.=-]*$",  # a path of plain names
    r"^[A-Za-z]+([_-][A-Za-z]+)+$",  # an identifier
)


def _positions(text: Column, pattern: str, kind: Column | str, keep) -> Column:
    """Spans of all matches, leftmost and non-overlapping: the lengths of matches and of the gaps between them add up
    to the starts. ``keep`` tells from a match's text and number whether it counts."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def spans(matches: Column, gaps: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            size = F.length(F.get(matches, at))
            start = state["upto"] + F.length(F.get(gaps, at))
            span = F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("stop"), kind.alias("kind"))
            return F.struct((start + size).cast("int").alias("upto"), F.when(keep(F.get(matches, at), at), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

        begin = F.struct(F.lit(0).alias("upto"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), begin, step, lambda state: state["out"])

    found = F.when(
        text.rlike(pattern),
        let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), lambda x: spans(x["m"], x["g"])),
    )
    return F.coalesce(found, F.array().cast(SPANS))


SPANS = "array<struct<start: int, stop: int, kind: string>>"


def first_random_window(word: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """(start, stop) of the stretch of windows with at least ``bits`` bits a character, from the first to the last;
    stop is 0 if there is none.

    The window slides by one character. Its counts change by one up and one down, and the sum of c log2 c with
    them: the entropy is log2(window) less that sum over the window's length.
    """
    size = len(alphabet)
    weights = F.lit([0.0, *(c * math.log2(c) for c in range(1, window + 1))]).cast("array<double>")
    least = (math.log2(window) - bits) * window + 1e-9

    def place(char: Column) -> Column:
        return F.call_function("locate", char, F.lit(alphabet)) - 1

    def step(state: Column, at: Column) -> Column:
        entering = place(F.substring(word, at, F.lit(1)))
        leaving = F.when(at > window, place(F.substring(word, at - window, F.lit(1)))).otherwise(F.lit(-1))

        def change(both: Column) -> Column:
            counts = state["counts"]
            c_in, c_out = F.get(counts, both["i"]), F.get(counts, both["o"])
            same = both["i"] == both["o"]
            gain = F.get(weights, c_in + 1) - F.get(weights, c_in)
            loss = F.when(both["o"] >= 0, F.get(weights, c_out) - F.get(weights, c_out - 1)).otherwise(F.lit(0.0))
            total = F.when(same, state["sum"]).otherwise(state["sum"] + gain - loss)
            moved = F.when(same, counts).otherwise(
                F.transform(counts, lambda c, k: c + (k == both["i"]).cast("int") - (k == both["o"]).cast("int"))
            )
            return let(F.struct(total.alias("total"), moved.alias("counts")), lambda x: _seen(state, x, at))

        return let(F.struct(entering.cast("int").alias("i"), leaving.cast("int").alias("o")), change)

    def _seen(state: Column, now: Column, at: Column) -> Column:
        random = (at >= window) & (now["total"] <= least)
        return F.struct(
            now["counts"].alias("counts"), now["total"].alias("sum"),
            F.when(random & (state["stop"] == 0), at - window).otherwise(state["start"]).cast("int").alias("start"),
            F.when(random, at).otherwise(state["stop"]).cast("int").alias("stop"),
        )

    begin = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), begin, step, lambda state: F.struct(state["start"].alias("start"), state["stop"].alias("stop")))


def allowed(word: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | word.rlike(pattern)
    return out


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Stretches of random characters in the candidate strings, of the first class whose alphabet holds the string."""

    def judged(span: Column) -> Column:
        def of(word: Column) -> Column:
            found = F.when(allowed(word), F.array().cast(SPANS))
            for name, (alphabet, bits) in CLASSES.items():
                inside = word.rlike(f"^[{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]+$")
                found = found.when(inside, let(first_random_window(word, alphabet, bits, window), lambda w, name=name: _shifted(span, w, name)))
            return found.otherwise(F.array().cast(SPANS))

        return let(F.substring(text, span["start"] + 1, span["stop"] - span["start"]), of)

    candidates = _positions(text, CANDIDATE, "candidate", lambda match, at: F.lit(True))
    return let(candidates, lambda spans: F.flatten(F.transform(spans, judged)))


def _shifted(span: Column, found: Column, name: str) -> Column:
    moved = F.struct((span["start"] + found["start"]).alias("start"), (span["start"] + found["stop"]).alias("stop"), F.lit(f"entropy-{name}").alias("kind"))
    return F.when(found["stop"] > 0, F.array(moved)).otherwise(F.array().cast(SPANS))


def span_list(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _by_place(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    # kinds that are not listed have rank 0 and go behind the listed ones
    order = F.transform(order, lambda s: F.struct(s["start"].alias("start"), F.when(s["rank"] > 0, s["rank"]).otherwise(99).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.array_sort(order)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, base, found): spans of the fixed patterns, and all spans, each (start, rank, kind, stop), sorted.

    Starts and stops count code points; a stop is exclusive. Base spans are never suppressed; an entropy span is
    added where none of the base spans of the text overlaps it and the allow-list does not know its candidate.

    Null and empty texts have no spans. Repeated rows are repeated, null ids kept. An empty table gives none.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), as_text(docs[text]).alias("text"))
    value = F.col("text")
    kept = {
        "assign": (ASSIGN, lambda match, at: F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_CHARS),
        "access": (ACCESS, lambda match, at: F.length(match) >= ACCESS_CHARS),
        # the same runs as HEX, without listing the short ones
        "hex": (f"[0-9a-f]{{{HEX_CHARS},}}", lambda match, at: F.lit(True)),
    }
    spans = rows.select("doc_id", *[_positions(value, pattern, kind, keep).alias(kind) for kind, (pattern, keep) in kept.items()], entropy_spans(value, window).alias("random"))
    base = _by_place(F.concat(*KINDS))
    rest = F.filter("random", lambda r: ~F.exists(F.concat(*KINDS), lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    return spans.select("doc_id", *KINDS, base.alias("base"), _by_place(F.concat(*KINDS, rest)).alias("found"))
