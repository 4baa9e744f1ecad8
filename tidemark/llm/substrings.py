"""Substring dedup by relative Lempel-Ziv parsing over an index of all reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_BLANK, Words, as_text, small_batches, text_slices, written

WINDOW = 35
#: Words of an anchor; each window holds WINDOW - ANCHOR + 1 of them and belongs to the least.
ANCHOR = 6

#: An odd multiplier has an inverse modulo 2^64, so that a run's hash follows from two prefix sums.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Runs:
    """Hashes of runs of consecutive words in a batch of texts, in constant time each."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, NOT_BLANK)
        named = self.words.array().dictionary_encode()
        digest = xxhash.xxh64_intdigest
        known = np.fromiter((digest(x) for x in named.dictionary.to_pylist()), np.uint64, len(named.dictionary))
        each = known[named.indices.to_numpy()] if len(self.words) else np.zeros(0, np.uint64)
        self.sums = np.zeros(len(each) + 1, np.uint64)
        np.cumsum(each * _powers(_STEP, len(each)), out=self.sums[1:])
        self.back = _powers(_BACK, len(each) + 1)

    def hashes(self, starts: np.ndarray, sizes) -> np.ndarray:
        return _mix((self.sums[starts + sizes] - self.sums[starts]) * self.back[starts])


def phrases(runs: Runs, window: int, anchor: int) -> dict[str, np.ndarray]:
    """The parse into phrases: each window of a text belongs to the anchor in it with the least hash (of equals
    the first), and the consecutive windows of one anchor are a phrase.

    The cut depends on the window's words alone, so equal windows lie in phrases of equal anchors, at the same
    place. a and b are the first and last window, counted in words from the text's beginning.
    """
    first, counts = runs.words.first, runs.words.counts
    total = len(runs.words)
    span = window - anchor + 1
    if total < window:
        empty = np.zeros(0, np.int64)
        return {"text": empty, "a": empty, "b": empty, "anchor": empty.astype(np.uint64), "phrase": empty.astype(np.uint64)}
    at = np.arange(total - anchor + 1)
    hashes = runs.hashes(at, anchor)
    # upper half: the hash; lower half: the place, so that the least of equals is the first
    half = np.uint64(32)
    least = (hashes >> half << half) | at.astype(np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + window <= first[1:][text])
    place, text = place[inside], text[inside]
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return {"text": empty, "a": empty, "b": empty, "anchor": empty.astype(np.uint64), "phrase": empty.astype(np.uint64)}
    cuts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    low = inside[cuts]
    high = inside[np.concatenate([cuts[1:], [len(inside)]]) - 1]
    owner = text[cuts]
    return {
        "text": owner, "a": low - first[owner], "b": high - first[owner],
        "anchor": hashes[place[cuts]], "phrase": runs.hashes(low, high - low + window),
    }


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _phrase_batches(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = phrases(Runs(part.column("text")), window, anchor)
                keys = part.select(["k1", "k2"]).take(pa.array(found["text"]))
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, pa.array(found["a"], pa.int32()), pa.array(found["b"], pa.int32()), _signed(found["anchor"]), _signed(found["phrase"])],
                    names=["k1", "k2", "a", "b", "anchor", "phrase"],
                )

    return run


def _edge_batches(window: int):
    """The single windows of phrases whose anchor is shared and whose rest is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                runs = Runs(part.column("text"))
                edges = part.column("edges")
                owner = np.repeat(np.arange(len(part)), np.diff(edges.offsets.to_numpy()))
                rows = edges.flatten()
                a, b, anchor = (rows.field(x).to_numpy() for x in ("a", "b", "anchor"))
                lone = rows.field("lone").to_numpy(zero_copy_only=False)
                sizes = b - a + 1
                starts = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - a, sizes)
                owner, anchor, lone = (np.repeat(x, sizes) for x in (owner, anchor, lone))
                hashes = runs.hashes(starts + runs.words.first[owner], window)
                keys = part.select(["k1", "k2"]).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, pa.array(starts, pa.int32()), pa.array(anchor, pa.int64()), _signed(hashes), pa.array(lone, pa.bool_())],
                        names=["k1", "k2", "a", "anchor", "window", "lone"],
                )

    return run


def greedy_factors(row: np.ndarray, a: np.ndarray, b: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left to right in each text, a matched stretch grows as long as the next one follows on, in the text and in the
    same reference; one that does not begins a factor. Takes spans sorted by text and place; returns each factor's
    first and last span."""
    shift = ref - a
    onward = (row[1:] == row[:-1]) & (a[1:] <= b[:-1] + 1) & (shift[1:] == shift[:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~onward])) if len(row) else np.zeros(0, np.int64)
    return begins, np.concatenate([begins[1:], [len(row)]]).astype(np.int64) - 1 if len(row) else begins


def _removal_batches(window: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), NOT_BLANK)
                spans = part.column("spans")
                counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy().astype(np.int64)
                flat = spans.flatten()
                a, b, ref = (flat.field(x).to_numpy().astype(np.int64) for x in ("a", "b", "ref"))
                row = np.repeat(np.arange(len(part)), counts)
                order = np.lexsort((a, row))
                row, a, b, ref = row[order], a[order], b[order], ref[order]
                low, high = greedy_factors(row, a, b, ref)
                owner, start, size = row[low], a[low], b[high] - a[low] + window
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, words.first[owner] + start, 1)
                np.add.at(gone, words.first[owner] + start + size, -1)
                keep = np.cumsum(gone[:-1]) == 0
                joined, begins, ends = words.joined()
                sizes = ends - begins + 1
                kept = joined[np.repeat(keep, sizes)].tobytes()
                upto = np.concatenate([[0], np.cumsum(np.where(keep, sizes, 0))])[words.first]
                texts = [kept[x : max(x, y - 1)] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[words.first])
                columns = [part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                if whole:
                    factors = pa.StructArray.from_arrays(
                        [pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(ref[low] >> PLACE_BITS), pa.array(ref[low] & ((1 << PLACE_BITS) - 1), pa.int32())],
                        names=["start", "size", "ref_text", "ref_start"],
                    )
                    cuts = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                    columns += [pa.array([x.decode() for x in texts], pa.string()), pa.ListArray.from_arrays(pa.array(cuts), factors)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"][: len(columns)])

    return run


REMOVAL = "doc_id long, n_words long, n_removed long, kept_sha256 string"
WHOLE = ", kept_text string, factors array<struct<start: int, size: int, ref_text: long, ref_start: int>>"

#: A reference in one long: the upper bits of its text's key, and the word at which it starts.
PLACE_BITS = 26


def _reference() -> Column:
    return F.shiftleft(F.shiftright("k1", PLACE_BITS), PLACE_BITS).bitwiseOR(F.col("a").cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text: copies share their parse."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("k2")]


def duplicate_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, a, b, ref): windows a to b of a text occur elsewhere too, the first of them at the reference.

    The index holds each phrase of each reference block (the whole input, in blocks as the tasks read it), keyed
    by its anchor. A phrase found twice matches whole. A phrase whose anchor is known and which differs is where a
    match ends: its windows are checked one by one against those of the other phrases of that anchor.

    Counts are combined before each exchange; what they are joined to is a written table, so that Spark can split a
    very common passage over tasks.
    """
    index = written(texts.mapInArrow(_phrase_batches(window, anchor), "k1 long, k2 long, a int, b int, anchor long, phrase long"), "phrases")
    anchors = index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high"), F.min(_reference()).alias("ref"))
    anchors = written(anchors.where("n > 1").select("anchor", F.when(F.col("low") == F.col("high"), F.col("ref")).alias("ref")), "anchors")
    shared = written(index.join(anchors, "anchor"), "shared")
    alike = shared.where("ref is not null").select("k1", "k2", "a", "b", "ref")

    # anchors with different phrases
    rest = shared.where("ref is null").drop("ref")
    counted = written(rest.groupBy("anchor", "phrase").agg(F.count("*").alias("n"), F.min(_reference()).alias("ref")), "counted")
    rest = written(rest.join(counted, ["anchor", "phrase"]), "matched")
    whole = rest.where("n > 1").select("k1", "k2", "a", "b", "ref")

    # where matches end; of equal phrases one stands for all
    ends = rest.where((F.col("n") == 1) | (F.col("ref") == _reference()))
    ends = written(ends.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b", "anchor", (F.col("n") == 1).alias("lone"))).alias("edges")), "ends")
    windows = written(texts.join(ends, ["k1", "k2"]).mapInArrow(_edge_batches(window), "k1 long, k2 long, a int, anchor long, window long, lone boolean"), "windows")
    # copies of a text are one place
    place = F.xxhash64("k1", "k2", "a")
    twice = windows.groupBy("anchor", "window").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.min(_reference()).alias("ref"))
    twice = written(twice.where("one <> other").select("anchor", "window", "ref"), "twice")
    # phrases found twice match whole: their windows are in the index of ends, not among the spans, which never overlap
    edge = windows.where("lone").join(twice, ["anchor", "window"]).select("k1", "k2", "a", F.col("a").alias("b"), "ref")
    return alike.unionByName(whole).unionByName(edge)


def remove_duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, whole: bool = True) -> DataFrame:
    """Texts without the words that a window of ``window`` words covers whose sequence starts anywhere else too.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one blank); with ``whole`` also
    kept_text, and factors: the parse against the index, as start and size in words and one place of the reference.

    Null, empty and blank texts, and texts of fewer words than the window, lose nothing. Repeated rows repeat each
    other's windows, whatever their doc_id, and lose them all. Rows keep a null doc_id. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    content = as_text(docs[text])
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), content.alias("text"), *_text_keys(content))
    spans = duplicate_spans(texts.select("k1", "k2", "text"), window, anchor)
    spans = written(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b", "ref")).alias("spans")), "spans")
    joined = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removal_batches(window, whole), REMOVAL + WHOLE * whole)
