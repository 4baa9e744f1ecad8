"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ANY_CASE_WORD, Words, small_batches, text_slices, written

WINDOW = 13
#: Test words of one pass; a larger test set takes more passes, each with its own index and broadcast.
PASS_WORDS = 1_000_000
INDEX_BYTES = 8 << 20

INDEX = "block string, doc_ids array<long>, n_words array<int>, terms array<int>, cuts array<int>, docs array<int>, places array<int>"
MATCH = "block string, doc int, doc_id long, item int, item_start int, doc_start int, size int"


class Items:
    """The test items of one pass as numbered terms: the vocabulary, and each item's number with its terms in order."""

    def __init__(self, vocabulary: list[bytes], items: list[tuple[int, np.ndarray]], window: int):
        self.vocabulary, self.items, self.window = vocabulary, items, window

    @classmethod
    def of(cls, texts: list[str], window: int) -> Items:
        words = Words(pa.array(texts, pa.string()), ANY_CASE_WORD, lower=True)
        named = words.array().dictionary_encode()
        terms, first = named.indices.to_numpy(), words.first.tolist()
        return cls(named.dictionary.to_pylist(), [(k, terms[a:b]) for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b > a], window)

    @property
    def plain(self) -> tuple:
        """What is broadcast: no class of this package."""
        return self.vocabulary, self.items, self.window

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item number, first word and terms of each window of ``size`` words; an item is cut at the window's length."""
        owner, start, rows = [], [], []
        for number, terms in self.items:
            if min(len(terms), self.window) == size:
                for at in range(len(terms) - size + 1):
                    owner.append(number)
                    start.append(at)
                    rows.append(terms[at : at + size])
        return np.array(owner, np.int32), np.array(start, np.int32), np.array(rows, np.int64).reshape(len(rows), size)

    @property
    def sizes(self) -> list[int]:
        return sorted({min(len(terms), self.window) for _, terms in self.items})


def _index_batches(test) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary = pa.array(test.value[0], pa.binary())
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_slices(batch, most=INDEX_BYTES):
                words = Words(part.column("text"), ANY_CASE_WORD, lower=True)
                found = pc.index_in(words.array(), value_set=vocabulary)
                at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                terms = found.drop_null().to_numpy().astype(np.int32)
                doc = np.searchsorted(words.first, at, side="right") - 1
                place = at - words.first[doc]
                order = np.argsort(terms, kind="stable")  # postings of a term stay in document and word order
                terms = terms[order]
                cuts = np.concatenate([np.flatnonzero(np.diff(terms, prepend=-1)), [len(terms)]])
                row = {
                    "block": f"{task}-{number}", "doc_ids": part.column("doc_id").to_pylist(), "n_words": words.counts.astype(np.int32), "terms": terms[cuts[:-1]],
                    "cuts": cuts.astype(np.int32), "docs": doc[order].astype(np.int32), "places": place[order].astype(np.int32),
                }
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([row["doc_ids"]], pa.list_(pa.int64())), *(_one(row[x]) for x in ("n_words", "terms", "cuts", "docs", "places"))], names=list(row),
                )

    return run


def _one(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int32()))


def build_index(docs: DataFrame, test, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (document of the block, word place) of the test set's terms, sorted by term, in blocks of whole documents.

    One row is one block of about INDEX_BYTES of text, so a document's postings lie together and lists are
    intersected where they are. ``docs`` without any word of the test set still appear with their number of words.
    """
    small_batches(docs.sparkSession)
    needed = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return written(needed.mapInArrow(_index_batches(test), INDEX), "postings", **{"parquet.block.size": str(32 << 20)})


def term_counts(index: DataFrame, terms: int) -> np.ndarray:
    """Postings of each test term over all documents; as many numbers as the pass has terms."""
    each = index.select(F.explode(F.arrays_zip("terms", F.slice("cuts", 2, F.greatest(F.size("terms"), F.lit(1))).alias("stop"), F.col("cuts").alias("start"))).alias("x"))
    each = each.where("x.terms is not null").groupBy("x.terms").agg(F.sum(F.col("x.stop") - F.col("x.start")).alias("n"))
    counts = np.zeros(terms, np.int64)
    for row in each.toLocalIterator():
        counts[row["terms"]] = row["n"]
    return counts


class Block:
    """One index row: sorted keys (document * 2^32 + place) of each term."""

    def __init__(self, row: dict, terms: int):
        present = row["terms"]
        self.low, self.high = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        self.low[present], self.high[present] = row["cuts"][:-1], row["cuts"][1:]
        self.keys = (row["docs"].astype(np.int64) << 32) + row["places"]

    @property
    def counts(self) -> np.ndarray:
        return self.high - self.low

    def list(self, term: int) -> np.ndarray:
        return self.keys[self.low[term] : self.high[term]]


def _contains(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == wanted


def _phrase_finder(test: Items, counts: np.ndarray) -> Callable:
    """Starts of each window: the rarest term's list, moved by its offset, is intersected with the next rarest's."""
    tables = []
    for size in test.sizes:
        owner, start, terms = test.windows(size)
        tables.append((size, owner, start, terms, np.argsort(counts[terms], axis=1, kind="stable")))

    def find(block: Block) -> Iterator[tuple]:
        here = block.counts
        for size, owner, start, terms, order in tables:
            for row in np.flatnonzero((here[terms] > 0).all(axis=1)).tolist():
                window, ranked = terms[row], order[row]
                keys = block.list(window[ranked[0]]) - ranked[0]
                for offset in ranked[1:]:
                    keys = keys[_contains(block.list(window[offset]), keys + offset)]
                    if not len(keys):
                        break
                if len(keys):
                    yield keys >> 32, int(owner[row]), int(start[row]), keys & 0xFFFFFFFF, size

    return find


def _proximity_finder(test: Items, counts: np.ndarray, rarest: int, span: int) -> Callable:
    """Places of a window's rarest term with the next rarest ``rarest - 1`` distinct terms within ``span`` words."""
    wanted = []
    for size in test.sizes:
        owner, start, terms = test.windows(size)
        for number, at, row in zip(owner.tolist(), start.tolist(), terms, strict=True):
            distinct = sorted(set(row.tolist()), key=lambda t: (counts[t], t))[:rarest]
            wanted.append((number, at, distinct))

    def find(block: Block) -> Iterator[tuple]:
        here = block.counts
        for number, at, distinct in wanted:
            if not all(here[t] for t in distinct):
                continue
            keys = block.list(distinct[0])
            for term in distinct[1:]:
                other = block.list(term)
                low = np.searchsorted(other, np.maximum(keys - span, keys >> 32 << 32))
                low[low == len(other)] = 0
                near = np.abs(other[low] - keys) <= span
                near &= other[low] >> 32 == keys >> 32
                keys = keys[near]
                if not len(keys):
                    break
            if len(keys):
                yield keys >> 32, number, at, keys & 0xFFFFFFFF, 1

    return find


def _match_batches(test, counts: np.ndarray, finder: Callable, *options: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(Items(*test.value), counts, *options)
        for batch in batches:
            for number in range(batch.num_rows):
                row = {x: batch.column(x)[number].values.to_numpy(zero_copy_only=False) for x in ("terms", "cuts", "docs", "places")}
                found = list(find(Block(row, len(counts))))
                if not found:
                    continue
                docs = np.concatenate([x[0] for x in found])
                sizes = [len(x[0]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[number].as_py()] * len(docs), pa.string()), pa.array(docs, pa.int32()), batch.column("doc_ids")[number].values.take(pa.array(docs)),
                     *(pa.array(np.repeat([x[k] for x in found], sizes), pa.int32()) for k in (1, 2)),
                     pa.array(np.concatenate([x[3] for x in found]), pa.int32()), pa.array(np.repeat([x[4] for x in found], sizes), pa.int32())],
                    names=["block", "doc", "doc_id", "item", "item_start", "doc_start", "size"],
                )

    return run


def distinct_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, text), each pair once; a null id counts as an empty one, a null text has no words."""
    items = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("")).alias("item_id"), benchmark[text].alias("text")).where("text is not null").distinct()
    return written(items, "items")


def _weight(chars):
    """No text has more words than this."""
    return chars / 2 + 1


def _passes(items: DataFrame, window: int, pass_words: int) -> Iterator[tuple[Items, dict[int, str]]]:
    """The test set in passes of bounded size, read one after the other."""
    texts, ids, used = [], [], 0
    for row in items.toLocalIterator():
        texts.append(row["text"])
        ids.append(row["item_id"])
        used += _weight(len(row["text"]))
        if used >= pass_words:
            yield Items.of(texts, window), dict(enumerate(ids))
            texts, ids, used = [], [], 0
    if texts:
        yield Items.of(texts, window), dict(enumerate(ids))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW,
            proximity: tuple[int, int] | None = None, pass_words: int = PASS_WORDS) -> tuple[DataFrame, DataFrame]:
    """All places where a window of a test item occurs in a document, and the index of all documents.

    Exact phrases: (block, doc, doc_id, item_id, item_start, doc_start, size), one row for each occurrence of
    each window of ``window`` consecutive item words (all words of a shorter item). With ``proximity`` (rarest,
    span): one row for each place of the window's rarest term that has its next rarest distinct terms, ``rarest``
    in all, within ``span`` words in the same document.
    """
    spark = docs.sparkSession
    items = distinct_items(benchmark, item_id, text)
    found, index = [], None
    if (items.agg(F.sum(_weight(F.length("text")))).first()[0] or 0) >= pass_words:
        # more than one pass: all of them read the same files, so that they cut the same blocks
        docs = written(docs.select(doc_id, text), "documents")
    for test, names in _passes(items, window, pass_words):
        shared = spark.sparkContext.broadcast(test.plain)
        postings = build_index(docs, shared, doc_id, text)
        index = index or postings
        counts = term_counts(postings, len(test.vocabulary))
        finder, options = (_phrase_finder, ()) if proximity is None else (_proximity_finder, proximity)
        rows = postings.mapInArrow(_match_batches(shared, counts, finder, *options), MATCH)
        ids = spark.createDataFrame([(int(k), v) for k, v in names.items()], "item int, item_id string")
        rows = rows.join(ids, "item")  # as many ids as a pass has items
        found.append(written(rows.select("block", "doc", "doc_id", "item_id", "item_start", "doc_start", "size"), "matches"))
    if index is None:
        index = build_index(docs, spark.sparkContext.broadcast(Items.of([], window).plain), doc_id, text)
        found = [spark.createDataFrame([], "block string, doc int, doc_id long, item_id string, item_start int, doc_start int, size int")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, index


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW, share: int = 20,
                  pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated) for each row of ``docs``.

    A document word inside any occurrence of a window is hit; a document is contaminated if at least one word in
    ``share`` is. Words are runs of digits, a-z and characters outside ASCII, after lower-casing A-Z.

    Null, empty and wordless texts have no words and are clean; null or wordless items match nothing; a null
    item_id counts as an empty one; repeated items and rows change nothing, repeated documents are repeated.
    Empty tables give an empty result, or all documents clean.
    """
    hits, index = matches(docs, benchmark, doc_id, text, item_id, window, pass_words=pass_words)
    spans = hits.groupBy("block", "doc", "doc_start").agg(F.max("size").alias("size")).groupBy("block", "doc").agg(F.collect_list(F.struct("doc_start", "size")).alias("spans"))
    covered = F.transform("spans", lambda x: F.sequence(x["doc_start"], x["doc_start"] + x["size"] - 1))
    spans = spans.select("block", "doc", F.size(F.array_distinct(F.flatten(covered))).cast("long").alias("n_hit"))
    items = hits.select("block", "doc", "item_id").distinct().groupBy("block", "doc").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    all_docs = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "x")).select("block", "doc", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").cast("long").alias("n_words"))
    out = all_docs.join(spans, ["block", "doc"], "left").join(items, ["block", "doc"], "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
