"""Language ID: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LETTER_BYTE, Words, as_text, small_batches, text_slices, written

#: A model is fitted on about this many labelled documents of each language, chosen by a hash of their id.
ROWS_PER_LANGUAGE = 2_000
#: Its vocabularies hold the most frequent entries of each language, so that no language takes another's places.
MOST_WORDS = 60_000
MOST_GRAMS = 60_000
LONGEST = 5
UNKNOWN = "und"


@dataclass
class Model:
    """``words`` and ``grams`` map bytes to rows of log frequencies, one column for each of ``languages``."""

    languages: list[str]
    words: list[bytes]
    word_scores: np.ndarray
    grams: dict[bytes, int]
    gram_scores: np.ndarray
    prior: np.ndarray


def lower_words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), LETTER_BYTE)


def grams_of(word: bytes, longest: int = LONGEST) -> list[bytes]:
    """All n-grams of a word between its bounds, in characters, up to the longest."""
    chars = f"<{word.decode(errors='replace')}>"
    return [chars[i : i + n].encode() for n in range(1, longest + 1) for i in range(len(chars) - n + 1)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch: kind 0 for words, 1 for n-grams."""
    for batch in batches:
        for part in text_slices(batch):
            for lang in pc.unique(part.column("lang")).to_pylist():
                texts = part.filter(pc.equal(part.column("lang"), lang)).column("text")
                found = lower_words(texts).array().value_counts()
                words, counts = found.field("values").to_pylist(), found.field("counts").to_pylist()
                grams: Counter = Counter()
                for word, count in zip(words, counts, strict=True):
                    for gram in grams_of(word):
                        grams[gram] += count
                n = len(words) + len(grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([0] * len(words) + [1] * len(grams), pa.int32()), pa.array([*words, *grams], pa.binary()), pa.array([*counts, *grams.values()], pa.int64())],
                    names=["lang", "kind", "entry", "n"],
                )


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE,
        most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """A model of about ``rows_per_language`` whole documents of each language; rows with a null language or text
    are not learned from. Its size is bounded by the two vocabularies of each language, whatever the input."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"), F.pmod(F.xxhash64(docs[doc_id]), F.lit(1 << 30)).alias("chance")).where("text is not null and lang is not null")
    # one number for each language; no task gathers a language's rows
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, int((1 << 30) * min(1.0, rows_per_language / n))).otherwise(share)
    sample = rows.where(F.col("chance") < share).select("lang", "text")
    counts = written(sample.mapInArrow(_count_batches, "lang string, kind int, entry binary, n long").groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n")), "counts")
    languages = sorted(sizes)
    each = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)) for name in languages]
    entries = counts.groupBy("kind", "entry").agg(F.array(*each).cast("array<long>").alias("by_lang"))

    def top(kind: int, most: int) -> tuple[list[bytes], np.ndarray]:
        """The most frequent entries of each language with their smoothed log frequencies; arrays, as many as the vocabulary has entries."""
        own = [counts.where((F.col("kind") == kind) & (F.col("lang") == name)).orderBy(F.desc("n"), "entry").limit(most).select("entry") for name in languages]
        if not own:
            return [], np.zeros((0, 0), np.float32)
        listed = written(reduce(DataFrame.unionAll, own).distinct(), "listed")
        found = entries.where(F.col("kind") == kind).join(listed, "entry", "left_semi").select("entry", "by_lang").toArrow()
        table = found["by_lang"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(found.num_rows, len(languages))
        return found["entry"].to_pylist(), np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * (found.num_rows + 1))).astype(np.float32)

    words, word_scores = top(0, most_words)
    grams, gram_scores = top(1, most_grams)
    return Model(languages, words, word_scores, {gram: k for k, gram in enumerate(grams)}, gram_scores, np.full(len(languages), -math.log(len(languages) or 1)))


def backoff_score(word: bytes, grams: dict[bytes, int], scores: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Sum over a cover of the word from left to right: at each place the longest n-gram known, else one character
    less and so on; a character that is no n-gram says nothing."""
    chars = f"<{word.decode(errors='replace')}>"
    total, at = np.zeros(scores.shape[1]), 0
    while at < len(chars):
        for n in range(min(longest, len(chars) - at), 0, -1):
            row = grams.get(chars[at : at + n].encode())
            if row is not None:
                total = total + scores[row]
                break
        at += n
    return total


def score_slice(texts: pa.Array, model: Model, vocabulary: pa.Array) -> tuple[list[str], list[float]]:
    """Language and posterior of each text; texts without words get no language here."""
    words = lower_words(texts)
    named = words.array().dictionary_encode()
    known = pc.index_in(named.dictionary, value_set=vocabulary)
    table = np.zeros((len(known), len(model.languages)))
    seen = known.is_valid().to_numpy(zero_copy_only=False)
    table[seen] = model.word_scores[known.drop_null().to_numpy()]
    for row in np.flatnonzero(~seen).tolist():
        table[row] = backoff_score(named.dictionary[row].as_py(), model.grams, model.gram_scores)
    sums = np.zeros((len(texts), len(model.languages)))
    filled = np.flatnonzero(words.counts)
    if len(filled):
        sums[filled] = np.add.reduceat(table[named.indices.to_numpy()], words.first[:-1][filled], axis=0)
    sums += model.prior
    best = sums.argmax(axis=1)
    posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[x] for x in best], posterior.tolist()


def predictor(spark: SparkSession, model: Model):
    """A column function: struct(lang, score) of a text. ``und`` with score 0 if the text is null, has no letter, or
    nothing was learned."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.words, model.word_scores, model.grams, model.gram_scores, model.prior))

    @F.arrow_udf("lang string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        vocabulary = pa.array(own.words, pa.binary())
        for array in texts:
            langs, scores = [], []
            for part in text_slices(pa.RecordBatch.from_arrays([array], names=["text"])):
                a, b = score_slice(part.column("text"), own, vocabulary)
                langs += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    def column(text: Column) -> Column:
        readable = as_text(text).rlike(r"\p{L}") & F.lit(bool(model.languages))
        if not model.languages:
            return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        found = predict(F.when(readable, text))
        return F.when(readable, found).otherwise(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))

    return column


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by id, is never learned from; a null id counts as an empty text."""
    return F.crc32(as_text(doc_id.cast("string")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **bounds: int) -> DataFrame:
    """All columns, and held_out, lang_pred, score: learned from the documents not held out, predicted for all.

    Prediction reads the text alone. Null texts and texts without a letter are ``und`` with score 0, also all texts
    if no row has a language. Of equally likely languages the first by name is taken. Repeated rows are repeated.
    Columns named like the new ones are replaced.
    """
    learned = docs.where(~held_out(docs[doc_id]))
    predict = predictor(docs.sparkSession, fit(learned, text, lang, doc_id, **bounds))
    found = docs.withColumn("held_out", held_out(docs[doc_id])).withColumn("__language", predict(docs[text]))
    return found.withColumns({"lang_pred": F.col("__language.lang"), "score": F.col("__language.score")}).drop("__language")
