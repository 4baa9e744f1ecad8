"""Shared by the operators of this subpackage: written tables, word spans of Arrow text batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import SHUFFLE_CLEANUP, forget, stored  # noqa: F401  (the first two for those that import them here)

# The functions that tasks run travel with the tasks; executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules["tidemark.llm"])

#: A task works on slices of about this many text bytes (one longer text is a slice of its own), so its memory
#: does not depend on the batch size.
SLICE_BYTES = 4 << 20

#: Rows of one Arrow batch. Texts are long; ten thousand of them would be hundreds of megabytes.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later plans start there, and survive lost executors."""
    return stored(df, label, **options)


def as_text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for each byte inside one of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: [^\x20\x09-\x0D]; bytes of multi-byte UTF-8 characters are all 0x80 or more.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and everything outside ASCII.
LOWER_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: The same with A-Z, for texts that are lower-cased byte by byte.
ANY_CASE_WORD = LOWER_WORD | byte_class((0x41, 0x5A))
LETTER_BYTE = byte_class((0x61, 0x7A), (0x80, 0xFF))

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 32


def text_slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, used = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if used and used + size > most:
            yield batch.slice(start, row - start)
            start, used = row, 0
        used += size
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text at a time, over the bounds of batches."""
    held, used = [], 0
    for batch in batches:
        for part in text_slices(batch, text, most):
            # a row counts as well, so that empty texts are not held without end
            size = (pc.sum(pc.binary_length(part.column(text))).as_py() or 0) + 64 * part.num_rows
            if held and used + size > most:
                yield pa.concat_batches(held)
                held, used = [], 0
            held.append(part)
            used += size
    if held:
        yield pa.concat_batches(held)


class Words:
    """Maximal runs of bytes of a class in each text of a batch.

    ``data`` holds the bytes of all texts; word i is ``data[starts[i]:ends[i]]``; the words of text t are
    ``first[t]`` to ``first[t + 1] - 1``. A null text has no words. ``apart`` tells from two rows of neighbouring
    bytes between which of them a word ends as well.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool = False, apart: Callable | None = None):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n = len(texts)
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        bounds = np.zeros(1, np.int64) if n == 0 else np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        self.inside = table[raw]
        self.data = LOWER_ASCII[raw] if lower else raw
        begin, last = self.inside.copy(), self.inside.copy()
        begin[1:] &= ~self.inside[:-1]
        last[:-1] &= ~self.inside[1:]
        if apart is not None:
            cut = apart(raw[:-1], raw[1:]) & self.inside[:-1] & self.inside[1:]
            begin[1:] |= cut
            last[:-1] |= cut
        filled = bounds[1:] > bounds[:-1]
        edges = bounds[:-1][filled]
        begin[edges] = self.inside[edges]
        edges = bounds[1:][filled] - 1
        last[edges] = self.inside[edges]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def array(self, kind: pa.DataType | None = None) -> pa.Array:
        """All words, without what lies between them."""
        offsets = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return pa.Array.from_buffers(kind or pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[self.inside]))])

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, each followed by one blank: bytes, starts, ends."""
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes + 1) - 1
        out = np.full(int(sizes.sum()) + len(self), 0x20, np.uint8)
        place = np.ones(len(out), bool)
        place[ends] = False
        out[place] = self.data[self.inside]
        return out, ends - sizes, ends
