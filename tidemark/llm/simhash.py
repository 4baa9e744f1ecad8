"""SimHash near-duplicates: fingerprints, and links by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_BLANK, Words, small_batches, text_slices, written
from tidemark.llm.components import smallest_reachable

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
#: Cut into this many segments, four differing bits leave one segment with at most one of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of one bucket that a single run compares; larger buckets are compared block against block.
BLOCK = 1024
#: Fingerprints whose signatures, 67 each, one task makes and counts.
TASK_PRINTS = 8192


def fingerprint_slice(texts: pa.Array, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """One 64-bit fingerprint a text: a bit is 1 if it is set in over half the shingle hashes; no words give zero."""
    words = Words(texts, NOT_BLANK, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if not len(words):
        return out
    joined, starts, ends = words.joined()
    counts, first = words.counts, words.first[:-1]
    grams = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    total = int(grams.sum())
    group = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(grams, out=group[1:])
    at = np.arange(total) - np.repeat(group[:-1] - first, grams)
    last = np.minimum(at + shingle - 1, np.repeat(words.first[1:] - 1, grams))
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, total)
    filled = np.flatnonzero(grams)
    cuts = group[:-1][filled]
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), cuts)
        out[filled] |= (2 * ones > grams[filled]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprint_batches(shingle: int, carried: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                prints = fingerprint_slice(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints), *(part.column(x) for x in carried)], names=["doc_id", "print", *carried])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long, one row for each row of the input; and ``carried`` long columns."""
    small_batches(docs.sparkSession)
    needed = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), *carried)
    return needed.mapInArrow(_fingerprint_batches(shingle, carried), ", ".join(f"{x} long" for x in ("doc_id", "print", *carried)))


def signatures(prints: DataFrame) -> DataFrame:
    """(segment, bit, value, side, print): a segment's value as it is (bit -1), and with each bit left out in turn.

    Prints that agree in a segment meet under bit -1. Prints that differ there in one bit meet under that bit,
    one with side 0 and one with side 1; equal segments are not compared there again.
    """
    rows = []
    for number, (low, width) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << width) - 1))
        rows.append(F.array(_signature(number, F.lit(-1), part, F.lit(0))))
        rows.append(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), _left_out(number, part)))
    return prints.select("print", F.inline(F.flatten(F.array(*rows)))).select(_key().alias("key"), "side", "print")


def _signature(number: int, bit: Column, value: Column, side: Column) -> Column:
    return F.struct(F.lit(number).alias("segment"), bit.alias("bit"), value.alias("value"), side.alias("side"))


def _left_out(number: int, part: Column):
    def signature(bit: Column) -> Column:
        mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        side = F.call_function("shiftright", part, bit).bitwiseAND(F.lit(1)).cast("int")
        return _signature(number, bit, part.bitwiseAND(mask), side)

    return signature


def _key() -> Column:
    """Segment, bit and value in one long: 2, 5 and 22 bits."""
    return (F.col("segment") * (1 << 27)).cast("long") + (F.col("bit") + 1).cast("long") * (1 << 22) + F.col("value")


def _popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def spanning_links(prints: np.ndarray, sides: np.ndarray, wild: bool, most: int) -> list[tuple[int, int]]:
    """Links that connect what the close pairs of a bucket connect: one fewer than members in each component.

    With ``wild`` only members of different sides are compared.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(prints))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _popcount(prints[left] ^ prints[at]) <= most
            if wild:
                near &= sides[left] != sides[at]
            found = left[near]
            if len(found):
                links.extend((at, int(x)) for x in found)
                queue.extend(found.tolist())
                left = left[~near]
    return links


def _bucket_links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by (key, one, two); a run of equal keys may go on in the next batch."""
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            keys, one, two = (table.column(x).to_numpy() for x in ("key", "one", "two"))
            prints, sides = table.column("print").to_numpy().view(np.uint64), table.column("side").to_numpy()
            change = (np.diff(keys) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys)]])
            a, b = [], []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if high - low > 1:
                    wild = bool((keys[low] >> 22) & 31)
                    for i, j in spanning_links(prints[low:high], sides[low:high], wild, most):
                        a.append(low + i)
                        b.append(low + j)
            ends = prints.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[a], pa.int64()), pa.array(ends[b], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 65_536:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(x)[table.num_rows - 1].as_py() for x in ("key", "one", "two")]
            same = np.ones(table.num_rows, bool)
            for name, value in zip(("key", "one", "two"), last, strict=True):
                same &= table.column(name).to_numpy() == value
            whole = int(np.argmax(same))  # rows before the run that may go on
            if whole:
                yield work(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def links(prints: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct prints that connect all those with at most ``most`` differing bits.

    ``prints`` is a written table of distinct prints. Buckets of one are dropped by a count, buckets of two are
    decided where they are counted. Only larger ones are gathered; one with more than ``block`` members is dealt
    to the pairs of its blocks, so no task holds more than two blocks of it, whatever its size.
    """
    keyed = signatures(prints.repartition(1 + prints.count() // TASK_PRINTS, "print"))
    buckets = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b"), F.min("side").alias("low"), F.max("side").alias("high"),
    ).where("n > 1 and (low < high or (shiftright(key, 22) & 31) = 0)")
    buckets = written(buckets, "buckets")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")

    many = buckets.where("n > 2").select("key", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # Spark sizes the signatures like the prints that they are made of, and would broadcast all of them
    members = keyed.hint("merge").join(many, "key").select(
        "key", "side", "print", blocks.alias("blocks"), F.pmod(F.xxhash64("print"), blocks).cast("int").alias("own"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # a block meets itself only in a bucket of one block; elsewhere it meets itself inside each of its pairs
    members = members.withColumn("other", other).where("blocks = 1 or own <> other")
    members = members.select(
        "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "side", "print",
    )
    dealt = members.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "print")
    found = dealt.mapInArrow(_bucket_links(most), "a long, b long")
    return pairs.unionByName(found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, print, component_id): documents whose fingerprints are linked share the smallest doc_id reachable.

    Deletion variants: a fingerprint is cut into three segments; of two fingerprints with at most four differing
    bits one segment differs by at most one bit, so both share that segment's value with this bit left out. Those
    values are equality-joined and verified by the number of differing bits.

    Null or empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows
    give repeated rows. A null doc_id is never a component's id unless the component has no other. An empty table
    gives an empty table.
    """
    if most > 2 * len(SEGMENTS) - 1:
        raise ValueError(f"{len(SEGMENTS)} segments find at most {2 * len(SEGMENTS) - 1} differing bits")
    prints = written(fingerprints(docs, doc_id, text, shingle), "prints")
    # texts of one fingerprint are one node; the smallest id is found before the shuffle
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("smallest")), "nodes")
    edges = links(nodes.select("print"), most)
    reach = smallest_reachable(edges, nodes.select(F.col("print").alias("node"), "smallest"))
    reach = written(reach.select(F.col("node").alias("print"), F.col("smallest").alias("component_id")), "reach")
    return prints.join(reach, "print").select("doc_id", "print", "component_id")
