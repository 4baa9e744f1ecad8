"""Vectors as short codes: product codebooks refined over a lexicographic trie of the distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Leaves of the trie that are walked at a time. A task keeps one path's distances between two such stretches.
STRETCH = 8192


class TrieWalk:
    """A depth-first walk over the trie of lexicographically sorted parts, in stretches of leaves.

    A node's distance vector, to each entry over the dimensions down to it, is its parent's plus one dimension's; it
    is computed once for all parts below the node. ``path`` keeps the vectors of the last leaf's path, so that the
    next stretch goes on from the prefix that it shares with it.
    """

    def __init__(self, codebook: np.ndarray):
        self.codebook = codebook
        self.last: np.ndarray | None = None
        self.path = np.zeros((codebook.shape[1] + 1, len(codebook)), np.int64)

    def __call__(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each leaf (of equals the first), and its distance."""
        width = leaves.shape[1]
        before = np.concatenate([leaves[:1] if self.last is None else self.last[None], leaves[:-1]])
        # dimensions shared with the leaf before; new nodes begin below them
        shared = np.cumprod(before == leaves, axis=1).sum(axis=1)
        if self.last is None:
            shared[0] = 0
        above, parent = self.path[:1], np.zeros(len(leaves), np.int64)
        for depth in range(width):
            new = np.flatnonzero(shared <= depth)
            step = leaves[new, depth, None] - self.codebook[None, :, depth]
            vectors = np.concatenate([self.path[depth + 1][None], above[parent[new]] + step * step])
            node = np.cumsum(shared <= depth)  # 0: the path that the last stretch ended in
            self.path[depth] = above[parent[-1]]
            above, parent = vectors, node
        self.path[width] = above[parent[-1]]
        self.last = leaves[-1].copy()
        nearest = above.argmin(axis=1)
        return nearest[parent], above[np.arange(len(above)), nearest][parent]


def nearest_entries(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances of parts in any order, by a walk over the trie of the distinct ones."""
    distinct, back = np.unique(parts, axis=0, return_inverse=True)
    walk, codes, errors = TrieWalk(codebook), [], []
    for at in range(0, len(distinct), STRETCH):
        code, error = walk(distinct[at : at + STRETCH])
        codes.append(code)
        errors.append(error)
    back = back.reshape(-1)
    return np.concatenate(codes)[back], np.concatenate(errors)[back]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _weighted_sums(codebooks: list[np.ndarray]):
    """Per position and entry the number of parts nearest to it and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, width = codebooks[0].shape
        sums = np.zeros((len(codebooks), count, width + 1), np.int64)
        walks: dict[int, TrieWalk] = {}
        for batch in batches:
            position, weight = (batch.column(x).to_numpy() for x in ("position", "weight"))
            leaves = _matrix(batch.column("part"), width)
            cuts = np.flatnonzero(np.concatenate([[True], position[1:] != position[:-1], [True]])) if len(position) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                k = int(position[a])
                walk = walks.setdefault(k, TrieWalk(codebooks[k]))
                for at in range(a, b, STRETCH):
                    to = min(b, at + STRETCH)
                    nearest, _ = walk(leaves[at:to])
                    weighted = np.concatenate([np.ones((to - at, 1), np.int64), leaves[at:to]], axis=1) * weight[at:to, None]
                    np.add.at(sums[k], nearest, weighted)
        k, e = np.nonzero(sums[:, :, 0])
        found = sums[k, e]
        for d in range(width + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(np.full(len(k), d), pa.int32()), pa.array(found[:, d])], names=["position", "entry", "component", "total"])

    return run


def _coded(codebooks: list[np.ndarray], kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = codebooks[0].shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), width * len(codebooks))
            found = [nearest_entries(vectors[:, k * width : (k + 1) * width], book) for k, book in enumerate(codebooks)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.reshape(-1)))
            error = np.sum([error for _, error in found], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], lists, pa.array(error)], names=[*batch.schema.names[:kept], "codes", "error"])

    return run


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist()).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, key: str = "key", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook a part position, from (key, vector) with integer vectors of one length.

    A position's first entries are that part of the vectors with the least keys (equal keys by their vectors, null keys
    last; fewer vectors, fewer entries). Each round gives every part to its nearest entry and moves each entry that
    has parts to the floor of their mean. The distinct parts, with how often they occur, are written once, sorted;
    the rounds walk over them, and the driver sees ``parts * entries`` rows of sums a round. No vectors give no codebooks.
    """
    first = [row["vector"] for row in vectors.orderBy(F.col(key).asc_nulls_last(), "vector").limit(entries).collect()]
    if not first:
        return []
    width = len(first[0]) // parts
    starts = np.array(first, np.int64)
    codebooks = [starts[:, k * width : (k + 1) * width] for k in range(parts)]

    pieces = F.array(*[F.struct(F.lit(k).alias("position"), F.slice("vector", k * width + 1, width).alias("part")) for k in range(parts)])
    distinct = vectors.select(F.inline(pieces)).groupBy("position", "part").agg(F.count("*").alias("weight"))
    # counted by hash, then dealt by range: neighbours share prefixes, and a task walks one stretch of the trie
    distinct = written(written(distinct, "counted").repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")
    for _ in range(rounds):
        sums = distinct.mapInArrow(_weighted_sums(codebooks), "position int, entry int, component int, total long")
        totals = np.zeros((parts, len(first), width + 1), np.int64)
        for row in sums.groupBy("position", "entry", "component").agg(F.sum("total")).collect():
            totals[row[0], row[1], row[2]] = row[3]
        counts = totals[:, :, :1]
        moved = totals[:, :, 1:] // np.maximum(counts, 1)
        codebooks = [np.where(counts[k] > 0, moved[k], book) for k, book in enumerate(codebooks)]
    forget(distinct)
    return codebooks


def quantized(vector: Column) -> Column:
    """The integer vector; null where the vector is null or empty, or a component is null, infinite or no number."""
    fit = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fit, whole)


def encode(table: DataFrame, vec_id: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error, label_error) and the codebooks that the codes point into.

    error is the squared distance of the integer vector to its entries, label_error its sum over all rows of the label
    (null labels are one). Vectors that are null, empty, or hold a null or non-finite component are left out; the
    others must have one length, a multiple of ``parts`` (ValueError). Repeated rows stay repeated, each counts. Equal
    distances go to the entry of the lower index. Other columns play no part. An empty table gives no rows.
    """
    rows = table.select(table[vec_id].alias("key"), table[label].alias("label"), quantized(table[vector]).alias("vector")).where("vector is not null")
    rows = written(rows, "vectors")
    low, high = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high or (low or 0) % parts:
        raise ValueError(f"vectors of {low} to {high} components; one length is needed, a multiple of {parts}")
    codebooks = fit_codebooks(rows.select("key", "vector"), "key", parts, entries, rounds)
    kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
    shape = f"key {kinds['key']}, label {kinds['label']}, codes array<int>, error long"
    if not codebooks:
        coded = rows.select("key", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    else:
        coded = rows.mapInArrow(_coded(codebooks, 2), shape)
    coded = written(coded, "codes")
    labels = written(coded.groupBy(F.col("label").alias("named")).agg(F.sum("error").alias("label_error")), "labels")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("named")))
    return out.select(F.col("key").alias(vec_id), F.col("label").alias(label), "codes", "error", "label_error"), codebooks
