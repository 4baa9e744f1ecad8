"""Approximate nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Projections, and how many of them have to collide. At distance R (on unit vectors) a window of WIDTH * R makes
#: 0.83 of the projections collide, at 2 R half of them.
PROJECTIONS = 48
COLLISIONS = 33
WIDTH = 2.72
FIRST_RADIUS = 0.1
GROWTH = 2.0
#: More than any place of a unit vector on a projection: all sorted arrays in one stay sorted, each at its offset.
APART = 1000.0
#: Unit vectors are at most this far apart; a search that gets so far looks at every vector that is left.
FARTHEST = 2.0
BLOCK = 4096
#: Queries that are one row of the search.
QUERY_BLOCK = 1024
#: Blocks of the index that a task holds at a time.
GROUP_BLOCKS = 16
SEED = 20240
BLOCK_ROWS = "dim int, ids binary, vectors binary, places binary, order binary"


def usable(vector: Column) -> Column:
    """Not null, some component not zero, none null, infinite or NaN."""
    value = vector.cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).standard_normal((PROJECTIONS, dim))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # scaled first, so that squares of very large or small components neither overflow nor vanish
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    odd = ~np.isfinite(norms) | (norms < 1e-150)
    if odd.any():
        scale = np.abs(vectors[odd]).max(axis=1, keepdims=True)
        part = vectors[odd] / scale
        vectors = vectors.copy()
        vectors[odd] = part
        norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors, norms


@dataclass
class Index:
    """One block: ids, vectors, norms; for each projection the sorted places and the rows in that order."""

    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    places: np.ndarray
    order: np.ndarray

    def __post_init__(self):
        self.line = (self.places + APART * np.arange(PROJECTIONS)[:, None]).ravel()
        self.rows = self.order.ravel()

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Index:
        vectors, norms = unit(vectors)
        places = directions(vectors.shape[1]) @ (vectors / norms[:, None]).T
        order = np.argsort(places, axis=1, kind="stable").astype(np.int32)
        return cls(ids, vectors, norms, np.take_along_axis(places, order, axis=1), order)

    @classmethod
    def read(cls, row: dict) -> Index:
        ids = np.frombuffer(row["ids"], np.int64)
        vectors, norms = unit(np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"]))
        return cls(ids, vectors, norms, np.frombuffer(row["places"], np.float64).reshape(PROJECTIONS, len(ids)), np.frombuffer(row["order"], np.int32).reshape(PROJECTIONS, len(ids)))

    def row(self) -> dict:
        return {"dim": self.vectors.shape[1], "ids": self.ids.tobytes(), "vectors": self.vectors.tobytes(), "places": self.places.tobytes(), "order": self.order.tobytes()}

    def cosines(self, rows: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
        return (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)

    def search(self, own: int, vector: np.ndarray, norm: float, at: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the block's k nearest, nearest first, equals by id.

        Windows around the query's places grow by virtual rehashing: the same sorted arrays serve every radius, and
        only what enters a window is counted. Vectors that reach the threshold are verified. The search ends when
        the k-th nearest known, here or by ``bound`` (a distance within which k are known), is inside the radius.
        """
        n = len(self.ids)
        counts = np.zeros(n, np.int64)
        verified = np.zeros(n, bool)
        verified[self.ids == own] = True
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        low = high = None
        # a bound that is known lets the first window be half as wide as the last one can become
        radius = FIRST_RADIUS if bound >= FARTHEST else max(FIRST_RADIUS, bound / GROWTH)
        at = at + APART * np.arange(PROJECTIONS)
        while True:
            if radius >= FARTHEST:
                new = np.flatnonzero(~verified)
            else:
                half = WIDTH * radius / 2
                left, right = np.searchsorted(self.line, at - half).tolist(), np.searchsorted(self.line, at + half, side="right").tolist()
                spans = zip(left, right, strict=True) if low is None else chain(zip(left, low, strict=True), zip(high, right, strict=True))
                counts += np.bincount(np.concatenate([self.rows[a:b] for a, b in spans]), minlength=n)
                low, high = left, right
                new = np.flatnonzero((counts >= COLLISIONS) & ~verified)
            if len(new):
                verified[new] = True
                found, scores = np.concatenate([found, new]), np.concatenate([scores, self.cosines(new, vector, norm)])
                best = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
            if len(found) >= k:
                bound = min(bound, math.sqrt(max(0.0, 2 - 2 * scores[k - 1])))
            if bound <= radius or radius >= FARTHEST:
                return self.ids[found], scores
            radius = min(radius * GROWTH, max(bound, radius * 1.0001)) if bound < FARTHEST else radius * GROWTH


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _blocks_by_dim(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of vectors of one length. Rows are sorted by length and id; of rows with one id the first stays."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, last = 0, None

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])

    for batch in batches:
        lengths = batch.column("dim").to_numpy()
        ids = batch.column("vec_id").to_numpy()
        cuts = np.flatnonzero(np.diff(lengths, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and (held[0][1].shape[1] != lengths[a] or rows >= most):
                yield joined()
                held, rows = [], 0
            fresh = np.ones(b - a, bool)
            fresh[1:] = ids[a + 1 : b] != ids[a : b - 1]
            if last is not None and last == (lengths[a], ids[a]):
                fresh[0] = False
            last = (lengths[b - 1], ids[b - 1])
            keep = np.flatnonzero(fresh) + a
            if len(keep):
                held.append((ids[keep], _matrix(batch.column("vector").take(pa.array(keep)))))
                rows += len(keep)
    if held:
        yield joined()


def _index_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks_by_dim(batches, most):
            row = Index.of(ids, vectors).row()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("dim", pa.int32())] + [(x, pa.binary()) for x in ("ids", "vectors", "places", "order")]))

    return run


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row a block of about ``block`` vectors of one length, every usable vector in one of them."""
    wanted = _usable_rows(vectors, vec_id, embedding)
    parts = max(1, -(-wanted.count() // block))
    dealt = wanted.repartition(parts, "vec_id").sortWithinPartitions("dim", "vec_id", "vector")
    # a part is one block as a rule: more if the vectors differ in length or ids hash unevenly
    blocks = dealt.mapInArrow(_index_batches(2 * block), BLOCK_ROWS).withColumn("part", F.spark_partition_id())
    return written(blocks, "vectors", **{"parquet.block.size": str(16 << 20)})


def _usable_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    kept = vectors.where(vectors[vec_id].isNotNull() & usable(vectors[embedding]))
    return kept.select(vectors[vec_id].cast("long").alias("vec_id"), F.size(vectors[embedding]).alias("dim"), vectors[embedding].cast("array<double>").alias("vector"))


def _search_batches(k: int):
    """Rows sorted by group and kind: a group's blocks (kind 0) are held, its queries (kind 1) stream past them.

    What one block finds bounds the search of the next, so that a group yields k rows a query at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != group:
                    group, held = row["grp"], []
                if row["kind"] == 0:
                    held.append((row["dim"], Index.read(row)))
                    continue
                indexes = [index for dim, index in held if dim == row["dim"]]
                if indexes:
                    yield _searched(indexes, row, k)

    return run


def _searched(indexes: list[Index], row: dict, k: int) -> pa.RecordBatch:
    ids = np.frombuffer(row["ids"], np.int64)
    bounds = np.frombuffer(row["places"], np.float64)
    scaled, norms = unit(np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"]))
    places = (scaled / norms[:, None]) @ directions(row["dim"]).T
    out: tuple[list, list, list] = ([], [], [])
    for number, own in enumerate(ids.tolist()):
        bound = bounds[number]
        near, scores = np.zeros(0, np.int64), np.zeros(0)
        for index in indexes:
            more, found = index.search(own, scaled[number], norms[number], places[number], bound, k)
            near, scores = np.concatenate([near, more]), np.concatenate([scores, found])
            best = np.lexsort((near, -scores))[:k]
            near, scores = near[best], scores[best]
            if len(near) == k:
                bound = min(bound, math.sqrt(max(0.0, 2 - 2 * scores[-1])))
        for held, value in zip(out, (np.full(len(near), own), near, scores), strict=True):
            held.append(value)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])


_NEAR = pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_QUERY_SCHEMA = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("bounds", pa.binary()), ("near", pa.list_(_NEAR))])
QUERY_ROWS = "dim int, ids binary, vectors binary, bounds binary, near array<struct<query_id: long, vec_id: long, score: double>>"


def _query_batches(pilot, k: int):
    """Blocks of queries, each query with the pilot block's k nearest and the distance within which they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {row["dim"]: Index.read(row) for row in pilot.value}
        for ids, vectors in _blocks_by_dim(batches, QUERY_BLOCK):
            dim = vectors.shape[1]
            index = blocks.get(dim)
            bounds = np.full(len(ids), np.inf)
            near: list[dict] = []
            if index is not None:
                scaled, norms = unit(vectors)
                places = (scaled / norms[:, None]) @ directions(dim).T
                for number, own in enumerate(ids.tolist()):
                    found, scores = index.search(own, scaled[number], norms[number], places[number], math.inf, k)
                    if len(scores) == k:
                        bounds[number] = math.sqrt(max(0.0, 2 - 2 * scores[-1]))
                    near += [{"query_id": own, "vec_id": v, "score": s} for v, s in zip(found.tolist(), scores.tolist(), strict=True)]
            row = {"dim": dim, "ids": ids.tobytes(), "vectors": vectors.tobytes(), "bounds": bounds.tobytes(), "near": near}
            yield pa.RecordBatch.from_pylist([row], schema=_QUERY_SCHEMA)

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine for each row where ``queries`` holds.

    Every usable vector is indexed, in blocks. A group of at most GROUP_BLOCKS blocks is held by one task, and the
    queries, in blocks of their own, are sent to each group; neither passes through the driver. One pilot block gives
    each query a first bound, and neighbours that stay unless nearer ones are found. Nearest first, equals by the
    smaller vec_id; a row is no neighbour of itself.

    Vectors that are null, empty or zero, or have a null, infinite or NaN component, and rows without an id, take no
    part. Vectors of another length than the query's are no candidates. Rows of one id count once (the least
    vector). With fewer candidates than k all of them are returned; no query or an empty table gives none.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, vec_id, embedding, block)
    # the largest block, found by its numbers, so that no other one is sent to the driver
    largest = index.select("part", "dim", F.length("ids").alias("n")).orderBy(F.desc("n"), "part", "dim").limit(1).collect()
    pilots = [r for x in largest for r in index.where((F.col("part") == x["part"]) & (F.col("dim") == x["dim"]) & (F.length("ids") == x["n"])).drop("part").take(1)]
    pilot = spark.sparkContext.broadcast([r.asDict() for r in pilots])
    asked = _usable_rows(vectors.where(queries), vec_id, embedding).repartition("vec_id").sortWithinPartitions("dim", "vec_id", "vector")
    asked = written(asked.mapInArrow(_query_batches(pilot, k), QUERY_ROWS), "queries")

    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    groups = max(-(-parts // GROUP_BLOCKS), min(parts, 2 * spark.sparkContext.defaultParallelism))
    held = index.select(F.pmod("part", F.lit(groups)).alias("grp"), F.lit(0).alias("kind"), "dim", "ids", "vectors", "places", "order")
    sent = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), "dim", "ids", "vectors",
        F.col("bounds").alias("places"), F.lit(None).cast("binary").alias("order"),
    )
    met = held.unionByName(sent).repartitionById(groups, "grp").sortWithinPartitions("grp", "kind")
    found = met.mapInArrow(_search_batches(k), "query_id long, vec_id long, score double")
    first = asked.select(F.explode("near").alias("x")).select("x.*")
    # the pilot block is searched again with its group
    found = written(found.unionByName(first), "near").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
