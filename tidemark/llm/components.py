"""Connected components of a link table, by contraction in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links as stars around the smallest node of what they connect."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        one, two = ends[: len(a)], ends[len(a) :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[one], label[two])
            new = label.copy()
            np.minimum.at(new, label[one], low)
            np.minimum.at(new, label[two], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        rest = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[label[rest]]), pa.array(names[rest])], names=["a", "b"])


def smallest_reachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, smallest) with the least ``smallest`` of the component; a node without edges keeps its own.

    Alternating large-star and small-star rounds: each node's neighbours are joined to the smallest one. Links
    are first contracted inside each batch. A node's minimum is aggregated before the shuffle and written; the join
    back is one whose hot keys Spark splits, so a node with very many links is no single task's work.
    """
    links = written(edges.mapInArrow(_forest, "a long, b long").distinct(), "links")
    while True:
        before = links
        # large star: neighbours larger than the node go to the smallest of node and neighbours
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        links = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        links = written(links, "links")
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        least = written(links.groupBy("b").agg(F.min("a").alias("m")), "least")
        low = links.join(least, "b")
        after = low.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        after = written(after.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        done = _same(before, after)
        forget(before)
        forget(links)
        links = after
        if done:
            break
    member = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    rooted = written(nodes.join(member, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "smallest"), "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("smallest").alias("smallest")), "lowest")
    return rooted.select("node", "root").join(lowest, "root").select("node", "smallest")


def _same(one: DataFrame, two: DataFrame) -> bool:
    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        return tuple(row)

    return mark(one) == mark(two)
