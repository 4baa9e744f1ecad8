"""Merkle manifest of a table: runs of sibling hashes meet by lag and lead windows over numbered nodes, level by level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written

#: Consecutive nodes that become one node of the next level.
FAN = 16
#: Runs that lie in one window group while parents are hashed; any source, however large, is many groups.
RUNS_A_GROUP = 16
#: Rows of one task are numbered in the lower bits of monotonically_increasing_id.
_ROW_BITS = 33


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its length in bytes, a colon and itself; a null as a dash."""
    return F.sha2(F.concat(*[_field(value) for value in values]), 256)


def _numbered(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Leaves (tree, idx, n, ...): tree numbers the groups and idx the leaves of each, in order and without gaps.

    Rows are sorted once, by range; a group may take any number of tasks, equal rows as well (their last sort key
    tells them apart). What is counted after that is one row for each task and group in it. Also returns the size of
    the largest group, and how many groups there are.
    """
    order = ["grp", "key", "hash", "salt"]
    ordered = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    ordered = written(ordered.withColumn("place", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("place", _ROW_BITS).alias("part")
    cells = written(ordered.groupBy(part, "grp").agg(F.min("place").alias("low"), F.count("*").alias("rows")), "cells")

    group = Window.partitionBy("grp")
    base = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("*", base.alias("base"), F.sum("rows").over(group).alias("n"))
    opens = F.when(F.col("base") == 0, 1).otherwise(0)
    cells = cells.withColumn("opened", F.sum(opens).over(Window.partitionBy("part").orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)))
    cells = written(cells, "cells")
    # one row a task
    parts = cells.groupBy("part").agg(F.max("opened").alias("all_opened"))
    ahead = F.coalesce(F.sum("all_opened").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = written(cells.join(parts.select("part", ahead.alias("ahead")), "part").withColumn("tree", F.col("ahead") + F.col("opened") - 1), "cells")
    largest, trees = cells.agg(F.max("n"), F.max("tree") + 1).first()

    own = ordered.withColumn("part", part).alias("o")
    same = (F.col("o.part") == F.col("c.part")) & F.col("o.grp").eqNullSafe(F.col("c.grp"))
    kept = [F.col(f"o.{name}") for name in leaves.columns if name != "grp"]
    placed = own.join(cells.alias("c"), same).select("c.tree", (F.col("o.place") - F.col("c.low") + F.col("c.base")).alias("idx"), "c.n", *kept)
    return written(placed, "nodes"), int(largest or 0), int(trees or 0)


def _siblings(nodes: DataFrame, runs: int) -> DataFrame:
    """Nodes with ``grouped``, the window group, and the hashes beside them in their run: ``left`` and ``right`` of them.

    The lag and lead columns have fixed offsets; the slot in the run masks what belongs to the run before, the run's
    length what belongs to the next one.
    """
    slot = F.col("idx") % FAN
    size = F.least(F.lit(FAN), F.col("n") - F.col("idx") + slot)
    grouped = nodes.withColumn("grouped", F.floor(F.col("idx") / (FAN * runs)))
    window = Window.partitionBy("tree", "grouped").orderBy("idx")
    left = [F.when(slot >= k, F.lag("hash", k).over(window)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < size, F.lead("hash", k).over(window)) for k in range(1, FAN)]
    return grouped.select("*", F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))


def _levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Nodes of each level, leaves first; the first child of each run makes its parent. Trees of one node end there."""
    levels = [nodes]
    while largest > 1:
        firsts = _siblings(levels[-1].where("n > 1"), RUNS_A_GROUP).where(F.col("idx") % FAN == 0)
        above = firsts.select(
            "tree", F.floor(F.col("idx") / FAN).alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.concat("hash", "right"), 256).alias("hash"),
        )
        levels.append(written(above, "nodes"))
        largest = -(-largest // FAN)
    return levels


def _with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's nodes with ``path``, what lies left and right of them on each level up, and tops' columns.

    ``tops`` has (tree, path, ...) for the node that each tree ends in. From there each level takes its parents'
    path and puts its own siblings before it; a path is shipped once for a run, not once for a leaf.
    """
    extra = [name for name in tops.columns if name not in ("tree", "path")]
    above = None
    for height in reversed(range(len(levels))):
        nodes = levels[height]
        names = [*nodes.columns, "path", *extra]
        found = nodes.where("n = 1").join(tops, "tree").select(*names)
        if above is not None:
            parents = above.select("tree", F.col("idx").alias("grouped"), F.col("path").alias("__up"), *extra)
            path = F.concat(F.array(F.struct("left", "right")), F.col("__up"))
            inner = _siblings(nodes.where("n > 1"), 1).join(parents, ["tree", "grouped"]).withColumn("path", path)
            found = found.unionByName(inner.select(*names))
        above = written(found, "paths") if height else found
    return above


def merkle_manifest(rows: DataFrame, columns: Sequence[str], group: str, key: str, suspect: Column | None = None, altered: Mapping[str, Column] | None = None) -> DataFrame:
    """One row a leaf: key, leaf, subroot, root, path, proof, proof_sha256, folded_root, verified.

    A leaf is the hash of a row's ``columns``. In each ``group`` leaves ascend by ``key`` (nulls first; equal keys by
    leaf), and runs of ``FAN`` become nodes until one is left, the group's subroot; subroots in the order of their
    groups (null first, by bytes) make the root in the same way. ``path`` has the hashes left and right of the node on
    each level, ``proof`` joins them from the leaf's run upward. ``folded_root`` is computed from the path and the
    row as presented: where ``suspect`` holds its columns are as in ``altered``, elsewhere as they were.

    Null values and empty texts are leaves like others, a null is not an empty text. Repeated rows are leaves of their
    own, with the same hash. Columns outside ``columns`` play no part, whatever their names. An empty table has no rows
    and no root.
    """
    plain = {name: rows[name] for name in columns}
    asked = F.coalesce(suspect, F.lit(False)) if suspect is not None else F.lit(False)
    presented = F.when(asked, leaf_hash([(altered or {}).get(name, value) for name, value in plain.items()]))
    leaves = written(rows.select(rows[group].alias("grp"), rows[key].alias("key"), leaf_hash(list(plain.values())).alias("hash"), presented.alias("presented")), "hashes")

    nodes, largest, trees = _numbered(leaves)
    forget(leaves)
    levels = _levels(nodes, largest)
    subroots = None
    for level in levels:
        ends = level.where("n = 1").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "hash")
        subroots = ends if subroots is None else subroots.unionByName(ends)
    above = _levels(written(subroots, "subroots"), trees)
    empty = F.array().cast("array<struct<left: string, right: string>>")
    root = above[-1].select("tree", empty.alias("path"), F.col("hash").alias("root"))
    tops = written(_with_paths(above, root).select(F.col("idx").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), "tops")

    proof = F.concat_ws("", F.transform("path", lambda x: F.concat(x["left"], x["right"])))
    folded = F.aggregate("path", F.coalesce("presented", "hash"), lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))
    out = _with_paths(levels, tops).select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "path", proof.alias("proof"), folded.alias("folded_root"))
    return out.select(key, "leaf", "subroot", "root", "path", "proof", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
