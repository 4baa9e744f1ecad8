"""Sharding by histogram sort: exact byte counts below candidate boundaries decide the splitters."""

from __future__ import annotations

from dataclasses import dataclass
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, written

OVERHEAD = 16
#: Splitters are within this share of a shard's ideal size, or at the nearest boundary between two keys.
TOLERANCE = 0.002
#: Copies of one text are parted only if a boundary would else be off by more than this share.
PART_COPIES = 0.02
TEXT_DIGITS = 16
#: A piece of the key range with more rows than this is divided further, so that a task sorts no more.
PIECE_ROWS = 1_000_000
#: Rows of one key, which cannot be divided by it, are dealt to this many parts that are numbered by themselves.
PARTS = 64
#: Up to this many pieces (some ten megabytes) are broadcast; beyond it Spark joins them.
BROADCAST_PIECES = 100_000
#: Hexadecimal digits of the first probes (4096 of them). A refinement has 16 probes, set where a piece's keys part.
FIRST_DIGITS = 3


def sort_key(text: Column, doc_id: Column) -> Column:
    """32 hexadecimal digits: a hash of the text, then one of the id, so that copies of a text lie together and
    can be parted where they outweigh a shard."""
    return F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), doc_id)), 16, "0"))


@dataclass
class Histogram:
    """Pieces of the key range by prefix: bytes, rows, least and greatest key. Pieces of one key cannot be divided."""

    pieces: dict[str, tuple[int, int, str, str]]

    def ordered(self) -> list[tuple[str, int, int, str, str]]:
        return [(prefix, *self.pieces[prefix]) for prefix in sorted(self.pieces)]

    def probes(self, prefix: str) -> int:
        """Digits of the next probes inside a piece: one more than all its keys share."""
        return len(commonprefix(self.pieces[prefix][2:])) + 1

    def undecided(self, shards: int, tolerance: float) -> set[str]:
        """Pieces that hold a wanted boundary farther than the tolerance from both their ends."""
        rows = self.ordered()
        total = sum(size for _, size, _, _, _ in rows)
        ideal, below, target, out = total / shards, 0, 1, set()
        for prefix, size, _, low, high in rows:
            limit = PART_COPIES if low[:TEXT_DIGITS] == high[:TEXT_DIGITS] else tolerance
            while target < shards and target * ideal < below + size:
                near = min(target * ideal - below, below + size - target * ideal)
                if near > limit * ideal and low != high:
                    out.add(prefix)
                target += 1
            below += size
        return out

    def large(self, piece_rows: int) -> set[str]:
        """Pieces with more rows than a task should sort, if their keys differ."""
        return {prefix for prefix, (_, count, low, high) in self.pieces.items() if count > piece_rows and low != high}

    def placed(self, shards: int) -> dict[str, int]:
        """The shard of each piece: each wanted boundary moved to the nearest piece boundary."""
        rows = self.ordered()
        total = sum(size for _, size, _, _, _ in rows)
        edges = [0]
        for _, size, _, _, _ in rows:
            edges.append(edges[-1] + size)
        cuts, at = [], 0
        for target in range(1, shards):
            want = target * total / shards
            while at + 1 < len(edges) and abs(edges[at + 1] - want) <= abs(edges[at] - want):
                at += 1
            cuts.append(at)
        out, shard = {}, 0
        for number, (prefix, _, _, _, _) in enumerate(rows):
            while shard < shards - 1 and cuts[shard] <= number:
                shard += 1
            out[prefix] = shard
        return out

    def numbered(self, shard_of: dict[str, int], piece_rows: int) -> list[tuple[str, int, int, bool]]:
        """(prefix, shard, rows of the shard before it, too many rows) of all pieces, which lie in those with a shard."""
        owners = iter(sorted(shard_of))
        owner, out, shard, before = next(owners, ""), [], None, 0
        for prefix, _, count, _, _ in self.ordered():
            while not prefix.startswith(owner):
                owner = next(owners)
            if shard_of[owner] != shard:
                shard, before = shard_of[owner], 0
            out.append((prefix, shard, before, count > piece_rows))
            before += count
        return out


def _count(pieces: DataFrame) -> dict:
    """Exact bytes and rows of each piece, as many lines as there are probes."""
    counted = pieces.groupBy("piece").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    return {r["piece"]: (r["size"], r["rows"], r["low"], r["high"]) for r in counted.collect()}


def _filed(keyed: DataFrame, pieces: list[tuple], schema: str) -> DataFrame:
    """Rows with the one piece whose prefix their key has; ``pieces`` are (piece, ...)."""
    prefixes = F.array(*[F.substring("key", 1, n) for n in sorted({len(x[0]) for x in pieces} or {1})])
    table = keyed.sparkSession.createDataFrame(pieces, schema)
    table = F.broadcast(table) if len(pieces) <= BROADCAST_PIECES else table
    return keyed.select("*", F.explode(prefixes).alias("piece")).join(table, "piece")


def _refined(keyed: DataFrame, found: Histogram, wanted: set[str]) -> None:
    """One round: exact counts below the probes inside the wanted pieces, which take their place."""
    held = _filed(keyed, [(x, found.probes(x)) for x in sorted(wanted)], "piece string, digits int")
    refined = _count(held.withColumn("piece", F.substring(F.col("key"), F.lit(1), F.col("digits"))))
    for prefix in wanted:
        del found.pieces[prefix]
    found.pieces |= refined


def histogram(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Histogram:
    """Rounds of exact counts below more and more probes, until every splitter meets the tolerance.

    Each round refines only the pieces that need it; their prefixes, and the counts, are all the driver sees.
    """
    found = Histogram(_count(keyed.withColumn("piece", F.substring("key", 1, FIRST_DIGITS))))
    while wanted := found.undecided(shards, tolerance):
        _refined(keyed, found, wanted)
    return found


def _places(located: DataFrame, heavy: bool) -> DataFrame:
    """Adds ``place``, from 0 inside a piece. Rows of a ``heavy`` piece, all equal, are numbered part by part: the
    part's rows by themselves, after the exact counts of the parts before it."""
    located = located.withColumn("part", F.when(F.col("heavy"), F.col("part")).otherwise(0))
    own = F.row_number().over(Window.partitionBy("piece", "part").orderBy("key", "doc_id", "size", "text_crc32")) - 1
    placed = located.withColumn("place", own)
    if not heavy:
        return placed
    # at most PARTS rows a heavy piece
    counts = located.where("heavy").groupBy("piece", "part").agg(F.count("*").alias("n"))
    ahead = counts.select("piece", "part", (F.sum("n").over(Window.partitionBy("piece").orderBy("part")) - F.col("n")).alias("ahead"))
    return placed.join(ahead, ["piece", "part"], "left").withColumn("place", F.col("place") + F.coalesce("ahead", F.lit(0)))


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of nearly equal bytes, slots gapless from 0 in each.

    size is the text's UTF-8 bytes plus 16. Rows are in the order of a hash of their text, then of their id: equal
    texts stay together unless a boundary within the tolerance would have to part them. One exchange puts the rows
    of each piece of the key range together; a slot is the number of rows in the shard's earlier pieces plus the
    place in its own, so no task holds a whole shard. Boundaries do not depend on ``piece_rows``: larger pieces are
    divided after they have their shard, and rows equal in id and text, which no key divides, are dealt to parts.

    A null text has no bytes and the checksum of an empty one; a null id is a key of its own; repeated rows take
    slots of their own. With fewer distinct keys than shards some shards stay empty. An empty table gives none.
    """
    content = docs[text]
    keyed = docs.select(
        docs[doc_id].cast("long").alias("doc_id"), (F.octet_length(as_text(content)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(as_text(content).cast("binary")).alias("text_crc32"), sort_key(content, docs[doc_id].cast("long")).alias("key"),
    )
    keyed = written(keyed.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")), "keyed")
    found = histogram(keyed, shards, tolerance)
    shard_of = found.placed(shards)
    while wanted := found.large(piece_rows):
        _refined(keyed, found, wanted)
    pieces = found.numbered(shard_of, piece_rows)
    located = _filed(keyed, pieces, "piece string, shard int, before long, heavy boolean")
    return _places(located, any(heavy for _, _, _, heavy in pieces)).withColumn("slot", F.col("before") + F.col("place")).select("doc_id", "size", "text_crc32", "shard", "slot")
