"""Repeated byte strings, found by merging Burrows-Wheeler transforms of shards.

Texts are cut by their content: each window of 100 bytes belongs to the least of its 32-byte anchors, consecutive windows
of one anchor are a piece. Equal windows lie in pieces of equal anchors, so pieces are dealt by their anchor, and only
those whose anchor occurs twice. Where they meet, they are shards of about a quarter of a megabyte; each is sorted by
itself and becomes its transform, and the transforms are merged by refining how their rows interleave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, forget, small_batches, text_slices, written

WINDOW = 100
ANCHOR = 32
#: Text bytes that a task cuts at a time, few enough for a processor's cache; a longer text is cut by itself, in about 60
#: bytes of memory for each of its own.
CUT_BYTES = 1 << 18
#: Bytes of pieces that are sorted together, and that are merged together.
SHARD_BYTES = 1 << 18
UNIT_BYTES = 1 << 20
#: Different pieces of one anchor that are merged in one task. Those of a more common anchor are compared window by
#: window, counted before the exchange.
MERGED = 4096

_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_HALF = np.uint64(32)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _STEPS[0])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (none null) of a batch, and where each begins and the last ends."""
    n = len(texts)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.zeros(1, np.int64) if n == 0 else np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


class Hashes:
    """Hashes of any run of bytes, in constant time each: prefix sums over powers of an odd, hence invertible, number."""

    def __init__(self, data: np.ndarray, step: np.uint64):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(step, len(data)), out=self.sums[1:])
        self.back = _powers(np.uint64(pow(int(step), -1, 1 << 64)), len(data) + 1)

    def __call__(self, starts: np.ndarray, sizes) -> np.ndarray:
        return _mix((self.sums[starts + sizes] - self.sums[starts]) * self.back[starts])


def cut_by_anchors(data: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, last window (places in the text) and anchor hash of each piece, in order."""
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty.astype(np.uint64)
    span = window - anchor + 1
    at = np.arange(len(data) - anchor + 1)
    hashes = Hashes(data, _STEPS[0])(at, anchor)
    # upper half: the hash; lower half: the place, so that the least of equals is the first
    least = (hashes >> _HALF << _HALF) | at.astype(np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + window <= bounds[1:][text])
    if not len(inside):
        return empty, empty, empty, empty.astype(np.uint64)
    place, text = place[inside], text[inside]
    cuts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    owner = text[cuts]
    last = inside[np.concatenate([cuts[1:], [len(inside)]]) - 1]
    return owner, inside[cuts] - bounds[owner], last - bounds[owner], hashes[place[cuts]]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchor_batches(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=CUT_BYTES):
                owner, first, last, hashes = cut_by_anchors(*text_bytes(part.column("text")), window, anchor)
                keys = part.select(["r1", "r2"]).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32()), _signed(hashes)], names=["r1", "r2", "a", "b", "anchor"])

    return run


PIECES = "r1 long, r2 long, doc_id long, a int, anchor long, s1 long, s2 long, piece binary"


def _piece_batches(window: int):
    """The pieces that ``cuts`` names, with 128 bits that stand for their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=CUT_BYTES):
                data, bounds = text_bytes(part.column("text"))
                cuts = part.column("cuts")
                owner = np.repeat(np.arange(len(part)), np.diff(cuts.offsets.to_numpy()))
                rows = cuts.flatten()
                a, b, anchor = (rows.field(x) for x in ("a", "b", "anchor"))
                starts = a.to_numpy() + bounds[owner]
                sizes = b.to_numpy() - a.to_numpy() + window
                one, two = (Hashes(data, step)(starts, sizes) for step in _STEPS)
                raw = data.tobytes()
                pieces = [raw[x:y] for x, y in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
                keys = part.select(["r1", "r2", "doc_id"]).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*keys.columns, a, anchor, _signed(one), _signed(two), pa.array(pieces, pa.binary())], names=["r1", "r2", "doc_id", "a", "anchor", "s1", "s2", "piece"])

    return run


def _opens(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; one more than the rows, so that the next group's begin is each one's end."""
    opens = np.ones(len(columns[0]) + 1, bool)
    np.not_equal(columns[0][1:], columns[0][:-1], out=opens[1:-1])
    for values in columns[1:]:
        opens[1:-1] |= values[1:] != values[:-1]
    return opens


class Transform:
    """The Burrows-Wheeler transform of a shard of strings, two symbols at a time.

    Row k stands for the k-th suffix in order: ``before[k]`` are the two bytes before it and ``steps[k]`` is the row of
    the suffix that begins with them; -1 where the string has not as many.
    """

    #: Symbols of nine bits in the first sort's key.
    _PACKED = 7

    def __init__(self, strings: list[bytes], depth: int):
        sizes = np.array([len(x) for x in strings], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        codes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        codes[bounds[1:] - 1] = 0
        string = np.repeat(np.arange(len(strings)), sizes + 1)
        begin, end = bounds[:-1].take(string), (bounds[1:] - 1).take(string)
        order = self._sorted(codes, end, depth)
        self.string, self.place = string.take(order), order - begin.take(order)
        row = np.empty(len(codes), np.int64)
        row[order] = np.arange(len(codes))
        room = np.flatnonzero(self.place >= 2)
        back = order.take(room) - 2
        self.before = np.zeros(len(codes), np.uint16)
        self.before[room] = ((codes.take(back) - 1) << 8) | (codes.take(back + 1) - 1)
        self.steps = np.full(len(codes), -1, np.int64)
        self.steps[room] = row.take(back)

    def _sorted(self, codes: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes in the order of their first ``depth`` symbols: seven first, then twice as many by the ranks so far,
        among those that are still tied."""
        at = np.arange(len(codes))
        pair = (codes << 9) | codes.take(np.minimum(at + 1, end))
        four = (pair << 18) | pair.take(np.minimum(at + 2, end))
        key = (four << 27) | (four >> 9).take(np.minimum(at + 4, end))
        order = np.argsort(key)
        rank = np.empty(len(codes), np.int64)
        slots, moved, key, known = at, order, key.take(order), self._PACKED
        while True:
            opens = _opens(key)
            rank[moved] = slots.take(np.maximum.accumulate(np.where(opens[:-1], np.arange(len(slots)), 0)))
            tied = np.flatnonzero(~(opens[:-1] & opens[1:]))
            if known >= depth or not len(tied):
                return order
            slots, moved = slots.take(tied), moved.take(tied)
            key = (rank.take(moved) << 32) | rank.take(np.minimum(moved + known, end.take(moved)))
            sub = np.argsort(key)
            moved, key = moved.take(sub), key.take(sub)
            order[slots] = moved
            known *= 2


def merged_repeats(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of all shards, one after the other) whose suffixes share their first ``depth`` bytes with another row's,
    and where each interval of equal ones begins.

    The interleave starts as shard after shard, one block. Each step puts the four (or two) bytes before a row's suffix
    in front of it: a stable sort by these bytes alone turns the order by h bytes into the order by h + 4, the rows of a
    shard keep their order, and a block ends where the bytes or the former blocks differ. Neighbours parted by that step
    share at least h bytes and less than h + 4; a block of one row has met all it shares and is followed no further, as
    what its suffix is the end of is unique too.
    """
    offsets = np.cumsum([0] + [len(x.before) for x in shards])
    near = np.concatenate([x.before for x in shards])
    steps = np.concatenate([np.where(x.steps >= 0, x.steps + at, -1) for x, at in zip(shards, offsets, strict=False)])
    far, far_steps = near.take(steps), np.where(steps >= 0, steps.take(steps), -1)
    rows, block = np.arange(len(near)), np.zeros(len(near), np.int32)
    for size in [2] * (depth % 4 // 2) + [4] * (depth // 4):
        onward = (far_steps if size == 4 else steps).take(rows)
        room = np.flatnonzero(onward >= 0)
        rows, onward, block = rows.take(room), onward.take(room), block.take(room)
        if not len(rows):
            break
        symbols = near.take(rows)
        order = symbols.argsort(kind="stable")
        if size == 4:
            upper = far.take(rows)
            order = order.take(upper.take(order).argsort(kind="stable"))
            symbols = (upper.astype(np.uint32) << np.uint32(16)) | symbols
        rows, block = onward.take(order), block.take(order)
        opens = _opens(symbols.take(order), block)
        shared = np.flatnonzero(~(opens[:-1] & opens[1:]))
        rows, block = rows.take(shared), np.cumsum(opens[:-1], dtype=np.int32).take(shared)
    return rows, np.flatnonzero(_opens(block)[:-1]) if len(rows) else np.zeros(0, np.int64)


RUNS = "s1 long, s2 long, runs array<struct<j: int, k: int, doc: long, start: int>>"
_RUN = pa.struct([("j", pa.int32()), ("k", pa.int32()), ("doc", pa.int64()), ("start", pa.int32())])


def _merge_unit(rows: pa.Table, window: int) -> pa.RecordBatch:
    """For each piece its runs of windows j to k that occur more than once, the first time at a document's start and on."""
    pieces = rows.column("piece").to_pylist()
    sizes = np.array([len(x) for x in pieces], np.int64)
    docs = rows.column("doc_id").combine_chunks()
    # ids by their order, a null first
    names = np.unique(pc.drop_null(docs).to_numpy())
    doc = np.searchsorted(names, pc.fill_null(docs, 0).to_numpy()) + 1
    doc[pc.is_null(docs).to_numpy(zero_copy_only=False)] = 0
    first = (doc.astype(np.int64) << 32) | rows.column("a").to_numpy().astype(np.int64)

    counts = sizes - window + 1
    upto = np.concatenate([[0], np.cumsum(counts)])
    own = np.repeat(first - upto[:-1], counts) + np.arange(upto[-1])
    many = np.repeat(rows.column("many").to_numpy(zero_copy_only=False), counts)

    # windows of one piece differ, as its anchor is at another place in each: a piece alone at its anchor meets nothing
    opens = _opens(rows.column("anchor").to_numpy())
    meeting = np.flatnonzero(~(opens[:-1] & opens[1:]))
    shards, cuts = [], np.flatnonzero(np.diff(np.cumsum(sizes[meeting]) // SHARD_BYTES, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(meeting)], strict=False):
        shards.append((meeting[a:b], Transform([pieces[x] for x in meeting[a:b].tolist()], window)))
    earliest = own.copy()
    found, begins = merged_repeats([x for _, x in shards], window) if shards else (np.zeros(0, np.int64), None)
    if len(found):
        string = np.concatenate([at.take(x.string) for at, x in shards])[found]
        spot = upto[string] + np.concatenate([x.place for _, x in shards])[found]
        least = np.minimum.reduceat(own[spot], begins)
        earliest[spot] = np.repeat(least, np.diff(np.concatenate([begins, [len(spot)]])))
        many[spot] = True

    at = np.flatnonzero(many)
    piece = np.repeat(np.arange(len(pieces)), counts)[at]
    low = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(piece) != 0) | (np.diff(earliest[at]) != 1)])) if len(at) else np.zeros(0, np.int64)
    high = np.concatenate([low[1:], [len(at)]]).astype(np.int64) - 1 if len(at) else low
    owner = piece[low]
    where = earliest[at[low]]
    named = where >> 32
    ids = np.concatenate([[0], names])[named]
    runs = pa.StructArray.from_arrays(
        [pa.array(at[low] - upto[owner], pa.int32()), pa.array(at[high] - upto[owner], pa.int32()), pa.array(ids.astype(np.int64), mask=named == 0), pa.array(where & 0xFFFFFFFF, pa.int32())], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(pieces) + 1)).astype(np.int32)), runs)
    return pa.RecordBatch.from_arrays([rows.column("s1").combine_chunks(), rows.column("s2").combine_chunks(), lists], names=["s1", "s2", "runs"])


def _merge_batches(window: int):
    """Pieces sorted by anchor, in units of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        used = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if used >= UNIT_BYTES:
                # the held anchor may go on in this batch
                goes_on = int(pc.sum(pc.equal(batch.column("anchor"), held[-1].column("anchor")[-1])).as_py())
                held.append(batch.slice(0, goes_on))
                batch = batch.slice(goes_on)
                if not batch.num_rows:
                    used += held[-1].column("piece").nbytes
                    continue
                yield _merge_unit(pa.Table.from_batches(held), window)
                held, used = [], 0
            held.append(batch)
            used += batch.column("piece").nbytes
        if held:
            yield _merge_unit(pa.Table.from_batches(held), window)

    return run


def _common_runs(pieces: DataFrame, window: int) -> DataFrame:
    """The same as the merge for anchors of very many different pieces: one row a window, met by 128 bits of it."""
    each = F.explode(F.sequence(F.lit(0), F.octet_length("piece") - window)).alias("j")
    windows = pieces.select("s1", "s2", "many", "at", "piece", each)
    text = F.expr(f"substring(piece, j + 1, {window})")
    place = F.struct(F.col("at.doc_id").alias("doc"), (F.col("at.a") + F.col("j")).alias("start"))
    windows = written(windows.select("s1", "s2", "j", "many", place.alias("place"), F.xxhash64(text).alias("w1"), F.xxhash64(F.lit(1), text).alias("w2")), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("place").alias("least"), F.max("place").alias("most"), F.max("many").alias("any"))
    least = written(least.where("any or least <> most").select("w1", "w2", "least"), "least")
    met = windows.join(least, ["w1", "w2"]).select("s1", "s2", F.struct("j", F.col("j").alias("k"), "least.doc", "least.start").alias("run"))
    return met.groupBy("s1", "s2").agg(F.collect_list("run").alias("runs"))


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, merged: int = MERGED) -> DataFrame:
    """(r1, r2, spans): bytes ``a`` to before ``b`` of a text are windows that start earlier elsewhere.

    ``texts`` has (r1, r2, doc_id, text), 128 bits that stand for the row's id and text. Earlier is a smaller doc_id (null
    before all), or the same and an earlier start.
    """
    index = written(texts.select("r1", "r2", "text").mapInArrow(_anchor_batches(window, anchor), "r1 long, r2 long, a int, b int, anchor long"), "anchors")
    twice = written(index.groupBy("anchor").count().where("count > 1").select("anchor"), "twice")
    cuts = index.join(twice, "anchor", "left_semi").groupBy("r1", "r2").agg(F.collect_list(F.struct("a", "b", "anchor")).alias("cuts"))
    cuts = written(cuts, "cuts")
    forget(index)
    forget(twice)
    pieces = written(texts.join(cuts, ["r1", "r2"]).mapInArrow(_piece_batches(window), PIECES), "pieces", compression="zstd")
    forget(cuts)

    at = F.struct("doc_id", "a")
    known = pieces.groupBy("s1", "s2").agg(F.first("anchor").alias("anchor"), F.min(at).alias("at"), F.max(at).alias("most"), F.first("piece").alias("piece"))
    known = written(known.select("s1", "s2", "anchor", "at", (F.col("at") != F.col("most")).alias("many"), "piece"), "known", compression="zstd")
    common = written(known.groupBy("anchor").count().where(F.col("count") > merged).select("anchor"), "common")
    dealt = known.join(common, "anchor", "left_anti").select("s1", "s2", "anchor", "at.doc_id", "at.a", "many", "piece")
    runs = dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge_batches(window), RUNS).where("size(runs) > 0")
    runs = written(runs, "runs")
    common = written(_common_runs(known.join(common, "anchor", "left_semi"), window), "runs")
    forget(known)

    met = pieces.select("r1", "r2", "doc_id", "a", "s1", "s2").join(runs.unionByName(common), ["s1", "s2"])
    met = met.select("r1", "r2", "doc_id", "a", F.explode("runs").alias("run"))
    before = F.struct("run.doc", "run.start") < F.struct("doc_id", F.col("a") + F.col("run.j"))
    span = F.struct((F.col("a") + F.col("run.j")).alias("a"), (F.col("a") + F.col("run.k") + window).alias("b"))
    return met.where(before).groupBy("r1", "r2").agg(F.collect_set(span).alias("spans"))


REMOVAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
WHOLE = ", kept binary, removed array<struct<start: int, size: int>>"


def _removal_batches(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=CUT_BYTES):
                data, bounds = text_bytes(part.column("text"))
                spans = part.column("spans")
                counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy().astype(np.int64)
                base = np.repeat(bounds[:-1], counts)
                flat = spans.flatten()
                edges = np.zeros(len(data) + 1, np.int32)
                np.add.at(edges, flat.field("a").to_numpy() + base, 1)
                np.add.at(edges, flat.field("b").to_numpy() + base, -1)
                gone = np.cumsum(edges[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                starts = bounds[:-1][np.diff(bounds) > 0]
                opens[starts] = gone[starts]
                removed, runs = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (gone, opens))
                kept = data[~gone].tobytes()
                upto = (bounds - np.concatenate([[0], np.cumsum(removed)])).tolist()
                texts = [kept[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed), pa.array(runs), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                if whole:
                    begin = np.flatnonzero(opens)
                    order = np.cumsum(opens)[gone] - 1
                    row = np.searchsorted(bounds, begin, "right") - 1
                    found = pa.StructArray.from_arrays([pa.array(begin - bounds[row], pa.int32()), pa.array(np.bincount(order, minlength=len(begin)), pa.int32())], names=["start", "size"])
                    columns += [pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)), found)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"][: len(columns)])

    return run


def remove_repeated_bytes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, merged: int = MERGED, whole: bool = True
) -> DataFrame:
    """Texts as UTF-8 bytes without those that a string of ``window`` bytes covers which also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of what is left; with ``whole`` also
    ``kept``, as bytes (a cut may part a character), and ``removed``, the runs in bytes. ``window`` is even and longer
    than ``anchor``.

    Null texts are empty; texts shorter than the window lose nothing. A null doc_id comes before all others. Rows of one
    doc_id are one document: of equal strings in them the one that starts first stays, in both rows if they start at
    the same place, so repeated rows have equal results. Other columns play no part. An empty table gives none.
    """
    if window % 2 or not 0 < anchor <= window:
        raise ValueError("the window must be even, and as long as the anchor at least")
    small_batches(docs.sparkSession)
    content, key = as_text(docs[text]), docs[doc_id].cast("long")
    texts = docs.select(F.xxhash64(content, key, key.isNull()).alias("r1"), F.xxhash64(F.lit(1), key, key.isNull(), content).alias("r2"), key.alias("doc_id"), content.alias("text"))
    spans = written(repeated_spans(texts, window, anchor, merged), "spans")
    return texts.join(spans, ["r1", "r2"], "left").select("doc_id", "text", "spans").mapInArrow(_removal_batches(whole), REMOVAL + WHOLE * whole)
