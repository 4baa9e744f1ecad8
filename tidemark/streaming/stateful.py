"""Streams whose memory is Spark's keyed state: nothing of an earlier batch is read again.

Each processor sees the rows of one key in one micro-batch and keeps, for that key, only what is still alive. The rows of a
key in a batch are held together, so the trigger (files or offsets a batch) bounds the memory of a task.
"""

from __future__ import annotations

import heapq
import json
import math
import sys
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.vocabulary import NEWS_RETENTION_DAYS
from tidemark.operators.changes import JOB_FIELDS
from tidemark.operators.stories import MIN_SHARE, MIN_WORDS, story_words
from tidemark.operators.usage import number_text, usage_measures

# the processors travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


# --- stories --------------------------------------------------------------------------


class StoryIndex:
    """Stories by their words, those still in time. A title is compared with those that have several of the words it cannot do without."""

    HITS = 4

    def __init__(self) -> None:
        self.stories: dict[int, tuple[str, frozenset[str], list[str]]] = {}
        self.by_word: dict[str, dict[int, None]] = {}
        self.by_prefix: dict[str, dict[int, None]] = {}
        self.seen: list[tuple[int, int]] = []
        self.number = 0

    def _needed(self, size: int) -> tuple[int, int]:
        """Words that a set of this size shares with a larger one, and how many of them are looked for in its prefix."""
        needed = math.ceil(size * MIN_SHARE - 1e-9)
        return needed, min(self.HITS, needed)

    def _prefix(self, words: frozenset[str]) -> list[str]:
        """If a set as large or larger shares enough words, it has several of these; the rarest so far are chosen."""
        needed, hits = self._needed(len(words))
        by_word, none = self.by_word, ()
        return [w for _, w in sorted((len(by_word.get(w, none)), w) for w in words)[: len(words) - needed + hits]]

    def add(self, item_id: str, seen: int, words: frozenset[str]) -> None:
        if len(words) >= MIN_WORDS:
            prefix = self._prefix(words)
            for index, named in ((self.by_word, words), (self.by_prefix, prefix)):
                for word in named:
                    index.setdefault(word, {})[self.number] = None
            self.stories[self.number] = (item_id, words, prefix)
            heapq.heappush(self.seen, (seen, self.number))
        self.number += 1

    def forget(self, since: int) -> None:
        """Stories seen before that match nothing any more."""
        while self.seen and self.seen[0][0] < since:
            number = heapq.heappop(self.seen)[1]
            _, words, prefix = self.stories.pop(number)
            for index, named in ((self.by_word, words), (self.by_prefix, prefix)):
                for word in named:
                    held = index[word]
                    del held[number]
                    if not held:
                        del index[word]

    def first_match(self, words: frozenset[str], since: int) -> str | None:
        """The first story added that is told again; what was seen before ``since`` is forgotten."""
        self.forget(since)
        size = len(words)
        if size < MIN_WORDS:
            return None
        own = Counter(n for w in self._prefix(words) for n in self.by_word.get(w, ()))
        theirs = Counter(n for w in words for n in self.by_prefix.get(w, ()))
        hits = self._needed(size)[1]
        near = {n for n, found in own.items() if found >= hits}
        near.update(n for n, found in theirs.items() if found >= self._needed(len(self.stories[n][1]))[1])
        for n in sorted(near):
            item_id, other, _ = self.stories[n]
            if len(words & other) / min(size, len(other)) >= MIN_SHARE:
                return item_id
        return None


class StoryMemory(StatefulProcessor):
    """Remembers the fresh items of an account for some days."""

    def __init__(self, days: int, delay_ms: int):
        self.days, self.delay_ms = days, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fresh = handle.getListState("fresh", "item_id STRING, seen BIGINT, words STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["seen", "input_ord", "item_id"])
        index, keep = StoryIndex(), self.days * DAY_MS
        ids = {}
        # items come in the order of time: what the first of them can't reach, none can
        oldest, before = int(batch["seen"].iloc[0]) - keep, []
        for item_id, seen, words in self.fresh.get():
            before.append((item_id, int(seen), words))
            ids[item_id] = seen
            if seen >= oldest:
                index.add(item_id, seen, frozenset(words.split()))
        added, out = [], []
        for item_id, seen, text in zip(batch["item_id"], batch["seen"], batch["words"], strict=True):
            words, since = frozenset(text.split()), seen - keep
            story = item_id if ids.get(item_id, since - 1) >= since else index.first_match(words, since)
            out.append((key[0], item_id, "fresh" if story is None else "repeated", story or item_id))
            if story is None:
                index.add(item_id, seen, words)
                ids[item_id] = seen
                added.append((item_id, int(seen), text))
        # what no item in time can reach any more is not kept, however long the batch was
        cut = max(int(batch["seen"].max()) - self.delay_ms, timerValues.getCurrentWatermarkInMs()) - keep
        alive, added = [x for x in before if x[1] >= cut], [x for x in added if x[1] >= cut]
        if len(alive) < len(before):
            if alive or added:
                self.fresh.put(alive + added)
            else:
                self.fresh.clear()
        elif added:
            self.fresh.appendList(added)
        if added:
            # when the last of them has been forgotten by all items in time
            self.handle.registerTimer(max(x[1] for x in added) + keep + 1)
        yield pd.DataFrame(out, columns=["account_id", "item_id", "novelty", "story_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        oldest = timerValues.getCurrentWatermarkInMs() - self.days * DAY_MS
        alive = [tuple(x) for x in self.fresh.get() if x[1] >= oldest]
        if alive:
            self.fresh.put(alive)
        else:
            self.fresh.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_stories(items: DataFrame, days: int = NEWS_RETENTION_DAYS, delay: str = "1 day") -> DataFrame:
    """(account_id, item_id, novelty, story_id) of each item of a stream (account_id, item_id, input_ord, title, seen_at).

    An item is ``repeated`` if its id, or the story of its title, is that of a fresh item of the account seen at most
    ``days`` before it, and ``story_id`` names the first such item; else it is ``fresh`` and remembered. In a batch
    items count by seen_at, input_ord and id. Titles of less than three words are only known by their id. What no item
    within ``delay`` of the newest one can reach is forgotten; older items are judged too, by what is still known.
    """
    worded = items.withWatermark("seen_at", delay).select("account_id", "item_id", "input_ord", F.unix_millis("seen_at").alias("seen"), F.array_join(story_words("title"), " ").alias("words"))
    return worded.groupBy("account_id").transformWithStateInPandas(
        StoryMemory(days, int(pd.Timedelta(delay) / pd.Timedelta(milliseconds=1))), "account_id STRING, item_id STRING, novelty STRING, story_id STRING", "Append", "EventTime",
    )


# --- usage ----------------------------------------------------------------------------


class OpenBuckets(StatefulProcessor):
    """The points of the buckets that the watermark has not passed; a timer at a bucket's end makes it final."""

    COLUMNS = ["kind", "account_id", "metric", "bucket_ms", "instant_ms", "value", "unit", "points", "input_rows", "received_ms"]

    def __init__(self, interval_ms: int):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one entry a bucket: its points as JSON, {instant: [-received, value text, unit, value]}, and how many rows made them
        self.buckets = handle.getMapState("buckets", "bucket BIGINT", "points STRING, input_rows BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows)
        bucket = batch["instant_ms"] - batch["instant_ms"] % self.interval_ms
        closed = bucket + self.interval_ms <= timerValues.getCurrentWatermarkInMs()
        late = batch[closed]
        if len(late):
            yield late.assign(kind="late", account_id=key[0], metric=key[1], bucket_ms=bucket[closed], points=1, input_rows=1)[self.COLUMNS]
        for start, part in batch[~closed].groupby(bucket[~closed]):
            start = int(start)
            points, counted = {}, 0
            if self.buckets.containsKey((start,)):
                text, counted = self.buckets.getValue((start,))
                points = json.loads(text)
            else:
                self.handle.registerTimer(start + self.interval_ms - 1)
            for instant, received, text, unit, value in zip(part["instant_ms"], part["received_ms"], part["value_text"], part["unit"], part["value"], strict=True):
                point = [-int(received), text, unit, float(value)]
                points[str(instant)] = min(points.get(str(instant), point), point)
            self.buckets.updateValue((start,), (json.dumps(points), int(counted) + len(part)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = int(expiredTimerInfo.getExpiryTimeInMs()) + 1 - self.interval_ms
        text, counted = self.buckets.getValue((start,))
        points = [x for _, x in sorted((int(k), x) for k, x in json.loads(text).items())]
        self.buckets.removeKey((start,))
        row = ("bucket", key[0], key[1], start, None, math.fsum(x[3] for x in points), min(x[2] for x in points), len(points), int(counted), -min(x[0] for x in points))
        yield pd.DataFrame([row], columns=self.COLUMNS).astype({"instant_ms": "Int64"})

    def close(self) -> None:
        pass


def stream_usage_buckets(rows: DataFrame, interval_hours: int = 24, delay: str = "2 hours") -> DataFrame:
    """Final usage buckets, and every row that came too late for one: ``kind`` is ``bucket`` or ``late``.

    Arrival order is free. The watermark is ``delay`` behind the newest observation of the batches before; a bucket is
    final once it has passed the bucket's end, and is returned then, once. A row of a final bucket is returned
    by itself, as a side output, with its instant; rows of open buckets count, so no row is lost: those counted in
    buckets (``input_rows``), those late and those in still open buckets are all rows. A point is one value an instant, of
    the latest receipt, in base units, as in the batch operators.
    """
    marked = usage_measures(rows).withWatermark("observed_at", delay)
    # an instant of its own: Spark drops late rows by the watermarked column itself
    plain = marked.select(
        "account_id", "metric", F.unix_millis("observed_at").alias("instant_ms"), F.unix_millis("received_at").alias("received_ms"),
        "value", number_text(F.col("value")).alias("value_text"), "unit",
    )
    found = plain.groupBy("account_id", "metric").transformWithStateInPandas(
        OpenBuckets(interval_hours * 3_600_000),
        "kind STRING, account_id STRING, metric STRING, bucket_ms BIGINT, instant_ms BIGINT, value DOUBLE, unit STRING, points BIGINT, input_rows BIGINT, received_ms BIGINT",
        "Append", "EventTime",
    )
    times = {name: F.timestamp_millis(f"{name}_ms") for name in ("bucket", "instant", "received")}
    return found.select(
        "kind", "account_id", "metric", times["bucket"].alias("bucket_start"), times["instant"].alias("observed_at"), "value", "unit", "points", "input_rows", times["received"].alias("received_at"),
    )


# --- snapshots ------------------------------------------------------------------------


class LastSnapshot(StatefulProcessor):
    """The postings of an account's last snapshot; the next one replaces them. A call reads one state value and writes one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the postings as JSON, {job_id: record}
        self.last = handle.getValueState("last", "captured BIGINT, postings STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        snapshots: dict[int, list[Row]] = {}
        for row in rows:
            if row.captured is not None:
                snapshots.setdefault(row.captured, []).append(row)
        held = self.last.get()
        taken, last = (None, {}) if held is None else (held[0], json.loads(held[1]))
        newest = taken
        for captured in sorted(snapshots):
            if newest is not None and captured <= newest:
                continue  # a repeated or older snapshot
            ordered = sorted(snapshots[captured], key=lambda r: (r.input_ord is None, r.input_ord or 0))
            current = {r.job_id: r.record for r in ordered if r.job_id is not None}
            if newest is not None:
                changes = []
                for job_id in sorted({*last, *current}):
                    before, after = last.get(job_id), current.get(job_id)
                    changes.append((job_id, "added" if before is None else "removed" if after is None else "unchanged" if before == after else "changed", before, after))
                if changes:
                    yield Row(account_id=key[0], captured=captured, changes=json.dumps(changes))
            last, newest = current, captured
        if newest != taken:
            self.last.update((newest, json.dumps(last)))

    def close(self) -> None:
        pass


def stream_snapshot_changes(postings: DataFrame) -> DataFrame:
    """added / removed / changed / unchanged jobs of each snapshot against the account's last one.

    ``postings``: account_id, captured_at, job_id, the job fields, input_ord. The rows of an account with one captured_at
    are a snapshot and arrive in one batch; a row without a job_id stands for an empty one. Of rows of one job the last by
    input_ord counts. The first snapshot is the baseline and reports nothing; one that is not newer than the last
    is ignored. The state holds an account's live postings, whatever its history.
    """
    record = F.to_json(F.struct(*JOB_FIELDS), {"ignoreNullFields": "false"})
    plain = postings.select("account_id", "job_id", F.unix_millis("captured_at").alias("captured"), "input_ord", record.alias("record"))
    # accounts are many and small: rows travel in batches of many accounts, not as a frame each
    found = plain.groupBy("account_id").transformWithState(
        LastSnapshot(), "account_id STRING, captured BIGINT, changes STRING", "Append", "None",
    )
    # a snapshot's changes leave the state as one row: [job_id, change, before, after] each
    change = F.explode(F.from_json("changes", "array<array<string>>")).alias("c")
    found = found.select("account_id", "captured", change).select("account_id", "captured", *[F.get("c", F.lit(k)).alias(name) for k, name in enumerate(("job_id", "change", "before", "after"))])
    kinds = {field.name: field.dataType.simpleString() for field in postings.schema}
    shape = ", ".join(f"{name} {kinds[name]}" for name in JOB_FIELDS)
    return found.select("account_id", "job_id", F.timestamp_millis("captured").alias("captured_at"), "change", F.from_json("before", shape).alias("before"), F.from_json("after", shape).alias("after"))
