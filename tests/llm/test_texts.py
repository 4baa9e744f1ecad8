"""Fingerprints, repeated passages and contamination next to plain versions of their rules."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import LOWER, documents, nothing, odd_texts, sentence
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, simhash, substrings
from tidemark.llm.components import smallest_reachable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    ones = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            ones[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def plain_groups(prints):
    """Smallest id of each component of prints with at most four differing bits."""
    rows = list(prints)
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                group[find(i)] = find(j)
    ids = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        ids[find(k)].append(doc_id)
    return [min((x for x in ids[find(k)] if x is not None), default=None) for k in range(len(rows))]


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_simhash_groups(spark):
    rows = odd_texts()
    prints = [(k, plain_print(text)) for k, text in rows]
    want = Counter((k, p, g) for (k, p), g in zip(prints, plain_groups(prints), strict=True))
    got = simhash.near_duplicates(documents(spark)).collect()
    assert Counter((r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(nothing(spark)).collect() == []


@pytest.mark.parametrize("block", [3, 1024])
def test_links_of_large_buckets(spark, block):
    # one cloud of near prints, more than a block of them, and chains that leave it
    rng = random.Random(4)
    center = rng.getrandbits(64)
    prints = {center}
    while len(prints) < 60:
        value = rng.choice(sorted(prints))
        for _ in range(rng.randrange(1, 5)):
            value ^= 1 << rng.randrange(64)
        prints.add(value)
    prints |= {rng.getrandbits(64) for _ in range(40)}
    signed = sorted(int(np.uint64(x).astype(np.int64)) for x in prints)
    table = spark.createDataFrame([(x,) for x in signed], "print long")
    edges = simhash.links(table, block=block)
    assert all((int(r["a"]) ^ int(r["b"])) % (1 << 64) and bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= 4 for r in edges.collect())
    reach = smallest_reachable(edges, table.select(F.col("print").alias("node"), F.col("print").alias("smallest")))
    got = {r["node"]: r["smallest"] for r in reach.collect()}
    want = plain_groups([(x, x % (1 << 64)) for x in signed])
    assert got == dict(zip(signed, want, strict=True))


def test_signatures_are_not_broadcast(spark):
    # sized like their prints, they would be, where the prints are few enough
    table = spark.createDataFrame([(k * 0x9E3779B97F4A7C1 % (1 << 62),) for k in range(50)], "print long")
    plan = simhash.links(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long").repartition(7)
    nodes = spark.createDataFrame([(k, k + 5) for k in [*range(301), 1000, 1001, 2000]], "node long, smallest long")
    got = {r["node"]: r["smallest"] for r in smallest_reachable(edges, nodes).collect()}
    assert got == {**{k: 5 for k in range(301)}, 1000: 1005, 1001: 1005, 2000: 2005}


def plain_removal(rows, window):
    words = [WORD.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substrings_of_odd_texts(spark):
    got = substrings.remove_duplicate_spans(documents(spark)).drop("factors").collect()
    assert counted(got) == Counter(plain_removal(odd_texts(), 35))
    assert substrings.remove_duplicate_spans(nothing(spark)).collect() == []


@pytest.mark.parametrize(("window", "anchor", "vocabulary"), [(5, 2, 2), (6, 3, 4), (4, 1, 3)])
def test_substrings_of_few_words(spark, window, anchor, vocabulary):
    # few different words: windows overlap their own copies, anchors are shared by chance all the time
    rng = random.Random(window)
    rows = [(k, sentence(rng, rng.randrange(0, 30), vocabulary)) for k in range(60)]
    got = substrings.remove_duplicate_spans(documents(spark, rows), window=window, anchor=anchor)
    assert counted(got.drop("factors").collect()) == Counter(plain_removal(rows, window))


def test_repeated_passages_that_others_begin_with(spark):
    # two texts share a passage to its end, a third only its beginning: the phrase is found twice and ends a match as well
    rng = random.Random(4)
    rows = []
    for k in range(0, 90, 3):
        passage = sentence(rng, 60, 100_000)
        rows += [(k, passage), (k + 1, f"z{k} {passage}" if k % 2 else passage), (k + 2, " ".join(passage.split()[: rng.randrange(36, 60)]) + f" u{k}")]
    got = substrings.remove_duplicate_spans(documents(spark, rows)).drop("factors").collect()
    assert counted(got) == Counter(plain_removal(rows, 35))


def test_factors_point_to_equal_words(spark):
    rng = random.Random(9)
    passage = sentence(rng, 50, 1000)
    rows = [(k, f"{sentence(rng, 5, 1000)} {passage} {sentence(rng, 6, 1000)}") for k in range(3)]
    factors = {r["doc_id"]: r["factors"] for r in substrings.remove_duplicate_spans(documents(spark, rows)).collect()}
    assert {(f["start"], f["size"]) for found in factors.values() for f in found} >= {(5, 50)}


def test_phrases_cover_each_window_once():
    rng = random.Random(2)
    texts = [sentence(rng, n, 3) for n in (0, 3, 34, 35, 36, 90, 200)]
    runs = substrings.Runs(pa.array(texts))
    found = substrings.phrases(runs, 35, 6)
    for number, text in enumerate(texts):
        own = found["text"] == number
        windows = [w for a, b in zip(found["a"][own], found["b"][own], strict=True) for w in range(a, b + 1)]
        assert windows == list(range(max(0, len(text.split()) - 34)))


def plain_contamination(rows, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        if words:
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                windows[tuple(words[i : i + size])].add(str(item) if item is not None else "")
    out = []
    for doc_id, text in rows:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = [0] * len(words), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if items_here := windows.get(tuple(words[i : i + size])):
                    found |= items_here
                    hit[i : i + size] = [1] * size
        out.append((doc_id, len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(words)))
    return out


def bench_rows():
    texts = dict((k, t) for k, t in odd_texts() if k is not None)
    passage = " ".join(texts[50].split()[12:52])
    return [(1, passage.upper()), (2, "same, ID"), (2, "same, ID"), (3, None), (4, "?!"), (None, "één"), (5, " ".join(texts[9].split()[:13])), (6, "la " * 14), (10, "not in any document at all")]


@pytest.mark.parametrize("pass_words", [1_000_000, 40])
def test_contamination(spark, pass_words):
    bench = spark.createDataFrame([(k, t, "x", "y") for k, t in bench_rows()], "item_id long, text string, item string, block string")
    got = decontaminate.contamination(documents(spark), bench, pass_words=pass_words).drop("items").collect()
    assert counted(got) == Counter(plain_contamination(odd_texts(), bench_rows()))


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    assert decontaminate.contamination(nothing(spark), bench).collect() == []
    clean = decontaminate.contamination(documents(spark), bench.limit(0)).collect()
    assert len(clean) == len(odd_texts()) and not any(r["contaminated"] or r["n_hit"] for r in clean)


def test_phrase_and_proximity_matches(spark):
    docs = documents(spark, [(1, "aa bb cc dd aa bb"), (2, "dd zz cc bb aa"), (3, "aa zz zz zz zz zz zz zz zz bb cc dd")])
    bench = spark.createDataFrame([(9, "aa bb cc dd")], "item_id long, text string")
    exact, _ = decontaminate.matches(docs, bench)
    assert [(r["doc_id"], r["item_id"], r["doc_start"], r["size"]) for r in exact.collect()] == [(1, "9", 0, 4)]
    near, _ = decontaminate.matches(docs, bench, proximity=(4, 4))
    assert {r["doc_id"] for r in near.collect()} == {1, 2}
