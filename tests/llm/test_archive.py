"""Manifest, vector codes and repeated byte strings against plain versions of their rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import documents, nothing, odd_texts
from pyspark.sql import functions as F

from tidemark.llm import suffixes
from tidemark.llm.manifest import merkle_manifest
from tidemark.llm.suffixes import Transform, cut_by_anchors, merged_repeats, remove_repeated_bytes
from tidemark.llm.vector_codes import TrieWalk, codebooks_digest, encode, nearest_entries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(hashes):
    """(root, siblings of each leaf as lists of (left, right))."""
    paths = [[] for _ in hashes]
    owners = [[k] for k in range(len(hashes))]
    level = list(hashes)
    while len(level) > 1:
        above, above_owners = [], []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            for slot in range(len(run)):
                for k in owners[at + slot]:
                    paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            above.append(sha("".join(run)))
            above_owners.append([k for one in owners[at : at + 16] for k in one])
        level, owners = above, above_owners
    return (level[0] if level else None), paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        leaves = [(row["doc_id"] is not None, row["doc_id"] or 0, leaf_of([row[c] for c in COLUMNS]), row) for row in groups[source]]
        leaves.sort(key=lambda x: x[:3])
        trees.append((leaves, *plain_tree([x[2] for x in leaves])))
    root, tops = plain_tree([subroot for _, subroot, _ in trees])
    out = []
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for (_, _, leaf, row), path in zip(leaves, paths, strict=True):
            values = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None:
                values["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])
            node = leaf_of([values[c] for c in COLUMNS])
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((str(row["doc_id"]), leaf, subroot, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out)


def manifest_of(docs):
    suspect = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    lowered = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = merkle_manifest(docs, COLUMNS, "source", "doc_id", suspect, {"text": lowered})
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in out.collect())


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(5)
    rows = [(k, text, None, f"s{rng.randrange(19)}" if rng.random() < 0.5 else "hot", None) for k, text in odd_texts()]
    rows += [(1000 + k, f"Text {k}", "en", "hot", k) for k in range(700)]  # three levels
    rows += [(5, "One Leaf", "en", None, 8), (9, "b", None, "ä", 1)] + [(5000 + k % 3, "Same", "en", "many", 4) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hash", F.lit("clash")).withColumn("idx", F.lit("clash"))
    got = manifest_of(docs.repartition(5))
    assert got == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row, strict=True)) for row in rows])
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = documents(spark, [(1, "Alone")])
    (row,) = merkle_manifest(one, COLUMNS, "source", "doc_id").collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["path"] == [] and row["proof_sha256"] == sha("")
    assert merkle_manifest(nothing(spark), COLUMNS, "source", "doc_id").collect() == []


def test_manifest_is_the_same_however_the_rows_are_dealt(spark):
    rows = [(k, f"t{k % 7}") for k in range(300)] + [(None, "x")] * 40
    assert manifest_of(documents(spark, rows).coalesce(1)) == manifest_of(documents(spark, rows).repartition(9))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(k, label, [int(np.floor(4096 * float(x))) for x in v]) for k, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    width = len(kept[0][2]) // parts
    books = [[v[p * width : (p + 1) * width] for _, _, v in kept[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            got = {}
            for _, _, v in kept:
                part = v[p * width : (p + 1) * width]
                got.setdefault(nearest(p, part)[1], []).append(part)
            moved.append([[sum(x) // len(got[k]) for x in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])])
        books = moved
    found = [(k, label, [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]) for k, label, v in kept]
    by_label = {}
    for _, label, x in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in x)
    return sorted((str(k), [c for _, c in x], sum(d for d, _ in x), by_label[label]) for k, label, x in found), hashlib.sha256(
        ",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def vectors(spark, rows):
    full = [(*row, "other", "other", "other") for row in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, vector string, codes string, position string").repartition(3)


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(2)
    rows = [(k, [round(rng.gauss(0, 0.2), 2) for _ in range(16)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [(k, rows[3][1], 1) for k in range(200, 260)] + [rows[7]] * 3 + [(None, rows[9][1], 2)]
    rows += [(300, None, 1), (301, [float("nan")] + [0.0] * 15, 1), (302, [float("inf")] + [0.0] * 15, 1), (303, [None] + [0.0] * 15, None), (304, [], 2)]
    out, books = encode(vectors(spark, rows), "vec_id", "embedding", "label")
    got = sorted((str(r["vec_id"]), r["codes"], r["error"], r["label_error"]) for r in out.collect())
    want, digest = plain_codes(rows)
    assert got == want and codebooks_digest(books) == digest


def test_codes_of_few_vectors_and_of_none(spark):
    rows = [(2, [0.5] * 8, None), (1, [0.25] * 8, None)]
    out, books = encode(vectors(spark, rows), "vec_id", "embedding", "label")
    assert sorted((r["vec_id"], r["codes"], r["error"]) for r in out.collect()) == [(1, [0] * 8, 0), (2, [1] * 8, 0)] and books[0].shape == (2, 1)
    empty, books = encode(vectors(spark, [(1, None, 1)]), "vec_id", "embedding", "label")
    assert empty.collect() == [] and books == []
    with pytest.raises(ValueError):
        encode(vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]), "vec_id", "embedding", "label")


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_the_walk_goes_on_over_stretches(stretch):
    rng = np.random.default_rng(stretch)
    leaves = np.unique(rng.integers(-2, 3, (400, 5)), axis=0)
    book = rng.integers(-3, 4, (6, 5))
    walk = TrieWalk(book)
    found = [walk(leaves[at : at + stretch]) for at in range(0, len(leaves), stretch)]
    distance = ((leaves[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert np.array_equal(np.concatenate([x for x, _ in found]), distance.argmin(axis=1))
    assert np.array_equal(np.concatenate([x for _, x in found]), distance.min(axis=1))
    assert np.array_equal(nearest_entries(leaves[::-1], book)[0], distance.argmin(axis=1)[::-1])


def plain_removal(rows, window):
    texts = [(k, (text or "").encode()) for k, text in rows]
    first = {}
    for k, text in texts:
        for i in range(len(text) - window + 1):
            place = (k is not None, k or 0, i)
            key = text[i : i + window]
            if key not in first or place < first[key]:
                first[key] = place
    out = []
    for k, text in texts:
        gone = [False] * len(text)
        for i in range(len(text) - window + 1):
            if first[text[i : i + window]] < (k is not None, k or 0, i):
                gone[i : i + window] = [True] * window
        kept = bytes(x for x, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(k), len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def odd_bytes():
    rng = random.Random(8)
    rows = [(k, text if text is None else text[:9000]) for k, text in odd_texts()]
    passage = "".join(rng.choice("abcdef é") for _ in range(130))
    rows += [(100 + k, f"{rng.random()}{passage[: 90 + k]}{rng.random()}") for k in range(40)]  # from too short to long enough
    rows += [(200, "ab" * 400), (201, "a" * 300), (202, "b" + "a" * 120), (203, "é" * 70), (204, "\0" * 150), (204, "\0" * 120)]
    return rows


def removed_of(docs, **options):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeated_bytes(docs, **options).collect())


def test_repeated_bytes_equal_brute_force(spark):
    rows = odd_bytes()
    assert removed_of(documents(spark, rows)) == plain_removal(rows, 100)


def test_anchors_of_very_many_pieces_give_the_same(spark):
    rows = odd_bytes()
    assert removed_of(documents(spark, rows), merged=3) == plain_removal(rows, 100)


def test_small_units_and_another_window_give_the_same(spark, monkeypatch):
    rows = [(k, text) for k, text in odd_bytes() if k is None or k >= 50 and k < 210]
    assert removed_of(documents(spark, rows), window=40, anchor=12) == plain_removal(rows, 40)


def test_removed_runs_and_what_is_kept_make_the_text(spark):
    rows = odd_bytes()
    texts = {}
    for k, text in rows:
        texts.setdefault(k, []).append((text or "").encode())
    for row in remove_repeated_bytes(documents(spark, rows)).collect():
        assert sum(x["size"] for x in row["removed"]) == row["n_removed"] and len(row["removed"]) == row["n_spans"]

        def without(text, row=row):
            for x in reversed(row["removed"]):
                text = text[: x["start"]] + text[x["start"] + x["size"] :]
            return text

        assert any(without(text) == bytes(row["kept"]) for text in texts[row["doc_id"]])


def test_no_rows_no_result(spark):
    assert remove_repeated_bytes(nothing(spark)).collect() == []
    with pytest.raises(ValueError):
        remove_repeated_bytes(nothing(spark), window=99)


def test_merged_transforms_give_the_intervals_of_sorted_suffixes():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 60))) for _ in range(30)] + [b"ab" * 20] * 2
    depth = 6
    shards = [(0, Transform(strings[:9], depth)), (9, Transform(strings[9:10], depth)), (10, Transform(strings[10:], depth))]
    rows, begins = merged_repeats([x for _, x in shards], depth)
    string = np.concatenate([x.string + a for a, x in shards])[rows]
    place = np.concatenate([x.place for _, x in shards])[rows]
    got = [sorted(zip(string[a:b].tolist(), place[a:b].tolist(), strict=True)) for a, b in zip(begins, [*begins[1:], len(rows)], strict=True)]
    classes = {}
    for s, text in enumerate(strings):
        for i in range(len(text) - depth + 1):
            classes.setdefault(text[i : i + depth], []).append((s, i))
    # intervals in the order of their strings
    assert got == [classes[key] for key in sorted(classes) if len(classes[key]) > 1]


def test_rows_of_a_transform_are_sorted_suffixes():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 300))) for _ in range(20)]
    shard = Transform(strings, 100)
    suffix = [strings[s][p : p + 100] for s, p in zip(shard.string.tolist(), shard.place.tolist(), strict=True)]
    assert suffix == sorted(suffix)
    for k in np.flatnonzero(shard.steps >= 0):
        s, p = shard.string[k], shard.place[k]
        assert (shard.string[shard.steps[k]], shard.place[shard.steps[k]]) == (s, p - 2)
        assert int(shard.before[k]).to_bytes(2, "big") == strings[s][p - 2 : p]


def test_equal_windows_lie_in_pieces_of_equal_anchors():
    rng = random.Random(6)
    shared = bytes(rng.randrange(256) for _ in range(400))
    data = bytes(rng.randrange(256) for _ in range(77)) + shared + bytes(rng.randrange(256) for _ in range(50)) + shared
    bounds = np.array([0, 77 + 400 + 25, len(data)])
    owner, a, b, anchor = cut_by_anchors(np.frombuffer(data, np.uint8), bounds, 100, 32)
    of = {}
    for o, x, y, g in zip(owner, a, b, anchor, strict=True):
        for i in range(x, y + 1):
            assert of.setdefault(data[bounds[o] + i : bounds[o] + i + 100], g) == g
    assert suffixes.WINDOW == 100
