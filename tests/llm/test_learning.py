"""Mixing rates, co-training and the pipeline."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from cases import documents, nothing, sentence
from pyspark.sql import functions as F
from test_tables import plain_ids
from test_texts import bench_rows, plain_contamination, plain_groups, plain_print

from tidemark.llm import features, mixing, quality
from tidemark.llm.common import written


def plain_rates(n, p, want, rounds=20_000):
    """Projected gradient with plain steps in the same metric."""
    rate = np.ones(len(n))
    inverse = np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in range(rounds):
        rate = np.maximum(0, rate - p @ inverse @ ((rate * n) @ p - want))
    return rate


def members(spark, n, p):
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)]
    return spark.createDataFrame(rows, "n long, p array<double>")


def rates(spark, rows, steps):
    return np.array([r["r"] for r in rows.withColumn("r", mixing.rate_after(F.col("p"), F.lit(1.0), steps)).collect()])


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.2, 0.2, 0.2], 200)
    n = rng.integers(1, 500, 200).astype(float)
    rows = members(spark, n, p)
    targets = {"a": 0.1, "b": 0.2, "c": 0.7}
    steps, off = mixing.fit_rates(rows, ["a", "b", "c"], targets)
    got = rates(spark, rows, steps)
    order = rows.collect()
    n, p = np.array([r["n"] for r in order], float), np.array([r["p"] for r in order])
    assert off < 1e-4 and (got >= 0).all()
    assert np.allclose((got * n) @ p / n.sum(), [0.1, 0.2, 0.7], atol=1e-4)
    # the targets' least squares value is zero: what plain steps reach as well
    assert np.allclose((plain_rates(n, p, np.array([0.1, 0.2, 0.7]) * n.sum()) * n) @ p / n.sum(), [0.1, 0.2, 0.7], atol=1e-3)


def test_targets_out_of_reach_are_approached(spark):
    # every document is at least three tenths b: b = 0 can't be met
    rng = np.random.default_rng(2)
    b = 0.3 + 0.7 * rng.random(100)
    p = np.stack([1 - b, b], axis=1)
    n = np.full(100, 10.0)
    rows = members(spark, n, p)
    steps, off = mixing.fit_rates(rows, ["a", "b"], {"a": 1.0, "b": 0.0}, rounds=25)
    got = rates(spark, rows, steps)
    p = np.array([r["p"] for r in rows.collect()])
    want = np.array([1000.0, 0.0])
    inverse = np.linalg.pinv((p * n[:, None]).T @ p)

    def objective(rate):
        left = (rate * n) @ p - want
        return left @ inverse @ left

    assert off > 0.01 and objective(got) <= objective(plain_rates(n, p, want, 25)) * 1.01 < objective(np.ones(100))
    with pytest.raises(ValueError):
        mixing.fit_rates(rows, ["a", "b"], {"z": 1.0})


def labelled_rows(n=400):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        text = sentence(rng, rng.randrange(5, 40), 300)
        text = " ".join(w + "###" for w in text.split()) if bad else text
        rows.append((k, text + (" moron scum" if toxic else "")))
        if k % 3:
            labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def test_mixture_of_labelled_domains(spark):
    rows, labels = labelled_rows()
    rows += [(900, None), (901, ""), (None, "wort1 wort2"), (3, rows[3][1])]
    docs = documents(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    domain = F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic"))
    targets = {"q1t0": 0.9, "q0t0": 0.06, "q1t1": 0.03, "q0t1": 0.01}
    out = mixing.mixed(docs, table, domain, targets, anchor="q1t0")
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.collect()}
    right = sum(got[k]["__domain"] == f"q{q}t{t}" for k, q, t in labels)
    assert right >= 0.97 * len(labels)
    tokens = {d: sum(r["__rate"] * r["__n"] for r in out.collect() if r["__domain"] == d) for d in targets}
    total = sum(tokens.values())
    assert all(abs(tokens[d] / total - share) < 0.04 for d, share in targets.items())
    assert all(r["__copies"] in (int(r["__rate"]), int(r["__rate"]) + 1) for r in got.values())
    assert got[900]["__n"] == 0 and got[901]["__n"] == 0


def test_mixture_knows_rare_telling_words(spark):
    """Two hundred words mark toxic documents, each in eight of them and every document by few words."""
    rng = random.Random(13)
    marks = [f"mark{k}" for k in range(200)] * 8
    rows = [(k, sentence(rng, 5, 5) + " " + " ".join(marks[8 * k : 8 * k + 8])) for k in range(200)]
    rows += [(k, sentence(rng, 8, 5)) for k in range(200, 2000)]
    table = spark.createDataFrame([(k, int(k < 200)) for k, _ in rows], "doc_id long, toxic int")
    model = mixing.fit_domains(documents(spark, rows), table, F.col("toxic").cast("string"))
    assert set(marks) <= set(model.lexicon)


def test_mixture_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "one two"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, none, F.col("quality").cast("string"), {"1": 1.0}).collect()
    assert [(r["__rate"], r["__copies"], r["__domain"]) for r in out] == [(1.0, 1, None)] * 2
    assert mixing.mixed(nothing(spark), none, F.col("quality").cast("string"), {"1": 1.0}).collect() == []


def test_telling_features_match_a_plain_count(spark):
    rows, labels = labelled_rows(200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = written(features.labelled(documents(spark, rows), table, [F.col("toxic")], "doc_id", "text", "doc_id"), "sample")
    found = {r["feature"] for r in features.telling_features(sample, "label0", 10).collect()}
    assert {"moron", "scum"} <= found


def page_rows():
    return [(k, f"https://a{k}.site{k % 3}.org/x/y?z=1", "<p>x</p>") for k in range(0, 400, 2)] + [(2, None, None), (None, "http://b.org", "x")]


def test_co_training_scores(spark):
    rows, labels = labelled_rows()
    known = [x for x in labels if x[0] % 2]
    docs = documents(spark, [*rows, (900, None), (None, "wort1 moron scum"), (3, rows[3][1])])
    table = spark.createDataFrame([*known, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    out = quality.scored(docs, table, pages, {"quality": F.col("quality"), "toxic": F.col("toxic")}).collect()
    assert len(out) == len(rows) + 3
    got = {r["doc_id"]: r for r in out}
    unseen = [x for x in labels if not x[0] % 2]
    for name, column in (("quality", 1), ("toxic", 2)):
        assert sum((got[x[0]][name] >= 0.5) == bool(x[column]) for x in unseen) >= 0.95 * len(unseen)
    assert got[None]["toxic"] > 0.5 and all(0 <= r[x] <= 1 for r in out for x in ("quality", "toxic", "quality_meta", "toxic_text"))


def test_views_teach_each_other():
    """The text view knows words that no label shows; it learns them from the metadata view's pseudo-labels."""
    rng = np.random.default_rng(3)
    bad, seen = rng.random(1800) < 0.5, np.arange(1800) < 600
    names = {"text": ["bad1", "bad2", "good1", "good2"], "meta": ["host=spam", "host=fine"]}
    text = np.stack([bad & seen, bad & ~seen, ~bad & seen, ~bad & ~seen], axis=1).astype(np.float32)
    tables = {"text": text, "meta": np.stack([bad, ~bad], axis=1).astype(np.float32)}
    label, fold = np.where(seen, bad, np.nan), np.arange(1800) % 5
    alone, _, _ = quality.co_train(tables, names, label, fold, rounds=0)
    taught, _, _ = quality.co_train(tables, names, label, fold, rounds=3)
    assert alone.weights[1] == pytest.approx(0, abs=1e-6)
    assert taught.weights[1] > 0.5 and taught.weights[3] < -0.5


def test_all_rows_without_a_label_take_part(spark):
    """A word that no labelled document has is learned, though few of the very many other documents have it."""
    rng = np.random.default_rng(4)
    bad = rng.random(12_600) < 0.5
    seen, late = np.arange(12_600) < 600, np.arange(12_600) >= 12_000
    names = {"text": ["bad1", "bad2", "good1"], "meta": ["host=spam", "host=fine"]}
    text = np.stack([bad & ~late, bad & late, ~bad], axis=1).astype(np.float32)
    tables = {"text": text, "meta": np.stack([bad, ~bad], axis=1).astype(np.float32)}
    label, fold = np.where(seen, bad, np.nan), np.arange(12_600) % 5
    at_hand = quality.co_train(tables, names, label, fold)
    assert at_hand[0].weights[1] > 0.5

    # the same from a table of column numbers, summed by Spark
    lists = {view: [np.flatnonzero(row).tolist() for row in table] for view, table in tables.items()}
    rows = [(None if np.isnan(x) else int(x), a, b) for x, a, b in zip(label, lists["text"], lists["meta"], strict=True)]
    table = written(spark.createDataFrame(rows, "label0 int, text_label0 array<int>, meta_label0 array<int>").repartition(3), "rows")
    free = quality.free_rows(table, {("h", "text"): 3, ("h", "meta"): 2}, {"h": "label0"})
    known = quality.Known({view: x[seen] for view, x in tables.items()}, names, label[seen], fold[seen])
    by_spark = quality.teach({"h": known}, free)["h"]
    assert all(np.allclose(a.weights, b.weights, atol=1e-6) for a, b in zip(at_hand[:2], by_spark[:2], strict=True))
    past = [{("h", view): (model.weights * model.slope, model.begin * model.slope + model.shift) for view, model in zip(("text", "meta"), by_spark, strict=False)}]
    assert free(quality.Ask(past, [("h", "text")])).sum() == (~seen).sum()


def test_scores_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    out = quality.scored(documents(spark, [(1, "one two"), (2, None)]), none, pages, {"quality": F.col("quality")}).collect()
    assert {r["doc_id"]: r["quality"] for r in out} == {1: 0.5, 2: 0.5}
    assert quality.scored(nothing(spark), none, pages, {"quality": F.col("quality")}).collect() == []


# ---- pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = labelled_rows(150)
    texts = {k: t for k, t in rows}
    rows += [(200, texts[4]), (201, texts[4] + " wort9"), (202, "1234 --"), (203, None), (204, ""), (205, bench_rows()[0][1]), (206, f"{bench_rows()[0][1]} {sentence(rng, 20)}")]
    folder = tmp_path_factory.mktemp("corpus")
    full = [(k, t, "en", "s", len(t or ""), "extra") for k, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, print string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench_rows(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = written(stage(spark, docs, corpus), f"stage{number}")
        after = docs.collect()
        if number < 4:
            assert docs.columns == columns, name
            ids = [r["doc_id"] for r in after]
            assert {(r["doc_id"], r["text"]) for r in after} <= set(before)
        if number == 0:
            assert sorted(ids) == sorted(k for k, t in before if any(c.isalpha() for c in t or ""))
        elif number == 1:
            groups = plain_groups([(k, plain_print(t)) for k, t in before])
            assert sorted(ids) == sorted(set(groups))
        elif number == 2:
            clean = [r[0] for r in plain_contamination(before, bench_rows()) if not r[-1]]
            assert sorted(ids) == sorted(clean) and len(clean) < len(before)
        elif number == 3:
            toxic = {k for k, t in before if "moron" in t}
            assert sum(k in toxic for k in ids) < 0.3 * len(toxic) and len(set(ids)) > 0.5 * len(before)
        else:
            want = sorted((k, len(plain_ids(t)), zlib.crc32(np.array(plain_ids(t), "<u4").tobytes())) for k, t in before)
            assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == want
            order = sorted(after, key=lambda r: r["start"])
            assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order[:-1]]]).tolist()
            assert [r["doc_id"] for r in order] == sorted(r["doc_id"] for r in order)


def test_pipeline_runs(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_pipeline_keeps_rows_without_or_with_repeated_ids(spark, corpus):
    rng = random.Random(22)
    own = [sentence(rng, 30, 3000) for _ in range(8)]
    spoiled = bench_rows()[0][1]
    rows = [
        (None, own[0]), (None, own[1]), (None, own[1] + ""), (None, own[2]), (1, own[2]), (2, own[3]), (2, own[4]), (2, own[4]),
        (3, own[5]), (3, spoiled), (None, spoiled), (4, own[6]), (5, own[6]),
    ]
    full = [(k, t, "en", None if n % 2 else "s", len(t), "extra") for n, (k, t) in enumerate(rows)]
    docs = written(spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, print string").repartition(3), "docs")
    first = written(corpus_pipeline.one_of_each_group(spark, docs, corpus), "first")
    assert first.columns == docs.columns
    want = [(None, own[0]), (None, own[1]), (1, own[2]), (2, own[3]), (2, own[4]), (3, own[5]), (3, spoiled), (4, own[6])]
    assert sorted(((r["doc_id"], r["text"]) for r in first.collect()), key=str) == sorted(want, key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, corpus).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in clean), key=str) == sorted(((k, t) for k, t in rows if t != spoiled), key=str)


def test_mixture_totals_keep_targets_that_nothing_serves(spark):
    rows = [("a", 10, 3), ("a", 10, 1), ("b", 50, 1), ("b", 50, 0), (None, 5, 2)]
    mixture = spark.createDataFrame(rows, "__domain string, __n long, __copies int")
    found = {r["domain"]: (r["documents"], r["tokens"], round(r["share"], 3), r["target"], r["reached"]) for r in mixing.mixture_totals(mixture, {"a": 2.0, "b": 1.0, "c": 1.0}).collect()}
    assert found == {"a": (2, 40, 0.4, 0.5, False), "b": (2, 50, 0.5, 0.25, False), "c": (0, 0, 0.0, 0.25, False), None: (1, 10, 0.1, 0.0, False)}
    empty = mixing.mixture_totals(mixture.limit(0), {"a": 1.0}).collect()
    assert [(r["domain"], r["tokens"], r["share"], r["target"]) for r in empty] == [("a", 0, 0.0, 1.0)]
    even = mixing.mixture_totals(mixture.where("__domain is not null"), {"a": 4.0, "b": 5.0})
    assert all(r["reached"] for r in even.collect())
