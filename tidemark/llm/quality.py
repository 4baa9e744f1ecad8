"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import computed, let
from tidemark.llm.common import as_text, written
from tidemark.llm.features import LABELLED_ROWS, feature_list, matched, telling_features, word_list

#: Features of a text, and names of metadata, that a view of a head knows.
LEXICON = 192
#: Rows of a table of presences that are widened at a time.
BLOCK = 4096
ROUNDS = 4
#: How sure a view has to be of a row that it labels for the other view.
CONFIDENT = 0.97
#: The weight of a row labelled so; all those of a class together weigh no more than its labelled rows.
HANDED_WEIGHT = 0.5
#: One labelled row in five is kept for calibration and never trained on.
CALIBRATION = 5
PENALTY = 1.0


@dataclass
class View:
    """Logistic regression over the presence of named features, and its calibration: slope and shift of the log odds."""

    names: list[str]
    weights: np.ndarray
    begin: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, found: Column) -> Column:
        """Calibrated log odds of a row's features, given as numbers of ``names``."""
        weights = F.lit([float(w) for w in self.weights]) if self.names else F.array().cast("array<double>")
        return F.aggregate(found, F.lit(float(self.begin)), lambda total, k: total + F.get(weights, k)) * float(self.slope) + float(self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def odds_of(table: np.ndarray, weights: np.ndarray, begin: float) -> np.ndarray:
    """Log odds of rows; the table of presences is widened a block at a time."""
    return np.concatenate([np.zeros(0), *(table[at : at + BLOCK].astype(float) @ weights + begin for at in range(0, len(table), BLOCK))])


def slopes(table: np.ndarray, target: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the weighted logistic loss; the last place is the intercept's."""
    gradient, curved = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
    for at in range(0, len(table), BLOCK):
        rows = np.hstack([table[at : at + BLOCK].astype(float), np.ones((len(table[at : at + BLOCK]), 1))])
        p, w = sigmoid(rows @ beta), weight[at : at + BLOCK]
        gradient = gradient + rows.T @ (w * (p - target[at : at + BLOCK]))
        curved = curved + (rows * (w * p * (1 - p) + 1e-9)[:, None]).T @ rows
    return gradient, curved


def newton(own: dict, others: Callable[[dict], dict] | None = None, start: dict | None = None, penalty: float = PENALTY, rounds: int = 30) -> dict:
    """Weights, the intercept last, of several regressions at once, each with few columns.

    ``own`` has table, target and weight of the rows at hand. ``others`` gives the sums of ``slopes`` over all other
    rows for the weights reached, for all regressions that are not done.
    """
    beta = {key: np.zeros(table.shape[1] + 1) if start is None else start[key] for key, (table, _, _) in own.items()}
    going = list(own)
    for _ in range(rounds):
        more = others({key: beta[key] for key in going}) if others is not None else {}
        for key in list(going):
            ridge = np.full(len(beta[key]), penalty)
            ridge[-1] = 1e-6
            gradient, curved = slopes(*own[key], beta[key])
            if key in more:
                gradient, curved = gradient + more[key][0], curved + more[key][1]
            step = np.linalg.solve(curved + np.diag(ridge), gradient + ridge * beta[key])
            beta[key] = beta[key] - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                going.remove(key)
        if not going:
            break
    return beta


def fit_logistic(table: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Newton's method on a bounded sample with few columns. Returns weights and intercept."""
    beta = newton({0: (table, target, weight)}, penalty=penalty)[0]
    return beta[:-1], float(beta[-1])


def platt(odds: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate log odds; the targets are smoothed, so that few rows don't make them certain."""
    if len(odds) == 0 or len(set(target.tolist())) < 2:
        return 1.0, 0.0
    ones = target.sum()
    soft = np.where(target > 0, (ones + 1) / (ones + 2), 1 / (len(target) - ones + 2))
    weights, begin = fit_logistic(odds[:, None], soft, np.ones(len(odds)), penalty=1e-3)
    return float(weights[0]), begin


def metadata_list(row: dict[str, Column]) -> Column:
    """Names of a page's metadata: source, language, length by powers of two, and the address's scheme, domain, depth
    and query, where there are any."""
    url = as_text(row["url"])
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    size = F.floor(F.log2(F.greatest(F.coalesce(row["n_chars"], F.lit(0)).cast("double"), F.lit(1.0)))).cast("string")
    parts = {
        "source": as_text(row["source"].cast("string")), "lang": as_text(row["lang"].cast("string")), "chars": size,
        "scheme": F.regexp_extract(url, r"^([a-z]+)://", 1), "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "depth": F.size(F.split(F.regexp_extract(url, r"^[a-z]+://[^/]*([^?#]*)", 1), "/")).cast("string"), "query": url.contains("?").cast("string"),
        "page": F.floor(F.log2(F.coalesce(row["html"], F.lit(0)) + 1.0)).cast("string"),
    }
    return F.array(*[F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit(""))) for name, value in parts.items()])


def presences(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """A table of ones from lists of column numbers."""
    lists = rows.combine_chunks()
    out = np.zeros((len(lists), width), np.float32)
    out[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    return out


OTHER = {"text": "meta", "meta": "text"}


@dataclass
class Ask:
    """What is summed over the rows without a label: ``past`` has each round's calibrated weights and intercepts by
    head and view, ``shares`` the weight of a row handed over by head, view and class, ``betas`` the weights reached
    by head and view. Without ``betas`` the rows handed over are counted."""

    past: list[dict]
    keys: list[tuple[str, str]]
    shares: dict | None = None
    betas: dict | None = None


def handed_over(table: np.ndarray, models: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The label that the view of ``models`` (one a round) gave each row when it first was sure enough, else NaN."""
    sure, out = float(np.log(CONFIDENT / (1 - CONFIDENT))), np.full(len(table), np.nan)
    for weights, begin in models:
        odds = odds_of(table, weights, begin)
        new = np.isnan(out) & (np.abs(odds) >= sure - 1e-12)
        out[new] = odds[new] > 0
    return out


def free_sums(tables: dict[tuple[str, str], np.ndarray], ask: Ask) -> np.ndarray:
    """The sums of ``ask`` over rows without a label, for each key one after another: both classes' counts, or the
    gradient and the upper half of the second derivatives."""
    out = []
    for head, view in ask.keys:
        given = handed_over(tables[head, OTHER[view]], [models[head, OTHER[view]] for models in ask.past])
        if ask.betas is None:
            out.append(np.array([(given == 0).sum(), (given == 1).sum()], float))
            continue
        use = np.flatnonzero(~np.isnan(given))
        weight = np.where(given[use] == 1, ask.shares[head, view][1], ask.shares[head, view][0])
        gradient, curved = slopes(tables[head, view][use], given[use], weight, ask.betas[head, view])
        out += [gradient, curved[np.triu_indices(len(gradient))]]
    return np.concatenate(out)


def apart(sums: np.ndarray, ask: Ask) -> dict:
    """What ``free_sums`` has put one after another, by key."""
    out, at = {}, 0
    for key in ask.keys:
        if ask.betas is None:
            out[key], at = sums[at : at + 2], at + 2
            continue
        width = len(ask.betas[key])
        upper, size = np.triu_indices(width), width * (width + 1) // 2
        curved = np.zeros((width, width))
        curved[upper] = sums[at + width : at + width + size]
        out[key], at = (sums[at : at + width], curved + np.triu(curved, 1).T), at + width + size
    return out


@dataclass
class Known:
    """A head's labelled rows: tables by view, the columns' names, 0/1 labels and folds."""

    tables: dict[str, np.ndarray]
    names: dict[str, list[str]]
    label: np.ndarray
    fold: np.ndarray


def teach(heads: dict[str, Known], free: Callable[[Ask], np.ndarray], rounds: int = ROUNDS) -> dict[str, tuple[View, View, list[float]]]:
    """For each head both views (text, meta), calibrated, and the weights that combine their log odds (text,
    metadata, intercept).

    Rows of fold 0 calibrate. Each round fits both views on the labelled rows and on what the other view has handed
    over; each then hands all rows without a label that it is sure enough of to the other. ``free`` gives sums over
    all rows without a label, which are not at hand; the heads are fitted side by side, so that one pass serves all.
    """
    keys = [(head, view) for head in heads for view in OTHER if len(heads[head].label)]
    past: list[dict] = []
    beta: dict = {}
    views: dict = {}
    for turn in range(rounds + 1):
        own = {}
        for head, view in keys:
            rows = heads[head]
            use = np.flatnonzero(rows.fold != 0)
            own[head, view] = rows.tables[view][use], rows.label[use], np.ones(len(use))
        others = None
        if turn and keys:
            ask = Ask(past, keys)
            counts = apart(free(ask), ask)
            shares = {}
            for key in keys:
                labelled = np.array([(own[key][1] == value).sum() for value in (0, 1)], float)
                shares[key] = np.minimum(HANDED_WEIGHT, labelled / np.maximum(counts[key], 1.0))
            told = [key for key in keys if (counts[key] * shares[key]).any()]

            def others(reached: dict, told: list = told, shares: dict = shares) -> dict:
                asked = [key for key in reached if key in told]
                ask = Ask(past, asked, shares, {key: reached[key] for key in asked})
                return apart(free(ask), ask) if asked else {}

        beta = newton(own, others, beta or None)
        for head, view in keys:
            rows, weights, begin = heads[head], beta[head, view][:-1], float(beta[head, view][-1])
            held = rows.fold == 0
            slope, shift = platt(odds_of(rows.tables[view][held], weights, begin), rows.label[held])
            views[head, view] = View(rows.names[view], weights, begin, slope, shift)
        past = [*past, {key: (views[key].weights * views[key].slope, views[key].begin * views[key].slope + views[key].shift) for key in keys}]
    out = {}
    for head, rows in heads.items():
        both = [1.0, 0.0, 0.0]
        held = rows.fold == 0
        for view in OTHER:
            views.setdefault((head, view), View(rows.names[view], np.zeros(len(rows.names[view])), 0.0))
        if len(set(rows.label[held].tolist())) == 2:
            odds = np.stack([odds_of(rows.tables[view][held], *past[-1][head, view]) for view in ("text", "meta")], axis=1)
            weights, begin = fit_logistic(odds, rows.label[held], np.ones(held.sum()), penalty=0.1)
            both = [*np.maximum(weights, 0.0).tolist(), begin]
        out[head] = views[head, "text"], views[head, "meta"], both
    return out


def co_train(tables: dict[str, np.ndarray], names: dict[str, list[str]], label: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS) -> tuple[View, View, list[float]]:
    """``teach`` for one head whose rows are all at hand; ``label`` is NaN where unknown."""
    known = ~np.isnan(label)
    rest = {("", view): table[~known] for view, table in tables.items()}
    rows = Known({view: table[known] for view, table in tables.items()}, names, label[known], fold[known])
    return teach({"": rows}, lambda ask: free_sums(rest, ask), rounds)[""]


def _free_batches(ask: Ask, widths: dict[tuple[str, str], int], columns: dict[str, str]):
    """Sums of ``ask`` over a task's rows, each head's those that have no label of it; one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            tables = {}
            for head in {head for head, _ in ask.keys}:
                rows = pa.Table.from_batches([batch.filter(batch.column(columns[head]).is_null())])
                tables |= {(head, view): presences(rows[f"{view}_{columns[head]}"], widths[head, view]) for view in OTHER}
            total = total + free_sums(tables, ask)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for batch in batches:
        for sums in batch.column("sums"):
            total = total + np.frombuffer(sums.as_buffer(), float)
    if isinstance(total, np.ndarray):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def free_rows(rows: DataFrame, widths: dict[tuple[str, str], int], columns: dict[str, str]) -> Callable[[Ask], np.ndarray]:
    """``free`` of ``teach`` over a written table of column numbers. Tasks add up what they have read, two more tasks
    add up theirs; as many numbers as the models have second derivatives reach the driver, whatever the input."""

    def free(ask: Ask) -> np.ndarray:
        sums = rows.mapInArrow(_free_batches(ask, widths, columns), "sums binary").repartition(2).mapInArrow(_added, "sums binary")
        parts = [np.frombuffer(x.as_buffer(), float) for x in sums.toArrow()["sums"]]
        size = sum(2 if ask.betas is None else len(ask.betas[key]) * (len(ask.betas[key]) + 3) // 2 for key in ask.keys)
        return np.sum(parts, axis=0) if parts else np.zeros(size)

    return free


def _numbers(found: Column, names: list[str]) -> Column:
    return F.transform(matched(found, names), lambda name: (F.array_position(F.lit(names) if names else F.array().cast("array<string>"), name) - 1).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, pages: DataFrame, heads: dict[str, Column], doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
           n_chars: str = "n_chars", label_id: str = "doc_id", page_id: str = "page_id", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, <head>_text, <head>_meta, <head>) for each document and each of ``heads`` (name: 0/1 label column).

    Scores are probabilities of label 1: of the text view, of the metadata view, and of both, calibrated on labelled
    rows kept aside. The views are fitted on at most ``labelled_rows`` labelled documents, and label all other rows
    for each other; all documents are scored.

    Null texts have no words, null metadata is a value of its own, a null label is none; of several labels or
    pages of one id the greatest counts. Null ids are scored without page and label. A head without both labels
    scores by its prior. Repeated rows are repeated. An empty table gives none.
    """
    content, words = docs[text], word_list(docs[text])
    urls = pages.where(pages[page_id].isNotNull()).groupBy(pages[page_id].cast("long").alias("page")).agg(F.max("url").alias("url"), F.max(F.octet_length("html")).alias("html"))
    base = docs.select(
        docs[doc_id].cast("long").alias("doc_id"), let(words, lambda w: feature_list(content, w)).alias("features"),
        docs[source].alias("source"), docs[lang].alias("lang"), docs[n_chars].alias("n_chars"),
    )
    names = {head: f"label{k}" for k, head in enumerate(heads)}
    truth = labels.where(labels[label_id].isNotNull()).groupBy(labels[label_id].cast("long").alias("id")).agg(*[F.max(c.cast("int")).alias(names[h]) for h, c in heads.items()])
    # bounded by its parameter
    sample = written(truth.orderBy(F.xxhash64("id"), "id").limit(labelled_rows), "sample")
    chosen = base.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).drop("id").dropDuplicates(["doc_id"])
    meta_of = metadata_list({x: F.col(x) for x in ("source", "lang", "n_chars", "url", "html")})
    chosen = chosen.join(urls, F.col("doc_id") == F.col("page"), "left").select("doc_id", "features", meta_of.alias("meta"), (F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(CALIBRATION))).cast("int").alias("fold"), *names.values())
    chosen = written(chosen, "chosen")

    known: dict[str, Known] = {}
    for head, label in names.items():
        told = telling_features(chosen.where(F.col("fold") > 0), label, LEXICON).select("feature").distinct()
        lexicon = sorted(r["feature"] for r in told.collect())
        labelled = chosen.where(F.col(label).isNotNull())
        metas = labelled.select(F.explode("meta").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        meta_names = sorted(r["name"] for r in metas.orderBy(F.desc("n"), "name").limit(LEXICON).collect())
        # numbers only: as many rows as the sample, as many columns as the two vocabularies
        rows = labelled.select("doc_id", "fold", F.col(label).alias("label"), _numbers(F.col("features"), lexicon).alias("text"), _numbers(F.col("meta"), meta_names).alias("meta"))
        rows = rows.toArrow().sort_by("doc_id")
        tables = {"text": presences(rows["text"], len(lexicon)), "meta": presences(rows["meta"], len(meta_names))}
        known[head] = Known(tables, {"text": lexicon, "meta": meta_names}, rows["label"].cast(pa.float64()).to_numpy(), rows["fold"].to_numpy())

    # all documents as column numbers, narrow: read in each pass of the fit, and for the scores
    found = base.select("doc_id", "source", "lang", "n_chars", *[_numbers(F.col("features"), rows.names["text"]).alias(f"text_{names[head]}") for head, rows in known.items()])
    found = found.join(urls, F.col("doc_id") == F.col("page"), "left").select("doc_id", meta_of.alias("meta"), *[f"text_{x}" for x in names.values()])
    found = found.join(F.broadcast(sample), F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", *names.values(), *[f"text_{x}" for x in names.values()], *[_numbers(F.col("meta"), rows.names["meta"]).alias(f"meta_{names[head]}") for head, rows in known.items()],
    )
    found = written(found, "found")
    widths = {(head, view): len(rows.names[view]) for head, rows in known.items() for view in OTHER}
    models = teach(known, free_rows(found, widths, names))

    # each view's odds are evaluated once a row, whatever uses them above
    views = [
        odds.alias(f"{view}_{names[head]}") for head, (by_text, by_meta, _) in models.items()
        for view, odds in (("t", by_text.odds(F.col(f"text_{names[head]}"))), ("m", by_meta.odds(F.col(f"meta_{names[head]}"))))
    ]
    found = computed(found, F.struct(*views))
    out = ["doc_id"]
    for head, (_, _, both) in models.items():
        joint = F.col(f"t_{names[head]}") * both[0] + F.col(f"m_{names[head]}") * both[1] + both[2]
        for name, odds in ((f"{head}_text", F.col(f"t_{names[head]}")), (f"{head}_meta", F.col(f"m_{names[head]}")), (head, joint)):
            out.append(F.round(1 / (1 + F.exp(-odds)), 9).alias(name))
    return found.select(*out)
