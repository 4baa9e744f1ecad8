"""Soft-membership mixing: domain posteriors of a classifier, and document rates by projected gradient."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.llm.features import LABELLED_ROWS, feature_list, labelled, matched, sums, telling_features, word_list
from tidemark.llm.common import written

LEXICON = 256
#: Weight of the squared coefficients.
PENALTY = 1e-4
FIT_ROUNDS = 100
ROUNDS = 60
#: Rounds after which the rates reached are written, so that a round replays no more steps than this.
REPLAY = 10
#: Largest difference of a domain's tokens from its target, as a share of all tokens.
TOLERANCE = 1e-5
SEED = 8


@dataclass
class DomainModel:
    """Softmax regression over the presence of a lexicon's features: weights and intercepts, one for each domain."""

    domains: list[str]
    lexicon: list[str]
    weights: list[list[float]]
    begin: list[float]

    def posterior(self, features: Column) -> Column:
        """Array of probabilities, in the order of the domains."""
        logs = sums(matched(features, self.lexicon), self.lexicon, self.weights, self.begin)

        def normal(values: Column) -> Column:
            return let(F.transform(values, lambda x: F.exp(x - F.array_max(values))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

        return let(logs, normal)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
                rows: int = LABELLED_ROWS, lexicon: int = LEXICON) -> DomainModel:
    """Learned from at most ``rows`` labelled documents; a null domain is no label."""
    sample = written(labelled(docs, labels, [domain.cast("string")], doc_id, text, label_id, rows).where("label0 is not null"), "labelled")
    domains = sorted(r["label0"] for r in sample.select("label0").distinct().collect())
    names = sorted(r["feature"] for r in telling_features(sample, "label0", lexicon).select("feature").distinct().collect())
    if len(domains) < 2 or not names:
        sizes = {r["label0"]: r["n"] for r in sample.groupBy("label0").agg(F.count("*").alias("n")).collect()}
        return DomainModel(domains, [], [], [float(np.log(sizes[d])) for d in domains])
    present = let(matched(F.col("features"), names), lambda found: F.transform(F.lit(names), lambda name: F.array_contains(found, name).cast("double")))
    label = (F.array_position(F.lit(domains), F.col("label0")) - 1).cast("double").alias("label")
    # one narrow row a document of the sample, read again in each round of the fit
    ready = written(sample.select(label, present.alias("present")), "present").select("label", array_to_vector("present").alias("features")).coalesce(4)
    model = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=FIT_ROUNDS, standardization=False).fit(ready)
    return DomainModel(domains, names, model.coefficientMatrix.toArray().T.tolist(), model.interceptVector.toArray().tolist())


def rate_after(posterior: Column, begin: Column, steps: list[np.ndarray]) -> Column:
    """The rate after projected steps: each lowers it by the product of posterior and step, and stops at zero."""
    if not steps:
        return begin
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])

    def dot(step: Column) -> Column:
        return F.aggregate(F.zip_with(posterior, step, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    return F.aggregate(moves, begin, lambda rate, step: F.greatest(F.lit(0.0), rate - dot(step)))


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, anchor: str | None = None,
              rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], float]:
    """Steps that take all rates from 1 to the least squares fit, and the difference that remains.

    ``rows`` has n (tokens) and p (posterior). Expected tokens of domain d are the sum of rate * n * p[d] over all
    documents. The objective is the squared difference from the targets, measured in the inverse of the Gram
    matrix of the memberships, and a document's step is weighed by 1 / n; the largest curvature is then one, so
    that steps of one never overshoot. While it lowers the objective, the Gram matrix is that of the documents whose
    rate is not zero, which takes far fewer rounds. A round is one aggregate of sums by domain and pair of domains.
    """
    size = len(domains)
    weight = np.array([float(targets.get(d, 0.0)) for d in domains])
    if not size or weight.sum() <= 0 or (weight < 0).any() or set(targets) - set(domains):
        raise ValueError(f"targets must be nonnegative weights of {domains}")

    def measured(held: DataFrame, rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix of the memberships with a rate."""
        share = [F.get("p", F.lit(i)) for i in range(size)]
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        alive = F.when(F.col("r") > 0, F.col("n")).otherwise(0)
        row = held.select("n", "p", rate.alias("r")).agg(
            *[F.sum(F.col("r") * F.col("n") * x) for x in share], *[F.sum(alive * share[i] * share[j]) for i, j in pairs],
        ).first()
        values = [x or 0.0 for x in row]
        gram = np.zeros((size, size))
        for (i, j), value in zip(pairs, values[size:], strict=True):
            gram[i, j] = gram[j, i] = value
        return np.array(values[:size]), gram

    def inverse(gram: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(gram, rcond=1e-10, hermitian=True)

    held, begin, recent = rows.select("n", "p", F.lit(1.0).alias("rate")), F.col("rate"), []
    have, gram = measured(held, begin)
    if total is None:
        total = have.sum() if anchor is None else have[domains.index(anchor)] / weight[domains.index(anchor)] * weight.sum()
    want = weight / weight.sum() * total
    full, steps, off = inverse(gram), [], have - want
    metric = full
    while np.abs(off).max() > tolerance * max(total, 1.0) and len(steps) < rounds:
        step = metric @ off
        have, gram = measured(held, rate_after(F.col("p"), begin, [*recent, step]))
        now = have - want
        if metric is not full and now @ full @ now >= off @ full @ off:
            metric = full  # too far: the plain step instead
            continue
        steps.append(step)
        recent.append(step)
        if len(recent) == REPLAY:
            held, recent = written(held.select("n", "p", rate_after(F.col("p"), begin, recent).alias("rate")), "rates"), []
        still = np.abs(now - off).max() <= 1e-7 * max(total, 1.0)
        metric, off = inverse(gram), now
        if still:
            break  # no rate moves any more: the targets can't be met
    return steps, float(np.abs(off).max() / max(total, 1.0))


def mixed(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          total: float | None = None, anchor: str | None = None, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, and __n (words), __domain, __share (of the likeliest domain), __rate and __copies.

    Rates are expected numbers of copies. copies is the rate rounded up or down by a hash of the id, so that it is
    the same in every run and right on average. ``total`` is how many tokens the mixture has: by default as many
    as the input, with ``anchor`` as many as leave that domain's as they are.

    Texts that are null, empty or without words have no tokens and keep the rate that their posterior gives them.
    Null ids share one hash; repeated rows get equal rates. Without any label, or without any token, each rate is
    1 and the domain null. An empty table stays empty.
    """
    model = fit_domains(docs, labels, domain, doc_id, text, label_id)
    words = word_list(docs[text])
    found = let(words, lambda w: let(feature_list(docs[text], w), lambda f: F.struct(F.size(w).cast("long").alias("n"), model.posterior(f).alias("p"))))
    rows = docs.withColumn("__found", found)
    rows = written(rows.withColumns({"__n": F.col("__found.n"), "__p": F.col("__found.p")}).drop("__found"), "members")
    steps: list[np.ndarray] = []
    if model.domains:
        narrow = rows.select(F.col("__n").alias("n"), F.col("__p").alias("p"))
        known = {d: w for d, w in targets.items() if d in model.domains}
        if sum(known.values()) > 0:
            steps, _ = fit_rates(narrow, model.domains, known, total, anchor if anchor in known else None)
    rate = F.round(rate_after(F.col("__p"), F.lit(1.0), steps), 9)
    names = F.lit(model.domains) if model.domains else F.array().cast("array<string>")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumns({"__domain": F.get(names, F.array_position(F.col("__p"), F.array_max("__p")).cast("int") - 1), "__share": F.array_max("__p"), "__rate": rate})
    return rows.withColumn("__copies", F.floor(F.col("__rate") + chance).cast("int")).drop("__p")


def mixture_totals(mixture: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(domain, documents, tokens, share, target, reached): what a mixture of :func:`mixed` holds beside its targets.

    One row for each domain that documents are predicted to be of or that has a target. tokens are those of the
    copies taken, counted for the likeliest domain; share and target are of all of them. A target that no document
    can serve, because no label names its domain, has no tokens and a share of 0 here; it is not dropped. reached says
    that the share is within a tenth of the target. Documents without a domain are one row of null. A mixture
    without tokens has shares of 0, and one without rows only its targets.
    """
    weight = sum(targets.values())
    if weight <= 0 or min(targets.values()) < 0:
        raise ValueError("targets must be nonnegative weights")
    wanted = mixture.sparkSession.createDataFrame([(d, w / weight) for d, w in sorted(targets.items())], "wanted string, target double")
    taken = F.col("__copies") * F.col("__n")
    held = mixture.groupBy(F.col("__domain").alias("domain")).agg(F.count("*").alias("documents"), F.sum(taken).alias("tokens"))
    whole = mixture.agg(F.sum(taken).alias("whole"))
    # one row a domain from here on
    both = held.join(wanted, F.col("domain") == F.col("wanted"), "full_outer").select(
        F.coalesce("domain", "wanted").alias("domain"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("documents", "tokens")], F.coalesce("target", F.lit(0.0)).alias("target"),
    )
    total = F.coalesce(whole.scalar(), F.lit(0))
    share = F.when(total > 0, F.col("tokens") / total).otherwise(0.0)
    return both.withColumn("share", share).withColumn("reached", F.abs(F.col("share") - F.col("target")) <= F.col("target") * 0.1).select(
        "domain", "documents", "tokens", "share", "target", "reached"
    )
