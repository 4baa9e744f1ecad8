"""Text features as column expressions, and the choice of those that tell labels apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.llm.common import as_text

SEPARATORS = r"""[\x00-\x20.,;:!?"'()|]+"""
#: Shares of a text's characters that are symbols, capitals and digits, and of its words that are distinct, in steps.
SHAPES = {
    "symbols": ("#$%&*!|<>{}[]~^_=\\", (0.005, 0.02, 0.06, 0.12)),
    "capitals": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (0.03, 0.1, 0.3, 0.6)),
    "digits": ("0123456789", (0.01, 0.05, 0.2)),
}
DISTINCT = (0.1, 0.3, 0.5, 0.8)
#: Rows of labels that a lexicon and a classifier are fitted on, those of the least hashes.
LABELLED_ROWS = 20_000
#: A feature is used if its likelihood-ratio statistic for the label is at least this, and that many texts have it.
LEAST_GAIN, LEAST_TEXTS = 25.0, 5


def word_list(text: Column) -> Column:
    """All words, lower-cased, repeats included."""
    return F.filter(F.split(F.lower(as_text(text)), SEPARATORS), lambda w: w != "")


def _step(value: Column, limits: tuple, name: str) -> Column:
    names = F.lit([f"\x01{name}:{k}" for k in range(len(limits) + 1)])
    return let(value, lambda x: F.get(names, sum(((x >= limit).cast("int") for limit in limits), F.lit(0))))


def feature_list(text: Column, words: Column) -> Column:
    """The distinct words, and a name for each shape's step; shapes begin with a character no word has."""
    content = as_text(text)
    size = F.greatest(F.length(content), F.lit(1))
    shapes = [_step((F.length(content) - F.length(F.translate(content, chars, ""))) / size, limits, name) for name, (chars, limits) in SHAPES.items()]

    def joined(distinct: Column) -> Column:
        variety = _step(F.size(distinct) / F.greatest(F.size(words), F.lit(1)), DISTINCT, "distinct")
        return F.concat(distinct, F.array(*shapes, variety))

    return let(F.array_distinct(words), joined)


def labelled(docs: DataFrame, labels: DataFrame, wanted: list[Column], doc_id: str, text: str, label_id: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, features, the wanted label columns) of at most ``rows`` labelled documents. Of several labels of one
    document the greatest count."""
    names = [f"label{k}" for k in range(len(wanted))]
    each = labels.where(labels[label_id].isNotNull()).select(labels[label_id].cast("long").alias("id"), *[x.alias(n) for x, n in zip(wanted, names, strict=True)])
    sample = each.groupBy("id").agg(*[F.max(n).alias(n) for n in names]).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text"))
    # the sample has at most ``rows`` narrow rows
    return texts.join(F.broadcast(sample), "id").select(F.col("id").alias("doc_id"), feature_list(F.col("text"), word_list(F.col("text"))).alias("features"), *names)


def telling_features(rows: DataFrame, label: str, most: int) -> DataFrame:
    """(feature, label, n, with_feature, of_label, texts) of the ``most`` features with the greatest likelihood ratio
    between texts that have them and texts that do not. ``rows`` is a bounded sample."""
    known = rows.where(F.col(label).isNotNull())
    counts = known.select(F.col(label).alias("label"), F.explode("features").alias("feature")).groupBy("feature", "label").agg(F.count("*").alias("n"))
    sizes = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("of_label"))
    total = F.sum("of_label").over(Window.partitionBy())
    sizes = sizes.withColumn("texts", total)
    by_feature = Window.partitionBy("feature")
    table = counts.join(F.broadcast(sizes), "label").withColumn("with_feature", F.sum("n").over(by_feature))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    absent, without = F.col("of_label") - F.col("n"), F.col("texts") - F.col("with_feature")
    gain = 2 * (part(F.col("n"), F.col("with_feature") * F.col("of_label") / F.col("texts")) + part(absent, without * F.col("of_label") / F.col("texts")))
    # labels that a feature never has: n = 0, all of them without it
    missed = F.sum(F.col("of_label")).over(by_feature)
    rest = F.col("texts") - missed
    extra = F.when(rest > 0, 2 * rest * F.log(F.col("texts") / without)).otherwise(0.0)
    scored = table.withColumn("gain", F.sum(gain).over(by_feature) + extra).where((F.col("gain") >= LEAST_GAIN) & (F.col("with_feature") >= LEAST_TEXTS))
    best = scored.groupBy("feature").agg(F.max("gain").alias("best")).orderBy(F.desc("best"), "feature").limit(most)
    return scored.join(F.broadcast(best.select("feature")), "feature").select("feature", "label", "n", "with_feature", "of_label", "texts")


def matched(features: Column, lexicon: list[str]) -> Column:
    return F.array_intersect(features, F.lit(lexicon) if lexicon else F.array().cast("array<string>"))


def sums(found: Column, lexicon: list[str], weights: list[list[float]], begin: list[float]) -> Column:
    """An array: ``begin`` plus the weights of the features found, one row of ``weights`` for each of the lexicon."""
    start = F.array(*[F.lit(float(x)) for x in begin])
    if not lexicon:
        return start
    table = F.map_from_arrays(F.lit(lexicon), F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights]))
    return F.aggregate(found, start, lambda total, name: F.zip_with(total, F.element_at(table, name), lambda a, b: a + b))
