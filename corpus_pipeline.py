"""From documents to token records: language ID, near-dedup, decontamination, mixing, binary output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.components import smallest_reachable
from tidemark.llm.decontaminate import contamination
from tidemark.llm.language import UNKNOWN, identify
from tidemark.llm.mixing import mixed
from tidemark.llm.mixture_queries import ANCHOR, TARGETS, label_domain
from tidemark.llm.records import token_records
from tidemark.llm.registry import table
from tidemark.llm.simhash import fingerprints, links
from tidemark.session import prepare

END_ID = 2


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of a whole row, nulls by their place: ids may be null or repeated. Only equal rows share it."""
    return F.xxhash64(*[x for name in docs.columns for x in (docs[name], docs[name].isNull())])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the labelled ones have; texts without a letter go."""
    found = identify(docs.withColumn("__lang", docs["lang"]), lang="__lang")
    return found.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked as near copies the one with the smallest id; of repeated rows one.

    Of rows with one id, or without an id, that are linked, the one with the smallest row key stays; a null id stays
    only where no other is.
    """
    keyed = docs.withColumn("__row", row_key(docs))
    prints = written(fingerprints(keyed, carried=("__row",)), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("__none"), F.col("doc_id").alias("__id"), "__row")
    nodes = written(prints.groupBy("print").agg(F.min(row).alias("smallest")), "nodes")
    reach = smallest_reachable(links(nodes.select("print")), nodes.select(F.col("print").alias("node"), "smallest"))
    first = written(reach.select("smallest.__id", F.col("smallest.__row").alias("__first")).distinct(), "first")
    kept = keyed.join(first, (F.col("__row") == F.col("__first")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row"]).drop("__row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without more of the benchmark than the rule allows; each row is judged by itself."""
    keyed = docs.withColumn("__row", row_key(docs))
    judged = contamination(keyed, table(spark, sf_dir, "benchmark"), doc_id="__row")
    gone = judged.where("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return keyed.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate in the mixture gives, none included."""
    rated = mixed(docs, table(spark, sf_dir, "labels"), label_domain(), TARGETS, anchor=ANCHOR)
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    return rated.where("__copies > 0").select(*docs.columns, copies).drop("__copy")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token records, read back: doc_id, start, n_tokens, ids_crc32."""
    out = token_records(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, by_class=True, width=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", keep_languages), ("SimHash near-dedup", one_of_each_group), ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix), ("token-ID output", token_output),
]

#: Language models and rates are fitted, which SQL can't say; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each reading what the one before has written."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
