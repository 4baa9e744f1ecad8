"""Queries that learn from the labels: the mixture's rates, and document quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import mixed
from tidemark.llm.quality import scored
from tidemark.llm.registry import query, table

#: Shares of the mixture's tokens by quality (q) and toxicity (t) of the labels.
TARGETS = {"q1t0": 0.94, "q0t0": 0.04, "q1t1": 0.015, "q0t1": 0.005}
#: The domain whose tokens the mixture keeps as they are.
ANCHOR = "q1t0"


def label_domain() -> Column:
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


@query("op8_mixing")
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates at which all documents enter a mixture with given token shares by labelled domain."""
    out = mixed(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"), label_domain(), TARGETS, anchor=ANCHOR)
    return out.select("doc_id", F.col("__n").alias("n_tokens"), F.col("__domain").alias("domain"), F.round("__share", 9).alias("share"), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


@query("op5_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality and toxicity of all documents, from their text and their pages' metadata; keep: good and not toxic."""
    out = scored(
        table(spark, folder, "documents"), table(spark, folder, "labels"), table(spark, folder, "pages"), {"quality": F.col("quality"), "toxic": F.col("toxic")},
    )
    good = F.round(F.col("quality") * (1 - F.col("toxic")), 9)
    return out.select("doc_id", "quality_text", "quality_meta", "quality", "toxic_text", "toxic_meta", "toxic", good.alias("score"), ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("keep"))
