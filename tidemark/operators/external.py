"""Per-account rollup of careers and company-news collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vocabulary import MAX_ITEMS_PER_ACCOUNT
from tidemark.operators.changes import job_classify


def careers_rollup(accounts: DataFrame, fetches: DataFrame, records: DataFrame, changes: DataFrame, baselines: DataFrame, normalize: bool = True) -> DataFrame:
    """Per account: current, relevant and changed postings, baseline and status.

    ``fetches``: account_id, fetch_status; ``records``: postings after the
    collection; ``changes``: careers_diff rows; ``baselines``: accounts with
    earlier records.
    """
    described = records.withColumn("description", F.lit(None).cast("string"))
    current = job_classify(described, normalize=normalize).groupBy("account_id").agg(
        F.count("*").alias("current_count"), F.count_if(F.col("relevant")).alias("relevant_count")
    )
    changed = changes.filter("change <> 'unchanged'").groupBy("account_id").agg(F.count("*").alias("changed_count"))
    based = baselines.select("account_id").distinct().withColumn("baseline_available", F.lit(True))
    zero = F.lit(0).cast("bigint")
    status = (
        F.when(F.col("fetch_status").isNull(), "unavailable")
        .when(F.col("fetch_status").isin("ok", "not_modified"), "succeeded")
        .when(F.col("fetch_status") == "unsupported", "unsupported")
        .otherwise("partial")
    )
    return (
        accounts.select("account_id").join(fetches.select("account_id", "fetch_status"), "account_id", "left")
        .join(current, "account_id", "left").join(changed, "account_id", "left").join(based, "account_id", "left")
        .select(
            "account_id", status.alias("careers_status"),
            *[F.coalesce(c, zero).alias(c) for c in ("current_count", "relevant_count", "changed_count")],
            F.coalesce("baseline_available", F.lit(False)).alias("baseline_available"),
        )
    )


def careers_items(changes: DataFrame, observed_at: Column | None = None, baselines: DataFrame | None = None, limit: int = MAX_ITEMS_PER_ACCOUNT, normalize: bool = True) -> DataFrame:
    """The most recent changed postings of each account; the limit applies before the shuffle.

    A posting without a date counts as of its own ``observed_at``, which :func:`careers_diff` carries, and where
    ``changes`` have none as of the one given for all.
    Those shown are classified (``relevant``, ``rationale``). With ``baselines``, the accounts with earlier records,
    ``first_observed`` tells the postings of accounts seen for the first time.
    """
    job = F.coalesce("after", "before")
    own = [c for c in changes.columns if c == "observed_at"]
    if not own and observed_at is None:
        raise ValueError("changes without observed_at need one for all")
    items = changes.filter("change <> 'unchanged'").select("account_id", "job_id", "change", *own, job.alias("job")).select(
        "account_id", "job_id", "change", *own, "job.*"
    )
    times = [F.col("posted_at"), *[F.col(c) for c in own], *([] if observed_at is None else [observed_at])]
    order = Window.partitionBy("account_id").orderBy(F.desc(F.coalesce(*times)), "job_id")
    shown = items.withColumn("item_rank", F.row_number().over(order)).filter(F.col("item_rank") <= limit)
    shown = job_classify(shown.withColumn("description", F.lit(None).cast("string")), normalize=normalize).drop("description", "score", "matched_terms")
    if baselines is None:
        return shown
    based = baselines.select("account_id", F.lit(True).alias("based")).distinct()
    return shown.join(based, "account_id", "left").withColumn("first_observed", F.col("based").isNull()).drop("based")


def news_items_shown(items: DataFrame, limit: int = MAX_ITEMS_PER_ACCOUNT) -> DataFrame:
    """The first collected news items of each account: title, url, excerpt, author, published_at, kind and their rank.

    ``items``: account_id, input_ord, title, url, excerpt, author, published_at, observed_at, kind. Missing texts are
    empty, a missing time of publication is that of the observation, and whatever is no company post is an article.
    """
    order = Window.partitionBy("account_id").orderBy("input_ord", "url")
    shown = items.withColumn("item_rank", F.row_number().over(order)).filter(F.col("item_rank") <= limit)
    filled = [F.coalesce(name, F.lit("")).alias(name) for name in ("title", "url", "excerpt", "author")]
    kind = F.when(F.col("kind") == "company_post", "post").otherwise("article").alias("kind")
    return shown.select("account_id", "item_rank", *filled, F.coalesce("published_at", "observed_at").alias("published_at"), kind)


def news_rollup(accounts: DataFrame, items: DataFrame, failures: DataFrame) -> DataFrame:
    """Per account: articles and status; a failure with a snapshot is partial, without one failed.

    ``items``: account_id, ...; ``failures``: account_id, has_snapshot.
    """
    counts = items.groupBy("account_id").agg(F.count("*").alias("article_count"))
    failed = failures.groupBy("account_id").agg(F.max("has_snapshot").alias("has_snapshot"))
    return (
        accounts.select("account_id").join(counts, "account_id", "left").join(failed, "account_id", "left")
        .select(
            "account_id",
            F.when(F.col("has_snapshot").isNull(), "succeeded").when(F.col("has_snapshot"), "partial").otherwise("failed").alias("news_status"),
            F.coalesce("article_count", F.lit(0).cast("bigint")).alias("article_count"),
        )
    )


def external_rollup(careers: DataFrame, news: DataFrame) -> DataFrame:
    return careers.join(news, "account_id", "full_outer")


def external_status(rollup: DataFrame, news_configured: bool = True) -> DataFrame:
    """Overall status: unavailable, partial or succeeded, for each source and combined."""
    usable = ~F.col("careers_status").isin("unsupported", "unavailable")
    careers = (
        F.when(F.count_if(usable) == 0, "unavailable").when(F.count_if(F.col("careers_status") != "succeeded") > 0, "partial").otherwise("succeeded")
    )
    news = F.when(F.count_if(F.col("news_status") != "succeeded") > 0, "partial").otherwise("succeeded") if news_configured else F.lit("unavailable")
    summary = rollup.agg(careers.alias("careers_status"), news.alias("news_status"), F.count("*").alias("accounts"))
    both = F.array("careers_status", "news_status")
    return summary.withColumn(
        "status",
        F.when(F.forall(both, lambda s: s == "unavailable"), "unavailable").when(F.exists(both, lambda s: s != "succeeded"), "partial").otherwise("succeeded"),
    )
