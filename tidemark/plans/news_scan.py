"""One scan of the account news monitor over all accounts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators import news
from tidemark.session import stored


@dataclass(frozen=True)
class NewsScan:
    state: DataFrame
    pending: DataFrame
    summary: DataFrame


def news_scan(
    results: DataFrame,
    watchlist: DataFrame,
    searches: DataFrame,
    state: DataFrame,
    reported: DataFrame,
    now: Column,
    judge: Callable = news.rule_judge,
) -> NewsScan:
    """Candidate gate -> novelty -> judge -> material events -> state -> pending events and counts.

    Verdicts are written: the judge may be slow or costly and must not run again for each of the three results. What is
    counted is observed while the tables are written, in the same pass.
    """
    counted = {name: Observation(name) for name in ("gated", "novelty", "verdicts", "material")}
    searched = results.join(searches.filter("ok").select("account_id"), "account_id", "left_semi")
    gated = news.news_candidate_gate(searched, watchlist, now)
    gated = stored(gated.observe(counted["gated"], F.count("*").alias("results"), F.count_if(F.col("drop_reason").isNull()).alias("candidates")), "gated")
    candidates = gated.filter("drop_reason IS NULL")
    known = news.prune_news_state(state, now)
    novelty = news.news_novelty(candidates, known)
    novelty = stored(novelty.observe(counted["novelty"], F.count_if(F.col("novelty") == "already_judged").alias("already_judged")), "novelty")
    fresh = novelty.filter("novelty = 'fresh'").withColumnRenamed("candidate_url", "link").drop("novelty", "drop_reason", "url").withColumnRenamed("link", "url")
    verdicts = news.judge_batches(fresh, judge, state=known)
    verdicts = stored(verdicts.observe(counted["verdicts"], F.count_if(F.col("judge_error").isNull()).alias("judged")), "verdicts")
    judged = news.material_events(verdicts, fresh)
    judged = stored(judged.observe(counted["material"], F.count_if(F.col("material")).alias("material")), "judged")
    new_state = news.news_state_upsert(state, judged, now)
    pending = news.news_pending(news.pending_candidates(new_state, reported, watchlist, now))
    counts = {name: value for observation in counted.values() for name, value in observation.get.items()}
    return NewsScan(new_state, pending, news.news_scan_summary(watchlist, searches, verdicts.filter("judge_error IS NOT NULL"), counts))
