"""Which accounts grew, ranked: usage rows -> series -> growth signals -> opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import ranking, usage


def growth_opportunities(
    rows: DataFrame,
    windows: usage.UsageWindows,
    expected_accounts: DataFrame | None = None,
    growth: usage.GrowthConfig = usage.GrowthConfig(),
    config: ranking.RankingConfig = ranking.RankingConfig(),
) -> DataFrame:
    series = usage.usage_series(rows, windows, expected_accounts)
    signals = usage.growth_signals(usage.consumption_growth(usage.series_to_pairs(series, windows), growth), growth)
    # every growth signal is observed at the end of the current window, which is also the reference time
    scored = ranking.score_signals(signals, config, as_of=usage.instant(windows.end_at), normalize=False)
    return ranking.rank_opportunities(scored, config)
