"""Schedule windows and the trailing intent-signal brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vocabulary import BRIEF_ROW_LIMIT

DAY = "INTERVAL 1 DAY"


def local_boundary(date: Column, zone: str, time: str = "08:00") -> Column:
    """Instant of a local wall-clock time; an error where the clock skips that time.

    Spark shifts a skipped local time silently, so the instant is converted back
    and compared with what was asked for.
    """
    wall = F.to_timestamp(F.concat_ws(" ", date.cast("string"), F.lit(f"{time}:00")))
    at = F.to_utc_timestamp(wall, zone)
    missing = F.raise_error(F.concat(F.lit(f"schedule time {time} does not exist in {zone}: "), date.cast("string")))
    return F.when(F.from_utc_timestamp(at, zone) != wall, missing.cast("timestamp")).otherwise(at)


def schedule_windows(dates: DataFrame, zone: str, time: str = "08:00") -> DataFrame:
    """Adjacent windows between the same local time of two days: 23, 24 or 25 hours long."""
    return dates.select(
        "schedule_date",
        local_boundary(F.date_sub("schedule_date", 1), zone, time).alias("window_start"),
        local_boundary(F.col("schedule_date"), zone, time).alias("window_end"),
    )


def utc_day_windows(dates: DataFrame, days: int = 1) -> DataFrame:
    """The trailing complete UTC days before each date."""
    if not 1 <= days <= 14:
        raise ValueError("days must be between 1 and 14")
    return dates.select(
        "schedule_date",
        F.date_sub("schedule_date", days).cast("timestamp").alias("window_start"),
        F.col("schedule_date").cast("timestamp").alias("window_end"),
    )


def window_assign(events: DataFrame, zone: str, time: str = "08:00", ts: str = "ts") -> DataFrame:
    """Adds the schedule window each event falls into - computed per row, no range join.

    The window that ends on local date D holds the local times from D-1 at
    ``time`` up to D at ``time``; the date follows from the shifted local clock.
    """
    hour, minute = (int(p) for p in time.split(":"))
    local = F.from_utc_timestamp(F.col(ts), zone)
    day = F.to_date(local)
    late = (F.hour(local) * 60 + F.minute(local)) >= hour * 60 + minute
    return (
        events.withColumn("schedule_date", F.when(late, F.date_add(day, 1)).otherwise(day))
        .withColumn("window_start", local_boundary(F.date_sub("schedule_date", 1), zone, time))
        .withColumn("window_end", local_boundary(F.col("schedule_date"), zone, time))
    )


def due_date(now: Column, zone: str, hour: int = 8) -> Column:
    """Local calendar date whose run is due, NULL before ``hour``."""
    local = F.from_utc_timestamp(now, zone)
    return F.when(F.hour(local) >= hour, F.to_date(local))


def brief_candidates(signals: DataFrame, accounts: DataFrame, briefs: DataFrame, delivered: DataFrame, days: int = 7) -> DataFrame:
    """Surfaced, undelivered signals of each brief.

    ``signals``: signal_id, account_id, signal_date, is_surfaced, ...; ``accounts``:
    account_id, account_name, owner; ``briefs``: brief_date and owner, or brief_date
    alone if every owner has a brief that day. A signal of day
    d is exploded to the dates d+1 .. d+days, so briefs are met by equality.
    """
    reach = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda n: F.date_add("signal_date", n))
    keys = [c for c in ("brief_date", "owner") if c in briefs.columns]
    open_signals = signals.filter("is_surfaced").join(delivered.select("signal_id").distinct(), "signal_id", "left_anti")
    return (
        open_signals.join(accounts.select("account_id", "account_name", "owner"), "account_id")
        .withColumn("brief_date", F.explode(reach))
        .join(briefs.select(*keys).distinct(), keys, "left_semi")
        .dropDuplicates(["brief_date", "owner", "account_id", "signal_id"])
    )


def intent_signal_brief(candidates: DataFrame, limit: int = BRIEF_ROW_LIMIT) -> DataFrame:
    """First rows of each brief, oldest first, with ``has_more``.

    The row limit is applied per task before the shuffle (window group limit).
    """
    order = Window.partitionBy("brief_date", "owner").orderBy("signal_date", "account_name", "signal_id")
    first = candidates.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)
    totals = candidates.groupBy("brief_date", "owner").agg((F.count("*") > limit).alias("has_more"))
    return first.join(totals, ["brief_date", "owner"])
