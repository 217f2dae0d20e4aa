"""When to look again: close buckets, due times, and the windows of a sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
#: Time left above which a bucket begins, its name, and its interval.
AHEAD = [(30 * MINUTE, "normal", HOUR), (5 * MINUTE, "last-30-minutes", 5 * MINUTE), (MINUTE, "last-5-minutes", 30 * SECOND), (0, "last-minute", 15 * SECOND)]
GRACE = 120 * SECOND
TERMINAL = ("ended", "sold", "unsold", "cancelled")


def close_bucket(df: DataFrame, now: Column, grace: int = GRACE) -> DataFrame:
    """df (status, ends_at, last_checked_at) with bucket, interval_seconds, due_at, should_refresh."""
    at, end, last = F.unix_micros(now), F.unix_micros("ends_at"), F.unix_micros("last_checked_at")
    left = end - at
    stopped = F.col("status").isin(*TERMINAL)
    bucket, every, began, turns = F.when(stopped, "stopped"), F.when(stopped, None), F.when(stopped, None), F.when(stopped, None)
    before = None
    for bound, name, interval in AHEAD:
        here = left > bound
        bucket, every = bucket.when(here, name), every.when(here, interval)
        began = began.when(here, F.lit(None) if before is None else end - before)
        turns, before = turns.when(here, end - bound), bound
    late = [(-left < grace, "close-grace", 15 * SECOND, end, end + grace), (-left < DAY, "close-reconciliation", 5 * MINUTE, end + grace, end + DAY)]
    for here, name, interval, start, turn in late:
        bucket, every, began, turns = bucket.when(here, name), every.when(here, interval), began.when(here, start), turns.when(here, turn)
    bucket, every, began = bucket.otherwise("stale-close-reconciliation"), every.otherwise(HOUR), began.otherwise(end + DAY)
    rows = df.withColumns({"bucket": bucket, "x_every": every, "x_began": began.cast("long"), "x_turns": turns.cast("long")})
    seen = F.least(last, at)
    due = F.least(
        seen + F.col("x_every"),
        F.when((seen < F.col("x_began")) & (F.col("x_began") <= at), F.col("x_began")),
        F.when(F.col("x_turns") > at, F.col("x_turns")),
    )
    due = F.when(F.col("bucket") == "stopped", None).when(last.isNull(), at).otherwise(due)
    rows = rows.withColumn("x_due", due)
    return rows.withColumns({"interval_seconds": (F.col("x_every") / SECOND).cast("long"), "due_at": F.timestamp_micros("x_due"), "should_refresh": F.coalesce(F.col("x_due") <= at, F.lit(False))}).drop("x_every", "x_began", "x_turns", "x_due")


def sync_window(df: DataFrame, now: Column, bootstrap_days: int = 7, overlap_days: int = 2, most_days: int = 14) -> DataFrame:
    """df (covered_through) with mode, from_at, to_at."""
    at, covered = F.unix_micros(now), F.unix_micros("covered_through")
    fresh = covered.isNull() | (covered > at)
    start = F.when(fresh, at - bootstrap_days * DAY).otherwise(covered - overlap_days * DAY)
    stop = F.when(fresh, at).otherwise(F.least(at, covered - overlap_days * DAY + most_days * DAY))
    mode = F.when(fresh, "bootstrap").when(stop < at, "catch-up").otherwise("incremental")
    return df.withColumns({"mode": mode, "from_at": F.timestamp_micros(start), "to_at": F.timestamp_micros(stop)})


def catch_up_windows(df: DataFrame, now: Column, bootstrap_days: int = 7, overlap_days: int = 2, most_days: int = 14) -> DataFrame:
    """A row for each window of sync_window() until the last one reaches now: step, from_at, to_at.
    Each window starts ``overlap_days`` before the end of the one before."""
    if not 0 < overlap_days < most_days:
        raise ValueError("windows must move forward")
    rows = sync_window(df, now, bootstrap_days, overlap_days, most_days)
    stride, at, start = (most_days - overlap_days) * DAY, F.unix_micros(now), F.unix_micros("from_at")
    more = F.greatest(F.lit(0), F.ceil((at - F.unix_micros("to_at")) / stride)).cast("int")
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), more)))
    begins = start + F.col("step") * F.lit(stride)
    return rows.withColumns({"x_from": begins, "x_to": F.least(at, begins + most_days * DAY)}).withColumns({"from_at": F.timestamp_micros("x_from"), "to_at": F.timestamp_micros(F.when(F.col("mode") == "bootstrap", at).otherwise(F.col("x_to")))}).drop("x_from", "x_to")


def closing_candidates(auctions: DataFrame, now: Column, minutes: int = 30, limit: int = 500) -> DataFrame:
    """Open auctions with a numeric id that end within the minutes: those still ahead by
    their end, then the overdue by their last check. limit is a top-k report."""
    at, end = F.unix_micros(now), F.unix_micros("ends_at")
    rows = auctions.filter(F.col("status").isin("active", "closing") & (end <= at + minutes * MINUTE) & F.col("external_id").rlike("^[1-9][0-9]*$"))
    ahead = end > at
    order = [F.when(ahead, 0).otherwise(1), F.when(ahead, end), F.when(~ahead, F.unix_micros("last_checked_at")).asc_nulls_first(), F.col("external_id")]
    return rows.orderBy(*order).limit(limit)
