"""Bid histories: windows over the observations of each auction.

observations: auction_id, observed_at, bid_cents, bidders, status, ends_at. Every order
is by time and then event_id or bid, so that ties never depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.operators.shelves import range_dealt


def _order(df: DataFrame, by: str = "auction_id"):
    tie = "event_id" if "event_id" in df.columns else "bid_cents"
    return Window.partitionBy(by).orderBy("observed_at", tie)


def last_n_observations(observations: DataFrame, n: int = 24, by: str = "auction_id") -> DataFrame:
    """The last n of each auction, with age_rank 1 for the newest."""
    tie = "event_id" if "event_id" in observations.columns else "bid_cents"
    order = Window.partitionBy(by).orderBy(F.desc("observed_at"), F.desc(tie))
    return observations.withColumn("age_rank", F.row_number().over(order)).filter(F.col("age_rank") <= n)


def last_write_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the order given."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("x_turn", turn).filter("x_turn = 1").drop("x_turn")


def _scanned(observations: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """observations with x_before (the fields of the auction's row before, null at its first)
    and x_part, the stretch of the order that the row lies in.

    Auctions are dealt out by ranges of (auction, time), so that a busy one is cut into
    stretches that tasks scan by themselves; what a stretch starts from comes from a summary
    of those before it."""
    tie = "event_id" if "event_id" in observations.columns else "bid_cents"
    dealt = range_dealt(observations, ["auction_id", "observed_at", tie], "observations")
    at = F.struct("observed_at", tie, "x_tie")
    here = Window.partitionBy("x_part", "auction_id").orderBy("observed_at", tie, "x_tie")
    ends = dealt.groupBy("x_part", "auction_id").agg(F.max_by(F.struct(*fields), at).alias("x_row"))
    carried = _carried(ends, F.last("x_row").over(_earlier()).alias("x_carried"))
    rows = dealt.withColumn("x_before", F.lag(F.struct(*fields)).over(here)).join(F.broadcast(carried), ["x_part", "auction_id"], "left")
    return rows.withColumn("x_before", F.coalesce("x_before", "x_carried")).drop("x_carried").withColumn("x_at", at)


def _earlier() -> Window:
    return Window.partitionBy("auction_id").orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)


def _carried(summaries: DataFrame, *values: Column) -> DataFrame:
    """What goes into stretches that continue an auction: at most one for each stretch."""
    before = F.count(F.lit(1)).over(_earlier())
    return summaries.select("x_part", "auction_id", *values, before.alias("x_n")).filter("x_n > 0").drop("x_n")


def _running() -> Window:
    return Window.partitionBy("x_part", "auction_id").orderBy("x_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _running_total(rows: DataFrame, name: str, value: Column, aggregate, combine) -> DataFrame:
    """rows with name: the aggregate of value over the auction's rows up to this one."""
    rows = rows.withColumn("x_value", value)
    sums = rows.groupBy("x_part", "auction_id").agg(aggregate("x_value").alias("x_sum"))
    carried = _carried(sums, aggregate("x_sum").over(_earlier()).alias("x_carried"))
    rows = rows.withColumn("x_here", aggregate("x_value").over(_running())).join(F.broadcast(carried), ["x_part", "auction_id"], "left")
    return rows.withColumn(name, combine(F.col("x_carried"), F.col("x_here"))).drop("x_value", "x_here", "x_carried")


def change_points(observations: DataFrame, fields: tuple[str, ...] = ("bid_cents", "bidders", "status", "ends_at")) -> DataFrame:
    """Observations whose fields differ from those of the one before; nulls are a value. All
    observations of one time count, in order of their event."""
    rows = _scanned(observations, fields)
    differs = F.col("x_before").isNull()
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"x_before.{f}"))
    return rows.filter(differs).select(*observations.columns)


def extension_count(observations: DataFrame) -> DataFrame:
    """With the running number of times the end moved later."""
    moved = F.coalesce((F.col("ends_at") > F.col("x_before.ends_at")).cast("int"), F.lit(0))
    rows = _running_total(_scanned(observations, ("ends_at",)), "extension_count", moved, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b)
    return rows.select(*observations.columns, "extension_count")


def effective_end(observations: DataFrame) -> DataFrame:
    """With an end that never moves earlier."""
    rows = _running_total(_scanned(observations, ("ends_at",)), "effective_ends_at", F.col("ends_at"), F.max, F.greatest)
    return rows.select(*observations.columns, "effective_ends_at")


def carry_forward_bid(observations: DataFrame) -> DataFrame:
    """With the last known bid where one is missing."""
    rows = _scanned(observations, ("bid_cents",))
    known = rows.groupBy("x_part", "auction_id").agg(F.max_by("bid_cents", F.when(F.col("bid_cents").isNotNull(), F.col("x_at"))).alias("x_bid"))
    carried = _carried(known, F.last("x_bid", ignorenulls=True).over(_earlier()).alias("x_carried"))
    rows = rows.withColumn("x_here", F.last("bid_cents", ignorenulls=True).over(_running())).join(F.broadcast(carried), ["x_part", "auction_id"], "left")
    return rows.withColumn("carried_bid_cents", F.coalesce("x_here", "x_carried")).select(*observations.columns, "carried_bid_cents")


def max_extension(auctions: DataFrame, observations: DataFrame) -> DataFrame:
    """auctions with the largest extension count seen, 0 where there is none."""
    most = observations.groupBy("auction_id").agg(F.max("extension_count").alias("extensions"))
    return auctions.join(most, "auction_id", "left").withColumn("extensions", F.coalesce("extensions", F.lit(0)))


def latest_valuation(valuations: DataFrame, now: Column, preferred: str) -> DataFrame:
    """The unexpired valuation of each auction: the preferred provider's, then the newest."""
    live = valuations.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return last_write_wins(live, ["auction_id"], [F.when(F.col("provider") == preferred, 0).otherwise(1), F.desc("created_at")])
