"""Closing prices: from verified outcomes, or as a low-confidence reference.

The reference forecast blends terminal outcomes, an independent valuation, the current
bid with the time left, bidders, and how briskly the bid has risen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.functions.deals import time_to_close_weight
from gavelflow.functions.numbers import clamped, rounded, to_places
from gavelflow.operators.history import last_n_observations
from gavelflow.operators.quantiles import interpolated, weighted_quantile

LEAST_MATCH, LEAST_VALUATION_CONFIDENCE = 0.45, 0.2
ROUNDING = 10_000


def valid_outcomes(outcomes: DataFrame, by: str, newest: str) -> DataFrame:
    """Outcomes with an id, a price, a match of 0.45 or more and a weight; the newest of each id."""
    match = clamped(F.coalesce("match_score", F.lit(0.65)), 0.0, 1.0)
    weight = F.coalesce("weight", F.lit(1.0))
    good = outcomes.withColumns({"match_score": match, "weight": weight, "outcome_id": F.trim("outcome_id")})
    good = good.filter((F.col("outcome_id") != "") & (F.col("close_cents") > 0) & (F.col("match_score") >= LEAST_MATCH) & (F.col("weight") > 0))
    order = Window.partitionBy(by, "outcome_id").orderBy(F.desc(newest))
    return good.withColumn("x_turn", F.row_number().over(order)).filter("x_turn = 1").drop("x_turn")


def closing_forecast(subjects: DataFrame, outcomes: DataFrame, least: int = 5) -> DataFrame:
    """id, status, low, expected and high cents, confidence, sample_size, exact_models, curves.

    subjects: id, current_bid_cents; outcomes: id, outcome_id, final_price_cents,
    bid_at_time_cents, match_score, with one row for each outcome of a subject."""
    least = max(2, least)
    bid, final, then = F.col("current_bid_cents"), F.col("final_price_cents"), F.col("bid_at_time_cents")
    used = outcomes.filter((F.trim("outcome_id") != "") & (final > 0)).dropDuplicates(["id", "outcome_id"])
    estimate = F.greatest(bid, rounded(F.when(then > 0, bid * (final / then)).otherwise(final)))
    told = subjects.join(used, "id").withColumn("estimate", estimate).groupBy("id").agg(
        interpolated(F.col("estimate"), 0.2).alias("low_cents"), interpolated(F.col("estimate"), 0.5).alias("expected_cents"), interpolated(F.col("estimate"), 0.8).alias("high_cents"),
        F.avg(clamped(F.coalesce("match_score", F.lit(0.65)), 0.0, 1.0)).alias("match"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("match_score", F.lit(0.0)) >= 0.9).alias("exact_models"), F.count_if(then > 0).alias("curves"),
    )
    enough = F.coalesce(F.col("n") >= least, F.lit(False))
    confidence = to_places(clamped(F.col("match") * 0.55 + clamped(F.col("n") / 20, 0.0, 1.0) * 0.3 + F.col("curves") / F.col("n") * 0.15, 0.0, 0.95), 4)
    return subjects.select("id").join(told, "id", "left").select(
        "id", F.when(enough, "available").otherwise("insufficient").alias("status"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("low_cents", "expected_cents", "high_cents")],
        F.when(enough, confidence).otherwise(0.0).alias("confidence"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(name) for c, name in (("n", "sample_size"), ("exact_models", "exact_models"), ("curves", "curves"))],
    )


def valid_observations(observations: DataFrame, as_of: Column) -> DataFrame:
    """Distinct (time, bid) pairs of each auction up to as_of."""
    return observations.filter(F.col("observed_at").isNotNull() & (F.col("observed_at") <= as_of) & (F.col("bid_cents") >= 0)).dropDuplicates(["auction_id", "observed_at", "bid_cents"])


def bid_aggression(observations: DataFrame, bids: DataFrame, n: int = 24) -> DataFrame:
    """auction_id, aggression, observations: of the last n points of each auction.

    bids: auction_id, current_bid_cents; points above the current bid don't count."""
    last = last_n_observations(observations, n)
    order = Window.partitionBy("auction_id").orderBy("observed_at", "bid_cents")
    joined = last.join(bids, "auction_id")
    earlier = joined.filter("bid_cents <= current_bid_cents")
    stepped = earlier.withColumn("x_rise", (F.col("bid_cents") > F.lag("bid_cents").over(order)).cast("int"))
    told = stepped.groupBy("auction_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("bid_cents", F.struct("observed_at", "bid_cents")).alias("first"), F.sum("x_rise").alias("rises"), F.max("current_bid_cents").alias("bid")
    )
    lift = clamped((F.col("bid") - F.col("first")) / F.greatest(F.col("bid"), F.lit(1)), 0.0, 1.0)
    value = clamped(lift * 0.7 + F.least(F.lit(1.0), F.coalesce("rises", F.lit(0)) / 5) * 0.3, 0.0, 1.0)
    told = told.select("auction_id", F.when((F.col("n") >= 2) & (F.col("bid") > 0), value).otherwise(0.0).alias("aggression"))
    counted = joined.groupBy("auction_id").agg(F.count(F.lit(1)).alias("observations"))
    return counted.join(told, "auction_id", "left").select("auction_id", F.coalesce("aggression", F.lit(0.0)).alias("aggression"), "observations")


def weighed_outcomes(outcomes: DataFrame) -> DataFrame:
    """id, n, match, and the weighted quantiles o2, o5, o8 of valid_outcomes()."""
    # Weights in 1e-8: the supplied weight, at most 10, times the squared match of 4 places.
    weight = rounded(F.least(F.lit(10.0), F.col("weight")) * F.col("match_score") * F.col("match_score") * 1e8)
    weighed = outcomes.withColumn("w", weight)
    told = weighed.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.avg("match_score").alias("match"))
    quantiles = weighted_quantile(weighed, ["id"], "close_cents", "w", [2, 5, 8]).withColumnsRenamed({"q2": "o2", "q5": "o5", "q8": "o8"})
    return told.join(quantiles, "id")


def reference_forecast(subjects: DataFrame, outcomes: DataFrame, trends: DataFrame, as_of: Column, increment: int = ROUNDING) -> DataFrame:
    """id, status, low, expected and high cents, confidence, horizon_seconds, sample_size.

    subjects: id, current_bid_cents, bidder_count, ends_at, valuation_status, low_cents,
    median_cents, high_cents, valuation_confidence; outcomes: valid_outcomes() by id, or what
    weighed_outcomes() made of them; trends: id, aggression, observations."""
    step = max(100, increment)
    told = outcomes if "o5" in outcomes.columns else weighed_outcomes(outcomes)
    low, mid, high = F.col("low_cents"), F.col("median_cents"), F.col("high_cents")
    usable = F.coalesce((F.col("valuation_status") != "unavailable") & (F.col("valuation_confidence") >= LEAST_VALUATION_CONFIDENCE) & (low > 0) & (low <= mid) & (mid <= high), F.lit(False))
    rows = subjects.join(told, "id", "left").join(trends, "id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "x_valued": usable})
    n, valued, share = F.col("n"), F.col("x_valued"), clamped(F.lit(3.0) / (F.col("n") + 3), 0.12, 0.5)

    def anchor(outcome: str, value: Column) -> Column:
        blend = rounded(F.round(F.col(outcome) * (1 - share) + value * share, 6))
        return F.when((n > 0) & valued, blend).when(n > 0, F.col(outcome)).when(valued, value)

    rows = rows.withColumns({"x_low": anchor("o2", low), "x_mid": anchor("o5", mid), "x_high": anchor("o8", high), "x_match": F.coalesce("match", F.lit(0.0)), "x_vconf": F.when(valued, clamped(F.col("valuation_confidence"), 0.0, 1.0)).otherwise(0.0)})
    seconds = F.greatest(F.lit(0), F.floor((F.unix_micros("ends_at") - F.unix_micros(as_of)) / 1_000_000))
    rows = rows.withColumn("horizon_seconds", F.when(F.col("ends_at").isNotNull(), seconds).cast("long"))
    a_low, a_mid, a_high, horizon, bid = (F.col(c) for c in ("x_low", "x_mid", "x_high", "horizon_seconds", "current_bid_cents"))
    to_step = lambda x: rounded(F.round(x / step, 9)) * step
    aggression, seen = F.coalesce("aggression", F.lit(0.0)), F.coalesce("observations", F.lit(0))
    engagement = F.when(F.col("bidder_count") >= 0, clamped(F.log1p(F.floor("bidder_count").cast("double")) / F.lit(2.3978952727983707), 0.0, 1.0)).otherwise(0.0)
    weight = clamped(time_to_close_weight(horizon) * (1 + engagement * 0.05 + aggression * 0.08), 0.0, 0.92)
    rows = rows.withColumn("x_weight", F.round(weight, 12))
    weight, above = F.col("x_weight"), bid >= a_high
    ahead = lambda x: bid + weight * F.greatest(F.lit(0.0), x - bid)
    risk = F.least(F.greatest(F.lit(float(ROUNDING)), F.greatest(F.lit(0), a_high - a_low) * 0.15), F.greatest(F.lit(float(ROUNDING)), bid * 0.05))
    raw_high = F.when(above & ~F.coalesce(horizon == 0, F.lit(False)), bid + risk * weight).otherwise(ahead(a_high))
    no_bid = bid.isNull()
    rows = rows.withColumn("r_low", F.when(no_bid, F.greatest(F.lit(step), to_step(a_low))).otherwise(F.greatest(bid, to_step(ahead(a_low)))))
    rows = rows.withColumn("r_mid", F.greatest("r_low", F.when(no_bid, to_step(a_mid)).otherwise(to_step(ahead(a_mid + (a_high - a_mid) * aggression * 0.2)))))
    rows = rows.withColumn("r_high", F.greatest("r_mid", F.when(no_bid, to_step(a_high)).otherwise(to_step(raw_high))))
    unknown_end = F.when(F.col("ends_at").isNull(), 0.7).otherwise(1.0)
    quiet = clamped((0.06 + F.least(F.lit(0.14), n * 0.012) * F.col("x_match") + F.col("x_vconf") * 0.1) * unknown_end, 0.03, 0.28)
    lively = 0.08 + F.least(F.lit(0.12), n * 0.012) * F.col("x_match") + F.col("x_vconf") * 0.1 + F.least(F.lit(0.025), seen * 0.005)
    lively = clamped(lively * unknown_end * F.when(above, 0.65).otherwise(1.0), 0.03, 0.35)
    anchored = a_mid.isNotNull()
    return rows.select(
        "id", F.when(anchored, "reference-only").otherwise("insufficient").alias("status"),
        *[F.when(anchored, F.col(c)).cast("long").alias(name) for c, name in (("r_low", "low_cents"), ("r_mid", "expected_cents"), ("r_high", "high_cents"))],
        F.when(anchored, to_places(F.when(no_bid, quiet).otherwise(lively), 4)).otherwise(0.0).alias("confidence"),
        "horizon_seconds", F.when(anchored, n).otherwise(0).cast("long").alias("sample_size"),
    )


def anchors_of_matches(samples: DataFrame) -> DataFrame:
    """Adjusted comparables as outcomes of a forecast: id, outcome_id, close_cents, match_score, weight, exact_model."""
    exact = (F.col("tier") == 1) & (F.col("match") >= 0.85)
    return samples.select(F.col("s_id").alias("id"), F.col("c_auction_id").alias("outcome_id"), F.col("value").alias("close_cents"), F.col("match").alias("match_score"), (F.col("weight") / 1e6).alias("weight"), exact.alias("exact_model"), F.col("c_ended_at").alias("ended_at"))
