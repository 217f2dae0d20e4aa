"""Ranks deals by value, forecast and costs.

Input columns: current_bid_cents, valuation_status (provider, reference-only,
unavailable), low_cents, valuation_confidence, forecast_status (available,
reference-only, insufficient), forecast_low, forecast_expected, forecast_high,
forecast_confidence, data_confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import deals as D
from gavelflow.functions.numbers import clamped, rounded, to_places


def _tier(status: Column, score: Column) -> Column:
    return F.when((status == "actionable") & (score >= 75), 1).when(status.isin("actionable", "watch") & (score >= 55), 2).when((status == "watch") & (score >= 30), 3).otherwise(4)


def assess_deals(board: DataFrame, costs: D.Costs = D.Costs(), target: D.Target = D.Target()) -> DataFrame:  # noqa: B008
    """board with the assessment's columns. A deal without a current bid is never scored:
    its status is insufficient, with the code CURRENT_BID_UNAVAILABLE first."""
    bid = F.col("current_bid_cents")
    value = F.when((F.col("valuation_status") != "unavailable") & (F.col("low_cents") > 0), F.col("low_cents"))
    forecast = F.col("forecast_status") != "insufficient"
    expected = F.when(forecast & (F.col("forecast_expected") >= bid), F.col("forecast_expected"))
    high = F.when(forecast & F.col("forecast_high").isNotNull(), F.greatest(bid, F.col("forecast_high")))
    staged = board.withColumns({"conservative_value_cents": value, "expected_close_cents": expected, "x_high": high})
    value, expected, high = F.col("conservative_value_cents"), F.col("expected_close_cents"), F.col("x_high")
    known = value.isNotNull() & bid.isNotNull()
    staged = staged.withColumns({
        "all_in_at_current_bid_cents": D.all_in(bid, F.coalesce(value, F.lit(0)), costs),
        "all_in_at_expected_close_cents": F.when(known, D.all_in(expected, value, costs)),
        "safe_max_bid_cents": F.when(known, D.safe_max_bid(value, costs, target)),
        "break_even_bid_cents": F.when(known, D.break_even_bid(value, costs)),
        "downside_profit_cents": F.when(known, value - D.all_in(high, value, costs)),
    })
    safe, even, all_in = F.col("safe_max_bid_cents"), F.col("break_even_bid_cents"), F.col("all_in_at_expected_close_cents")
    low, mid, top = F.col("forecast_low"), F.col("forecast_expected"), F.col("forecast_high")
    priced = F.when(F.col("valuation_status") == "provider", F.col("forecast_status") == "available").otherwise(False)
    confidence = to_places(clamped(
        (clamped(F.col("valuation_confidence"), 0.0, 1.0) * 0.45
         + F.when(forecast, clamped(F.col("forecast_confidence"), 0.0, 1.0)).otherwise(0.0) * 0.4
         + clamped(F.coalesce(F.col("data_confidence"), F.lit(1.0)), 0.0, 1.0) * 0.15) * F.when(priced, 1.0).otherwise(0.55), 0.0, 1.0), 4)
    staged = staged.withColumns({
        "projected_profit_cents": F.when(known, value - all_in),
        "x_roi": F.when(known, (value - all_in) / F.greatest(F.lit(1), all_in)),
        "x_discount": F.when(known, (value - F.coalesce(expected, bid)) / value),
        "x_win": F.when(known, D.probability_at_or_below(low, mid, top, safe)),
        "x_profitable": F.when(known, D.probability_at_or_below(low, mid, top, even)),
        "x_confidence": F.when(known, confidence).otherwise(0.0),
    })
    win, profitable, roi = F.col("x_win"), F.col("x_profitable"), F.col("x_roi")
    headroom = F.when(safe <= 0, 0.0).otherwise(clamped((safe - bid) / safe, 0.0, 1.0))
    raw = (
        clamped((F.col("x_discount") + 0.05) / 0.45, 0.0, 1.0) * 30
        + headroom * 25
        + F.coalesce(clamped(roi / 0.25, 0.0, 1.0), F.lit(0.0)) * 20
        + (F.coalesce(profitable, F.lit(0.0)) + F.coalesce(win, F.lit(0.0))) / 2 * 15
        + F.col("x_confidence") * 10
    )
    profit = F.col("projected_profit_cents")
    avoid = (bid > even) | F.coalesce(profit < 0, F.lit(False))
    meets = priced & (bid <= safe) & F.coalesce(profit >= target.minimum_profit, F.lit(False)) & F.coalesce(win >= 0.35, F.lit(False)) & (F.col("x_confidence") >= 0.5)
    status = F.when(~known, "insufficient").when(avoid, "avoid").when(meets, "actionable").otherwise("watch")
    staged = staged.withColumns({"status": status, "score": F.when(known, rounded(clamped(F.round(raw, 9), 0.0, 100.0))).otherwise(0).cast("long")})
    codes = F.array_compact(F.array(
        F.when(bid.isNull(), F.lit("CURRENT_BID_UNAVAILABLE")),
        F.when(value.isNull(), F.lit("VALUATION_UNAVAILABLE")).when(F.col("valuation_status") == "reference-only", F.lit("REFERENCE_ONLY_VALUATION")),
        F.when(~forecast, F.lit("FORECAST_INSUFFICIENT")).when(F.col("forecast_status") == "reference-only", F.lit("REFERENCE_ONLY_FORECAST")),
        F.when(~known, F.lit(None)).when(avoid, F.lit("ABOVE_BREAK_EVEN")).when(meets, F.lit("MEETS_PROFIT_AND_CONFIDENCE_THRESHOLDS")).when(bid > safe, F.lit("ABOVE_SAFE_MAX_BID")).otherwise(F.lit("MONITOR_BELOW_SAFE_MAX_BID")),
    ))
    out = staged.withColumns({
        "tier": _tier(F.col("status"), F.col("score")),
        "roi": to_places(roi, 4), "discount_to_value": to_places(F.col("x_discount"), 4),
        "probability_profitable": to_places(profitable, 4), "probability_win": to_places(win, 4),
        "confidence": F.col("x_confidence"), "reason_codes": codes,
    })
    return out.drop("x_high", "x_roi", "x_discount", "x_win", "x_profitable", "x_confidence")
