"""Costs, bid ceilings, probabilities and scores of one deal, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelflow.functions.numbers import clamped, rounded


@dataclass(frozen=True)
class Costs:
    """Rates, and fixed costs in cents."""

    buyer_premium_rate: float = 0.0
    purchase_tax_rate: float = 0.0
    selling_fee_rate: float = 0.08
    transport: int = 85_000
    title: int = 22_500
    inspection: int = 17_500
    repairs: int = 0
    storage: int = 0
    risk_reserve: int = 75_000

    @property
    def fixed(self) -> int:
        return self.transport + self.title + self.inspection + self.repairs + self.storage + self.risk_reserve


@dataclass(frozen=True)
class Target:
    minimum_profit: int = 150_000
    margin_rate: float = 0.12


def cost_of_bid(bid: Column, costs: Costs) -> Column:
    """The bid with its premium, and the tax on both."""
    premium = rounded(bid * F.lit(costs.buyer_premium_rate))
    return bid + premium + rounded((bid + premium) * F.lit(costs.purchase_tax_rate))


def cost_breakdown(bid: Column, exit_value: Column, costs: Costs) -> Column:
    premium = rounded(bid * F.lit(costs.buyer_premium_rate))
    tax = rounded((bid + premium) * F.lit(costs.purchase_tax_rate))
    fee = rounded(exit_value * F.lit(costs.selling_fee_rate))
    acquisition = bid + premium + tax + F.lit(costs.fixed)
    return F.struct(
        bid.alias("purchase_bid"), premium.alias("buyer_premium"), tax.alias("purchase_tax"), fee.alias("selling_fee"),
        acquisition.cast("long").alias("acquisition"), (acquisition + fee).cast("long").alias("all_in"),
    )


def all_in(bid: Column, exit_value: Column, costs: Costs) -> Column:
    return (cost_of_bid(bid, costs) + F.lit(costs.fixed) + rounded(exit_value * F.lit(costs.selling_fee_rate))).cast("long")


def ceiling(value: Column, required: Column, costs: Costs) -> Column:
    """Largest whole bid from 0 to the value that leaves the required profit, else 0.

    Bid costs grow by at least one cent a cent, so the answer lies next to the budget
    divided by the rates; neighbours settle the rounding."""
    budget = value - rounded(value * F.lit(costs.selling_fee_rate)) - F.lit(costs.fixed) - required
    near = F.floor(budget / F.lit((1 + costs.buyer_premium_rate) * (1 + costs.purchase_tax_rate))).cast("long")
    tried = F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda d: near + d)
    fits = F.filter(tried, lambda b: (b >= 0) & (b <= value) & (cost_of_bid(b, costs) <= budget))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def safe_max_bid(value: Column, costs: Costs, target: Target) -> Column:
    return ceiling(value, F.greatest(F.lit(target.minimum_profit).cast("long"), rounded(value * F.lit(target.margin_rate))), costs)


def break_even_bid(value: Column, costs: Costs) -> Column:
    return ceiling(value, F.lit(0).cast("long"), costs)


def probability_at_or_below(low: Column, expected: Column, high: Column, threshold: Column) -> Column:
    """Piecewise-linear distribution through (low, 0), (expected, 1/2) and (high, 1)."""
    rising = F.when(expected == low, F.lit(0.5)).otherwise(F.lit(0.5) * (threshold - low) / (expected - low))
    falling = F.when(high == expected, F.lit(1.0)).otherwise(F.lit(0.5) + F.lit(0.5) * (threshold - expected) / (high - expected))
    within = F.when(threshold < low, F.lit(0.0)).when(threshold >= high, F.lit(1.0)).when(threshold <= expected, rising).otherwise(falling)
    return F.when((low <= expected) & (expected <= high), within)


def time_to_close_weight(seconds: Column) -> Column:
    """Share of the way to the historical price that is still ahead."""
    steps = [(0, 0.0, True), (60, 0.1, False), (300, 0.2, False), (1_800, 0.35, False), (21_600, 0.55, False), (86_400, 0.7, False), (604_800, 0.8, False)]
    out = F.when(seconds.isNull(), F.lit(0.55))
    for bound, weight, inclusive in steps:
        out = out.when(seconds <= bound if inclusive else seconds < bound, F.lit(weight))
    return out.otherwise(F.lit(0.9))


def condition_adjustment(condition: Column, operability: Column, damage_flags: Column, issue_flags: Column) -> Column:
    """What condition takes off a value, between -0.45 and 0."""
    base = F.when(condition == "fair", -0.08).when(condition == "repairable", -0.22).when(condition == "salvage", -0.40).otherwise(0.0)
    moves = F.when(operability == "non-operational", -0.18).when(operability == "runs", -0.04).otherwise(0.0)
    many = lambda flags: F.least(F.lit(4), F.size(F.array_distinct(F.coalesce(flags, F.array().cast("array<string>")))))
    return clamped(base + moves - many(damage_flags) * 0.025 - many(issue_flags) * 0.01, -0.45, 0.0)


def listing_confidence(vin: Column, mileage: Column, kind: Column) -> Column:
    """kind: fleet, valued or discovery."""
    return F.when(vin.isNotNull() & mileage.isNotNull(), 0.65).when(kind == "fleet", 0.40).when(kind == "valued", 0.45).otherwise(0.25)


def outcome_status(bid: Column, bidders: Column) -> Column:
    return F.when(bid > 0, "closed-high-bid").when((bid == 0) & (bidders == 0), "no-bid").otherwise("closed-outcome-unknown")
