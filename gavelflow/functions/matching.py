"""How close a closed sale is to a vehicle, and how its price is carried over.

Subjects and comparables have year, mileage, condition, operability, class and issues;
columns of the two sides are passed as dicts, since they stand in one joined row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelflow.functions.numbers import clamped, rounded

#: Fixed values of the match model.
CONDITION_SCORES = {"new": 5, "usable": 4, "unknown": 3, "repairable": 2, "salvage": 1, "scrap": 0}
OPERABILITY_SCORES = {"runs-and-drives": 3, "runs": 2, "unknown": 1, "non-operational": 0}
FALLBACK_CLASSES = [
    "compact-van", "full-size-van", "minivan", "passenger-hatchback", "passenger-sedan", "pickup-light-duty",
    "pickup-one-ton", "pickup-three-quarter-ton", "suv-compact", "suv-full-size", "suv-midsize",
]
TIGHT, FAMILY, CLASS = 1, 2, 3
BASIS_NAMES = {TIGHT: "family-year-mileage", FAMILY: "family", CLASS: "body-class"}
BASIS_WEIGHTS = {TIGHT: 1.0, FAMILY: 0.78, CLASS: 0.48}
CONFIDENCE_CAPS = {TIGHT: 0.82, FAMILY: 0.58, CLASS: 0.25}
#: by mode: most years apart for recent and for older subjects.
YEARS_APART = {TIGHT: (2, 3), FAMILY: (3, 5), CLASS: (1, 2)}
#: by mode: least miles, share of the subject's, ceiling near zero, ratio below and from 25,000 miles.
MILES_APART = {TIGHT: (20_000, 0.5, 25_000, 3.0, 1.75), FAMILY: (40_000, 0.75, 40_000, 4.0, 2.25), CLASS: (15_000, 0.35, 15_000, 2.75, 1.5)}


#: Below this the ceiling counts, not the ratio.
FEW_MILES = 1_000


def scored(value: Column, scores: dict[str, int]) -> Column:
    out = F.lit(scores["unknown"])
    for name, score in scores.items():
        out = F.when(value == name, score).otherwise(out)
    return out


def condition_score(value: Column) -> Column:
    return scored(value, CONDITION_SCORES)


def operability_score(value: Column) -> Column:
    return scored(value, OPERABILITY_SCORES)


def condition_band(value: Column) -> Column:
    return F.when(value.isin("new", "usable"), "normal").when(value == "repairable", "repairable").when(value.isin("salvage", "scrap"), "terminal").otherwise("unknown")


def operability_band(value: Column) -> Column:
    return F.when(value.isin("runs", "runs-and-drives"), "mobile").when(value == "non-operational", "non-operational").otherwise("unknown")


def most_years_apart(year: Column, reference_year: int, mode: int) -> Column:
    recent, older = YEARS_APART[mode]
    return F.when(F.lit(reference_year) - year <= 4, recent).otherwise(older)


def kind_guards(s: dict[str, Column], c: dict[str, Column], reference_year: int, mode: int) -> Column:
    """What guards() asks of all but the mileage."""
    unknown_side = F.lit(mode != CLASS)
    near_year = F.abs(s["year"] - c["year"]) <= most_years_apart(s["year"], reference_year, mode)
    year = F.when(s["year"].isNull(), unknown_side).otherwise(F.coalesce(near_year, F.lit(False)))

    band = condition_band(s["condition"]), condition_band(c["condition"])
    moves = operability_band(s["operability"]), operability_band(c["operability"])
    equal, some_unknown = band[0] == band[1], (band[0] == "unknown") | (band[1] == "unknown")
    if mode == CLASS:
        condition, operability = equal, moves[0] == moves[1]
    else:
        terminal = (band[0] == "terminal") | (band[1] == "terminal")
        condition = some_unknown | (equal if mode == TIGHT else (equal | ~terminal))
        operability = (moves[0] == "unknown") | (moves[1] == "unknown") | (moves[0] == moves[1])
    same_class = s["class"].isNull() | c["class"].isNull() | (s["class"] == c["class"])
    return year & condition & operability & same_class


def mileage_guard(s: dict[str, Column], c: dict[str, Column], mode: int) -> Column:
    least, share, ceiling, wide, narrow = MILES_APART[mode]
    a, b = s["mileage"].cast("double"), c["mileage"].cast("double")
    ratio = F.greatest(a / b, b / a) <= F.when(a < 25_000, wide).otherwise(narrow)
    near_miles = (F.abs(a - b) <= F.greatest(F.lit(float(least)), a * share)) & F.when(F.least(a, b) < FEW_MILES, F.greatest(a, b) <= ceiling).otherwise(ratio)
    return F.when(s["mileage"].isNull(), F.lit(mode != CLASS)).otherwise(F.coalesce(near_miles, F.lit(False)))


def guards(s: dict[str, Column], c: dict[str, Column], reference_year: int, mode: int) -> Column:
    """Whether the comparable may stand for the subject in this mode."""
    return kind_guards(s, c, reference_year, mode) & mileage_guard(s, c, mode)


def closeness(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when((a > 0) & (b > 0), F.exp(-F.abs(F.ln(a / b)) / 0.75)).otherwise(F.lit(0.4))


def match_score(s: dict[str, Column], c: dict[str, Column], identity: float, *, same_mileage: bool = False) -> Column:
    """Rounded to 9 places, so that equal scores stay equal wherever they are computed. With
    same_mileage, the highest that any mileage could reach."""
    miles = F.lit(1.0) if same_mileage else closeness(s["mileage"], c["mileage"])
    year = F.coalesce(F.exp(-F.abs(s["year"] - c["year"]) / 5.0), F.lit(0.55))
    condition = F.exp(-F.abs(condition_score(s["condition"]) - condition_score(c["condition"])) / 2.5)
    operability = F.exp(-F.abs(operability_score(s["operability"]) - operability_score(c["operability"])) / 2.0)
    score = F.lit(identity) * (0.35 + year * 0.65) * (0.35 + miles * 0.65) * (0.55 + condition * 0.45) * (0.75 + operability * 0.25)
    return F.round(score, 9)


def price_factor(s: dict[str, Column], c: dict[str, Column]) -> Column:
    """What the comparable's price is multiplied by to stand for the subject."""
    year = F.coalesce(clamped(F.exp((s["year"] - c["year"]) * 0.045), 0.7, 1.4), F.lit(1.0))
    a, b = s["mileage"].cast("double"), c["mileage"].cast("double")
    miles = F.when((a != 0) & (b != 0), clamped(F.pow(b / a, F.lit(0.28)), 0.65, 1.45)).otherwise(F.lit(1.0))
    condition = clamped(F.exp((condition_score(s["condition"]) - condition_score(c["condition"])) * 0.12), 0.72, 1.35)
    operability = clamped(F.exp((operability_score(s["operability"]) - operability_score(c["operability"])) * 0.1), 0.75, 1.3)
    issues = clamped(F.exp((c["issues"] - s["issues"]) * 0.035), 0.8, 1.25)
    return clamped(year * miles * condition * operability * issues, 0.45, 1.8)


def adjusted_price(s: dict[str, Column], c: dict[str, Column]) -> Column:
    return F.greatest(F.lit(1).cast("long"), rounded(c["closed_high_bid_cents"] * price_factor(s, c)))


def sample_weight(tier: Column, score: Column, ended_at: Column, as_of: Column) -> Column:
    """In millionths, so that sums are exact."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ended_at)) / F.lit(86_400_000_000.0))
    basis = F.when(tier == TIGHT, BASIS_WEIGHTS[TIGHT]).when(tier == FAMILY, BASIS_WEIGHTS[FAMILY]).otherwise(BASIS_WEIGHTS[CLASS])
    return rounded(F.greatest(F.lit(0.01), basis * score * F.exp(-days / 365)) * 1e6)
