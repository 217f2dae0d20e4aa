"""Values of open vehicles from closed sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import matching as M
from gavelflow.functions.numbers import clamped, let, once, to_places
from gavelflow.operators.comparables import match_comparables, sides
from gavelflow.operators.quantiles import middle_of, weighted_quantile_of

LEAST_FOR_OUTLIERS, MOST_RATIO, PUBLISHED = 5, 3, 12


def drop_price_outliers(samples: Column, value: str = "value") -> Column:
    """Of five or more sorted samples, those within a third and three times the median,
    if they are a strict majority."""
    median = middle_of(F.transform(samples, lambda x: x[value]))
    near = let(median, lambda m: F.filter(samples, lambda x: (x[value] * MOST_RATIO >= m) & (x[value] <= m * MOST_RATIO)))
    return let(near, lambda n: F.when((F.size(samples) >= LEAST_FOR_OUTLIERS) & (F.size(n) >= F.floor(F.size(samples) / 2) + 1), n).otherwise(samples))


def confidence_of(samples: Column, tier: Column, q20: Column, q50: Column, q80: Column) -> Column:
    """From the effective sample size, the average match and the spread."""
    cap = F.when(tier == M.TIGHT, M.CONFIDENCE_CAPS[M.TIGHT]).when(tier == M.FAMILY, M.CONFIDENCE_CAPS[M.FAMILY]).otherwise(M.CONFIDENCE_CAPS[M.CLASS])
    add = lambda f: F.aggregate(samples, F.lit(0.0), lambda a, x: a + f(x))
    weights, squares = add(lambda x: x["weight"] / 1e6), add(lambda x: (x["weight"] / 1e6) * (x["weight"] / 1e6))
    match = add(lambda x: x["match"]) / F.size(samples)
    spread = (q80 - q20) / q50
    dispersion = clamped(1 - F.greatest(F.lit(0.0), spread - 0.45) * 0.55, 0.35, 1.0)
    sparse = lambda size: F.when(size < 1.5, 0.28).when(size < 2.5, 0.4).otherwise(cap)
    least = lambda size: F.least(cap, sparse(size), cap * (0.18 + 0.82 * (1 - F.exp(-size / 4))) * (0.55 + match * 0.45) * dispersion)
    return to_places(let(let(weights, lambda w: w * w) / squares, least), 4)


def adjusted_samples(matches: DataFrame, as_of: Column) -> DataFrame:
    """Each match with its adjusted price, weight in millionths and rounded match score."""
    s, c = sides()
    return matches.withColumns({
        "value": M.adjusted_price(s, c),
        "weight": M.sample_weight(F.col("tier"), F.col("score"), c["ended_at"], as_of),
        "match": to_places(clamped(F.col("score"), 0.0, 1.0), 4),
        "gap": F.abs(s["mileage"] - c["mileage"]),
    })


def value_subjects(subjects: DataFrame, comps: DataFrame, as_of: str, *, k: int = 15, classes: list[str] | None = None) -> DataFrame:
    """A row for each subject: status, low, median and high cents, sample size, confidence,
    match basis, and the published comparables, nearest mileage first."""
    at = F.lit(as_of).cast("timestamp")
    matches = adjusted_samples(match_comparables(subjects, comps, int(as_of[:4]), k=k, classes=classes), at)
    sample = F.struct("value", "weight", "match", F.col("c_auction_id").alias("auction_id"), "gap", F.unix_micros("c_ended_at").alias("ended"))
    grouped = matches.groupBy("s_id").agg(F.min("tier").alias("tier"), F.sort_array(F.collect_list(sample)).alias("samples"))
    kept = once(grouped.withColumnRenamed("samples", "all"), samples=drop_price_outliers(F.col("all")))
    priced = once(kept, **{f"q{q}": weighted_quantile_of(F.col("samples"), q) for q in (2, 5, 8)})
    # Nearest mileage first (unknown last), then better match, then later.
    shown = F.array_sort(F.transform("samples", lambda x: F.struct(x["gap"].isNull().alias("far"), x["gap"].alias("gap"), (-x["match"]).alias("m"), (-x["ended"]).alias("e"), x["auction_id"].alias("auction_id"))))
    valued = priced.select(
        F.col("s_id").alias("id"), "tier",
        F.col("q2").alias("low_cents"), F.col("q5").alias("median_cents"), F.col("q8").alias("high_cents"),
        F.size("samples").alias("sample_size"),
        confidence_of(F.col("samples"), F.col("tier"), F.col("q2"), F.col("q5"), F.col("q8")).alias("confidence"),
        F.array_join(F.transform(F.slice(shown, 1, PUBLISHED), lambda x: x["auction_id"]), ",").alias("comparables"),
    )
    basis = F.when(F.col("tier") == M.TIGHT, M.BASIS_NAMES[M.TIGHT]).when(F.col("tier") == M.FAMILY, M.BASIS_NAMES[M.FAMILY]).when(F.col("tier") == M.CLASS, M.BASIS_NAMES[M.CLASS])
    return subjects.select("id").join(valued, "id", "left").select(
        "id",
        F.when(F.col("tier").isNull(), "unavailable").otherwise("available").alias("status"),
        basis.alias("match_basis"),
        "low_cents", "median_cents", "high_cents",
        F.coalesce("sample_size", F.lit(0)).cast("long").alias("sample_size"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("comparables", F.lit("")).alias("comparables"),
    )


def valuation_snapshot(valuations: DataFrame) -> DataFrame:
    """Counts of valued and unavailable subjects, and by basis."""
    return valuations.agg(
        F.count(F.lit(1)).alias("subjects"),
        F.count_if(F.col("status") == "available").alias("valued"),
        F.count_if(F.col("status") != "available").alias("unavailable"),
        *[F.count_if(F.col("match_basis") == name).alias(name.replace("-", "_")) for name in M.BASIS_NAMES.values()],
    )
