"""The quantile flavours of the model; they differ and must not be mixed.

The array functions take a sorted array of structs (value, weight) with whole weights,
so that a result never depends on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.functions.numbers import let, rounded


def weighted_quantile_of(samples: Column, tenths: int, value: str = "value", weight: str = "weight") -> Column:
    """First value at which the running weight reaches tenths / 10 of the total."""
    total = F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + x[weight])
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("found"))

    def step(a: Column, x: Column, total: Column) -> Column:
        run = a["run"] + x[weight]
        return F.struct(run.alias("run"), F.coalesce(a["found"], F.when(run * 10 >= total * tenths, x[value])).alias("found"))

    # Summed once, not once a sample.
    return let(total, lambda t: F.aggregate(samples, start, lambda a, x: step(a, x, t), lambda a: a["found"]))


#: Width of the first histogram's bins.
BIN = 1 << 16


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, tenths: list[int], *, width: int = BIN) -> DataFrame:
    """by, q<tenths>: weighted_quantile_of() over rows, for groups of any size. Values and
    weights are whole numbers.

    Weights are summed by bin of values, where they lie, then by value within the bins that
    hold the quantiles; a group is at most (largest value / width) rows, then width rows."""
    bin_of = F.floor(F.col(value) / width).cast("long")
    rows = df.select(*by, F.col(value).alias("x_value"), F.col(weight).alias("x_weight"), bin_of.alias("x_bin"))
    upto = Window.partitionBy(*by).orderBy("x_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = rows.groupBy(*by, "x_bin").agg(F.sum("x_weight").alias("x_sum"))
    bins = bins.withColumns({"x_run": F.sum("x_sum").over(upto), "x_total": F.sum("x_sum").over(Window.partitionBy(*by))})
    first = lambda q: F.min(F.when(F.col("x_run") * 10 >= F.col("x_total") * q, F.struct("x_bin", (F.col("x_run") - F.col("x_sum")).alias("x_before"))))
    held = bins.groupBy(*by).agg(F.max("x_total").alias("x_total"), F.array(*[F.struct(F.lit(q).alias("x_q"), first(q).alias("x_in")) for q in tenths]).alias("x_each"))
    held = held.select(*by, "x_total", F.explode("x_each").alias("x_one")).select(*by, "x_total", "x_one.x_q", "x_one.x_in.*")
    inside = rows.join(held, [*by, "x_bin"]).groupBy(*by, "x_q", "x_total", "x_before", "x_value").agg(F.sum("x_weight").alias("x_sum"))
    run = F.col("x_before") + F.sum("x_sum").over(Window.partitionBy(*by, "x_q").orderBy("x_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = inside.withColumn("x_run", run).filter(F.col("x_run") * 10 >= F.col("x_total") * F.col("x_q"))
    return reached.groupBy(*by).agg(*[F.min(F.when(F.col("x_q") == q, F.col("x_value"))).alias(f"q{q}") for q in tenths])


def interpolated(value: Column, q: float) -> Column:
    """Linear interpolation at (n - 1) * q, rounded; an aggregate."""
    return rounded(F.percentile(value, q))


def middle(value: Column) -> Column:
    """Middle value, or the rounded mean of the two middle ones; an aggregate."""
    return rounded(F.percentile(value, 0.5))


def lower_element(values: Column, q: float) -> Column:
    """Element at floor((n - 1) * q) of a sorted array."""
    return F.try_element_at(values, (F.floor((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    """Element at floor(n / 2) of a sorted array."""
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def middle_of(values: Column) -> Column:
    """middle() of a sorted array."""
    n = F.size(values)
    low = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(values, (F.floor(n / 2) + 1).cast("int"))
    return rounded((low + high) / F.lit(2.0))
