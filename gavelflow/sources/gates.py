"""Rules that rows and batches must pass before they are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = ("currentbid", "current_bid", "subjectbid", "subject_bid")


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with violations: the names of the rules that hold of them, in order."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)."""
    empty = F.size("violations") == 0
    return validated.filter(empty).drop("violations"), validated.filter(~empty)


def leaks(df: DataFrame) -> list[str]:
    """Fields, nested ones too, that would carry a bid into a valuation."""

    def walk(field, at: str) -> list[str]:
        kind = field.dataType
        while hasattr(kind, "elementType"):
            kind = kind.elementType
        inner = [x for f in getattr(kind, "fields", []) for x in walk(f, f"{at}{field.name}.")]
        return [at + field.name] * field.name.lower().startswith(FORBIDDEN) + inner

    return [x for f in df.schema.fields for x in walk(f, "")]


def valuation_rules() -> dict[str, Column]:
    low, mid, high = (F.col(c) for c in ("low_cents", "median_cents", "high_cents"))
    available = F.col("status") == "available"
    return {
        "prices": available & ~F.coalesce((low > 0) & (low <= mid) & (mid <= high), F.lit(False)),
        "confidence": available & ~F.coalesce((F.col("confidence") > 0) & (F.col("confidence") <= 1), F.lit(False)),
        "evidence": available & (F.col("sample_size") <= 0),
        "unavailable-with-price": ~available & mid.isNotNull(),
    }
