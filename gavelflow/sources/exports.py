"""Exports that their own figures let through: valuations with the sales they rest on, and lots.

Every gate reads figures that were observed while the export was written. An export that is
refused takes nothing away from the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.sources.content import revision_of, word_sums
from gavelflow.sources.gates import leaks, valuation_rules
from gavelflow.sources.generations import KEPT, Generations, Staged

# What an export needs.
LEAST_SUBJECTS, LEAST_SALES, LEAST_LOTS = 10, 25, 10
LEAST_DETAILED, LEAST_PICTURED, LEAST_VALUED = 0.9, 0.9, 0.5
MOST_RETENTION_DAYS = 1_825
FUTURE_MINUTES = 5
VIN = "(?i)^[A-HJ-NPR-Z0-9]{17}$"


def corpus_rules(host: str) -> dict[str, Column]:
    """Faults of a closed sale: auction_id, source_url, closed_high_bid_cents, ended_at, vin."""
    address = rf"(?i)^https://(?:[^/?#@]*@)?{host.replace('.', '[.]')}(?::[0-9]*)?(?:[/?#]|$)"
    return {
        "price": ~F.coalesce(F.col("closed_high_bid_cents") > 0, F.lit(False)),
        "ended-at": F.col("ended_at").isNull(),
        "host": ~F.coalesce(F.col("source_url").rlike(address), F.lit(False)),
        "vin": F.col("vin").isNotNull() & ~F.trim("vin").rlike(VIN),
    }


def export_rules() -> dict[str, Column]:
    known = F.coalesce(F.col("status").isin("available", "unavailable"), F.lit(False))
    return {**valuation_rules(), "status": ~known, "as-of": F.col("as_of").isNull()}


def faults_of(rules: dict[str, Column]) -> dict[str, Column]:
    """Figures: how many rows each rule finds fault with."""
    return {f"fault:{name}": F.count_if(F.coalesce(rule, F.lit(False))) for name, rule in rules.items()}


def faulty(staged: Staged) -> list[str]:
    return [name for name, n in staged.figures.items() if name.startswith("fault:") and n]


def valuation_refusals(staged: Staged) -> list[str]:
    n, valued = staged.rows, staged.figures["valued"]
    short = ["subjects"] * (n < LEAST_SUBJECTS) + ["valued"] * (valued < LEAST_VALUED * n)
    return staged.faults + faulty(staged) + short + ["coverage"] * (valued + staged.figures["unavailable"] != n)


def corpus_refusals(staged: Staged) -> list[str]:
    n = staged.rows
    return staged.faults + faulty(staged) + ["sales"] * (n < LEAST_SALES) + ["details"] * (staged.figures["detailed"] < LEAST_DETAILED * n)


def export_market(valuations: DataFrame, sales: DataFrame, root: Generations, corpus: Generations, export_id: str, at: str, host: str, retention_days: int) -> tuple[Staged, Staged]:
    """Valuations into ``root`` and then the sales they rest on into ``corpus``; both or, where
    either is refused, none. Where only the first is taken, the sales are taken up again by
    the next export, whose windows overlap.

    valuations: subject_id, status, low_cents, median_cents, high_cents, confidence,
    sample_size, as_of. sales: auction_id, source_url, closed_high_bid_cents, ended_at, vin,
    mileage. More columns may follow, but none that carries a subject's bid."""
    named = leaks(valuations) + leaks(sales)
    if named:
        raise ValueError(f"a bid would be exported: {', '.join(named)}")
    if not 1 <= retention_days <= MOST_RETENTION_DAYS:
        raise ValueError(f"sales can't be kept for {retention_days} days")
    counted = {"valued": F.count_if(F.col("status") == "available"), "unavailable": F.count_if(F.col("status") == "unavailable")}
    first = root.stage(valuations, {**counted, **faults_of(export_rules())})
    why = [f"valuations: {x}" for x in valuation_refusals(first)]
    if why:  # the sales needn't be written to be dropped
        root.drop(first)
        raise ValueError(f"export {export_id} is refused: {'; '.join(why)}")
    try:
        second = corpus.stage(sales, {"detailed": F.count("mileage"), **faults_of(corpus_rules(host))})
    except Exception:
        root.drop(first)
        raise
    why = [f"sales: {x}" for x in corpus_refusals(second)]
    if why:
        root.drop(first)
        corpus.drop(second)
        raise ValueError(f"export {export_id} is refused: {'; '.join(why)}")
    try:
        root.take(first, export_id, at, 24 * 60)
    except Exception:
        corpus.drop(second)
        raise
    corpus.take(second, export_id, at, retention_days * 24 * 60)
    return first, second


def lot_rules() -> dict[str, Column]:
    """Faults of an exported lot: id, title, status, year, mileage, current_bid_cents, bidder_count, vin, images."""
    text = lambda c, most: F.coalesce(F.length(F.trim(c)).between(1, most), F.lit(False))
    least = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    return {
        "id": ~text("id", 300), "title": ~text("title", 1_000), "status": ~F.coalesce(F.col("status") == "active", F.lit(False)),
        "year": F.col("year").isNotNull() & ~F.col("year").between(1886, 2200), "mileage": least("mileage") | F.coalesce(F.col("mileage") > 2_000_000, F.lit(False)),
        "bid": least("current_bid_cents") | least("bidder_count"), "vin": F.col("vin").isNotNull() & ~F.col("vin").rlike(VIN),
        "images": F.coalesce(F.size("images") > 6, F.lit(False)) | F.coalesce(F.exists("images", lambda u: ~u.rlike("^https://")), F.lit(False)),
    }


def lot_figures() -> dict[str, Column]:
    return {"detailed": F.count_if("detail_enriched"), "pictured": F.count_if(F.size("images") > 0), **faults_of(lot_rules())}


def lot_refusals(staged: Staged) -> list[str]:
    n, told = staged.rows, staged.figures
    return faulty(staged) + ["lots"] * (n < LEAST_LOTS) + ["details"] * (told["detailed"] < LEAST_DETAILED * n) + ["images"] * (told["pictured"] < LEAST_PICTURED * n)


def validated(g: Generations, schema, now: Column, rules: dict[str, Column], least: int = LEAST_LOTS) -> DataFrame:
    """generation_id, reasons of the kept generations: why a reader would turn them away. Times
    come from the header; count, ids, rules and revision from one pass over the rows."""
    spark, key, out = g.spark, g.ids[0], []
    for m in g.manifest().orderBy(F.desc("generated_at"), F.desc("generation_id")).limit(KEPT).collect():
        rows = spark.read.schema(schema).parquet(f"{g.root}/rows/{m.build}")
        per_id = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if((F.col("n") > 1) | F.col(key).isNull()).alias("repeated"))
        content = rows.agg(*word_sums(rows), F.count_if(F.exists(F.array(*[F.coalesce(r, F.lit(False)) for r in rules.values()]), lambda x: x)).alias("faulty"))
        told = per_id.crossJoin(F.broadcast(content)).first()  # one row each
        ok = m.row_count == told.rows and m.revision == revision_of(told.rows, told.asDict())
        at, end = F.unix_micros(F.lit(m.generated_at)), F.unix_micros(F.lit(m.expires_at))
        faults = {
            "future": at > F.unix_micros(now) + FUTURE_MINUTES * 60_000_000, "expired": end <= F.unix_micros(now), "times": end < at,
            "count": F.lit(told.rows < least or m.row_count != told.rows), "rows": F.lit(told.faulty > 0), "repeated": F.lit(told.repeated > 0), "revision": F.lit(not ok),
        }
        reasons = F.array_compact(F.array(*[F.when(fault, F.lit(name)) for name, fault in faults.items()]))
        out.append(spark.range(1).select(F.lit(m.generation_id).alias("generation_id"), reasons.alias("reasons")))
    if not out:
        return spark.createDataFrame([], "generation_id string, reasons array<string>")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
