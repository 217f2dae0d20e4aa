"""Landed payloads: collections, pages, fallbacks between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLECTIONS = ("results", "auctions", "items", "data")


def read_lot_payloads(spark: SparkSession, path: str, record: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of JSON files: an array, or an object with an array of records
    under one of the known names, also one level down. Others are quarantined."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    parsed = raw.withColumn("v", F.try_parse_json("value"))
    paths = ["$", *[f"$.{a}" for a in COLLECTIONS], *[f"$.{a}.{b}" for a in COLLECTIONS for b in COLLECTIONS[:3]]]
    arrays = [F.try_variant_get("v", p, "array<variant>") for p in paths]
    found = parsed.withColumn("records", F.coalesce(*arrays))
    wide = T.StructType([T.StructField(f.name, f.dataType, True) for f in record])
    rows = found.filter("records IS NOT NULL").select("file", F.posexplode("records").alias("pos", "r"))
    rows = rows.select("file", "pos", F.from_json(F.to_json("r"), wide).alias("record")).filter("record IS NOT NULL").select("file", "pos", "record.*")
    return rows, found.filter("records IS NULL").select("file", "value")


def resolve_fields(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each field from the first of its names that there is: exactly, else whatever its case."""
    lower = {c.lower(): c for c in reversed(df.columns)}

    def find(names: list[str]) -> Column:
        exact = [n for n in names if n in df.columns]
        loose = [lower[n.lower()] for n in names if n.lower() in lower]
        found = list(dict.fromkeys(exact + loose))
        return F.coalesce(*[F.col(f"`{c}`") for c in found]) if found else F.lit(None).cast("string")

    return df.select(*[find(names).alias(field) for field, names in aliases.items()])


def assemble_catalog(pages: DataFrame) -> DataFrame:
    """The last row of each id of a snapshot, with ``complete``: whether the advertised total
    never changed and equals the distinct ids. pages: snapshot_id, page, pos, total, id, ..."""
    order = Window.partitionBy("snapshot_id", "id").orderBy(F.desc("page"), F.desc("pos"))
    rows = pages.withColumn("x_turn", F.row_number().over(order)).filter("x_turn = 1").drop("x_turn")
    told = pages.groupBy("snapshot_id").agg(F.count_distinct("total").alias("totals"), F.max("total").alias("total_max"), F.count_distinct("id").alias("ids"))
    told = told.select("snapshot_id", ((F.col("totals") == 1) & (F.col("total_max") == F.col("ids"))).alias("complete"))
    return rows.join(told, "snapshot_id")


def scan_closed(ledger: DataFrame, since: Column, through: Column, statuses: tuple[str, ...] = ("Closed", "Sale Complete")) -> DataFrame:
    """Closed sales that ended from since up to, not at, through; pushed down to the files."""
    return ledger.filter(F.col("status").isin(*statuses) & (F.col("ended_at") >= since) & (F.col("ended_at") < through))


def scan_awarded(ledger: DataFrame) -> DataFrame:
    """Confirmed awards with a price, a plausible year, make, model and times."""
    return ledger.filter((F.col("award_status") == "confirmed") & (F.col("awarded_price_cents") > 0) & F.col("year").between(1900, 2200) & (F.trim("make") != "") & (F.trim("model") != "") & F.col("ended_at").isNotNull())


def newest_outcome(ledger: DataFrame) -> DataFrame:
    """One row: newest, the last time that a confirmed award with a price was observed."""
    return ledger.filter((F.col("award_status") == "confirmed") & (F.col("awarded_price_cents") > 0)).agg(F.max("outcome_observed_at").alias("newest"))


def pick_source(rows: DataFrame, health: DataFrame, now: Column, order: list[str], most_age_hours: int = 24, least_rows: int = 1) -> DataFrame:
    """The rows of the first source, in order, that is complete, large enough and no older.
    health: source, complete, observed_at, with a row for each source."""
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    age = F.unix_micros(now) - F.unix_micros("observed_at")
    good = health.join(sizes, "source").filter(F.col("complete") & (F.col("n") >= least_rows) & (age >= 0) & (age <= most_age_hours * 3_600_000_000) & (rank > 0))
    chosen = good.select("source", rank.alias("rank")).orderBy("rank", "source").limit(1)
    return rows.join(F.broadcast(chosen.select("source")), "source", "left_semi")  # one row


def durable_or_recent(durable: DataFrame, checks: DataFrame, recent: DataFrame, advertised: DataFrame, scope: str, *, least_rows: int = 100) -> DataFrame:
    """Of each scope, with ``mode``: the durable rows, where they are ``least_rows`` or more and
    a sync of the scope was completed; else the rows of the recent window, where they are as
    many as its source advertised. A scope with neither has no rows.

    checks: scope, success, coverage; advertised: scope, advertised."""
    count = lambda rows, name: rows.groupBy(scope).agg(F.count(F.lit(1)).alias(name))
    synced = checks.filter((F.col("success") == 1) & (F.col("coverage") == "complete")).select(scope).distinct()
    firm = count(durable, "n").filter(F.col("n") >= least_rows).join(synced, scope, "left_semi").select(scope)
    whole = count(recent, "n").join(advertised, scope).filter("n = advertised").join(firm, scope, "left_anti").select(scope)
    return durable.join(firm, scope, "left_semi").withColumn("mode", F.lit("durable")).unionByName(recent.join(whole, scope, "left_semi").withColumn("mode", F.lit("recent")))
