"""Rows of the board: a lot with its vehicle, valuation, forecast and assessment.

A board row's flat columns are what filters and orders read; details are nested. Valuation
columns: valuation_status, low_cents, median_cents, high_cents, valuation_confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import deals as D
from gavelflow.functions import lot_text as T
from gavelflow.functions.numbers import rounded
from gavelflow.operators.assessment import assess_deals
from gavelflow.operators.board import apply_live_state
from gavelflow.operators.forecasts import reference_forecast
from gavelflow.operators.lots import fleet_model

VALUE = ["valuation_status", "low_cents", "median_cents", "high_cents", "valuation_confidence"]
#: Fixed texts of a board row.
PENDING, NO_STATE = "Location pending", "—"
NO_MILEAGE, RECALL = "Mileage not reported", "Open recall disclosed"


def array_union_distinct(*arrays: Column) -> Column:
    """All items once, in order, without nulls and blanks."""
    every = F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def readable(flag: Column) -> Column:
    """Dashes and underscores to blanks, words in title case (the rest of a word as it is)."""
    words = F.split(F.regexp_replace(flag, "[-_]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def listed_flags(damage: Column, issues: Column, notes: Column, open_recall: Column, mileage: Column) -> Column:
    """Readable flags and notes, once each whatever their case, in order."""
    texts = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    said = F.array_compact(F.array(F.when(open_recall, F.lit(RECALL)), F.when(mileage.isNull(), F.lit(NO_MILEAGE))))
    every = F.concat(F.transform(texts(damage), readable), F.transform(texts(issues), readable), texts(notes), said)
    return F.filter(every, lambda x, i: (F.trim(x) != "") & ~F.exists(F.slice(every, 1, i), lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x))))


def lots_to_opportunities(lots: DataFrame, observed_at: Column) -> DataFrame:
    """Board rows of catalog lots, not yet valued.

    lots: id, sale_number, lot_number, title, url, images, status, starts_at, ends_at,
    current_bid (dollars), bidder_count, city, state, postal_code, year, make, model_label,
    vin, mileage, body_type, condition, operability, description, damage_flags, issue_flags,
    condition_notes, open_recall."""
    title = F.when(F.trim("title") != "", F.col("title")).otherwise("Untitled vehicle")
    year = F.coalesce(F.col("year"), F.nullif(F.regexp_extract(title, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int"), F.lit(0))
    model = F.coalesce("model_label", F.trim(F.regexp_replace(title, r"^\s*(?:19|20)\d{2}\s+", "")))
    sale_lot = F.array_join(F.filter(F.array("sale_number", "lot_number"), lambda x: x.isNotNull() & (x != "")), " · Lot ")
    return lots.select(
        F.concat(F.lit("live-"), F.regexp_replace("id", "(?i)[^a-z0-9]+", "-")).alias("id"), T.source_external_id(F.coalesce("url", F.lit("")), F.col("id")).alias("external_id"),
        F.when(sale_lot != "", sale_lot).otherwise(F.col("id")).alias("sale_lot_number"), F.lit("lots").alias("source"), title.alias("title"), F.col("url").alias("source_url"),
        array_union_distinct(F.col("images")).alias("images"), F.when(F.col("status") == "active", "active").otherwise("preview").alias("status"), "starts_at", "ends_at",
        F.lit("internet").alias("sale_type"), F.lit(True).alias("online_bidding"), rounded(F.col("current_bid") * 100).alias("current_bid_cents"), F.col("bidder_count").cast("int").alias("bidder_count"),
        observed_at.alias("last_checked_at"), F.coalesce("city", F.lit(PENDING)).alias("city"), F.coalesce("state", F.lit(NO_STATE)).alias("state"), F.coalesce("postal_code", F.lit("")).alias("postal_code"),
        F.col("vin"), F.col("mileage").cast("long").alias("mileage"), F.col("body_type").alias("body_style"), year.alias("year"), F.coalesce("make", F.lit("Make pending")).alias("make"), model.alias("model"),
        T.display_condition(F.col("condition")).alias("condition"), "operability", F.when(F.trim("description") != "", F.col("description")).otherwise("").alias("description"),
        listed_flags(F.col("damage_flags"), F.col("issue_flags"), F.col("condition_notes"), F.col("open_recall"), F.col("mileage")).alias("risk_flags"), F.lit("discovery").alias("kind"),
    )


def board_status(channel: Column, phase: Column) -> Column:
    """Only internet sales that run are active; a sale in person is never bid on online."""
    return F.when((channel == "internet") & (phase == "active"), "active").when(phase.isin("ended", "closed"), "ended").otherwise("preview")


def fleet_to_opportunities(listings: DataFrame, details: DataFrame, observed_at: Column) -> DataFrame:
    """Board rows of fleet listings with their dossier, where there is one.

    listings: source_id, external_key, vin, sale_number, sale_run_number, year, make, model,
    mileage, vehicle_type, condition_code, channel, phase, starts_at, effective_ends_at,
    high_bid_cents, images, url, city, state, postal_code; details: source_id, series,
    body_style, high_bid_cents, starts_at, effective_ends_at, images, comments, and
    open_recall_count."""
    d = details.select("source_id", *[F.col(c).alias(f"d_{c}") for c in ("series", "body_style", "high_bid_cents", "starts_at", "effective_ends_at", "images", "comments", "open_recall_count")])
    rows = listings.join(d, "source_id", "left")
    sale_lot = F.array_join(F.array_compact(F.array("sale_number", F.concat(F.lit("Run "), "sale_run_number"))), " · ")
    make = F.when(F.col("make") == F.upper("make"), F.initcap("make")).otherwise(F.col("make"))
    internet = F.col("channel") == "internet"
    model = fleet_model(F.col("model"))
    return rows.select(
        F.concat(F.lit("fleet-"), "source_id").alias("id"), F.col("external_key").alias("external_id"), F.coalesce(F.nullif(sale_lot, F.lit("")), "vin", "source_id").alias("sale_lot_number"), F.lit("fleet").alias("source"),
        F.concat_ws(" ", F.col("year").cast("string"), F.coalesce(make, F.lit("Make pending")), F.coalesce(model, F.lit("Model pending"))).alias("title"), F.col("url").alias("source_url"),
        array_union_distinct(F.col("d_images"), F.col("images")).alias("images"), board_status(F.col("channel"), F.col("phase")).alias("status"), F.coalesce("d_starts_at", "starts_at").alias("starts_at"),
        F.coalesce("d_effective_ends_at", "effective_ends_at").alias("ends_at"), F.col("channel").alias("sale_type"), F.coalesce(internet, F.lit(False)).alias("online_bidding"),
        F.when(internet, F.coalesce("d_high_bid_cents", "high_bid_cents")).alias("current_bid_cents"), F.lit(None).cast("int").alias("bidder_count"), observed_at.alias("last_checked_at"),
        F.coalesce("city", F.lit(PENDING)).alias("city"), F.coalesce("state", F.lit(NO_STATE)).alias("state"), F.coalesce("postal_code", F.lit("")).alias("postal_code"), "vin", F.col("mileage").cast("long").alias("mileage"),
        F.coalesce("d_body_style", "vehicle_type").alias("body_style"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(make, F.lit("Make pending")).alias("make"), F.coalesce(model, F.lit("Model pending")).alias("model"),
        T.display_condition(T.condition_of(F.col("condition_code")), usable_as="fair").alias("condition"), F.lit("unknown").alias("operability"), F.coalesce(F.trim("d_comments"), F.lit("")).alias("description"),
        listed_flags(F.array().cast("array<string>"), F.array().cast("array<string>"), F.array_compact(F.array(F.nullif(F.trim(F.substring("d_comments", 1, 500)), F.lit("")))), F.col("d_open_recall_count") > 0, F.col("mileage")).alias("risk_flags"), F.lit("fleet").alias("kind"),
    )


def reprice(board: DataFrame, valuations: DataFrame | None, outcomes: DataFrame, trends: DataFrame, as_of: Column, *, costs: D.Costs = D.Costs(), target: D.Target = D.Target(), data_confidence: Column | None = None) -> DataFrame:  # noqa: B008
    """board with its valuation (taken from ``valuations`` by id where that is given), forecast
    and assessment computed anew. The board's own status becomes lot_status.

    outcomes: valid_outcomes() by id; trends: bid_aggression() by id."""
    rows = board
    if valuations is not None:
        rows = board.drop(*VALUE).join(valuations.select("id", *VALUE), "id", "left")
        rows = rows.withColumns({"valuation_status": F.coalesce("valuation_status", F.lit("unavailable")), "valuation_confidence": F.coalesce("valuation_confidence", F.lit(0.0))})
    told = reference_forecast(rows.select("id", "current_bid_cents", "bidder_count", "ends_at", *VALUE), outcomes, trends, as_of)
    told = told.select("id", F.col("status").alias("forecast_status"), F.col("low_cents").alias("forecast_low"), F.col("expected_cents").alias("forecast_expected"), F.col("high_cents").alias("forecast_high"), F.col("confidence").alias("forecast_confidence"), "horizon_seconds")
    known = D.listing_confidence(F.col("vin"), F.col("mileage"), F.lit("valued")) if data_confidence is None else data_confidence
    rows = rows.drop("forecast_status", "forecast_low", "forecast_expected", "forecast_high", "forecast_confidence", "horizon_seconds").withColumnRenamed("status", "lot_status")
    return assess_deals(rows.join(told, "id").withColumn("data_confidence", known), costs, target)


def reprice_live(board: DataFrame, live: DataFrame, outcomes: DataFrame, trends: DataFrame, as_of: Column, *, costs: D.Costs = D.Costs(), target: D.Target = D.Target()) -> DataFrame:  # noqa: B008
    """The rows of the board that a strictly newer live state changes, with that state, and
    forecast and assessment anew. live: id, the live fields, last_checked_at; one row of an id."""
    moved = apply_live_state(board, live).filter("live").drop("live")
    return reprice(moved, None, outcomes, trends, as_of, costs=costs, target=target, data_confidence=F.lit(0.25))


def pollable() -> Column:
    """Active, and identified where its bids are read: fleet lots by vehicle number and an
    internet or unknown channel, others by a numeric id."""
    fleet = F.coalesce(F.trim("vin") != "", F.lit(False)) & F.coalesce(F.col("sale_type").isin("internet", "unknown"), F.lit(True))
    return (F.col("status") == "active") & F.when(F.col("source") == "fleet", fleet).otherwise(F.coalesce(F.col("external_id").rlike("^[1-9][0-9]*$"), F.lit(False)))


ANCHORS = 15


def compact_board(board: DataFrame) -> DataFrame:
    """Board rows without what only the single view needs. outcome_anchors (array) stay, as far
    as ANCHORS, where bids may still be polled; one image of fleet lots; one reason code."""
    live = F.col("status").isin("active", "closing")
    market_only = "MARKET_ONLY_BEFORE_PUBLIC_BID"
    return board.withColumns({
        "outcome_anchors": F.when(live, F.slice("outcome_anchors", 1, ANCHORS)).otherwise(F.slice("outcome_anchors", 1, 0)),
        "images": F.when(F.col("source") == "fleet", F.slice("images", 1, 1)).otherwise(F.col("images")),
        "description": F.lit(""), "reason_codes": F.slice("reason_codes", 1, 1),
        "forecast_codes": F.filter("forecast_codes", lambda c: c == market_only),
    })


LEAST_LOTS, LEAST_DETAILED, MOST_IMAGES = 10, 0.9, 6


def prepare_lot_snapshot(lots: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to export, one row of gate figures with ``ok``). Active lots only, with at most
    six trusted images, an expiry a day and an image expiry 55 minutes on.

    lots: id, status, detail_enriched, images."""
    hours = lambda minutes: F.timestamp_micros(F.unix_micros(now) + F.lit(minutes * 60_000_000))
    rows = lots.filter("status = 'active'").withColumns({
        "images": F.slice(F.filter("images", lambda u: u.rlike("(?i)^https://")), 1, MOST_IMAGES), "expires_at": hours(24 * 60), "images_expire_at": hours(55),
    })
    n = F.col("lots")
    gate = rows.agg(F.count(F.lit(1)).alias("lots"), F.count_distinct("id").alias("ids"), F.count_if("detail_enriched").alias("detailed"), F.count_if(F.size("images") > 0).alias("pictured"))
    ok = (n >= LEAST_LOTS) & (n == F.col("ids")) & (F.col("detailed") >= n * LEAST_DETAILED) & (F.col("pictured") >= n * LEAST_DETAILED)
    return rows, gate.withColumn("ok", ok)
