"""Catalog rows with their lot's detail, and dossiers of fleet vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import lot_text as T
from gavelflow.operators.lots import money_cents
from gavelflow.operators.opportunities import array_union_distinct

NO_ORDER = 9999
MOST_MILES = 10_000_000


def attach_catalog_detail(catalog: DataFrame, details: DataFrame, key: str = "lot_id") -> DataFrame:
    """Catalog rows with their lot's detail as the struct ``detail``; null, and not
    ``detail_enriched``, where there is none. details has one row of each lot."""
    d = details.select(F.col(key), F.struct(*[c for c in details.columns if c != key]).alias("detail"), F.lit(True).alias("x_found"))
    return catalog.join(d, key, "left").withColumn("detail_enriched", F.coalesce("x_found", F.lit(False))).drop("x_found")


def attachments(images: Column, most: int = 6) -> Column:
    """Usable images by their order: array of (id, uri, name). images: array of struct of id,
    uri, name, valid, scan, position. Invalid and infected ones, and those without id, uri or
    name, are dropped; of the same id and uri the first counts."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    good = F.filter(images, lambda i: F.coalesce(i["valid"], F.lit(True)) & (F.upper(text(i["scan"])) != "INFECTED") & (text(i["id"]) != "") & (text(i["uri"]) != "") & (text(i["name"]) != ""))
    once = F.filter(good, lambda x, k: ~F.exists(F.slice(good, 1, k), lambda y: (y["id"] == x["id"]) & (y["uri"] == x["uri"])))
    placed = F.transform(once, lambda x, k: F.struct(F.coalesce(x["position"], F.lit(NO_ORDER)).alias("position"), k.alias("k"), x["id"].alias("id"), x["uri"].alias("uri"), x["name"].alias("name")))
    return F.slice(F.transform(F.array_sort(placed), lambda x: F.struct(x["id"].alias("id"), x["uri"].alias("uri"), x["name"].alias("name"))), 1, most)


def _spec(specs: Column, *labels: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(specs, F.lit(x))), F.lit("")) for x in labels])


def normalize_catalog_lots(rows: DataFrame, observed_year: int, *, body_rules=None, makes=None, damage_rules=None, issue_rules=None) -> DataFrame:
    """Typed lots of catalog rows with their detail.

    The structured odometer decides; where the text says another mileage the lot is flagged
    ``odometer-conflict`` and its notes say so. rows: lot_id, auction_id, title, city, state,
    agency, and detail (struct of description, odometer, make, model, body_type,
    condition_code, city, state, agency; may be null)."""
    d = lambda c: F.col(f"detail.{c}")
    html = F.coalesce(d("description"), F.lit(""))
    staged = rows.withColumns({"x_text": T.clean_text(html), "x_specs": T.spec_map(html), "x_title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled vehicle"))})
    title, text, specs = F.col("x_title"), F.col("x_text"), F.col("x_specs")
    whole = F.concat_ws(" ", title, text)
    staged = staged.withColumns({
        "x_odometer": T.parse_int(d("odometer")), "x_said": F.coalesce(T.parse_int(_spec(specs, "mileage", "odometer")), T.extract_mileage(text)),
        "x_year": T.extract_year(F.concat_ws(" ", title, _spec(specs, "model year")), observed_year), "x_make": F.coalesce(T.extract_make(title, makes), d("make"), _spec(specs, "make")),
        "x_flags": T.issue_flags(text, issue_rules), "x_body": F.coalesce(T.extract_body_type(F.concat_ws(" ", _spec(specs, "body style", "body type"), title, text), body_rules), d("body_type")),
    })
    conflict = F.coalesce(F.col("x_odometer") != F.col("x_said"), F.lit(False))
    mileage = F.coalesce("x_odometer", "x_said", T.extract_mileage(whole))
    note = F.when(conflict, F.concat(F.lit("Mileage conflict: odometer "), F.col("x_odometer").cast("string"), F.lit(" miles; description "), F.col("x_said").cast("string"), F.lit(" miles.")))
    here = d("city").isNotNull() | d("state").isNotNull()
    return staged.select(
        "lot_id", "auction_id", F.concat(F.lit("lot:"), F.col("auction_id").cast("string")).alias("id"), title.alias("title"), text.alias("description"), F.col("x_year").alias("year"), F.col("x_make").alias("make"),
        F.coalesce(d("model"), _spec(specs, "model"), T.model_label(title, F.col("x_year"), F.col("x_make"))).alias("model_label"), T.extract_vin(F.concat_ws(" ", _spec(specs, "vin"), whole)).alias("vin"), mileage.alias("mileage"),
        F.when(mileage.isNull(), "not-reported").when(conflict, "conflicting-readings").otherwise("reported-not-verified").alias("odometer_status"), F.col("x_body").alias("body_type"),
        T.condition_of(d("condition_code")).alias("condition"), T.operability(text).alias("operability"), T.damage_flags(text, damage_rules).alias("damage_flags"),
        F.concat(F.col("x_flags"), F.when(conflict, F.array(F.lit("odometer-conflict"))).otherwise(F.array().cast("array<string>"))).alias("issue_flags"),
        F.array_compact(F.array(note)).alias("condition_notes"), _spec(specs, "transmission type", "transmission").alias("transmission"), _spec(specs, "color", "exterior color").alias("color"),
        F.when(here, d("city")).otherwise(F.col("city")).alias("city"), F.when(here, d("state")).otherwise(F.col("state")).alias("state"), F.coalesce(d("agency"), F.col("agency")).alias("agency"), "detail_enriched",
    )


def equipment(*lists: Column) -> Column:
    """Items of texts that ``;`` separates, once each, in order, none over 512 characters."""
    every = F.flatten(F.array(*[F.split(F.coalesce(x, F.lit("")), ";") for x in lists]))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= 512)))


def normalize_fleet_detail(raw: DataFrame, year_now: int, observed_at: Column) -> DataFrame:
    """Dossiers of fleet vehicles; rows without id or vehicle number come back with ``reject``."""
    text = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit(""))
    ends, longer = T.parse_time(F.col("saleEndDate")), T.parse_time(F.col("extendedSaleEndDate"))
    miles, year = T.parse_int(F.col("vehicleMiles")), T.parse_int(F.col("modelYear"))
    return raw.select(
        text("id").alias("source_id"), F.upper(text("vin")).alias("vin"), text("saleNumber").alias("sale_number"), F.when(year.between(1900, year_now + 2), year).cast("int").alias("year"),
        text("makeName").alias("make"), text("modelName").alias("model"), text("vehicleSeries").alias("series"), text("vehicleBodyStyle").alias("body_style"), F.when(miles <= MOST_MILES, miles).alias("mileage"),
        T.parse_int(F.col("openRecall")).alias("open_recall_count"), text("comments").alias("comments"), equipment(F.col("vehicleAdditionalEquip1"), F.col("vehicleAdditionalEquip2")).alias("equipment"),
        T.parse_time(F.col("saleStartDate")).alias("starts_at"), F.greatest(ends, longer).alias("effective_ends_at"), money_cents(F.col("highBid")).alias("high_bid_cents"), money_cents(F.col("winningBidAmt")).alias("winning_bid_cents"),
        T.image_array(F.concat_ws("|", F.concat_ws("|", array_union_distinct(F.array("photoUrlLarge", "photoUrl"), F.col("gallery"))))).alias("images"), F.coalesce(F.col("approved"), F.lit(False)).alias("condition_report_approved"), observed_at.alias("observed_at"),
        F.when(text("id").isNull(), "missing-id").when(text("vin").isNull(), "missing-vin").alias("reject"),
    )
