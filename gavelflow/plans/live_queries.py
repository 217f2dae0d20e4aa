"""Board rows, live updates, reprices, details, offers and ledger upkeep as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.functions import deals as D
from gavelflow.functions import identity, lot_text
from gavelflow.operators import board as B
from gavelflow.operators import catalog, forecasts, history, ledger, lots, offers, opportunities
from gavelflow.plans import board_queries, deal_queries
from gavelflow.plans.bindings import STREAM_NOW, ctes, view
from gavelflow.sources import gates, payloads

EVENT_NOW = "2024-01-15 12:00:00"


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(*columns: str) -> Column:
    return F.array_compact(F.array(*columns))


def lots_to_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_lots")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"images": _words("url"), "damage_flags": _words("flag"), "issue_flags": none, "condition_notes": F.array(F.lit("No Key"))})
    out = opportunities.lots_to_opportunities(rows, _ts("2024-01-01 00:00:00"))
    return out.select("id", "external_id", "sale_lot_number", "title", "status", "current_bid_cents", "city", "state", "year", "make", "model", "condition", F.array_join("risk_flags", ",").alias("risk_flags"))


def fleet_to_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_fleet").withColumn("images", F.array(F.lit("b")))
    details = rows.filter("detailed").select(
        "source_id", F.lit("XL").alias("series"), F.lit("Wagon").alias("body_style"), F.when(F.col("n") % 4 == 0, F.col("high_bid_cents") + 5).alias("high_bid_cents"), F.lit(None).cast("timestamp").alias("starts_at"),
        (F.col("effective_ends_at") + F.expr("INTERVAL 1 DAY")).alias("effective_ends_at"), F.array(F.lit("a"), F.lit("b")).alias("images"), F.lit(" fine ").alias("comments"), (F.col("n") % 5 == 0).cast("int").alias("open_recall_count"),
    )
    out = opportunities.fleet_to_opportunities(rows, details, _ts("2024-01-01 00:00:00"))
    return out.select("id", "sale_lot_number", "title", "status", "current_bid_cents", "online_bidding", F.unix_micros("ends_at").alias("ends_us"), "body_style", "condition", F.array_join("images", ",").alias("images"), F.array_join("risk_flags", ",").alias("risk_flags"))


def _identified(df: DataFrame) -> DataFrame:
    n = F.col("id").cast("long")
    return df.withColumns({"vin": F.when(n % 3 != 0, "v"), "mileage": F.when(n % 2 == 0, n), "status": F.lit("active")})


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes and bid trends of the open lots, as reference_forecast takes them."""
    seen = history.last_write_wins(view(spark, sf_dir, "outcomes"), ["id", "seen"], [F.col("outcome_id"), F.col("close_cents"), F.col("match_score"), F.col("weight")])
    observed = forecasts.valid_observations(view(spark, sf_dir, "bid_observations").drop("event_id"), _ts(STREAM_NOW))
    bids = view(spark, sf_dir, "open_lots").select(F.col("n").alias("auction_id"), (F.col("current_bid_cents") % 10_000).alias("current_bid_cents"))
    trends = forecasts.bid_aggression(observed, bids).select(F.col("auction_id").cast("string").alias("id"), "aggression", "observations")
    return forecasts.valid_outcomes(seen, "id", "seen"), trends


def reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _identified(view(spark, sf_dir, "open_lots").drop("n"))
    values = rows.select("id", *opportunities.VALUE).filter("valuation_status <> 'unavailable'")
    out = opportunities.reprice(rows, values, *_evidence(spark, sf_dir), _ts(STREAM_NOW), costs=deal_queries.COSTS, target=deal_queries.TARGET)
    return out.select("id", "status", "score", "tier", "safe_max_bid_cents", "expected_close_cents", "projected_profit_cents", "confidence", F.array_join("reason_codes", ",").alias("reason_codes"))


def compact_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("id", 5, 20).cast("long")
    rows = view(spark, sf_dir, "board").withColumns({
        "outcome_anchors": F.sequence(F.lit(1), (n % 25 + 1).cast("int")), "images": F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), lambda k: k.cast("string")), "description": F.col("title"),
        "reason_codes": F.array("state", "city"), "forecast_codes": F.when(n % 2 == 0, F.array(F.lit("X"), F.lit("MARKET_ONLY_BEFORE_PUBLIC_BID"))).otherwise(F.array(F.lit("X"))),
    })
    out = opportunities.compact_board(rows)
    return out.select("id", F.size("outcome_anchors").alias("anchors"), F.array_join("images", ",").alias("images"), "description", F.array_join("reason_codes", ",").alias("reason_codes"), F.array_join("forecast_codes", ",").alias("forecast_codes"))


def pollable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("id", 5, 20).cast("long")
    rows = view(spark, sf_dir, "board").withColumns({"sale_type": F.when(n % 4 == 0, "live").when(n % 4 == 1, "internet"), "external_id": F.when(n % 5 == 0, F.concat(F.lit("x"), n.cast("string"))).otherwise(n.cast("string"))})
    return rows.filter(opportunities.pollable()).select("id", "source")


def prepare_lot_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "board").withColumns({"detail_enriched": F.col("vin").isNotNull(), "images": F.array(F.concat(F.lit("https://i/"), "id"), F.concat(F.lit("ftp://i/"), "id"))})
    out, gate = opportunities.prepare_lot_snapshot(rows, _ts("2024-01-01 00:00:00"))
    return out.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("images")).alias("images"), F.unix_micros(F.max("expires_at")).alias("expires_us")).crossJoin(gate)  # one row each


def apply_live_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.apply_live_updates(view(spark, sf_dir, "live_auctions"), view(spark, sf_dir, "live_checks"))
    return out.select("external_id", "status", "current_bid_cents", F.unix_micros("ended_at").alias("ended_us"), "final_bid_cents", "final_status", F.unix_micros("price_changed_at").alias("changed_us"), F.unix_micros("last_checked_at").alias("checked_us"))


def live_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.live_observations(view(spark, sf_dir, "live_auctions"), view(spark, sf_dir, "live_checks"))
    return out.select("auction_id", F.unix_micros("observed_at").alias("observed_us"), "current_bid_cents", "status", "extension_count")


def close_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    auctions, vehicles, live = view(spark, sf_dir, "live_auctions"), view(spark, sf_dir, "order_vehicles"), view(spark, sf_dir, "live_checks")
    old = ledger.closed_rows(auctions.filter("auction_id % 4 = 0"), vehicles, F.col("ends_at"), F.col("ends_at")).withColumn("award_status", F.lit("confirmed"))
    out = ledger.close_live(old, ledger.apply_live_updates(auctions, live), vehicles, live)
    return out.select("external_id", "closed_high_bid_cents", "award_status", "outcome_status", F.unix_micros("outcome_observed_at").alias("observed_us"))


def auction_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.auction_vehicles(view(spark, sf_dir, "live_auctions"), view(spark, sf_dir, "order_vehicles")).select("auction_id", "status", "vin", "model")


def link_source_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "comp_updates").select("source_key", F.split_part("external_id", F.lit("-"), F.lit(2)).alias("external_id"), F.col("external_id").alias("sale"))
    return ledger.link_source_auction(rows, view(spark, sf_dir, "live_auctions")).select("sale", "source_auction_id")


def log_source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("check_id"), F.lit(0).alias("success"), F.lit("in-progress").alias("coverage"), *[F.lit(None).cast(t).alias(c) for c, t in (("result_count", "long"), ("expected_count", "long"), ("error_code", "string"))])
    done = rows.filter("check_id % 4 <> 0").select("check_id", (F.col("check_id") % 9).alias("received"), (F.col("check_id") % 9 + (F.col("check_id") % 5 == 0).cast("int")).alias("expected"), F.when(F.col("check_id") % 7 == 0, "TIMEOUT").alias("error_code"))
    return ledger.log_source_check(rows, done).select("check_id", "success", "coverage", "result_count", "error_code")


def sync_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = view(spark, sf_dir, "checks").withColumn("scope", F.lit("daily"))
    out = ledger.sync_cursor(checks, view(spark, sf_dir, "comp_updates"), "daily")
    return out.select(F.unix_micros("covered_through").alias("covered_us"), F.unix_micros("earliest").alias("earliest_us"))


def refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavelflow.functions import cadence

    rows = cadence.close_bucket(view(spark, sf_dir, "seen_auctions"), _ts(EVENT_NOW))
    return ledger.refresh_summary(rows.withColumns({"success": F.when(F.col("auction_id") % 3 > 0, F.col("auction_id") % 3 == 1), "appended": F.col("auction_id") % 2 == 0}))


def cache_valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "deals").select("n", F.when(F.col("n") % 3 == 0, "offers").when(F.col("n") % 3 == 1, "comps").otherwise("miss").alias("kind"))
    out = ledger.cache_valuations(rows, _ts(EVENT_NOW))
    return out.select("n", F.unix_micros("expires_at").alias("expires_us"))


def usable_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "live_auctions").withColumn("status", F.when(F.col("status") == "sold", "closed").otherwise(F.col("status")))
    good, told = ledger.usable_closed(rows)
    return good.agg(F.sum("current_bid_cents").alias("bids")).crossJoin(told)  # one row each


def retained_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.retained_coverage(view(spark, sf_dir, "comp_updates"))
    return out.select("rows", "detailed", F.unix_micros("earliest").alias("earliest_us"), F.unix_micros("latest").alias("latest_us"))


def combine_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = view(spark, sf_dir, "raw_lots").select("id", "lot_number"), view(spark, sf_dir, "raw_fleet").select(F.col("source_id").alias("id"), "sale_run_number")
    return ledger.corpus_order(ledger.combine_sources(a, b).withColumn("ended_at", F.lit(1)), "id").select("id", "lot_number", "sale_run_number")


def append_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.last_write_wins(view(spark, sf_dir, "bid_observations"), ["auction_id", "observed_at"], [F.desc("event_id")])
    cut = _ts(EVENT_NOW)
    return ledger.append_observations(rows.filter(F.col("observed_at") < cut), rows.filter((F.col("observed_at") >= cut) | (F.col("event_id") % 10 == 0))).select("event_id", "auction_id")


def upsert_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "vehicles").drop("make", "year").withColumns({"body_type": F.lit("b"), "operability": F.lit("unknown")})
    new = rows.filter("auction_id % 2 = 0").withColumns({"vin": F.when(F.col("auction_id") % 4 == 0, F.col("vin")), "mileage": F.when(F.col("auction_id") % 8 == 0, F.lit(7).cast("long")), "model": F.lit("new"), "condition": F.when(F.col("auction_id") % 3 == 0, "salvage").otherwise("unknown")})
    return ledger.upsert_vehicles(rows.filter("auction_id % 5 <> 1"), new).select("auction_id", "vin", "mileage", "model", "condition")


def latest_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "comp_updates").select(F.col("part_id").alias("auction_id"), F.when(F.col("supplier_id") % 3 == 0, "market").otherwise("comps").alias("provider"), F.col("observed_at").alias("created_at"), (F.col("ended_at") + F.expr("INTERVAL 400 DAY")).alias("expires_at"), "external_id")
    rows = history.last_write_wins(rows, ["auction_id", "provider", "created_at"], [F.col("external_id")])
    return history.latest_valuation(rows, _ts("1999-01-01 00:00:00"), "market").select("auction_id", "provider", "external_id")


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("generated_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 55 MINUTE")).alias("images_expire_at"))
    out = B.staleness(rows, _ts(EVENT_NOW))
    return out.select("event_id", F.unix_micros("expires_at").alias("expires_us"), "stale", F.unix_micros("stale_since").alias("since_us"), "age_seconds")


def plausibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "seen_auctions")
    now = rows.filter(F.col("last_seen_at") >= _ts(EVENT_NOW)).agg(F.count(F.lit(1)).alias("expected"), F.count("external_id").alias("received"), F.count_distinct("external_id").alias("distinct_ids"))
    before = rows.filter(F.col("last_seen_at") < _ts(EVENT_NOW)).agg((F.count(F.lit(1)) * 3).alias("received"))
    return ledger.plausibility_gate(now, before)


def condition_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    flags = lambda n: F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: (k % 5).cast("string"))
    value = D.condition_adjustment(pick(["good", "fair", "repairable", "salvage"], key), pick(["runs", "non-operational", "unknown"], key), flags(key % 7), flags(key % 3))
    return rows.select("p_partkey", F.round(value, 9).alias("adjustment"))


def listing_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "vehicles")
    kind = F.when(F.col("auction_id") % 3 == 0, "fleet").when(F.col("auction_id") % 3 == 1, "valued").otherwise("discovery")
    bid = F.when(F.col("auction_id") % 5 > 0, F.col("auction_id") % 5 - 1)
    return rows.select("auction_id", D.listing_confidence(F.col("vin"), F.col("mileage"), kind).alias("confidence"), D.outcome_status(bid, F.col("auction_id") % 2).alias("outcome"), lot_text.display_condition(F.col("condition"), "fair").alias("shown"))


def scan_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "live_auctions").withColumn("status", F.when(F.col("status") == "sold", "Closed").when(F.col("status") == "preview", "Sale Complete").otherwise("Open")).withColumn("ended_at", F.col("ends_at"))
    return payloads.scan_closed(rows, _ts("1995-01-01 00:00:00"), _ts("1996-06-01 00:00:00")).select("auction_id", "status")


def scan_awarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "order_vehicles").join(view(spark, sf_dir, "live_auctions").select("auction_id", "current_bid_cents", F.col("ends_at").alias("ended_at"), F.col("ends_at").alias("outcome_observed_at")), "auction_id")
    rows = rows.withColumns({"award_status": F.when(F.col("auction_id") % 2 == 0, "confirmed").otherwise("unknown"), "awarded_price_cents": F.col("current_bid_cents"), "make": F.when(F.col("auction_id") % 3 == 0, " ").otherwise(F.col("make"))})
    good, newest = payloads.scan_awarded(rows), payloads.newest_outcome(rows)
    return good.agg(F.count(F.lit(1)).alias("rows"), F.sum("awarded_price_cents").alias("cents")).crossJoin(newest.select(F.unix_micros("newest").alias("newest_us")))  # one row each


def valuation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "open_lots").select("id", F.col("valuation_status").alias("status"), "low_cents", F.when(F.col("n") % 7 == 0, F.col("low_cents") - 1).otherwise(F.col("median_cents")).alias("median_cents"), "high_cents", F.col("valuation_confidence").alias("confidence"), (F.col("n") % 6).alias("sample_size"))
    return gates.validate(rows, gates.valuation_rules()).select("id", F.array_join("violations", ",").alias("violations"))


def vehicle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    vin = F.concat(F.lit(" "), F.when(key % 3 == 0, F.lpad(key.cast("string"), 17, "a")).otherwise(F.lpad(key.cast("string"), 17, "I")))
    url = F.when(key % 2 == 0, F.concat(F.lit("https://x/preview/"), key.cast("string"), F.lit("?a"))).otherwise(F.lit(""))
    return rows.select(
        "p_partkey", identity.canonical_vin(vin).alias("vin"), identity.vehicle_key(F.when(key % 5 > 0, F.lit(2000)), F.when(key % 2 == 0, F.col("p_brand")), F.col("p_name"), F.col("p_type")).alias("vehicle_key"),
        lot_text.source_external_id(url, F.concat(F.lit("gsa-fleet:"), key.cast("string"))).alias("external_id"), lot_text.sale_number(F.concat("p_brand", F.lit("/"), "p_name")).alias("sale_number"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    image = F.struct(
        line.alias("at"), (F.col("l_partkey") % 7).cast("string").alias("id"), (F.col("l_suppkey") % 2).cast("string").alias("uri"), F.when(line % 5 > 0, "n").alias("name"), (line % 4 != 0).alias("valid"),
        F.when(F.col("l_returnflag") == "R", "infected").otherwise("clean").alias("scan"), F.when(line % 3 > 0, (line * 5 % 4).cast("int")).alias("position"),
    )
    held = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(image).alias("i")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("images"))
    return held.select("l_orderkey", F.array_join(F.transform(catalog.attachments(F.col("images")), lambda x: F.concat(x["id"], F.lit(":"), x["uri"])), ",").alias("images"))


def catalog_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rows = parts.select(key.alias("lot_id"), (key * 10).alias("auction_id"), F.concat((1990 + key % 30).cast("string"), F.lit(" Ford "), "p_brand").alias("title"), F.lit("Reno").alias("city"), F.lit("NV").alias("state"), F.lit("A").alias("agency"))
    text = F.concat(F.lit("<p>Mileage: "), (key % 1000 * 7).cast("string"), F.lit("</p><p>Color: "), "p_type", F.lit("</p>"))
    none = F.lit(None).cast("string")
    details = parts.filter("p_partkey % 4 <> 0").select(
        key.alias("lot_id"), text.alias("description"), F.when(key % 3 == 0, (key % 1000 * 7 + key % 2).cast("string")).alias("odometer"), none.alias("make"), none.alias("model"), none.alias("body_type"),
        F.when(key % 2 == 0, "U").otherwise("X").alias("condition_code"), none.alias("city"), F.when(key % 5 == 0, "CA").alias("state"), F.when(key % 6 == 1, "B").alias("agency"),
    )
    out = catalog.normalize_catalog_lots(catalog.attach_catalog_detail(rows, details), 2024)
    return out.select("lot_id", "year", "make", "mileage", "odometer_status", "color", "condition", "city", "state", "agency", "detail_enriched", F.size("condition_notes").alias("notes"), F.array_contains("issue_flags", "odometer-conflict").alias("conflict"))


def fleet_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    given = {
        "id": F.when(key % 9 > 0, text(key)), "vin": F.concat(F.lit(" v"), text(key)), "saleNumber": F.lit("S"), "modelYear": text(1890 + key % 140), "makeName": F.concat(F.lit("a  "), "o_orderpriority"), "vehicleMiles": text(key % 100),
        "vehicleAdditionalEquip1": F.concat(F.lit("AC; "), "o_orderpriority"), "vehicleAdditionalEquip2": F.concat("o_orderpriority", F.lit(";Tow;")), "highBid": text(F.round(key / 4, 2)), "comments": F.lit(" a  b "),
    }
    names = ["modelName", "vehicleSeries", "vehicleBodyStyle", "openRecall", "saleStartDate", "saleEndDate", "extendedSaleEndDate", "winningBidAmt", "photoUrlLarge", "photoUrl"]
    raw = rows.select("o_orderkey", *[c.alias(n) for n, c in given.items()], *[none.alias(n) for n in names], F.array().cast("array<string>").alias("gallery"), F.lit(True).alias("approved"))
    out = catalog.normalize_fleet_detail(raw, 2024, _ts(EVENT_NOW))
    return out.select("source_id", "vin", "year", "make", "mileage", F.array_join("equipment", ";").alias("equipment"), "high_bid_cents", "comments", F.coalesce("reject", F.lit("")).alias("reject"))


def market_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part, with its sales as offers."""
    rows = _read(spark, sf_dir, "lineitem").select("l_partkey", F.struct((F.col("l_quantity") * 1000).cast("long").alias("mileage"), F.col("l_extendedprice").cast("long").cast("string").alias("amount")).alias("o"))
    held = rows.groupBy("l_partkey").agg(F.collect_list("o").alias("offers"))
    head = F.concat(F.lit('{"percentileLow":'), F.when(F.col("l_partkey") % 2 == 0, F.lit('"$1k"')).otherwise(F.lit("null")), F.lit(',"percentileHigh":null,"offers":'), F.to_json("offers"), F.lit("}"))
    page = F.concat(F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"appraisalData":'), head, F.lit("}}}</script>"))
    out = offers.extract_market_offers(held.select(F.col("l_partkey").alias("page_id"), page.alias("html")))
    return out.select("page_id", "low_cents", "high_cents", F.size("offers").alias("offers"), "reported_sample_size", "basis")


def fleet_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_fleet").select("source_id", F.when(F.col("phase") == "closed", "Closed").otherwise("Open").alias("sale_status"), F.lit("lotted").alias("outcome"), "starts_at", "effective_ends_at", F.lit(True).alias("is_comparable_outcome"), F.col("high_bid_cents").alias("final_price_cents"))
    out = lots.awarded_outcomes(lots.rephase(rows, _ts("1997-01-01 00:00:00")))
    return out.select("source_id", "phase")


QUERIES = {
    f.__name__: f
    for f in (
        lots_to_opportunities, fleet_to_opportunities, reprice, compact_board, pollable, prepare_lot_snapshot, apply_live_updates, live_observations, close_live, auction_vehicles, link_source_auction, log_source_check,
        sync_cursor, refresh_summary, cache_valuations, usable_closed, retained_coverage, combine_sources, append_observations, upsert_vehicles, latest_valuation, staleness, plausibility_gate, condition_adjustment,
        listing_confidence, scan_closed, scan_awarded, valuation_gate, vehicle_keys, attachments, catalog_lots, fleet_details, market_offers, fleet_phases,
    )
}

ENOW = f"TIMESTAMP '{EVENT_NOW}'"
REPRICED = deal_queries.ORACLE_SQL["assess_deals"].replace(
    ctes("deals"),
    f"""WITH rf AS ({deal_queries.ORACLE_SQL['reference_forecast']}), lots AS ({ctes('open_lots')} SELECT * FROM open_lots),
    deals AS (SELECT lots.id, current_bid_cents, valuation_status, CASE WHEN valuation_status <> 'unavailable' THEN lots.low_cents END AS low_cents, CASE WHEN valuation_status <> 'unavailable' THEN valuation_confidence ELSE 0.0 END AS valuation_confidence,
        rf.status AS forecast_status, rf.low_cents AS forecast_low, rf.expected_cents AS forecast_expected, rf.high_cents AS forecast_high, rf.confidence AS forecast_confidence, CASE WHEN n % 3 <> 0 AND n % 2 = 0 THEN 0.65 ELSE 0.45 END AS data_confidence
        FROM lots JOIN rf ON lots.id = rf.id)""",
)
LIVE = f"""{ctes('live_auctions', 'live_checks', 'order_vehicles')},
    latest AS (SELECT * FROM live_checks QUALIFY row_number() OVER (PARTITION BY auction_id ORDER BY last_checked_at DESC, current_bid_cents DESC NULLS LAST, status, ends_at DESC) = 1),
    j AS (SELECT a.*, coalesce(l.last_checked_at > a.last_checked_at, false) AS newer, l.status AS s, l.current_bid_cents AS b, l.bidder_count AS bs, l.ends_at AS e, l.last_checked_at AS c FROM live_auctions a LEFT JOIN latest l USING (auction_id)),
    after AS (SELECT auction_id, external_id, CASE WHEN newer THEN s ELSE status END AS status, CASE WHEN newer THEN b ELSE current_bid_cents END AS current_bid_cents, CASE WHEN newer THEN bs ELSE bidder_count END AS bidder_count,
        CASE WHEN newer AND s = 'ended' THEN coalesce(ended_at, e) ELSE ended_at END AS ended_at, CASE WHEN newer AND s = 'ended' THEN b ELSE final_bid_cents END AS final_bid_cents, CASE WHEN newer AND s = 'ended' THEN 'closed-high-bid-unverified' ELSE final_status END AS final_status,
        CASE WHEN newer AND (b IS DISTINCT FROM current_bid_cents OR bs IS DISTINCT FROM bidder_count) THEN c ELSE price_changed_at END AS price_changed_at, CASE WHEN newer THEN c ELSE last_checked_at END AS last_checked_at FROM j)"""
OUTCOME = "CASE WHEN current_bid_cents > 0 THEN 'closed-high-bid' WHEN current_bid_cents = 0 AND bidder_count = 0 THEN 'no-bid' ELSE 'closed-outcome-unknown' END"

ORACLE_SQL = {
    "lots_to_opportunities": f"""{ctes('raw_lots')}, r AS (SELECT *, CASE WHEN trim(title) = '' THEN 'Untitled vehicle' ELSE title END AS t FROM raw_lots)
        SELECT 'live-gsa-sale-' || n AS id, CASE WHEN n % 2 = 0 THEN n::VARCHAR ELSE id END AS external_id, concat_ws(' · Lot ', sale_number, lot_number) AS sale_lot_number, t AS title, CASE status WHEN 'active' THEN 'active' ELSE 'preview' END AS status,
            floor(current_bid * 100 + 0.5::DOUBLE)::BIGINT AS current_bid_cents, coalesce(city, 'Location pending') AS city, coalesce(state, '—') AS state,
            CASE WHEN n % 3 = 0 THEN 2001 WHEN t = 'Untitled vehicle' THEN 0 ELSE 1990 + n % 30 END::INT AS year, coalesce(make, 'Make pending') AS make, coalesce(model_label, CASE WHEN t = 'Untitled vehicle' THEN t ELSE substring(t, 6) END) AS model,
            CASE condition WHEN 'new' THEN 'good' WHEN 'usable' THEN 'good' WHEN 'repairable' THEN 'repairable' WHEN 'scrap' THEN 'salvage' ELSE 'unknown' END AS condition,
            concat_ws(',', CASE WHEN n % 10 < 3 THEN 'Frame Damage' END, 'No Key', CASE WHEN open_recall THEN 'Open recall disclosed' END, CASE WHEN mileage IS NULL THEN 'Mileage not reported' END) AS risk_flags FROM r""",
    "fleet_to_opportunities": f"""{ctes('raw_fleet')}, r AS (SELECT *, CASE n % 4 WHEN 0 THEN 'Grand Cherokee' WHEN 1 THEN 'Transit' WHEN 2 THEN 'Titan' ELSE 'Model pending' END AS m, CASE WHEN n % 2 = 0 THEN 'Ford' ELSE 'Ram' END AS mk FROM raw_fleet)
        SELECT 'fleet-' || n AS id, coalesce(nullif(concat_ws(' · ', sale_number, 'Run ' || sale_run_number), ''), vin, source_id) AS sale_lot_number, concat_ws(' ', year, mk, m) AS title,
            CASE WHEN channel = 'internet' AND phase = 'active' THEN 'active' WHEN phase = 'closed' THEN 'ended' ELSE 'preview' END AS status,
            CASE WHEN channel = 'internet' THEN CASE WHEN detailed AND n % 4 = 0 THEN high_bid_cents + 5 ELSE high_bid_cents END END AS current_bid_cents, channel = 'internet' AS online_bidding,
            epoch_us(CASE WHEN detailed THEN effective_ends_at + INTERVAL 1 DAY ELSE effective_ends_at END) AS ends_us, CASE WHEN detailed THEN 'Wagon' ELSE 'SUV' END AS body_style,
            CASE condition_code WHEN 'U' THEN 'fair' WHEN 'X' THEN 'salvage' ELSE 'unknown' END AS condition, CASE WHEN detailed THEN 'a,b' ELSE 'b' END AS images,
            concat_ws(',', CASE WHEN detailed THEN 'fine' END, CASE WHEN detailed AND n % 5 = 0 THEN 'Open recall disclosed' END, CASE WHEN mileage IS NULL THEN 'Mileage not reported' END) AS risk_flags FROM r""",
    "reprice": f"SELECT id, status, score, tier, safe_max_bid_cents, expected_close_cents, projected_profit_cents, confidence, reason_codes FROM ({REPRICED})",
    "compact_board": f"""{ctes('board')}, b AS (SELECT *, CAST(substring(id, 5) AS BIGINT) AS n FROM board)
        SELECT id, CASE WHEN status IN ('active', 'closing') THEN least(15, n % 25 + 1) ELSE 0 END::INT AS anchors, CASE WHEN source = 'fleet' THEN '1' ELSE ['1', '1,2', '1,2,3'][n % 3 + 1] END AS images, '' AS description, state AS reason_codes,
            CASE WHEN n % 2 = 0 THEN 'MARKET_ONLY_BEFORE_PUBLIC_BID' ELSE '' END AS forecast_codes FROM b""",
    "pollable": f"""{ctes('board')}, b AS (SELECT *, CAST(substring(id, 5) AS BIGINT) AS n FROM board)
        SELECT id, source FROM b WHERE status = 'active' AND CASE WHEN source = 'fleet' THEN vin IS NOT NULL AND n % 4 <> 0 ELSE n % 5 <> 0 END""",
    "prepare_lot_snapshot": f"""{ctes('board')}, a AS (SELECT count(*) AS lots, count(DISTINCT id) AS ids, count(vin) AS detailed FROM board WHERE status = 'active')
        SELECT lots AS rows, lots::BIGINT AS images, epoch_us(TIMESTAMP '2024-01-02 00:00:00') AS expires_us, lots, ids, detailed, lots AS pictured, lots >= 10 AND lots = ids AND detailed >= lots * 0.9 AS ok FROM a""",
    "apply_live_updates": f"""{LIVE} SELECT external_id, status, current_bid_cents, epoch_us(ended_at) AS ended_us, final_bid_cents, final_status, epoch_us(price_changed_at) AS changed_us, epoch_us(last_checked_at) AS checked_us FROM after""",
    "live_observations": f"""{LIVE},
        d AS (SELECT * FROM live_checks QUALIFY row_number() OVER (PARTITION BY auction_id, last_checked_at ORDER BY current_bid_cents DESC NULLS LAST, status, ends_at DESC) = 1),
        o AS (SELECT auction_id, d.last_checked_at, d.current_bid_cents AS b, d.bidder_count AS bs, d.status AS s, d.ends_at AS e, a.current_bid_cents AS ab, a.bidder_count AS abs_, a.status AS st, a.ends_at AS ae, extension_count AS x FROM d JOIN live_auctions a USING (auction_id) WHERE d.last_checked_at > a.last_checked_at),
        w AS (SELECT *, row_number() OVER p AS k, lag(b) OVER p AS lb, lag(bs) OVER p AS lbs, lag(s) OVER p AS ls, lag(e) OVER p AS le FROM o WINDOW p AS (PARTITION BY auction_id ORDER BY last_checked_at)),
        v AS (SELECT *, CASE WHEN k = 1 THEN ab ELSE lb END AS wb, CASE WHEN k = 1 THEN abs_ ELSE lbs END AS wbs, CASE WHEN k = 1 THEN st ELSE ls END AS ws, CASE WHEN k = 1 THEN ae ELSE le END AS we FROM w),
        y AS (SELECT *, x + sum((e > we)::INT) OVER (PARTITION BY auction_id ORDER BY last_checked_at) AS extensions FROM v)
        SELECT auction_id, epoch_us(last_checked_at) AS observed_us, b AS current_bid_cents, s AS status, extensions::INT AS extension_count FROM y WHERE b IS DISTINCT FROM wb OR bs IS DISTINCT FROM wbs OR s IS DISTINCT FROM ws OR e IS DISTINCT FROM we""",
    "close_live": f"""{LIVE}, n AS (SELECT a.external_id, a.current_bid_cents AS closed_high_bid_cents, 'unknown' AS award_status, {OUTCOME} AS outcome_status, epoch_us(a.last_checked_at) AS observed_us
            FROM after a JOIN order_vehicles USING (auction_id) WHERE status IN ('ended', 'sold') AND current_bid_cents IS NOT NULL AND EXISTS (SELECT 1 FROM live_checks l WHERE l.auction_id = a.auction_id AND l.last_checked_at = a.last_checked_at)),
        o AS (SELECT external_id, current_bid_cents AS closed_high_bid_cents, 'confirmed' AS award_status, {OUTCOME} AS outcome_status, epoch_us(ends_at) AS observed_us FROM live_auctions JOIN order_vehicles USING (auction_id) WHERE auction_id % 4 = 0 AND current_bid_cents IS NOT NULL)
        SELECT * FROM n UNION ALL SELECT * FROM o WHERE external_id NOT IN (SELECT external_id FROM n)""",
    "auction_vehicles": f"{ctes('live_auctions', 'order_vehicles')} SELECT auction_id, status, vin, model FROM live_auctions JOIN order_vehicles USING (auction_id)",
    "link_source_auction": f"{ctes('live_auctions', 'comp_updates')} SELECT c.external_id AS sale, auction_id AS source_auction_id FROM comp_updates c LEFT JOIN live_auctions a ON a.external_id = split_part(c.external_id, '-', 2)",
    "log_source_check": """WITH e AS (SELECT event_id AS check_id, event_id % 4 <> 0 AS done, CASE WHEN event_id % 7 = 0 THEN 'TIMEOUT' WHEN event_id % 5 = 0 THEN 'COUNT_MISMATCH' END AS code FROM events)
        SELECT check_id, CASE WHEN done AND code IS NULL THEN 1 ELSE 0 END AS success, CASE WHEN NOT done THEN 'in-progress' WHEN code IS NULL THEN 'complete' ELSE 'failed' END AS coverage, CASE WHEN done THEN check_id % 9 END AS result_count, CASE WHEN done THEN code END AS error_code FROM e""",
    "sync_cursor": f"{ctes('checks', 'comp_updates')} SELECT (SELECT epoch_us(max(checked_at)) FROM checks WHERE success = 1 AND coverage = 'complete') AS covered_us, (SELECT epoch_us(min(ended_at)) FROM comp_updates) AS earliest_us",
    "refresh_summary": f"""WITH b AS ({board_queries.ORACLE_SQL['close_bucket']}), w AS (SELECT *, CAST(external_id AS BIGINT) AS n FROM b)
        SELECT count(*) AS considered, count(*) FILTER (should_refresh) AS due, count(*) FILTER (should_refresh AND n % 3 = 1) AS succeeded, count(*) FILTER (should_refresh AND n % 3 <> 1) AS failed,
            count(*) FILTER (should_refresh AND n % 3 = 1 AND n % 2 = 0) AS observations_appended, string_agg(DISTINCT bucket, ',' ORDER BY bucket) FILTER (should_refresh) AS due_buckets FROM w""",
    "cache_valuations": f"{ctes('deals')} SELECT n, epoch_us({ENOW}) + CASE n % 3 WHEN 0 THEN 24 ELSE 1 END * 3600000000 AS expires_us FROM deals",
    "usable_closed": f"""{ctes('live_auctions')} SELECT sum(current_bid_cents) FILTER (status = 'sold' AND current_bid_cents > 0)::BIGINT AS bids, count(*) AS rows, count(*) FILTER (status = 'sold' AND current_bid_cents > 0) AS usable,
        count(*) FILTER (status <> 'sold') AS terminated, count(*) FILTER (status = 'sold' AND NOT coalesce(current_bid_cents > 0, false)) AS no_bid FROM live_auctions""",
    "retained_coverage": f"{ctes('comp_updates')} SELECT count(*) AS rows, count(mileage) AS detailed, epoch_us(min(ended_at)) AS earliest_us, epoch_us(max(ended_at)) AS latest_us FROM comp_updates",
    "combine_sources": f"{ctes('raw_lots', 'raw_fleet')} SELECT id, lot_number, NULL::VARCHAR AS sale_run_number FROM raw_lots UNION ALL SELECT source_id, NULL, sale_run_number FROM raw_fleet",
    "append_observations": f"""{ctes('bid_observations')}, o AS (SELECT * FROM bid_observations QUALIFY row_number() OVER (PARTITION BY auction_id, observed_at ORDER BY event_id DESC) = 1),
        c AS (SELECT * FROM o WHERE observed_at < {ENOW}), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY auction_id ORDER BY observed_at DESC) = 1)
        SELECT o.event_id, o.auction_id FROM o LEFT JOIN l USING (auction_id) WHERE o.observed_at >= {ENOW}
        AND (l.auction_id IS NULL OR o.bid_cents IS DISTINCT FROM l.bid_cents OR o.bidders IS DISTINCT FROM l.bidders OR o.status IS DISTINCT FROM l.status OR o.ends_at IS DISTINCT FROM l.ends_at)""",
    "upsert_vehicles": f"""{ctes('vehicles')}, o AS (SELECT * FROM vehicles WHERE auction_id % 5 <> 1), i AS (SELECT auction_id, CASE WHEN auction_id % 4 = 0 THEN vin END AS vin, CASE WHEN auction_id % 8 = 0 THEN 7 END AS mileage, 'new' AS model,
            CASE WHEN auction_id % 3 = 0 THEN 'salvage' ELSE 'unknown' END AS condition FROM vehicles WHERE auction_id % 2 = 0)
        SELECT auction_id, coalesce(i.vin, o.vin) AS vin, coalesce(i.mileage, o.mileage) AS mileage, CASE WHEN i.auction_id IS NULL THEN o.model ELSE i.model END AS model,
            CASE WHEN i.auction_id IS NULL THEN o.condition WHEN o.auction_id IS NULL OR i.condition <> 'unknown' THEN i.condition ELSE o.condition END AS condition FROM o FULL JOIN i USING (auction_id)""",
    "latest_valuation": f"""{ctes('comp_updates')}, v AS (SELECT part_id AS auction_id, CASE WHEN supplier_id % 3 = 0 THEN 'market' ELSE 'comps' END AS provider, observed_at, ended_at, external_id FROM comp_updates
            QUALIFY row_number() OVER (PARTITION BY part_id, supplier_id % 3 = 0, observed_at ORDER BY external_id) = 1)
        SELECT auction_id, provider, external_id FROM v WHERE ended_at + INTERVAL 400 DAY > TIMESTAMP '1999-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY auction_id ORDER BY CASE provider WHEN 'market' THEN 0 ELSE 1 END, observed_at DESC) = 1""",
    "staleness": f"""WITH g AS (SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t, CASE WHEN event_id % 3 = 0 THEN 55 ELSE 70 END::BIGINT * 60000000 AS life FROM events)
        SELECT event_id, t + life AS expires_us, t + life <= epoch_us({ENOW}) AS stale, CASE WHEN t + life <= epoch_us({ENOW}) THEN t + life END AS since_us, CAST(floor((epoch_us({ENOW}) - t) / 1000000.0) AS BIGINT) AS age_seconds FROM g""",
    "plausibility_gate": f"""{ctes('seen_auctions')}, c AS (SELECT count(*) FILTER (last_seen_at >= {ENOW}) AS n, count(*) FILTER (last_seen_at < {ENOW}) * 3 AS b FROM seen_auctions)
        SELECT n AS expected, n AS received, n AS distinct_ids, b AS before, n > 0 AND n >= b * 0.5 AS ok, CASE WHEN n = 0 THEN 'empty' WHEN n < b * 0.5 THEN 'sharp-drop' ELSE '' END AS reason FROM c""",
    "condition_adjustment": """SELECT p_partkey, round(greatest(-0.45, least(0.0, CASE p_partkey % 4 WHEN 1 THEN -0.08 WHEN 2 THEN -0.22 WHEN 3 THEN -0.4 ELSE 0 END::DOUBLE + CASE p_partkey % 3 WHEN 0 THEN -0.04 WHEN 1 THEN -0.18 ELSE 0 END::DOUBLE
        - least(4, p_partkey % 7 + 1) * 0.025::DOUBLE - least(4, p_partkey % 3 + 1) * 0.01::DOUBLE)), 9) AS adjustment FROM part""",
    "listing_confidence": f"""{ctes('vehicles')} SELECT auction_id, CASE WHEN vin IS NOT NULL AND mileage IS NOT NULL THEN 0.65 WHEN auction_id % 3 = 0 THEN 0.4 WHEN auction_id % 3 = 1 THEN 0.45 ELSE 0.25 END::DOUBLE AS confidence,
        CASE WHEN auction_id % 5 > 1 THEN 'closed-high-bid' WHEN auction_id % 5 = 1 AND auction_id % 2 = 0 THEN 'no-bid' ELSE 'closed-outcome-unknown' END AS outcome, CASE condition WHEN 'usable' THEN 'fair' WHEN 'salvage' THEN 'salvage' ELSE 'unknown' END AS shown FROM vehicles""",
    "scan_closed": f"""{ctes('live_auctions')} SELECT auction_id, CASE status WHEN 'sold' THEN 'Closed' ELSE 'Sale Complete' END AS status FROM live_auctions WHERE status <> 'active' AND ends_at >= TIMESTAMP '1995-01-01 00:00:00' AND ends_at < TIMESTAMP '1996-06-01 00:00:00'""",
    "scan_awarded": f"""{ctes('live_auctions', 'order_vehicles')}, g AS (SELECT * FROM order_vehicles JOIN live_auctions USING (auction_id) WHERE auction_id % 2 = 0)
        SELECT count(*) FILTER (current_bid_cents > 0 AND auction_id % 3 <> 0) AS rows, sum(current_bid_cents) FILTER (current_bid_cents > 0 AND auction_id % 3 <> 0)::BIGINT AS cents, epoch_us(max(ends_at) FILTER (current_bid_cents > 0)) AS newest_us FROM g""",
    "valuation_gate": f"""{ctes('open_lots')}, v AS (SELECT *, valuation_status = 'available' AS a, CASE WHEN n % 7 = 0 THEN low_cents - 1 ELSE median_cents END AS m FROM open_lots)
        SELECT id, concat_ws(',', CASE WHEN a AND NOT (low_cents > 0 AND low_cents <= m AND m <= high_cents) THEN 'prices' END, CASE WHEN a AND NOT (valuation_confidence > 0) THEN 'confidence' END, CASE WHEN a AND n % 6 = 0 THEN 'evidence' END, CASE WHEN NOT a THEN 'unavailable-with-price' END) AS violations FROM v""",
    "vehicle_keys": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(lpad(p_partkey::VARCHAR, 17, 'a')) END AS vin, CASE WHEN p_partkey % 5 > 0 THEN '2000' ELSE 'unknown' END || '|' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE lower(p_name || ' ' || p_type) END AS vehicle_key,
        p_partkey::VARCHAR AS external_id, CASE WHEN regexp_matches(upper(trim(p_brand)), '^[A-Z0-9._-]{3,64}$') THEN upper(trim(p_brand)) END AS sale_number FROM part""",
    "attachments": """WITH i AS (SELECT l_orderkey, l_linenumber AS ln, min({'id': (l_partkey % 7)::VARCHAR, 'uri': (l_suppkey % 2)::VARCHAR, 'name': CASE WHEN l_linenumber % 5 > 0 THEN 'n' END, 'valid': l_linenumber % 4 <> 0, 'scan': CASE WHEN l_returnflag = 'R' THEN 'infected' ELSE 'clean' END,
            'position': CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber * 5 % 4 END}) AS i FROM lineitem GROUP BY 1, 2),
        g AS (SELECT l_orderkey, ln, i.id AS id, i.uri AS uri, coalesce(i.position, 9999) AS pos FROM i WHERE i.name IS NOT NULL AND i.valid AND i.scan = 'clean'),
        o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey, id, uri ORDER BY ln) = 1), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, ln) AS k FROM o)
        SELECT l_orderkey, coalesce(images, '') AS images FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (SELECT l_orderkey, string_agg(id || ':' || uri, ',' ORDER BY k) AS images FROM f WHERE k <= 6 GROUP BY l_orderkey) USING (l_orderkey)""",
    "catalog_lots": """WITH p AS (SELECT *, p_partkey AS k, p_partkey % 4 <> 0 AS d, p_partkey % 1000 * 7 AS said, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 1000 * 7 + p_partkey % 2 END AS odo FROM part),
        q AS (SELECT *, coalesce(d AND odo <> said, false) AS conflict FROM p)
        SELECT k AS lot_id, (1990 + k % 30)::INT AS year, 'Ford' AS make, CASE WHEN d THEN coalesce(odo, said) END AS mileage, CASE WHEN NOT d THEN 'not-reported' WHEN conflict THEN 'conflicting-readings' ELSE 'reported-not-verified' END AS odometer_status,
            CASE WHEN d THEN p_type END AS color, CASE WHEN NOT d THEN 'unknown' WHEN k % 2 = 0 THEN 'usable' ELSE 'salvage' END AS condition, CASE WHEN d AND k % 5 = 0 THEN NULL ELSE 'Reno' END AS city, CASE WHEN d AND k % 5 = 0 THEN 'CA' ELSE 'NV' END AS state,
            CASE WHEN d AND k % 6 = 1 THEN 'B' ELSE 'A' END AS agency, d AS detail_enriched, conflict::INT AS notes, conflict FROM q""",
    "fleet_details": """SELECT CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey::VARCHAR END AS source_id, 'V' || o_orderkey AS vin, CASE WHEN 1890 + o_orderkey % 140 BETWEEN 1900 AND 2026 THEN 1890 + o_orderkey % 140 END::INT AS year, 'a ' || o_orderpriority AS make,
        o_orderkey % 100 AS mileage, 'AC;' || o_orderpriority || ';Tow' AS equipment, CASE WHEN o_orderkey / 4.0 <= 10000000 THEN floor(round(o_orderkey / 4.0, 2) * 100 + 0.5)::BIGINT END AS high_bid_cents, 'a b' AS comments, CASE WHEN o_orderkey % 9 = 0 THEN 'missing-id' ELSE '' END AS reject FROM orders""",
    "market_offers": """WITH o AS (SELECT l_partkey, trunc(l_extendedprice)::BIGINT AS d FROM lineitem), g AS (SELECT l_partkey, count(*) FILTER (d BETWEEN 100 AND 1000000) AS n, min(d) FILTER (d BETWEEN 100 AND 1000000) AS lo, max(d) FILTER (d BETWEEN 100 AND 1000000) AS hi FROM o GROUP BY 1),
        h AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 100000 ELSE lo * 100 END AS low FROM g)
        SELECT l_partkey AS page_id, low AS low_cents, hi * 100 AS high_cents, n::INT AS offers, n AS reported_sample_size, 'embedded' AS basis FROM h WHERE low <= hi * 100""",
    "fleet_phases": f"""{ctes('raw_fleet')} SELECT source_id, CASE WHEN phase = 'closed' THEN 'closed' WHEN starts_at > TIMESTAMP '1997-01-01 00:00:00' THEN 'coming' WHEN effective_ends_at < TIMESTAMP '1997-01-01 00:00:00' THEN 'ended' ELSE 'active' END AS phase FROM raw_fleet WHERE high_bid_cents > 0""",
}
