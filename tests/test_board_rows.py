"""Board rows, catalog details, offers, live updates and the ledger's live path on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gavelflow.operators import catalog, ledger, offers, opportunities

NOW = datetime(2024, 5, 1, 12)


def ts(text):
    return F.lit(text).cast("timestamp")


LOT = "id string, sale_number string, lot_number string, title string, url string, images array<string>, status string, starts_at timestamp, ends_at timestamp, current_bid double, bidder_count int, city string, state string, postal_code string, year int, make string, model_label string, vin string, mileage long, body_type string, condition string, operability string, description string, damage_flags array<string>, issue_flags array<string>, condition_notes array<string>, open_recall boolean"


def test_lots_to_opportunities(spark):
    rows = [
        ("gsa:ppms:12", "S1", "7", "2015 Ford F-150", "https://x.example/preview/12", ["a", "a", "", "b"], "active", None, None, 12.345, 2, "Reno", "NV", "1", None, None, None, "V", 5, "truck", "usable", "runs", "Good", ["frame-damage"], ["no_key"], ["Frame damage", "note"], True),
        ("gsa:ppms:13", None, "", " ", None, None, "scheduled", None, None, None, None, None, None, None, None, None, None, None, None, None, "scrap", "unknown", None, None, None, None, None),
    ]
    a, b = opportunities.lots_to_opportunities(spark.createDataFrame(rows, LOT), ts("2024-05-01 12:00:00")).orderBy("id").collect()
    assert (a.id, a.external_id, a.sale_lot_number, a.status, a.current_bid_cents) == ("live-gsa-ppms-12", "12", "S1 · Lot 7", "active", 1235)
    assert (a.year, a.make, a.model, a.condition, a.images) == (2015, "Make pending", "Ford F-150", "good", ["a", "b"])
    assert a.risk_flags == ["Frame Damage", "No Key", "note", "Open recall disclosed"]
    assert (b.title, b.sale_lot_number, b.status, b.current_bid_cents, b.city, b.state, b.year, b.condition) == ("Untitled vehicle", "gsa:ppms:13", "preview", None, "Location pending", "—", 0, "salvage")
    assert b.risk_flags == ["Mileage not reported"] and b.images == []


FLEET = "source_id string, external_key string, vin string, sale_number string, sale_run_number string, year int, make string, model string, mileage long, vehicle_type string, condition_code string, channel string, phase string, starts_at timestamp, effective_ends_at timestamp, high_bid_cents long, images array<string>, url string, city string, state string, postal_code string"
DETAIL = "source_id string, series string, body_style string, high_bid_cents long, starts_at timestamp, effective_ends_at timestamp, images array<string>, comments string, open_recall_count int"


def test_fleet_to_opportunities(spark):
    rows = [
        ("1", "fleet:1", "V1", "S", "3", 2019, "FORD", "GR CHEROKEE", 9, "SUV", "U", "internet", "active", None, NOW, 100, ["b"], "u", "Reno", "NV", None),
        ("2", "fleet:2", None, None, None, None, None, None, None, "SUV", "?", "live", "active", None, None, 100, None, "u", None, None, None),
        ("3", "fleet:3", "V3", None, None, 2020, "Ram", "1500", 5, "T", "X", "internet", "ended", None, NOW, None, [], "u", None, None, None),
    ]
    details = spark.createDataFrame([("1", "XL", "Wagon", 250, None, None, ["a", "b"], " fine ", 1)], DETAIL)
    a, b, c = opportunities.fleet_to_opportunities(spark.createDataFrame(rows, FLEET), details, ts("2024-05-01 12:00:00")).orderBy("id").collect()
    assert (a.id, a.status, a.current_bid_cents, a.images, a.body_style, a.sale_lot_number) == ("fleet-1", "active", 250, ["a", "b"], "Wagon", "S · Run 3")
    assert (a.title, a.condition, a.risk_flags) == ("2019 Ford Grand Cherokee", "fair", ["fine", "Open recall disclosed"])
    # A sale in person never gets an online bid, and is shown as coming.
    assert (b.status, b.current_bid_cents, b.online_bidding, b.sale_lot_number) == ("preview", None, False, "2")
    assert (c.status, c.condition, c.make) == ("ended", "salvage", "Ram")


def test_pollable_and_compact(spark):
    rows = spark.createDataFrame(
        [
            ("lots", "active", "12", None, None, ["a", "b"], [1] * 20, "long", ["A", "B"], ["X", "MARKET_ONLY_BEFORE_PUBLIC_BID"]),
            ("lots", "active", "x1", None, None, [], [1], "", [], []),
            ("fleet", "active", "f", "V", "internet", ["a", "b"], [1], "", ["A"], ["X"]),
            ("fleet", "active", "f", "V", "live", [], [1], "", [], []),
            ("fleet", "preview", "f", "V", None, [], [1, 2], "", [], []),
        ],
        "source string, status string, external_id string, vin string, sale_type string, images array<string>, outcome_anchors array<int>, description string, reason_codes array<string>, forecast_codes array<string>",
    )
    assert [r.p for r in rows.select(opportunities.pollable().alias("p")).collect()] == [True, False, True, False, False]
    got = opportunities.compact_board(rows).collect()
    assert [len(r.outcome_anchors) for r in got] == [15, 1, 1, 1, 0]
    assert got[0].images == ["a", "b"] and got[2].images == ["a"] and got[0].description == "" and got[0].reason_codes == ["A"] and got[0].forecast_codes == ["MARKET_ONLY_BEFORE_PUBLIC_BID"] and got[2].forecast_codes == []


def test_prepare_lot_snapshot(spark):
    rows = [(str(k), "active", k != 3, [f"https://i/{j}" for j in range(8)] + ["ftp://x"]) for k in range(10)] + [("z", "ended", True, [])]
    out, gate = opportunities.prepare_lot_snapshot(spark.createDataFrame(rows, "id string, status string, detail_enriched boolean, images array<string>"), ts("2024-05-01 12:00:00"))
    got = out.collect()
    assert len(got) == 10 and all(len(r.images) == 6 for r in got)
    assert (got[0].expires_at - NOW).total_seconds() == 86_400 and (got[0].images_expire_at - NOW).total_seconds() == 3_300
    assert gate.first().ok
    _, gate = opportunities.prepare_lot_snapshot(spark.createDataFrame(rows[:9], "id string, status string, detail_enriched boolean, images array<string>"), ts("2024-05-01 12:00:00"))
    assert not gate.first().ok


def test_attachments(spark):
    kind = "images array<struct<id:string,uri:string,name:string,valid:boolean,scan:string,position:int>>"
    images = [("1", "u1", "n1", None, None, 5), ("2", "u2", "n2", True, "clean", None), ("3", "u3", "n3", False, None, 1), ("4", "u4", "n4", True, "infected", 1), ("1", "u1", "again", None, None, 0), ("5", "", "n", None, None, 0), ("6", "u6", "n6", None, None, 2)]
    got = spark.createDataFrame([(images,), (None,), ([],)], kind).select(catalog.attachments(F.col("images")).alias("a")).collect()
    assert [x.id for x in got[0].a] == ["6", "1", "2"] and got[1].a is None and got[2].a == []


CATALOG = "lot_id long, auction_id long, title string, city string, state string, agency string"
LOT_DETAIL = "lot_id long, description string, odometer string, make string, model string, body_type string, condition_code string, city string, state string, agency string"


def test_normalize_catalog_lots(spark):
    rows = spark.createDataFrame([(1, 11, "2015 Ford F-150", "Reno", "NV", "A"), (2, 12, "Desk", None, None, None), (3, 13, "2010 Dodge Ram", "X", "Y", None)], CATALOG)
    details = spark.createDataFrame(
        [
            (1, "<p>Mileage: 120,500</p><p>Color: red</p><p>VIN: 1FTFW1ET5DFC10312</p> Runs and drives.", "120000", None, None, None, "U", None, "CA", None),
            (3, "<li>Odometer: 5,000</li>", None, "DODGE", "RAM 1500", "truck", "X", None, None, "B"),
        ],
        LOT_DETAIL,
    )
    got = {r.lot_id: r for r in catalog.normalize_catalog_lots(catalog.attach_catalog_detail(rows, details), 2024).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.mileage, a.odometer_status, a.color, a.vin, a.year, a.make, a.condition) == (120_000, "conflicting-readings", "red", "1FTFW1ET5DFC10312", 2015, "Ford", "usable")
    assert a.issue_flags[-1] == "odometer-conflict" and a.condition_notes == ["Mileage conflict: odometer 120000 miles; description 120500 miles."]
    assert (a.city, a.state, a.agency, a.detail_enriched) == (None, "CA", "A", True)
    assert (b.mileage, b.odometer_status, b.detail_enriched, b.condition) == (None, "not-reported", False, "unknown")
    assert (c.mileage, c.odometer_status, c.model_label, c.condition, c.city, c.agency) == (5_000, "reported-not-verified", "RAM 1500", "salvage", "X", "B")


def test_normalize_fleet_detail(spark):
    names = ["id", "vin", "saleNumber", "modelYear", "makeName", "modelName", "vehicleSeries", "vehicleBodyStyle", "vehicleMiles", "openRecall", "comments", "vehicleAdditionalEquip1", "vehicleAdditionalEquip2", "saleStartDate", "saleEndDate", "extendedSaleEndDate", "highBid", "winningBidAmt", "photoUrlLarge", "photoUrl"]
    rows = [("1", " abc ", "S", "2015", "Ford", "F150", None, None, "12", "0", " a  b ", "AC; ABS;;AC", "ABS;Tow", None, "2024-05-01T10:00:00Z", "2024-05-01T10:05:00Z", "12.5", None, "http://i/1.jpg#x", "https://i/1.jpg", ["https://i/2.jpg"], True), (None, "v", *[None] * 18, None, None)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", gallery array<string>, approved boolean")
    a, b = catalog.normalize_fleet_detail(frame, 2024, ts("2024-05-01 12:00:00")).orderBy(F.desc_nulls_last("source_id")).collect()
    assert (a.vin, a.year, a.comments, a.equipment, a.high_bid_cents, a.reject) == ("ABC", 2015, "a b", ["AC", "ABS", "Tow"], 1250, None)
    assert a.effective_ends_at == datetime(2024, 5, 1, 10, 5) and a.images == ["https://i/1.jpg", "https://i/2.jpg"] and a.condition_report_approved
    assert b.reject == "missing-id"


def test_market_offers(spark):
    page = '<html><script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"appraisalData":{"percentileLow":"$10k","percentileHigh":15000,"sampleSize":9,"offers":[{"miles":"12,000","price":"11,500","date":" d ","trim":"XL"},{"mileage":5,"offer":50},{"odometer":70000,"amount":"12k"}]}}}}</script></html>'
    direct = '{"data":{"offerData":[{"mileage":1000,"value":9000},{"mileage":2000,"value":7000}],"percentileLow":null,"percentileHigh":"x"}}'
    text = "Based on 40 real offers. Recent Dealer offers range from $8,000 to $12,000\n$9,500 at 60k miles\n$1 $2 at 5 miles\n$10,000 with 45,500 miles"
    rows = [(1, page), (2, direct), (3, text), (4, "nothing $8,000 to $12,000"), (5, None), (6, text.replace("$8,000 to", "$18,000 to"))]
    got = {r.page_id: r for r in offers.extract_market_offers(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    a = got[1]
    assert (a.low_cents, a.high_cents, a.reported_sample_size, a.basis) == (1_000_000, 1_500_000, 9, "embedded")
    assert [(o.mileage, o.amount_cents, o.observed_at, o.trim) for o in a.offers] == [(12_000, 1_150_000, "d", "XL"), (70_000, 1_200_000, None, None)]
    assert (got[2].low_cents, got[2].high_cents, len(got[2].offers)) == (700_000, 900_000, 2)
    b = got[3]
    assert (b.low_cents, b.high_cents, b.reported_sample_size, b.basis) == (800_000, 1_200_000, 40, "text")
    assert [(o.mileage, o.amount_cents) for o in b.offers] == [(60_000, 950_000), (45_500, 1_000_000)]
    assert set(got) == {1, 2, 3}


def test_offers_are_read_once_and_text_only_where_it_counts(spark):
    page = lambda listed: '{"percentileLow":1000,"percentileHigh":2000,"offers":[' + listed + "]}"
    rows = [(1, page('7,"x",null,[1],{"miles":5,"odometer":"1k","value":{"a":1},"amount":"$1,5k"},{"mileage":null,"miles":2.5,"price":200,"createdAt":3,"trimCode":true}')), (2, page("") + "\nreal offers $1 to $2"), (3, '{"percentileLow":3000,"percentileHigh":2000,"offers":[]} real offers $100 to $200, sample of 9 offers')]
    out = offers.extract_market_offers(spark.createDataFrame(rows, "page_id long, html string"))
    got = {r.page_id: r for r in out.collect()}
    assert [(o.mileage, o.amount_cents, o.observed_at, o.trim) for o in got[1].offers] == [(1000, 1_500_000, None, None), (3, 20_000, "3", "true")]
    assert got[2].basis == "embedded" and (got[3].basis, got[3].low_cents, got[3].reported_sample_size) == ("text", 10_000, 9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)(?:real|recent)") == 1 and plan.count("$.offerData, ") <= 20


AUCTION = "auction_id long, source_key string, external_id string, current_bid_cents long, bidder_count int, status string, ends_at timestamp, last_checked_at timestamp, last_seen_at timestamp, price_changed_at timestamp, ended_at timestamp, final_bid_cents long, final_status string, extension_count int"
LIVE = "auction_id long, external_id string, current_bid_cents long, bidder_count int, status string, ends_at timestamp, last_checked_at timestamp"
VEHICLE = "auction_id long, vin string, year int, make string, model string, mileage long"


def at(minute, hour=12):
    return datetime(2024, 5, 1, hour, minute)


def auctions(spark):
    return spark.createDataFrame(
        [
            (1, "lots", "1", 100, 1, "active", at(30), at(0), at(0), at(0), None, None, None, 0),
            (2, "lots", "2", 200, 2, "active", at(30), at(0), at(0), at(0), None, None, None, 2),
            (3, "lots", "3", None, 0, "preview", at(30), at(0, 9), at(0, 9), None, None, None, None, 0),
            (4, "fleet", "1", 300, 0, "active", at(30), at(0, 9), at(0, 9), at(0), None, None, None, 0),
            (5, "lots", "5", 500, 0, "sold", at(30), at(0, 9), at(0, 9), at(0), at(1), 450, "x", 0),
        ],
        AUCTION,
    )


def test_live_updates(spark):
    live = spark.createDataFrame(
        [
            (1, "1", 150, 1, "active", at(30), at(5)), (1, "1", 150, 1, "active", at(40), at(6)), (1, "1", 180, 2, "ended", at(40), at(7)), (1, "1", 180, 2, "ended", at(40), at(7)),  # a replay
            (2, "2", 999, 9, "ended", at(50), at(0)),  # not newer
            (3, "4", 1, 1, "active", at(30), at(9)),  # another auction's id
            (4, "1", None, 0, "active", at(30), at(9)),
        ],
        LIVE,
    )
    seen = ledger.live_observations(auctions(spark), live).orderBy("auction_id", "observed_at").collect()
    assert [(r.auction_id, r.current_bid_cents, r.status, r.extension_count) for r in seen] == [(1, 150, "active", 0), (1, 150, "active", 1), (1, 180, "ended", 1), (4, None, "active", 0)]
    after = {r.auction_id: r for r in ledger.apply_live_updates(auctions(spark), live).collect()}
    a = after[1]
    assert (a.status, a.current_bid_cents, a.ended_at, a.final_bid_cents, a.final_status, a.price_changed_at, a.last_checked_at) == ("ended", 180, at(40), 180, ledger.UNVERIFIED, at(7), at(7))
    assert after[2].current_bid_cents == 200 and after[3].current_bid_cents is None and after[4].current_bid_cents is None and after[4].price_changed_at == at(9)
    assert after[5].final_bid_cents == 450 and after[5].ended_at == at(1)
    vehicles = spark.createDataFrame([(1, "V", 2015, "Ford", "F150", 5), (5, "W", 2016, "Ram", "1500", 6)], VEHICLE)
    old = ledger.closed_rows(auctions(spark).filter("auction_id = 1"), vehicles, ts("2020-01-01"), ts("2020-01-01")).withColumn("award_status", F.lit("confirmed"))
    updated = ledger.apply_live_updates(auctions(spark), live)
    new = ledger.close_live(old, updated, vehicles, live).collect()
    assert [(r.external_id, r.closed_high_bid_cents, r.award_status, r.outcome_status, r.ended_at, r.outcome_observed_at) for r in new] == [("1", 180, "unknown", "closed-high-bid", at(40), at(7))]
    linked = ledger.link_source_auction(spark.createDataFrame([("lots", "1"), ("lots", "77")], "source_key string, external_id string"), auctions(spark)).orderBy("external_id").collect()
    assert [r.source_auction_id for r in linked] == [1, None]


def test_archive_and_close_out(spark):
    checks = spark.createDataFrame([(at(0, 10), 1, "complete"), (at(0, 11), 0, "complete"), (at(0, 13), 1, "complete")], "checked_at timestamp, success int, coverage string")
    got = ledger.archive_missing(auctions(spark), checks, ts("2024-05-01 12:30:00"), "lots")
    assert sorted(got.columns) == sorted(auctions(spark).columns)
    rows = {r.auction_id: r for r in got.collect()}
    assert rows[3].status == "ended" and rows[3].ended_at == at(30) and rows[3].final_status == ledger.UNVERIFIED
    # Another source, seen since, and already ended rows stay as they are.
    assert rows[4].status == "active" and rows[1].status == "active" and (rows[5].ended_at, rows[5].final_bid_cents, rows[5].final_status) == (at(1), 450, "x")
    vehicles = spark.createDataFrame([(1, "V", 2015, "Ford", "F150", 5), (5, "W", 2016, "Ram", "1500", 6)], VEHICLE)
    ended = got.withColumns({"status": F.when(F.col("auction_id").isin(1, 2, 5), "ended").otherwise(F.col("status")), "ended_at": F.when(F.col("auction_id").isin(1, 2), ts("2024-05-01 12:30:00")).otherwise(F.col("ended_at"))})
    empty = ledger.closed_rows(ended.limit(0), vehicles, F.col("ended_at"), F.col("ended_at"))
    out = ledger.close_out(empty, ended, vehicles, ts("2024-05-01 12:30:00"), "lots").collect()
    assert [(r.external_id, r.closed_high_bid_cents) for r in out] == [("1", 100)]  # 2 has no vehicle, 5 ended before
    assert ledger.close_out(spark.createDataFrame(out, empty.schema), ended, vehicles, ts("2024-05-01 12:30:00"), "lots").count() == 1


def test_fold_with_null_clock(spark):
    kind = "k int, v int, t timestamp"
    current = spark.createDataFrame([(1, 1, None), (2, 1, at(5)), (3, 1, at(5))], kind)
    incoming = spark.createDataFrame([(1, 2, at(1)), (2, 2, None), (3, 2, at(5)), (4, 2, None)], kind)
    got = ledger.fold(current, incoming, ["k"], {"v": ledger.NEWER, "t": ledger.NEWER}, "t").orderBy("k").collect()
    assert [r.v for r in got] == [2, 1, 2, 2]


def test_checks_cursor_summary_and_cache(spark):
    checks = spark.createDataFrame([(1, "a", at(0), 0, "in-progress", None, None, None), (2, "a", at(1), 0, "in-progress", None, None, None), (3, "a", at(2), 0, "in-progress", None, None, None), (4, "b", at(3), 1, "complete", 5, 5, None)], "check_id int, scope string, checked_at timestamp, success int, coverage string, result_count long, expected_count long, error_code string")
    results = spark.createDataFrame([(1, 5, 5, None), (2, 4, 5, None)], "check_id int, received long, expected long, error_code string")
    done = ledger.log_source_check(checks, results)
    assert [(r.success, r.coverage, r.error_code) for r in done.orderBy("check_id").collect()] == [(1, "complete", None), (0, "failed", "COUNT_MISMATCH"), (0, "in-progress", None), (1, "complete", None)]
    corpus = spark.createDataFrame([("a", at(5), 7), ("b", at(4), None), ("c", at(5), 7)], "auction_id string, ended_at timestamp, mileage long")
    assert tuple(ledger.sync_cursor(done, corpus, "a").first()) == (at(0), at(4))
    assert tuple(ledger.retained_coverage(corpus).first()) == (3, 2, at(4), at(5))
    assert [r.auction_id for r in ledger.corpus_order(corpus).collect()] == ["a", "c", "b"]
    work = spark.createDataFrame([("x", True, True, True), ("y", True, False, True), ("y", True, None, False), ("z", False, None, False), ("x", True, True, False)], "bucket string, should_refresh boolean, success boolean, appended boolean")
    assert tuple(ledger.refresh_summary(work).first()) == (5, 4, 2, 2, 1, "x,y")
    cached = ledger.cache_valuations(spark.createDataFrame([("offers",), ("comps",), ("miss",)], "kind string"), ts("2024-05-01 12:00:00"))
    assert [(r.expires_at - r.created_at).total_seconds() / 3600 for r in cached.collect()] == [24, 1, 1]
    rows, told = ledger.usable_closed(spark.createDataFrame([("closed", 5, at(1)), ("Closed", 5, at(1)), ("closed", 0, at(1)), ("closed", None, at(1)), (None, 5, at(1)), ("closed", 5, None)], "status string, current_bid_cents long, ends_at timestamp"))
    assert rows.count() == 1 and tuple(told.first()) == (6, 1, 2, 2)
    both = ledger.combine_sources(corpus.select("auction_id"), corpus.select("auction_id", "mileage"))
    assert both.count() == 6 and both.columns == ["auction_id", "mileage"]
    gate = ledger.plausibility_gate(spark.createDataFrame([(10, 10, 10)], "expected long, received long, distinct_ids long"), spark.createDataFrame([(21,), (5,)], "received long"))
    assert gate.count() == 1 and gate.first().reason == "sharp-drop"
    with pytest.raises(ValueError):
        ledger.refresh_corpus(corpus, corpus, "2024-05-02", "2024-05-01", "2024-05-03", 30)
