import random
import re

from pyspark.sql import functions as F

from gavelflow.functions import lot_text
from gavelflow.operators import lots


def test_rules_in_one_pass_equal_rules_one_by_one(spark):
    """Texts made of the rules' own words, in any order and close together, some within other words."""
    every = {
        "body": lot_text.BODY_RULES, "damage": lot_text.DAMAGE_RULES, "issue": lot_text.ISSUE_RULES, "road": lot_text.NON_ROAD_RULES,
        "make": [(r"\b" + re.escape(m).replace(r"\ ", r"[\s-]+") + r"\b", m) for m in lot_text.MAKES],
        "odd": [(r"(ab)\1", "twice"), (r"x|\by\b", "no-boundary"), (r"\b[|(]b", "class")], "none": [],
    }
    words = sorted({w for rules in every.values() for p, label in rules for w in re.findall("[A-Za-z]{2,}", p) + [label]}) + ["abab", "x", "y", "|b", "\n", "  ", "é", "_", "-"]
    r = random.Random(5)
    texts = [None, ""] + [r.choice(["", " ", "", "7"]).join(r.choice([w, w.upper(), w.title()]) + r.choice([" ", " ", " ", "", "-", "é"]) for w in r.choices(words, k=r.randrange(1, 9))) for _ in range(1_500)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    told = df.select("t", *[F.struct(lot_text.first_rule(F.col("t"), rules).alias("first"), lot_text.all_rules(F.col("t"), rules).alias("all")).alias(name) for name, rules in every.items()]).collect()
    for name, rules in every.items():
        plain = [(re.compile(lot_text.ascii_words(f"(?i){p}"), re.ASCII), label) for p, label in rules]
        hits = 0
        for row in told:
            want = [label for p, label in plain if row.t is not None and p.search(row.t)]
            assert (row[name]["first"], row[name]["all"]) == (want[0] if want else None, want), (name, row.t)
            hits += len(want)
        assert hits > 20 or not rules


def test_bulk_lot_example(spark):
    raw = spark.createDataFrame(
        [("41QSCI-26-001", "0001", "2016 Chevrolet Tahoe", "<p>SUV. VIN 1GNSKAECXGR377492<br>Odometer: 59,129</p><script>x</script>", "Active", "$10,125.50", "7", "2026-08-01T00:00", "2026-08-07T12:00", "http://a.example/1.jpg|https://a.example/2.jpg", "Dallas", "TX"),
         ("1", None, "Dump trailer", "two axles", "p", "n/a", "x", None, None, None, None, None)],
        "sale string, lot string, title string, description string, status string, bid string, bidders string, starts_at string, ends_at string, images string, city string, state string",
    )
    a, b = lots.normalize_lots(raw, 2026).collect()
    assert (a.id, a.is_vehicle, a.vin, a.mileage, a.body_type, a.year, a.make, a.model_label, a.status) == ("gsa:41qsci-26-001:0001", True, "1GNSKAECXGR377492", 59129, "suv", 2016, "Chevrolet", "Tahoe", "active")
    assert (a.current_bid_cents, a.bidder_count, str(a.ends_at)) == (1_012_550, 7, "2026-08-07 12:00:00") and a.images == ["https://a.example/1.jpg", "https://a.example/2.jpg"]
    assert "<" not in a.description and (b.is_vehicle, b.reason, b.status, b.current_bid_cents, b.bidder_count) == (False, "trailer", "preview", None, None)


def test_fleet_listings(spark):
    cols = "id string, vin string, makeName string, modelName string, modelYear int, vehicleMiles int, saleType string, saleStatus string, vehicleSaleStatus string, saleStartDate string, saleEndDate string, extendedSaleEndDate string, saleNumber string, highBid string, winningBidAmt string, saleProceedsAmt string"
    rows = [
        ("1", " x ", "Ford", "F250", 2018, 10, "Internet", "Closed", "Sold", "2026-08-01T00:00Z", "2026-08-02T00:00Z", "2026-08-03T00:00Z", "s", "5", "100.5", "90"),
        ("2", None, "Ford", "F250", 2018, 10, "Live", "Open", "Lotted", "2026-08-01T00:00Z", "2026-08-09T00:00Z", None, "s", None, "100", None),
        ("3", None, "Ford", None, 2018, 10, "other", "Open", "Awarded", "2026-08-06T00:00Z", None, None, "s", "-1", None, "70"),
    ]
    now = F.lit("2026-08-05 00:00:00").cast("timestamp")
    a, b, c = lots.normalize_fleet_listings(spark.createDataFrame(rows, cols), now, 2026).collect()
    assert (a.vin, a.channel, a.phase, a.final_price_cents, a.final_price_basis, a.is_comparable_outcome, str(a.effective_ends_at)) == ("X", "internet", "closed", 10_050, "winning-bid", True, "2026-08-03 00:00:00")
    assert (b.channel, b.phase, b.final_price_cents, b.is_comparable_outcome) == ("live", "active", None, False)
    assert (c.channel, c.final_price_basis, c.high_bid_cents, c.is_comparable_outcome) == ("unknown", "sale-proceeds", None, False)


def test_bids(spark):
    raw = spark.createDataFrame([("a", [("2026-08-01T00:00Z", "5", "BIDDER 3"), ("2026-08-01T00:00Z", "5", "bidder 3x"), ("2026-08-01T00:00Z", "5", None), ("bad", "5", None)])], "auction_id string, bids array<struct<bidDate:string,bidAmt:string,bidderUserId:string>>")
    history = lots.normalize_bid_history(raw)
    assert sorted(r.bidder or "" for r in history.collect()) == ["", "BIDDER 3"]
    details = spark.createDataFrame([("a", None, 1)], "auction_id string, highest_bid_cents long, detail_bid_cents long")
    assert lots.current_bids(history, details).first().current_bid_cents == 500
    live = spark.createDataFrame([("372696", 372696, 2510.5, 3, "Active", "2026-08-07T12:00:00"), ("1", 2, 1.0, 1, "Active", "2026-08-07T12:00:00"), ("3", 3, None, 0, "Mystery", "2026-08-07T12:00:00")], "requested_id string, auctionId long, currentBid double, numberOfBidders int, status string, endDate string")
    a, b, c = lots.normalize_live_bids(live).collect()
    assert (a.current_bid_cents, str(a.ends_at), a.reject) == (251_050, "2026-08-07 17:00:00", None) and (b.reject, c.reject, c.current_bid_cents) == ("id-mismatch", "unknown-status", None)
    models = spark.createDataFrame([("GR  CHEROKEE",), ("F250 XL",), ("Transit",)], "m string").select(lots.fleet_model(F.col("m")).alias("m"))
    assert [r.m for r in models.collect()] == ["Grand Cherokee", "F250 Xl", "Transit"]
