"""The reference's examples, and invariants of the models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gavelflow.functions import cadence, deals, identity, lot_text
from gavelflow.operators import board, comparables, forecasts, history, ledger, quantiles, valuation
from gavelflow.operators.quantiles import weighted_quantile
from gavelflow.sources import gates

def NOW():
    return F.lit("2026-08-05 17:00:00").cast("timestamp")
COSTS = deals.Costs(0.1, 0.05, 0.08, 10_000, 20_000, 30_000, 40_000, 50_000, 60_000)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cost_vector(spark):
    r = one(spark, deals.cost_breakdown(F.lit(1_000_000), F.lit(1_500_000), COSTS).alias("c")).c
    assert (r.buyer_premium, r.purchase_tax, r.selling_fee, r.acquisition, r.all_in) == (100_000, 55_000, 120_000, 1_365_000, 1_485_000)


def test_ceiling_is_the_last_profitable_bid(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(r.randrange(1, 5_000_000), r.randrange(0, 400_000)) for _ in range(300)], "value long, required long")
    for costs in (COSTS, deals.Costs(), deals.Costs(0.137, 0.0825)):
        got = rows.withColumn("b", deals.ceiling(F.col("value"), F.col("required"), costs))
        got = got.withColumns({"left": F.col("value") - deals.all_in(F.col("b"), F.col("value"), costs), "next": F.col("value") - deals.all_in(F.col("b") + 1, F.col("value"), costs)}).collect()
        for x in got:
            assert x.b == 0 or (x.left >= x.required and (x.next < x.required or x.b == x.value))


@pytest.mark.parametrize(("make", "title", "model", "body", "family", "kind"), [
    ("Ford", "2018 Ford F-250 XL", "F250XL", "pickup", "ford-f250", "pickup-three-quarter-ton"),
    ("Dodge", "2019 Dodge Ram", "RAM 1500 CREW CAB 4X4", "pickup", "ram-1500", None),
    ("Ford", "2021 Ford Transit Connect Cargo Van", "Transit Connect", None, "ford-transit-connect", None),
    ("Chevrolet", "2019 Chevrolet Express Passenger Van", "Express", "van", None, "full-size-van"),
    ("Chevrolet", "2017 Chevrolet K3500", "K3500", None, "chevrolet-silverado-3500", "pickup-one-ton"),
    ("Jeep", "2020 Jeep Grand Cherokee", "Grand Cherokee", None, "jeep-grand-cherokee", None),
])
def test_families(spark, make, title, model, body, family, kind):
    rows = spark.createDataFrame([(make, model, title, body)], "make string, model string, title string, body string")
    got = identity.identify(rows).first()
    assert family is None or got.family == family
    assert kind is None or got["class"] == kind


def test_lot_facts(spark):
    text = F.lit("2016 Chevrolet Tahoe sport utility. VIN: 1GNSKAECXGR377492 Odometer reading: 59,129.5 flat tires; check engine. Runs and drives")
    r = one(spark, lot_text.extract_vin(text).alias("vin"), lot_text.extract_mileage(text).alias("miles"), lot_text.extract_body_type(text).alias("body"), lot_text.extract_year(text, 2026).alias("year"),
            lot_text.extract_make(text).alias("make"), lot_text.damage_flags(text).alias("damage"), lot_text.issue_flags(text).alias("issues"), lot_text.operability(text).alias("moves"))
    assert (r.vin, r.miles, r.body, r.year, r.make) == ("1GNSKAECXGR377492", 59129, "suv", 2016, "Chevrolet")
    assert (r.damage, r.issues, r.moves) == (["tire-damage"], ["engine-issue"], "runs-and-drives")
    c = one(spark, lot_text.classify_lot(F.lit("Forklift, Toyota 2015"), text, 2026).alias("c")).c
    assert not c.is_vehicle and c.reason == "material-handling-equipment"


def test_clean_text_never_leaks_markup(spark):
    html = "<p>A&amp;B<br/>&#65;&nbsp;<script>var t='</p>';</script><!-- x --><b>ﬁne</b>&lt;i&gt;</p>"
    assert one(spark, lot_text.clean_text(F.lit(html)).alias("t")).t == "A&B A fine"


def test_wall_clock(spark):
    rows = spark.createDataFrame([("2026-08-05 10:21:00",), ("2026-01-05 10:21:00",), ("2026-03-08 02:30:00",), ("2026-11-01 01:30:00",)], "w string")
    got = [str(r.u) if r.u else None for r in rows.select(lot_text.central_to_utc(F.to_timestamp("w")).cast("string").alias("u")).collect()]
    assert got == ["2026-08-05 15:21:00", "2026-01-05 16:21:00", None, "2026-11-01 06:30:00"]


@pytest.mark.parametrize(("left_s", "bucket"), [(1800.001, "normal"), (1800, "last-30-minutes"), (300, "last-5-minutes"), (60, "last-minute"), (0, "close-grace"), (-119, "close-grace"), (-120, "close-reconciliation"), (-86400, "stale-close-reconciliation")])
def test_close_buckets(spark, left_s, bucket):
    rows = spark.range(1).select(F.lit("active").alias("status"), F.timestamp_micros(F.unix_micros(NOW()) + int(left_s * 1_000_000)).alias("ends_at"), F.lit(None).cast("timestamp").alias("last_checked_at"))
    r = cadence.close_bucket(rows, NOW()).first()
    assert r.bucket == bucket and r.should_refresh


def _subjects(spark, **over):
    base = {"id": "s", "external_id": "9001", "family": "ford-f250", "class": "pickup-three-quarter-ton", "year": 2018, "mileage": 100_000, "condition": "usable", "operability": "runs-and-drives", "vin": None, "issues": 0} | over
    return spark.createDataFrame([tuple(base[c] for c in comparables.SUBJECT)], "id string, external_id string, family string, class string, year int, mileage long, condition string, operability string, vin string, issues int")


def _comps(spark, rows):
    out = [(f"{1000 + k}", "ford-f250", "pickup-three-quarter-ton", 2017, 110_000, "usable", "runs-and-drives", r.get("vin"), 0, r["price"], r.get("ended", "2026-07-15 15:00:00")) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, "auction_id string, family string, class string, year int, mileage long, condition string, operability string, vin string, issues int, closed_high_bid_cents long, ended string").withColumn("ended_at", F.to_timestamp("ended")).drop("ended")


def _value(spark, rows, **over):
    return valuation.value_subjects(_subjects(spark, **over), _comps(spark, rows), "2026-08-05 17:00:00").first()


def test_valuation_examples(spark):
    four = _value(spark, [{"price": p} for p in (900_000, 1_200_000, 1_500_000, 1_800_000)])
    assert four.sample_size == 4 and four.match_basis == "family-year-mileage" and four.low_cents <= four.median_cents <= four.high_cents
    vin = "1FT7W2B60JEC00001"
    assert _value(spark, [{"price": 900_000, "vin": vin, "ended": "2026-06-01 00:00:00"}, {"price": 1_000_000, "vin": vin}, {"price": 1_100_000}]).sample_size == 2
    near, far = (_value(spark, [{"price": p} for p in ps]) for ps in ((1_000_000, 1_010_000, 1_020_000, 1_030_000), (300_000, 800_000, 1_300_000, 2_400_000)))
    assert near.confidence > far.confidence
    assert _value(spark, [{"price": p} for p in (9_966, 800_000, 810_000, 790_000, 805_000, 795_000)]).sample_size == 5
    assert _value(spark, [{"price": p} for p in (9_966, 800_000)]).sample_size == 2
    assert _value(spark, [{"price": 1}], family="other", **{"class": "bus-shuttle"}).status == "unavailable"
    assert _value(spark, [{"price": 900_000}], external_id="1000").status == "unavailable"


def test_weighted_quantile_over_rows(spark):
    r = random.Random(9)
    data = [(k % 3, r.randrange(50), r.randrange(1, 9)) for k in range(200)]
    got = {x.g: x for x in weighted_quantile(spark.createDataFrame(data, "g int, v long, w long"), ["g"], "v", "w", [2, 5, 8]).collect()}
    for g in range(3):
        mine = sorted((v, w) for h, v, w in data if h == g)
        total = sum(w for _, w in mine)
        for q in (2, 5, 8):
            run = 0
            for v, w in mine:
                run += w
                if run * 10 >= total * q:
                    break
            assert got[g][f"q{q}"] == v


def test_forecast_is_monotone_in_the_bid(spark):
    lots = spark.createDataFrame([(f"{k}", k * 100_000, 3, "available", 1_000_000, 1_200_000, 1_500_000, 0.7) for k in range(0, 20)], "id string, current_bid_cents long, bidder_count int, valuation_status string, low_cents long, median_cents long, high_cents long, valuation_confidence double")
    lots = lots.withColumn("ends_at", F.timestamp_micros(F.unix_micros(NOW()) + 3_600_000_000))
    outcomes = spark.createDataFrame([], "id string, outcome_id string, close_cents long, match_score double, weight double")
    trends = spark.createDataFrame([], "id string, aggression double, observations long")
    got = sorted(forecasts.reference_forecast(lots, outcomes, trends, NOW()).collect(), key=lambda r: int(r.id))
    assert all(r.low_cents <= r.expected_cents <= r.high_cents for r in got)
    assert all(a.expected_cents <= b.expected_cents for a, b in zip(got, got[1:]))


def test_fold_twice_is_fold_once(spark):
    schema = "source_key string, external_id string, observed_at int, closed_high_bid_cents long, ended_at int, mileage long, vin string, part_id long, supplier_id long"
    old = spark.createDataFrame([("s", "1", 5, 10, 5, 7, "v", 1, 1), ("s", "2", 5, 20, 5, None, None, 1, 1)], schema)
    new = spark.createDataFrame([("s", "1", 4, 11, 5, None, None, 2, 2), ("s", "2", 6, 21, 5, 3, "w", 2, 2), ("s", "3", 1, 31, 5, 3, None, 2, 2)], schema)
    once = ledger.upsert_comparables(old, new)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, ledger.upsert_comparables(once, new).collect()), key=str)
    assert {r.external_id: (r.closed_high_bid_cents, r.vin) for r in once.collect()} == {"1": (10, "v"), "2": (21, "w"), "3": (31, None)}


def test_history_and_board(spark):
    rows = spark.createDataFrame([("a", 1, 10, 1, "active", 5), ("a", 2, 10, 1, "active", 5), ("a", 3, None, 1, "active", 7), ("a", 4, None, 1, "ended", 6)], "auction_id string, observed_at int, bid_cents long, bidders int, status string, ends_at int")
    assert [r.observed_at for r in history.change_points(rows).orderBy("observed_at").collect()] == [1, 3, 4]
    assert [r.extension_count for r in history.extension_count(rows).orderBy("observed_at").collect()] == [0, 0, 1, 1]
    assert [r.effective_ends_at for r in history.effective_end(rows).orderBy("observed_at").collect()] == [5, 5, 7, 7]
    assert [r.carried_bid_cents for r in history.carry_forward_bid(rows).orderBy("observed_at").collect()] == [10, 10, 10, 10]
    states = spark.createDataFrame([(" tx ",), ("—",), ("Unknown",), ("",), ("Texas",)], "s string").select(board.normalize_state(F.col("s")).alias("s"))
    assert [r.s for r in states.collect()] == ["TX", None, None, None, "Texas"]


def test_sync_windows(spark):
    rows = spark.createDataFrame([(None,), ("2026-08-05 16:00:00",), ("2026-06-05 17:00:00",)], "t string").select(F.to_timestamp("t").alias("covered_through"))
    assert [r["mode"] for r in cadence.sync_window(rows, NOW()).collect()] == ["bootstrap", "incremental", "catch-up"]


def test_leaks(spark):
    rows = spark.range(1).select("id", F.struct(F.lit(1).alias("currentBidCents"), F.lit(2).alias("ok")).alias("v"))
    assert gates.leaks(rows) == ["v.currentBidCents"] and gates.leaks(rows.select("id")) == []


def test_time_weights(spark):
    rows = spark.createDataFrame([(None,), (0,), (59,), (60,), (1_799,), (604_800,)], "s long").select(deals.time_to_close_weight(F.col("s")).alias("w"))
    assert [r.w for r in rows.collect()] == [0.55, 0, 0.1, 0.2, 0.35, 0.9]
    assert math.isclose(one(spark, deals.condition_adjustment(F.lit("salvage"), F.lit("non-operational"), F.array(), F.array()).alias("a")).a, -0.45)


def test_specs_of_lines_and_sentences(spark):
    rows = spark.createDataFrame([("<ul><li>Color: red</li><li>none</li><li>color : <b>blue</b></li></ul> VIN: x",), ("Engine: V8. Doors: four! Clean",), ("",), (None,)], "h string")
    got = [r.m for r in rows.select(lot_text.spec_map(F.col("h")).alias("m")).collect()]
    assert got == [{"color": "blue"}, {"engine": "V8.", "doors": "four!"}, {}, None]


def test_weighted_quantile_over_rows_equals_that_of_arrays(spark):
    r = random.Random(9)
    rows = [(r.choice("abc") if k % 3 else "big", r.choice([r.randrange(1, 40), r.randrange(1, 10**7)]), r.choice([0, 1, 7, 10**6])) for k in range(900)] + [("one", 5, 3), ("none", 5, 0), ("none", 4, 0)]
    df = spark.createDataFrame(rows, "g string, v long, w long")
    sorted_rows = F.sort_array(F.collect_list(F.struct(F.col("v").alias("value"), F.col("w").alias("weight"))))
    want = df.groupBy("g").agg(sorted_rows.alias("s")).select("g", *[quantiles.weighted_quantile_of(F.col("s"), q).alias(f"q{q}") for q in (2, 5, 8)])
    for width in (16, 1 << 16):
        assert {tuple(x) for x in quantiles.weighted_quantile(df, ["g"], "v", "w", [2, 5, 8], width=width).collect()} == {tuple(x) for x in want.collect()}


def test_accents_fold_in_identities_and_catalog_statuses(spark):
    got = spark.createDataFrame([("Citroën ﬁne ²",), ("Škoda",), (None,), ("Ford Motor Co",)], "m string").select(identity.compact(F.col("m")).alias("c")).collect()
    assert [x.c for x in got] == ["CITROENFINE2", "SKODA", "", "FORD"]
    told = spark.createDataFrame([("A",), (" preview",), (None,), ("closed",)], "s string").select(lot_text.status_of(F.col("s"), "catalog").alias("t")).collect()
    assert [x.t for x in told] == ["active", "preview", "scheduled", "unknown"]
