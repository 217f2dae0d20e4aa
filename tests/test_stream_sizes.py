"""What a stream costs by its plan: stores, micro-batches, shuffles and columns, not rows."""

from pyspark.sql import functions as F

from gavelflow.operators import forecasts
from gavelflow.plans import stream_queries
from gavelflow.streaming import bids


def test_state_lies_in_a_few_stores_for_each_core(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        with bids.keyed_state(spark):
            held = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert held == bids.STORES * spark.sparkContext.defaultParallelism and spark.conf.get("spark.sql.shuffle.partitions") == "1000"
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        with bids.keyed_state(spark):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "1"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_timers_take_two_numbers_of_a_row(spark, tmp_path):
    spark.createDataFrame([], bids.EVENTS).write.parquet(str(tmp_path / "in"))
    plan = bids.stream_close_timers(bids.read_events(spark, str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    head = next(x for x in plan.splitlines() if "Project" in x)
    assert "ends_us" in head and "final_us" in head and "bidders" not in head


def test_more_files_make_no_more_micro_batches(spark, tmp_path):
    for files, most in ((4, 1), (9, 1), (17, 2), (40, 4)):
        place = str(tmp_path / f"f{files}")
        spark.range(0, files, 1, files).write.parquet(place)
        held = stream_queries._trigger_files(spark, place)
        assert held == most and -(-files // held) <= stream_queries.FILES + 2


def test_changes_of_wanted_keys_are_those_of_all(spark, tmp_path):
    base = spark.createDataFrame([(k, k % 3, f"old{k}") for k in range(30)], "a int, b int, v string")
    for number, keys in enumerate((range(0, 10), range(5, 15))):
        spark.createDataFrame([(k, k % 3, f"new{number}-{k}") for k in keys], "a int, b int, v string").write.parquet(str(tmp_path / "c" / f"batch={number}"))
    wanted = spark.createDataFrame([(k, k % 3) for k in (0, 7, 7, 12, 20, 99)], "a int, b int")
    for before in (0, 1, 2):
        every = {r.a: r.v for r in bids.with_changes(base, str(tmp_path / "c"), ["a", "b"], before).collect()}
        got = {r.a: r.v for r in bids.with_changes(base, str(tmp_path / "c"), ["a", "b"], before, wanted).collect()}
        assert got == {k: every[k] for k in (0, 7, 12, 20)}


def test_outcomes_weighed_once_forecast_the_same(spark):
    rows = spark.createDataFrame([(f"l{k % 5}", f"o{k}", 1_000_000 + k * 7_000, 0.5 + k % 5 / 10, 1.0 + k % 3) for k in range(60)], "id string, outcome_id string, close_cents long, match_score double, weight double")
    lots = spark.createDataFrame([(f"l{k}", 900_000 * k, k, "available", 2_000_000, 3_000_000, 4_000_000, 0.7) for k in range(7)], "id string, current_bid_cents long, bidder_count int, valuation_status string, low_cents long, median_cents long, high_cents long, valuation_confidence double").withColumn("ends_at", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    trends = spark.createDataFrame([("l1", 0.4, 9)], "id string, aggression double, observations long")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    told = [forecasts.reference_forecast(lots, x, trends, now).orderBy("id").collect() for x in (rows, forecasts.weighed_outcomes(rows))]
    assert told[0] == told[1] and len(told[0]) == 7
