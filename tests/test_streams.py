"""Streams over several micro-batches, with a replay and a late row, against plain folds."""

import random
import weakref
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gavelflow.functions import cadence
from gavelflow.operators import forecasts, history, opportunities
from gavelflow.streaming import bids

START = datetime(2024, 1, 1)


def events(tied=1):
    """(auction_id, observed_at, bid_cents, bidders, status, ends_at, event_id), by time, so many at one time."""
    r, out = random.Random(6), []
    for k in range(240):
        out.append((r.randrange(6), START + timedelta(minutes=10 * (k - k % tied)), r.choice([None, 100, 100, 200]), r.choice([1, 1, None]), "active", START + timedelta(days=1, hours=r.choice([0, 0, 1, 2])), k))
    return out


def land(spark, rows, folder, schema, files=6):
    """Files one after another in the order of time; then the second again, and a late row."""
    size = -(-len(rows) // files)
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    for part in [*parts, parts[1], rows[:1]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_change_points_over_batches(spark, tmp_path):
    rows = events(tied=7)  # also over the border of two files
    land(spark, rows, str(tmp_path / "in"), bids.EVENTS)
    stream = bids.read_events(spark, str(tmp_path / "in"), 1)
    bids.run_to_table(bids.stream_change_points(stream, "400 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.event_id: (r.extension_count, r.effective_ends_at) for r in spark.read.schema(bids.CHANGES).parquet(str(tmp_path / "out")).collect()}
    want, last, moved, latest = {}, {}, {}, {}
    for a, _, bid, bidders, status, end, k in rows:
        state, before = (bid, bidders, status, end), last.get(a)
        if before and end > before[3]:
            moved[a] = moved.get(a, 0) + 1
        latest[a] = max(latest.get(a, end), end)
        if state != before:
            want[k] = (moved.get(a, 0), latest[a])
        last[a] = state
    assert got == want
    count = spark.read.parquet(str(tmp_path / "out")).count()
    bids.run_to_table(bids.stream_change_points(bids.read_events(spark, str(tmp_path / "in"), 1), "400 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == count  # a restart goes on where it stopped


def test_a_busy_auction_is_folded_frame_by_frame(spark, tmp_path):
    """Rows of one micro-batch lie in no order, and a frame holds few of an auction's."""
    r = random.Random(8)
    rows = [(1 if k % 3 else r.randrange(2, 6), START + timedelta(seconds=k - k % 4), r.choice([None, 100, 200]), 1, "active", START + timedelta(hours=r.choice([0, 0, 0, 1, 2])), k) for k in range(3_000)]
    rows += [(1, None, 5, 1, "active", START, 9_000), (1, START, 5, 1, "active", START, None)]
    r.shuffle(rows)
    spark.createDataFrame(rows, bids.EVENTS).repartition(3).write.parquet(str(tmp_path / "in"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        bids.run_to_table(bids.stream_change_points(bids.read_events(spark, str(tmp_path / "in")), "1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {x.event_id: (x.extension_count, x.effective_ends_at) for x in spark.read.schema(bids.CHANGES).parquet(str(tmp_path / "out")).collect()}
    want, last, moved, latest = {}, {}, {}, {}
    for a, _, bid, _, _, end, k in sorted((x for x in rows if x[1] and x[6] is not None), key=lambda x: (x[1], x[6])):
        moved[a] = moved.get(a, 0) + (a in last and end > last[a][1])
        latest[a] = max(latest.get(a, end), end)
        if last.get(a) != (bid, end):
            want[k] = (moved[a], latest[a])
        last[a] = (bid, end)
    assert got == want
    assert spark.conf.get("spark.sql.streaming.unsupportedOperationCheck") == "true"


def test_a_fold_holds_one_frame():
    """Of two million rows of an auction, each frame is freed before the one after the next comes."""

    class State:
        exists = hasTimedOut = False
        told = None

        def update(self, value):
            self.told = value

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, at):
            pass

    alive, most = [], 0

    def frames():
        nonlocal most
        for k in range(200):
            ids = np.arange(k * 10_000, (k + 1) * 10_000)
            at = pd.Timestamp(START).as_unit("us") + pd.to_timedelta(ids // 3, unit="s")
            frame = pd.DataFrame({"auction_id": 1, "observed_at": at, "bid_cents": ids // 1_000, "bidders": 1, "status": "active", "ends_at": pd.Timestamp(START), "event_id": ids})
            alive.append(weakref.ref(frame))
            most = max(most, sum(x() is not None for x in alive))
            yield frame

    state = State()
    told = sum(len(x) for x in bids._fold((1,), frames(), state))
    assert told == 2_000 and state.told[1] == 1_999_999 and most <= 2


def test_scans_of_a_busy_auction_equal_plain_folds(spark):
    """One auction has a third of all rows; the order is cut into stretches in the middle of it."""
    r = random.Random(7)
    when = lambda: None if r.random() < 0.02 else START + timedelta(minutes=r.randrange(80))
    rows = [(1 if k % 3 == 0 else r.randrange(2, 12), when(), r.choice([None, None, 100, 200]), r.choice([1, None]), "active", r.choice([None, START, START + timedelta(hours=r.randrange(4))]), k) for k in range(900)]
    df = spark.createDataFrame(rows, bids.EVENTS)
    changed = {x.event_id for x in history.change_points(df).collect()}
    moved = {x.event_id: x.extension_count for x in history.extension_count(df).collect()}
    ends = {x.event_id: x.effective_ends_at for x in history.effective_end(df).collect()}
    carried = {x.event_id: x.carried_bid_cents for x in history.carry_forward_bid(df).collect()}
    want, last = (set(), {}, {}, {}), {}
    for a, at, bid, n, status, end, k in sorted(rows, key=lambda x: (x[1] is not None, x[1] or START, x[6])):
        before, moves, latest, known = last.get(a, (None, 0, None, None))
        if before != (bid, n, status, end):
            want[0].add(k)
        if before and end and before[3] and end > before[3]:
            moves += 1
        latest = max(x for x in (latest, end) if x) if latest or end else None
        known = known if bid is None else bid
        want[1][k], want[2][k], want[3][k] = moves, latest, known
        last[a] = ((bid, n, status, end), moves, latest, known)
    assert (changed, moved, ends, carried) == want
    stretches = history._scanned(df, ("bid_cents",)).filter("auction_id = 1").select("x_part").distinct().count()
    assert stretches > 1


def test_close_timers_run_by_event_time(spark, tmp_path):
    end = START + timedelta(hours=1)
    rows = [(1, START, 5, 1, "active", end, 1), (2, START, 5, 1, "active", end, 2), (3, START + timedelta(minutes=1), 5, 1, "active", None, 3)]
    rows += [(2, START + timedelta(hours=2), 5, 1, "sold", end, 4), (9, START + timedelta(hours=3), 5, 1, "active", START + timedelta(days=90), 5), (9, START + timedelta(days=3), 5, 1, "active", START + timedelta(days=90), 6), (9, START + timedelta(days=4), 5, 1, "active", START + timedelta(days=90), 7)]
    for row in rows:
        spark.createDataFrame([row], bids.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    timed = bids.stream_close_timers(bids.read_events(spark, str(tmp_path / "in"), 1))
    bids.run_to_table(timed, str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r.auction_id, r.phase, r.at) for r in spark.read.schema(bids.TIMED).parquet(str(tmp_path / "out")).collect())
    assert [x for x in got if x[0] == 1] == [(1, "grace", end), (1, "reconciliation", end + timedelta(minutes=2)), (1, "stale", end + timedelta(days=1))]
    assert (2, "terminal", START + timedelta(hours=2)) in got and not any(p == "stale" for a, p, _ in got if a == 2)
    assert not [x for x in got if x[0] in (3, 9)]


def test_reprices_over_batches_end_like_one(spark, tmp_path):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    board = spark.createDataFrame(
        [(str(k), 50, 1, "active", START + timedelta(days=2), START, "v", 5, "available", 4_000_000, 5_000_000, 6_000_000, 0.8) for k in range(6)],
        "id string, current_bid_cents long, bidder_count int, status string, ends_at timestamp, last_checked_at timestamp, vin string, mileage long, valuation_status string, low_cents long, median_cents long, high_cents long, valuation_confidence double",
    )
    outcomes = spark.createDataFrame([], "id string, outcome_id string, close_cents long, match_score double, weight double")
    kind = "id string, current_bid_cents long, bidder_count int, status string, ends_at timestamp, last_checked_at timestamp"
    live = [(str(a), bid, n, status, end, at) for a, at, bid, n, status, end, _ in events()]
    land(spark, live, str(tmp_path / "in"), kind)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bids.stream_reprice(stream, board, outcomes, now, str(tmp_path / "out"))
    told = spark.read.parquet(str(tmp_path / "out" / "assessed"))
    assert told.select("batch").distinct().count() > 3
    got = {r.id: (r.current_bid_cents, r.last_checked_at, r.score, r.forecast_expected) for r in sorted(told.collect(), key=lambda r: r.batch)}
    last = {x[0]: x for x in live}
    points = spark.createDataFrame([(x[0], x[5], x[1]) for x in live], "auction_id string, observed_at timestamp, bid_cents long")
    bid = spark.createDataFrame([(k, x[1]) for k, x in last.items()], "auction_id string, current_bid_cents long")
    trends = forecasts.bid_aggression(points, bid).withColumnRenamed("auction_id", "id")
    assert trends.filter("observations = 24").count() == 6 and trends.filter("aggression > 0").count() > 0
    once = opportunities.reprice_live(board, spark.createDataFrame(list(last.values()), kind), outcomes, trends, now)
    assert got == {r.id: (r.current_bid_cents, r.last_checked_at, r.score, r.forecast_expected) for r in once.collect()}
    state = bids.with_changes(board, str(tmp_path / "out" / "board"), ["id"])
    assert {r.id: r.last_checked_at for r in state.collect()} == {k: x[5] for k, x in last.items()}


def test_catch_up_windows(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 2, 19)), (3, None)], "id int, covered_through timestamp")
    got = cadence.catch_up_windows(rows, F.lit("2024-02-20 00:00:00").cast("timestamp")).orderBy("id", "step").collect()
    one = [(r.from_at, r.to_at) for r in got if r.id == 1]
    assert one[0] == (datetime(2023, 12, 30), datetime(2024, 1, 13)) and one[-1][1] == datetime(2024, 2, 20)
    assert all(a[1] - b[0] == timedelta(days=2) for a, b in zip(one, one[1:], strict=False))
    assert [(r.from_at, r.to_at) for r in got if r.id == 3] == [(datetime(2024, 2, 13), datetime(2024, 2, 20))]


def test_a_small_frame_costs_no_frame_operations(monkeypatch):
    """A fold of a few rows: nulls, a replay, a late row, and no pandas comparison of columns."""
    at = lambda *hours: [None if h is None else START + timedelta(hours=h) for h in hours]
    frame = lambda ids, times, bid, status, ends: pd.DataFrame({"auction_id": 1, "observed_at": at(*times), "bid_cents": bid, "bidders": 1, "status": status, "ends_at": pd.to_datetime(pd.Series(at(*ends))), "event_id": ids})
    monkeypatch.setattr(pd.DataFrame, "drop_duplicates", None)
    monkeypatch.setattr(pd.DataFrame, "shift", None)
    last, out = bids._step(None, frame([1, 2, 2, 3], [0, 1, 1, 2], [None, None, None, 5.0], [None, None, None, "active"], [None, 9, 9, 8]))
    assert out["event_id"].tolist() == [1, 2, 3] and out["extension_count"].tolist() == [0, 0, 0]
    assert pd.isna(out["effective_ends_at"].iloc[0]) and out["effective_ends_at"].iloc[2] == at(9)[0]
    last, out = bids._step(last, frame([3, 4, 5], [2, 3, 4], [5.0, 5.0, 5.0], ["active"] * 3, [8, 8, 10]))
    assert out["event_id"].tolist() == [5] and out["extension_count"].tolist() == [1] and last[1] == 5 and last[6] == 1
