"""Auctions of a stream are folded together, and clocks don't depend on micro-batches."""

import random
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from gavelflow.functions.cadence import TERMINAL
from gavelflow.streaming import bids

START = datetime(2024, 1, 1)
AFTER = [("grace", timedelta()), ("reconciliation", timedelta(minutes=2)), ("stale", timedelta(days=1))]


def observed(seed, auctions, n):
    """Rows in order of time, each at its own, some without an auction, an end or a bid."""
    r = random.Random(seed)
    when = sorted(r.sample(range(1, 20 * 24 * 60), n))
    end = lambda at: r.choice([None, START, at + timedelta(minutes=r.randrange(-90, 1_500))])
    times = [START + timedelta(minutes=m) for m in when]
    return [(r.choice([None, *range(auctions)]), at, r.choice([None, 100, 200]), r.choice([1, None]), r.choice(["active", "active", "active", None, "sold"]), end(at), k) for k, at in enumerate(times)]


def landed(spark, rows, folder, files):
    size = -(-len(rows) // files)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], bids.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return folder


def clocks(rows):
    """What each auction enters, row by row."""
    held, out = {}, []

    def run(who, passed):
        end, done = held[who]
        while done < 3 and passed(end + AFTER[done][1]):
            out.append((who, AFTER[done][0], end + AFTER[done][1]))
            done += 1
        held[who] = end, done
        if done == 3:
            del held[who]

    for who, at, _, _, status, end, _ in rows:
        if who in held:
            run(who, lambda x, at=at: x < at)
        if status in TERMINAL:
            held.pop(who, None)
            out.append((who, "terminal", at))
        elif end and (who not in held or end > held[who][0]):
            held[who] = end, 0
    for who in list(held):
        run(who, lambda x: x <= rows[-1][1])
    return out


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))


@pytest.mark.parametrize("files", [1, 5])
def test_clocks_of_few_and_many_micro_batches_are_those_of_a_plain_fold(spark, tmp_path, files):
    rows = observed(11, 9, 400)
    stream = bids.read_events(spark, landed(spark, rows, str(tmp_path / "in"), files), 1)
    bids.run_to_table(bids.stream_close_timers(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [(x.auction_id, x.phase, x.at) for x in spark.read.schema(bids.TIMED).parquet(str(tmp_path / "out")).collect()]
    want = clocks(rows)
    assert in_order(got) == in_order(want) and {x[1] for x in want} == {"grace", "reconciliation", "stale", "terminal"}


def test_the_query_lets_timers_run(spark, tmp_path):
    """Two auctions a month apart from the stream's end, one of them sold."""
    at = lambda days, hours=1: START + timedelta(days=days, hours=hours)
    rows = [(k, at(k % 28), 1 if k < 99 else 2, "error" if k == 98 else "view", 5.0) for k in range(0, 100, 7)] + [(98, at(3, 2), 7, "view", 5.0), (99, at(3, 3), 7, "error", 5.0), (200, at(0, 2), 3, "view", 5.0), (201, at(29), 4, "view", 5.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(x.auction_id, x.phase): x.at_us for x in entry.queries()["stream_close_timers"](spark, str(tmp_path)).filter("auction_id IN (3, 4, 7)").collect()}
    us = lambda when: int((when - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert got == {(3, name): us(START + timedelta(days=1) + late) for name, late in AFTER} | {(7, "terminal"): us(at(3, 3))}


def test_changes_of_many_auctions_take_few_states(spark, tmp_path):
    """One state and one call for a group: 1,500 auctions were as many before."""
    rows = observed(12, 1_500, 6_000)
    stream = bids.read_events(spark, landed(spark, rows, str(tmp_path / "in"), 3), 1)
    bids.run_to_table(bids.stream_change_points(stream, "400 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {x.event_id: (x.auction_id, x.extension_count, x.effective_ends_at) for x in spark.read.schema(bids.CHANGES).parquet(str(tmp_path / "out")).collect()}
    want, last, moved, latest = {}, {}, {}, {}
    for who, _, bid, n, status, end, k in rows:
        moved[who] = moved.get(who, 0) + bool(who in last and end and last[who][3] and end > last[who][3])
        latest[who] = max((x for x in (latest.get(who), end) if x), default=None)
        if last.get(who) != (bid, n, status, end):
            want[k] = (who, moved[who], latest[who])
        last[who] = (bid, n, status, end)
    assert got == want and len({x[0] for x in rows}) > 1_400
    assert spark.read.format("statestore").load(str(tmp_path / "check")).count() <= bids.GROUPS + 1


def test_a_silent_auction_is_forgotten_in_a_group_that_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bids, "GROUPS", 1)
    rows = [(1, START, 5, 1, "active", START, 1)] + [(2, START + timedelta(hours=12 * k), 5, 1, "active", START, 10 + k) for k in range(1, 9)] + [(1, START + timedelta(hours=100), 5, 1, "active", START, 99)]
    stream = bids.read_events(spark, landed(spark, rows, str(tmp_path / "in"), len(rows)), 1)
    bids.run_to_table(bids.stream_change_points(stream, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(x.event_id for x in spark.read.schema(bids.CHANGES).parquet(str(tmp_path / "out")).collect()) == [1, 11, 99]
