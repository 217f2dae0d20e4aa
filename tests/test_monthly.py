"""The monthly ledger: what a merge touches, moves between months, and what interrupted runs leave."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gavelflow.operators import ledger
from gavelflow.sources.monthly import MonthlyLedger

ROWS = "source_key string, external_id string, observed_at timestamp, ended_at timestamp, closed_high_bid_cents long, mileage long, vin string"
START = datetime(2024, 1, 1)


def sales(spark, seed, n, ids, days):
    r = random.Random(seed)
    rows = {}
    for _ in range(n):
        key = str(r.choice(ids))
        rows[key] = ("lots", key, START + timedelta(days=r.randrange(200)), START + timedelta(days=r.choice(days)) if r.random() < 0.95 else None, r.randrange(10**6), r.choice([None, 5]), r.choice([None, "v"]))
    return spark.createDataFrame(list(rows.values()), ROWS)


def held(df):
    return sorted(map(str, df.select(*[x.split()[0] for x in ROWS.split(", ")]).collect()))


def monthly(spark, path):
    return MonthlyLedger(spark, str(path), sales(spark, 0, 1, [1], [1]).schema, ["source_key", "external_id"], buckets=4)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.glob("rows/month=*/*.parquet")}


def test_merges_equal_full_folds_while_ends_move(spark, tmp_path):
    months, plain = monthly(spark, tmp_path), None
    for seed in range(4):
        batch = sales(spark, seed, 60, range(100), range(150))
        months.merge(batch, ledger.upsert_comparables)
        plain = batch if plain is None else ledger.upsert_comparables(plain, batch)
        assert held(months.months()) == held(plain)
    wrong = months.months().filter(~F.col("month").eqNullSafe(F.coalesce(F.date_format("ended_at", "yyyy-MM"), F.lit("none"))))
    assert wrong.count() == 0
    assert held(months.scan("2024-02-10", "2024-04-01")) == held(plain.filter("ended_at >= '2024-02-10' AND ended_at < '2024-04-01'"))


def test_a_month_of_new_rows_touches_that_month_alone(spark, tmp_path):
    months = monthly(spark, tmp_path)
    months.merge(sales(spark, 1, 300, range(1000), range(150)), ledger.upsert_comparables)
    before = files(tmp_path)
    batch = sales(spark, 2, 40, range(2000, 2100), range(62, 80)).filter("ended_at IS NOT NULL")  # March
    assert months.merge(batch, ledger.upsert_comparables) == ["2024-03"]
    after = files(tmp_path)
    assert {f: t for f, t in before.items() if "2024-03" not in f} == {f: t for f, t in after.items() if "2024-03" not in f}
    scan = months.scan("2024-03-01", "2024-03-31")
    assert {f.split("month=")[1][:7] for f in scan.inputFiles()} >= {"2024-03"} and "PartitionFilters: [isnotnull(month" in scan._jdf.queryExecution().toString()


def test_a_month_that_all_rows_leave_is_gone(spark, tmp_path):
    months = monthly(spark, tmp_path)
    first = sales(spark, 1, 20, range(5), [3]).withColumn("ended_at", F.lit(START)).withColumn("observed_at", F.lit(START))
    months.merge(first, ledger.upsert_comparables)
    months.merge(first.withColumn("ended_at", F.lit(START + timedelta(days=40))), ledger.upsert_comparables)
    assert [r.month for r in months.months().select("month").distinct().collect()] == ["2024-02"] and months.months().count() == first.count()


def test_a_merge_that_died_is_finished_or_forgotten(spark, tmp_path):
    months, twin = monthly(spark, tmp_path / "a"), monthly(spark, tmp_path / "b")
    one, two = sales(spark, 1, 80, range(100), range(90)), sales(spark, 2, 80, range(100), range(90))
    for m in (months, twin):
        m.merge(one, ledger.upsert_comparables)
    twin.merge(two, ledger.upsert_comparables)
    finish = months.finish

    def dies_at_the_end():
        if (tmp_path / "a" / "pending" / "READY").exists():
            raise RuntimeError("lost")
        finish()

    months.finish = dies_at_the_end
    with pytest.raises(RuntimeError):
        months.merge(two, ledger.upsert_comparables)
    again = monthly(spark, tmp_path / "a")
    assert held(again.months()) == held(twin.months()) and not (tmp_path / "a" / "pending").exists()

    def dies(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        again.merge(one, dies)
    assert held(again.months()) == held(twin.months())


def test_a_walk_that_is_killed_equals_one_run(spark, tmp_path):
    source = sales(spark, 5, 300, range(400), range(90))
    whole, killed = (ledger.WindowWalk(monthly(spark, tmp_path / x)) for x in "ab")
    spark.range(1).select(F.lit(START).cast("timestamp").alias("covered_through")).write.parquet(whole.commits)
    spark.range(1).select(F.lit(START).cast("timestamp").alias("covered_through")).write.parquet(killed.commits)
    assert whole.run(source, "2024-02-20 00:00:00") == 5
    merge, calls = killed.months.merge, []

    def dies_on_the_third(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return merge(*args)

    killed.months.merge = dies_on_the_third
    with pytest.raises(RuntimeError):
        killed.run(source, "2024-02-20 00:00:00")
    killed.months.merge = merge
    killed.run(source, "2024-02-20 00:00:00")
    assert held(killed.months.months()) == held(whole.months.months()) and whole.months.months().count() > 50
    assert killed.cursor().first() == whole.cursor().first()


def test_backfill_walks_until_two_empty_windows(spark):
    rows = spark.createDataFrame([(START - timedelta(days=d),) for d in (1, 3, 20, 49, 700)], "ended_at timestamp")
    got = ledger.backfill_windows(rows, "2024-01-01 00:00:00").orderBy("step").collect()
    assert [(r.step, r.rows) for r in got] == [(0, 2), (1, 1), (2, 0), (3, 1), (4, 0), (5, 0)]
    assert [r["rows"] for r in ledger.backfill_windows(rows.filter("false"), "2024-01-01 00:00:00").orderBy("step").collect()] == [0, 0]
    every = spark.range(0, 14 * 90, 7).select((F.lit(START).cast("timestamp") - F.make_dt_interval(F.col("id").cast("int") + 1)).alias("ended_at"))
    assert ledger.backfill_windows(every, "2024-01-01 00:00:00").count() == 92


def test_staged_months_are_moved_and_a_move_that_died_goes_on(spark, tmp_path):
    months, twin = monthly(spark, tmp_path / "a"), monthly(spark, tmp_path / "b")
    one, two = sales(spark, 1, 80, range(100), range(90)), sales(spark, 2, 80, range(100), range(90))
    for m in (months, twin):
        m.merge(one, ledger.upsert_comparables)
    twin.merge(two, ledger.upsert_comparables)
    move, moved, staged = months._replace, [], set()

    def dies_at_the_third(name, partition):
        staged.update(p.name for p in (tmp_path / "a" / "pending" / name / partition).glob("part-*"))
        if len(moved) == 2:
            raise RuntimeError("lost")
        moved.append(partition)
        move(name, partition)
        if len(moved) == 2:  # moved, but not marked
            (tmp_path / "a" / "pending" / "moved" / name / partition).rmdir()

    months._replace = dies_at_the_third
    with pytest.raises(RuntimeError):
        months.merge(two, ledger.upsert_comparables)
    again = monthly(spark, tmp_path / "a")
    assert held(again.months()) == held(twin.months()) and not (tmp_path / "a" / "pending").exists()
    assert staged and staged <= {p.name for p in (tmp_path / "a").rglob("part-*")}  # the same files
