"""Subjects that look for the same are searched for once, and each leaves its own sales out."""

import random

from pyspark.sql import functions as F

from gavelflow.operators import comparables, market
from gavelflow.operators.shelves import Shelf, grouped, handed_out
from tests.test_searches import vehicles


def sales_read(monkeypatch, run):
    """Values whose sales the shelves give out."""
    asked, items = [], Shelf.items
    with monkeypatch.context() as m:
        m.setattr(Shelf, "items", lambda self, sized: asked.append(sized.count()) or items(self, sized))
        run()
    return sum(asked)


def copies(subjects, n):
    return subjects.crossJoin(subjects.sparkSession.range(n).withColumnRenamed("id", "copy")).withColumn("id", F.concat("id", F.lit("/"), F.col("copy").cast("string"))).drop("copy")


def test_what_is_read_does_not_grow_with_equal_subjects(spark, monkeypatch):
    r = random.Random(21)
    subjects, comps = vehicles(spark, r, 30, "s"), vehicles(spark, r, 600, "c")
    identities = lambda rows, ident: rows.select(F.col(ident).alias("external_id"), "family", F.col("family").alias("key"), "year", F.col("family").alias("make"), F.col("class").alias("model"), "mileage", *([] if ident == "auction_id" else ["id"]), *(["closed_high_bid_cents", "ended_at"] if ident == "auction_id" else []))
    now = F.timestamp_seconds(F.lit(2 * 10**9))
    for run in (
        lambda s: comparables.match_comparables(s, comps, 2002, k=4, classes=[]).count(),
        lambda s: comparables.candidate_pool(s, comps, k=5).count(),
        lambda s: market.exact_identity_comps(identities(s, "external_id"), identities(comps, "auction_id"), now, k=4).count(),
    ):
        few, many = sales_read(monkeypatch, lambda: run(copies(subjects, 2))), sales_read(monkeypatch, lambda: run(copies(subjects, 8)))  # noqa: B023
        assert 0 < many == few


def test_pools_are_those_of_plain_sorting(spark):
    r = random.Random(22)
    subjects = vehicles(spark, r, 80, "s", miles=lambda r: r.randrange(12) * 8_000)
    comps = vehicles(spark, r, 500, "c", miles=lambda r: r.randrange(12) * 8_000)
    got = {(x.id, x.auction_id, x.by, x["rank"]) for x in comparables.candidate_pool(subjects, comps, k=6).collect()}
    want, sales = set(), comps.collect()
    for s in subjects.collect():
        for key, years, least, share in (("family", 5, 40_000, 0.75), ("class", 2, 15_000, 0.35)):
            fits = []
            for c in sales if None not in (s[key], s.year, s.mileage) else ():
                own = c.auction_id == s.external_id or (s.vin is not None and s.vin == c.vin)
                if not own and c[key] == s[key] and None not in (c.year, c.mileage) and abs(c.year - s.year) <= years and abs(c.mileage - s.mileage) <= max(least, s.mileage * share):
                    fits.append((abs(c.year - s.year), abs(c.mileage - s.mileage), -c.ended_at.timestamp(), c.auction_id))
            if fits:
                want |= {(s.id, x[3], key, at + 1) for at, x in enumerate(sorted(fits)[:6])}
                break
    assert got == want


def test_a_large_group_is_laid_out_in_several_places(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") < 45, "a").alias("look"))
    groups = grouped(rows, ["look"], "large-group")
    lists = groups.select("x_group", F.array("look").alias("x_all"))
    out = handed_out(rows, groups, lists, ["look"], most=10)
    assert {(x.id, x.look, *x.x_all) for x in out.collect()} == {(k, v, v) for k in range(50) for v in ["a" if k < 45 else None]} and out.count() == 50
