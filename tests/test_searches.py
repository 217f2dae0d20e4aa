"""Shelf searches against plain sorting, and how much they read when the data grow."""

import random

from pyspark.sql import functions as F

from gavelflow.functions import matching as M
from gavelflow.operators import comparables, market
from gavelflow.operators.shelves import Shelf, unpacked

SUBJECT = "id string, external_id string, family string, class string, year int, mileage long, condition string, operability string, vin string, issues int"
COMP = "auction_id string, family string, class string, year int, mileage long, condition string, operability string, vin string, issues int, closed_high_bid_cents long, ended_at timestamp"
CONDITIONS = ["new", "usable", "unknown", "repairable", "salvage", "scrap", None, "odd"]
OPERABILITY = ["runs-and-drives", "runs", "unknown", "non-operational", None]


def vehicles(spark, r, n, kind, families=("f1", "f2", None), years=(1996, 2003), miles=lambda r: r.choice([0, 1, 400, 999, 1000, 1001, r.randrange(200_000)])):
    rows = []
    for i in range(n):
        row = [f"{kind}{i}", r.choice(families), r.choice(["van", "suv", None]), r.choice([*range(*years), None]), r.choice([miles(r), miles(r), miles(r), None]), r.choice(CONDITIONS), r.choice(OPERABILITY), r.choice([None, f"v{r.randrange(40)}"]), r.randrange(3)]
        rows.append([row[0], f"c{r.randrange(50)}", *row[1:]] if kind == "s" else [*row, r.randrange(1, 10**6)])
    if kind == "s":
        return spark.createDataFrame(rows, SUBJECT)
    return spark.createDataFrame(rows, COMP.replace(", ended_at timestamp", "")).withColumn("ended_at", F.timestamp_seconds(F.lit(10**9) + F.crc32(F.col("auction_id").cast("binary")) % 20 * 86_400))


def every_pair(subjects, comps, year, k, classes):
    """(subject, tier, auction, rank) by joining all with all."""
    s, c = comparables.sides()
    left = subjects.select(*[F.col(x).alias(f"s_{x}") for x in comparables.SUBJECT])
    right = comparables.latest_per_vin(comps).select(*[F.col(x).alias(f"c_{x}") for x in comparables.COMP])
    pairs = left.crossJoin(right).filter(comparables.not_self())
    family = pairs.filter((s["family"] == c["family"]) & M.guards(s, c, year, M.FAMILY)).withColumn("score", M.match_score(s, c, 1.0))
    family = family.withColumn("tier", F.when(M.guards(s, c, year, M.TIGHT), 1).otherwise(2))
    wide = pairs.filter(s["class"].isin(classes) & s["year"].isNotNull() & (s["class"] == c["class"]) & M.guards(s, c, year, M.CLASS))
    wide = wide.withColumn("score", F.when(s["family"] == c["family"], M.match_score(s, c, 1.0)).otherwise(M.match_score(s, c, 0.58))).withColumn("tier", F.lit(3))
    found = {}
    for r in family.unionByName(wide).collect():
        found.setdefault(r.s_id, {}).setdefault(r.tier, []).append((-r.score, -r.c_ended_at.timestamp(), r.c_auction_id, r.c_family))
    best, sizes = set(), {}
    for subject, tiers in found.items():
        t = min(tiers)
        if t == 3 and (len(tiers[3]) < 3 or len({x[3] for x in tiers[3]} - {None}) < 2):
            continue
        sizes[subject] = (t, len(tiers[t]))
        best |= {(subject, t, x[2], i + 1) for i, x in enumerate(sorted(tiers[t])[:k])}
    return best, sizes


def test_matches_are_those_of_all_pairs(spark):
    r = random.Random(11)
    subjects, comps = vehicles(spark, r, 250, "s"), vehicles(spark, r, 900, "c", families=("f1", "f2", "f3", "f4", None))
    want, sizes = every_pair(subjects, comps, 2002, 4, ["van"])
    got = comparables.match_comparables(subjects, comps, 2002, k=4, classes=["van"]).select("s_id", "tier", "c_auction_id", "rank").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert {x[1] for x in want} == {1, 2, 3}
    counts = comparables.tier_counts(subjects, comps, 2002, classes=["van"]).collect()
    assert {x.id: (x.tier, x.candidates) for x in counts if x.candidates} == sizes and len(counts) == 250


def read_by_joins(spark, run):
    """Rows that all joins of ``run`` put out, from Spark's own metrics; but for left outer ones,
    which give each row of the sorted sales what its range takes up, and make no pairs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    total, executions = 0, store.executionsList()
    for i in range(before, executions.size()):
        e = executions.apply(i)
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            for m in range(node.metrics().size()) if "Join" in node.name() and "LeftOuter" not in node.desc() else ():
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_pairs_stay_bounded_when_one_cell_grows_tenfold(spark):
    r = random.Random(12)
    one = dict(families=("f1",), years=(2000, 2001), miles=lambda r: r.randrange(20_000, 120_000))
    subjects = vehicles(spark, r, 60, "s", **one).withColumns({"class": F.lit("van"), "year": F.lit(2000), "condition": F.lit("usable"), "operability": F.lit("runs"), "mileage": F.coalesce("mileage", F.lit(50_000))})
    comps = vehicles(spark, r, 30_000, "c", **one).withColumns({"class": F.lit("van"), "year": F.lit(2000), "condition": F.lit("usable"), "operability": F.lit("runs"), "vin": F.lit(None).cast("string")})
    few, many = comps.filter("substr(auction_id, -1) = '3'"), comps
    rows = [read_by_joins(spark, lambda: comparables.match_comparables(subjects, x, 2002, k=5, classes=[]).count()) for x in (few, many)]
    assert few.count() * 9 < many.count() and 60 < rows[1] < 1.5 * rows[0]


def test_shelf_reads_what_is_next(spark):
    r = random.Random(13)
    rows = [(r.choice("ab"), r.choice([None, r.randrange(60)]), i) for i in range(400)]
    shelf = Shelf(spark.createDataFrame(rows, "cell string, at int, n int"), ["cell"], "at", ["n"], keep=2, block=3)
    asked = [(c, x) for c in "abz" for x in (-5, 0, 17, 59, 99)]
    got = unpacked(shelf.near(spark.createDataFrame(asked, "cell string, start int"), F.col("start"), 4)).collect()
    want = set()
    for c, x in asked:
        values = sorted({at for cell, at, _ in rows if cell == c and at is not None})
        for at in [v for v in values if v >= x][:4] + [v for v in values if v < x][-4:]:
            want |= {(c, x, at, n) for n in sorted(n for cell, v, n in rows if (cell, v) == (c, at))[:2]}
    assert {(x.cell, x.start, x.at, x.n) for x in got} == want and len(got) == len(want)


def test_exact_identity_takes_the_nearest_of_both_keys(spark):
    r = random.Random(14)
    vehicle = lambda: (r.choice(["k1", "k2", None]), r.choice([2000, 2001, None]), r.choice(["Ford", "FORD", None]), r.choice(["x", "X"]), r.choice([None, r.randrange(9) * 1000]))
    subjects = [(f"s{i}", f"c{i}", *vehicle()) for i in range(40)]
    sales = [(f"c{i}", *vehicle(), r.choice([0, 5, 9]), r.randrange(4)) for i in range(300)]
    s = spark.createDataFrame(subjects, "id string, external_id string, key string, year int, make string, model string, mileage long")
    c = spark.createDataFrame(sales, "external_id string, key string, year int, make string, model string, mileage long, closed_high_bid_cents long, n int").withColumn("ended_at", F.timestamp_seconds(F.col("n")))
    got = {(x.s_id, x.c_external_id, x["rank"]) for x in market.exact_identity_comps(s, c, F.timestamp_seconds(F.lit(2)), k=6).collect()}
    want = set()
    low = lambda x: x if x is None else x.lower()
    for i, ext, key, year, make, model, miles in subjects:
        fits = []
        for e, k2, y2, m2, o2, miles2, price, n in sales:
            same = (key is not None and key == k2) or (None not in (year, make) and (year, low(make), low(model)) == (y2, low(m2), low(o2)))
            if same and price > 0 and n <= 2 and e != ext:
                gap = None if None in (miles, miles2) else abs(miles - miles2)
                fits.append((gap is None, gap or 0, -n, e))
        want |= {(i, x[3], at + 1) for at, x in enumerate(sorted(fits)[:6])}
    assert got == want
