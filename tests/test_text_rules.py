"""Rules over texts: words looked for first change nothing, texts are read once and dealt to all cores."""

import random
import re

from pyspark.sql import functions as F

from gavelflow.functions import lot_text
from gavelflow.functions.numbers import let
from gavelflow.plans import lot_queries

WORDS = "SUV pickup pick-up mini van minivan trailers trailer dents dent rusted runs and drives engine  runs won't start leaks oil vin: 1FTYR14U8XPB12345 1ftyr14u8xpb12345 2019 1999 odo 12,000 55000 miles Mercedes-Benz ford Land-Rover as is x_van carvan Kia KİA".split(" ")


def texts(n=400):
    r = random.Random(4)
    return [None, "", *[" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 9))) for _ in range(n)]]


def test_words_looked_for_first_change_no_rule(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "k int, t string")
    lists = {"body": lot_text.BODY_RULES, "road": lot_text.NON_ROAD_RULES, "damage": lot_text.DAMAGE_RULES, "runs": lot_text.OPERABILITY_RULES}
    got = {r.k: r for r in rows.select("k", *[lot_text.first_rule(F.col("t"), x).alias(name) for name, x in lists.items()], *[lot_text.all_rules(F.col("t"), x).alias(f"{name}_all") for name, x in lists.items()]).collect()}
    hit = 0
    for k, t in enumerate(texts()):
        for name, rules in lists.items():
            found = [label for p, label in rules if t is not None and re.search(lot_text.ascii_words(f"(?i){p}").replace(r"\d", "[0-9]"), t, re.ASCII)]
            assert got[k][name] == (found[0] if found else None) and list(got[k][f"{name}_all"]) == found
            hit += bool(found)
    assert hit > 300


def test_words_that_matches_begin_with():
    told = {p: lot_text._opening(p) for p in (r"\blas?\b", r"\b(?:mini\s*van|suv)\b", r"\bApache[\s-]+x\b", r"\b(?:ab|cd)?x\b", r"\b(?!ab)cd\b", r"\b[ab]c\b", r"ab\b", r"\b(?:(?:ab)?c|de)\b")}
    assert list(told.values()) == [["la"], ["mini", "suv"], ["apache"], None, None, None, None, None]


def test_facts_equal_plain_patterns(spark):
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "k int, t string").select("k", lot_text.extract_vin(F.col("t")).alias("vin"), lot_text.extract_mileage(F.col("t")).alias("miles"), lot_text.extract_year(F.col("t"), 2024).alias("year")).collect()
    seen = set()
    for k, vin, miles, year in got:
        t = texts()[k] or ""
        run = re.search(r"(?i)(?<![A-Za-z0-9_])([A-HJ-NPR-Z0-9]{17})(?![A-Za-z0-9_])", t, re.ASCII)
        assert vin == (run[1].upper() if run else None)
        said = re.search(r"(?<![A-Za-z0-9_])odo ([\d,]{1,12})(?![A-Za-z0-9_])", t) or re.search(r"(?<![A-Za-z0-9_])([\d,]{1,12}) miles", t)
        assert miles == (int(said[1].replace(",", "")) if said else None)
        dated = re.search(r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])", t)
        assert year == (int(dated[0]) if dated else None)
        seen |= {c for c, v in (("vin", vin), ("miles", miles), ("year", year)) if v is not None}
    assert seen == {"vin", "miles", "year"}


def test_a_value_is_computed_once(spark):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        counted.add(1)
        return str(x)

    rows = spark.range(20).select(slow("id").alias("t")).select(let(F.col("t"), lambda t: F.concat(t, t, F.when(t != "3", t))).alias("out"))
    assert rows.filter("out = '777'").count() == 1 and counted.value == 20


def test_documents_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("The licensed 2019 und "), "id").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    for query in (lot_queries.extract_facts, lot_queries.classify_lot):
        held = query(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
        assert held > spark.sparkContext.defaultParallelism


def test_coverage_counts_as_the_join_does(spark):
    said = ["Question 1FTYR14U8XPB12345 the", "Question\n55000 miles 2019", "nothing", None, "licensed\nlicensed 1999"]
    docs = spark.createDataFrame([(k % 7 if k else None, said[k % 5]) for k in range(40)], "doc_id int, text string")
    text = F.col("text")
    lots = docs.select("doc_id", lot_queries._classified().alias("c"))
    facts = docs.select("doc_id", lot_text.extract_vin(text).alias("vin"), lot_text.extract_mileage(text).alias("mileage"), lot_text.extract_year(text, 2024).alias("year"))
    want = lots.join(facts, "doc_id").agg(
        F.count(F.lit(1)), F.count_if("c.is_vehicle"), F.count_if(~F.col("c.is_vehicle")), F.count("vin"), F.count("mileage"), F.count("c.body_type"), F.count("year"),
    ).first()
    plan = lot_queries.coverage(docs)
    assert tuple(plan.first()) == tuple(want) and min(want) > 0
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
