"""Exports judged by what was observed while they were written."""

import random

import pytest
from pyspark.sql import functions as F

from gavelflow.sources import content, exports
from gavelflow.sources.generations import Generations

AT = "2024-05-01 12:00:00"
VALUES = "subject_id string, status string, low_cents long, median_cents long, high_cents long, confidence double, sample_size int, as_of timestamp"
SALES = "auction_id string, source_url string, closed_high_bid_cents long, ended_at timestamp, vin string, mileage long"


def values(spark, n=12, valued=8, **other):
    rows = spark.range(n).select(F.concat(F.lit("s"), "id").alias("subject_id"), F.when(F.col("id") < valued, "available").otherwise("unavailable").alias("status"), F.lit(AT).cast("timestamp").alias("as_of"))
    some = F.col("status") == "available"
    rows = rows.withColumns({"low_cents": F.when(some, 5), "median_cents": F.when(some, 6), "high_cents": F.when(some, 7), "confidence": F.when(some, F.lit(0.5)), "sample_size": F.when(some, 3).otherwise(0)})
    return rows.withColumns({c: F.expr(x) for c, x in other.items()}).select(*[c.split()[0] for c in VALUES.split(", ")])


def sales(spark, n=30, detailed=30, **other):
    rows = spark.range(n).select(F.concat(F.lit("a"), "id").alias("auction_id"), F.lit("https://sales.example/x").alias("source_url"), F.lit(100).cast("long").alias("closed_high_bid_cents"), F.lit(AT).cast("timestamp").alias("ended_at"), F.lit("1GNSKAECXGR377492").alias("vin"), F.when(F.col("id") < detailed, F.col("id")).alias("mileage"))
    return rows.withColumns({c: F.expr(x) for c, x in other.items()})


def stores(spark, folder):
    return Generations(spark, str(folder / "values"), ("subject_id",)), Generations(spark, str(folder / "sales"), ("auction_id",))


def export(spark, folder, v, s, name="e1", days=365):
    return exports.export_market(v, s, *stores(spark, folder), name, AT, "sales.example", days)


def test_both_exports_are_taken_with_figures_and_revision(spark, tmp_path):
    v, s = export(spark, tmp_path, values(spark), sales(spark))
    root, corpus = stores(spark, tmp_path)
    m = root.manifest().first()
    assert (m.row_count, m.figures["valued"], m.figures["unavailable"], m.revision) == (12, 8, 4, v.revision) and len(v.revision) == 64
    assert v.revision == content.revision(values(spark).repartition(5)) and corpus.manifest().first().figures["detailed"] == 30 and s.rows == 30


@pytest.mark.parametrize(
    ("v", "s", "why"),
    [
        (dict(n=9), {}, "subjects"),
        (dict(valued=5), {}, "valued"),
        (dict(low_cents="9L"), {}, "fault:prices"),
        (dict(confidence="1.5D"), {}, "fault:confidence"),
        (dict(sample_size="0"), {}, "fault:evidence"),
        (dict(as_of="CAST(NULL AS timestamp)"), {}, "fault:as-of"),
        (dict(status="IF(subject_id = 's3', 'odd', status)"), {}, "coverage"),
        (dict(subject_id="'s'"), {}, "repeated"),
        (dict(subject_id="CAST(NULL AS string)"), {}, "unnamed"),
        (dict(n=0), {}, "empty"),
        ({}, dict(n=24), "sales: sales"),
        ({}, dict(detailed=26), "details"),
        ({}, dict(source_url="'https://sales.example.evil/x'"), "fault:host"),
        ({}, dict(vin="'IOQ'"), "fault:vin"),
        ({}, dict(closed_high_bid_cents="0L"), "fault:price"),
    ],
)
def test_what_is_refused_leaves_the_export_before(spark, tmp_path, v, s, why):
    before = export(spark, tmp_path, values(spark), sales(spark))
    with pytest.raises(ValueError, match=why):
        export(spark, tmp_path, values(spark, **v), sales(spark, **s), "e2")
    for g, staged in zip(stores(spark, tmp_path), before, strict=True):
        assert [m.revision for m in g.manifest().collect()] == [staged.revision]
        assert [p.name for p in (tmp_path / g.root.split("/")[-1] / "rows").iterdir()] == [staged.build]


def test_bids_and_retention_are_refused_before_anything_is_written(spark, tmp_path):
    with pytest.raises(ValueError, match="current_bid_cents"):
        export(spark, tmp_path, values(spark).withColumn("current_bid_cents", F.lit(1)), sales(spark))
    with pytest.raises(ValueError, match="0 days"):
        export(spark, tmp_path, values(spark), sales(spark), days=0)
    assert not list(tmp_path.iterdir())


def test_a_publish_reads_its_source_once(spark, tmp_path):
    spark.range(5_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("x")).write.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    g = Generations(spark, str(tmp_path / "g"))
    rows = spark.read.parquet(str(tmp_path / "in")).mapInPandas(counted, "id string, x long")
    assert g.publish(rows, "g1", AT, figures={"seven": F.count_if(F.col("x") == 6)}) == 5_000 and reads.value == 5_000
    assert g.manifest().first().figures == {"seven": 714}


def test_revision_follows_content_alone(spark):
    r = random.Random(3)
    rows = [(k, r.choice([None, "", "a", "1:a", "é"]), [k, None], None) for k in range(50)]
    kind = "k int, t string, a array<int>, n double"
    df = spark.createDataFrame(rows, kind)
    told = content.revision(df)
    r.shuffle(rows)
    assert told == content.revision(spark.createDataFrame(rows, kind).repartition(3))
    assert told != content.revision(spark.createDataFrame(rows + rows[:1], kind)) != content.revision(spark.createDataFrame(rows[1:], kind))
    swapped = [(1, "ab", [], 1.0)], [(1, "a", [], 1.0)], [(1, None, [], 1.0)], [(1, "", [], 1.0)], [(1, "", None, 1.0)]
    assert len({content.revision(spark.createDataFrame(x, kind)) for x in swapped}) == 5


def test_readers_turn_bad_snapshots_away(spark, tmp_path):
    lots = spark.range(20).select(F.concat(F.lit("lot-"), "id").alias("id"), F.lit("A van").alias("title"), F.lit("active").alias("status"), F.lit(2015).alias("year"), F.lit(10).cast("long").alias("mileage"), F.lit(5).cast("long").alias("current_bid_cents"), F.lit(1).alias("bidder_count"), F.lit(None).cast("string").alias("vin"), F.array(F.lit("https://i/1")).alias("images"), F.lit(True).alias("detail_enriched"))
    g = Generations(spark, str(tmp_path))
    with pytest.raises(ValueError, match="images"):
        g.publish(lots.withColumn("images", F.array(F.lit("ftp://i"))), "g0", AT, figures=exports.lot_figures(), refusals=exports.lot_refusals)
    assert exports.validated(g, lots.schema, F.lit(AT).cast("timestamp"), exports.lot_rules()).count() == 0
    g.publish(lots, "g1", AT, 24 * 60, figures=exports.lot_figures(), refusals=exports.lot_refusals)
    g.publish(lots.limit(12), "g2", "2024-05-01 13:00:00", 24 * 60, figures=exports.lot_figures(), refusals=exports.lot_refusals)

    def why(now):
        told = exports.validated(g, lots.schema, F.lit(now).cast("timestamp"), exports.lot_rules())
        return {r.generation_id: r.reasons for r in told.collect()}

    assert why("2024-05-01 12:56:00") == {"g1": [], "g2": []}
    assert why("2024-05-01 12:54:00") == {"g1": [], "g2": ["future"]}
    assert why("2024-05-02 12:00:00") == {"g1": ["expired"], "g2": []}
    build = g.manifest().filter("generation_id = 'g2'").first().build
    lots.limit(12).withColumn("year", F.lit(1)).write.mode("overwrite").parquet(str(tmp_path / "rows" / build))
    assert why("2024-05-01 13:00:00")["g2"] == ["rows", "revision"]
    lots.limit(5).unionByName(lots.limit(5)).write.mode("overwrite").parquet(str(tmp_path / "rows" / build))
    assert why("2024-05-01 13:00:00")["g2"] == ["count", "repeated", "revision"]


def test_sales_are_not_written_for_valuations_that_are_refused(spark, tmp_path, monkeypatch):
    staged = []
    stage = exports.Generations.stage
    monkeypatch.setattr(exports.Generations, "stage", lambda self, rows, *a, **k: staged.append(self.ids) or stage(self, rows, *a, **k))
    with pytest.raises(ValueError, match="valuations: subjects"):
        export(spark, tmp_path, values(spark, n=9), sales(spark))
    assert staged == [("subject_id",)] and not list((tmp_path / "sales").glob("rows/*"))
