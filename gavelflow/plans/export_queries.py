"""Exports with observed gates as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.plans.bindings import ctes, view
from gavelflow.sources import exports, gates
from gavelflow.sources.generations import Generations
from gavelflow.sources.scratch import scratch_folder

AT, HOST = "1998-06-15 00:00:00", "sales.example"
LOTS = "id string, title string, status string, year int, mileage long, current_bid_cents long, bidder_count long, vin string, images array<string>, detail_enriched boolean"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "deals")
    some = F.coalesce((F.col("low_cents") > 0) & (F.col("valuation_confidence") > 0), F.lit(False))
    price = lambda more: F.when(some, F.col("low_cents") + more)
    return rows.select(
        F.col("id").alias("subject_id"), F.when(some, "available").otherwise("unavailable").alias("status"), price(0).alias("low_cents"), price(100).alias("median_cents"),
        price(200).alias("high_cents"), F.when(some, F.least("valuation_confidence", F.lit(0.9))).alias("confidence"), F.when(some, 3).otherwise(0).alias("sample_size"), _ts(AT).alias("as_of"),
    )


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "comps").groupBy("auction_id").agg(*[F.max(c).alias(c) for c in ("closed_high_bid_cents", "ended_at", "vin", "mileage")])
    return rows.withColumn("source_url", F.concat(F.lit(f"https://{HOST}/"), "auction_id"))


def export_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests say of an export of all valuations and sales, after one that leaves too few valued was refused."""
    folder = scratch_folder(spark, "export")
    stores = Generations(spark, f"{folder}/valuations", ("subject_id",)), Generations(spark, f"{folder}/sales", ("auction_id",))
    valuations, sales = _valuations(spark, sf_dir), _sales(spark, sf_dir)
    exports.export_market(valuations, sales, *stores, "e1", AT, HOST, 365)
    none = valuations.withColumns({"status": F.lit("unavailable"), **{c: F.lit(None).cast("long") for c in ("low_cents", "median_cents", "high_cents")}})
    try:
        exports.export_market(none, sales, *stores, "e2", "1998-06-16 00:00:00", HOST, 365)
    except ValueError:
        told = [g.manifest().select("generation_id", "row_count", "revision", F.col("figures")[name].alias("enough")) for g, name in zip(stores, ("valued", "detailed"), strict=True)]
        return told[0].unionByName(told[1])
    raise AssertionError("e2 should have been refused")


def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all closed sales, some with foreign addresses, no ends or short numbers."""
    k = F.col("mileage") / 4000
    rows = view(spark, sf_dir, "comps").withColumns({
        "source_url": F.concat(F.when(k % 5 == 0, "http").otherwise("https"), F.lit("://"), F.when(k % 7 == 0, "x.").otherwise(""), F.lit(f"{HOST}/"), "auction_id"),
        "ended_at": F.when(k % 11 != 0, F.col("ended_at")), "vin": F.when(k % 13 == 0, F.substring("vin", 1, 16)).otherwise(F.col("vin")),
        "closed_high_bid_cents": F.when(k % 17 != 0, F.col("closed_high_bid_cents")),
    })
    return gates.validate(rows, exports.corpus_rules(HOST)).groupBy("auction_id").agg(F.max(F.array_join("violations", ",")).alias("violations"), F.count(F.lit(1)).alias("rows"))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "board").filter("status = 'active'")
    own = {"title": F.concat(F.lit("Lot "), "id"), "year": F.lit(2015), "mileage": F.col("score").cast("long"), "current_bid_cents": F.coalesce("current_bid_cents", F.lit(0)), "bidder_count": F.lit(1), "vin": F.lit(None), "images": F.array(F.concat(F.lit("https://i/"), "id")), "detail_enriched": F.lit(True)}
    return rows.withColumns(own).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LOTS.split(", ")])


def validate_lot_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why two snapshots of all active lots are turned away, at four times; the second lists
    some lots under a year that can't be, as a writer without gates would."""
    g = Generations(spark, scratch_folder(spark, "snapshot"))
    lots = _lots(spark, sf_dir)
    g.publish(lots, "s1", AT, 24 * 60, figures=exports.lot_figures(), refusals=exports.lot_refusals)
    g.publish(lots.withColumn("year", F.when(F.col("mileage") > 50, 1).otherwise(F.col("year"))), "s2", "1998-06-15 01:00:00", 24 * 60)
    out = None
    for now in ("1998-06-14 23:50:00", "1998-06-15 00:55:00", "1998-06-16 00:00:00", "1998-06-16 01:00:00"):
        told = exports.validated(g, lots.schema, _ts(now), exports.lot_rules()).select("generation_id", F.unix_micros(_ts(now)).alias("read_us"), F.array_join("reasons", ",").alias("reasons"))
        out = told if out is None else out.unionByName(told)
    return out


QUERIES = {f.__name__: f for f in (export_market, corpus_gate, validate_lot_snapshot)}


def _revision(rows: str, columns: list[str]) -> str:
    text = " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in columns)
    words = ", ".join(f"coalesce(sum(('0x' || substr(h, {16 * k + 1}, 15))::BIGINT), 0)::VARCHAR" for k in range(4))
    return f"(SELECT sha256(concat_ws(':', count(*)::VARCHAR, {words})) FROM (SELECT sha256({text}) AS h FROM {rows}))"


K = "(mileage // 4000)"
ORACLE_SQL = {
    "export_market": f"""{ctes('deals', 'comps')}, b AS (SELECT *, coalesce(low_cents > 0 AND valuation_confidence > 0, false) AS ok FROM deals),
        v AS (SELECT id, CASE WHEN ok THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN ok THEN low_cents END AS low, CASE WHEN ok THEN least(valuation_confidence, 0.9::DOUBLE) END AS confidence, CASE WHEN ok THEN 3 ELSE 0 END AS n FROM b),
        s AS (SELECT auction_id, max(closed_high_bid_cents) AS cents, max(ended_at) AS ended_at, max(vin) AS vin, max(mileage) AS mileage FROM comps GROUP BY auction_id)
        SELECT 'e1' AS generation_id, (SELECT count(*) FROM v) AS row_count, (SELECT count(*) FROM v WHERE low IS NOT NULL) AS enough, {_revision('v', ['id', 'status', 'low', 'low + 100', 'low + 200', 'confidence', 'n', f"epoch_us(TIMESTAMP '{AT}')"])} AS revision
        UNION ALL SELECT 'e1', (SELECT count(*) FROM s), (SELECT count(mileage) FROM s), {_revision('s', ['auction_id', 'cents', 'epoch_us(ended_at)', 'vin', 'mileage', f"'https://{HOST}/' || auction_id"])}""",
    "corpus_gate": f"""{ctes('comps')} SELECT auction_id, max(concat_ws(',', CASE WHEN {K} % 17 = 0 OR closed_high_bid_cents <= 0 THEN 'price' END, CASE WHEN {K} % 11 = 0 THEN 'ended-at' END,
            CASE WHEN {K} % 5 = 0 OR {K} % 7 = 0 THEN 'host' END, CASE WHEN {K} % 13 = 0 AND vin IS NOT NULL THEN 'vin' END)) AS violations, count(*) AS rows FROM comps GROUP BY auction_id""",
    "validate_lot_snapshot": f"""{ctes('board')}, t AS (SELECT * FROM (VALUES (TIMESTAMP '1998-06-14 23:50:00'), (TIMESTAMP '1998-06-15 00:55:00'), (TIMESTAMP '1998-06-16 00:00:00'), (TIMESTAMP '1998-06-16 01:00:00')) x(now)),
        g AS (SELECT 's1' AS generation_id, TIMESTAMP '{AT}' AS made, false AS odd UNION ALL SELECT 's2', TIMESTAMP '1998-06-15 01:00:00', (SELECT bool_or(score::BIGINT > 50) FROM board WHERE status = 'active'))
        SELECT generation_id, epoch_us(now) AS read_us, concat_ws(',', CASE WHEN made > now + INTERVAL 5 MINUTE THEN 'future' END, CASE WHEN made + INTERVAL 24 HOUR <= now THEN 'expired' END, CASE WHEN odd THEN 'rows' END) AS reasons FROM g, t""",
}
