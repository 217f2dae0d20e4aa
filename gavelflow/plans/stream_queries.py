"""Streams, generations and payload queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.operators import history, ledger
from gavelflow.plans.bindings import ctes, view
from gavelflow.sources import payloads
from gavelflow.sources.generations import Generations, lookup
from gavelflow.sources.scratch import scratch_folder
from gavelflow.streaming import bids


#: Files at least, and rows of a file.
FILES, FILE_ROWS = 8, 1_000_000


def _landed(rows: DataFrame, root: str, at: str = "observed_at") -> str:
    """The rows as files of bounded size by ranges of time, written at once and dated so that a
    stream takes them in order; the third lands again after the others, as a replay of late rows."""
    place, spark = f"{root}/landed", rows.sparkSession
    # Written first: counting them and dealing them by ranges would each work them out again.
    rows.write.parquet(f"{root}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    rows.repartitionByRange(max(FILES, -(-rows.count() // FILE_ROWS)), at).write.parquet(place)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(place)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    first = jvm.System.currentTimeMillis() - 1000 * len(files)
    for k, file in enumerate(files):
        fs.setTimes(file, first + 1000 * k, -1)
    if len(files) > 2:
        spark.read.schema(rows.schema).parquet(files[2].toString()).coalesce(1).write.mode("append").parquet(place)
    return place


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's table, in FILES micro-batches or so, the last one with replays."""
    root = scratch_folder(spark, "bids")
    events = view(spark, sf_dir, "bid_observations").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in bids.EVENTS.split(", ")])
    place = _landed(events, root)
    bids.run_to_table(bids.stream_change_points(bids.read_events(spark, place, _trigger_files(spark, place)), "400 days"), f"{root}/changes", f"{root}/checkpoint")
    return spark.read.schema(bids.CHANGES).parquet(f"{root}/changes")


def _trigger_files(spark: SparkSession, place: str) -> int:
    """Files of a micro-batch, so that there are no more than FILES and one of them: each reads the state."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return max(1, (sum(f.getPath().getName().startswith("part-") for f in found) - 1) // FILES)


def _live(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    place = _landed(rows, root, "last_checked_at")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _trigger_files(spark, place)).parquet(place)


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    auctions, vehicles = view(spark, sf_dir, "live_auctions"), view(spark, sf_dir, "order_vehicles")
    old = ledger.closed_rows(auctions.filter("auction_id % 4 = 0"), vehicles, F.col("ends_at"), F.col("ends_at")).withColumn("award_status", F.lit("confirmed"))
    root = scratch_folder(spark, "ledger")
    out = bids.stream_ledger(_live(spark, view(spark, sf_dir, "live_checks"), root), auctions, vehicles, old, root)
    return out.select("external_id", "closed_high_bid_cents", "award_status", F.unix_micros("outcome_observed_at").alias("observed_us"))


def stream_reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavelflow.plans import live_queries as Q

    board = Q._identified(view(spark, sf_dir, "open_lots").drop("n")).withColumn("last_checked_at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    live = view(spark, sf_dir, "bid_observations").select(F.col("auction_id").cast("string").alias("id"), F.col("bid_cents").alias("current_bid_cents"), F.col("bidders").alias("bidder_count"), "status", "ends_at", F.col("observed_at").alias("last_checked_at"))
    root = scratch_folder(spark, "reprice")
    bids.stream_reprice(_live(spark, live, root), board, Q._evidence(spark, sf_dir)[0], F.lit("2024-01-31 00:00:00").cast("timestamp"), root)
    rows = spark.read.parquet(f"{root}/assessed")
    return history.last_write_wins(rows, ["id"], [F.desc("batch")]).select("id", "lot_status", "current_bid_cents", "forecast_expected", "status", "score", "tier")


def stream_close_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases that auctions enter by the clock; those without an end are left out."""
    root = scratch_folder(spark, "timers")
    events = view(spark, sf_dir, "bid_observations").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in bids.EVENTS.split(", ")])
    # Files land in order of time, so nothing but the replay is late.
    place = _landed(events, root)
    timed = bids.stream_close_timers(bids.read_events(spark, place, _trigger_files(spark, place)))
    bids.run_to_table(timed, f"{root}/phases", f"{root}/checkpoint")
    return spark.read.schema(bids.TIMED).parquet(f"{root}/phases").select("auction_id", "phase", F.unix_micros("at").alias("at_us"))


def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "comp_updates")
    old = history.last_write_wins(rows.filter("observed_at < TIMESTAMP '1998-01-01 00:00:00'"), ["source_key", "external_id"], [F.desc("observed_at"), F.desc("closed_high_bid_cents"), F.desc("part_id"), F.desc("supplier_id")])
    cursor = spark.range(1).select(F.lit("1997-12-20 00:00:00").cast("timestamp").alias("covered_through"))
    out = ledger.incremental_sync(old, rows, cursor, F.lit("1999-01-01 00:00:00").cast("timestamp"), ties=["closed_high_bid_cents", "part_id", "supplier_id"])
    return out.select("external_id", "closed_high_bid_cents", "part_id")


def stream_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("event_id", "auction_id", "bid_cents", "status")


def stream_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("auction_id").agg(F.max("extension_count").alias("extensions"), F.unix_micros(F.max("effective_ends_at")).alias("ends_us"))


def assemble_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pages = rows.select(F.col("l_suppkey").alias("snapshot_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("pos"), (F.lit(500) + (F.col("l_suppkey") % 3 == 0).cast("int") * (F.col("l_linenumber") % 2)).alias("total"), F.col("l_partkey").alias("id"), "l_extendedprice")
    pages = pages.groupBy("snapshot_id", "page", "pos", "id").agg(F.max("total").alias("total"), F.max("l_extendedprice").alias("price"))
    return payloads.assemble_catalog(pages).select("snapshot_id", "id", "price", "complete")


def pick_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "board").select("id", "source", "status")
    health = rows.groupBy("source").agg(F.lit(True).alias("complete"), F.lit("1998-06-15 00:00:00").cast("timestamp").alias("observed_at"))
    health = health.withColumn("complete", F.col("source") != "lots")
    return payloads.pick_source(rows, health, F.lit("1998-06-15 06:00:00").cast("timestamp"), ["lots", "fleet"])


def durable_or_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By state: usable sales before June 1998 as the durable ones, later ones as the recent window."""
    rows = view(spark, sf_dir, "comps").select("auction_id", "state", "ended_at", "condition")
    june = F.lit("1998-06-01 00:00:00").cast("timestamp")
    recent = rows.filter(F.col("ended_at") >= june).drop("ended_at", "condition")
    durable = rows.filter((F.col("ended_at") < june) & (F.col("condition") == "usable")).drop("ended_at", "condition")
    advertised = recent.groupBy("state").agg((F.count(F.lit(1)) + F.when(F.col("state") < "F", 1).otherwise(0)).alias("advertised"))
    return payloads.durable_or_recent(durable, view(spark, sf_dir, "state_checks"), recent, advertised, "state")


def max_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = history.extension_count(view(spark, sf_dir, "bid_observations"))
    return history.max_extension(view(spark, sf_dir, "live_auctions").select("auction_id"), counted)


def lookup_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lot of a published board by its id, one by its external id, and one that isn't there."""
    g = Generations(spark, scratch_folder(spark, "board"))
    board = view(spark, sf_dir, "board").select("id", F.col("vin").alias("external_id"), "status", "score").filter("external_id IS NOT NULL")
    g.publish(board, "g1", "1998-06-15 00:00:00")
    rows = g.read(board.schema, F.lit("1998-06-15 00:30:00").cast("timestamp"))
    found = [lookup(rows, ident) for ident in ("lot-7", "00000000000000032", "lot-nothing")]
    return found[0].unionByName(found[1]).unionByName(found[2]).drop("stale")


def publish_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations, three builds that are refused (repeated ids, no rows, a taken id), and
    what is read before and after the newest expires."""
    g = Generations(spark, scratch_folder(spark, "board"))
    board = view(spark, sf_dir, "board").select("id", "status", "score")
    g.publish(board.filter("score > 90"), "g1", "1998-06-15 00:00:00")
    g.publish(board, "g2", "1998-06-15 01:00:00")
    for broken, ident in ((board.unionByName(board), "g3"), (board.filter("false"), "g4"), (board.filter("score < 5"), "g2")):
        try:
            g.publish(broken, ident, "1998-06-15 01:30:00")
        except ValueError:
            continue
        raise AssertionError(f"{ident} should have been refused")
    at = lambda t: g.read(board.schema, F.lit(t).cast("timestamp")).withColumn("read_us", F.unix_micros(F.lit(t).cast("timestamp")))
    return at("1998-06-15 02:00:00").unionByName(at("1998-06-15 02:10:00"))


def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed awards of one source, high bids of the other, each with its own price basis."""
    rows = view(spark, sf_dir, "comps")
    award = (F.col("operability") == "runs") & (F.col("condition") == "usable")
    bid = (F.col("operability") != "runs") & (F.col("closed_high_bid_cents") > 5_000_000)
    return rows.filter(award | bid).select("auction_id", F.when(award, "award").otherwise("high-bid").alias("basis"), "closed_high_bid_cents")


QUERIES = {f.__name__: f for f in (stream_change_points, stream_extensions, stream_ledger, stream_reprice, stream_close_timers, incremental_sync, assemble_catalog, pick_source, durable_or_recent, max_extension, lookup_opportunity, publish_and_read, ledger_view)}

ORDER = "OVER (PARTITION BY auction_id ORDER BY observed_at, event_id)"
ORACLE_SQL = {
    "stream_change_points": f"""{ctes('bid_observations')} SELECT event_id, auction_id, bid_cents, status FROM bid_observations
        QUALIFY lag(1) {ORDER} IS NULL OR bid_cents IS DISTINCT FROM lag(bid_cents) {ORDER} OR bidders IS DISTINCT FROM lag(bidders) {ORDER} OR status IS DISTINCT FROM lag(status) {ORDER} OR ends_at IS DISTINCT FROM lag(ends_at) {ORDER}""",
    "stream_extensions": f"""{ctes('bid_observations')}, m AS (SELECT *, coalesce((ends_at > lag(ends_at) {ORDER})::INT, 0) AS moved FROM bid_observations)
        SELECT auction_id, sum(moved)::INT AS extensions, epoch_us(max(ends_at)) AS ends_us FROM m GROUP BY auction_id""",
    "stream_ledger": f"""{ctes('live_auctions', 'live_checks', 'order_vehicles')},
        d AS (SELECT * FROM live_checks QUALIFY row_number() OVER (PARTITION BY auction_id, last_checked_at ORDER BY current_bid_cents DESC NULLS LAST, status, ends_at DESC) = 1),
        n AS (SELECT a.external_id, CASE WHEN d.last_checked_at > a.last_checked_at THEN d.current_bid_cents ELSE a.current_bid_cents END AS closed_high_bid_cents, 'unknown' AS award_status, epoch_us(d.last_checked_at) AS observed_us
            FROM d JOIN live_auctions a USING (auction_id) JOIN order_vehicles USING (auction_id)
            WHERE d.status = 'ended' AND d.current_bid_cents IS NOT NULL AND CASE WHEN d.last_checked_at > a.last_checked_at THEN true ELSE d.last_checked_at = a.last_checked_at AND a.status = 'sold' AND a.current_bid_cents IS NOT NULL END QUALIFY row_number() OVER (PARTITION BY a.external_id ORDER BY d.last_checked_at DESC) = 1),
        o AS (SELECT external_id, current_bid_cents AS closed_high_bid_cents, 'confirmed' AS award_status, epoch_us(ends_at) AS observed_us FROM live_auctions JOIN order_vehicles USING (auction_id) WHERE auction_id % 4 = 0 AND current_bid_cents IS NOT NULL),
        k AS (SELECT external_id FROM live_auctions JOIN order_vehicles USING (auction_id))
        SELECT * FROM n UNION ALL SELECT * FROM o WHERE external_id NOT IN (SELECT external_id FROM n)""",
    "incremental_sync": f"""{ctes('comp_updates')}, o AS (SELECT * FROM comp_updates WHERE observed_at < TIMESTAMP '1998-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY observed_at DESC, closed_high_bid_cents DESC, part_id DESC, supplier_id DESC) = 1),
        n AS (SELECT * FROM comp_updates WHERE ended_at >= TIMESTAMP '1997-12-18 00:00:00' AND ended_at < TIMESTAMP '1999-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY observed_at DESC, closed_high_bid_cents DESC, part_id DESC, supplier_id DESC) = 1)
        SELECT coalesce(n.external_id, o.external_id) AS external_id, CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.closed_high_bid_cents ELSE o.closed_high_bid_cents END AS closed_high_bid_cents,
            CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.part_id ELSE o.part_id END AS part_id FROM o FULL JOIN n ON o.external_id = n.external_id""",
    "assemble_catalog": """WITH p AS (SELECT l_suppkey AS snapshot_id, l_linenumber AS page, l_orderkey AS pos, l_partkey AS id, max(500 + (l_suppkey % 3 = 0)::INT * (l_linenumber % 2)) AS total, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
        t AS (SELECT snapshot_id, count(DISTINCT total) = 1 AND max(total) = count(DISTINCT id) AS complete FROM p GROUP BY snapshot_id)
        SELECT snapshot_id, id, price, complete FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY snapshot_id, id ORDER BY page DESC, pos DESC) = 1) JOIN t USING (snapshot_id)""",
    "pick_source": f"""{ctes('board')}, h AS (SELECT source, source <> 'lots' AS complete, TIMESTAMP '1998-06-15 00:00:00' AS observed_at, count(*) AS n FROM board GROUP BY source),
        g AS (SELECT source FROM h WHERE complete AND n >= 1 AND epoch_us(TIMESTAMP '1998-06-15 06:00:00') - epoch_us(observed_at) BETWEEN 0 AND 24 * 3600000000 AND source IN ('lots', 'fleet') ORDER BY list_position(['lots', 'fleet'], source) LIMIT 1)
        SELECT id, source, status FROM board WHERE source IN (SELECT source FROM g)""",
    "durable_or_recent": f"""{ctes('comps', 'state_checks')}, d AS (SELECT auction_id, state FROM comps WHERE ended_at < TIMESTAMP '1998-06-01 00:00:00' AND condition = 'usable'), r AS (SELECT auction_id, state FROM comps WHERE ended_at >= TIMESTAMP '1998-06-01 00:00:00'),
        firm AS (SELECT state FROM d GROUP BY state HAVING count(*) >= 100 AND state IN (SELECT state FROM state_checks WHERE success = 1 AND coverage = 'complete'))
        SELECT auction_id, state, 'durable' AS mode FROM d WHERE state IN (SELECT state FROM firm) UNION ALL SELECT auction_id, state, 'recent' FROM r WHERE state >= 'F' AND state NOT IN (SELECT state FROM firm)""",
    "max_extension": f"""{ctes('live_auctions', 'bid_observations')}, m AS (SELECT auction_id, coalesce((ends_at > lag(ends_at) {ORDER})::INT, 0) AS moved FROM bid_observations), x AS (SELECT auction_id, sum(moved) AS extensions FROM m GROUP BY auction_id)
        SELECT a.auction_id, coalesce(extensions, 0)::BIGINT AS extensions FROM live_auctions a LEFT JOIN x ON x.auction_id = a.auction_id""",
    "lookup_opportunity": f"{ctes('board')} SELECT id, vin AS external_id, status, score FROM board WHERE vin IS NOT NULL AND (id = 'lot-7' OR vin = '00000000000000032')",
    "publish_and_read": f"""{ctes('board')} SELECT id, status, score, TIMESTAMP '1998-06-15 01:00:00' + INTERVAL 70 MINUTE <= t AS stale, epoch_us(t) AS read_us
        FROM board, (VALUES (TIMESTAMP '1998-06-15 02:00:00'), (TIMESTAMP '1998-06-15 02:10:00')) v(t)""",
    "ledger_view": f"""{ctes('comps')} SELECT auction_id, CASE WHEN operability = 'runs' AND condition = 'usable' THEN 'award' ELSE 'high-bid' END AS basis, closed_high_bid_cents FROM comps
        WHERE (operability = 'runs' AND condition = 'usable') OR (operability <> 'runs' AND closed_high_bid_cents > 5000000)""",
}
