"""Board and ledger queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.functions import cadence
from gavelflow.operators import board as B
from gavelflow.operators import history, ledger
from gavelflow.plans.bindings import AUCTION_NOW, STREAM_NOW, ctes, view
from gavelflow.sources.monthly import MonthlyLedger
from gavelflow.sources.scratch import scratch_folder

SPLIT = "1998-06-01 00:00:00"
#: Middle of the events.
EVENT_NOW = "2024-01-15 12:00:00"


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "board")


def _category() -> Column:
    return B.board_category(truck_body=r"(?i)\b(?:MACHINERY|FURNITURE)\b", truck_model=r"(?i)\b1-URGENT\b", car=r"(?i)\bAUTOMOBILE\b")


def board_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.board_query(_board(spark, sf_dir), _ts(AUCTION_NOW), text="nation_1", condition="good", max_bid_cents=4_000_000, quick="trucks", category=_category())
    return found.select("id", "status", "current_bid_cents", B.normalize_state(F.col("state")).alias("state"), _category().alias("category"))


def board_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = _board(spark, sf_dir).filter("score > 50").select("id")
    closing = B.board_query(_board(spark, sf_dir), _ts(AUCTION_NOW), quick="closing").select("id", F.lit("closing").alias("by"))
    coming = B.board_query(_board(spark, sf_dir), _ts(AUCTION_NOW), quick="coming", state="TX").select("id", F.lit("coming").alias("by"))
    kept = B.board_query(_board(spark, sf_dir), _ts(AUCTION_NOW), quick="saved", saved=saved).select("id", F.lit("saved").alias("by"))
    return closing.unionByName(coming).unionByName(kept)


def best_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_deals(_board(spark, sf_dir), 100).select("id", "score", "confidence", "projected_profit_cents")


def board_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [B.board_sort(_board(spark, sf_dir), key).select("id", F.lit(key).alias("by")) for key in ("ending", "confidence", "profit", "bid")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.state_facets(_board(spark, sf_dir))


def board_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.board_kpis(_board(spark, sf_dir), _ts(AUCTION_NOW))


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.source_coverage(_board(spark, sf_dir), _ts(AUCTION_NOW))


def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.retained_rows(_board(spark, sf_dir), _ts(AUCTION_NOW)).select("id", "status")


def _feed(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Two overlapping feeds of the board: their check times, images and valuations differ by lot."""
    n = F.substring("id", 5, 20).cast("long")
    rows = _board(spark, sf_dir).withColumn("n", n).filter(F.col("n") % 4 != 1 + 2 * shift)
    # Whole hours, so that ties are common.
    checked = F.timestamp_micros(F.unix_micros("starts_at") + (F.col("n") * (3 + shift) % 5) * 3_600_000_000)
    valued_at = F.timestamp_micros(F.unix_micros("starts_at") + (F.col("n") * (2 + 3 * shift) % 7) * 86_400_000_000)
    value = F.struct(
        F.when(F.col("n") % (5 + shift) == 0, "unavailable").otherwise("provider").alias("status"), (F.col("n") + shift).alias("low_cents"), F.col("median_cents"), (F.col("n") * 3 + shift).alias("high_cents"),
        valued_at.alias("as_of"), F.lit(0.5).alias("confidence"), F.lit(5).alias("sample_size"),
    )
    images = F.transform(F.sequence(F.lit(0), (F.col("n") * (2 + shift) % 3).cast("int")), lambda k: F.concat(F.lit("img-"), k.cast("string")))
    forecast = F.when(F.col("n") % (3 + shift) == 0, "insufficient").otherwise("available")
    return rows.select("id", "source", checked.alias("last_checked_at"), images.alias("images"), forecast.alias("forecast_status"), F.lit(shift).alias("side"), value.alias("valuation"))


def _merged(df: DataFrame) -> DataFrame:
    return df.select("id", "side", F.col("valuation.low_cents").alias("low_cents"), "reprice")


def merge_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(B.merge_feeds(_feed(spark, sf_dir, 0), _feed(spark, sf_dir, 1)))


def merge_authoritative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(B.merge_authoritative(_feed(spark, sf_dir, 0), _feed(spark, sf_dir, 1).filter("source = 'lots'"), ["lots"]))


def _updates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "comp_updates")
    order = [F.desc("observed_at"), F.desc("closed_high_bid_cents"), F.desc("part_id"), F.desc("supplier_id")]
    before, after = rows.filter(F.col("observed_at") < _ts(SPLIT)), rows.filter((F.col("observed_at") >= _ts(SPLIT)) | (F.col("part_id") % 10 == 0))
    return tuple(history.last_write_wins(x, ["source_key", "external_id"], order) for x in (before, after))


def upsert_comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.upsert_comparables(*_updates(spark, sf_dir)).select("external_id", "closed_high_bid_cents", "mileage", "vin", "part_id")


def monthly_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upsert_comparables() into a ledger by month of end, read back."""
    old, new = _updates(spark, sf_dir)
    months = MonthlyLedger(spark, scratch_folder(spark, "monthly"), old.schema, ["source_key", "external_id"])
    for part in (old, new):
        months.merge(part, ledger.upsert_comparables)
    return months.months().select("external_id", "closed_high_bid_cents", "mileage", "vin", "part_id", "month")


def merge_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merge_corpus(*_updates(spark, sf_dir), _ts("2001-12-01 00:00:00"), 1500).select("external_id", "closed_high_bid_cents")


def _auction_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "auctions")
    cols = ["source_key", "external_id", "title", "status", "current_bid_cents", "bidder_count", "ends_at", "image_url", "last_checked_at", "price_changed_at"]
    old = rows.filter("n % 3 <> 0").select("source_key", "external_id", F.col("segment").alias("title"), "status", "current_bid_cents", F.col("bidder_count").cast("int").alias("bidder_count"), "ends_at", F.lit("old.jpg").alias("image_url"), F.col("starts_at").alias("last_checked_at"), F.col("starts_at").alias("price_changed_at"))
    shift = F.timestamp_micros(F.unix_micros("starts_at") + (F.col("n") % 5 - 2) * 86_400_000_000)
    new = rows.filter("n % 4 <> 0").select(
        "source_key", "external_id", F.col("priority").alias("title"), F.lit("closing").alias("status"), F.when(F.col("n") % 2 == 0, F.col("current_bid_cents")).otherwise(F.col("current_bid_cents") + 5).alias("current_bid_cents"),
        F.col("bidder_count").cast("int").alias("bidder_count"), "ends_at", F.when(F.col("n") % 7 == 0, "new.jpg").alias("image_url"), shift.alias("last_checked_at"), shift.alias("price_changed_at"),
    )
    return old.select(*cols), new.select(*cols)


def upsert_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.upsert_auctions(*_auction_sides(spark, sf_dir))
    return out.select("external_id", "title", "status", "current_bid_cents", "image_url", F.unix_micros("last_checked_at").alias("checked_us"), F.unix_micros("price_changed_at").alias("changed_us"))


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.archive_missing(view(spark, sf_dir, "seen_auctions"), view(spark, sf_dir, "checks"), _ts(EVENT_NOW), "lots")


def archive_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(spark, sf_dir).select("external_id", "source_key", "status", "final_bid_cents", F.unix_micros("ended_at").alias("ended_us"), "final_status")


def close_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vehicles = _archived(spark, sf_dir), view(spark, sf_dir, "vehicles").drop("condition", "updated_at").filter("auction_id % 3 <> 0")
    start = ledger.closed_rows(view(spark, sf_dir, "seen_auctions").filter("auction_id % 5 = 0"), vehicles, F.col("ends_at"), F.col("ends_at")).withColumn("outcome_status", F.lit("known"))
    return ledger.close_out(start, rows, vehicles, _ts(EVENT_NOW), "lots").select("external_id", "closed_high_bid_cents", "outcome_status", "vin")


def close_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cadence.close_bucket(view(spark, sf_dir, "seen_auctions"), _ts(EVENT_NOW))
    return out.select("external_id", "bucket", "interval_seconds", F.unix_micros("due_at").alias("due_us"), "should_refresh")


def sync_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "seen_auctions").select("external_id", F.col("last_checked_at").alias("covered_through"))
    out = cadence.sync_window(rows, _ts(EVENT_NOW), most_days=5)
    return out.select("external_id", "mode", F.unix_micros("from_at").alias("from_us"), F.unix_micros("to_at").alias("to_us"))


def closing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.closing_candidates(view(spark, sf_dir, "seen_auctions"), _ts(EVENT_NOW)).select("external_id")


def backfill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.backfill_windows(view(spark, sf_dir, "comp_updates"), "1999-01-01 00:00:00")
    return out.select("step", F.unix_micros("from_at").alias("from_us"), "rows")


def counts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts_by(_board(spark, sf_dir), "condition", ["good", "fair", "new", "scrap"])


def ledger_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "comps").orderBy(F.desc("ended_at"), "auction_id").limit(100).select("auction_id", "closed_high_bid_cents")


def terminal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.terminal_gate(_updates(spark, sf_dir)[1], _ts("1995-01-01 00:00:00"), _ts("2001-12-31 00:00:00"))


QUERIES = {
    f.__name__: f
    for f in (
        board_query, board_closing, best_deals, board_sort, state_facets, board_kpis, source_coverage, retained_rows, merge_feeds, merge_authoritative, upsert_comparables, monthly_merge, merge_corpus,
        upsert_auctions, archive_missing, close_out, close_bucket, sync_window, closing_candidates, backfill_windows, counts_by, ledger_recent, terminal_gate,
    )
}

NOW, ENOW = f"TIMESTAMP '{AUCTION_NOW}'", f"TIMESTAMP '{EVENT_NOW}'"
STATE = "CASE WHEN trim(state) = '' OR trim(state) = '—' OR lower(trim(state)) = 'unknown' THEN NULL WHEN length(trim(state)) = 2 THEN upper(trim(state)) ELSE trim(state) END"
CATEGORY = r"""CASE WHEN regexp_matches(body_style, '\b(?:MACHINERY|FURNITURE)\b') OR regexp_matches(title, '\b1-URGENT\b') OR regexp_matches(model, '\b1-URGENT\b') THEN 'trucks'
    WHEN regexp_matches(body_style, '\bAUTOMOBILE\b') THEN 'cars' ELSE 'other' END"""
SOON = f"coalesce(ends_at >= {NOW} AND ends_at <= {NOW} + INTERVAL 30 MINUTE, false)"


def _feed_sql(shift: int) -> str:
    return f"""SELECT id, source, starts_at + (n * {3 + shift} % 5) * INTERVAL 1 HOUR AS checked, 1 + n * {2 + shift} % 3 AS images, n % {3 + shift} = 0 AS poor, {shift} AS side,
        n % {5 + shift} <> 0 AND median_cents IS NOT NULL AS ok, n + {shift} AS low_cents, starts_at + (n * {2 + 3 * shift} % 7) * INTERVAL 1 DAY AS as_of
        FROM (SELECT *, CAST(substring(id, 5) AS BIGINT) AS n FROM board) WHERE n % 4 <> {1 + 2 * shift}"""


def _merge_sql(where: str, tail: str) -> str:
    return f"""{ctes('board')}, a AS ({_feed_sql(0)}), b AS (SELECT * FROM ({_feed_sql(1)}) {where}),
        j AS (SELECT b.*, a.id IS NOT NULL AS known, a.low_cents AS old_low, a.ok AS old_ok, a.as_of AS old_at, a.poor AS old_poor,
            a.id IS NULL OR b.checked > a.checked OR (b.checked = a.checked AND b.images >= a.images) AS take_new FROM b LEFT JOIN a USING (id)),
        v AS (SELECT *, CASE WHEN NOT known THEN true WHEN old_ok <> ok THEN ok WHEN NOT old_ok THEN take_new WHEN old_at <> as_of THEN as_of > old_at ELSE take_new END AS value_new FROM j)
        SELECT id, CASE WHEN take_new THEN 1 ELSE 0 END AS side, CASE WHEN value_new THEN low_cents ELSE old_low END AS low_cents,
            known AND (take_new <> value_new OR (CASE WHEN value_new THEN ok ELSE old_ok END AND CASE WHEN take_new THEN poor ELSE old_poor END)) AS reprice FROM v {tail}"""


ARCHIVED = f"""{ctes('checks', 'seen_auctions', 'vehicles')}, p AS (SELECT max(checked_at) AS prev FROM checks WHERE success = 1 AND coverage = 'complete' AND checked_at < {ENOW}),
        g AS (SELECT s.*, source_key = 'lots' AND status IN ('active', 'preview', 'closing') AND coalesce(last_seen_at < prev, false) AS gone FROM seen_auctions s, p)"""


UPDATES = f"""{ctes('comp_updates')},
    old AS (SELECT * FROM comp_updates WHERE observed_at < TIMESTAMP '{SPLIT}' QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY observed_at DESC, closed_high_bid_cents DESC, part_id DESC, supplier_id DESC) = 1),
    new AS (SELECT * FROM comp_updates WHERE observed_at >= TIMESTAMP '{SPLIT}' OR part_id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY observed_at DESC, closed_high_bid_cents DESC, part_id DESC, supplier_id DESC) = 1)"""

ORACLE_SQL = {
    "board_query": f"""{ctes('board')}, b AS (SELECT *, {CATEGORY} AS category FROM board)
        SELECT id, status, current_bid_cents, {STATE} AS state, category FROM b
        WHERE contains(lower(concat_ws(' ', title, coalesce(vin, ''), city, state, body_style)), 'nation_1') AND condition = 'good' AND current_bid_cents <= 4000000 AND status = 'active' AND category = 'trucks'""",
    "board_closing": f"""{ctes('board')} SELECT id, 'closing' AS by FROM board WHERE status = 'active' AND {SOON}
        UNION ALL SELECT id, 'coming' FROM board WHERE status = 'preview' AND {STATE} = 'TX' UNION ALL SELECT id, 'saved' FROM board WHERE status = 'active' AND score > 50""",
    "best_deals": f"""{ctes('board')} SELECT id, score, confidence, projected_profit_cents FROM board
        ORDER BY score DESC, confidence DESC, projected_profit_cents DESC NULLS LAST, coalesce(ends_at, starts_at) NULLS LAST, id LIMIT 100""",
    "board_sort": f"""{ctes('board')} SELECT id, 'ending' AS by FROM (SELECT id FROM board ORDER BY coalesce(starts_at, ends_at) NULLS LAST, id LIMIT 48)
        UNION ALL SELECT id, 'confidence' FROM (SELECT id FROM board ORDER BY confidence DESC, score DESC, id LIMIT 48)
        UNION ALL SELECT id, 'profit' FROM (SELECT id FROM board ORDER BY projected_profit_cents DESC NULLS LAST, id LIMIT 48)
        UNION ALL SELECT id, 'bid' FROM (SELECT id FROM board ORDER BY current_bid_cents NULLS LAST, id LIMIT 48)""",
    "state_facets": f"""{ctes('board')}, b AS (SELECT {STATE} AS state FROM board WHERE status IN ('active', 'closing', 'preview')) SELECT state, count(*) AS lots FROM b WHERE state IS NOT NULL GROUP BY state""",
    "board_kpis": f"""{ctes('board')}, d AS (SELECT list_sort(list(discount_to_value)) AS l FROM board WHERE discount_to_value IS NOT NULL)
        SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'preview') AS coming, count(*) FILTER ({SOON}) AS closing, sum(greatest(projected_profit_cents, 0)) FILTER (projected_profit_cents IS NOT NULL) AS headroom_cents,
            count(*) FILTER (valuation_status <> 'unavailable' AND median_cents IS NOT NULL) AS valued, count(DISTINCT condition) AS conditions, (SELECT l[len(l) // 2 + 1] FROM d) AS median_discount FROM board""",
    "source_coverage": f"""{ctes('board')} SELECT source, count(*) AS lots, count(*) FILTER (status = 'active' AND ends_at > {NOW}) AS active, count(*) FILTER (status = 'preview') AS coming, count(*) FILTER (status = 'ended') AS ended, count(current_bid_cents) AS with_bid FROM board GROUP BY source""",
    "retained_rows": f"""{ctes('board')} SELECT id, status FROM board WHERE last_checked_at <= {NOW} AND last_checked_at >= {NOW} - INTERVAL 24 HOUR AND (status = 'preview' OR (status = 'active' AND ends_at > {NOW}))""",
    "merge_feeds": _merge_sql("", ""),
    "merge_authoritative": _merge_sql("WHERE source = 'lots'", "UNION ALL SELECT id, side, low_cents, false FROM a WHERE source <> 'lots' AND id NOT IN (SELECT id FROM b)"),
    "upsert_comparables": f"""{UPDATES} SELECT coalesce(n.external_id, o.external_id) AS external_id,
        CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.closed_high_bid_cents ELSE o.closed_high_bid_cents END AS closed_high_bid_cents,
        CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.mileage ELSE o.mileage END AS mileage, coalesce(n.vin, o.vin) AS vin,
        CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.part_id ELSE o.part_id END AS part_id FROM old o FULL JOIN new n ON o.external_id = n.external_id""",
    "monthly_merge": f"""{UPDATES} SELECT coalesce(n.external_id, o.external_id) AS external_id,
        CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.closed_high_bid_cents ELSE o.closed_high_bid_cents END AS closed_high_bid_cents,
        CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.mileage ELSE o.mileage END AS mileage, coalesce(n.vin, o.vin) AS vin,
        CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.part_id ELSE o.part_id END AS part_id,
        strftime(CASE WHEN o.external_id IS NULL OR n.observed_at >= o.observed_at THEN n.ended_at ELSE o.ended_at END, '%Y-%m') AS month FROM old o FULL JOIN new n ON o.external_id = n.external_id""",
    "merge_corpus": f"""{UPDATES}, u AS (SELECT external_id, closed_high_bid_cents, ended_at FROM new UNION ALL SELECT external_id, closed_high_bid_cents, ended_at FROM old WHERE external_id NOT IN (SELECT external_id FROM new))
        SELECT external_id, closed_high_bid_cents FROM u WHERE ended_at >= TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 1500 DAY""",
    "upsert_auctions": f"""{ctes('auctions')},
        o AS (SELECT external_id, segment AS title, status, current_bid_cents AS bid, bidder_count AS bidders, 'old.jpg' AS image, starts_at AS checked, starts_at AS changed FROM auctions WHERE n % 3 <> 0),
        i AS (SELECT external_id, priority AS title, 'closing' AS status, CASE WHEN n % 2 = 0 THEN current_bid_cents ELSE current_bid_cents + 5 END AS bid, bidder_count AS bidders, CASE WHEN n % 7 = 0 THEN 'new.jpg' END AS image, starts_at + (n % 5 - 2) * INTERVAL 1 DAY AS checked FROM auctions WHERE n % 4 <> 0),
        j AS (SELECT coalesce(i.external_id, o.external_id) AS external_id, i.external_id IS NULL AS gone, o.external_id IS NULL AS fresh, coalesce(i.checked >= o.checked, false) AS newer,
            i.title AS it, o.title AS ot, i.status AS s, o.status AS os, i.bid AS ib, o.bid AS ob, i.bidders AS ibs, o.bidders AS obs, i.image AS ii, o.image AS oi, i.checked AS ic, o.checked AS oc, o.changed AS och FROM o FULL JOIN i ON o.external_id = i.external_id)
        SELECT external_id, CASE WHEN gone THEN ot ELSE it END AS title, CASE WHEN fresh OR newer THEN s ELSE os END AS status, CASE WHEN fresh OR newer THEN ib ELSE ob END AS current_bid_cents, coalesce(ii, oi) AS image_url,
            epoch_us(CASE WHEN fresh OR newer THEN ic ELSE oc END) AS checked_us, epoch_us(CASE WHEN fresh OR (newer AND (ib IS DISTINCT FROM ob OR ibs IS DISTINCT FROM obs)) THEN ic ELSE och END) AS changed_us FROM j""",
    "archive_missing": f"""{ARCHIVED} SELECT external_id, source_key, CASE WHEN gone THEN 'ended' ELSE status END AS status, CASE WHEN gone THEN current_bid_cents END AS final_bid_cents,
        CASE WHEN gone THEN epoch_us({ENOW}) END AS ended_us, CASE WHEN gone THEN 'closed-high-bid-unverified' END AS final_status FROM g""",
    "close_out": f"""{ARCHIVED}, c AS (SELECT external_id, current_bid_cents AS closed_high_bid_cents, CASE WHEN current_bid_cents > 0 THEN 'closed-high-bid' WHEN current_bid_cents = 0 AND bidder_count = 0 THEN 'no-bid' ELSE 'closed-outcome-unknown' END AS outcome_status,
            vin, gone, auction_id FROM g JOIN vehicles USING (auction_id) WHERE auction_id % 3 <> 0 AND current_bid_cents IS NOT NULL)
        SELECT external_id, closed_high_bid_cents, 'known' AS outcome_status, vin FROM c WHERE auction_id % 5 = 0 UNION ALL SELECT external_id, closed_high_bid_cents, outcome_status, vin FROM c WHERE gone AND auction_id % 5 <> 0""",
    "close_bucket": f"""{ctes('seen_auctions')},
        a AS (SELECT external_id, status, epoch_us({ENOW}) AS t, epoch_us(ends_at) AS e, epoch_us(last_checked_at) AS l FROM seen_auctions),
        b AS (SELECT *, CASE WHEN status IN {cadence.TERMINAL} THEN 'stopped' WHEN e - t > 1800000000 THEN 'normal' WHEN e - t > 300000000 THEN 'last-30-minutes' WHEN e - t > 60000000 THEN 'last-5-minutes' WHEN e - t > 0 THEN 'last-minute'
            WHEN t - e < 120000000 THEN 'close-grace' WHEN t - e < 86400000000 THEN 'close-reconciliation' ELSE 'stale-close-reconciliation' END AS bucket FROM a),
        c AS (SELECT *, CASE bucket WHEN 'normal' THEN 3600 WHEN 'last-30-minutes' THEN 300 WHEN 'last-5-minutes' THEN 30 WHEN 'last-minute' THEN 15 WHEN 'close-grace' THEN 15 WHEN 'close-reconciliation' THEN 300 WHEN 'stale-close-reconciliation' THEN 3600 END AS secs,
            CASE bucket WHEN 'last-30-minutes' THEN e - 1800000000 WHEN 'last-5-minutes' THEN e - 300000000 WHEN 'last-minute' THEN e - 60000000 WHEN 'close-grace' THEN e WHEN 'close-reconciliation' THEN e + 120000000 WHEN 'stale-close-reconciliation' THEN e + 86400000000 END AS began,
            CASE bucket WHEN 'normal' THEN e - 1800000000 WHEN 'last-30-minutes' THEN e - 300000000 WHEN 'last-5-minutes' THEN e - 60000000 WHEN 'last-minute' THEN e WHEN 'close-grace' THEN e + 120000000 WHEN 'close-reconciliation' THEN e + 86400000000 END AS turns FROM b),
        d AS (SELECT *, CASE WHEN bucket = 'stopped' THEN NULL WHEN l IS NULL THEN t ELSE least(least(l, t) + secs::BIGINT * 1000000, CASE WHEN least(l, t) < began AND began <= t THEN began END, CASE WHEN turns > t THEN turns END) END AS due FROM c)
        SELECT external_id, bucket, secs AS interval_seconds, due AS due_us, coalesce(due <= t, false) AS should_refresh FROM d""",
    "sync_window": f"""{ctes('seen_auctions')}, a AS (SELECT external_id, epoch_us({ENOW}) AS t, epoch_us(last_checked_at) AS c FROM seen_auctions),
        b AS (SELECT *, c IS NULL OR c > t AS fresh FROM a), w AS (SELECT *, CASE WHEN fresh THEN t - 7 * 86400000000 ELSE c - 2 * 86400000000 END AS f, CASE WHEN fresh THEN t ELSE least(t, c + 3 * 86400000000) END AS u FROM b)
        SELECT external_id, CASE WHEN fresh THEN 'bootstrap' WHEN u < t THEN 'catch-up' ELSE 'incremental' END AS mode, f AS from_us, u AS to_us FROM w""",
    "closing_candidates": rf"""{ctes('seen_auctions')} SELECT external_id FROM seen_auctions WHERE status IN ('active', 'closing') AND ends_at <= {ENOW} + INTERVAL 30 MINUTE AND regexp_matches(external_id, '^[1-9][0-9]*$')
        ORDER BY CASE WHEN ends_at > {ENOW} THEN 0 ELSE 1 END, CASE WHEN ends_at > {ENOW} THEN ends_at END, CASE WHEN ends_at <= {ENOW} THEN last_checked_at END NULLS FIRST, external_id LIMIT 500""",
    "backfill_windows": f"""{ctes('comp_updates')}, c AS (SELECT CAST(floor((epoch_us(TIMESTAMP '1999-01-01 00:00:00') - epoch_us(ended_at) - 1) / (14 * 86400000000)) AS INT) AS step, count(*) AS n FROM comp_updates GROUP BY 1),
        r AS (SELECT w.step, coalesce(n, 0) AS rows FROM (SELECT unnest(generate_series(0, (SELECT max(step) + 2 FROM c))) AS step) w LEFT JOIN c ON w.step = c.step), s AS (SELECT *, coalesce(rows = 0 AND lag(rows) OVER (ORDER BY step) = 0, false)::INT AS stop FROM r)
        SELECT step, epoch_us(TIMESTAMP '1999-01-01 00:00:00') - (step + 1) * 14 * 86400000000 AS from_us, rows FROM s QUALIFY coalesce(sum(stop) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
    "counts_by": f"""{ctes('board')} SELECT value, sum(n)::BIGINT AS n FROM (SELECT condition AS value, count(*) AS n FROM board GROUP BY 1 UNION ALL SELECT unnest(['good', 'fair', 'new', 'scrap']), 0) GROUP BY value""",
    "ledger_recent": f"""{ctes('comps')} SELECT auction_id, closed_high_bid_cents FROM comps ORDER BY ended_at DESC, auction_id LIMIT 100""",
    "terminal_gate": f"""{UPDATES}, t AS (SELECT count(*) AS rows, count(DISTINCT external_id) AS ids, count(*) FILTER (closed_high_bid_cents > 0) AS priced,
            count(*) FILTER (ended_at BETWEEN TIMESTAMP '1994-12-31 00:00:00' AND TIMESTAMP '2002-01-01 00:00:00') AS inside, count(mileage) AS detailed FROM new)
        SELECT *, rows = ids AND rows = priced AND rows = inside AND detailed * 10 >= rows * 9 AS ok FROM t""",
}
