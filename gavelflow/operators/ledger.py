"""Merge-style maintenance of the auction, vehicle and comparable tables.

Plain Parquet has no MERGE: each merge joins what is there with what comes in on the
key, and folds column by column under a policy. A batch that comes twice folds to the
same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.functions.cadence import catch_up_windows
from gavelflow.functions.deals import outcome_status
from gavelflow.operators.history import last_write_wins
from gavelflow.sources.monthly import MonthlyLedger

ALWAYS, NEWER, KNOWN, CHANGED = "always", "newer", "known", "changed"


def fold(current: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str], clock: str, *, unknown: str = "unknown") -> DataFrame:
    """One row of each key. By column: ALWAYS takes the incoming value; NEWER takes it if
    the incoming clock is not older, a null current clock being the oldest; KNOWN takes it
    unless it is null or ``unknown``. incoming has one row of each key."""
    a = current.select(*[F.col(c).alias(f"a_{c}") for c in current.columns])
    b = incoming.select(*[F.col(c).alias(f"b_{c}") for c in current.columns])
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    rows = a.join(b, on, "full_outer")
    here, there = F.col(f"a_{keys[0]}").isNotNull(), F.col(f"b_{keys[0]}").isNotNull()
    newer = F.col(f"a_{clock}").isNull() | F.coalesce(F.col(f"b_{clock}") >= F.col(f"a_{clock}"), F.lit(False))

    def column(c: str) -> Column:
        old, new = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in keys:
            return F.coalesce(old, new)
        kind = policy.get(c, ALWAYS)
        both = {
            ALWAYS: new,
            NEWER: F.when(newer, new).otherwise(old),
            KNOWN: F.when(new.isNull() | (new.cast("string") == unknown), old).otherwise(new),
        }[kind]
        return F.when(~here, new).when(~there, old).otherwise(both)

    return rows.select(*[column(c).alias(c) for c in current.columns])


AUCTION_POLICY = {"status": NEWER, "current_bid_cents": NEWER, "bidder_count": NEWER, "ends_at": NEWER, "last_checked_at": NEWER, "image_url": KNOWN}


def upsert_auctions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Descriptive columns are replaced; state only by checks that are not older; the time
    of the last price change moves when bid or bidders differ.

    Columns: source_key, external_id, title, status, current_bid_cents, bidder_count,
    ends_at, image_url, last_checked_at, price_changed_at."""
    keys = ["source_key", "external_id"]
    before = current.select(*keys, F.col("current_bid_cents").alias("x_bid"), F.col("bidder_count").alias("x_bidders"), F.col("price_changed_at").alias("x_changed"), F.col("last_checked_at").alias("x_checked"))
    rows = incoming.join(before, keys, "left")
    differs = ~F.col("current_bid_cents").eqNullSafe(F.col("x_bid")) | ~F.col("bidder_count").eqNullSafe(F.col("x_bidders"))
    moved = F.when(F.col("x_checked").isNull(), F.col("last_checked_at")).when((F.col("last_checked_at") >= F.col("x_checked")) & differs, F.col("last_checked_at")).otherwise(F.col("x_changed"))
    return fold(current, rows.withColumn("price_changed_at", moved).select(*current.columns), keys, AUCTION_POLICY, "last_checked_at")


VEHICLE_POLICY = {"vin": KNOWN, "mileage": KNOWN, "body_type": KNOWN, "condition": KNOWN, "operability": KNOWN}


def upsert_vehicles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nulls and unknowns never overwrite known facts. Key: auction_id."""
    return fold(current, incoming, ["auction_id"], VEHICLE_POLICY, "updated_at")


COMPARABLE_POLICY = {"mileage": NEWER, "vin": KNOWN, "closed_high_bid_cents": NEWER, "ended_at": NEWER, "observed_at": NEWER, "part_id": NEWER, "supplier_id": NEWER}


def upsert_comparables(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replaced by observations that are not older. Key: source_key, external_id."""
    return fold(current, incoming, ["source_key", "external_id"], COMPARABLE_POLICY, "observed_at")


def merge_corpus(previous: DataFrame, discovery: DataFrame, now: Column, retention_days: int, key: str = "external_id") -> DataFrame:
    """Union in which the newer side wins, without rows that ended before the retention."""
    if not 1 <= retention_days <= 1825:
        raise ValueError("retention is 1 to 1825 days")
    both = previous.withColumn("x_side", F.lit(0)).unionByName(discovery.withColumn("x_side", F.lit(1)))
    kept = last_write_wins(both, [key], [F.desc("x_side")]).drop("x_side")
    return kept.filter(F.unix_micros("ended_at") >= F.unix_micros(now) - F.lit(retention_days * 86_400_000_000))


def refresh_corpus(previous: DataFrame, discovery: DataFrame, refreshed_before: str | None, refreshed_at: str, now: str, retention_days: int, key: str = "external_id") -> DataFrame:
    """merge_corpus() that refuses to move the time of the refresh backwards or past now."""
    if refreshed_at > now or (refreshed_before is not None and refreshed_at < refreshed_before):
        raise ValueError("a corpus is refreshed forwards, and not beyond now")
    return merge_corpus(previous, discovery, F.lit(now).cast("timestamp"), retention_days, key)


def newest_of(rows: DataFrame, keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """The last observation of each key; ties go to the largest values of the columns named,
    by default of all others in their order."""
    ties = [c for c in rows.columns if c not in (*keys, "observed_at")] if ties is None else ties
    return last_write_wins(rows, keys, [F.desc("observed_at"), *[F.desc(c) for c in ties]])


def incremental_sync(ledger: DataFrame, source: DataFrame, cursor: DataFrame, now: Column, *, overlap_days: int = 2, most_days: int = 14, ties: list[str] | None = None) -> DataFrame:
    """ledger after all windows from the cursor to now are read again from the source and merged.

    cursor: one row, covered_through. Windows overlap and merging is idempotent, so they are
    read as one range; what a run repeats changes nothing. Key: source_key, external_id."""
    windows = catch_up_windows(cursor, now, overlap_days=overlap_days, most_days=most_days)
    reach = windows.agg(F.min("from_at").alias("x_from"), F.max("to_at").alias("x_to"))  # one row
    rows = source.crossJoin(F.broadcast(reach)).filter("ended_at >= x_from AND ended_at < x_to").drop("x_from", "x_to")
    return upsert_comparables(ledger, newest_of(rows, ["source_key", "external_id"], ties))


class WindowWalk:
    """incremental_sync() window by window into a monthly ledger. Each window is merged and
    then committed; a walk that dies goes on at the window that it died in."""

    def __init__(self, months: MonthlyLedger, ties: list[str] | None = None):
        self.months, self.ties, self.spark, self.commits = months, ties, months.spark, f"{months.root}/walk"

    def cursor(self) -> DataFrame:
        """One row: covered_through, null before the first commit."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.commits)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        done = self.spark.read.schema("covered_through timestamp").parquet(self.commits) if there else self.spark.createDataFrame([], "covered_through timestamp")
        return done.agg(F.max("covered_through").alias("covered_through"))

    def run(self, source: DataFrame, now: str, *, overlap_days: int = 2, most_days: int = 14, bootstrap_days: int = 7) -> int:
        """Windows committed. The source is scanned for one window at a time."""
        windows = catch_up_windows(self.cursor(), F.lit(now).cast("timestamp"), bootstrap_days, overlap_days, most_days)
        windows = windows.orderBy("step").select("from_at", "to_at").collect()  # as many as there are spans to catch up
        for w in windows:
            rows = source.filter((F.col("ended_at") >= F.lit(w.from_at)) & (F.col("ended_at") < F.lit(w.to_at)))
            self.months.merge(newest_of(rows, self.months.keys, self.ties), upsert_comparables)
            self.spark.range(1).select(F.lit(w.to_at).alias("covered_through")).coalesce(1).write.mode("append").parquet(self.commits)
        return len(windows)


def append_observations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What to append: observations that differ from the auction's last state, one a time."""
    last = last_write_wins(current, ["auction_id"], [F.desc("observed_at")]).select("auction_id", *[F.col(c).alias(f"x_{c}") for c in ("bid_cents", "bidders", "status", "ends_at")], F.lit(True).alias("x_seen"))
    rows = incoming.dropDuplicates(["auction_id", "observed_at"]).join(last, "auction_id", "left")
    same = F.coalesce("x_seen", F.lit(False))
    for c in ("bid_cents", "bidders", "status", "ends_at"):
        same = same & F.col(c).eqNullSafe(F.col(f"x_{c}"))
    return rows.filter(~same).select(*incoming.columns).join(current.select("auction_id", "observed_at"), ["auction_id", "observed_at"], "left_anti")


def previous_complete_check(checks: DataFrame, now: Column) -> DataFrame:
    """One row: the last complete check before now."""
    return checks.filter((F.col("success") == 1) & (F.col("coverage") == "complete") & (F.col("checked_at") < now)).agg(F.max("checked_at").alias("previous_check"))


UNVERIFIED = "closed-high-bid-unverified"


def archive_missing(auctions: DataFrame, checks: DataFrame, now: Column, source: str) -> DataFrame:
    """Open auctions of the source that the check before the last didn't see have ended: with
    status, ended_at, final_bid_cents and final_status. All other rows stay as they are.

    checks are those of the same source and scope."""
    rows = auctions.crossJoin(F.broadcast(previous_complete_check(checks, now)))  # one row
    unseen = F.coalesce(F.col("last_seen_at") < F.col("previous_check"), F.lit(False))
    gone = (F.col("source_key") == source) & F.col("status").isin("active", "preview", "closing") & unseen
    new = {"status": F.lit("ended"), "ended_at": now, "final_bid_cents": F.col("current_bid_cents"), "final_status": F.lit(UNVERIFIED)}
    old = {"status": "string", "ended_at": "timestamp", "final_bid_cents": "long", "final_status": "string"}
    rows = rows.withColumn("x_gone", gone)
    before = lambda c: F.col(c) if c in auctions.columns else F.lit(None).cast(old[c])
    return rows.select(*[c for c in auctions.columns if c not in new], *[F.when(F.col("x_gone"), value).otherwise(before(c)).alias(c) for c, value in new.items()])


def auction_vehicles(auctions: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Auctions with their vehicle's columns; those without a vehicle are left out. Key: auction_id."""
    facts = [c for c in vehicles.columns if c == "auction_id" or c not in auctions.columns]
    return auctions.join(vehicles.select(*facts), "auction_id")


COMPARABLE = ["source_key", "external_id", "source_auction_id", "vin", "year", "make", "model", "mileage", "closed_high_bid_cents", "award_status", "outcome_status", "ended_at", "outcome_observed_at"]


def closed_rows(auctions: DataFrame, vehicles: DataFrame, ended_at: Column, observed_at: Column) -> DataFrame:
    """Ended auctions with a bid as rows of the ledger."""
    rows = auction_vehicles(auctions.filter("current_bid_cents IS NOT NULL"), vehicles)
    return rows.withColumns({
        "x_ended": ended_at, "x_observed": observed_at, "award_status": F.lit("unknown"),
        "outcome_status": outcome_status(F.col("current_bid_cents"), F.col("bidder_count")),
    }).select(
        "source_key", "external_id", F.col("auction_id").alias("source_auction_id"), "vin", "year", "make", "model", "mileage",
        F.col("current_bid_cents").alias("closed_high_bid_cents"), "award_status", "outcome_status", F.col("x_ended").alias("ended_at"), F.col("x_observed").alias("outcome_observed_at"),
    )


def close_out(ledger: DataFrame, auctions: DataFrame, vehicles: DataFrame, now: Column, source: str) -> DataFrame:
    """ledger with the auctions of the source that ended now, have a bid and aren't in it.
    Key: source_key, external_id."""
    ended = auctions.filter((F.col("source_key") == source) & (F.col("status") == "ended") & (F.col("ended_at") == now))
    new = closed_rows(ended, vehicles, F.col("ended_at"), now).join(ledger.select("source_key", "external_id"), ["source_key", "external_id"], "left_anti")
    return ledger.unionByName(new.select(*ledger.columns))


TERMINAL_STATUSES = ("ended", "sold", "unsold", "cancelled")
LIVE_FIELDS = ["current_bid_cents", "bidder_count", "status", "ends_at"]


def live_observations(auctions: DataFrame, live: DataFrame) -> DataFrame:
    """What to append to the bid history: live rows newer than the auction's last check that
    change bid, bidders, status or end, with extension_count. Key: auction_id, external_id;
    of several rows of one time the one of the largest bid counts."""
    before = auctions.select("auction_id", "external_id", F.col("last_checked_at").alias("x_checked"), F.col("extension_count").alias("x_extensions"), *[F.col(c).alias(f"x_{c}") for c in LIVE_FIELDS])
    rows = last_write_wins(live, ["auction_id", "external_id", "last_checked_at"], [F.desc_nulls_last("current_bid_cents"), F.col("status"), F.desc("ends_at")])
    rows = rows.join(before, ["auction_id", "external_id"]).filter("last_checked_at > x_checked")
    order = Window.partitionBy("auction_id").orderBy("last_checked_at")
    first = F.row_number().over(order) == 1
    was = {c: F.when(first, F.col(f"x_{c}")).otherwise(F.lag(c).over(order)) for c in LIVE_FIELDS}
    rows = rows.withColumns({f"w_{c}": was[c] for c in LIVE_FIELDS})
    changed = F.lit(False)
    for c in LIVE_FIELDS:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"w_{c}"))
    moved = F.sum(F.coalesce((F.col("ends_at") > F.col("w_ends_at")).cast("int"), F.lit(0))).over(order)
    rows = rows.withColumns({"x_changed": changed, "extension_count": (F.coalesce("x_extensions", F.lit(0)) + moved).cast("int")})
    return rows.filter("x_changed").select("auction_id", "external_id", F.col("last_checked_at").alias("observed_at"), *LIVE_FIELDS, "extension_count")


def apply_live_updates(auctions: DataFrame, live: DataFrame) -> DataFrame:
    """auctions after live checks that are strictly newer. A terminal status fills ended_at
    (once), final_bid_cents and final_status; price_changed_at moves with bid or bidders.

    auctions: auction_id, external_id, the live fields, last_checked_at, price_changed_at,
    ended_at, final_bid_cents, final_status, and any others; live: one or more rows of an
    auction, of which the latest counts."""
    last = last_write_wins(live, ["auction_id", "external_id"], [F.desc("last_checked_at"), F.desc_nulls_last("current_bid_cents"), F.col("status"), F.desc("ends_at")])
    new = last.select("auction_id", "external_id", *[F.col(c).alias(f"n_{c}") for c in [*LIVE_FIELDS, "last_checked_at"]])
    rows = auctions.join(new, ["auction_id", "external_id"], "left").withColumn("x_newer", F.coalesce(F.col("n_last_checked_at") > F.col("last_checked_at"), F.lit(False)))
    over = F.col("n_status").isin(*TERMINAL_STATUSES)
    moved = ~F.col("n_current_bid_cents").eqNullSafe(F.col("current_bid_cents")) | ~F.col("n_bidder_count").eqNullSafe(F.col("bidder_count"))
    value = {c: F.col(f"n_{c}") for c in [*LIVE_FIELDS, "last_checked_at"]} | {
        "ended_at": F.when(over, F.coalesce("ended_at", "n_ends_at")).otherwise(F.col("ended_at")),
        "final_bid_cents": F.when(over, F.col("n_current_bid_cents")).otherwise(F.col("final_bid_cents")),
        "final_status": F.when(over, F.lit(UNVERIFIED)).otherwise(F.col("final_status")),
        "price_changed_at": F.when(moved, F.col("n_last_checked_at")).otherwise(F.col("price_changed_at")),
    }
    return rows.select(*[F.when(F.col("x_newer"), value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in auctions.columns])


def close_live(ledger: DataFrame, auctions: DataFrame, vehicles: DataFrame, live: DataFrame) -> DataFrame:
    """ledger after the live checks that ended auctions, with auctions as apply_live_updates()
    left them: their rows are written anew, awards reset, whatever was there."""
    told = live.select("auction_id", "external_id", F.col("last_checked_at").alias("x_at")).distinct()
    ended = auctions.filter(F.col("status").isin(*TERMINAL_STATUSES)).join(told, ["auction_id", "external_id"]).filter("last_checked_at = x_at").drop("x_at")
    new = closed_rows(ended, vehicles, F.col("ends_at"), F.col("last_checked_at")).select(*ledger.columns)
    return ledger.join(new.select("source_key", "external_id"), ["source_key", "external_id"], "left_anti").select(*ledger.columns).unionByName(new)


def link_source_auction(ledger: DataFrame, auctions: DataFrame) -> DataFrame:
    """ledger with source_auction_id, the auction of the same source and external id, or null."""
    ids = auctions.select("source_key", "external_id", F.col("auction_id").alias("x_auction"))
    rows = ledger.join(ids, ["source_key", "external_id"], "left")
    return rows.withColumn("source_auction_id", F.col("x_auction")).drop("x_auction")


def log_source_check(checks: DataFrame, results: DataFrame) -> DataFrame:
    """checks with started ones finished by their results. checks: check_id, success, coverage,
    result_count, expected_count, error_code; results: check_id, received, expected, error_code.

    A check is complete only if nothing failed and all that was expected came; an unfinished one stays in progress."""
    r = results.select("check_id", F.col("received").alias("x_received"), F.col("expected").alias("x_expected"), F.col("error_code").alias("x_error"), F.lit(True).alias("x_done"))
    rows = checks.join(r, "check_id", "left")
    code = F.coalesce("x_error", F.when(~F.col("x_received").eqNullSafe(F.col("x_expected")), "COUNT_MISMATCH"))
    new = {
        "success": F.when(code.isNull(), 1).otherwise(0), "coverage": F.when(code.isNull(), "complete").otherwise("failed"),
        "result_count": F.col("x_received"), "expected_count": F.col("x_expected"), "error_code": code,
    }
    return rows.select(*[F.when(F.coalesce("x_done", F.lit(False)), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in checks.columns])


def sync_cursor(checks: DataFrame, ledger: DataFrame, scope: str) -> DataFrame:
    """One row: covered_through, the last complete check of the scope, and earliest, the ledger's first end."""
    last = checks.filter((F.col("scope") == scope) & (F.col("success") == 1) & (F.col("coverage") == "complete")).agg(F.max("checked_at").alias("covered_through"))
    return last.crossJoin(ledger.agg(F.min("ended_at").alias("earliest")))  # one row each


def refresh_summary(worklist: DataFrame) -> DataFrame:
    """One row of figures. worklist: bucket, should_refresh, success (null where not tried), appended."""
    due = F.col("should_refresh")
    return worklist.agg(
        F.count(F.lit(1)).alias("considered"), F.count_if(due).alias("due"), F.count_if(due & F.col("success")).alias("succeeded"), F.count_if(due & ~F.coalesce("success", F.lit(False))).alias("failed"),
        F.count_if(due & F.coalesce("success", F.lit(False)) & F.col("appended")).alias("observations_appended"), F.array_join(F.sort_array(F.collect_set(F.when(due, F.col("bucket")))), ",").alias("due_buckets"),
    )


CACHE_HOURS = {"offers": 24, "comps": 1, "miss": 1}


def cache_valuations(valuations: DataFrame, created_at: Column) -> DataFrame:
    """valuations with created_at and expires_at: offers live a day, comparables and misses an
    hour. kind: offers, comps or miss."""
    hours = F.lit(CACHE_HOURS["miss"])
    for kind, n in CACHE_HOURS.items():
        hours = F.when(F.col("kind") == kind, n).otherwise(hours)
    rows = valuations.withColumn("created_at", created_at)
    return rows.withColumn("expires_at", F.timestamp_micros(F.unix_micros("created_at") + hours.cast("long") * F.lit(3_600_000_000)))


def usable_closed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sales that closed with a bid and an end, one row of counts). Any status but exactly
    ``closed`` counts as terminated; a closed one without a bid above zero as no-bid."""
    closed = F.col("status") == "closed"
    good = F.coalesce(closed & (F.col("current_bid_cents") > 0) & F.col("ends_at").isNotNull(), F.lit(False))
    told = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("usable"), F.count_if(~F.coalesce(closed, F.lit(False))).alias("terminated"),
        F.count_if(F.coalesce(closed, F.lit(False)) & ~F.coalesce(F.col("current_bid_cents") > 0, F.lit(False))).alias("no_bid"),
    )
    return rows.filter(good), told


def retained_coverage(corpus: DataFrame) -> DataFrame:
    """One row: rows, those with details (mileage), and the earliest and latest end."""
    return corpus.agg(F.count(F.lit(1)).alias("rows"), F.count("mileage").alias("detailed"), F.min("ended_at").alias("earliest"), F.max("ended_at").alias("latest"))


def corpus_order(corpus: DataFrame, key: str = "auction_id") -> DataFrame:
    """Latest end first; the id settles ties."""
    return corpus.orderBy(F.desc("ended_at"), key)


def combine_sources(*parts: DataFrame) -> DataFrame:
    """All rows of all catalogs; columns that one lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def counts_by(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """value, n: counts of each value, and zeros for known values that don't occur."""
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    zeros = rows.sparkSession.createDataFrame([(v, 0) for v in known], "value string, n long")
    return counted.unionByName(zeros).groupBy("value").agg(F.sum("n").alias("n"))


def plausibility_gate(counts: DataFrame, previous: DataFrame, least_share: float = 0.5) -> DataFrame:
    """ok, reason for the one row of counts (expected, received, distinct_ids) against the
    previous complete check's (received)."""
    # The largest of previous rows stands for them all: one row, also if there is none.
    rows = counts.crossJoin(F.broadcast(previous.agg(F.max("received").alias("before"))))
    reason = F.when(F.col("received") != F.col("expected"), "count-mismatch").when(F.col("distinct_ids") != F.col("received"), "duplicate-ids").when(F.col("received") == 0, "empty").when(F.col("received") < F.col("before") * least_share, "sharp-drop")
    return rows.select("expected", "received", "distinct_ids", "before", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def terminal_gate(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Figures and verdict of a batch of closed sales: unique ids, positive prices, ends
    within a day of the window, nine in ten with mileage."""
    day = 86_400_000_000
    inside = F.unix_micros("ended_at").between(F.unix_micros(start) - day, F.unix_micros(end) + day)
    told = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("external_id").alias("ids"), F.count_if(F.col("closed_high_bid_cents") > 0).alias("priced"), F.count_if(inside).alias("inside"), F.count_if(F.col("mileage").isNotNull()).alias("detailed"))
    ok = (F.col("rows") == F.col("ids")) & (F.col("rows") == F.col("priced")) & (F.col("rows") == F.col("inside")) & (F.col("detailed") * 10 >= F.col("rows") * 9)
    return told.withColumn("ok", ok)


def backfill_windows(ledger: DataFrame, start: str, days: int = 14) -> DataFrame:
    """The windows of a walk backwards from start: step, from_at, to_at, rows. The walk ends
    with the second of two empty windows, however far back that is."""
    length = F.lit(days * 86_400_000_000)
    begin = F.unix_micros(F.lit(start).cast("timestamp"))
    step = F.floor((begin - F.unix_micros("ended_at") - 1) / length).cast("int")
    counted = ledger.select(step.alias("step")).filter("step >= 0").groupBy("step").agg(F.count(F.lit(1)).alias("rows"))  # a row for each window that has any
    ends = ledger.sparkSession.range(1).select(F.lit(-1).alias("step"), F.lit(0).cast("long").alias("rows"))
    order = Window.orderBy("step")
    gaps = counted.unionByName(ends).withColumn("x_next", F.lead("step").over(order)).filter(F.col("x_next").isNull() | (F.col("x_next") - F.col("step") > 2))
    last = gaps.agg((F.min("step") + 2).alias("x_last"))  # one row
    steps = last.select(F.explode(F.sequence(F.lit(0), "x_last")).alias("step"))
    rows = steps.join(counted, "step", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    to = F.timestamp_micros(begin - F.col("step") * length)
    return rows.select("step", F.timestamp_micros(begin - (F.col("step") + 1) * length).alias("from_at"), to.alias("to_at"), "rows")
