"""The ranked board: filters, orders, facets, figures and feed merges.

board: id, source, title, vin, city, state, body_style, make, model, condition, status,
current_bid_cents, score, confidence, projected_profit_cents, discount_to_value,
valuation_status, median_cents, starts_at, ends_at, last_checked_at, images (array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 48
OPEN = ("active", "closing")
UNDER_CENTS = 1_000_000
#: Fixed patterns of the categories.
TRUCK_BODY = r"(?i)\b(?:pickup(?:\s+truck)?|truck|chassis\s+cab|cab\s+chassis|crew\s+cab|extended\s+cab|regular\s+cab)\b"
TRUCK_MODEL = r"(?i)\b(?:silverado|sierra|colorado|canyon|tacoma|tundra|frontier|titan|ridgeline|gladiator|ranger|maverick|ram\s*(?:1500|2500|3500|4500|5500)|f[-\s]?(?:150|250|350|450|550))\b"
CAR = r"(?i)\b(?:passenger\s+cars?|sedans?|coupes?|hatchbacks?|station\s+wagons?|wagons?|convertibles?|roadsters?|sport\s+utility\s+vehicles?|suvs?|crossovers?|mini[-\s]?vans?|passenger\s+vans?)\b"


def normalize_state(state: Column) -> Column:
    """Trimmed; blank, a dash or unknown is null; two letters are capitals."""
    text = F.trim(state)
    return F.when((text == "") | (text == "—") | (F.lower(text) == "unknown"), None).when(F.length(text) == 2, F.upper(text)).otherwise(text)


def is_open() -> Column:
    return F.col("status").isin(*OPEN)


def active_at(now: Column) -> Column:
    """Active, and not past its end."""
    return (F.col("status") == "active") & (F.col("ends_at").isNull() | (F.col("ends_at") > now))


def closing_soon(now: Column, minutes: int = 30) -> Column:
    left = F.unix_micros("ends_at") - F.unix_micros(now)
    return F.coalesce((left >= 0) & (left <= minutes * 60_000_000), F.lit(False))


def board_category(truck_body: str = TRUCK_BODY, truck_model: str = TRUCK_MODEL, car: str = CAR) -> Column:
    body = F.trim(F.coalesce("body_style", F.lit("")))
    identity = F.concat_ws(" ", "title", "make", "model")
    cars = body.rlike(car) | F.lower(body).isin("car", "automobile") | F.col("title").rlike(car)
    return F.when(body.rlike(truck_body) | identity.rlike(truck_model), "trucks").when(cars, "cars").otherwise("other")


def board_query(board: DataFrame, now: Column, *, text: str = "", state: str = "all", condition: str = "all", max_bid_cents: int | None = None, quick: str = "all", saved: DataFrame | None = None, category: Column | None = None) -> DataFrame:
    """quick: all, coming, closing, trucks, cars, other, under-10k or saved. A lot without
    a bid fails a bound on the bid. saved: one column, id."""
    keep = F.lit(True)
    if text.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "vin", "city", "state", "body_style")]))
        keep = keep & hay.contains(text.strip().lower())
    if state != "all":
        keep = keep & F.coalesce(normalize_state(F.col("state")) == state, F.lit(False))
    if condition != "all":
        keep = keep & F.coalesce(F.col("condition") == condition, F.lit(False))
    if max_bid_cents is not None:
        keep = keep & F.coalesce(F.col("current_bid_cents") <= max_bid_cents, F.lit(False))
    keep = keep & ((F.col("status") == "preview") if quick == "coming" else is_open())
    if quick == "closing":
        keep = keep & closing_soon(now)
    if quick in ("trucks", "cars", "other"):
        keep = keep & ((board_category() if category is None else category) == quick)
    if quick == "under-10k":
        keep = keep & F.coalesce(F.col("current_bid_cents") <= UNDER_CENTS, F.lit(False))
    out = board.filter(keep)
    return out.join(saved.select("id"), "id", "left_semi") if quick == "saved" and saved is not None else out


ORDERS = {
    "ending": lambda: [F.coalesce("starts_at", "ends_at").asc_nulls_last()],
    "confidence": lambda: [F.desc("confidence"), F.desc("score")],
    "profit": lambda: [F.desc_nulls_last("projected_profit_cents")],
    "bid": lambda: [F.asc_nulls_last("current_bid_cents")],
    "best": lambda: [F.desc("score"), F.desc("confidence"), F.desc_nulls_last("projected_profit_cents"), F.coalesce("ends_at", "starts_at").asc_nulls_last()],
}


def board_sort(board: DataFrame, key: str = "best", k: int | None = PAGE) -> DataFrame:
    """The first k in this order; the id settles ties."""
    out = board.orderBy(*ORDERS[key](), "id")
    return out if k is None else out.limit(k)


def best_deals(board: DataFrame, k: int = PAGE) -> DataFrame:
    return board_sort(board, "best", k)


def state_facets(board: DataFrame) -> DataFrame:
    """state, lots over open and coming lots with a known state."""
    rows = board.filter(is_open() | (F.col("status") == "preview")).select(normalize_state(F.col("state")).alias("state")).filter("state IS NOT NULL")
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("lots"))


def board_kpis(board: DataFrame, now: Column) -> DataFrame:
    """One row of figures over the whole board."""
    profit = F.col("projected_profit_cents")
    counted = board.agg(
        F.count_if(is_open()).alias("active"), F.count_if(F.col("status") == "preview").alias("coming"), F.count_if(closing_soon(now)).alias("closing"),
        F.sum(F.when(profit.isNotNull(), F.greatest(profit, F.lit(0)))).alias("headroom_cents"),
        F.count_if((F.col("valuation_status") != "unavailable") & F.col("median_cents").isNotNull()).alias("valued"),
        F.count_distinct("condition").alias("conditions"),
    )
    # Discounts are values of four decimal places: a histogram of them is small at any size.
    histogram = board.filter("discount_to_value IS NOT NULL").groupBy("discount_to_value").agg(F.count(F.lit(1)).alias("n"))
    held = histogram.agg(F.sort_array(F.collect_list(F.struct(F.col("discount_to_value").alias("v"), "n"))).alias("h"))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("double").alias("found"))
    step = lambda a, x: F.struct((a["run"] + x["n"]).alias("run"), F.coalesce(a["found"], F.when(a["run"] + x["n"] > F.floor(total / 2), x["v"])).alias("found"))
    median = held.select(F.aggregate("h", start, step, lambda a: a["found"]).alias("median_discount"))
    return counted.crossJoin(F.broadcast(median))  # one row each


def source_coverage(board: DataFrame, now: Column) -> DataFrame:
    """Lots of each source by phase."""
    return board.groupBy("source").agg(
        F.count(F.lit(1)).alias("lots"), F.count_if(active_at(now)).alias("active"), F.count_if(F.col("status") == "preview").alias("coming"),
        F.count_if(F.col("status") == "ended").alias("ended"), F.count_if(F.col("current_bid_cents").isNotNull()).alias("with_bid"),
    )


def retained_rows(board: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Checked within a day and not in the future; coming, or open and not ended."""
    age = F.unix_micros(now) - F.unix_micros("last_checked_at")
    fresh = (age >= 0) & (age <= hours * 3_600_000_000)
    return board.filter(fresh & ((F.col("status") == "preview") | (is_open() & (F.col("ends_at").isNull() | (F.col("ends_at") > now)))))


def _usable(side: str) -> Column:
    v = F.col(f"{side}.valuation")
    return F.coalesce((v["status"] != "unavailable") & v["low_cents"].isNotNull() & v["median_cents"].isNotNull() & v["high_cents"].isNotNull(), F.lit(False))


def merge_feeds(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """A row for each incoming lot: the newer record (on a tie the one with more distinct
    images, else the incoming), with the better valuation of the two, and whether the deal
    must be assessed anew (``reprice``).

    Both: id, last_checked_at, images, forecast_status, payload, and valuation, a struct of
    status, low_cents, median_cents, high_cents, as_of, confidence, sample_size."""
    prior = current.select("id", F.struct(*[c for c in current.columns if c != "id"]).alias("old"))
    rows = incoming.select("id", F.struct(*[c for c in current.columns if c != "id"]).alias("new")).join(prior, "id", "left")
    many = lambda side: F.size(F.array_distinct(F.filter(F.coalesce(F.col(f"{side}.images"), F.array().cast("array<string>")), lambda x: x != "")))
    newer = F.col("new.last_checked_at") > F.col("old.last_checked_at")
    tied = F.col("new.last_checked_at") == F.col("old.last_checked_at")
    rows = rows.withColumn("take_new", F.col("old").isNull() | newer | (tied & (many("new") >= many("old"))))
    rows = rows.withColumn("take_new", F.coalesce("take_new", F.lit(False)))
    old_ok, new_ok = _usable("old"), _usable("new")
    old_at, new_at = F.col("old.valuation.as_of"), F.col("new.valuation.as_of")
    new_value = F.when(F.col("old").isNull(), True).when(old_ok != new_ok, new_ok).when(~old_ok, F.col("take_new")).when(~old_at.eqNullSafe(new_at), F.coalesce(new_at > old_at, new_at.isNotNull())).otherwise(F.col("take_new"))
    rows = rows.withColumn("value_new", new_value)
    record = F.when(F.col("take_new"), F.col("new")).otherwise(F.col("old"))
    value = F.when(F.col("value_new"), F.col("new.valuation")).otherwise(F.col("old.valuation"))
    out = rows.select("id", record.alias("r"), value.alias("valuation"), "take_new", "value_new", (F.when(F.col("value_new"), new_ok).otherwise(old_ok)).alias("ok"), F.col("old").isNotNull().alias("known"))
    reprice = F.col("known") & ((F.col("take_new") != F.col("value_new")) | (F.col("ok") & (F.col("r.forecast_status") == "insufficient")))
    columns = [F.col(f"r.{c}").alias(c) for c in current.columns if c not in ("id", "valuation")]
    return out.select("id", *columns, "valuation", reprice.alias("reprice"))


def merge_authoritative(current: DataFrame, incoming: DataFrame, sources: list[str]) -> DataFrame:
    """merge_feeds(), and the current rows of sources that the response doesn't speak for."""
    merged = merge_feeds(current, incoming)
    kept = current.filter(~F.col("source").isin(sources)).join(incoming.select("id"), "id", "left_anti")
    return merged.unionByName(kept.select(*current.columns).withColumn("reprice", F.lit(False)))


def apply_live_state(board: DataFrame, state: DataFrame) -> DataFrame:
    """board with the live bid, bidders, status, end and check time where they are newer; live: whether they were."""
    fields = ["current_bid_cents", "bidder_count", "status", "ends_at", "last_checked_at"]
    s = state.select("id", *[F.col(c).alias(f"x_{c}") for c in fields])
    rows = board.join(s, "id", "left").withColumn("live", F.coalesce(F.col("x_last_checked_at") > F.col("last_checked_at"), F.lit(False)))
    return rows.select(*[F.when(F.col("live"), F.col(f"x_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in board.columns], "live")


def staleness(generations: DataFrame, now: Column, max_age_minutes: int = 70) -> DataFrame:
    """With expiry (the sooner of age and images), whether it is stale, since when, and its age in seconds."""
    aged = F.timestamp_micros(F.unix_micros("generated_at") + F.lit(max_age_minutes * 60_000_000))
    rows = generations.withColumn("expires_at", F.least(aged, F.col("images_expire_at")))
    stale = F.col("expires_at") <= now
    return rows.withColumns({"stale": stale, "stale_since": F.when(stale, F.col("expires_at")), "age_seconds": F.floor((F.unix_micros(now) - F.unix_micros("generated_at")) / 1_000_000)})
