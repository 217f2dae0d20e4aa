"""Raw rows to typed lots, listings and bids, as one select each.

Rows that can't be read are not dropped: they come back with a reason, for a quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import lot_text as T
from gavelflow.functions.numbers import rounded

MOST_CENTS = 1_000_000_000
CHANNELS = ("internet", "live")
#: Outcome words, and sale statuses that close a sale.
OUTCOMES = {"sold": "sold", "awarded": "awarded", "lotted": "lotted", "removed": "removed", "withdrawn": "removed"}
CLOSED_SALES = ("closed", "sale complete")
LIVE_TERMINAL = ("ended", "sold")


def normalize_lots(raw: DataFrame, observed_year: int) -> DataFrame:
    """Typed lots with ``is_vehicle`` and the reason of an exclusion.

    raw: sale, lot, title, description (HTML), status, bid, bidders, starts_at, ends_at, images, city, state."""
    clean = raw.withColumns({"x_title": T.clean_text("title"), "x_text": T.clean_text("description")})
    title, text = F.col("x_title"), F.col("x_text")
    clean = clean.withColumns({"x_c": T.classify_lot(title, text, observed_year), "x_make": T.extract_make(title), "x_year": T.extract_year(F.concat_ws(" ", title, text), observed_year)})
    whole = F.concat_ws(" ", title, text)
    return clean.select(
        T.lot_id(F.col("sale"), F.col("lot"), F.concat_ws("|", "title", "description")).alias("id"), title.alias("title"), text.alias("description"),
        "x_c.is_vehicle", "x_c.reason", "x_c.vin", "x_c.mileage", "x_c.body_type", F.col("x_year").alias("year"), F.col("x_make").alias("make"), T.model_label(title, F.col("x_year"), F.col("x_make")).alias("model_label"),
        T.damage_flags(whole).alias("damage_flags"), T.issue_flags(whole).alias("issue_flags"), T.operability(whole).alias("operability"), T.status_of(F.col("status")).alias("status"),
        rounded(T.parse_money(F.col("bid")) * 100).alias("current_bid_cents"), T.parse_int(F.col("bidders")).alias("bidder_count"), T.parse_time(F.col("starts_at")).alias("starts_at"), T.parse_time(F.col("ends_at")).alias("ends_at"),
        T.image_array(F.col("images")).alias("images"), T.location_struct([], F.col("city"), F.col("state"), F.lit(None).cast("string")).alias("location"),
    )


def money_cents(dollars: Column) -> Column:
    """Cents of decimal dollars up to ten million; negative or unreadable is null."""
    cents = rounded(T.parse_money(dollars) * 100)
    return F.when(cents.between(0, MOST_CENTS), cents)


def mapped(value: Column, names: dict[str, str], otherwise: str = "unknown") -> Column:
    out = F.lit(otherwise)
    for name, label in names.items():
        out = F.when(F.lower(F.trim(value)) == name, label).otherwise(out)
    return out


def phase(sale_status: Column, outcome: Column, starts_at: Column, ends_at: Column, now: Column) -> Column:
    closed = F.lower(F.trim(sale_status)).isin(*CLOSED_SALES) | outcome.isin("sold", "awarded", "removed")
    return F.when(closed, "closed").when(starts_at > now, "coming").when(ends_at < now, "ended").when((starts_at <= now) & (ends_at >= now), "active").otherwise("unknown")


def normalize_fleet_listings(raw: DataFrame, now: Column, year_now: int) -> DataFrame:
    """Typed listings. A price is final only of a sold or awarded vehicle: its winning bid,
    else its proceeds."""
    outcome = mapped(F.col("vehicleSaleStatus"), OUTCOMES)
    staged = raw.withColumns({
        "outcome": outcome, "channel": mapped(F.col("saleType"), {c: c for c in CHANNELS}),
        "starts_at": T.parse_time(F.col("saleStartDate")), "effective_ends_at": F.greatest(T.parse_time(F.col("saleEndDate")), T.parse_time(F.col("extendedSaleEndDate"))),
        "x_win": money_cents(F.col("winningBidAmt")), "x_paid": money_cents(F.col("saleProceedsAmt")), "year": F.when(F.col("modelYear").between(1900, year_now + 2), F.col("modelYear")),
        "make": F.nullif(F.trim("makeName"), F.lit("")), "model": F.nullif(F.trim("modelName"), F.lit("")),
    })
    final = F.col("outcome").isin("sold", "awarded")
    price = F.when(final & (F.col("x_win") > 0), F.col("x_win")).when(final & (F.col("x_paid") > 0), F.col("x_paid"))
    basis = F.when(final & (F.col("x_win") > 0), "winning-bid").when(final & (F.col("x_paid") > 0), "sale-proceeds").otherwise("unavailable")
    return staged.select(
        F.col("id").alias("source_id"), F.concat(F.lit("fleet:"), "id").alias("external_key"), F.upper(F.trim("vin")).alias("vin"), F.col("saleNumber").alias("sale_number"), "year", "make", "model",
        F.col("vehicleMiles").cast("long").alias("mileage"), "channel", "outcome", F.col("saleStatus").alias("sale_status"), phase(F.col("saleStatus"), F.col("outcome"), F.col("starts_at"), F.col("effective_ends_at"), now).alias("phase"),
        "starts_at", "effective_ends_at", money_cents(F.col("highBid")).alias("high_bid_cents"), price.alias("final_price_cents"), basis.alias("final_price_basis"),
        (price.isNotNull() & F.col("year").isNotNull() & F.col("make").isNotNull() & F.col("model").isNotNull()).alias("is_comparable_outcome"),
    )


def rephase(listings: DataFrame, now: Column) -> DataFrame:
    return listings.withColumn("phase", phase(F.col("sale_status"), F.col("outcome"), F.col("starts_at"), F.col("effective_ends_at"), now))


def awarded_outcomes(listings: DataFrame) -> DataFrame:
    return listings.filter("is_comparable_outcome AND final_price_cents > 0 AND effective_ends_at IS NOT NULL")


def normalize_bid_history(raw: DataFrame) -> DataFrame:
    """Distinct readable bids of each auction. raw: auction_id, bids (array of bidDate,
    bidAmt, bidderUserId). Names that aren't numbered bidders are withheld."""
    rows = raw.select("auction_id", F.explode("bids").alias("b"))
    label = F.when(F.trim("b.bidderUserId").rlike(r"(?i)^BIDDER\s+\d+$"), F.trim("b.bidderUserId"))
    rows = rows.select("auction_id", label.alias("bidder"), T.parse_time(F.col("b.bidDate")).alias("bid_at"), money_cents(F.col("b.bidAmt")).alias("amount_cents"))
    return rows.filter("bid_at IS NOT NULL AND amount_cents IS NOT NULL").dropDuplicates()


def current_bids(history: DataFrame, details: DataFrame) -> DataFrame:
    """auction_id, current_bid_cents: the highest bidder's amount, else the largest bid, else
    the detail's. details: auction_id, highest_bid_cents, detail_bid_cents."""
    largest = history.groupBy("auction_id").agg(F.max("amount_cents").alias("x_most"))
    return details.join(largest, "auction_id", "left").select("auction_id", F.coalesce("highest_bid_cents", "x_most", "detail_bid_cents").alias("current_bid_cents"))


def normalize_live_bids(raw: DataFrame) -> DataFrame:
    """Live rows with ``reject``, null for good ones. A missing bid stays null, it is no zero.

    raw: requested_id, auctionId, currentBid, numberOfBidders, status, endDate (Chicago)."""
    wall = F.try_to_timestamp(F.col("endDate"))
    staged = raw.withColumns({"status": T.status_of(F.col("status"), "live"), "ends_at": T.central_to_utc(wall), "current_bid_cents": rounded(F.col("currentBid").cast("double") * 100)})
    reject = F.when(F.col("auctionId").isNull(), "missing-id").when(~F.col("auctionId").cast("string").eqNullSafe(F.col("requested_id").cast("string")), "id-mismatch").when(F.col("status").isNull(), "unknown-status").when(F.col("ends_at").isNull(), "bad-end").when(F.col("current_bid_cents") < 0, "negative-bid")
    return staged.select(F.col("auctionId").cast("string").alias("external_id"), "current_bid_cents", F.col("numberOfBidders").cast("int").alias("bidder_count"), "status", "ends_at", reject.alias("reject"))


def fleet_model(model: Column) -> Column:
    """Blanks collapsed; known short forms spelled out; capitals to title case."""
    text = F.trim(F.regexp_replace(model, r"\s+", " "))
    return F.when(F.upper(text).isin("GR CHEROKEE", "GRAND CHEROKEE"), "Grand Cherokee").when(F.upper(text).isin("E350", "E-350"), "E-350").when(text == F.upper(text), F.initcap(text)).otherwise(text)
