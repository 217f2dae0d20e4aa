"""Market offers from landed value pages: embedded JSON, or strictly read text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions.numbers import let, once, rounded

LEAST_DOLLARS, MOST_DOLLARS, MOST_MILES = 100, 1_000_000, 2_000_000
#: Fixed names under which pages hold figures.
NESTED = ("props", "pageProps", "data", "initialState")
LOW, HIGH, SIZE = ("percentileLow", "low", "lowValue"), ("percentileHigh", "high", "highValue"), ("sampleSize", "offerCount", "totalOffers")
MILES, AMOUNT = ("mileage", "odometer", "miles"), ("offer", "offerAmount", "amount", "price", "value")
DATE, TRIM = ("created", "createdAt", "offerDate", "date"), ("trimDisplay", "trim", "trimCode")
#: What stands before and after a page's data. Not one pattern: a lazy group tries its end at each character.
OPENING, CLOSING = r"""(?i)<script[^>]*\bid=["']__NEXT_DATA__["'][^>]*>""", "(?i)</script>"
SPEAKS = r"(?i)(?:real|recent)\s+(?:\w+\s+)?offers?"
RANGE = r"\$([\d,]+)\s*(?:-|–|—|to)\s*\$([\d,]+)"


def number(text: Column) -> Column:
    """A number of digits, commas and points, with a k or m for thousands or millions."""
    value = lambda plain: F.regexp_extract(plain, r"^([0-9.]+)[km]?$", 1).try_cast("double")
    times = lambda plain: F.when(plain.endswith("k"), 1_000).when(plain.endswith("m"), 1_000_000).otherwise(1)
    return let(F.translate(F.lower(F.trim(text)), "$,", ""), lambda plain: value(plain) * times(plain))


def to_cents(dollars: Column) -> Column:
    """Offers lie between a hundred and a million dollars; all else is no offer."""
    return F.when(dollars.between(LEAST_DOLLARS, MOST_DOLLARS), rounded(dollars * 100))


def to_miles(n: Column) -> Column:
    return F.when(n.between(0, MOST_MILES), rounded(n))


def _offers(raw: Column) -> Column:
    """Readable ones of an array of struct of miles, amount (texts), observed_at and trim. In
    steps, since a lambda computes an expression as often as it is written."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    numbers = F.transform(raw, lambda o: F.struct(number(o["miles"]).alias("miles"), number(o["amount"]).alias("amount"), blank(o["observed_at"]).alias("observed_at"), blank(o["trim"]).alias("trim")))
    read = F.transform(numbers, lambda o: F.struct(to_miles(o["miles"]).alias("mileage"), to_cents(o["amount"]).alias("amount_cents"), o["observed_at"].alias("observed_at"), o["trim"].alias("trim")))
    return F.filter(read, lambda o: o["mileage"].isNotNull() & o["amount_cents"].isNotNull())


def _field(v: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def _appraisal(page: Column) -> Column:
    """The object that holds the figures: under appraisalData, or itself, at most six levels of known names deep."""
    found, level = [], [("$", page)]
    for _ in range(6):
        deeper = []
        for path, _ in level:
            prefix = "" if path == "$" else path[1:]
            found.append(F.try_variant_get(page, f"${prefix}.appraisalData", "variant"))
            has = lambda *names, at=prefix: F.coalesce(*[F.try_variant_get(page, f"${at}.{n}", "variant") for n in names]).isNotNull()
            bounded, listed = has("percentileLow", "percentileHigh"), has("offerData", "offers")
            found.append(F.when(bounded & listed, F.try_variant_get(page, path, "variant")))
            # Known names nest in the order of the list; a page that repeats one is not followed.
            start = NESTED.index(path.split(".")[-1]) + 1 if path != "$" else 0
            deeper += [(f"{path}.{n}", page) for n in NESTED[start:]]
        level = deeper
    return F.coalesce(*found)


def extract_market_offers(pages: DataFrame) -> DataFrame:
    """page_id, low_cents, high_cents, offers (mileage, amount_cents, observed_at, trim),
    reported_sample_size, basis (embedded or text); pages that hold no range are left out.

    pages: page_id, html."""
    html = F.coalesce("html", F.lit(""))
    rows = once(pages.select("page_id", html.alias("html")), within=F.split(F.get(F.split("html", OPENING, 2), F.lit(1)), CLOSING, 2))
    rows = once(rows, script=F.coalesce(F.when(F.size("within") == 2, F.trim(F.get("within", F.lit(0)))), F.lit(""))).drop("within")
    payload = F.try_parse_json(F.when(F.col("script") != "", F.col("script")).when(F.trim("html").startswith("{"), F.trim("html")))
    rows = once(rows, page=payload).drop("script")
    rows = once(rows, a=_appraisal(F.col("page"))).drop("page")
    a = F.col("a")
    # All names of an offer are read in one pass over its fields, not by a path each.
    kind = f"array<struct<{', '.join(f'`{n}` string' for n in (*MILES, *AMOUNT, *DATE, *TRIM))}>>"
    listed = F.coalesce(F.try_variant_get(a, "$.offerData", kind), F.try_variant_get(a, "$.offers", kind), F.array().cast(kind))
    first = lambda o, names: F.coalesce(*[o[n] for n in names])
    named = F.transform(listed, lambda o: F.struct(first(o, MILES).alias("miles"), first(o, AMOUNT).alias("amount"), first(o, DATE).alias("observed_at"), first(o, TRIM).alias("trim")))
    rows = once(rows, e_raw=named, e_lo=number(_field(a, LOW)), e_hi=number(_field(a, HIGH)), e_size=rounded(number(_field(a, SIZE))))
    rows = once(rows, e_offers=_offers(F.col("e_raw")))
    amounts = F.transform("e_offers", lambda o: o["amount_cents"])
    rows = rows.withColumns({"e_low": F.coalesce(to_cents(F.col("e_lo")), F.array_min(amounts)), "e_high": F.coalesce(to_cents(F.col("e_hi")), F.array_max(amounts))})
    # What the text says is only read where the embedded figures don't count.
    rows = once(rows, embedded=F.coalesce(F.col("e_low") <= F.col("e_high"), F.lit(False)))
    rows = once(rows, speaks=~F.col("embedded") & F.col("html").rlike(SPEAKS))
    speaks, embedded = F.col("speaks"), F.col("embedded")
    lines = F.when(speaks, F.filter(F.split("html", "\r?\n"), lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\$([\d,]+)"), F.lit(1))) == 1)).otherwise(F.array().cast("array<string>"))
    said = lambda x: F.regexp_replace(F.regexp_extract(x, r"\b([\d,.]+\s*[kKmM]?)\s*(?:miles?|mi)\b", 1), r"\s", "")
    none = F.lit(None).cast("string")
    told = F.transform(lines, lambda x: F.struct(said(x).alias("miles"), F.regexp_extract(x, r"\$([\d,]+)", 1).alias("amount"), none.alias("observed_at"), none.alias("trim")))
    rows = rows.withColumns({
        "t_raw": told, "t_lo": F.when(speaks, number(F.regexp_extract("html", RANGE, 1))), "t_hi": F.when(speaks, number(F.regexp_extract("html", RANGE, 2))),
        "t_size": F.when(speaks, rounded(number(F.regexp_extract("html", r"(?i)(?:based on|sample of)\s+([\d,]+)\s+(?:\w+\s+){0,2}offers?", 1)))),
    })
    rows = once(rows, t_offers=_offers(F.col("t_raw"))).withColumns({"t_low": to_cents(F.col("t_lo")), "t_high": to_cents(F.col("t_hi"))})
    text = ~embedded & F.coalesce(F.col("t_low") <= F.col("t_high"), F.lit(False))
    pick = lambda c: F.when(embedded, F.col(f"e_{c}")).otherwise(F.col(f"t_{c}"))
    return rows.filter(embedded | text).select(
        "page_id", pick("low").alias("low_cents"), pick("high").alias("high_cents"), pick("offers").alias("offers"),
        F.greatest(F.size(pick("offers")).cast("long"), F.coalesce(pick("size"), F.lit(0))).cast("long").alias("reported_sample_size"), F.when(embedded, "embedded").otherwise("text").alias("basis"),
    )
