"""Which vehicle a lot is: make, family, class, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions.lot_text import decomposed

# Families in order of precedence, on compacted make, model and title.
FAMILY_RULES = [
    ("ford-f150", r"\bF?150\b|F150"), ("ford-f250", "F250"), ("ford-f350", "F350"), ("ford-f450", "F450"), ("ford-f550", "F550"), ("ford-ranger", "RANGER"),
    ("ford-transit-connect", "TRANSITCONNECT"), ("ford-transit", "TRANSIT"), ("ford-e150", "E150"), ("ford-e250", "E250"), ("ford-e350", "E350"), ("ford-explorer", "EXPLORER"),
    ("ford-expedition", "EXPEDITION"), ("chevrolet-silverado-1500", "(?:SILVERAD[O0].*1500|(?:K|C)1500|1500.*SILVERAD[O0])"),
    ("chevrolet-silverado-2500", "(?:SILVERAD[O0].*2500|(?:K|C)2500|2500.*SILVERAD[O0])"), ("chevrolet-silverado-3500", "(?:SILVERAD[O0].*3500|(?:K|C)3500|3500.*SILVERAD[O0])"),
    ("chevrolet-silverado", "SILVERAD[O0]"), ("chevrolet-express", "EXPRESS"), ("chevrolet-tahoe", "TAHOE"), ("chevrolet-suburban", "SUBURBAN"), ("chevrolet-equinox", "EQUINOX"),
    ("chevrolet-malibu", "MALIBU"), ("chevrolet-volt", "VOLT"), ("ram-1500", "(?:RAM.*1500|1500.*(?:RAM|TRADESMAN|CLASSIC))"), ("ram-2500", "(?:RAM.*2500|2500.*(?:RAM|TRADESMAN|ST))"),
    ("ram-3500", "(?:RAM.*3500|3500.*(?:RAM|TRADESMAN))"), ("ram-4500", "(?:RAM.*4500|4500.*RAM)"), ("ram-5500", "(?:RAM.*5500|5500.*RAM)"),
    ("dodge-grand-caravan", "GRANDCARAVAN"), ("dodge-durango", "DURANGO"), ("dodge-charger", "CHARGER"), ("nissan-titan", "TITAN"), ("nissan-pathfinder", "PATHFINDER"),
    ("jeep-grand-cherokee", "GRANDCHEROKEE"), ("jeep-cherokee", "CHEROKEE"),
]
MAKE_RULES = [("FORD", "ford"), ("CHEVROLET", "chevrolet"), ("^CHEVY$", "chevrolet"), ("^GMC$|GENERALMOTORS", "gmc"), ("RAM", "ram"), ("DODGE", "dodge"), ("INTERNATIONAL", "international"), ("FREIGHTLINER", "freightliner"), ("NISSAN", "nissan"), ("CHRYSLER", "chrysler"), ("JEEP", "jeep"), ("KTM", "ktm")]
#: (what it is matched on, pattern, class), the first match counts.
CLASS_RULES = [
    ("text", "FIRE|PUMPER|FIREAPPARATUS|FOAMTRUCK", "fire-apparatus"), ("text", "MOTORCYCLE|MOTORBIKE|KTM", "motorcycle"), ("text", "TRAM|GOLFCART|LOWSPEED|MOTOELECTRIC", "low-speed-vehicle"),
    ("text", "BUS|SHUTTLE|COACH", "bus-shuttle"), ("text", "FREIGHTLINER|INTERNATIONAL|OSHKOSH|L9000|HEAVYDUTY|TRACTORTRUCK|DUMPTRUCK", "truck-heavy-duty"),
    ("family", "-(?:f150|silverado-1500|ranger|titan|1500)$", "pickup-light-duty"), ("family", "-(?:f250|silverado-2500|2500)$", "pickup-three-quarter-ton"),
    ("family", "-(?:f350|silverado-3500|3500)$", "pickup-one-ton"), ("family", "-(?:f450|f550|4500|5500)$", "pickup-heavy-duty"), ("text", "PICKUP|CREWCAB|QUADCAB|DOUBLECAB|FLATBED", "pickup-other"),
    ("family", "grand-caravan", "minivan"), ("family", "transit-connect", "compact-van"), ("family", "(?:transit|express|e150|e250|e350)", "full-size-van"), ("text", "MINIVAN|GRANDCARAVAN", "minivan"),
    ("text", r"CARGOVAN|PASSENGERVAN|FULLSIZEVAN|\bVAN\b", "full-size-van"), ("family", "(?:expedition|tahoe|suburban)", "suv-full-size"), ("family", "(?:explorer|durango|pathfinder|grand-cherokee)", "suv-midsize"),
    ("family", "(?:cherokee|equinox)", "suv-compact"), ("text", r"SPORTUTILITY|CROSSOVER|\bSUV\b", "suv-other"), ("text", "HATCHBACK", "passenger-hatchback"),
    ("text", "SEDAN|4DOOR|PASSENGERCAR|MALIBU|CHARGER|VOLT", "passenger-sedan"),
]


def compact(c: Column) -> Column:
    """Capital letters and digits only, with brand aliases resolved."""
    text = F.upper(decomposed(F.coalesce(c, F.lit(""))))
    for pattern, name in (("FORD MOTOR (?:CO|COMPANY)", "FORD"), ("CHEVROLET MOTOR DIVISION|CHEVROLET TRUCK", "CHEVROLET"), ("DODGE TRUCK|RAM TRUCK", "RAM")):
        text = F.regexp_replace(text, pattern, name)
    return F.regexp_replace(text, "[^A-Z0-9]+", "")


def make_of(text: Column) -> Column:
    """The brand of a compacted make."""
    out = F.nullif(F.lower(text), F.lit(""))
    for pattern, name in reversed(MAKE_RULES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def family_of(known: Column, text: Column, label: Column) -> Column:
    """The first family whose pattern and make fit, else make-model. text and label are compacted."""
    out = F.when(known.isNotNull() & (F.length(label) >= 2), F.concat_ws("-", known, F.lower(label)))
    for family, pattern in reversed(FAMILY_RULES):
        brand = family.split("-")[0]
        fits = known.isin("ram", "dodge") if brand == "ram" else known == brand
        out = F.when(text.rlike(pattern) & fits, family).otherwise(out)
    return out


def class_of(family: Column, text: Column) -> Column:
    out = F.lit(None).cast("string")
    for on, pattern, name in reversed(CLASS_RULES):
        out = F.when((text if on == "text" else family).rlike(pattern), name).otherwise(out)
    return out


def identify(df: DataFrame, make: str = "make", model: str = "model", title: str = "title", body: str = "body") -> DataFrame:
    """df with known_make, family and class. Staged, so that each text is compacted once."""
    m, l, t, b = (F.coalesce(F.col(c), F.lit("")) for c in (make, model, title, body))  # noqa: E741
    staged = df.withColumns({"x_make": compact(m), "x_text": compact(F.concat_ws(" ", m, l, t)), "x_label": compact(l), "x_whole": compact(F.concat_ws(" ", t, l, b))})
    staged = staged.withColumn("known_make", make_of(F.col("x_make")))
    staged = staged.withColumn("family", family_of(F.col("known_make"), F.col("x_text"), F.col("x_label")))
    return staged.withColumn("class", class_of(F.col("family"), F.col("x_whole"))).drop("x_make", "x_text", "x_label", "x_whole")


def canonical_vin(c: Column) -> Column:
    vin = F.upper(F.trim(c))
    return F.when(vin.rlike("^[A-HJ-NPR-Z0-9]{17}$"), vin)


def vehicle_key(year: Column, family: Column, make: Column, model: Column) -> Column:
    """year|family, or year|make model where no family is known."""
    return F.concat_ws("|", F.coalesce(year.cast("string"), F.lit("unknown")), F.coalesce(family, F.lower(F.concat_ws(" ", make, model))))
