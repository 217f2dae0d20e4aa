"""Facts in the free text of a lot, as columns.

Every extractor takes its rules as a parameter; the defaults are the vehicle rules. All
is native but one vectorised function, for numeric character references and for Unicode
compatibility forms, which Spark lacks; it only sees rows that need it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelflow.functions.numbers import col, let

# Vocabularies and patterns of the normaliser, in order of precedence.
BODY_RULES = [
    (r"\b(?:sport\s+utility(?:\s+vehicle)?|suv)\b", "suv"),
    (r"\b(?:pickup(?:\s+truck)?|pick-up(?:\s+truck)?)\b", "pickup"),
    (r"\b(?:chassis\s+cab|cab(?:\s+and|\s*&)?\s+chassis)\b", "cab-chassis"),
    (r"\b(?:mini\s*van|minivan)\b", "minivan"),
    (r"\b(?:cargo|passenger|conversion)\s+van\b", "van"),
    (r"\bambulance\b", "ambulance"),
    (r"\b(?:transit|shuttle|school)\s+bus\b", "bus"),
    (r"\b(?:station\s+wagon|wagon)\b", "wagon"),
    (r"\bhatchback\b", "hatchback"),
    (r"\bcrossover\b", "crossover"),
    (r"\bconvertible\b", "convertible"),
    (r"\bcoupe\b", "coupe"),
    (r"\bsedan\b", "sedan"),
    (r"\bvan\b", "van"),
    (r"\bbus\b", "bus"),
    (r"\btruck\b", "truck"),
]
VEHICLE_TITLE = r"\b(?:automobile|motor\s+vehicle|police\s+interceptor|patrol\s+vehicle)\b"
NON_ROAD_RULES = [
    (r"\b(?:utility|cargo|equipment|boat|travel|flatbed|dump|semi|tractor)\s+trailer\b|\btrailer\b", "trailer"),
    (r"\b(?:forklift|fork\s+lift|pallet\s+truck)\b", "material-handling-equipment"),
    (r"\b(?:farm|agricultural|lawn|garden)\s+tractor\b|\btractor\b|\b(?:skid\s*steer|loader|excavator|bulldozer|backhoe|grader)\b", "heavy-equipment"),
    (r"\b(?:boat|vessel|watercraft|aircraft|airplane|helicopter)\b", "other-transport"),
    (r"\b(?:motorcycle|motorbike|scooter|atv|utv|golf\s+cart)\b", "recreational-vehicle"),
    (
        r"\b(?:vehicle|automotive|car|truck)\s+(?:parts?|accessor(?:y|ies)|tires?|wheels?|rims?|lift|hoist|rack|tool\s*box|bed\s+cap|camper\s+shell)\b|\b(?:parts?|accessor(?:y|ies)|tires?|wheels?|rims?)\s+(?:for|and)\s+(?:vehicle|automotive|car|truck)s?\b",
        "parts-or-accessories",
    ),
    (
        r"\b(?:engine|transmission)(?:s)?(?:\s+(?:assembly|assemblies|only|parts?))?\s+(?:and|\/|&)\s+(?:engine|transmission)(?:s)?\b|\b(?:engine|transmission)\s+(?:assembly|only|parts?)\b",
        "parts-or-accessories",
    ),
    (r"\b(?:replacement|remanufactured|rebuilt|spare)\s+(?:engine|transmission)\b|\b(?:engine|transmission)\s+(?:replacement|component|unit)\b", "parts-or-accessories"),
    (r"\b(?:for\s+parts\s+only|parts\s+only|scrap\s+metal)\b", "parts-or-scrap"),
]
MAKES = [
    "Alfa Romeo", "Aston Martin", "Audi", "BMW", "Buick", "Cadillac", "Chevrolet", "Chevy", "Chrysler", "Dodge", "Fiat", "Ford", "Freightliner", "Genesis", "GMC", "Honda",
    "Hummer", "Hyundai", "Infiniti", "International", "Isuzu", "Jaguar", "Jeep", "Kia", "Land Rover", "Lexus", "Lincoln", "Maserati", "Mazda", "Mercedes-Benz", "Mercedes",
    "Mercury", "Mini", "Mitsubishi", "Nissan", "Oldsmobile", "Peterbilt", "Plymouth", "Pontiac", "Porsche", "Ram", "Rivian", "Saab", "Saturn", "Scion", "Smart", "Subaru",
    "Suzuki", "Tesla", "Toyota", "Volkswagen", "Volvo",
]
MAKE_NAMES = {"Chevy": "Chevrolet", "Mercedes": "Mercedes-Benz"}
DAMAGE_RULES = [
    (r"\b(?:dent(?:ed|s)?|body damage|collision|accident damage|hail damage)\b", "body-damage"),
    (r"\b(?:rust(?:ed|ing)?|corrosion|corroded)\b", "rust-or-corrosion"),
    (r"\b(?:cracked|broken|shattered)\s+(?:windshield|window|glass)\b|\bwindshield\s+(?:is\s+)?(?:cracked|broken)\b", "glass-damage"),
    (r"\b(?:mold|mildew|moss|water intrusion|water damage|flood damage)\b", "water-or-organic-growth"),
    (r"\b(?:missing parts?|parts? (?:is|are) missing|stripped)\b", "missing-parts"),
    (r"\b(?:flat|damaged|worn|dry-rotted)\s+tires?\b|\btires?\s+(?:are\s+)?(?:flat|damaged|worn|dry-rotted)\b", "tire-damage"),
    (r"\b(?:torn|ripped|damaged|stained)\s+(?:seat|seats|upholstery|interior)\b", "interior-damage"),
    (r"\b(?:fire damage|burned|burnt)\b", "fire-damage"),
    (r"\b(?:scratches|scratched|paint damage|peeling paint)\b", "paint-damage"),
]
ISSUE_RULES = [
    (r"\b(?:does not|doesn't|will not|won't|unable to)\s+(?:start|run|drive)\b|\b(?:non[- ]?running|inoperable|non[- ]?operational)\b", "non-operational"),
    (r"\b(?:engine (?:issue|issues|problem|problems|damage)|check engine|engine knock|engine seized)\b", "engine-issue"),
    (r"\b(?:transmission (?:issue|issues|problem|problems|damage)|transmission slips?)\b", "transmission-issue"),
    (r"\b(?:dead battery|battery (?:is )?(?:dead|missing|weak|damaged))\b", "battery-issue"),
    (r"\b(?:fluid|oil|coolant|fuel|transmission)\s+leaks?\b|\bleaks?\s+(?:fluid|oil|coolant|fuel)\b", "fluid-leak"),
    (r"\bopen recall\s*:\s*yes\b|\bactive recall\b", "open-recall"),
    (r"\b(?:unknown operating condition|operating condition (?:is )?unknown|running condition (?:is )?unknown)\b", "operability-unknown"),
]
OPERABILITY_RULES = [
    (ISSUE_RULES[0][0], "non-operational"),
    (r"\b(?:runs? and drives?|starts? and drives?|operational and drivable)\b", "runs-and-drives"),
    (r"\b(?:engine runs?|vehicle runs?|starts? successfully|operational)\b", "runs"),
]
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "hellip": "…", "lt": "<", "nbsp": " ", "ndash": "–", "mdash": "—", "quot": '"'}
CONDITION_CODES = {"N": "new", "1": "new", "U": "usable", "4": "usable", "R": "repairable", "7": "repairable", "X": "salvage", "S": "scrap"}
DISPLAY_CONDITIONS = {"new": "good", "usable": "good", "repairable": "repairable", "salvage": "salvage", "scrap": "salvage"}
FEED_STATUSES = {
    "bulk": {"a": "active", "active": "active", "p": "preview", "preview": "preview", "": "scheduled", "s": "scheduled", "scheduled": "scheduled"},
    "live": {"active": "active", "preview": "preview", "closed": "ended", "ended": "ended", "complete": "ended", "awarded": "sold", "sold": "sold"},
}
FEED_STATUSES["catalog"] = FEED_STATUSES["bulk"]


def ascii_words(pattern: str) -> str:
    """The pattern with word boundaries that only know ASCII letters, digits and underscores.

    A boundary before a group, class or letter opens a word; any other closes one."""
    opened = re.sub(r"\\b(?=[(\[A-Za-z0-9])", "(?<![A-Za-z0-9_])", pattern)
    return opened.replace(r"\b", "(?![A-Za-z0-9_])")


def _alternatives(pattern: str) -> list[str]:
    """The pattern's alternatives outside all groups and classes."""
    out, depth, in_class, start, k = [], 0, False, 0, 0
    while k < len(pattern):
        char = pattern[k]
        if char == "\\":
            k += 1
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


#: Most words that a text is looked through for before its rules are tried.
MOST_WORDS = 12


def _opening(alternative: str) -> list[str] | None:
    """Words in small letters, of which every match begins with one; None where that isn't plain to see."""
    inner = re.fullmatch(r"\\b\((?:\?:)?((?:[^()\[\]\\]|\\.|\((?:[^()]|\\.)*\)[?*]?|\[[^\]]*\])*)\)(?![?*{]).*", alternative)
    if inner and not inner[1].startswith("?"):
        parts = [_opening(r"\b" + x) for x in _alternatives(inner[1])]
        return None if None in parts else [w for part in parts for w in part]
    plain = re.match(r"\\b([A-Za-z0-9 ]+)(.?)", alternative, re.DOTALL)
    if not plain:
        return None
    word = plain[1][:-1] if plain[2] and plain[2] in "?*{" else plain[1]
    return [word.lower()] if len(word) > 1 else None


def _holds_any(low: Column, patterns: list[str]) -> Column | None:
    """Whether the text in small letters holds a word that one of the patterns begins with."""
    opened = [_opening(x) for p in patterns for x in _alternatives(p)]
    if None in opened:
        return None
    words = {w for some in opened for w in some}
    words = sorted(w for w in words if not any(v != w and v in w for v in words))
    return reduce(or_, [low.contains(w) for w in words]) if 0 < len(words) <= MOST_WORDS else None


def any_rule(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """Whether one of the patterns matches, by one pass over the text: an alternation of them
    all, behind one word boundary where each begins with one. Patterns that refer back to
    their groups by number keep a pass of their own. low, the text in small letters, is first
    looked through for the words that matches begin with, which costs far less than a pattern."""
    alone = [p for p in patterns if re.search(r"\\[1-9]", p)]
    every = [x for p in patterns if p not in alone for x in _alternatives(p)]
    if every and all(re.match(r"\\b[(\[A-Za-z0-9]", x) for x in every):
        joined = ["(?i)(?<![A-Za-z0-9_])(?:" + "|".join(ascii_words(x[2:]) for x in every) + ")"]
    else:
        joined = ["(?i)" + "|".join(f"(?:{ascii_words(x)})" for x in every)] if every else []
    passes = [text.rlike(x) for x in [*joined, *(ascii_words(f"(?i){p}") for p in alone)]]
    held = None if low is None or alone else _holds_any(low, patterns)
    found = reduce(or_, passes) if passes else F.lit(False)
    return found if held is None else held & found


def _both_cases(text: Column, of) -> Column:
    """of(text, text in small letters), each computed once."""
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), lambda t: of(t["text"], t["low"]))


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that matches, else null. One pass tells whether any does;
    halving the rules then finds the first, in as many passes as their number has digits in base two."""

    def found(among: list[tuple[str, str]], text: Column, low: Column) -> Column:
        if len(among) == 1:
            return F.lit(among[0][1])
        first, rest = among[: len(among) // 2], among[len(among) // 2 :]
        return F.when(any_rule(text, [p for p, _ in first], low), found(first, text, low)).otherwise(found(rest, text, low))

    if not rules:
        return F.lit(None).cast("string")
    return _both_cases(text, lambda text, low: F.when(any_rule(text, [p for p, _ in rules], low), found(rules, text, low)))


def all_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of all patterns that match, in order. Halves of the rules of which none
    matches are left after one pass."""
    none = F.array().cast("array<string>")

    def found(rules: list[tuple[str, str]], text: Column, low: Column) -> Column:
        first, rest = rules[: len(rules) // 2], rules[len(rules) // 2 :]
        some = F.array(F.lit(rules[0][1])) if len(rules) == 1 else F.concat(found(first, text, low), found(rest, text, low))
        return F.when(any_rule(text, [p for p, _ in rules], low), some).otherwise(none)

    return _both_cases(text, lambda text, low: found(rules, text, low)) if rules else none


@F.pandas_udf(T.StringType())
def _unicode_forms(texts: pd.Series) -> pd.Series:
    def number(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else " "

    return texts.map(lambda t: unicodedata.normalize("NFKC", re.sub(r"(?i)&#(?:(\d{1,7})|x([\da-f]{1,6}));?", number, t)))


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def decomposed(text: Column) -> Column:
    """text with accents and compatibility forms taken apart (NFKD); only texts beyond ASCII leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _decomposed(text)).otherwise(text)


def named_entities(text: Column) -> Column:
    for name, char in ENTITIES.items():
        if name != "amp":
            text = F.regexp_replace(text, f"(?i)&{name}(?![\\da-z]);?", char)
    return F.regexp_replace(text, r"(?i)&amp(?![\da-z]);?", "&")


def clean_text(c: Column | str) -> Column:
    """Visible text of HTML on one line: no comments, scripts, styles, tags or controls."""
    text = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), "\\x00", " ")
    for _ in range(2):
        text = F.regexp_replace(text, r"<!--[\s\S]*?-->", " ")
        text = F.regexp_replace(text, r"(?i)<(script|style|noscript)\b[^>]*>[\s\S]*?</\1\s*>", " ")
        text = named_entities(text)
    text = F.when(text.rlike(r"&#|[^\x00-\x7F]"), _unicode_forms(text)).otherwise(text)
    text = F.regexp_replace(text, r"<[^>]*>", " ")  # line breaks and block tags are blanks like any other tag
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def extract_vin(text: Column) -> Column:
    def found(text: Column, low: Column) -> Column:
        labelled = F.when(low.contains("vin"), F.regexp_extract(text, ascii_words(r"(?i)\bVIN\s*(?:NUMBER|NO\.?|#)?\s*[:=\-]?\s*([A-HJ-NPR-Z0-9]{17})\b"), 1)).otherwise("")
        bare = F.regexp_extract(text, ascii_words(r"\b([A-HJ-NPR-Za-hj-npr-z0-9]{17})\b"), 1)
        return let(labelled, lambda x: F.when(x != "", x).otherwise(bare))

    return let(F.upper(_both_cases(text, found)), lambda vin: F.when(vin.rlike("[A-Z]") & vin.rlike("[0-9]"), vin))


def extract_mileage(text: Column) -> Column:
    def found(text: Column, low: Column) -> Column:
        ways = [
            (("mileage", "odo"), r"(?i)\b(?:mileage|odometer|odo)(?:\s+reading)?\s*(?:is|:|=|-)??\s*([\d,]{1,12})(?:\.\d+)?\b"),
            (("mile",), r"(?i)\b([\d,]{1,12})(?:\.\d+)?\s*(?:actual\s+)?miles?\b"),
        ]
        numbers = [F.when(reduce(or_, [low.contains(w) for w in words]), F.regexp_replace(F.regexp_extract(text, ascii_words(way), 1), ",", "").try_cast("bigint")) for words, way in ways]
        return F.coalesce(*[let(n, lambda n: F.when(n.between(0, 2_000_000), n)) for n in numbers])

    return _both_cases(text, found)


def extract_body_type(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return first_rule(text, BODY_RULES if rules is None else rules)


def extract_year(text: Column, observed_year: Column | int) -> Column:
    most = (observed_year if isinstance(observed_year, Column) else F.lit(observed_year)) + 2
    years = F.when(text.contains("19") | text.contains("20"), F.regexp_extract_all(text, F.lit(ascii_words(r"\b((?:19|20)\d{2})\b")), F.lit(1)))
    years = F.transform(years, lambda y: y.cast("int"))
    return F.try_element_at(F.filter(years, lambda y: y <= most), F.lit(1))


def extract_make(text: Column, makes: list[str] | None = None) -> Column:
    rules = [(r"\b" + re.escape(m).replace(r"\ ", r"[\s-]+") + r"\b", MAKE_NAMES.get(m, m)) for m in (MAKES if makes is None else makes)]
    return first_rule(text, rules)


def damage_flags(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return all_rules(text, DAMAGE_RULES if rules is None else rules)


def issue_flags(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return all_rules(text, ISSUE_RULES if rules is None else rules)


def operability(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return F.coalesce(first_rule(text, OPERABILITY_RULES if rules is None else rules), F.lit("unknown"))


def classify_lot(title: Column, text: Column, observed_year: int, *, body_rules=None, non_road=None, makes=None, vehicle_title: str = VEHICLE_TITLE) -> Column:
    """Struct of is_vehicle, reason (of exclusion), vin, mileage, body_type, evidence."""

    def of(title: Column, whole: Column) -> Column:
        signal = extract_body_type(title, body_rules).isNotNull() | title.rlike(ascii_words(f"(?i){vehicle_title}")) | (extract_year(title, observed_year).isNotNull() & extract_make(title, makes).isNotNull())
        excluded = first_rule(title, NON_ROAD_RULES if non_road is None else non_road)
        return F.struct(signal.alias("signal"), excluded.alias("excluded"), extract_vin(whole).alias("vin"), extract_mileage(whole).alias("miles"), extract_body_type(whole, body_rules).alias("body"))

    def judged(f: Column) -> Column:
        signal, excluded, vin, miles, body = (f[c] for c in ("signal", "excluded", "vin", "miles", "body"))
        vehicle = excluded.isNull() & signal & (vin.isNotNull() | miles.isNotNull() | body.isNotNull())
        reason = F.when(vehicle, None).otherwise(F.coalesce(excluded, F.when(signal, "insufficient-vehicle-evidence").otherwise("non-vehicle-title")))
        evidence = F.array_compact(F.array(F.when(signal, F.lit("vehicle-title")), F.when(vin.isNotNull(), F.lit("vin")), F.when(miles.isNotNull(), F.lit("mileage")), F.concat(F.lit("body:"), body)))
        return F.struct(vehicle.alias("is_vehicle"), reason.alias("reason"), vin.alias("vin"), miles.alias("mileage"), body.alias("body_type"), F.when(excluded.isNull(), evidence).otherwise(F.array().cast("array<string>")).alias("evidence"))

    given = F.struct(title.alias("title"), F.trim(F.concat_ws(" ", title, text)).alias("whole"))
    return let(let(given, lambda t: of(t["title"], t["whole"])), judged)


def parse_money(c: Column) -> Column:
    """Non-negative dollars as a double, or null."""
    text = F.regexp_replace(c.cast("string"), r"[$,\s]", "")
    return F.when(text.rlike(r"^\+?\d+(?:\.\d+)?$"), F.regexp_replace(text, r"^\+", "").try_cast("double"))


def parse_int(c: Column) -> Column:
    number = parse_money(c)
    return F.when((number == F.floor(number)) & (number <= 9007199254740991.0), number.try_cast("bigint"))


def parse_time(c: Column) -> Column:
    """/Date(ms)/, ISO without an offset as UTC, or any offset form."""
    ms = F.regexp_extract(c, r"^/Date\((\d+)(?:[+-]\d{4})?\)/$", 1).try_cast("bigint")
    # A time without seconds and with a zone isn't read otherwise.
    text = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.coalesce(F.timestamp_millis(ms), F.try_to_timestamp(F.when(~c.startswith("/Date("), text)))


def status_of(c: Column, feed: str = "bulk") -> Column:
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.lit(None).cast("string") if feed == "live" else F.lit("unknown")
    for name, status in FEED_STATUSES[feed].items():
        out = F.when(text == name, status).otherwise(out)
    return out


def condition_of(code: Column) -> Column:
    out = F.lit("unknown")
    for name, condition in CONDITION_CODES.items():
        out = F.when(F.upper(F.trim(code)) == name, condition).otherwise(out)
    return out


def display_condition(condition: Column, usable_as: str = "good") -> Column:
    out = F.lit("unknown")
    for name, shown in DISPLAY_CONDITIONS.items():
        out = F.when(condition == name, usable_as if name == "usable" else shown).otherwise(out)
    return out


def image_array(c: Column) -> Column:
    """Distinct https URLs in order, without fragment; those with credentials are dropped."""
    urls = F.regexp_extract_all(c, F.lit(r"(?i)(https?://[^\s|;<>\"',]+(?:,(?!\s*https?://)[^\s|;<>\"',]+)*)"), F.lit(1))
    tidy = F.transform(urls, lambda u: F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"[),]+$", ""), "#.*$", ""), "(?i)^http://", "https://"))
    return F.array_distinct(F.filter(tidy, lambda u: ~u.rlike("^https://[^/]*@")))


def spec_map(html: Column) -> Column:
    """label -> value of ``label: value`` lines of list items and paragraphs, or of the text's
    sentences where it has neither; the last wins."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(named_entities(x), r"<[^>]*>", " "), r"\s+", " "))
    blocks = F.regexp_extract_all(html, F.lit(r"(?i)<(?:li|p)\b[^>]*>([\s\S]*?)</(?:li|p)\s*>"), F.lit(1))
    blocks = F.filter(F.transform(blocks, plain), lambda x: x != "")
    lines = F.when(F.size(blocks) > 0, blocks).otherwise(F.split(plain(html), r"(?<=[.!?])\s+"))
    good = F.filter(lines, lambda x: x.rlike(r"^[^:]{2,45}:\s*.+$"))
    pairs = F.transform(good, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]{2,45}):", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]{2,45}:\s*(.+)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def lot_id(sale: Column, lot: Column, fallback: Column) -> Column:
    """gsa:<sale>:<lot>, parts in lower case with dashes; a hash where there is no lot."""
    part = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))
    return F.concat_ws(":", F.lit("gsa"), F.coalesce(part(sale), F.lit("unknown-sale")), F.coalesce(part(lot), F.concat(F.lit("lot-"), F.lower(F.hex(F.xxhash64(fallback))))))


def model_label(title: Column, year: Column, make: Column) -> Column:
    """The title without its first year and make, and without punctuation at its ends."""
    alias = F.when(make == "Chevrolet", "(?:Chevrolet|Chevy)").when(make == "Mercedes-Benz", "Mercedes(?:-Benz)?").otherwise(make)

    def without(text: Column, pattern: Column) -> Column:
        place = F.regexp_instr(text, pattern)
        found = F.regexp_substr(text, pattern)
        return F.when(F.coalesce(place, F.lit(0)) > 0, F.concat(F.substring(text, F.lit(1), place - 1), F.lit(" "), F.substring(text, place + F.length(found), F.length(text)))).otherwise(text)

    text = without(title, F.concat(F.lit(r"\b"), year.cast("string"), F.lit(r"\b")))
    text = without(text, F.concat(F.lit(r"(?i)\b"), alias, F.lit(r"\b")))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[\s,:;\-]+|[\s,:;\-]+$", "")
    return F.nullif(F.trim(text), F.lit(""))


def central_to_utc(wall: Column) -> Column:
    """Chicago wall clock to UTC; null where the clock skipped that time, the earlier of two."""
    utc = F.to_utc_timestamp(wall, "America/Chicago")
    return F.when(F.from_utc_timestamp(utc, "America/Chicago") == wall, utc)


def location_struct(lines: list[Column], city: Column, state: Column, postal: Column) -> Column:
    """Address lines once each, whatever their case; city, state, postal code."""
    held = F.filter(F.array(*[F.trim(x) for x in lines]), lambda x: x.isNotNull() & (x != ""))
    first = F.filter(held, lambda x, i: ~F.exists(F.slice(held, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.struct(first.alias("lines"), F.trim(city).alias("city"), F.trim(state).alias("state"), F.trim(postal).alias("postal_code"))


def condition_notes(lines: Column, rules: list[tuple[str, str]] | None = None, most: int = 12) -> Column:
    """Distinct lines that carry a flag or a condition word, the first ones."""
    pattern = "|".join(p for p, _ in (DAMAGE_RULES + ISSUE_RULES if rules is None else rules))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x.rlike(f"(?i){pattern}|\\bcondition\\b"))), 1, most)


def source_external_id(url: Column, own: Column) -> Column:
    found = F.regexp_extract(url, r"/preview/(\d+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(own, "^gsa-fleet:", ""))


def sale_number(lot: Column) -> Column:
    """First part of sale/lot, of 3 to 64 safe characters, in capitals."""
    part = F.upper(F.trim(F.split_part(lot, F.lit("/"), F.lit(1))))
    return F.when(part.rlike("^[A-Z0-9._-]{3,64}$"), part)


def risk_flags(*arrays: Column) -> Column:
    """Flags of all arrays, readable, once each whatever their case."""
    every = F.transform(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])), lambda x: F.trim(F.regexp_replace(x, "-", " ")))
    return F.filter(every, lambda x, i: (x != "") & ~F.exists(F.slice(every, 1, i), lambda y: F.lower(y) == F.lower(x)))
