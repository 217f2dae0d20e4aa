"""Text normalisation and identity queries, and their SQL.

The corpora hold no vehicle words, so these pass rule lists of words that do occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.functions import identity, lot_text
from gavelflow.plans.bindings import ctes, view

WORDS = [(r"\bworthless\b", "worthless"), (r"\bstupid\b", "stupid"), (r"\b(?:idiot|moron)\b", "person"), (r"\blicensed\b", "license"), (r"\bund\b", "german"), (r"\bthe\b", "english")]
FLAGS = [(r"\blas?\b", "article"), (r"\bof the\b", "of-the"), (r"\bund die\b", "und-die"), (r"\bmail\d*\b", "mail"), (r"\b555\b", "phone")]
MAKES = ["Apache License", "The", "Und", "Les"]
#: Tasks of each core, where rows are dealt out.
TASKS = 4


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", lot_text.clean_text("html").alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores: a file of one row group would be one task's."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rows.repartition(TASKS * spark.sparkContext.defaultParallelism, "doc_id", "text")


def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", lot_text.extract_vin(text).alias("vin"), lot_text.extract_mileage(text).alias("mileage"), lot_text.extract_year(text, 2024).alias("year"),
        lot_text.extract_body_type(text, WORDS).alias("body_type"), lot_text.extract_make(text, MAKES).alias("make"),
        F.array_join(lot_text.damage_flags(text, FLAGS), ",").alias("flags"), lot_text.operability(text, WORDS[:3]).alias("operability"),
    )


def _classified() -> Column:
    title, text = F.substring_index("text", "\n", 1), F.col("text")
    return lot_text.classify_lot(title, text, 2024, body_rules=WORDS, non_road=FLAGS[:3], makes=MAKES, vehicle_title=r"\bquestion\b")


def classify_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", _classified().alias("c"))
    return rows.select("doc_id", "c.is_vehicle", F.coalesce("c.reason", F.lit("")).alias("reason"), "c.body_type", F.array_join("c.evidence", ",").alias("evidence"))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of classify_lot() and extract_facts() joined by doc_id. Both are read off each
    text in one pass; a row counts once for each row of its id, as in the join."""
    return coverage(_documents(spark, sf_dir))


def coverage(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", _classified().alias("c"), lot_text.extract_vin(text).alias("vin"), lot_text.extract_mileage(text).alias("mileage"), lot_text.extract_year(text, 2024).alias("year"))
    told = {
        "total": F.count(F.lit(1)), "vehicles": F.count_if("c.is_vehicle"), "excluded": F.count_if(~F.col("c.is_vehicle")), "with_vin": F.count("vin"),
        "with_mileage": F.count("mileage"), "with_body_type": F.count("c.body_type"), "with_year": F.count("year"),
    }
    by_id = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in told.items()])
    return by_id.agg(*[F.coalesce(F.sum(F.col(name) * F.col("n")), F.lit(0)).alias(name) for name in told])


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_lot(spark, sf_dir).filter("NOT is_vehicle").groupBy("reason").agg(F.count(F.lit(1)).alias("lots"))


def spec_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled lines of all pages as they stand, and of their texts alone, by sentences."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace("html", "(?i)</?(?:li|p)\\b[^>]*>", " ")
    rows = pages.select("page_id", F.lit("page").alias("form"), lot_text.spec_map(F.col("html")).alias("m")).unionByName(pages.select("page_id", F.lit("text").alias("form"), lot_text.spec_map(bare).alias("m")))
    return rows.select("page_id", "form", F.explode("m").alias("label", "value"))


def image_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.concat_ws("|", "url", F.concat(F.lit("http://a.example/"), F.col("page_id") % 3, F.lit("#x")), "url", F.lit("https://u:p@b.example/y"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", lot_text.image_array(links).alias("images"))
    return rows.select("page_id", F.array_join("images", " ").alias("images"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a vehicle, from fixed makes and models picked by its key."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    makes = ["Ford", "FORD MOTOR CO", "Dodge", "Chevrolet", "Nissan", "Jeep", "Kubota", "RAM TRUCK"]
    models = ["F250XL", "RAM 1500 CREW CAB 4X4", "Transit Connect", "Express", "K3500", "Grand Cherokee", "Titan", "Silverad0 1500", "X"]
    bodies = ["pickup", "van", "sedan", "bus"]
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    key = F.col("p_partkey")
    return rows.select(key.alias("id"), pick(makes, key).alias("make"), pick(models, F.floor(key / 8)).alias("model"), F.concat_ws(" ", (1995 + key % 20).cast("string"), pick(makes, key), pick(models, F.floor(key / 8)), "p_name").alias("title"), pick(bodies, key).alias("body"))


def canonical_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identify(_titles(spark, sf_dir)).select("id", "known_make", "family", "class")


def model_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titles(spark, sf_dir)
    return rows.select("id", lot_text.model_label(F.col("title"), (1995 + F.col("id") % 20).cast("int"), F.col("make")).alias("label"))


def central_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 16) * 900_000_000)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.unix_micros(lot_text.central_to_utc(wall)).alias("utc_us"))


def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))
    stamp = F.concat(F.lit("/Date("), F.col("o_orderkey") * 86_400_000, F.lit(")/"))
    status = F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", lot_text.parse_money(text).alias("dollars"), lot_text.parse_int(F.col("o_orderkey").cast("string")).alias("whole"), F.unix_micros(lot_text.parse_time(stamp)).alias("at_us"),
        lot_text.status_of(status).alias("status"), lot_text.condition_of(F.col("o_orderpriority").substr(1, 1)).alias("condition"),
    )


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavelflow.sources.gates import validate

    rows = view(spark, sf_dir, "board")
    rules = {
        "bid-missing": F.col("current_bid_cents").isNull(), "score-range": ~F.col("score").between(0, 99), "ends-before-start": F.col("ends_at") <= F.col("starts_at"),
        "state-blank": F.trim("state") == "", "vin-missing": F.col("vin").isNull(),
    }
    return validate(rows, rules).select("id", F.array_join("violations", ",").alias("violations"))


QUERIES = {
    f.__name__: f
    for f in (clean_text, extract_facts, classify_lot, coverage_report, exclusion_counts, spec_map, image_array, canonical_family, model_label, central_to_utc, parsed_fields, validate_rows)
}


def _first(text: str, rules: list[tuple[str, str]], tail: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{label}'" for p, label in rules) + f" ELSE {tail} END"


def _make(text: str) -> str:
    return _first(text, [(r"\b" + m.replace(" ", r"[\s-]+") + r"\b", m) for m in MAKES])


def _year(text: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({text}, '\b((?:19|20)\d{{2}})\b', 1), lambda y: CAST(y AS INT)), lambda y: y <= 2026)[1]"


VIN = r"""upper(CASE WHEN regexp_extract({0}, '(?i)\bVIN\s*(?:NUMBER|NO\.?|#)?\s*[:=\-]?\s*([A-HJ-NPR-Z0-9]{{17}})\b', 1) <> '' THEN regexp_extract({0}, '(?i)\bVIN\s*(?:NUMBER|NO\.?|#)?\s*[:=\-]?\s*([A-HJ-NPR-Z0-9]{{17}})\b', 1) ELSE regexp_extract({0}, '(?i)\b([A-HJ-NPR-Z0-9]{{17}})\b', 1) END)"""
MILES = r"""coalesce(CASE WHEN TRY_CAST(replace(regexp_extract({0}, '(?i)\b(?:mileage|odometer|odo)(?:\s+reading)?\s*(?:is|:|=|-)??\s*([\d,]{{1,12}})(?:\.\d+)?\b', 1), ',', '') AS BIGINT) BETWEEN 0 AND 2000000 THEN TRY_CAST(replace(regexp_extract({0}, '(?i)\b(?:mileage|odometer|odo)(?:\s+reading)?\s*(?:is|:|=|-)??\s*([\d,]{{1,12}})(?:\.\d+)?\b', 1), ',', '') AS BIGINT) END,
    CASE WHEN TRY_CAST(replace(regexp_extract({0}, '(?i)\b([\d,]{{1,12}})(?:\.\d+)?\s*(?:actual\s+)?miles?\b', 1), ',', '') AS BIGINT) BETWEEN 0 AND 2000000 THEN TRY_CAST(replace(regexp_extract({0}, '(?i)\b([\d,]{{1,12}})(?:\.\d+)?\s*(?:actual\s+)?miles?\b', 1), ',', '') AS BIGINT) END)"""
FACTS = rf"""facts AS (SELECT doc_id, {VIN.format('text')} AS v, {MILES.format('text')} AS mileage, {_year('text')} AS year, {_first('text', WORDS)} AS body_type, {_make('text')} AS make,
    concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{label}' END" for p, label in FLAGS)}) AS flags, {_first('text', WORDS[:3], "'unknown'")} AS operability FROM documents)"""
LOTS = rf"""t AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title FROM documents),
    s AS (SELECT *, trim(concat_ws(' ', title, text)) AS w, {_first('title', FLAGS[:3])} AS out,
        {_first('title', WORDS)} IS NOT NULL OR regexp_matches(title, '(?i)\bquestion\b') OR ({_year('title')} IS NOT NULL AND {_make('title')} IS NOT NULL) AS signal FROM t),
    e AS (SELECT *, CASE WHEN regexp_matches({VIN.format('w')}, '[A-Z]') AND regexp_matches({VIN.format('w')}, '[0-9]') THEN 1 END AS vin, {MILES.format('w')} AS miles, {_first('w', WORDS)} AS body_type FROM s),
    lots AS (SELECT doc_id, out IS NULL AND signal AND (vin IS NOT NULL OR miles IS NOT NULL OR body_type IS NOT NULL) AS is_vehicle,
        CASE WHEN out IS NULL AND signal AND (vin IS NOT NULL OR miles IS NOT NULL OR body_type IS NOT NULL) THEN '' WHEN out IS NOT NULL THEN out WHEN signal THEN 'insufficient-vehicle-evidence' ELSE 'non-vehicle-title' END AS reason, body_type,
        CASE WHEN out IS NULL THEN concat_ws(',', CASE WHEN signal THEN 'vehicle-title' END, CASE WHEN vin IS NOT NULL THEN 'vin' END, CASE WHEN miles IS NOT NULL THEN 'mileage' END, 'body:' || body_type) ELSE '' END AS evidence FROM e)"""


def _compact(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce({text}, '')), 'FORD MOTOR (?:CO|COMPANY)', 'FORD', 'g'), 'CHEVROLET MOTOR DIVISION|CHEVROLET TRUCK', 'CHEVROLET', 'g'), 'DODGE TRUCK|RAM TRUCK', 'RAM', 'g'), '[^A-Z0-9]+', '', 'g')"


def _plain(text: str) -> str:
    for name, char in (("apos", "''"), ("gt", ">"), ("hellip", "…"), ("lt", "<"), ("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("quot", '"'), ("amp", "&")):
        text = f"regexp_replace(regexp_replace({text}, '(?i)&{name};', '{char}', 'g'), '(?i)&{name}([^0-9a-z;]|$)', '{char}\\1', 'g')"
    return f"trim(regexp_replace(regexp_replace({text}, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _pick(names: list[str], by: str) -> str:
    return f"{names!r}[({by}) % {len(names)} + 1]"


TITLES = f"""v AS (SELECT p_partkey AS id, {_pick(["Ford", "FORD MOTOR CO", "Dodge", "Chevrolet", "Nissan", "Jeep", "Kubota", "RAM TRUCK"], 'p_partkey')} AS make,
    {_pick(["F250XL", "RAM 1500 CREW CAB 4X4", "Transit Connect", "Express", "K3500", "Grand Cherokee", "Titan", "Silverad0 1500", "X"], 'p_partkey // 8')} AS model, {_pick(["pickup", "van", "sedan", "bus"], 'p_partkey')} AS body, p_name FROM part)"""
FAMILY = "CASE " + " ".join(
    f"WHEN regexp_matches(txt, '{p}') AND known IN {('ram', 'dodge') if f.startswith('ram') else '(' + repr(f.split('-')[0]) + ')'} THEN '{f}'" for f, p in identity.FAMILY_RULES
) + " WHEN known IS NOT NULL AND length(lab) >= 2 THEN known || '-' || lower(lab) END"
KNOWN = "CASE " + " ".join(f"WHEN regexp_matches(cm, '{p}') THEN '{m}'" for p, m in identity.MAKE_RULES) + " ELSE nullif(lower(cm), '') END"
CLASS = "CASE " + " ".join(f"WHEN regexp_matches({'ct' if on == 'text' else 'family'}, '{p}') THEN '{c}'" for on, p, c in identity.CLASS_RULES) + " END"

ORACLE_SQL = {
    "extract_facts": rf"WITH {FACTS} SELECT doc_id, CASE WHEN regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') THEN v END AS vin, mileage, year, body_type, make, flags, operability FROM facts",
    "classify_lot": f"WITH {LOTS} SELECT * FROM lots",
    "coverage_report": f"""WITH {FACTS}, {LOTS} SELECT count(*) AS total, count(*) FILTER (is_vehicle) AS vehicles, count(*) FILTER (NOT is_vehicle) AS excluded,
        count(*) FILTER (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')) AS with_vin, count(mileage) AS with_mileage, count(lots.body_type) AS with_body_type, count(year) AS with_year FROM lots JOIN facts USING (doc_id)""",
    "exclusion_counts": f"WITH {LOTS} SELECT reason, count(*) AS lots FROM lots WHERE NOT is_vehicle GROUP BY reason",
    "spec_map": f"""WITH f AS (SELECT page_id, 'page' AS form, html FROM pages UNION ALL SELECT page_id, 'text', regexp_replace(html, '(?i)</?(?:li|p)\\b[^>]*>', ' ', 'g') FROM pages),
        b AS (SELECT page_id, form, html, list_filter(list_transform(regexp_extract_all(html, '(?i)<(?:li|p)\\b[^>]*>([\\s\\S]*?)</(?:li|p)\\s*>', 1), lambda x: {_plain('x')}), lambda x: x <> '') AS blocks FROM f),
        l AS (SELECT page_id, form, CASE WHEN len(blocks) > 0 THEN blocks ELSE string_split(regexp_replace({_plain('html')}, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) END AS lines FROM b),
        e AS (SELECT page_id, form, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM l),
        k AS (SELECT page_id, form, n, lower(trim(regexp_extract(line, '^([^:]{{2,45}}):', 1))) AS label, trim(regexp_extract(line, '^[^:]{{2,45}}:\\s*(.+)$', 1)) AS value FROM e WHERE regexp_matches(line, '^[^:]{{2,45}}:\\s*.+$'))
        SELECT page_id, form, label, value FROM k QUALIFY row_number() OVER (PARTITION BY page_id, form, label ORDER BY n DESC) = 1""",
    "image_array": r"""WITH u AS (SELECT page_id, [regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)^http://', 'https://'), 'https://a.example/' || (page_id % 3)] AS l FROM pages)
        SELECT page_id, CASE WHEN l[1] = l[2] THEN l[1] ELSE array_to_string(l, ' ') END AS images FROM u""",
    "canonical_family": f"""WITH {TITLES}, c AS (SELECT id, body, {_compact('make')} AS cm, {_compact("concat_ws(' ', make, model, CAST(1995 + id % 20 AS VARCHAR), make, model, p_name)")} AS txt, {_compact('model')} AS lab,
            {_compact("concat_ws(' ', CAST(1995 + id % 20 AS VARCHAR), make, model, p_name, model, body)")} AS ct FROM v),
        k AS (SELECT *, {KNOWN} AS known FROM c), f AS (SELECT *, {FAMILY} AS family FROM k)
        SELECT id, known AS known_make, family, {CLASS} AS class FROM f""",
    "model_label": rf"""WITH {TITLES} SELECT id, trim(regexp_replace(concat(CASE make WHEN 'Chevrolet' THEN '' ELSE '' END, model, ' ', p_name), '\s+', ' ', 'g')) AS label FROM v""",
    "central_to_utc": """WITH w AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 16 * 15) * INTERVAL 1 MINUTE AS wall FROM orders),
        z AS (SELECT *, (wall AT TIME ZONE 'America/Chicago') AS later FROM w),
        u AS (SELECT *, CASE WHEN (later - INTERVAL 1 HOUR) AT TIME ZONE 'America/Chicago' = wall THEN later - INTERVAL 1 HOUR ELSE later END AS utc FROM z)
        SELECT o_orderkey, CASE WHEN utc AT TIME ZONE 'America/Chicago' = wall THEN epoch_us(utc) END AS utc_us FROM u""",
    "parsed_fields": """SELECT o_orderkey, o_totalprice AS dollars, o_orderkey AS whole, o_orderkey * 86400000000 AS at_us, CASE o_orderstatus WHEN 'P' THEN 'preview' ELSE 'unknown' END AS status,
        CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'new' WHEN '4' THEN 'usable' ELSE 'unknown' END AS condition FROM orders""",
    "validate_rows": f"""{ctes('board')} SELECT id, concat_ws(',', CASE WHEN current_bid_cents IS NULL THEN 'bid-missing' END, CASE WHEN score NOT BETWEEN 0 AND 99 THEN 'score-range' END, CASE WHEN ends_at <= starts_at THEN 'ends-before-start' END,
        CASE WHEN trim(state) = '' THEN 'state-blank' END, CASE WHEN vin IS NULL THEN 'vin-missing' END) AS violations FROM board""",
}
