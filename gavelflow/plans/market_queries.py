"""Exact-identity, offer and resolved valuations as queries, and their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.operators import ledger, market
from gavelflow.plans.bindings import AS_OF, ctes, view
from gavelflow.plans.valuation_queries import VALUED, value_subjects
from gavelflow.sources.scratch import written


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "subjects")
    return rows.select(
        "id", "external_id", F.concat_ws("|", F.col("year").cast("string"), F.col("family")).alias("key"), "year", F.col("family").alias("make"), F.upper("class").alias("model"),
        F.lower(F.substring("class", 1, 3)).alias("trim"), "family", F.when(F.col("external_id").cast("long") % 7 == 0, None).otherwise(F.col("mileage")).alias("mileage"), (F.col("external_id").cast("long") % 4 * -0.1).alias("adjustment"),
    )


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "comps")
    key = F.when(F.col("issues") == 0, F.concat_ws("|", F.col("year").cast("string"), F.col("family")))
    return rows.select(F.col("auction_id").alias("external_id"), key.alias("key"), "year", F.lower("family").alias("make"), F.lower("class").alias("model"), F.when(F.col("issues") == 1, None).otherwise(F.col("mileage")).alias("mileage"), "closed_high_bid_cents", "ended_at")


def exact_identity_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.exact_identity_valuation(_subjects(spark, sf_dir), _ledger(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


def market_offer_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_offer_valuation(_subjects(spark, sf_dir), view(spark, sf_dir, "offers"), ["family", "year"])


def resolve_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subjects(spark, sf_dir).withColumn("n", F.col("external_id").cast("long") / 20).withColumn("n", F.col("n").cast("long"))
    day = lambda d: F.timestamp_micros(F.lit(1_009_843_200_000_000) + d * 86_400_000_000)
    cached = s.filter("n % 3 = 0").select("id", F.when(F.col("n") % 2 == 0, F.col("n")).alias("median_cents"), day(F.col("n") % 5 - 2).alias("expires_at"))
    bundled = s.filter("n % 4 < 2").select("id", (F.col("n") + 1000).alias("median_cents"), day(F.lit(0)).alias("as_of"))
    exact = s.filter("n % 5 < 3").select("id", (F.col("n") + 2000).alias("median_cents"), day(F.col("n") % 3 - 1).alias("as_of"), (F.col("n") % 6).alias("sample_size"))
    offers = s.filter("n % 7 < 3").select("id", (F.col("n") + 3000).alias("median_cents"))
    return market.resolve_valuation(s, cached, bundled, exact, offers, F.lit(AS_OF).cast("timestamp"))


def _cached(offers: DataFrame) -> DataFrame:
    """Offer values that were cached up to two days ago, and misses of an hour and less."""
    missed = F.col("sample_size") < 3
    rows = offers.select("id", F.when(missed, None).otherwise(F.col("median_cents")).alias("median_cents"), F.when(missed, "miss").otherwise("offers").alias("kind"), (F.col("sample_size") % 48).alias("hours"))
    created = F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.when(F.col("kind") == "miss", F.col("hours") * 20 * 60_000_000).otherwise(F.col("hours") * 3_600_000_000))
    return ledger.cache_valuations(rows, created)


def resolve_in_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resolve_valuation() over the values that the other operators find: cached offers,
    comparables, exact sales and offers.

    The three know nothing of each other, and each is a row of small jobs after the large ones,
    so they are found beside each other."""
    subjects, now = _subjects(spark, sf_dir), F.lit(AS_OF).cast("timestamp")

    def valued() -> DataFrame:
        return written(value_subjects(spark, sf_dir).filter("status = 'available'").select("id", "median_cents", "confidence"), "valued")

    with ThreadPoolExecutor(3) as beside:
        found = [beside.submit(x) for x in (valued, lambda: written(exact_identity_valuation(spark, sf_dir), "exact"), lambda: written(market_offer_valuation(spark, sf_dir), "offers"))]
    bundled, exact, offers = (x.result() for x in found)
    bundled = bundled.select("id", "median_cents", F.when(F.col("confidence") < 0.4, F.timestamp_micros(F.unix_micros(now) - 86_400_000_000)).otherwise(now).alias("as_of"))
    exact = exact.select("id", "median_cents", now.alias("as_of"), "sample_size")
    return market.resolve_valuation(subjects, _cached(offers), bundled, exact, offers.select("id", "median_cents"), now)


def enrich_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    lots = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 300).alias("vin"), F.col("p_size").alias("year"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"))
    decodes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("vin"), (F.lit(1975) + F.col("s_suppkey") % 60).cast("int").alias("year"), F.col("s_name").alias("make"), F.lit("x").alias("model"))
    return market.enrich_identity(lots, decodes, 2024).select("id", "year", "make", "model", "match_basis")


def attach_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    listings = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 300).alias("vin"), (F.col("p_partkey") % 2).alias("sale"))
    details = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("vin"), (F.col("s_suppkey") + F.col("s_suppkey") % 3 * 300).alias("detail_id"), F.lit(1).cast("long").alias("detail_sale"))
    return market.attach_details(listings, details).select("id", "detail_id", F.coalesce("error_code", F.lit("")).alias("error_code"))


QUERIES = {f.__name__: f for f in (exact_identity_valuation, market_offer_valuation, resolve_valuation, resolve_in_one, enrich_identity, attach_details)}

SUBJECTS = f"""{ctes('comps', 'subjects', 'offers')},
    s AS (SELECT id, external_id, year || '|' || family AS key, year, family, family AS make, upper(class) AS model, lower(substring(class, 1, 3)) AS trim, CASE WHEN external_id::BIGINT % 7 = 0 THEN NULL ELSE mileage END AS mileage, external_id::BIGINT % 4 * -0.1::DOUBLE AS adj FROM subjects)"""
R = "floor({} + 0.5::DOUBLE)::BIGINT"

ORACLE_SQL = {
    "exact_identity_valuation": f"""{SUBJECTS},
        c AS (SELECT auction_id, CASE WHEN issues = 0 THEN year || '|' || family END AS key, year, lower(family) AS make, lower(class) AS model, CASE WHEN issues = 1 THEN NULL ELSE mileage END AS mileage, closed_high_bid_cents AS price, ended_at FROM comps WHERE closed_high_bid_cents > 0 AND ended_at <= TIMESTAMP '{AS_OF}'),
        p AS (SELECT s.id, s.mileage AS a, adj, c.* FROM s JOIN c ON s.year = c.year AND s.external_id <> auction_id AND (coalesce(s.key = c.key, false) OR (lower(s.make) = c.make AND lower(s.model) = c.model))),
        k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(a - mileage) NULLS LAST, ended_at DESC, auction_id) <= 25),
        m AS (SELECT *, CASE WHEN a > 0 AND mileage > 0 THEN greatest(1, {R.format('price * least(greatest(pow(mileage::DOUBLE / a, 0.28), 0.65), 1.45)')}) ELSE price END AS moved FROM k),
        v AS (SELECT id, list_sort(list(greatest(1, {R.format('moved * (1 + adj)')}))) AS v, list_sort(list(price)) AS raw FROM m GROUP BY id)
        SELECT id, v[floor((len(v) - 1) * 0.25)::INT + 1] AS low_cents, {R.format('(v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2.0::DOUBLE')} AS median_cents, v[floor((len(v) - 1) * 0.75)::INT + 1] AS high_cents,
            {R.format('(raw[(len(raw) + 1) // 2] + raw[len(raw) // 2 + 1]) / 2.0::DOUBLE')} AS raw_median_cents, len(v) AS sample_size, floor(round(least(0.7::DOUBLE, 0.3::DOUBLE + len(v) * 0.055::DOUBLE) * 100, 6) + 0.5::DOUBLE) / 100 AS confidence FROM v""",
    "market_offer_valuation": f"""{SUBJECTS},
        j AS (SELECT s.id, s.mileage AS sm, adj, o.*, contains(lower(o.trim), s.trim) AS fits FROM s JOIN offers o ON s.family = o.family AND s.year = o.year),
        k AS (SELECT *, abs(mileage - sm) AS gap, coalesce({R.format('1e6 / (1 + abs(mileage - sm) / 25000.0::DOUBLE)')}, 0) AS w FROM j QUALIFY fits OR count(*) FILTER (fits) OVER (PARTITION BY id) < 3),
        r AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY offer_cents) AS run, sum(w) OVER (PARTITION BY id) AS total FROM k),
        t AS (SELECT id, min(offer_cents) AS lo, max(offer_cents) AS hi, {R.format('quantile_cont(offer_cents, 0.5)')} AS mid, count(*) AS n, min(offer_cents) FILTER (run * 2 >= total) AS near, min(gap) AS gap, any_value(sm) AS m, any_value(adj) AS adj FROM r GROUP BY id),
        u AS (SELECT *, CASE WHEN m IS NOT NULL AND n >= 3 THEN least(greatest(near - mid, -{R.format('mid * 0.25')}), {R.format('mid * 0.25')}) ELSE 0 END AS shift FROM t),
        x AS (SELECT *, greatest(50000, lo + shift) AS l, greatest(50000, lo + shift, mid + shift) AS m2, greatest(50000, lo + shift, mid + shift, hi + shift) AS h FROM u),
        y AS (SELECT *, greatest(50000, {R.format('l * (1 + adj)')}) AS low_cents FROM x), z AS (SELECT *, greatest(low_cents, {R.format('m2 * (1 + adj)')}) AS median_cents FROM y)
        SELECT id, low_cents, median_cents, greatest(median_cents, {R.format('h * (1 + adj)')}) AS high_cents, n AS sample_size,
            (least(0.78, CASE WHEN n >= 8 THEN 0.64 WHEN n >= 5 THEN 0.57 WHEN n >= 3 THEN 0.5 ELSE 0.4 END + CASE WHEN gap <= 30000 THEN 0.08 ELSE 0 END))::DOUBLE AS confidence FROM z""",
    "resolve_valuation": """WITH s AS (SELECT 'lot:' || p_partkey AS id, p_partkey // 20 AS n FROM part),
        f AS (SELECT *, n % 3 = 0 AND n % 5 - 2 > 0 AS live, n % 3 = 0 AND n % 2 = 0 AS kv, n % 4 < 2 AS b, n % 5 < 3 AS e, n % 5 < 3 AND n % 6 >= 3 AND n % 3 - 1 > 0 AS newer, n % 7 < 3 AS o FROM s),
        g AS (SELECT *, CASE WHEN live AND kv THEN 'cache' WHEN b AND newer THEN 'exact' WHEN b THEN 'bundled' WHEN live THEN 'negative-cache' WHEN o THEN 'offers' WHEN e THEN 'exact' ELSE 'unavailable' END AS source FROM f)
        SELECT id, source, CASE source WHEN 'cache' THEN n WHEN 'exact' THEN n + 2000 WHEN 'bundled' THEN n + 1000 WHEN 'offers' THEN n + 3000 END AS median_cents FROM g""",
    "enrich_identity": """SELECT p_partkey AS id, CASE WHEN ok THEN d ELSE p_size END AS year, CASE WHEN ok THEN s_name ELSE p_brand END AS make, CASE WHEN ok THEN 'x' ELSE p_type END AS model, CASE WHEN ok THEN 'vin-decoded' ELSE 'listing' END AS match_basis
        FROM (SELECT p.*, s_name, 1975 + s_suppkey % 60 AS d, coalesce(1975 + s_suppkey % 60 BETWEEN 1981 AND 2025, false) AS ok FROM part p LEFT JOIN supplier ON p_partkey % 5 > 0 AND p_partkey % 300 = s_suppkey)""",
    "attach_details": """SELECT p_partkey AS id, s_suppkey + s_suppkey % 3 * 300 AS detail_id, CASE WHEN p_partkey % 5 = 0 THEN 'missing-vin' WHEN s_suppkey IS NULL THEN 'not-found' WHEN s_suppkey + s_suppkey % 3 * 300 <> p_partkey THEN 'id-mismatch' WHEN p_partkey % 2 <> 1 THEN 'sale-mismatch' ELSE '' END AS error_code
        FROM part LEFT JOIN supplier ON p_partkey % 5 > 0 AND p_partkey % 300 = s_suppkey""",
}
ORACLE_SQL["resolve_in_one"] = f"""WITH b AS ({VALUED} SELECT id, median_cents, CASE WHEN confidence < 0.4 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY ELSE TIMESTAMP '{AS_OF}' END AS as_of FROM valued WHERE status = 'available'),
    e AS ({ORACLE_SQL["exact_identity_valuation"]}), o AS ({ORACLE_SQL["market_offer_valuation"]}),
    k AS (SELECT id, CASE WHEN sample_size >= 3 THEN median_cents END AS median_cents, CASE WHEN sample_size < 3 THEN 60 - sample_size % 48 * 20 > 0 ELSE 24 - sample_size % 48 > 0 END AS live FROM o),
    s AS (SELECT 'lot:' || p_partkey AS id FROM part),
    f AS (SELECT s.id, k.median_cents AS km, coalesce(k.live, false) AS live, b.median_cents AS bm, e.median_cents AS em, o.median_cents AS om, coalesce(e.sample_size >= 3 AND TIMESTAMP '{AS_OF}' > b.as_of, false) AS newer
        FROM s LEFT JOIN k USING (id) LEFT JOIN b USING (id) LEFT JOIN e USING (id) LEFT JOIN o USING (id)),
    g AS (SELECT *, CASE WHEN live AND km IS NOT NULL THEN 'cache' WHEN bm IS NOT NULL AND newer THEN 'exact' WHEN bm IS NOT NULL THEN 'bundled' WHEN live THEN 'negative-cache' WHEN om IS NOT NULL THEN 'offers' WHEN em IS NOT NULL THEN 'exact' ELSE 'unavailable' END AS source FROM f)
    SELECT id, source, CASE source WHEN 'cache' THEN km WHEN 'exact' THEN em WHEN 'bundled' THEN bm WHEN 'offers' THEN om END::BIGINT AS median_cents FROM g"""
