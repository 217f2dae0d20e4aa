"""Domain views over the given star schema, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2002-01-01 00:00:00"
#: Inside the order dates.
AUCTION_NOW = "1998-06-15 00:00:00"
#: After the last event.
STREAM_NOW = "2024-01-31 00:00:00"

VIEWS = {
    "comps": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS auction_id,
               p_brand AS family, p_type AS class, CAST(year(l_shipdate) AS INT) AS year, CAST(l_quantity * 4000 AS BIGINT) AS mileage,
               CASE l_returnflag WHEN 'A' THEN 'usable' WHEN 'N' THEN 'repairable' WHEN 'R' THEN 'salvage' ELSE 'unknown' END AS condition,
               CASE l_linestatus WHEN 'O' THEN 'runs' WHEN 'F' THEN 'non-operational' ELSE 'unknown' END AS operability,
               CASE WHEN l_linenumber % 2 = 0 THEN lpad(CAST(l_partkey AS STRING), 17, '0') END AS vin,
               CAST(l_linenumber % 3 AS INT) AS issues,
               CAST(floor(CAST(l_extendedprice AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS closed_high_bid_cents,
               CAST(l_shipdate AS TIMESTAMP) AS ended_at, n_name AS state
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "comp_updates": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS external_id, 'lots' AS source_key,
               CAST(l_shipdate AS TIMESTAMP) AS observed_at, CAST(l_shipdate AS TIMESTAMP) AS ended_at,
               CAST(floor(CAST(l_extendedprice AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS closed_high_bid_cents,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_quantity * 4000 AS BIGINT) END AS mileage,
               CASE WHEN l_linestatus = 'O' THEN lpad(CAST(l_partkey AS STRING), 17, '0') END AS vin,
               l_partkey AS part_id, l_suppkey AS supplier_id
        FROM lineitem""",
    "subjects": """
        SELECT concat('lot:', CAST(p_partkey AS STRING)) AS id, CAST(p_partkey AS STRING) AS external_id, p_brand AS family, p_type AS class,
               CAST(1995 + p_partkey % 7 AS INT) AS year, CAST(p_size AS BIGINT) * 4000 AS mileage,
               CASE p_partkey / 20 % 4 WHEN 0 THEN 'usable' WHEN 1 THEN 'repairable' WHEN 2 THEN 'salvage' ELSE 'unknown' END AS condition,
               CASE p_partkey % 3 WHEN 0 THEN 'runs-and-drives' WHEN 1 THEN 'non-operational' ELSE 'unknown' END AS operability,
               CAST(lpad(CAST(p_partkey AS STRING), 17, '0') AS STRING) AS vin, CAST(p_partkey % 2 AS INT) AS issues
        FROM part""",
    "auctions": """
        SELECT 'lots' AS source_key, CAST(o_orderkey AS STRING) AS external_id,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'preview' ELSE 'ended' END AS status,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(CAST(o_totalprice AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS current_bid_cents,
               CAST(o_orderkey % 9 AS INT) AS bidder_count,
               CAST(o_orderdate AS TIMESTAMP) AS starts_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY AS ends_at,
               n_name AS state, c_mktsegment AS segment, o_custkey AS seller_id, o_orderpriority AS priority, o_orderkey AS n
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "bid_observations": """
        SELECT user_id AS auction_id, CAST(ts AS TIMESTAMP) AS observed_at,
               CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(CAST(value AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS bid_cents,
               CAST(event_id % 5 AS INT) AS bidders,
               CASE event_type WHEN 'error' THEN 'ended' ELSE 'active' END AS status,
               date_trunc('day', CAST(ts AS TIMESTAMP)) + INTERVAL '1' DAY AS ends_at, event_id
        FROM events""",
    "deals": """
        SELECT concat('lots:', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS n,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(CAST(o_totalprice AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS current_bid_cents,
               CASE o_orderkey % 4 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'reference-only' ELSE 'provider' END AS valuation_status,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(CAST(o_totalprice AS DOUBLE) * (8 + o_orderkey % 13) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS low_cents,
               CAST(o_orderkey % 11 AS DOUBLE) / 10 AS valuation_confidence,
               CASE o_orderkey % 5 WHEN 0 THEN 'insufficient' WHEN 1 THEN 'reference-only' ELSE 'available' END AS forecast_status,
               CAST(floor(CAST(o_totalprice AS DOUBLE) * (9 + o_orderkey % 3)) AS BIGINT) AS forecast_low,
               CAST(floor(CAST(o_totalprice AS DOUBLE) * (10 + o_orderkey % 4)) AS BIGINT) AS forecast_expected,
               CAST(floor(CAST(o_totalprice AS DOUBLE) * (13 + o_orderkey % 2)) AS BIGINT) AS forecast_high,
               CAST(o_orderkey % 9 AS DOUBLE) / 8 AS forecast_confidence,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS DOUBLE) / 5 END AS data_confidence
        FROM orders""",
    "board": """
        SELECT concat('lot-', CAST(o_orderkey AS STRING)) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'lots' ELSE 'fleet' END AS source, concat(c_mktsegment, ' ', o_orderpriority) AS title,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad(CAST(o_orderkey AS STRING), 17, '0') END AS vin, c_name AS city,
               CASE WHEN n_nationkey = 3 THEN ' unknown ' WHEN n_nationkey = 4 THEN '' WHEN n_nationkey = 5 THEN ' tx' ELSE n_name END AS state,
               c_mktsegment AS body_style, 'make' AS make, o_orderpriority AS model, CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' WHEN 2 THEN 'repairable' ELSE 'salvage' END AS condition,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'preview' ELSE 'ended' END AS status,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(CAST(o_totalprice AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS current_bid_cents,
               CAST(o_orderkey * 7 % 101 AS BIGINT) AS score, CAST(o_orderkey % 20 AS DOUBLE) / 20 AS confidence,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey * 131 % 900000 - 300000 AS BIGINT) END AS projected_profit_cents,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey * 17 % 9000 - 3000 AS DOUBLE) / 10000 END AS discount_to_value,
               CASE WHEN o_orderkey % 5 = 0 THEN 'unavailable' ELSE 'provider' END AS valuation_status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS BIGINT) END AS median_cents,
               CAST(o_orderdate AS TIMESTAMP) AS starts_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY + CAST(o_orderkey % 60 AS INT) * INTERVAL '1' MINUTE AS ends_at,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '5' DAY + CAST(o_orderkey % 50 AS INT) * INTERVAL '1' HOUR AS last_checked_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "checks": """
        SELECT CAST(ts AS TIMESTAMP) AS checked_at, CAST(event_id % 2 AS INT) AS success, CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'partial' END AS coverage FROM events""",
    "state_checks": """
        SELECT n_name AS state, CAST(event_id % 2 AS INT) AS success, CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'partial' END AS coverage
        FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_type = 'purchase'""",
    "seen_auctions": """
        SELECT CAST(event_id AS STRING) AS external_id, event_id AS auction_id, CASE WHEN event_id % 4 = 0 THEN 'fleet' ELSE 'lots' END AS source_key, CAST(event_id % 3 AS INT) AS bidder_count, CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'preview' WHEN 'purchase' THEN 'closing' WHEN 'error' THEN 'ended' ELSE 'sold' END AS status,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(CAST(value AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS current_bid_cents,
               CAST(ts AS TIMESTAMP) AS last_seen_at, CAST(ts AS TIMESTAMP) + CAST(event_id % 90 AS INT) * INTERVAL '1' MINUTE AS ends_at,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) - CAST(event_id % 70 AS INT) * INTERVAL '1' MINUTE END AS last_checked_at
        FROM events""",
    "vehicles": """
        SELECT event_id AS auction_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE lpad(CAST(event_id AS STRING), 17, '0') END AS vin, CAST(2000 + event_id % 20 AS INT) AS year, 'make' AS make,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS model, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id * 13 % 200000 END AS mileage,
               CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'usable' ELSE 'salvage' END AS condition, CAST(ts AS TIMESTAMP) AS updated_at
        FROM events""",
    "live_auctions": """
        SELECT o_orderkey AS auction_id, 'lots' AS source_key, CAST(o_orderkey AS STRING) AS external_id,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(CAST(o_totalprice AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS current_bid_cents, CAST(o_orderkey % 9 AS INT) AS bidder_count,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'preview' ELSE 'sold' END AS status, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY AS ends_at,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '3' DAY AS last_checked_at, CAST(o_orderdate AS TIMESTAMP) AS price_changed_at,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY END AS ended_at, CAST(NULL AS BIGINT) AS final_bid_cents, CAST(NULL AS STRING) AS final_status,
               CAST(o_orderkey % 3 AS INT) AS extension_count
        FROM orders""",
    "live_checks": """
        SELECT o_orderkey AS auction_id, CAST(o_orderkey AS STRING) AS external_id,
               CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(floor(CAST(o_totalprice AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) + l_partkey % 3 * 500 END AS current_bid_cents, CAST(o_orderkey % 9 + l_linenumber % 2 AS INT) AS bidder_count,
               CASE WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN 'ended' ELSE 'active' END AS status,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY + CAST(l_suppkey % 3 AS INT) * INTERVAL '1' HOUR AS ends_at, CAST(o_orderdate AS TIMESTAMP) + CAST(l_linenumber AS INT) * INTERVAL '1' DAY AS last_checked_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "order_vehicles": """
        SELECT o_orderkey AS auction_id, lpad(CAST(o_orderkey AS STRING), 17, '0') AS vin, CAST(2000 + o_orderkey % 20 AS INT) AS year, 'make' AS make, o_orderpriority AS model, o_orderkey % 200000 AS mileage
        FROM orders""",
    "raw_lots": """
        SELECT concat('gsa:sale:', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_clerk END AS sale_number, CAST(o_orderkey % 100 AS STRING) AS lot_number,
               CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE concat(CAST(1990 + o_orderkey % 30 AS STRING), ' ', c_mktsegment, ' ', o_orderpriority) END AS title,
               CASE WHEN o_orderkey % 2 = 0 THEN concat('https://x.example/preview/', CAST(o_orderkey AS STRING)) END AS url, CASE o_orderstatus WHEN 'O' THEN 'active' ELSE 'scheduled' END AS status,
               CAST(o_orderdate AS TIMESTAMP) AS starts_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY AS ends_at, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 90001 AS DOUBLE) / 4 END AS current_bid,
               CAST(o_orderkey % 9 AS INT) AS bidder_count, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE c_name END AS city, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE n_name END AS state, CAST(NULL AS STRING) AS postal_code,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(2001 AS INT) END AS year, CASE WHEN o_orderkey % 8 = 0 THEN 'Ford' END AS make, CASE WHEN o_orderkey % 9 = 0 THEN 'F150' END AS model_label,
               CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE lpad(CAST(o_orderkey AS STRING), 17, '0') END AS vin, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderkey % 200000 END AS mileage, c_mktsegment AS body_type,
               CASE o_orderkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'usable' WHEN 2 THEN 'repairable' WHEN 3 THEN 'scrap' ELSE 'unknown' END AS condition, 'unknown' AS operability, o_comment_like AS description, o_orderkey % 17 = 0 AS open_recall,
               CASE WHEN o_orderkey % 10 < 3 THEN 'frame-damage' ELSE 'no_key' END AS flag
        FROM (SELECT *, concat('Lot of ', o_orderpriority) AS o_comment_like, concat('S', CAST(o_custkey AS STRING)) AS o_clerk FROM orders) AS o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "raw_fleet": """
        SELECT CAST(o_orderkey AS STRING) AS source_id, o_orderkey AS n, concat('fleet:', CAST(o_orderkey AS STRING)) AS external_key, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad(CAST(o_orderkey AS STRING), 17, '0') END AS vin,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'S1' END AS sale_number, CASE WHEN o_orderkey % 2 = 0 THEN '7' END AS sale_run_number, CAST(2000 + o_orderkey % 20 AS INT) AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'FORD' ELSE 'Ram' END AS make,
               CASE o_orderkey % 4 WHEN 0 THEN 'GR CHEROKEE' WHEN 1 THEN 'Transit' WHEN 2 THEN 'TITAN' END AS model, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 100000 END AS mileage, 'SUV' AS vehicle_type,
               CASE o_orderkey % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'X' ELSE '?' END AS condition_code, CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'internet' END AS channel, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'coming' ELSE 'closed' END AS phase,
               CAST(o_orderdate AS TIMESTAMP) AS starts_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY AS effective_ends_at, o_orderkey * 3 AS high_bid_cents, 'u' AS url, CAST(NULL AS STRING) AS city, 'TX' AS state, CAST(NULL AS STRING) AS postal_code,
               o_orderkey % 6 = 0 AS detailed
        FROM orders""",
    "outcomes": """
        SELECT CAST(l_suppkey AS STRING) AS id, concat(CAST(l_partkey % 37 AS STRING), '-', l_returnflag) AS outcome_id, l_orderkey * 10 + l_linenumber AS seen,
               CAST(floor(CAST(l_extendedprice AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS close_cents,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey % 21 AS DOUBLE) / 20 END AS match_score,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_quantity AS DOUBLE) / 4 - 1 END AS weight
        FROM lineitem""",
    "open_lots": """
        SELECT CAST(s_suppkey AS STRING) AS id, s_suppkey AS n,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 7 * 1000000 + s_suppkey * 137 AS BIGINT) END AS current_bid_cents,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 13 AS INT) END AS bidder_count,
               CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2024-01-30 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-31 00:20:00' WHEN 3 THEN TIMESTAMP '2024-01-31 09:00:00' ELSE TIMESTAMP '2024-02-20 00:00:00' END AS ends_at,
               CASE s_suppkey % 3 WHEN 0 THEN 'unavailable' ELSE 'available' END AS valuation_status,
               CAST(2000000 + s_suppkey * 1000 AS BIGINT) AS low_cents, CAST(3000000 + s_suppkey * 1500 AS BIGINT) AS median_cents, CAST(5000000 + s_suppkey * 2500 AS BIGINT) AS high_cents,
               CAST(s_suppkey % 10 AS DOUBLE) / 10 AS valuation_confidence
        FROM supplier""",
    "offers": """
        SELECT p_brand AS family, CAST(year(l_shipdate) AS INT) AS year, p_type AS trim, CAST(l_quantity * 4000 AS BIGINT) AS mileage,
               CAST(floor(CAST(l_extendedprice AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS offer_cents
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}

BASE = {
    "comps": ["lineitem", "part", "supplier", "nation"],
    "comp_updates": ["lineitem"],
    "subjects": ["part"],
    "auctions": ["orders", "customer", "nation"],
    "bid_observations": ["events"],
    "offers": ["lineitem", "part"],
    "deals": ["orders"],
    "board": ["orders", "customer", "nation"],
    "checks": ["events"],
    "state_checks": ["events", "nation"],
    "seen_auctions": ["events"],
    "vehicles": ["events"],
    "live_auctions": ["orders"],
    "live_checks": ["lineitem", "orders"],
    "order_vehicles": ["orders"],
    "raw_lots": ["orders", "customer", "nation"],
    "raw_fleet": ["orders"],
    "outcomes": ["lineitem"],
    "open_lots": ["supplier"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("p_partkey / 20 % 4", "p_partkey div 20 % 4")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE[name]}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **tables)


def ctes(*names: str) -> str:
    """WITH clause of these views, for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace('p_partkey / 20 % 4', 'p_partkey // 20 % 4')})" for n in names)
