"""Valuation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.operators import comparables, forecasts, valuation
from gavelflow.plans.bindings import AS_OF, ctes, view

CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def value_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.value_subjects(view(spark, sf_dir, "subjects"), view(spark, sf_dir, "comps"), AS_OF, classes=CLASSES)


def match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparables.tier_counts(view(spark, sf_dir, "subjects"), view(spark, sf_dir, "comps"), 2002, classes=CLASSES)


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparables.candidate_pool(view(spark, sf_dir, "subjects"), view(spark, sf_dir, "comps"))


def valuation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.valuation_snapshot(value_subjects(spark, sf_dir))


def comparable_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted comparables of all subjects as outcomes of a forecast."""
    matches = comparables.match_comparables(view(spark, sf_dir, "subjects"), view(spark, sf_dir, "comps"), 2002, classes=CLASSES)
    return forecasts.anchors_of_matches(valuation.adjusted_samples(matches, F.lit(AS_OF).cast("timestamp"))).drop("ended_at")


QUERIES = {f.__name__: f for f in (value_subjects, match_tiers, candidate_pool, valuation_snapshot, comparable_anchors)}

COND = "CASE {} WHEN 'new' THEN 5 WHEN 'usable' THEN 4 WHEN 'repairable' THEN 2 WHEN 'salvage' THEN 1 WHEN 'scrap' THEN 0 ELSE 3 END"
OPER = "CASE {} WHEN 'runs-and-drives' THEN 3 WHEN 'runs' THEN 2 WHEN 'non-operational' THEN 0 ELSE 1 END"
CBAND = "CASE WHEN {0} IN ('new', 'usable') THEN 'normal' WHEN {0} = 'repairable' THEN 'repairable' WHEN {0} IN ('salvage', 'scrap') THEN 'terminal' ELSE 'unknown' END"
OBAND = "CASE WHEN {0} IN ('runs', 'runs-and-drives') THEN 'mobile' WHEN {0} = 'non-operational' THEN {0} ELSE 'unknown' END"


def _near(recent: int, older: int, least: int, share: float, ceiling: int, wide: float, narrow: float) -> str:
    return f"""abs(s.year - c.year) <= CASE WHEN 2002 - s.year <= 4 THEN {recent} ELSE {older} END
        AND abs(s.mileage - c.mileage) <= greatest({least}::DOUBLE, s.mileage * {share}::DOUBLE)
        AND CASE WHEN least(s.mileage, c.mileage) < 1000 THEN greatest(s.mileage, c.mileage) <= {ceiling}
            ELSE greatest(s.mileage::DOUBLE / c.mileage, c.mileage::DOUBLE / s.mileage) <= CASE WHEN s.mileage < 25000 THEN {wide} ELSE {narrow} END END"""


C1, C2 = CBAND.format("s.condition"), CBAND.format("c.condition")
O1, O2 = OBAND.format("s.operability"), OBAND.format("c.operability")
TIGHT = f"({_near(2, 3, 20000, 0.5, 25000, 3, 1.75)} AND ({C1} = 'unknown' OR {C2} = 'unknown' OR {C1} = {C2}) AND ({O1} = 'unknown' OR {O2} = 'unknown' OR {O1} = {O2}) AND s.class = c.class)"
FAMILY = f"({_near(3, 5, 40000, 0.75, 40000, 4, 2.25)} AND ({C1} = 'unknown' OR {C2} = 'unknown' OR {C1} = {C2} OR ({C1} <> 'terminal' AND {C2} <> 'terminal')) AND ({O1} = 'unknown' OR {O2} = 'unknown' OR {O1} = {O2}) AND s.class = c.class)"
CLASS = f"({_near(1, 2, 15000, 0.35, 15000, 2.75, 1.5)} AND {C1} = {C2} AND {O1} = {O2} AND s.class = c.class)"


def _match(identity: str) -> str:
    return f"""round({identity} * (0.35 + exp(-abs(s.year - c.year) / 5.0) * 0.65)
        * (0.35 + CASE WHEN s.mileage > 0 AND c.mileage > 0 THEN exp(-abs(ln(s.mileage::DOUBLE / c.mileage)) / 0.75) ELSE 0.4 END * 0.65)
        * (0.55 + exp(-abs({COND.format('s.condition')} - {COND.format('c.condition')}) / 2.5) * 0.45)
        * (0.75 + exp(-abs({OPER.format('s.operability')} - {OPER.format('c.operability')}) / 2.0) * 0.25), 9)"""


PAIRS = f"""{ctes('comps', 'subjects')},
    latest AS (SELECT * FROM comps WHERE vin IS NULL UNION ALL
        (SELECT * FROM comps WHERE vin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vin ORDER BY ended_at DESC, auction_id) = 1)),
    family_pairs AS (
        SELECT s.id, s.year AS s_year, s.mileage AS s_mileage, s.condition AS s_condition, s.operability AS s_operability, s.issues AS s_issues, c.*,
               CASE WHEN {TIGHT} THEN 1 ELSE 2 END AS tier, {_match('1.0')} AS score
        FROM subjects s JOIN latest c ON s.family = c.family AND s.external_id <> c.auction_id AND coalesce(s.vin <> c.vin, true) AND {FAMILY}),
    class_all AS (
        SELECT s.id, s.year AS s_year, s.mileage AS s_mileage, s.condition AS s_condition, s.operability AS s_operability, s.issues AS s_issues, c.*,
               3 AS tier, CASE WHEN s.family = c.family THEN {_match('1.0')} ELSE {_match('0.58')} END AS score
        FROM subjects s JOIN latest c ON s.class = c.class AND s.external_id <> c.auction_id AND coalesce(s.vin <> c.vin, true) AND {CLASS}
        WHERE s.id NOT IN (SELECT id FROM family_pairs)),
    class_pairs AS (SELECT * FROM class_all WHERE id IN (SELECT id FROM class_all GROUP BY id HAVING count(*) >= 3 AND count(DISTINCT family) >= 2)),
    pairs AS (SELECT * FROM family_pairs UNION ALL SELECT * FROM class_pairs)"""

VALUED = f"""{PAIRS},
    best AS (SELECT * FROM pairs QUALIFY tier = min(tier) OVER (PARTITION BY id)),
    ranked AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ended_at DESC, auction_id) <= 15),
    adjusted AS (
        SELECT id, tier, auction_id, ended_at, abs(s_mileage - mileage) AS gap, (floor(round((least(greatest(score, 0), 1)) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) AS match,
            greatest(1, floor(closed_high_bid_cents * least(greatest(
                least(greatest(exp((s_year - year) * 0.045), 0.7), 1.4)
                * CASE WHEN s_mileage <> 0 AND mileage <> 0 THEN least(greatest(pow(mileage::DOUBLE / s_mileage, 0.28), 0.65), 1.45) ELSE 1.0 END
                * least(greatest(exp(({COND.format('s_condition')} - {COND.format('condition')}) * 0.12), 0.72), 1.35)
                * least(greatest(exp(({OPER.format('s_operability')} - {OPER.format('operability')}) * 0.1), 0.75), 1.3)
                * least(greatest(exp((issues - s_issues) * 0.035), 0.8), 1.25), 0.45), 1.8) + 0.5::DOUBLE))::BIGINT AS value,
            floor(greatest(0.01, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.78 ELSE 0.48 END * score
                * exp(-greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ended_at)) / 86400000000.0) / 365)) * 1e6 + 0.5::DOUBLE)::BIGINT AS weight
        FROM ranked),
    medians AS (SELECT id, count(*) AS n, floor(quantile_cont(value, 0.5) + 0.5::DOUBLE) AS med FROM adjusted GROUP BY id),
    marked AS (SELECT a.*, n, value * 3 >= med AND value <= med * 3 AS near FROM adjusted a JOIN medians USING (id)),
    kept AS (SELECT * FROM marked QUALIFY NOT (n >= 5 AND count(*) FILTER (near) OVER (PARTITION BY id) >= n // 2 + 1) OR near),
    running AS (SELECT *, sum(weight) OVER (PARTITION BY id ORDER BY value RANGE UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY id) AS total,
        row_number() OVER (PARTITION BY id ORDER BY gap NULLS LAST, match DESC, ended_at DESC, auction_id) AS shown FROM kept),
    summed AS (
        SELECT id, min(tier) AS tier, min(value) FILTER (run * 10 >= total * 2) AS q2, min(value) FILTER (run * 10 >= total * 5) AS q5, min(value) FILTER (run * 10 >= total * 8) AS q8,
            count(*) AS n, sum(weight / 1e6) AS w, sum((weight / 1e6) * (weight / 1e6)) AS ww, avg(match) AS m,
            string_agg(auction_id, ',' ORDER BY shown) FILTER (shown <= 12) AS shown
        FROM running GROUP BY id),
    sized AS (SELECT *, CASE tier WHEN 1 THEN 0.82 WHEN 2 THEN 0.58 ELSE 0.25 END AS cap, w * w / ww AS ess, (q8 - q2)::DOUBLE / q5 AS spread FROM summed),
    valued AS (
        SELECT s.id, CASE WHEN tier IS NULL THEN 'unavailable' ELSE 'available' END AS status,
            CASE tier WHEN 1 THEN 'family-year-mileage' WHEN 2 THEN 'family' WHEN 3 THEN 'body-class' END AS match_basis,
            q2 AS low_cents, q5 AS median_cents, q8 AS high_cents, coalesce(n, 0) AS sample_size,
            coalesce((floor(round((least(cap, CASE WHEN ess < 1.5 THEN 0.28 WHEN ess < 2.5 THEN 0.4 ELSE cap END,
                cap * (0.18 + 0.82 * (1 - exp(-ess / 4))) * (0.55 + m * 0.45) * least(greatest(1 - greatest(0.0, spread - 0.45) * 0.55, 0.35), 1.0))) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE), 0.0)::DOUBLE AS confidence,
            coalesce(shown, '') AS comparables
        FROM subjects s LEFT JOIN sized USING (id))"""

ORACLE_SQL = {
    "value_subjects": f"{VALUED} SELECT * FROM valued",
    "comparable_anchors": f"""{VALUED} SELECT id, auction_id AS outcome_id, value AS close_cents, match AS match_score, weight / 1e6 AS weight, tier = 1 AND match >= 0.85 AS exact_model FROM adjusted""",
    "match_tiers": f"""{PAIRS},
        best AS (SELECT id, tier FROM pairs QUALIFY tier = min(tier) OVER (PARTITION BY id)),
        counted AS (SELECT id, min(tier) AS tier, count(*) AS candidates FROM best GROUP BY id)
        SELECT id, tier, coalesce(candidates, 0) AS candidates FROM subjects LEFT JOIN counted USING (id)""",
    "candidate_pool": f"""{ctes('comps', 'subjects')},
        near AS (SELECT s.id, c.auction_id, 'family' AS by, row_number() OVER (PARTITION BY s.id ORDER BY abs(s.year - c.year), abs(s.mileage - c.mileage), c.ended_at DESC, c.auction_id) AS rank
            FROM subjects s JOIN comps c ON s.family = c.family AND s.external_id <> c.auction_id AND coalesce(s.vin <> c.vin, true)
            AND abs(s.year - c.year) <= 5 AND abs(s.mileage - c.mileage) <= greatest(40000, s.mileage * 0.75)),
        wide AS (SELECT s.id, c.auction_id, 'class' AS by, row_number() OVER (PARTITION BY s.id ORDER BY abs(s.year - c.year), abs(s.mileage - c.mileage), c.ended_at DESC, c.auction_id) AS rank
            FROM subjects s JOIN comps c ON s.class = c.class AND s.external_id <> c.auction_id AND coalesce(s.vin <> c.vin, true)
            AND abs(s.year - c.year) <= 2 AND abs(s.mileage - c.mileage) <= greatest(15000, s.mileage * 0.35) WHERE s.id NOT IN (SELECT id FROM near))
        SELECT * FROM near WHERE rank <= 200 UNION ALL SELECT * FROM wide WHERE rank <= 200""",
    "valuation_snapshot": f"""{VALUED}
        SELECT count(*) AS subjects, count(*) FILTER (status = 'available') AS valued, count(*) FILTER (status <> 'available') AS unavailable,
            count(*) FILTER (match_basis = 'family-year-mileage') AS family_year_mileage, count(*) FILTER (match_basis = 'family') AS family,
            count(*) FILTER (match_basis = 'body-class') AS body_class FROM valued""",
}
