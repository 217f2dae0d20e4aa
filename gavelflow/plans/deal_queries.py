"""Forecasts, assessments and bid histories as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.functions import deals as D
from gavelflow.operators import assessment, forecasts, history
from gavelflow.plans.bindings import STREAM_NOW, ctes, view

COSTS = D.Costs(buyer_premium_rate=0.1, purchase_tax_rate=0.05, transport=10_000, title=20_000, inspection=30_000, repairs=40_000, storage=50_000, risk_reserve=60_000)
TARGET = D.Target()


def safe_max_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "deals").filter("low_cents IS NOT NULL")
    value = F.col("low_cents")
    cost = D.cost_breakdown(F.coalesce("current_bid_cents", F.lit(0)), value, COSTS)
    return rows.select("id", D.safe_max_bid(value, COSTS, TARGET).alias("safe_max_bid"), D.break_even_bid(value, COSTS).alias("break_even_bid"), cost.alias("c")).select(
        "id", "safe_max_bid", "break_even_bid", "c.buyer_premium", "c.purchase_tax", "c.selling_fee", "c.acquisition", "c.all_in"
    )


def assess_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assessment.assess_deals(view(spark, sf_dir, "deals"), COSTS, TARGET)
    return out.select(
        "id", "status", "score", "tier", "conservative_value_cents", "expected_close_cents", "safe_max_bid_cents", "break_even_bid_cents", "projected_profit_cents",
        "downside_profit_cents", "roi", "discount_to_value", "probability_profitable", "probability_win", "confidence", F.array_join("reason_codes", ",").alias("reason_codes"),
    )


def closing_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = view(spark, sf_dir, "open_lots").select("id", F.coalesce("current_bid_cents", F.lit(0)).alias("current_bid_cents"))
    seen = history.last_write_wins(view(spark, sf_dir, "outcomes"), ["id", "outcome_id"], [F.desc("seen"), F.col("close_cents")])
    outcomes = seen.select("id", "outcome_id", F.col("close_cents").alias("final_price_cents"), F.when(F.col("seen") % 3 == 0, F.floor(F.col("close_cents") / 2)).cast("long").alias("bid_at_time_cents"), "match_score")
    return forecasts.closing_forecast(lots, outcomes)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bid_observations")


def reference_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(STREAM_NOW).cast("timestamp")
    lots = view(spark, sf_dir, "open_lots").withColumnRenamed("n", "number")
    seen = view(spark, sf_dir, "outcomes")
    outcomes = forecasts.valid_outcomes(history.last_write_wins(seen, ["id", "seen"], [F.col("outcome_id"), F.col("close_cents"), F.col("match_score"), F.col("weight")]), "id", "seen")
    observed = forecasts.valid_observations(_observations(spark, sf_dir).drop("event_id"), now)
    bids = lots.select(F.col("number").alias("auction_id"), (F.col("current_bid_cents") % 10_000).alias("current_bid_cents"))
    trends = forecasts.bid_aggression(observed, bids).select(F.col("auction_id").cast("string").alias("id"), "aggression", "observations")
    return forecasts.reference_forecast(lots, outcomes, trends, now)


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.change_points(_observations(spark, sf_dir), ("bidders", "status", "ends_at")).select("event_id", "auction_id", "bidders", "status")


def extension_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.extension_count(_observations(spark, sf_dir)).select("event_id", "auction_id", "extension_count")


def last_n_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_n_observations(_observations(spark, sf_dir)).select("event_id", "auction_id", "bid_cents", "age_rank")


def effective_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.effective_end(_observations(spark, sf_dir)).select("event_id", F.unix_micros("effective_ends_at").alias("effective_ends_us"))


def carry_forward_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.carry_forward_bid(_observations(spark, sf_dir)).select("event_id", "carried_bid_cents")


QUERIES = {
    f.__name__: f
    for f in (safe_max_bid, assess_deals, closing_forecast, reference_forecast, change_points, extension_count, last_n_observations, effective_end, carry_forward_bid)
}


def _r(x: str) -> str:
    return f"floor({x} + 0.5::DOUBLE)::BIGINT"


def _cost(b: str) -> str:
    premium = _r(f"{b} * 0.1::DOUBLE")
    tax = _r(f"({b} + {premium}) * 0.05::DOUBLE")
    return f"({b} + {premium} + {tax})"


FEE = _r("low_cents * 0.08::DOUBLE")


def _ceiling(required: str) -> str:
    budget = f"(low_cents - {FEE} - 210000 - {required})"
    near = f"floor({budget} / (1.1::DOUBLE * 1.05::DOUBLE))::BIGINT"
    return f"""coalesce((SELECT max(b) FROM (SELECT {near} + unnest(generate_series(-3, 3)) AS b) WHERE b >= 0 AND b <= low_cents AND {_cost('b')} <= {budget}), 0)"""


SAFE, EVEN = _ceiling(f"greatest(150000, {_r('low_cents * 0.12::DOUBLE')})"), _ceiling("0")


def _p(x: str) -> str:
    return f"""CASE WHEN forecast_low <= forecast_expected AND forecast_expected <= forecast_high THEN
        CASE WHEN {x} < forecast_low THEN 0.0 WHEN {x} >= forecast_high THEN 1.0
             WHEN {x} <= forecast_expected THEN CASE WHEN forecast_expected = forecast_low THEN 0.5 ELSE 0.5::DOUBLE * ({x} - forecast_low) / (forecast_expected - forecast_low) END
             ELSE CASE WHEN forecast_high = forecast_expected THEN 1.0 ELSE 0.5::DOUBLE + 0.5::DOUBLE * ({x} - forecast_expected) / (forecast_high - forecast_expected) END END END"""


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


ORDER = "OVER (PARTITION BY auction_id ORDER BY observed_at, event_id)"
SO_FAR = "OVER (PARTITION BY auction_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)"


def _anchor(o: str, v: str) -> str:
    return f"CASE WHEN n > 0 AND valued THEN floor(round(o{o} * (1 - share) + {v} * share, 6) + 0.5::DOUBLE) WHEN n > 0 THEN o{o} WHEN valued THEN {v} END"


def _step(x: str) -> str:
    return f"(floor(round(({x}) / 10000::DOUBLE, 9) + 0.5::DOUBLE) * 10000)"


def _ahead(x: str) -> str:
    return f"current_bid_cents + tw * greatest(0.0, {x} - current_bid_cents)"


ORACLE_SQL = {
    "safe_max_bid": f"""{ctes('deals')}, b AS (SELECT *, coalesce(current_bid_cents, 0) AS bid FROM deals WHERE low_cents IS NOT NULL)
        SELECT id, {SAFE} AS safe_max_bid, {EVEN} AS break_even_bid, {_r('bid * 0.1::DOUBLE')} AS buyer_premium,
            {_r('(bid + ' + _r('bid * 0.1::DOUBLE') + ') * 0.05::DOUBLE')} AS purchase_tax, {FEE} AS selling_fee,
            {_cost('bid')} + 210000 AS acquisition, {_cost('bid')} + 210000 + {FEE} AS all_in FROM b""",
    "assess_deals": f"""{ctes('deals')},
        a AS (SELECT *, CASE WHEN valuation_status <> 'unavailable' AND low_cents > 0 THEN low_cents END AS val,
                CASE WHEN forecast_status <> 'insufficient' AND forecast_expected >= current_bid_cents THEN forecast_expected END AS exp,
                CASE WHEN forecast_status <> 'insufficient' THEN greatest(current_bid_cents, forecast_high) END AS hi FROM deals),
        b AS (SELECT *, val IS NOT NULL AND current_bid_cents IS NOT NULL AS known FROM a),
        c AS (SELECT *, CASE WHEN known THEN {SAFE} END AS safe, CASE WHEN known THEN {EVEN} END AS even,
                CASE WHEN known THEN {_cost('exp')} + 210000 + {FEE} END AS all_in, CASE WHEN known THEN val - ({_cost('hi')} + 210000 + {FEE}) END AS downside FROM b),
        d AS (SELECT *, CASE WHEN known THEN val - all_in END AS profit, CASE WHEN known THEN (val - all_in)::DOUBLE / greatest(1, all_in) END AS r,
                CASE WHEN known THEN (val - coalesce(exp, current_bid_cents))::DOUBLE / val END AS disc,
                CASE WHEN known THEN {_p('safe')} END AS win, CASE WHEN known THEN {_p('even')} END AS prof,
                valuation_status = 'provider' AND forecast_status = 'available' AS priced FROM c),
        e AS (SELECT *, CASE WHEN known THEN (floor(round(({_clamp(f"({_clamp('valuation_confidence')} * 0.45::DOUBLE + CASE WHEN forecast_status <> 'insufficient' THEN {_clamp('forecast_confidence')} ELSE 0.0::DOUBLE END * 0.4::DOUBLE + {_clamp('coalesce(data_confidence, 1.0::DOUBLE)')} * 0.15::DOUBLE) * CASE WHEN priced THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END")}) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) ELSE 0.0 END AS conf FROM d),
        f AS (SELECT *, {_clamp('(disc + 0.05::DOUBLE) / 0.45::DOUBLE')} * 30 + CASE WHEN safe <= 0 THEN 0.0::DOUBLE ELSE {_clamp('(safe - current_bid_cents)::DOUBLE / safe')} END * 25
                + coalesce({_clamp('r / 0.25::DOUBLE')}, 0.0) * 20 + (coalesce(prof, 0.0::DOUBLE) + coalesce(win, 0.0::DOUBLE)) / 2 * 15 + conf * 10 AS raw,
                current_bid_cents > even OR coalesce(profit < 0, false) AS lost,
                priced AND current_bid_cents <= safe AND coalesce(profit >= 150000, false) AND coalesce(win >= 0.35, false) AND conf >= 0.5 AS meets FROM e),
        g AS (SELECT *, CASE WHEN NOT known THEN 'insufficient' WHEN lost THEN 'avoid' WHEN meets THEN 'actionable' ELSE 'watch' END AS status,
                CASE WHEN known THEN floor(least(greatest(round(raw, 9), 0), 100) + 0.5::DOUBLE)::BIGINT ELSE 0 END AS score FROM f)
        SELECT id, status, score, CASE WHEN status = 'actionable' AND score >= 75 THEN 1 WHEN status IN ('actionable', 'watch') AND score >= 55 THEN 2 WHEN status = 'watch' AND score >= 30 THEN 3 ELSE 4 END AS tier,
            val AS conservative_value_cents, exp AS expected_close_cents, safe AS safe_max_bid_cents, even AS break_even_bid_cents, profit AS projected_profit_cents, downside AS downside_profit_cents,
            (floor(round((r) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) AS roi, (floor(round((disc) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) AS discount_to_value, (floor(round((prof) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) AS probability_profitable, (floor(round((win) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) AS probability_win, conf AS confidence,
            concat_ws(',', CASE WHEN current_bid_cents IS NULL THEN 'CURRENT_BID_UNAVAILABLE' END,
                CASE WHEN val IS NULL THEN 'VALUATION_UNAVAILABLE' WHEN valuation_status = 'reference-only' THEN 'REFERENCE_ONLY_VALUATION' END,
                CASE forecast_status WHEN 'insufficient' THEN 'FORECAST_INSUFFICIENT' WHEN 'reference-only' THEN 'REFERENCE_ONLY_FORECAST' END,
                CASE WHEN NOT known THEN NULL WHEN lost THEN 'ABOVE_BREAK_EVEN' WHEN meets THEN 'MEETS_PROFIT_AND_CONFIDENCE_THRESHOLDS' WHEN current_bid_cents > safe THEN 'ABOVE_SAFE_MAX_BID' ELSE 'MONITOR_BELOW_SAFE_MAX_BID' END) AS reason_codes
        FROM g""",
    "closing_forecast": f"""{ctes('open_lots', 'outcomes')},
        seen AS (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY id, outcome_id ORDER BY seen DESC, close_cents) = 1),
        est AS (SELECT l.id, greatest(coalesce(current_bid_cents, 0), {_r("CASE WHEN seen % 3 = 0 AND close_cents // 2 > 0 THEN coalesce(current_bid_cents, 0) * (close_cents::DOUBLE / (close_cents // 2)) ELSE close_cents END")}) AS e, match_score, seen % 3 = 0 AND close_cents // 2 > 0 AS curve
            FROM open_lots l JOIN seen USING (id) WHERE trim(outcome_id) <> '' AND close_cents > 0),
        told AS (SELECT id, {_r('quantile_cont(e, 0.2)')} AS lo, {_r('quantile_cont(e, 0.5)')} AS mid, {_r('quantile_cont(e, 0.8)')} AS hi, avg({_clamp('coalesce(match_score, 0.65::DOUBLE)')}) AS m,
            count(*) AS n, count(*) FILTER (match_score >= 0.9) AS ex, count(*) FILTER (curve) AS cu FROM est GROUP BY id)
        SELECT id, CASE WHEN n >= 5 THEN 'available' ELSE 'insufficient' END AS status, CASE WHEN n >= 5 THEN lo END AS low_cents, CASE WHEN n >= 5 THEN mid END AS expected_cents, CASE WHEN n >= 5 THEN hi END AS high_cents,
            CASE WHEN n >= 5 THEN (floor(round((least(greatest(m * 0.55::DOUBLE + least(n / 20, 1.0::DOUBLE) * 0.3::DOUBLE + cu / n * 0.15::DOUBLE, 0.0), 0.95)) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) ELSE 0.0 END AS confidence,
            coalesce(n, 0) AS sample_size, coalesce(ex, 0) AS exact_models, coalesce(cu, 0) AS curves FROM (SELECT id FROM open_lots) LEFT JOIN told USING (id)""",
    "reference_forecast": f"""{ctes('open_lots', 'outcomes', 'bid_observations')},
        single AS (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY id, seen ORDER BY outcome_id NULLS FIRST, close_cents NULLS FIRST, match_score NULLS FIRST, weight NULLS FIRST) = 1),
        good AS (SELECT id, outcome_id, seen, close_cents, {_clamp('coalesce(match_score, 0.65::DOUBLE)')} AS m, coalesce(weight, 1.0::DOUBLE) AS w FROM single),
        used AS (SELECT *, {_r('least(10.0::DOUBLE, w) * m * m * 1e8')} AS iw FROM good WHERE trim(outcome_id) <> '' AND close_cents > 0 AND m >= 0.45 AND w > 0 QUALIFY row_number() OVER (PARTITION BY id, outcome_id ORDER BY seen DESC) = 1),
        run AS (SELECT *, sum(iw) OVER (PARTITION BY id ORDER BY close_cents) AS cum, sum(iw) OVER (PARTITION BY id) AS total FROM used),
        told AS (SELECT id, avg(m) AS m, count(*) AS n, min(close_cents) FILTER (cum * 10 >= total * 2) AS o2, min(close_cents) FILTER (cum * 10 >= total * 5) AS o5, min(close_cents) FILTER (cum * 10 >= total * 8) AS o8 FROM run GROUP BY id),
        obs AS (SELECT DISTINCT auction_id, observed_at, bid_cents FROM bid_observations WHERE observed_at <= TIMESTAMP '{STREAM_NOW}' AND bid_cents >= 0),
        lastn AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY auction_id ORDER BY observed_at DESC, bid_cents DESC) <= 24),
        mine AS (SELECT n AS auction_id, id, observed_at, bid_cents, open_lots.current_bid_cents % 10000 AS bid FROM lastn JOIN open_lots ON auction_id = n),
        earlier AS (SELECT *, (bid_cents > lag(bid_cents) OVER (PARTITION BY id ORDER BY observed_at, bid_cents))::INT AS rise FROM mine WHERE bid_cents <= bid),
        trend AS (SELECT id, CASE WHEN count(*) >= 2 AND max(bid) > 0 THEN {_clamp(f"{_clamp('(max(bid) - arg_min(bid_cents, observed_at))::DOUBLE / greatest(max(bid), 1)')} * 0.7::DOUBLE + least(1.0::DOUBLE, coalesce(sum(rise), 0) / 5) * 0.3::DOUBLE")} ELSE 0.0 END AS aggr FROM earlier GROUP BY id),
        seen AS (SELECT id, count(*) AS seen FROM mine GROUP BY id),
        a AS (SELECT l.* EXCLUDE (n), coalesce(t.n, 0) AS n, coalesce(m, 0.0) AS m, o2, o5, o8, coalesce(aggr, 0.0) AS aggr, coalesce(seen, 0) AS seen,
                coalesce(valuation_status <> 'unavailable' AND valuation_confidence >= 0.2 AND low_cents > 0 AND low_cents <= median_cents AND median_cents <= high_cents, false) AS valued,
                least(greatest(3.0::DOUBLE / (coalesce(t.n, 0) + 3), 0.12), 0.5) AS share,
                CASE WHEN ends_at IS NOT NULL THEN greatest(0, floor((epoch_us(ends_at) - epoch_us(TIMESTAMP '{STREAM_NOW}')) / 1000000))::BIGINT END AS hz
            FROM open_lots l LEFT JOIN told t USING (id) LEFT JOIN trend USING (id) LEFT JOIN seen USING (id)),
        b AS (SELECT *, {_anchor('2', 'low_cents')} AS al, {_anchor('5', 'median_cents')} AS am, {_anchor('8', 'high_cents')} AS ah,
                CASE WHEN bidder_count >= 0 THEN {_clamp('ln(1 + bidder_count::DOUBLE) / 2.3978952727983707::DOUBLE')} ELSE 0.0 END AS eng,
                CASE WHEN valued THEN {_clamp('valuation_confidence')} ELSE 0.0::DOUBLE END AS vc,
                CASE WHEN hz IS NULL THEN 0.55 WHEN hz <= 0 THEN 0 WHEN hz < 60 THEN 0.1 WHEN hz < 300 THEN 0.2 WHEN hz < 1800 THEN 0.35 WHEN hz < 21600 THEN 0.55 WHEN hz < 86400 THEN 0.7 WHEN hz < 604800 THEN 0.8 ELSE 0.9 END::DOUBLE AS base FROM a),
        c AS (SELECT *, round(least(greatest(base * (1 + eng * 0.05::DOUBLE + aggr * 0.08::DOUBLE), 0.0), 0.92), 12) AS tw, current_bid_cents >= ah AS above FROM b),
        d AS (SELECT *, CASE WHEN above AND NOT coalesce(hz = 0, false) THEN current_bid_cents + least(greatest(10000.0::DOUBLE, greatest(0, ah - al) * 0.15::DOUBLE), greatest(10000.0::DOUBLE, current_bid_cents * 0.05::DOUBLE)) * tw ELSE {_ahead('ah')} END AS rh,
                CASE WHEN current_bid_cents IS NULL THEN greatest(10000, {_step('al')}) ELSE greatest(current_bid_cents, {_step(_ahead('al'))}) END AS lo FROM c),
        e AS (SELECT *, greatest(lo, CASE WHEN current_bid_cents IS NULL THEN {_step('am')} ELSE {_step(_ahead('am + (ah - am) * aggr * 0.2::DOUBLE'))} END) AS mi FROM d),
        f AS (SELECT *, greatest(mi, CASE WHEN current_bid_cents IS NULL THEN {_step('ah')} ELSE {_step('rh')} END) AS hi,
                CASE WHEN ends_at IS NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS ue FROM e)
        SELECT id, CASE WHEN am IS NULL THEN 'insufficient' ELSE 'reference-only' END AS status, CASE WHEN am IS NOT NULL THEN lo END::BIGINT AS low_cents, CASE WHEN am IS NOT NULL THEN mi END::BIGINT AS expected_cents, CASE WHEN am IS NOT NULL THEN hi END::BIGINT AS high_cents,
            CASE WHEN am IS NULL THEN 0.0 WHEN current_bid_cents IS NULL THEN (floor(round((least(greatest((0.06::DOUBLE + least(0.14::DOUBLE, n * 0.012::DOUBLE) * m + vc * 0.1::DOUBLE) * ue, 0.03), 0.28)) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE)
                ELSE (floor(round((least(greatest((0.08::DOUBLE + least(0.12::DOUBLE, n * 0.012::DOUBLE) * m + vc * 0.1::DOUBLE + least(0.025::DOUBLE, seen * 0.005::DOUBLE)) * ue * CASE WHEN above THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END, 0.03), 0.35)) * 10000.0::DOUBLE, 6) + 0.5::DOUBLE) / 10000.0::DOUBLE) END AS confidence,
            hz AS horizon_seconds, CASE WHEN am IS NULL THEN 0 ELSE n END AS sample_size FROM f""",
    "change_points": f"""{ctes('bid_observations')}
        SELECT event_id, auction_id, bidders, status FROM bid_observations
        QUALIFY lag(1) {ORDER} IS NULL OR bidders IS DISTINCT FROM lag(bidders) {ORDER} OR status IS DISTINCT FROM lag(status) {ORDER} OR ends_at IS DISTINCT FROM lag(ends_at) {ORDER}""",
    "extension_count": f"""{ctes('bid_observations')}, m AS (SELECT *, coalesce((ends_at > lag(ends_at) {ORDER})::INT, 0) AS moved FROM bid_observations)
        SELECT event_id, auction_id, sum(moved) {SO_FAR} AS extension_count FROM m""",
    "last_n_observations": f"""{ctes('bid_observations')}
        SELECT event_id, auction_id, bid_cents, row_number() OVER (PARTITION BY auction_id ORDER BY observed_at DESC, event_id DESC) AS age_rank FROM bid_observations QUALIFY age_rank <= 24""",
    "effective_end": f"""{ctes('bid_observations')} SELECT event_id, epoch_us(max(ends_at) {SO_FAR}) AS effective_ends_us FROM bid_observations""",
    "carry_forward_bid": f"""{ctes('bid_observations')} SELECT event_id, last_value(bid_cents IGNORE NULLS) {SO_FAR} AS carried_bid_cents FROM bid_observations""",
}
