"""Market text, intervals against predictions and extremes, decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally.functions import fees as FE
from skytally.functions import market as K
from skytally.functions.stats import normal_cdf_sql
from skytally.functions.timeparse import infer_year_date
from skytally.functions.units import half_up, interval_label, midpoint_f, rounding_bounds_f, tidy
from skytally.operators import markets as M
from skytally.plans.registry import query, r

# Text --------------------------------------------------------------------------------------------------------
SQL_TITLE = r"'(?i)^\s*(highest|lowest)\s+temperature\s+in\s+(.+?)\s+on\s+([a-z]+\s+\d{1,2})\??\s*$'"


@query(
    "par3_event_title", "questions",
    f"SELECT market_id, CASE WHEN k <> '' THEN upper(k[1]) || lower(k[2:]) END AS kind, nullif(c, '') AS city, nullif(d, '') AS month_day FROM (SELECT market_id, regexp_extract(title, {SQL_TITLE}, 1) AS k, regexp_extract(title, {SQL_TITLE}, 2) AS c, regexp_extract(title, {SQL_TITLE}, 3) AS d FROM questions)",
)
def par3(v):
    kind, city, day = K.title_parts(F.col("title"))
    return v.questions.select("market_id", kind.alias("kind"), city.alias("city"), day.alias("month_day"))


@query(
    "par4_year_inference", "questions",
    f", q AS (SELECT market_id, today, try_strptime(regexp_extract(title, {SQL_TITLE}, 3) || ' ' || year(today), '%B %d %Y') AS d, try_strptime(regexp_extract(title, {SQL_TITLE}, 3) || ' ' || (year(today) + 1), '%B %d %Y') AS n FROM questions)"
    " SELECT market_id, CAST(CASE WHEN CAST(d AS DATE) < today - 180 THEN n ELSE d END AS DATE) AS event_date FROM q",
)
def par4(v):
    return v.questions.select("market_id", infer_year_date(K.title_parts(F.col("title"))[2], F.col("today")).alias("event_date"))


@query(
    "par5_unit_inference", "questions",
    "SELECT market_id, CASE WHEN contains(l, 'celsius') OR contains(l, '°c') THEN 'C' WHEN contains(l, 'fahrenheit') OR contains(l, '°f') THEN 'F' ELSE 'F' END AS unit, CASE WHEN contains(l, 'celsius') THEN 'C' WHEN contains(l, 'fahrenheit') THEN 'F' ELSE 'C' END AS survey_unit FROM (SELECT market_id, lower(question) AS l FROM questions)",
)
def par5(v):
    return v.questions.select("market_id", K.infer_unit(F.col("question"), F.lit("f")).alias("unit"), K.survey_unit(F.col("question")).alias("survey_unit"))


@query(
    "par6_temperature_rule", "questions",
    r""", t AS (SELECT market_id, replace(replace(question, '–', '-'), '—', '-') AS t FROM questions), u AS (SELECT *, lower(t) AS l, CASE WHEN contains(lower(t), 'celsius') OR contains(lower(t), '°c') THEN 'C' ELSE 'F' END AS iu,
      regexp_extract_all(t, '(?i)(-?\d+(?:\.\d+)?)\s*(?:deg(?:rees?)?|°)?\s*([FC])?', 1) AS ns, regexp_extract_all(t, '(?i)(-?\d+(?:\.\d+)?)\s*(?:deg(?:rees?)?|°)?\s*([FC])?', 2) AS us FROM t),
    n AS (SELECT *, CAST(ns[1] AS DOUBLE) AS a, CASE WHEN regexp_matches(t, '\d\s*-\s*\d') AND CAST(ns[1] AS DOUBLE) >= 0 AND CAST(ns[2] AS DOUBLE) < 0 THEN abs(CAST(ns[2] AS DOUBLE)) ELSE CAST(ns[2] AS DOUBLE) END AS b FROM u),
    k AS (SELECT *, b IS NOT NULL AND (regexp_matches(l, '\b(between|from|to|through|range)\b') OR regexp_matches(t, '\d\s*-\s*\d')) AS rg, regexp_matches(l, '\b(at\s+or\s+above|or\s+higher|or\s+more|at\s+least|above|over|greater\s+than)\b') AS ab,
      regexp_matches(l, '\b(at\s+or\s+below|or\s+lower|or\s+less|at\s+most|below|under|less\s+than)\b') AS be FROM n)
    SELECT market_id, CASE WHEN a IS NULL THEN NULL WHEN rg THEN least(a, b) WHEN ab THEN a WHEN be THEN NULL ELSE a END AS rule_min, CASE WHEN a IS NULL THEN NULL WHEN rg THEN greatest(a, b) WHEN ab THEN NULL WHEN be THEN a ELSE a END AS rule_max,
      CASE WHEN a IS NOT NULL AND coalesce(us[1], '') <> '' THEN upper(us[1]) ELSE iu END AS unit FROM k""",
)
def par6(v):
    rule = v.questions.select("market_id", K.temperature_rule(F.col("question"), F.lit("F")).alias("r"))
    return rule.select("market_id", "r.*")


@query(
    "par7_outcome_values", "markets",
    f"SELECT market_id, CASE WHEN market_id % 10 = 0 THEN NULL ELSE {r('coalesce(yes_price, 0)')} END AS yes, CASE WHEN market_id % 10 = 0 THEN NULL WHEN market_id % 3 = 0 THEN {r('1 - coalesce(yes_price, 0)')} ELSE 0.25e0 END AS no, CASE WHEN market_id % 10 = 0 THEN NULL ELSE no_asset END AS no_token FROM markets",
)
def par7(v):
    names = F.when(F.col("market_id") % 3 == 0, '["Yes"]').when(F.col("market_id") % 2 == 0, '["yes ", "No"]').otherwise('"[\\"Yes\\",\\"NO\\"]"')
    df = v.markets.select(
        "market_id", names.alias("names"), F.when(F.col("market_id") % 10 == 0, "broken").otherwise(F.format_string('["%s","0.25"]', F.coalesce("yes_price", F.lit(0.0)).cast("string"))).alias("prices"),
        F.when(F.col("market_id") % 10 == 0, "").otherwise(F.format_string('["%s","%s"]', "yes_asset", "no_asset")).alias("tokens"))
    n, p, t = [K.jsonish_list(F.col(c)) for c in ("names", "prices", "tokens")]
    two = F.array(F.lit("Yes"), F.lit("No"))
    yes, no = K.pick_by_outcome(n, p, "yes").try_cast("double"), K.pick_by_outcome(n, p, "no").try_cast("double")
    return df.select("market_id", tidy(yes).alias("yes"), tidy(K.no_price(no, yes)).alias("no"), K.pick_by_outcome(two, t, "no").alias("no_token"))


@query(
    "par8_source_station", "markets",
    "SELECT market_id, CASE market_id % 6 WHEN 0 THEN concat('K', right(concat('00', CAST(event_id % 1000 AS VARCHAR)), 3)) WHEN 1 THEN concat('Q', right(concat('00', CAST(event_id % 1000 AS VARCHAR)), 3)) WHEN 2 THEN 'LTFM' WHEN 3 THEN 'HAND' ELSE '' END AS station,"
    " CASE market_id % 6 WHEN 0 THEN 'history' WHEN 1 THEN 'history' WHEN 2 THEN 'timeseries' WHEN 3 THEN 'manual' ELSE 'none' END AS source FROM markets",
)
def par8(v):
    code = F.expr("right(concat('00', event_id % 1000), 3)")
    m = F.col("market_id") % 6
    base = "See https://www.wunderground.com/history/daily/us/tx/x/"
    text = (
        F.when(m == 0, F.concat(F.lit(base + "k"), code, F.lit("/date/2024-1-5?cm_ven=x) for it"))).when(m == 1, F.concat(F.lit(base + "Q"), code, F.lit("/ now")))
        .when(m == 2, F.lit("https://example.org/wrh/timeseries?site=ltfm&hours=72")).when(m == 4, F.lit(base + "toolong")).otherwise(F.lit("no link"))
    )
    df = v.markets.select("market_id", text.alias("text"), F.when(m == 3, "HAND").otherwise("").alias("hand"))
    return M.with_source_station(df, "text", "hand").select("market_id", "station", "source")


# Projections -------------------------------------------------------------------------------------------------
@query(
    "prj3_interval_bounds", "markets",
    f"SELECT market_id, {r('coalesce(CASE WHEN unit = $$C$$ THEN rule_min * 9.0e0 / 5.0e0 + 32.0e0 ELSE rule_min END - 0.5, CAST($$-inf$$ AS DOUBLE))')} AS lower_f, {r('coalesce(CASE WHEN unit = $$C$$ THEN rule_max * 9.0e0 / 5.0e0 + 32.0e0 ELSE rule_max END + 0.5, CAST($$inf$$ AS DOUBLE))')} AS upper_f,"
    f" {r('CASE WHEN unit = $$C$$ THEN ((rule_min * 9.0e0 / 5.0e0 + 32.0e0) + (rule_max * 9.0e0 / 5.0e0 + 32.0e0)) / 2 ELSE (rule_min + rule_max) / 2 END')} AS midpoint_f,"
    " CASE WHEN rule_min IS NULL THEN concat('<=', CAST(CAST(rule_max AS BIGINT) AS VARCHAR), unit) WHEN rule_max IS NULL THEN concat('>=', CAST(CAST(rule_min AS BIGINT) AS VARCHAR), unit) ELSE concat(CAST(CAST(rule_min AS BIGINT) AS VARCHAR), '-', CAST(CAST(rule_max AS BIGINT) AS VARCHAR), unit) END AS label FROM markets",
)
def prj3(v):
    a = [F.col(c) for c in ("rule_min", "rule_max", "unit")]
    lower, upper = rounding_bounds_f(*a)
    return v.markets.select("market_id", tidy(lower).alias("lower_f"), tidy(upper).alias("upper_f"), tidy(midpoint_f(*a)).alias("midpoint_f"), interval_label(*a, F.col("market_id")).alias("label"))


@query(
    "prj7_quote_probability", "venue",
    f"SELECT ticker, {r('least(1, greatest(0, CASE WHEN yes_bid > 0 AND yes_ask > 0 THEN (yes_bid + yes_ask) / 2 WHEN last_price > 0 THEN last_price WHEN yes_bid > 0 THEN yes_bid WHEN yes_ask > 0 THEN yes_ask END))')} AS p FROM venue WHERE (yes_bid > 0 OR yes_ask > 0 OR last_price > 0)",
)
def prj7(v):
    p = K.quote_probability(F.col("yes_bid"), F.col("yes_ask"), F.col("last_price"))
    return v.venue.select("ticker", tidy(p).alias("p")).filter("p IS NOT NULL")


@query(
    "prj8_prj9_price_moves", "trades",
    ", q AS (SELECT trade_id, (trade_id % 101) / 100.0e0 AS a, (trade_id % 89) / 80.0e0 AS b, coalesce(position_side, 'YES') AS s FROM trades), c AS (SELECT *, least(0.999999, greatest(0, a)) AS p, least(1, greatest(0, b)) AS n FROM q)"
    f" SELECT trade_id, {r('p + 0.3 * (1 - p)')} AS target, {r('CASE WHEN n >= p THEN (n - p) / greatest(1e-9, 1 - p) WHEN p <= 0 THEN 0 ELSE (p - n) / p END')} AS moved, CASE WHEN s = 'NO' THEN 'YES' ELSE 'NO' END AS opposite, {r('least(1, greatest(0, 1 - b))')} AS complement FROM c",
)
def prj8(v):
    a, b = (F.col("trade_id") % 101) / 100.0, (F.col("trade_id") % 89) / 80.0
    return v.trades.select("trade_id", tidy(K.move_target(a, 0.3)).alias("target"), tidy(K.move_fraction(a, b)).alias("moved"),
                           K.opposite(F.coalesce("position_side", F.lit("YES"))).alias("opposite"), tidy(K.clamp01(1.0 - b)).alias("complement"))


@query(
    "prj6_prj10_fees_and_tiers", "trades",
    ", q AS (SELECT trade_id, shares, (trade_id % 101) / 100.0e0 AS p, (trade_id % 89) / 88.0e0 AS f FROM trades), z AS (SELECT *, 0.02 * least(0.99, greatest(0.01, p)) * (1 - least(0.99, greatest(0.01, p))) AS fp, 0.02 * least(0.99, greatest(0.01, f)) * (1 - least(0.99, greatest(0.01, f))) AS ff FROM q)"
    f" SELECT trade_id, {r('0.05 * shares * p * (1 - p)')} AS fee, {r('f - p - 0.05 * p * (1 - p)')} AS edge, {r('(greatest(0, f - ff) - (p + fp)) / (p + fp)')} AS profit,"
    " (SELECT CAST(first(t.w ORDER BY t.u) AS DOUBLE) FROM (VALUES " + ", ".join(f"({u}, {w})" for u, w in FE.PROFIT_TIERS) + ") AS t(u, w) WHERE z.p > 0 AND z.p <= t.u + 1e-9) AS tier FROM z",
)
def prj6(v):
    p, f = (F.col("trade_id") % 101) / 100.0, (F.col("trade_id") % 89) / 88.0
    return v.trades.select("trade_id", tidy(FE.taker_fee(F.col("shares"), p, 0.05)).alias("fee"), tidy(FE.edge_after_fee(f, p, 0.05)).alias("edge"),
                           tidy(FE.expected_profit(p, f, 0.02)).alias("profit"), FE.required_profit(p).alias("tier"))


# Intervals against predictions -------------------------------------------------------------------------------
CONT = "(m.rule_min IS NULL OR p.value >= m.rule_min) AND (m.rule_max IS NULL OR p.value <= m.rule_max)"
FIN = "m.rule_min IS NOT NULL AND m.rule_max IS NOT NULL"


@query("joi9_unique_market", "preds markets", f"SELECT p.pred_id, min(m.market_id) AS market_id FROM preds p JOIN markets m ON p.event_id = m.event_id AND {CONT} GROUP BY 1 HAVING count(*) = 1")
def joi9(v):
    return M.unique_market(v.preds, v.markets)


@query(
    "joi9_rounded_market", "preds markets",
    ", q AS (SELECT pred_id, event_id, CAST(floor(predicted_f + 0.5) AS BIGINT) AS rounded_f, CASE WHEN unit = 'C' THEN (floor(predicted_f + 0.5) - 32.0e0) * 5.0e0 / 9.0e0 ELSE floor(predicted_f + 0.5) END AS value FROM preds)"
    f" SELECT p.pred_id, min(m.market_id) AS market_id, min(rounded_f) AS rounded_f FROM q p JOIN markets m ON p.event_id = m.event_id AND {FIN} AND {CONT} GROUP BY 1 HAVING count(*) = 1",
)
def joi9b(v):
    return M.rounded_market(v.preds, v.markets)


SQL_PAIR = (
    f", pr AS (SELECT p.pred_id, p.event_id, count(*) FILTER (WHERE {CONT}) AS matches, min(struct_pack(a := m.rule_min, b := m.rule_max, c := m.market_id)) FILTER (WHERE {CONT}) AS x, max(struct_pack(a := m.rule_min, b := m.rule_max, c := m.market_id)) FILTER (WHERE {CONT}) AS y,"
    " first(m.market_id ORDER BY m.rule_max DESC, m.market_id) FILTER (WHERE m.rule_max < p.value) AS lo_id, first(m.market_id ORDER BY m.rule_min, m.market_id) FILTER (WHERE m.rule_min > p.value) AS up_id"
    f" FROM preds p JOIN markets m ON p.event_id = m.event_id AND {FIN} GROUP BY 1, 2), pairs AS (SELECT pred_id, event_id, matches, CASE WHEN matches = 2 THEN x.c ELSE lo_id END AS lower_id, CASE WHEN matches = 2 THEN y.c ELSE up_id END AS upper_id"
    " FROM pr WHERE matches = 2 OR (matches = 0 AND lo_id IS NOT NULL AND up_id IS NOT NULL))"
)


@query("joi10_adjacent_pair", "preds markets", SQL_PAIR + " SELECT pred_id, matches, lower_id, upper_id FROM pairs")
def joi10(v):
    return M.adjacent_pair(v.preds, v.markets)


@query(
    "joi11_boundary_snap", "preds markets",
    f", d AS (SELECT p.pred_id, m.market_id, CASE WHEN p.value < m.rule_min THEN m.rule_min - p.value WHEN p.value > m.rule_max THEN p.value - m.rule_max END AS g, CASE WHEN p.unit = 'C' THEN 0.35e0 * 5.0e0 / 9.0e0 ELSE 0.35e0 END AS tol FROM preds p JOIN markets m ON p.event_id = m.event_id AND {FIN})"
    f" SELECT pred_id, first(market_id ORDER BY g, CAST(market_id AS VARCHAR)) AS market_id, {r('min(g)')} AS distance FROM d WHERE g <= tol + 1e-9 GROUP BY 1",
)
def joi11(v):
    return M.boundary_snap(v.preds, v.markets, 0.35).withColumn("distance", tidy(F.col("distance")))


SQL_MASS = (
    ", pp AS (SELECT pred_id, event_id, unit, CAST(floor(predicted_f + 0.5) AS BIGINT) + i AS temp_f, (1 + cents * (i + 3) % 10) / (5.0e0 + cents * 1 % 10 + cents * 2 % 10 + cents * 3 % 10 + cents * 4 % 10 + cents * 5 % 10) AS pb FROM preds, (SELECT unnest([-2, -1, 0, 1, 2]) AS i)),"
    " pv AS (SELECT *, CASE WHEN unit = 'C' THEN (temp_f - 32.0e0) * 5.0e0 / 9.0e0 ELSE CAST(temp_f AS DOUBLE) END AS value FROM pp),"
    f" ms AS (SELECT p.pred_id, m.market_id, {r('sum(pb)')} AS probability FROM pv p JOIN markets m ON p.event_id = m.event_id AND {FIN} AND {CONT} GROUP BY 1, 2)"
)


def _probabilities(v):
    total = sum((F.col("cents") * j % 10 for j in range(1, 6)), F.lit(5.0))
    rows = v.preds.withColumn("i", F.explode(F.array(*[F.lit(i) for i in (-2, -1, 0, 1, 2)])))
    return rows.select("pred_id", "event_id", "unit", (half_up(F.col("predicted_f")) + F.col("i")).alias("temp_f"), ((1 + F.col("cents") * (F.col("i") + 3) % 10) / total).alias("p"))


@query("joi12_interval_mass", "preds markets", SQL_MASS + " SELECT * FROM ms")
def joi12(v):
    return M.interval_mass(_probabilities(v), v.markets).withColumn("probability", tidy(F.col("probability")))


@query("srt4_best_interval", "preds markets", SQL_MASS + " SELECT pred_id, first(market_id ORDER BY probability DESC, CAST(market_id AS VARCHAR)) AS market_id, max(probability) AS probability FROM ms WHERE probability >= 0.01 GROUP BY 1")
def srt4(v):
    return M.best_interval(M.interval_mass(_probabilities(v), v.markets).withColumn("probability", tidy(F.col("probability"))))


_UPF = "(CASE WHEN unit = 'C' THEN rule_max * 9.0e0 / 5.0e0 + 32.0e0 ELSE rule_max END + 0.5)"
_LOF = "(CASE WHEN unit = 'C' THEN rule_min * 9.0e0 / 5.0e0 + 32.0e0 ELSE rule_min END - 0.5)"


@query(
    "mkt4_joi13_interval_confidence", "preds markets calib",
    f", u AS (SELECT p.pred_id, upper(p.station) AS station, p.month, p.local_hour, p.predicted_f, m.market_id, m.rule_min, m.rule_max, m.unit FROM preds p JOIN markets m ON p.event_id = m.event_id AND {CONT}),"
    f" z AS (SELECT u.*, error_sigma_f AS s, (predicted_f - {_LOF} - error_mean_f) / nullif(error_sigma_f, 0) AS zt, (predicted_f - {_UPF} - error_mean_f) / nullif(error_sigma_f, 0) AS zl FROM u LEFT JOIN calib c ON u.station = c.station AND u.month = c.month AND u.local_hour = c.local_hour)"
    f" SELECT pred_id, market_id, CASE WHEN s > 0 THEN {r('greatest(0, least(1, CASE WHEN rule_min IS NULL THEN 1.0 ELSE ' + normal_cdf_sql('zt') + ' END - CASE WHEN rule_max IS NULL THEN 0.0 ELSE ' + normal_cdf_sql('zl') + ' END))')} END AS regressor_probability FROM z",
)
def mkt4(v):
    hits = M.containing(v.preds.drop("unit"), v.markets).select("pred_id", "station", "month", "local_hour", "predicted_f", "market_id")
    rows = hits.join(v.markets.select("market_id", "rule_min", "rule_max", "unit").hint("merge"), "market_id")
    return M.with_interval_confidence(rows, v.calib).select("pred_id", "market_id", tidy(F.col("regressor_probability")).alias("regressor_probability"))


SQL_SIG = ", q AS (SELECT trade_id, CASE WHEN trade_id % 11 = 0 THEN NULL ELSE (trade_id * 37 % 101) / 100.0e0 END AS r, CASE WHEN trade_id % 13 = 0 THEN NULL ELSE (trade_id * 53 % 101) / 100.0e0 END AS c, trade_id % 3 = 0 AS same FROM trades)"


def _signals(v):
    t = F.col("trade_id")
    return v.trades.select("trade_id", F.when(t % 11 != 0, (t * 37 % 101) / 100.0).alias("r"), F.when(t % 13 != 0, (t * 53 % 101) / 100.0).alias("c"), (t % 3 == 0).alias("same"))


@query("mkt5_combined_probability", "trades", SQL_SIG + f" SELECT trade_id, {r('CASE WHEN r IS NOT NULL AND c IS NOT NULL THEN least(1, greatest(0, 0.25 * c + 0.75 * r)) END')} AS p FROM q")
def mkt5(v):
    return _signals(v).select("trade_id", tidy(M.combined_probability(F.col("c"), F.col("r"), 1, 3)).alias("p"))


@query(
    "mkt6_signal_fusion", "trades",
    SQL_SIG + """, s AS (SELECT trade_id, CASE WHEN same THEN CASE WHEN coalesce(r >= 0.6, FALSE) OR coalesce(c >= 0.7, FALSE) THEN 'agreement' ELSE 'skip_agreement_below_thresholds' END
      WHEN r IS NULL AND c IS NULL THEN 'skip_no_probabilities'
      WHEN r IS NULL THEN CASE WHEN c >= 0.8 THEN 'classifier_takeover_missing_regressor_confidence' ELSE 'skip_classifier_below_takeover_without_regressor' END
      WHEN c IS NULL THEN CASE WHEN r >= 0.8 THEN 'regressor_takeover_missing_classifier_probability' ELSE 'skip_regressor_below_takeover_without_classifier' END
      WHEN abs(r - c) <= CAST(0.3 AS DOUBLE) THEN 'skip_disagreement_gap_too_small'
      WHEN c > r THEN CASE WHEN c >= 0.8 THEN 'classifier_takeover' ELSE 'skip_classifier_takeover_below_threshold' END
      WHEN r >= 0.8 THEN 'regressor_takeover' ELSE 'skip_regressor_takeover_below_threshold' END AS signal_reason FROM q)
    SELECT trade_id, signal_reason, CASE WHEN starts_with(signal_reason, 'skip') THEN NULL WHEN starts_with(signal_reason, 'classifier') THEN 'classifier' ELSE 'regressor' END AS signal_choice FROM s""",
)
def mkt6(v):
    return M.with_signal(_signals(v), "r", "c", "same").select("trade_id", "signal_reason", "signal_choice")


@query(
    "mkt7_price_candidates", "markets",
    f", q AS (SELECT *, [0.6e0, 0.7e0, 0.8e0][least(3, greatest(1, market_id % 7 - 1))] AS cap, 0.1e0 AS fl, {r('yes_price', 2)} AS p FROM markets), z AS (SELECT *, CASE WHEN rule_min IS NULL OR rule_max IS NULL THEN 'open_ended' WHEN yes_price IS NULL OR yes_price <= 0 THEN 'no_price' WHEN p < fl THEN 'below_floor' WHEN p > cap THEN 'above_cap' ELSE 'ok' END AS candidate_reason FROM q)"
    f" SELECT market_id, cap, candidate_reason, CASE WHEN candidate_reason = 'ok' THEN p END AS candidate_price, CASE WHEN candidate_reason = 'ok' THEN {r('cap - p')} END AS candidate_edge FROM z",
)
def mkt7(v):
    df = v.markets.withColumn("cap", M.price_cap(F.col("market_id") % 7, F.lit(2))).withColumn("fl", F.lit(0.1))
    out = M.with_candidate(df, "yes_price", "cap", "fl")
    return out.select("market_id", "cap", "candidate_reason", "candidate_price", tidy(F.col("candidate_edge")).alias("candidate_edge"))


SQL_NOQ = ", mq AS (SELECT *, CASE WHEN yes_price IS NULL THEN NULL ELSE greatest(0.0e0, least(1.0e0, 1.0e0 - yes_price)) * 0.6e0 END AS no_price FROM markets)"


def _quotes(v):
    return v.markets.withColumn("no_price", K.clamp01(1.0 - F.col("yes_price")) * 0.6)


@query(
    "mkt8_pair_plan", "preds markets",
    SQL_PAIR + SQL_NOQ + ", hd AS (SELECT market_id FROM markets WHERE market_id % 4 = 0),"
    f" lg AS (SELECT market_id, {r('yes_price', 2)} AS y, market_id IN (SELECT market_id FROM hd) AS h FROM mq), j AS (SELECT pairs.*, a.y AS ly, a.h AS lh, b.y AS uy, b.h AS uh FROM pairs JOIN lg a ON pairs.lower_id = a.market_id JOIN lg b ON pairs.upper_id = b.market_id),"
    f" k AS (SELECT j.*, ly + uy AS tot, CASE WHEN matches = 0 THEN (SELECT first(struct_pack(p := {r('m.no_price', 2)}, id := m.market_id) ORDER BY {r('m.no_price', 2)}, CAST(m.market_id AS VARCHAR)) FROM mq m WHERE m.event_id = j.event_id AND {FIN} AND m.no_price > 0 AND m.market_id <> j.lower_id AND m.market_id <> j.upper_id) END AS n FROM j),"
    " w AS (SELECT *, CASE WHEN ly IS NULL OR ly <= 0 OR uy IS NULL OR uy <= 0 THEN 'skip_missing_price' WHEN ly < 0.05 AND uy < 0.05 THEN 'skip_both_below_floor' WHEN ly < 0.05 THEN 'single_upper' WHEN uy < 0.05 THEN 'single_lower' WHEN n.p < tot AND n.p > 0.99 THEN 'skip_no_above_max' WHEN n.p < tot THEN 'buy_no_elsewhere'"
    " WHEN tot > 0.9 THEN 'skip_total_above_cap' WHEN lh AND uh THEN 'skip_both_held' WHEN lh THEN 'hedge_upper' WHEN uh THEN 'hedge_lower' ELSE 'both_legs' END AS plan FROM k)"
    f" SELECT pred_id, event_id, lower_id, upper_id, {r('tot')} AS pair_total, plan, CASE WHEN plan = 'buy_no_elsewhere' THEN n.id END AS no_market_id FROM w",
)
def mkt8(v):
    pairs = M.adjacent_pair(v.preds, v.markets).join(v.preds.select("pred_id", "event_id"), "pred_id")
    return M.pair_plan(pairs, _quotes(v), v.markets.filter("market_id % 4 = 0")).withColumn("pair_total", tidy(F.col("pair_total")))


@query(
    "joi23_venue_guard", "markets venue",
    ", q AS (SELECT event_id, ticker, (floor_strike + cap_strike) / 2 AS om, least(1, greatest(0, CASE WHEN yes_bid > 0 AND yes_ask > 0 THEN (yes_bid + yes_ask) / 2 WHEN last_price > 0 THEN last_price WHEN yes_bid > 0 THEN yes_bid WHEN yes_ask > 0 THEN yes_ask END)) AS p FROM venue WHERE yes_bid > 0 OR yes_ask > 0 OR last_price > 0),"
    " tp AS (SELECT event_id, ticker, om FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, ticker) AS x FROM q) WHERE x = 1),"
    " o AS (SELECT m.market_id, ticker, om, CASE WHEN unit = 'C' THEN ((rule_min * 9.0e0 / 5.0e0 + 32.0e0) + (rule_max * 9.0e0 / 5.0e0 + 32.0e0)) / 2 ELSE (rule_min + rule_max) / 2 END AS mid FROM markets m LEFT JOIN tp ON m.event_id = tp.event_id),"
    " z AS (SELECT *, CASE WHEN mid IS NULL THEN 'our_interval_midpoint_unavailable' WHEN ticker IS NULL THEN 'other_market_not_found' WHEN om IS NULL THEN 'other_interval_midpoint_unavailable' WHEN om - mid < 0 THEN 'our_midpoint_above_other' WHEN om - mid > 3 THEN 'other_midpoint_too_high' ELSE 'ok' END AS guard_reason FROM o)"
    f" SELECT market_id, guard_reason, guard_reason = 'ok' AS allowed, {r('om - mid')} AS mid_diff FROM z",
)
def joi23(v):
    return M.venue_guard(v.markets, v.venue, 3.0).select("market_id", "guard_reason", "allowed", tidy(F.col("mid_diff")).alias("mid_diff"))


# Intervals against extremes ----------------------------------------------------------------------------------
SQL_ST = (
    ", s AS (SELECT m.*, observed_high AS oh, observed_low AS ol, coalesce(CASE WHEN kind = 'Highest' THEN observed_high > rule_max ELSE observed_low < rule_min END, FALSE) AS impossible, CASE WHEN kind = 'Highest' THEN rule_max IS NULL OR observed_high IS NULL OR observed_high <= rule_max ELSE rule_min IS NULL OR observed_low IS NULL OR observed_low >= rule_min END AS possible_again,"
    " CASE WHEN kind = 'Highest' THEN observed_high IS NOT NULL AND (rule_min IS NULL OR observed_high >= rule_min) AND (rule_max IS NULL OR observed_high <= rule_max) ELSE observed_low IS NOT NULL AND (rule_min IS NULL OR observed_low >= rule_min) AND (rule_max IS NULL OR observed_low <= rule_max) END AS extreme_reached"
    " FROM markets m JOIN extremes e ON m.event_id = e.event_id), d AS (SELECT *, CASE WHEN kind = 'Highest' THEN oh - rule_max ELSE rule_min - ol END AS distance, coalesce(rule_max - rule_min, 9999) AS width,"
    " CASE WHEN kind = 'Highest' THEN rule_max - oh ELSE ol - rule_min END AS ahead, CASE WHEN kind = 'Highest' THEN 1 ELSE -1 END AS sg FROM s)"
)


def _state(v):
    return M.with_extremes(v.markets, v.extremes)


@query("mkt1_mkt2_market_state", "markets extremes", SQL_ST + " SELECT market_id, impossible, possible_again, extreme_reached FROM s")
def mkt1(v):
    return M.with_state(_state(v)).select("market_id", "impossible", "possible_again", "extreme_reached")


@query("flt5_reachable_markets", "markets extremes", SQL_ST + " SELECT market_id, event_id FROM s WHERE possible_again")
def flt5(v):
    return M.reachable(_state(v)).select("market_id", "event_id")


_ORD = "sg * coalesce(rule_min, -9999), sg * coalesce(rule_max, 9999), sg * market_id"


@query("srt1_market_order", "markets", f", d AS (SELECT *, CASE WHEN kind = 'Highest' THEN 1 ELSE -1 END AS sg FROM markets WHERE NOT closed) SELECT market_id, event_id, row_number() OVER (PARTITION BY event_id ORDER BY {_ORD}) AS position FROM d")
def srt1(v):
    return M.ordered(v.markets).select("market_id", "event_id", "position")


@query("srt1_outer_boundary", "markets", f", d AS (SELECT *, CASE WHEN kind = 'Highest' THEN 1 ELSE -1 END AS sg FROM markets WHERE NOT closed), o AS (SELECT event_id, kind, market_id, row_number() OVER (PARTITION BY event_id ORDER BY {_ORD}) AS p, count(*) OVER (PARTITION BY event_id) AS n FROM d) SELECT event_id, kind, market_id FROM o WHERE p = n")
def srt1b(v):
    return M.outer_boundary(v.markets)


@query("srt2_impossible_by_distance", "markets extremes", SQL_ST + " SELECT market_id, event_id, distance, row_number() OVER (PARTITION BY event_id ORDER BY distance, width, market_id) AS rank FROM d WHERE impossible AND NOT closed")
def srt2(v):
    return M.impossible_by_distance(_state(v)).select("market_id", "event_id", "distance", "rank")


@query(
    "srt3_nearest_no_market", "markets extremes",
    SQL_ST + f" SELECT event_id, kind, coalesce(first(market_id ORDER BY distance, width, market_id) FILTER (WHERE impossible), first(market_id ORDER BY ahead, width, market_id) FILTER (WHERE ahead >= 0), first(market_id ORDER BY {_ORD})) AS market_id FROM d WHERE NOT closed GROUP BY 1, 2",
)
def srt3(v):
    return M.nearest_no_market(_state(v))


@query(
    "mkt3_position_checks", "trades markets extremes",
    SQL_ST + ", t AS (SELECT t.trade_id, t.status, coalesce(t.position_side, 'YES') AS side, t.trade_id % 7 = 0 AS momentum, t.trade_id % 5 = 0 AS moved, t.trade_id % 3 = 0 AS stg, t.trade_id % 2 = 0 AS src, (t.trade_id % 41) / 10.0e0 AS age, s.* EXCLUDE (closed) FROM trades t JOIN s ON t.market_id = s.market_id WHERE t.status IN ('OPEN', 'HEDGED')),"
    " c AS (SELECT *, CASE WHEN momentum THEN 'invalidated_price_momentum' WHEN moved THEN 'inconsistent_after_price_move' WHEN stg AND src THEN 'invalidated_post_buy_validation' WHEN age >= 2 THEN 'not_verified_in_time' END AS why FROM t),"
    " e AS (SELECT trade_id, why, CASE WHEN (kind = 'Highest' AND oh IS NULL) OR (kind <> 'Highest' AND ol IS NULL) THEN 'unknown' WHEN status = 'HEDGED' THEN CASE WHEN possible_again THEN 'unwind' ELSE 'hold' END WHEN (side = 'NO' AND impossible) OR (side <> 'NO' AND extreme_reached) THEN 'hold' WHEN why IS NOT NULL THEN 'invalid' ELSE 'wait' END AS check_state FROM c)"
    " SELECT trade_id, check_state, CASE WHEN check_state = 'invalid' THEN why END AS check_reason FROM e",
)
def mkt3(v):
    t = F.col("trade_id")
    trades = v.trades.withColumns({"momentum": t % 7 == 0, "price_moved": t % 5 == 0, "staggered": t % 3 == 0, "validated_source": t % 2 == 0, "age_hours": (t % 41) / 10.0})
    return M.position_checks(trades, _state(v)).select("trade_id", "check_state", "check_reason")


@query(
    "mkt9_harvest_plan", "trades markets extremes",
    SQL_ST + SQL_NOQ + ", h AS (SELECT DISTINCT market_id, coalesce(position_side, 'YES') AS side FROM trades WHERE status = 'OPEN'), x AS (SELECT d.*, mq.no_price, d.market_id IN (SELECT market_id FROM h WHERE side = 'YES') AS hy, d.market_id IN (SELECT market_id FROM h WHERE side = 'NO') AS hn FROM d JOIN mq ON d.market_id = mq.market_id WHERE NOT d.closed),"
    f" g AS (SELECT event_id, last(struct_pack(id := market_id, er := extreme_reached, hy := hy, p := yes_price) ORDER BY {_ORD}) AS y, first(struct_pack(id := market_id, p := no_price) ORDER BY distance, width, market_id) FILTER (WHERE impossible AND NOT hn) AS n FROM x GROUP BY 1)"
    " SELECT event_id, CASE WHEN y.er THEN 'YES' ELSE 'NO' END AS side, CASE WHEN y.er THEN y.id ELSE n.id END AS market_id, " + r("CASE WHEN y.er THEN y.p ELSE n.p END") + " AS price FROM g WHERE (y.er AND NOT y.hy AND y.p > 0 AND y.p <= 0.99) OR (NOT y.er AND n.p > 0 AND n.p <= 0.99)",
)
def mkt9(v):
    rows = M.with_extremes(_quotes(v), v.extremes)
    held = v.trades.filter("status = 'OPEN'").select("market_id", F.coalesce("position_side", F.lit("YES")).alias("side")).distinct()
    return M.harvest_plan(rows, held).withColumn("price", tidy(F.col("price")))


@query(
    "agg21_joi26_city_metadata", "markets",
    ", e AS (SELECT city, event_id, concat('2024-06-0', CAST(1 + event_id % 5 AS VARCHAR)) AS event_date, kind, concat('t', CAST(event_id AS VARCHAR)) AS title, concat('S', CAST(event_id AS VARCHAR)) AS station, 'manual' AS source, any_value(unit) AS unit FROM markets GROUP BY 1, 2, 3, 4),"
    " f AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY event_date, kind, event_id) AS x FROM e), g AS (SELECT city, array_to_string(list_sort(list(DISTINCT event_date)), ',') AS event_dates, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(title) AS titles FROM e GROUP BY 1)"
    " SELECT f.city, event_id, title, station, source, unit, event_dates, kinds, titles FROM f JOIN g ON f.city = g.city WHERE x = 1",
)
def agg21(v):
    e = v.markets.groupBy("city", "event_id", "kind").agg(F.first("unit").alias("unit")).selectExpr(
        "city", "event_id", "kind", "unit", "concat('2024-06-0', 1 + event_id % 5) AS event_date", "concat('t', event_id) AS title", "concat('S', event_id) AS station", "'manual' AS source")
    return M.city_metadata(e)


@query(
    "flt8_target_events", "markets",
    ", e AS (SELECT DISTINCT event_id, city, DATE '2024-06-01' + CAST(event_id % 5 AS INT) AS event_date FROM markets), c AS (SELECT DISTINCT city, CASE WHEN event_id % 97 % 2 = 0 THEN 'Asia/Tokyo' ELSE 'America/Los_Angeles' END AS tz FROM markets WHERE event_id % 97 % 3 <> 0),"
    " t AS (SELECT city, CAST((TIMESTAMP '2024-06-02 20:00:00' AT TIME ZONE 'UTC') AT TIME ZONE tz AS DATE) AS d FROM c) SELECT event_id, city, event_date FROM e WHERE EXISTS (SELECT 1 FROM t WHERE t.city = e.city AND e.event_date IN (t.d, t.d + 1))",
)
def flt8(v):
    events = v.markets.selectExpr("event_id", "city", "date_add(DATE '2024-06-01', CAST(event_id % 5 AS INT)) AS event_date").distinct()
    cities = v.markets.filter("event_id % 97 % 3 <> 0").selectExpr("city", "CASE WHEN event_id % 97 % 2 = 0 THEN 'Asia/Tokyo' ELSE 'America/Los_Angeles' END AS tz").distinct()
    return M.target_events(events, cities, "2024-06-02 20:00:00")


@query("src6_typed_calibration", "calib", "SELECT upper(station) AS station, month, local_hour, 100.0e0 AS rows, " + r("error_mean_f") + " AS error_mean_f, " + r("CASE WHEN error_sigma_f <= 0 THEN 1.5 ELSE error_sigma_f END") + " AS error_sigma_f FROM calib")
def src6(v):
    from skytally.sources.readers import typed_calibration

    text = v.calib.select("station", *[F.col(c).cast("string").alias(c) for c in ("month", "local_hour", "error_mean_f")], F.lit("100").alias("rows"), F.col("error_sigma_f").cast("string").alias("error_robust_sigma_f"), F.lit("1.5").alias("error_std_f"))
    out = typed_calibration(text)
    return out.select("station", "month", "local_hour", "rows", tidy(F.col("error_mean_f")).alias("error_mean_f"), tidy(F.col("error_sigma_f")).alias("error_sigma_f"))
