"""Leg-level queries: filters, favourites, signals, predictions (C-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pooltide.catalog.base import COUPONS, HEADERS, LEGS, VIEW, register, rnd
from pooltide.functions import odds as O
from pooltide.operators import coupons as C
from pooltide.operators import legs as L
from pooltide.operators import predict as P
from pooltide.sources import adapter as A


@register("adapter_legs", f"WITH {LEGS} SELECT coupon_id, position, odds_1, odds_n, odds_2, share_1, share_n, share_2, tip, result FROM legs",
          doubles="odds_1 odds_n odds_2 share_1 share_n share_2")
def adapter_legs(spark, sf):
    return A.legs(spark, sf)


@register("adapter_coupons", f"WITH {COUPONS} SELECT coupon_id, date, season, grid_type, n_legs, difficulty, n_tips, results, top_winners, top_amount, near_winners, near_amount FROM coupons",
          doubles="difficulty top_amount near_amount")
def adapter_coupons(spark, sf):
    return C.payout_columns(A.coupons(spark, sf)).drop("payouts")


@register("leg_favourites", f"""WITH {LEGS}, {VIEW}
SELECT coupon_id, position, fav, fav_index, outsider, outsider_index, spread,
  CASE WHEN fav < 1.5 THEN 'sure' WHEN fav < 2.0 THEN 'medium' ELSE 'tight' END AS category
FROM view WHERE fav IS NOT NULL""", doubles="fav outsider spread")
def leg_favourites(spark, sf):
    return L.leg_board(A.legs(spark, sf))


@register("legs_missing_odds", f"""WITH {LEGS}
SELECT coupon_id, count(*) FILTER (NOT (odds_1 > 0 AND odds_n > 0 AND odds_2 > 0)) AS n_missing, count(*) AS n_legs
FROM legs GROUP BY coupon_id""")
def legs_missing_odds(spark, sf):
    return L.missing_odds(A.legs(spark, sf))


PROBS = """probs AS (
  SELECT *,
    CASE WHEN has_odds THEN q1 / (q1 + qn + q2) ELSE 1e0/3e0 END AS po1,
    CASE WHEN has_odds THEN qn / (q1 + qn + q2) ELSE 1e0/3e0 END AS pon,
    CASE WHEN has_odds THEN q2 / (q1 + qn + q2) ELSE 1e0/3e0 END AS po2,
    CASE WHEN ssum > 0 THEN share_1 / ssum ELSE 1e0/3e0 END AS pc1,
    CASE WHEN ssum > 0 THEN share_n / ssum ELSE 1e0/3e0 END AS pcn,
    CASE WHEN ssum > 0 THEN share_2 / ssum ELSE 1e0/3e0 END AS pc2,
    CASE nt WHEN 1 THEN CASE WHEN t1 THEN 0.8e0 ELSE 0.1e0 END WHEN 2 THEN CASE WHEN t1 THEN 0.45e0 ELSE 0.1e0 END ELSE 1e0/3e0 END AS pt1,
    CASE nt WHEN 1 THEN CASE WHEN tn THEN 0.8e0 ELSE 0.1e0 END WHEN 2 THEN CASE WHEN tn THEN 0.45e0 ELSE 0.1e0 END ELSE 1e0/3e0 END AS ptn,
    CASE nt WHEN 1 THEN CASE WHEN t2 THEN 0.8e0 ELSE 0.1e0 END WHEN 2 THEN CASE WHEN t2 THEN 0.45e0 ELSE 0.1e0 END ELSE 1e0/3e0 END AS pt2
  FROM (
    SELECT *, CAST(t1 AS INT) + CAST(tn AS INT) + CAST(t2 AS INT) AS nt, length(trim(tip)) > 0 AS has_tip
    FROM (SELECT *, (odds_1 > 0 AND odds_n > 0 AND odds_2 > 0) AS has_odds,
      contains(upper(trim(tip)), '1') AS t1, contains(upper(trim(tip)), 'N') AS tn, contains(upper(trim(tip)), '2') AS t2
      FROM view))
)"""


@register("leg_signals", f"""WITH {LEGS}, {VIEW}, {PROBS}
SELECT coupon_id, position, po1 AS odds_p1, pon AS odds_pn, po2 AS odds_p2, pc1 AS crowd_p1, pcn AS crowd_pn, pc2 AS crowd_p2,
  pt1 AS tip_p1, ptn AS tip_pn, pt2 AS tip_p2 FROM probs""",
          doubles="odds_p1 odds_pn odds_p2 crowd_p1 crowd_pn crowd_p2 tip_p1 tip_pn tip_p2")
def leg_signals(spark, sf):
    exprs = {**O.implied_probabilities(), **O.crowd_probabilities(), **O.tip_probabilities()}
    return A.legs(spark, sf).selectExpr("coupon_id", "position", *(f"{x} AS {k}" for k, x in exprs.items()))


# Stored coupon metrics: the SQL twin of operators.coupons.grid_metrics.
GRID_METRICS = f"""grid_metrics AS (
  SELECT coupon_id,
    {rnd("coalesce(s, 0e0)", 2)} AS somme_cotes_fav, {rnd("coalesce(m, 0e0)", 2)} AS moyenne_cote_fav,
    {rnd("coalesce(md, 0e0)", 2)} AS mediane_cote_fav, {rnd("sd", 2)} AS ecart_type_cotes,
    nb_surprises, {rnd("sd", 4)} AS std_cote_fav, {rnd("coalesce(iss, 0e0)", 4)} AS inv_spread_sum,
    nb_matchs_serres, nb_matchs_faciles, {rnd("coalesce(acc, 0e0)", 4)} AS accord_cotes_joueurs,
    {rnd("coalesce(sd / m, 0e0)", 4)} AS coeff_variation_fav, n_odds, n_legs
  FROM (
    SELECT coupon_id, sum(fav) AS s, avg(fav) AS m, median(fav) AS md, coalesce(stddev_samp(fav), 0e0) AS sd,
      count(*) FILTER (fav_index IS NOT NULL AND CASE result WHEN '1' THEN 1 WHEN 'N' THEN 2 ELSE 3 END <> fav_index) AS nb_surprises,
      sum(CASE WHEN spread > 0 THEN 1e0 / spread WHEN spread IS NOT NULL THEN 10e0 END) AS iss,
      count(*) FILTER (fav > 2.0) AS nb_matchs_serres, count(*) FILTER (fav < 1.5) AS nb_matchs_faciles,
      avg(CASE WHEN fav IS NOT NULL AND has_share THEN CASE WHEN crowd_index = fav_index THEN 1e0 ELSE 0e0 END END) AS acc,
      count(fav) AS n_odds, count(*) AS n_legs
    FROM view GROUP BY coupon_id)
)"""


@register("grid_metrics", f"WITH {LEGS}, {VIEW}, {GRID_METRICS} SELECT * FROM grid_metrics",
          doubles="somme_cotes_fav moyenne_cote_fav mediane_cote_fav ecart_type_cotes std_cote_fav inv_spread_sum accord_cotes_joueurs coeff_variation_fav")
def grid_metrics(spark, sf):
    return C.grid_metrics(A.legs(spark, sf))


def _metrics(spark, sf):
    return C.grid_metrics(A.legs(spark, sf)).join(A.headers(spark, sf).select("coupon_id", "difficulty"), "coupon_id", "left")


def rated_legs(spark, sf):
    """Legs carrying their coupon's metrics, from one shuffle of the legs."""
    return P.with_window_metrics(A.legs(spark, sf), A.headers(spark, sf))


PROFILE = """profiles AS (
  SELECT g.*, h.difficulty,
    CASE WHEN inv_spread_sum < 2.0 THEN 'secure' WHEN inv_spread_sum > 3.5 THEN 'risky'
      WHEN accord_cotes_joueurs > 0.80 THEN 'secure' WHEN std_cote_fav < 0.26 THEN 'secure'
      WHEN difficulty < 5.0 AND moyenne_cote_fav < 1.70 THEN 'secure' WHEN difficulty > 8.0 THEN 'risky'
      WHEN moyenne_cote_fav > 2.20 THEN 'risky' ELSE 'balanced' END AS risk_profile
  FROM grid_metrics g LEFT JOIN headers h USING (coupon_id)
)"""


@register("risk_profiles", f"""WITH {LEGS}, {HEADERS}, {VIEW}, {GRID_METRICS}, {PROFILE}
SELECT coupon_id, risk_profile FROM profiles""")
def risk_profiles(spark, sf):
    return _metrics(spark, sf).select("coupon_id", F.expr(P.RISK_PROFILE).alias("risk_profile"))


ADJUSTED = """adjusted AS (
  SELECT *, a1 / (a1 + an + a2) AS pd1, an / (a1 + an + a2) AS pdn, a2 / (a1 + an + a2) AS pd2 FROM (
    SELECT p.*, f.risk_profile,
      CASE f.risk_profile WHEN 'secure' THEN po1 + CASE WHEN po1 >= pon AND po1 >= po2 THEN 0.05e0 ELSE 0e0 END
        WHEN 'risky' THEN 0.8e0 * po1 + 0.2e0 * (1e0/3e0) ELSE po1 END AS a1,
      CASE f.risk_profile WHEN 'secure' THEN pon + CASE WHEN NOT (po1 >= pon AND po1 >= po2) AND pon >= po2 THEN 0.05e0 ELSE 0e0 END
        WHEN 'risky' THEN 0.8e0 * pon + 0.2e0 * (1e0/3e0) ELSE pon END AS an,
      CASE f.risk_profile WHEN 'secure' THEN po2 + CASE WHEN NOT (po1 >= pon AND po1 >= po2) AND NOT (pon >= po2) THEN 0.05e0 ELSE 0e0 END
        WHEN 'risky' THEN 0.8e0 * po2 + 0.2e0 * (1e0/3e0) ELSE po2 END AS a2
    FROM probs p JOIN profiles f USING (coupon_id))
)"""


def predicted(weights_sql: str, out: str = "predicted", extra: str = "") -> str:
    """Blended prediction over ``adjusted`` joined to a one-or-more-row weight table."""
    def mix(k):
        return (f"s1 * po{k} + s2 * pc{k} + s3 * pt{k} + s4 * pd{k} + s5 * "
                + {"1": "0.40e0", "n": "0.29e0", "2": "0.31e0"}[k])
    return f"""{out} AS (
  SELECT *, CASE WHEN prob_1 >= prob_n AND prob_1 >= prob_2 THEN '1' WHEN prob_n >= prob_2 THEN 'N' ELSE '2' END AS prediction,
    greatest(prob_1, prob_n, prob_2) - (prob_1 + prob_n + prob_2 - greatest(prob_1, prob_n, prob_2) - least(prob_1, prob_n, prob_2)) AS confidence
  FROM (SELECT *, f1 / (f1 + fn + f2) AS prob_1, fn / (f1 + fn + f2) AS prob_n, f2 / (f1 + fn + f2) AS prob_2
  FROM (SELECT *, {mix("1")} AS f1, {mix("n")} AS fn, {mix("2")} AS f2
  FROM (SELECT *, k1 / tw AS s1, k2 / tw AS s2, k3 / tw AS s3, k4 / tw AS s4, k5 / tw AS s5
  FROM (SELECT *, k1 + k2 + k3 + k4 + k5 AS tw
  FROM (SELECT a.*, w.* EXCLUDE (w1, w2, w3, w4, w5),
      CASE WHEN has_odds THEN w1 ELSE 0e0 END AS k1, CASE WHEN ssum > 0 THEN w2 ELSE 0e0 END AS k2,
      CASE WHEN has_tip THEN w3 ELSE 0e0 END AS k3, w4 AS k4, w5 AS k5
    FROM adjusted a CROSS JOIN ({weights_sql}) w)))))
)"""


STRATEGY_WEIGHTS_SQL = """SELECT * FROM (VALUES ('cautious', 1, 0.70e0, 0.10e0, 0.05e0, 0.10e0, 0.05e0),
  ('balanced', 2, 0.60e0, 0.15e0, 0.10e0, 0.10e0, 0.05e0), ('bold', 3, 0.45e0, 0.20e0, 0.15e0, 0.10e0, 0.10e0))
  AS v(strategy, strategy_order, w1, w2, w3, w4, w5)"""
BALANCED_SQL = f"SELECT strategy, w1, w2, w3, w4, w5 FROM ({STRATEGY_WEIGHTS_SQL}) WHERE strategy = 'balanced'"

BLEND = f"{LEGS}, {HEADERS}, {VIEW}, {GRID_METRICS}, {PROFILE}, {PROBS}, {ADJUSTED}"


@register("leg_difficulty_adjusted", f"WITH {BLEND} SELECT coupon_id, position, risk_profile, pd1, pdn, pd2 FROM adjusted",
          doubles="pd1 pdn pd2")
def leg_difficulty_adjusted(spark, sf):
    adj = P.signals(rated_legs(spark, sf))
    return adj.select("coupon_id", "position", "risk_profile", F.col("adjusted_p1").alias("pd1"),
                      F.col("adjusted_pn").alias("pdn"), F.col("adjusted_p2").alias("pd2"))


@register("leg_predictions", f"""WITH {BLEND}, {predicted(BALANCED_SQL)}
SELECT coupon_id, position, prob_1, prob_n, prob_2, prediction, confidence FROM predicted""",
          doubles="prob_1 prob_n prob_2 confidence")
def leg_predictions(spark, sf):
    return P.predict_legs(rated_legs(spark, sf)).select(
        "coupon_id", "position", "prob_1", "prob_n", "prob_2", "prediction", "confidence")


# Single legs: no coupon metrics, so every leg counts as balanced.
@register("scored_legs", f"""WITH {LEGS}, {VIEW}, {PROBS}, adjusted AS (SELECT *, po1 AS pd1, pon AS pdn, po2 AS pd2 FROM probs), {predicted(BALANCED_SQL)}
SELECT coupon_id, position, prob_1, prob_n, prob_2, prediction, confidence FROM predicted""", doubles="prob_1 prob_n prob_2 confidence")
def scored_legs(spark, sf):
    return P.score_legs(A.legs(spark, sf)).select(
        "coupon_id", "position", "prob_1", "prob_n", "prob_2", "prediction", "confidence")


# Coupons without stored metrics: only the mean favourite odds and the difficulty decide the profile.
@register("predictions_without_metrics", f"""WITH {LEGS}, {HEADERS}, {VIEW}, {GRID_METRICS}, profiles AS (
  SELECT g.coupon_id, CASE WHEN difficulty < 5.0 AND moyenne_cote_fav < 1.70 THEN 'secure' WHEN difficulty > 8.0 THEN 'risky'
    WHEN moyenne_cote_fav > 2.20 THEN 'risky' ELSE 'balanced' END AS risk_profile FROM grid_metrics g LEFT JOIN headers h USING (coupon_id)),
{PROBS}, {ADJUSTED}, {predicted(BALANCED_SQL)}
SELECT coupon_id, position, prob_1, prob_n, prob_2, prediction, risk_profile FROM predicted""", doubles="prob_1 prob_n prob_2")
def predictions_without_metrics(spark, sf):
    return P.predict_legs(A.legs(spark, sf), A.headers(spark, sf).select("coupon_id", "difficulty")).select(
        "coupon_id", "position", "prob_1", "prob_n", "prob_2", "prediction", "risk_profile")


@register("played_coupons", f"""WITH {LEGS.replace("l_partkey AS part_id", "l_linestatus AS ls, l_partkey AS part_id")}
SELECT coupon_id, count(*) AS n_legs FROM legs GROUP BY coupon_id HAVING count(*) FILTER (ls = 'O') = 0""")
def played_coupons(spark, sf):
    """Only coupons whose every leg has a result qualify."""
    from pooltide.plans.backtest import played_only
    line = A.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS coupon_id", "IF(l_linestatus = 'O', NULL, l_returnflag) AS result")
    return played_only(line).groupBy("coupon_id").agg(F.count(F.lit(1)).alias("n_legs"))
