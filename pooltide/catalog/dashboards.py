"""Match analysis and page tables (F-1, F-2, G-1 ... G-3, G-20 ... G-27, D-36, D-37, K-1)."""

from __future__ import annotations

from pooltide.catalog.base import COUPONS, FIXTURES, HEADERS, LEGS, VIEW, register, rnd, stored
from pooltide.catalog.features import SYMBOLS
from pooltide.catalog.legs import GRID_METRICS
from pooltide.functions.numeric import rounded
from pooltide.operators import coupon_stats as S
from pooltide.operators import coupons as C
from pooltide.operators import matches as MT
from pooltide.plans import dashboards as D
from pooltide.sources import adapter as A
from pyspark.sql import functions as F


@register("home_advantage", f"""WITH {FIXTURES}
SELECT league, country, count(*) AS n_matches, avg((result = '1')::INT) AS pct_home, avg((result = 'N')::INT) AS pct_draw, avg((result = '2')::INT) AS pct_away
FROM fixtures GROUP BY league, country""", doubles="pct_home pct_draw pct_away")
def home_advantage(spark, sf):
    return MT.home_advantage(A.fixtures(spark, sf))


@register("odds_calibration", f"""WITH {LEGS}, probs AS (
  SELECT p, hit FROM legs CROSS JOIN LATERAL (VALUES
    ((1e0/odds_1) / (1e0/odds_1 + 1e0/odds_n + 1e0/odds_2), (result = '1')::INT),
    ((1e0/odds_n) / (1e0/odds_1 + 1e0/odds_n + 1e0/odds_2), (result = 'N')::INT),
    ((1e0/odds_2) / (1e0/odds_1 + 1e0/odds_n + 1e0/odds_2), (result = '2')::INT)) v(p, hit)
  WHERE odds_1 > 0 AND odds_n > 0 AND odds_2 > 0
), bands AS (SELECT k, (10*k) || '-' || (10*(k+1)) || '%' AS probability_band FROM range(10) r(k))
SELECT probability_band, count(p) AS n_matches, avg(p) AS mean_implied, avg(hit) AS hit_rate
FROM bands LEFT JOIN probs ON p > k / 10e0 AND p <= (k + 1) / 10e0 GROUP BY probability_band""", doubles="mean_implied hit_rate")
def odds_calibration(spark, sf):
    return MT.odds_calibration(A.legs(spark, sf))


@register("results_distribution", f"""WITH {LEGS}
SELECT count(*) AS total, count(*) FILTER (result = '1') AS n_1, count(*) FILTER (result = 'N') AS n_n, count(*) FILTER (result = '2') AS n_2,
  avg((result = '1')::INT) AS pct_1, avg((result = 'N')::INT) AS pct_n, avg((result = '2')::INT) AS pct_2 FROM legs""",
          doubles="pct_1 pct_n pct_2")
def results_distribution(spark, sf):
    return MT.results_distribution(A.legs(spark, sf))


def _dated(spark, sf):
    return A.fixtures(spark, sf).join(A.headers(spark, sf).select("coupon_id", "season"), "coupon_id")


@register("results_distribution_filtered", f"""WITH {FIXTURES}, {HEADERS}
SELECT count(*) AS total, count(*) FILTER (result = '1') AS n_1, count(*) FILTER (result = 'N') AS n_n, count(*) FILTER (result = '2') AS n_2,
  avg((result = '1')::INT) AS pct_1, avg((result = 'N')::INT) AS pct_n, avg((result = '2')::INT) AS pct_2
FROM fixtures JOIN headers USING (coupon_id) WHERE league = 'NATION_7' AND season = '1996-1997'""", doubles="pct_1 pct_n pct_2")
def results_distribution_filtered(spark, sf):
    return MT.results_distribution(_dated(spark, sf), league="NATION_7", season="1996-1997")


CARDS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY coupon_id ORDER BY fav NULLS LAST, position) AS frank, count(fav) OVER (PARTITION BY coupon_id) AS n FROM view
), cards AS (
  SELECT coupon_id, count(*) AS n_legs, count(fav) AS n_with_odds, avg(fav) AS moy_cote_fav, coalesce(stddev_samp(fav), 0e0) AS std_cote_fav,
    avg(spread) AS moy_spread, count(*) FILTER (fav < 1.5) AS nb_matchs_faciles, count(*) FILTER (fav > 2.0) AS nb_matchs_serres,
    count(*) FILTER (fav > 2.5) AS nb_matchs_tres_serres,
    avg((q1/qsum)*(q1/qsum) + (qn/qsum)*(qn/qsum) + (q2/qsum)*(q2/qsum)) FILTER (fav IS NOT NULL) AS hhi_moyen,
    avg(qsum - 1) FILTER (fav IS NOT NULL) AS marge_bookmaker_moy, avg(fav) / avg(outsider) AS ratio_fav_outsider,
    CASE WHEN count(fav) > 1 THEN sum((2*frank - n - 1) * fav) / (count(fav) * sum(fav)) ELSE 0e0 END AS gini_cotes_fav,
    coalesce(avg((crowd_index = fav_index)::INT) FILTER (fav IS NOT NULL AND has_share), 0e0) AS accord,
    sum(CASE WHEN spread > 0 THEN 1e0/spread WHEN spread IS NOT NULL THEN 10e0 END) AS inv_spread_sum, product(fav) AS difficulty
  FROM ranked GROUP BY coupon_id HAVING count(fav) > 0)"""


@register("coupon_cards", f"""WITH {LEGS}, {VIEW}, {CARDS} SELECT * REPLACE ({rnd("difficulty", 2)} AS difficulty) FROM cards""",
          doubles="moy_cote_fav std_cote_fav moy_spread hhi_moyen marge_bookmaker_moy ratio_fav_outsider gini_cotes_fav accord inv_spread_sum difficulty")
def coupon_cards(spark, sf):
    return D.coupon_cards(A.legs(spark, sf)).withColumn("difficulty", F.expr(rounded("difficulty", 2)))


@register("leg_categories", f"""WITH {LEGS}, {VIEW}
SELECT coupon_id, string_agg(position || ':' || CASE WHEN fav < 1.5 THEN 'sure' WHEN fav < 2.0 THEN 'medium' ELSE 'tight' END, ' ' ORDER BY position) AS categories
FROM view WHERE fav IS NOT NULL GROUP BY coupon_id""")
def leg_categories(spark, sf):
    return D.leg_categories(A.legs(spark, sf)).selectExpr(
        "coupon_id", "array_join(transform(legs, x -> concat(x.position, ':', x.category)), ' ') AS categories")


BOARD = f"""WITH {LEGS}, {HEADERS}, {VIEW}, {CARDS}, board AS (
  SELECT *, CAST(odds_coverage AS INT) + CAST(enough_tips AS INT) + CAST(solid_favourites AS INT) + CAST(low_margin AS INT)
    + CAST(few_tight_legs AS INT) + CAST(concentrated AS INT) + CAST(crowd_agrees AS INT) + CAST(even_favourites AS INT) AS n_go FROM (
    SELECT coupon_id, n_with_odds / n_legs::DOUBLE >= 0.8 AS odds_coverage, coalesce(n_tips, 0) >= 30 AS enough_tips, moy_cote_fav < 1.85 AS solid_favourites,
      marge_bookmaker_moy < 0.08 AS low_margin, nb_matchs_serres / n_with_odds::DOUBLE < 0.3 AS few_tight_legs, hhi_moyen > 0.4 AS concentrated,
      accord >= 0.6 AS crowd_agrees, std_cote_fav < 0.4 AS even_favourites FROM cards LEFT JOIN headers USING (coupon_id)))"""


@register("go_board", f"""{BOARD} SELECT *, CASE WHEN n_go >= 6 THEN 'strong' WHEN n_go >= 4 THEN 'moderate' ELSE 'weak' END AS signal FROM board""")
def go_board(spark, sf):
    return D.go_board(D.coupon_cards(A.legs(spark, sf)), A.headers(spark, sf))


@register("go_board_long", f"""{BOARD} SELECT coupon_id, check_name AS "check", CASE WHEN ok THEN 'GO' ELSE 'NO-GO' END AS verdict
FROM board CROSS JOIN LATERAL (VALUES {", ".join(f"('{k}', {k})" for k in D.CHECKS)}) v(check_name, ok)""")
def go_board_long(spark, sf):
    return D.go_board_long(go_board(spark, sf))


@register("outcome_shares", f"""WITH {COUPONS}, symbols AS (SELECT grid_type, unnest(string_split(results, '')) AS s FROM coupons)
SELECT grid_type, count(*) AS total, count(*) FILTER (s = '1') AS n_1, count(*) FILTER (s = 'N') AS n_n, count(*) FILTER (s = '2') AS n_2,
  avg((s = '1')::INT) AS share_1, avg((s = 'N')::INT) AS share_n, avg((s = '2')::INT) AS share_2 FROM symbols GROUP BY grid_type""",
          doubles="share_1 share_n share_2")
def outcome_shares(spark, sf):
    return D.outcome_shares(A.coupons(spark, sf))


def _histogram_sql(source, column, bins):
    return f"""bounds AS (SELECT min({column}::DOUBLE) AS lo, (max({column}::DOUBLE) - min({column}::DOUBLE)) / {bins} AS w FROM {source})
SELECT CAST(least(floor(({column} - lo) / w + 1e-9), {bins - 1}) AS INTEGER) AS bin, count(*) AS n,
  any_value(lo) + CAST(least(floor(({column} - lo) / w + 1e-9), {bins - 1}) AS INTEGER) * any_value(w) AS bin_start
FROM {source}, bounds GROUP BY 1"""


@register("difficulty_histogram", f"WITH {HEADERS}, {_histogram_sql('headers', 'difficulty', 20)}", doubles="bin_start")
def difficulty_histogram(spark, sf):
    return D.histogram(A.headers(spark, sf), "difficulty", 20)


@register("surprise_histogram", f"WITH {LEGS}, {VIEW}, {GRID_METRICS}, {_histogram_sql('grid_metrics', 'nb_surprises', 8)}", doubles="bin_start")
def surprise_histogram(spark, sf):
    return D.histogram(C.grid_metrics(A.legs(spark, sf)), "nb_surprises", 8)


@register("history_table", f"""WITH {COUPONS}, {VIEW}, {GRID_METRICS}, {SYMBOLS}
SELECT coupon_id, season, grid_type, difficulty, results, profile, moyenne_cote_fav, nb_surprises, top_winners, top_amount
FROM coupons LEFT JOIN grid_metrics USING (coupon_id) JOIN (SELECT coupon_id, profile FROM stats) USING (coupon_id)""",
          doubles="difficulty moyenne_cote_fav top_amount")
def history_table(spark, sf):
    return D.history_table(A.coupons(spark, sf), C.grid_metrics(A.legs(spark, sf)))


@register("metric_scatter", f"""WITH {COUPONS}, {VIEW}, {GRID_METRICS}
SELECT coupon_id, difficulty, moyenne_cote_fav, ecart_type_cotes, nb_surprises FROM coupons JOIN grid_metrics USING (coupon_id) WHERE moyenne_cote_fav > 0""",
          doubles="difficulty moyenne_cote_fav ecart_type_cotes")
def metric_scatter(spark, sf):
    return D.metric_scatter(A.coupons(spark, sf), C.grid_metrics(A.legs(spark, sf)))


def _tier(spark, sf):
    return D.payout_tier(A.coupons(spark, sf), misses=1)


TIER = f"WITH {COUPONS}, tier AS (SELECT coupon_id, grid_type, season, difficulty, near_winners AS winners, near_amount AS amount FROM coupons)"


@register("payout_tier", f"{TIER} SELECT * FROM tier", doubles="difficulty amount")
def payout_tier(spark, sf):
    return _tier(spark, sf)


@register("payout_tier_summary", f"""{TIER}
SELECT grid_type, count(*) AS n_draws, count(*) FILTER (amount > 0) AS n_paying, avg(amount) FILTER (amount > 0) AS mean_amount,
  min(amount) FILTER (amount > 0) AS min_amount, max(amount) FILTER (amount > 0) AS max_amount, median(amount) FILTER (amount > 0) AS median_amount
FROM tier GROUP BY grid_type""", doubles="mean_amount min_amount max_amount median_amount")
def payout_tier_summary(spark, sf):
    return D.tier_summary(_tier(spark, sf))


@register("payout_bands", f"""{TIER}, bands AS (SELECT * FROM (VALUES ('< 50', 0, 50), ('50-100', 50, 100), ('100-200', 100, 200), ('200-500', 200, 500), ('> 500', 500, 1e18)) v(payout_band, lo, hi))
SELECT payout_band, count(amount) AS n, count(amount) / (SELECT count(*) FROM tier WHERE amount > 0)::DOUBLE AS share
FROM bands LEFT JOIN (SELECT amount FROM tier WHERE amount > 0) ON amount >= lo AND amount < hi GROUP BY payout_band""", doubles="share")
def payout_bands(spark, sf):
    return D.payout_bands(_tier(spark, sf))


@register("payouts_below", f"""{TIER} SELECT {", ".join(f"avg((amount < {e})::INT) AS below_{e}" for e in D.PAYOUT_EDGES)} FROM tier WHERE amount > 0""",
          doubles=" ".join(f"below_{e}" for e in D.PAYOUT_EDGES))
def payouts_below(spark, sf):
    return D.payouts_below(_tier(spark, sf))


@register("difficulty_against_payout", f"""{TIER} SELECT n, r, CASE WHEN abs(r) < 0.2 THEN 'none' WHEN abs(r) < 0.4 THEN 'weak' ELSE 'moderate' END AS strength, slope, intercept
FROM (SELECT count(*) AS n, corr(difficulty, amount) AS r, regr_slope(amount, difficulty) AS slope, regr_intercept(amount, difficulty) AS intercept FROM tier WHERE amount > 0)""",
          doubles="r slope intercept")
def difficulty_against_payout(spark, sf):
    return D.metric_against_payout(_tier(spark, sf), "difficulty")


@register("payout_by_tercile", f"""{TIER}, cuts AS (SELECT quantile_cont(difficulty, 1/3e0) AS lo, quantile_cont(difficulty, 2/3e0) AS hi FROM tier WHERE amount > 0)
SELECT CASE WHEN difficulty <= lo THEN 1 WHEN difficulty <= hi THEN 2 ELSE 3 END AS tercile, avg(amount) AS mean_amount, count(*) AS n
FROM tier, cuts WHERE amount > 0 GROUP BY 1""", doubles="mean_amount")
def payout_by_tercile(spark, sf):
    return D.payout_by_tercile(_tier(spark, sf), "difficulty")


@register("coupon_history", f"""WITH {COUPONS}, {SYMBOLS}, newest AS (SELECT coupon_id, date, grid_type, results FROM coupons WHERE grid_type = 'LF7' ORDER BY date DESC, coupon_id LIMIT 50)
SELECT newest.*, s.* EXCLUDE (coupon_id) FROM newest LEFT JOIN stats s USING (coupon_id)""", doubles="chaos entropy alternation")
def coupon_history(spark, sf):
    coupons = A.coupons(spark, sf)
    return D.coupon_history(coupons, S.coupon_stats(coupons, A.legs(spark, sf)), "LF7", 50)
