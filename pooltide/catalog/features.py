"""Coupon statistics and the feature table (C-5, D-*, E-*, F-3, G-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pooltide.catalog.base import COUPONS, VIEW, register, rnd
from pooltide.functions import sequences as Q
from pooltide.functions.numeric import rounded
from pooltide.operators import coupon_stats as S
from pooltide.operators import coupons as C
from pooltide.sources import adapter as A

# One row per symbol of the results string, with its neighbour and its run.
SYMBOLS = """symbols AS (
  SELECT coupon_id, i, s, lag(s) OVER w AS prev,
    i - row_number() OVER (PARTITION BY coupon_id, s ORDER BY i) AS island
  FROM (SELECT coupon_id, i, substr(results, CAST(i AS INT), 1) AS s
        FROM (SELECT coupon_id, results, unnest(range(1, n_legs + 1)) AS i FROM coupons))
  WINDOW w AS (PARTITION BY coupon_id ORDER BY i)
), seq_stats AS (
  SELECT coupon_id, count(*) FILTER (s = '1') AS n_1, count(*) FILTER (s = 'N') AS n_n, count(*) FILTER (s = '2') AS n_2,
    count(*) AS n, count(*) FILTER (s <> prev) AS n_changes FROM symbols GROUP BY coupon_id
), runs AS (
  SELECT coupon_id, max(c) AS longest_run FROM (SELECT coupon_id, s, island, count(*) AS c FROM symbols GROUP BY ALL) GROUP BY coupon_id
), entropies AS (
  SELECT coupon_id, sum(-(c / n) * log2(c / n)) AS entropy FROM (
    SELECT coupon_id, s, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n
    FROM symbols JOIN (SELECT coupon_id, n FROM seq_stats) USING (coupon_id) GROUP BY coupon_id, s) GROUP BY coupon_id
), upsets AS (
  SELECT coupon_id, count(*) FILTER (CASE result WHEN '1' THEN odds_1 WHEN 'N' THEN odds_n ELSE odds_2 END > 3.0) AS n_upsets
  FROM legs GROUP BY coupon_id
), stats AS (
  SELECT coupon_id, CAST(n_1 AS INTEGER) AS n_1, CAST(n_n AS INTEGER) AS n_n, CAST(n_2 AS INTEGER) AS n_2,
    n_upsets / n::DOUBLE AS chaos, entropy, CASE WHEN n > 1 THEN n_changes / (n - 1)::DOUBLE ELSE 0e0 END AS alternation,
    n_1 || '-' || n_n || '-' || n_2 AS profile, CAST(longest_run AS INTEGER) AS longest_run
  FROM seq_stats JOIN runs USING (coupon_id) JOIN entropies USING (coupon_id) JOIN upsets USING (coupon_id)
)"""


@register("coupon_stats", f"WITH {COUPONS}, {SYMBOLS} SELECT * FROM stats", doubles="chaos entropy alternation")
def coupon_stats(spark, sf):
    return S.coupon_stats(A.coupons(spark, sf), A.legs(spark, sf))


@register("averages_by_type", f"""WITH {COUPONS}, {SYMBOLS}
SELECT grid_type, count(*) AS n_coupons, avg(coalesce(n_1, 0)) AS mean_1, avg(coalesce(n_n, 0)) AS mean_n,
  avg(coalesce(n_2, 0)) AS mean_2, avg(coalesce(entropy, 0)) AS mean_entropy, avg(coalesce(chaos, 0)) AS mean_chaos,
  avg(coalesce(alternation, 0)) AS mean_alternation
FROM coupons LEFT JOIN stats USING (coupon_id) GROUP BY grid_type""",
          doubles="mean_1 mean_n mean_2 mean_entropy mean_chaos mean_alternation")
def averages_by_type(spark, sf):
    coupons = A.coupons(spark, sf)
    return S.averages_by_type(coupons, S.coupon_stats(coupons, A.legs(spark, sf)))


@register("sequence_functions", f"""WITH {COUPONS}, {SYMBOLS}, next_coupon AS (
  SELECT c.coupon_id, c.results, o.results AS other FROM coupons c JOIN coupons o ON o.coupon_id = c.coupon_id + 1)
SELECT coupon_id, entropy AS entropy_1n2, CAST((n_n + n_2) AS DOUBLE) / length(results) AS chaos_no_odds,
  CAST((SELECT count(*) FROM range(1, 1 + least(length(results), length(other))) r(i)
   WHERE substr(results, CAST(i AS INT), 1) = substr(other, CAST(i AS INT), 1)) AS INTEGER) AS n_agreeing
FROM next_coupon JOIN stats USING (coupon_id)""", doubles="entropy_1n2 chaos_no_odds")
def sequence_functions(spark, sf):
    c = A.coupons(spark, sf).select("coupon_id", "results")
    other = c.selectExpr("coupon_id - 1 AS coupon_id", "results AS other")
    return c.join(other, "coupon_id").selectExpr(
        "coupon_id", f"{Q.entropy_1n2()} AS entropy_1n2", f"{Q.chaos_without_odds()} AS chaos_no_odds",
        f"{Q.matching_positions('results', 'other')} AS n_agreeing")


# The feature table as SQL, spelled out from windowed legs.
FEATURES = f"""scored AS (
  SELECT v.*, 1e0 / fav AS prob_fav, q1 / qsum AS p1, qn / qsum AS pn, q2 / qsum AS p2,
    CASE result WHEN '1' THEN 1 WHEN 'N' THEN 2 WHEN '2' THEN 3 END AS res_index,
    nullif(CASE result WHEN '1' THEN odds_1 WHEN 'N' THEN odds_n WHEN '2' THEN odds_2 END, 0e0) AS realised,
    CASE WHEN fav IS NOT NULL AND has_share THEN CASE fav_index WHEN 1 THEN share_1 WHEN 2 THEN share_n ELSE share_2 END END AS sf,
    CASE WHEN fav IS NOT NULL AND has_share THEN CASE outsider_index WHEN 1 THEN share_1 WHEN 2 THEN share_n ELSE share_2 END END AS so,
    CASE WHEN ssum > 0 THEN -((CASE WHEN share_1 > 0 THEN share_1/ssum*log2(share_1/ssum) ELSE 0e0 END)
      + (CASE WHEN share_n > 0 THEN share_n/ssum*log2(share_n/ssum) ELSE 0e0 END)
      + (CASE WHEN share_2 > 0 THEN share_2/ssum*log2(share_2/ssum) ELSE 0e0 END)) / log2(3e0) END AS disp,
    CASE WHEN fav IS NOT NULL THEN count(fav) OVER (PARTITION BY coupon_id ORDER BY position) END AS dpos,
    row_number() OVER (PARTITION BY coupon_id ORDER BY fav NULLS LAST, position) AS frank,
    count(fav) OVER (PARTITION BY coupon_id) AS nf, count(*) OVER (PARTITION BY coupon_id) AS nl,
    avg(fav) OVER (PARTITION BY coupon_id) AS mfav, max(fav) OVER (PARTITION BY coupon_id) AS maxfav,
    min(fav) OVER (PARTITION BY coupon_id) AS minfav, stddev_samp(fav) OVER (PARTITION BY coupon_id) AS sfav
  FROM view v
), agg AS (
  SELECT coupon_id, any_value(nl) AS nl, any_value(nf) AS nf,
    avg(fav) AS moy_cote_fav, median(fav) AS med_cote_fav, min(fav) AS min_cote_fav, max(fav) AS max_cote_fav,
    coalesce(stddev_samp(fav), 0e0) AS std_cote_fav, sum(fav) AS somme_cotes_fav, product(fav) AS prod_cotes_fav,
    avg(outsider) AS moy_cote_outsider, max(outsider) AS max_cote_outsider, sum(outsider) AS somme_cotes_outsider,
    avg(spread) AS moy_spread, max(spread) AS max_spread, min(spread) AS min_spread, coalesce(stddev_samp(spread), 0e0) AS std_spread,
    avg(odds_n) FILTER (fav IS NOT NULL) AS moy_cote_nul, coalesce(stddev_samp(odds_n) FILTER (fav IS NOT NULL), 0e0) AS std_cote_nul,
    avg(prob_fav) AS moy_prob_fav, min(prob_fav) AS min_prob_fav, max(prob_fav) AS max_prob_fav, sum(prob_fav) AS somme_prob_fav,
    avg(-prob_fav * log2(prob_fav)) AS entropie_cotes,
    avg(p1*p1 + pn*pn + p2*p2) FILTER (fav IS NOT NULL) AS hhi_moyen, max(p1*p1 + pn*pn + p2*p2) FILTER (fav IS NOT NULL) AS hhi_max,
    min(p1*p1 + pn*pn + p2*p2) FILTER (fav IS NOT NULL) AS hhi_min, avg(qsum - 1) FILTER (fav IS NOT NULL) AS marge_bookmaker_moy,
    sum((2*frank - nf - 1) * fav) / (any_value(nf) * sum(fav)) AS gini,
    sum((fav - mfav)^3) / (any_value(nf) * any_value(sfav)^3) AS skew, sum((fav - mfav)^4) / (any_value(nf) * any_value(sfav)^4) - 3 AS kurt,
    sum(prob_fav) FILTER (frank <= 3) AS top3,
    avg((prob_fav*fav - 1)/(fav - 1)) FILTER (fav > 1) AS kelly_moyen,
    avg((p1 - (fav_index=1)::INT)^2 + (pn - (fav_index=2)::INT)^2 + (p2 - (fav_index=3)::INT)^2) FILTER (fav IS NOT NULL) AS brier_ante,
    coalesce(avg(sf), 0e0) AS moy_pct_fav, coalesce(min(sf), 0e0) AS min_pct_fav, coalesce(max(sf), 0e0) AS max_pct_fav,
    coalesce(avg(so), 0e0) AS moy_pct_outsider,
    coalesce(avg((crowd_index = fav_index)::INT) FILTER (fav IS NOT NULL AND has_share), 0e0) AS accord_cotes_joueurs,
    coalesce(avg(disp), 0e0) AS moy_dispersion_votes, coalesce(max(disp), 0e0) AS max_dispersion_votes, coalesce(min(disp), 0e0) AS min_dispersion_votes,
    count(*) FILTER (tip IN ('1','N','2')) AS nb_tip_simple, count(*) FILTER (length(tip) = 2) AS nb_tip_double,
    count(*) FILTER (tip IN ('1N2','-','')) AS nb_tip_triple,
    count(*) FILTER (fav > 2.0) AS nb_matchs_serres, count(*) FILTER (fav < 1.5) AS nb_matchs_faciles, count(*) FILTER (fav > 2.5) AS nb_matchs_tres_serres,
    sum(CASE WHEN spread > 0 THEN 1e0/spread WHEN spread IS NOT NULL THEN 10e0 END) AS inv_spread_sum,
    min(dpos) FILTER (fav = maxfav) AS pos_match_plus_serre, min(dpos) FILTER (fav = minfav) AS pos_match_plus_facile,
    coalesce(abs(avg(fav) FILTER (dpos <= nf // 2) - avg(fav) FILTER (dpos > nf // 2)), 0e0) AS asymetrie_cotes,
    max(fav) FILTER (dpos = nf) - max(fav) FILTER (dpos = 1) AS lastfirst,
    count(*) FILTER (result = '1') AS nb_1, count(*) FILTER (result = 'N') AS nb_N, count(*) FILTER (result = '2') AS nb_2,
    count(*) FILTER (res_index <> fav_index) AS nb_surprises, count(*) FILTER (res_index = fav_index) AS nb_fav_gagne,
    avg(CASE WHEN res_index = fav_index THEN fav - 1 ELSE -1e0 END) FILTER (fav IS NOT NULL) AS roi_theorique,
    coalesce(avg(realised), 0e0) AS moy_cote_resultat, coalesce(sum(realised), 0e0) AS somme_cotes_resultat,
    coalesce(product(realised), 0e0) AS prod_cotes_resultat, coalesce(max(realised), 0e0) AS max_cote_resultat,
    coalesce(min(realised), 0e0) AS min_cote_resultat, coalesce(median(realised), 0e0) AS med_cote_resultat,
    coalesce(sum(ln(realised)), 0e0) AS log_surprise_index,
    coalesce(avg((p1 - (res_index=1)::INT)^2 + (pn - (res_index=2)::INT)^2 + (p2 - (res_index=3)::INT)^2) FILTER (fav IS NOT NULL), 0e0) AS brier_realise,
    count(*) FILTER (tip NOT IN ('', '-')) AS ntips, count(*) FILTER (tip NOT IN ('', '-') AND contains(tip, result)) AS nb_tip_correct,
    count(*) FILTER (ssum > 0 AND crowd_index = res_index) AS ncrowd,
    coalesce(avg(abs(sf - so)), 0e0) AS tension_moy, coalesce(max(abs(sf - so)), 0e0) AS tension_max
  FROM scored GROUP BY coupon_id HAVING any_value(nf) > 0
), features_raw AS (
  SELECT a.coupon_id, 'LF' || nl AS grid_type, nl AS nb_matchs, nb_1 || '-' || nb_N || '-' || nb_2 AS profil,
    h.difficulty, h.n_tips AS nb_pronostics, a.* EXCLUDE (coupon_id, nl, nf, gini, skew, kurt, top3, lastfirst, ntips, ncrowd),
    moy_cote_fav / moy_cote_outsider AS ratio_fav_outsider, moy_cote_nul / moy_cote_fav AS ratio_nul_fav,
    h.difficulty * std_cote_fav AS diff_x_std, min_cote_fav * max_cote_fav AS prod_min_max_fav,
    max_cote_fav - min_cote_fav AS range_cote_fav, std_cote_fav / moy_cote_fav AS coeff_variation_fav,
    CASE WHEN nf > 1 THEN gini ELSE 0e0 END AS gini_cotes_fav,
    CASE WHEN nf > 2 AND max_cote_fav > min_cote_fav THEN skew ELSE 0e0 END AS skewness_cotes_fav,
    CASE WHEN nf > 3 AND max_cote_fav > min_cote_fav THEN kurt ELSE 0e0 END AS kurtosis_cotes_fav,
    CASE WHEN nf >= 3 THEN top3 / somme_prob_fav ELSE 1e0 END AS concentration_top3,
    moy_pct_fav - moy_pct_outsider AS ecart_pct_fav_outsider, nb_tip_simple / nl::DOUBLE AS ratio_tip_simple,
    nf / somme_prob_fav AS harmonic_mean_fav,
    CASE WHEN nf > 2 THEN lastfirst / (nf - 1) ELSE 0e0 END AS gradient_difficulte,
    nb_fav_gagne / nl::DOUBLE AS pct_fav_gagne, prod_cotes_resultat AS surprise_index,
    CASE WHEN ntips > 0 THEN nb_tip_correct / ntips::DOUBLE ELSE 0e0 END AS tip_accuracy, ncrowd / nl::DOUBLE AS joueurs_accuracy,
    top_winners AS gagnants_parfait, top_amount AS montant_parfait, near_winners AS gagnants_presque, near_amount AS montant_presque,
    CAST(top_winners > 0 AS BIGINT) AS has_gagnant_parfait, entropy AS entropie_resultat, alternation AS alternance,
    CAST(longest_run AS BIGINT) AS plus_longue_suite, nb_surprises * entropy * alternation AS indice_chaos,
    nb_fav_gagne / nl::DOUBLE * accord_cotes_joueurs * (CASE WHEN ntips > 0 THEN nb_tip_correct / ntips::DOUBLE ELSE 0e0 END) AS indice_previsibilite,
    moy_cote_resultat / moy_cote_fav AS ratio_resultat_fav, log_surprise_index AS log_prod_cotes_resultat,
    h.difficulty * nb_surprises AS diff_x_surprises, 1e0 / somme_prob_fav AS inv_somme_prob_fav,
    top_amount * top_winners AS pool_estime_parfait
  FROM agg a JOIN headers h USING (coupon_id) JOIN (SELECT coupon_id, entropy, alternation, longest_run FROM stats) s USING (coupon_id)
)"""

DOUBLE_FEATURES = [f for f in C.FEATURES if f not in C.WHOLE]


def _stored() -> str:
    cols = ", ".join(f"{rnd(f, C.STORED_DIGITS)} AS {f}" if f in DOUBLE_FEATURES else f for f in C.FEATURES)
    return f"features AS MATERIALIZED (SELECT coupon_id, grid_type, nb_matchs, profil, {cols} FROM features_raw)"


FEATURE_CTES = f"{COUPONS}, {VIEW}, {SYMBOLS}, {FEATURES}, {_stored()}"


def features(spark, sf):
    return C.coupon_features(A.legs(spark, sf), A.headers(spark, sf))


# Products are checked to 2 decimals: a product of many odds keeps fewer exact ones.
_PRODUCTS = ("prod_cotes_fav", "prod_cotes_resultat", "surprise_index")
_FEATURE_SQL = f"""WITH {FEATURE_CTES} SELECT * REPLACE ({", ".join(f"{rnd(p, 2)} AS {p}" for p in _PRODUCTS)}) FROM features"""


@register("coupon_features", _FEATURE_SQL, doubles=" ".join(DOUBLE_FEATURES))
def coupon_features(spark, sf):
    return features(spark, sf).withColumns({p: F.expr(rounded(p, 2)) for p in _PRODUCTS})
