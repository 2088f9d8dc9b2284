"""Coupon-level metrics and the coupon feature table.

Both read the leg view once. The window columns and the aggregation share one
hash partitioning on ``coupon_id``: the plan holds a single exchange of the legs.
Only fixed-width accumulators are used, so the aggregation stays a hash
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pooltide.functions.numeric import ratio, rounded
from pooltide.operators.legs import AGREEMENT, INVERSE_SPREAD, leg_scores, leg_view, with_exprs

_COUPON = "OVER (PARTITION BY coupon_id)"
_BY_POSITION = "OVER (PARTITION BY coupon_id ORDER BY position)"
_BY_FAV = "OVER (PARTITION BY coupon_id ORDER BY fav ASC NULLS LAST, position)"
_BY_REALISED = "OVER (PARTITION BY coupon_id ORDER BY realised ASC NULLS LAST, position)"

# Digits kept for stored feature values: enough for every use, few enough to
# hide the order in which a sum was taken, so a re-run task gives equal values.
STORED_DIGITS = 9


def _median_sum(rank: str, n: str, value: str) -> str:
    """SQL: median of ``value`` in a group of ``n`` rows carrying their sorted rank."""
    low, high = f"(({n} + 1) div 2)", f"(({n} + 2) div 2)"
    return (f"sum(CASE WHEN {rank} = {low} AND {rank} = {high} THEN {value} "
            f"WHEN {rank} = {low} OR {rank} = {high} THEN {value} / 2 END)")


def _aggregate(df: DataFrame, exprs: dict[str, str | Column]) -> DataFrame:
    return df.groupBy("coupon_id").agg(*(
        (F.expr(x) if isinstance(x, str) else x).alias(name) for name, x in exprs.items()))


def grid_metrics(legs: DataFrame) -> DataFrame:
    """Stored coupon metrics (rounded as stored): favourites, surprises, spread, agreement."""
    view = with_exprs(leg_view(legs), {
        "n_odds": f"count(fav) {_COUPON}", "fav_rank": f"row_number() {_BY_FAV}"})
    sums = _aggregate(view, {
        "s": "sum(fav)", "m": "avg(fav)", "sd": "coalesce(stddev_samp(fav), 0.0D)",
        "md": _median_sum("fav_rank", "n_odds", "fav"),
        "nb_surprises": "count_if(fav_index <> CASE result WHEN '1' THEN 1 WHEN 'N' THEN 2 WHEN '2' THEN 3 END)",
        "spread_sum": f"sum({INVERSE_SPREAD})",
        "nb_matchs_serres": "count_if(fav > 2.0D)", "nb_matchs_faciles": "count_if(fav < 1.5D)",
        "agreement": f"avg({AGREEMENT})", "n_odds": "count(fav)", "n_legs": "count(1)",
    })
    stored = lambda x, digits: f"coalesce({rounded(x, digits)}, 0.0D)"
    return sums.selectExpr(
        "coupon_id",
        f"{stored('s', 2)} AS somme_cotes_fav", f"{stored('m', 2)} AS moyenne_cote_fav",
        f"{stored('md', 2)} AS mediane_cote_fav", f"{stored('sd', 2)} AS ecart_type_cotes",
        "nb_surprises", f"{stored('sd', 4)} AS std_cote_fav", f"{stored('spread_sum', 4)} AS inv_spread_sum",
        "nb_matchs_serres", "nb_matchs_faciles", f"{stored('agreement', 4)} AS accord_cotes_joueurs",
        f"{stored('sd / m', 4)} AS coeff_variation_fav", "n_odds", "n_legs")


def basic_metrics(legs: DataFrame) -> DataFrame:
    """The four metrics computed on the fly for a coupon that carries none."""
    return grid_metrics(legs).select(
        "coupon_id", "somme_cotes_fav", "moyenne_cote_fav", "mediane_cote_fav", "ecart_type_cotes")


def payout_columns(coupons: DataFrame) -> DataFrame:
    """Winners and amount at the top rank and one below it, from the payout map."""
    at = lambda k: f"try_element_at(payouts, concat({k}, '_sur_', n_legs))"
    return with_exprs(coupons, {
        "top_winners": f"{at('n_legs')}.winners", "top_amount": f"{at('n_legs')}.amount",
        "near_winners": f"{at('n_legs - 1')}.winners", "near_amount": f"{at('n_legs - 1')}.amount",
    })


def coupon_features(legs: DataFrame, headers: DataFrame) -> DataFrame:
    """The feature table: one row per played coupon.

    ``headers`` has one row per coupon with ``difficulty``, ``n_tips`` and the
    payouts of the two top ranks. A coupon qualifies when every leg has a result
    and at least one leg has odds.
    """
    view = with_exprs(leg_scores(leg_view(legs)), {
        "n_legs": f"count(1) {_COUPON}", "n_odds": f"count(fav) {_COUPON}",
        "n_results": f"count(result) {_COUPON}", "n_realised": f"count(realised) {_COUPON}",
        "max_fav": f"max(fav) {_COUPON}", "min_fav": f"min(fav) {_COUPON}",
        "dense_pos": f"CASE WHEN fav IS NOT NULL THEN count(fav) {_BY_POSITION} END",
        "changed": f"result <> lag(result) {_BY_POSITION}",
        "fav_rank": f"row_number() {_BY_FAV}", "realised_rank": f"row_number() {_BY_REALISED}",
    })
    # Distance to the last change of result: its maximum is the longest run.
    view = with_exprs(view, {
        "run_length": f"position + 1 - max(CASE WHEN changed OR position = 1 THEN position END) {_BY_POSITION}",
    }).where("n_odds > 0 AND n_results = n_legs")
    real_tip = "coalesce(tip, '') NOT IN ('', '-')"
    base = _aggregate(view, {
        "n_legs": "first(n_legs)", "n_odds": "first(n_odds)",
        "moy_cote_fav": "avg(fav)", "med_cote_fav": _median_sum("fav_rank", "n_odds", "fav"),
        "min_cote_fav": "min(fav)", "max_cote_fav": "max(fav)", "std_cote_fav": "stddev_samp(fav)",
        "somme_cotes_fav": "sum(fav)",
        "moy_cote_outsider": "avg(outsider)", "max_cote_outsider": "max(outsider)",
        "somme_cotes_outsider": "sum(outsider)",
        "moy_spread": "avg(spread)", "max_spread": "max(spread)", "min_spread": "min(spread)",
        "std_spread": "stddev_samp(spread)",
        "moy_cote_nul": "avg(CASE WHEN fav IS NOT NULL THEN odds_n END)",
        "std_cote_nul": "stddev_samp(CASE WHEN fav IS NOT NULL THEN odds_n END)",
        "moy_prob_fav": "avg(prob_fav)", "min_prob_fav": "min(prob_fav)", "max_prob_fav": "max(prob_fav)",
        "somme_prob_fav": "sum(prob_fav)", "entropie_cotes": "avg(-prob_fav * log2(prob_fav))",
        "hhi_moyen": "avg(hhi)", "hhi_max": "max(hhi)", "hhi_min": "min(hhi)", "marge_bookmaker_moy": "avg(margin)",
        "gini_num": "sum((2 * fav_rank - n_odds - 1) * fav)",
        "pop_skew": "skewness(fav)", "pop_kurt": "kurtosis(fav)",
        "top3_prob": "sum(CASE WHEN fav_rank <= 3 THEN prob_fav END)",
        "kelly_moyen": "avg(CASE WHEN fav > 1 THEN (prob_fav * fav - 1) / (fav - 1) END)",
        "brier_ante": "avg(brier_fav)",
        "moy_pct_fav": "avg(share_fav)", "min_pct_fav": "min(share_fav)", "max_pct_fav": "max(share_fav)",
        "moy_pct_outsider": "avg(share_outsider)", "accord_cotes_joueurs": f"avg({AGREEMENT})",
        "moy_dispersion_votes": "avg(dispersion)", "max_dispersion_votes": "max(dispersion)",
        "min_dispersion_votes": "min(dispersion)",
        "nb_tip_simple": "count_if(tip IN ('1', 'N', '2'))", "nb_tip_double": "count_if(length(tip) = 2)",
        "nb_tip_triple": "count_if(coalesce(tip, '') IN ('1N2', '-', ''))",
        "nb_matchs_serres": "count_if(fav > 2.0D)", "nb_matchs_faciles": "count_if(fav < 1.5D)",
        "nb_matchs_tres_serres": "count_if(fav > 2.5D)",
        "inv_spread_sum": f"sum({INVERSE_SPREAD})",
        "pos_match_plus_serre": "min(CASE WHEN fav = max_fav THEN dense_pos END)",
        "pos_match_plus_facile": "min(CASE WHEN fav = min_fav THEN dense_pos END)",
        "first_half": "avg(CASE WHEN dense_pos <= n_odds div 2 THEN fav END)",
        "second_half": "avg(CASE WHEN dense_pos > n_odds div 2 THEN fav END)",
        "first_fav": "max(CASE WHEN dense_pos = 1 THEN fav END)",
        "last_fav": "max(CASE WHEN dense_pos = n_odds THEN fav END)",
        "nb_1": "count_if(result = '1')", "nb_N": "count_if(result = 'N')", "nb_2": "count_if(result = '2')",
        "nb_surprises": "count_if(result_index <> fav_index)", "nb_fav_gagne": "count_if(result_index = fav_index)",
        "roi_theorique": "avg(CASE WHEN result_index = fav_index THEN fav - 1 WHEN fav IS NOT NULL THEN -1.0D END)",
        "moy_cote_resultat": "avg(realised)", "somme_cotes_resultat": "sum(realised)",
        "max_cote_resultat": "max(realised)", "min_cote_resultat": "min(realised)",
        "med_cote_resultat": _median_sum("realised_rank", "n_realised", "realised"),
        "log_prod": "sum(ln(realised))", "brier_realise": "avg(brier_result)",
        "n_real_tips": f"count_if({real_tip})", "nb_tip_correct": f"count_if({real_tip} AND instr(tip, result) > 0)",
        "n_crowd_correct": "count_if(ssum > 0 AND crowd_index = result_index)",
        "n_changes": "count_if(changed)", "plus_longue_suite": "max(run_length)",
        "tension_moy": "avg(abs(share_fav - share_outsider))", "tension_max": "max(abs(share_fav - share_outsider))",
        "prod_cotes_fav": F.product("fav"), "prod_cotes_resultat": F.product("realised"),
    })
    return _derive(base.join(headers, "coupon_id"))


def _plogp(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0.0D END)"


def _zero(x: str) -> str:
    return f"coalesce({x}, 0.0D)"


# Feature columns kept as whole numbers; every other feature is a double.
WHOLE = frozenset((
    "nb_pronostics", "nb_tip_simple", "nb_tip_double", "nb_tip_triple", "nb_matchs_serres", "nb_matchs_faciles",
    "nb_matchs_tres_serres", "pos_match_plus_serre", "pos_match_plus_facile", "nb_1", "nb_N", "nb_2",
    "nb_surprises", "nb_fav_gagne", "nb_tip_correct", "gagnants_parfait", "gagnants_presque",
    "has_gagnant_parfait", "plus_longue_suite"))

_FIRST_STEP = {
    "difficulty": _zero("difficulty"), "n_tips": "coalesce(n_tips, 0)",
    "top_winners": "coalesce(top_winners, 0)", "top_amount": _zero("top_amount"),
    "near_winners": "coalesce(near_winners, 0)", "near_amount": _zero("near_amount"),
    "std_cote_fav": _zero("std_cote_fav"), "moy_pct_fav": _zero("moy_pct_fav"),
    "moy_pct_outsider": _zero("moy_pct_outsider"), "moy_cote_resultat": _zero("moy_cote_resultat"),
    "prod_cotes_resultat": "CASE WHEN somme_cotes_resultat IS NOT NULL THEN prod_cotes_resultat ELSE 0.0D END",
    "log_prod": _zero("log_prod"), "shrink": "(n_odds - 1) / n_odds",
    "accord_cotes_joueurs": _zero("accord_cotes_joueurs"),
    "pct_fav_gagne": "nb_fav_gagne / n_legs",
    "tip_accuracy": ratio("nb_tip_correct", "n_real_tips"),
    "entropie_resultat": " + ".join(_plogp(f"({k} / n_legs)") for k in ("nb_1", "nb_N", "nb_2")),
    "alternance": ratio("n_changes", "n_legs - 1"),
}

# Published features in order; a name alone passes the aggregated column through.
_FEATURES: dict[str, str | None] = {
    "difficulty": None, "nb_pronostics": "n_tips",
    "moy_cote_fav": None, "med_cote_fav": None, "min_cote_fav": None, "max_cote_fav": None,
    "std_cote_fav": None, "somme_cotes_fav": None, "prod_cotes_fav": None,
    "moy_cote_outsider": None, "max_cote_outsider": None, "somme_cotes_outsider": None,
    "moy_spread": None, "max_spread": None, "min_spread": None, "std_spread": _zero("std_spread"),
    "moy_cote_nul": None, "std_cote_nul": _zero("std_cote_nul"),
    "ratio_fav_outsider": ratio("moy_cote_fav", "moy_cote_outsider"),
    "ratio_nul_fav": ratio("moy_cote_nul", "moy_cote_fav"),
    "diff_x_std": "difficulty * std_cote_fav", "prod_min_max_fav": "min_cote_fav * max_cote_fav",
    "range_cote_fav": "max_cote_fav - min_cote_fav", "coeff_variation_fav": ratio("std_cote_fav", "moy_cote_fav"),
    "moy_prob_fav": None, "min_prob_fav": None, "max_prob_fav": None, "somme_prob_fav": None, "entropie_cotes": None,
    "hhi_moyen": None, "hhi_max": None, "hhi_min": None, "marge_bookmaker_moy": None,
    "gini_cotes_fav": f"CASE WHEN n_odds > 1 THEN {ratio('gini_num', 'n_odds * somme_cotes_fav')} ELSE 0.0D END",
    # Population moments restated over the sample deviation.
    "skewness_cotes_fav": "CASE WHEN n_odds > 2 AND std_cote_fav > 0 THEN coalesce(pop_skew, 0.0D) * pow(shrink, 1.5D) ELSE 0.0D END",
    "kurtosis_cotes_fav": "CASE WHEN n_odds > 3 AND std_cote_fav > 0 THEN (coalesce(pop_kurt, 0.0D) + 3) * shrink * shrink - 3 ELSE 0.0D END",
    "concentration_top3": "CASE WHEN n_odds >= 3 THEN top3_prob / somme_prob_fav ELSE 1.0D END",
    "kelly_moyen": _zero("kelly_moyen"), "brier_ante": None,
    "moy_pct_fav": None, "min_pct_fav": _zero("min_pct_fav"), "max_pct_fav": _zero("max_pct_fav"),
    "moy_pct_outsider": None, "accord_cotes_joueurs": None, "ecart_pct_fav_outsider": "moy_pct_fav - moy_pct_outsider",
    "moy_dispersion_votes": _zero("moy_dispersion_votes"), "max_dispersion_votes": _zero("max_dispersion_votes"),
    "min_dispersion_votes": _zero("min_dispersion_votes"),
    "nb_tip_simple": None, "nb_tip_double": None, "nb_tip_triple": None, "ratio_tip_simple": "nb_tip_simple / n_legs",
    "nb_matchs_serres": None, "nb_matchs_faciles": None, "nb_matchs_tres_serres": None,
    "inv_spread_sum": None, "harmonic_mean_fav": ratio("n_odds", "somme_prob_fav"),
    "pos_match_plus_serre": None, "pos_match_plus_facile": None,
    "asymetrie_cotes": "coalesce(abs(first_half - second_half), 0.0D)",
    "gradient_difficulte": "CASE WHEN n_odds > 2 THEN (last_fav - first_fav) / (n_odds - 1) ELSE 0.0D END",
    "nb_1": None, "nb_N": None, "nb_2": None, "nb_surprises": None, "nb_fav_gagne": None, "pct_fav_gagne": None,
    "roi_theorique": _zero("roi_theorique"),
    "moy_cote_resultat": None, "somme_cotes_resultat": _zero("somme_cotes_resultat"), "prod_cotes_resultat": None,
    "max_cote_resultat": _zero("max_cote_resultat"), "min_cote_resultat": _zero("min_cote_resultat"),
    "med_cote_resultat": _zero("med_cote_resultat"),
    "surprise_index": "prod_cotes_resultat", "log_surprise_index": "log_prod", "brier_realise": _zero("brier_realise"),
    "tip_accuracy": None, "nb_tip_correct": None, "joueurs_accuracy": "n_crowd_correct / n_legs",
    "gagnants_parfait": "top_winners", "montant_parfait": "top_amount",
    "gagnants_presque": "near_winners", "montant_presque": "near_amount",
    "has_gagnant_parfait": "IF(top_winners > 0, 1, 0)",
    "entropie_resultat": None, "alternance": None, "plus_longue_suite": None,
    "indice_chaos": "nb_surprises * entropie_resultat * alternance",
    "indice_previsibilite": "pct_fav_gagne * accord_cotes_joueurs * tip_accuracy",
    "ratio_resultat_fav": ratio("moy_cote_resultat", "moy_cote_fav"),
    "log_prod_cotes_resultat": "log_prod", "diff_x_surprises": "difficulty * nb_surprises",
    "inv_somme_prob_fav": ratio("1.0D", "somme_prob_fav"),
    "tension_moy": _zero("tension_moy"), "tension_max": _zero("tension_max"),
    "pool_estime_parfait": "top_amount * top_winners",
}

FEATURES = tuple(_FEATURES)


def _derive(joined: DataFrame) -> DataFrame:
    """Ratios and cross products of the aggregated columns, in the published order."""
    staged = with_exprs(joined, _FIRST_STEP)
    raw = staged.selectExpr(
        "coupon_id", "concat('LF', n_legs) AS grid_type", "n_legs AS nb_matchs",
        "concat_ws('-', nb_1, nb_N, nb_2) AS profil",
        *(f"{x or name} AS {name}" for name, x in _FEATURES.items()))
    return raw.selectExpr("coupon_id", "grid_type", "nb_matchs", "profil", *(
        f"CAST({name} AS BIGINT) AS {name}" if name in WHOLE
        else f"{rounded(f'CAST({name} AS DOUBLE)', STORED_DIGITS)} AS {name}" for name in FEATURES))
