"""Tables behind the pages: upcoming coupons, history, result and payout distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pooltide.functions import odds as O
from pooltide.functions import sequences as Q
from pooltide.functions.numeric import rounded
from pooltide.operators.legs import AGREEMENT, INVERSE_SPREAD, leg_scores, leg_view, with_exprs
from pooltide.operators.quantiles import exact_quantiles


def coupon_cards(legs: DataFrame) -> DataFrame:
    """Metrics of a coupon before it is played; difficulty is the product of the favourites."""
    scored = with_exprs(leg_scores(leg_view(legs)), {
        "fav_rank": "row_number() OVER (PARTITION BY coupon_id ORDER BY fav ASC NULLS LAST, position)",
        "n": "count(fav) OVER (PARTITION BY coupon_id)"})
    sums = {
        "n_legs": "count(1)", "n_with_odds": "count(fav)", "moy_cote_fav": "avg(fav)",
        "std_cote_fav": "coalesce(stddev_samp(fav), 0.0D)", "moy_spread": "avg(spread)",
        "nb_matchs_faciles": "count_if(fav < 1.5D)", "nb_matchs_serres": "count_if(fav > 2.0D)",
        "nb_matchs_tres_serres": "count_if(fav > 2.5D)", "hhi_moyen": "avg(hhi)", "marge_bookmaker_moy": "avg(margin)",
        "ratio_fav_outsider": "avg(fav) / avg(outsider)",
        "gini_cotes_fav": "IF(count(fav) > 1, sum((2 * fav_rank - n - 1) * fav) / (count(fav) * sum(fav)), 0.0D)",
        "accord": f"coalesce(avg({AGREEMENT}), 0.0D)", "inv_spread_sum": f"sum({INVERSE_SPREAD})",
    }
    return scored.groupBy("coupon_id").agg(
        *(F.expr(x).alias(k) for k, x in sums.items()), F.product("fav").alias("difficulty"),
    ).where("n_with_odds > 0")


def leg_categories(legs: DataFrame) -> DataFrame:
    """The legs of every coupon with their class, as one ordered array per coupon."""
    classed = leg_view(legs).where("fav IS NOT NULL").selectExpr(
        "coupon_id", f"struct(position, fav, spread, {O.leg_category()} AS category) AS leg")
    return classed.groupBy("coupon_id").agg(F.array_sort(F.collect_list("leg")).alias("legs"))


# The eight checks of a coupon before it is played.
CHECKS = {
    "odds_coverage": "n_with_odds / n_legs >= 0.80D",
    "enough_tips": "n_tips >= 30",
    "solid_favourites": "moy_cote_fav < 1.85D",
    "low_margin": "marge_bookmaker_moy < 0.08D",
    "few_tight_legs": "nb_matchs_serres / n_with_odds < 0.30D",
    "concentrated": "hhi_moyen > 0.40D",
    "crowd_agrees": "accord >= 0.60D",
    "even_favourites": "std_cote_fav < 0.40D",
}


def go_board(cards: DataFrame, headers: DataFrame) -> DataFrame:
    """Eight go / no-go checks per coupon, their count and the signal band."""
    joined = with_exprs(cards.join(headers.select("coupon_id", "n_tips"), "coupon_id", "left"), {
        "n_tips": "coalesce(n_tips, 0)"})
    checked = with_exprs(joined, CHECKS)
    counted = with_exprs(checked, {"n_go": " + ".join(f"int({k})" for k in CHECKS)})
    return with_exprs(counted, {
        "signal": "CASE WHEN n_go >= 6 THEN 'strong' WHEN n_go >= 4 THEN 'moderate' ELSE 'weak' END",
    }).select("coupon_id", *CHECKS, "n_go", "signal")


def go_board_long(board: DataFrame) -> DataFrame:
    """One row per coupon and check."""
    items = ", ".join(f"named_struct('check', '{k}', 'verdict', IF({k}, 'GO', 'NO-GO'))" for k in CHECKS)
    return board.selectExpr("coupon_id", f"inline(array({items}))")


def outcome_shares(coupons: DataFrame) -> DataFrame:
    """Share of each outcome over all results strings of a type."""
    counts = {k: f"sum({Q.count_of('results', o)})" for k, o in zip(("n_1", "n_n", "n_2"), O.OUTCOMES)}
    return with_exprs(
        coupons.where("results <> ''").groupBy("grid_type").agg(
            F.expr("sum(length(results))").alias("total"), *(F.expr(x).alias(k) for k, x in counts.items())),
        {f"share_{k[2:]}": f"{k} / total" for k in counts})


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram between the smallest and largest value."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    low = known.agg(F.min("x")).scalar()
    width = known.agg((F.max("x") - F.min("x")) / bins).scalar()
    placed = known.withColumns({"_low": low, "_width": width}).selectExpr(
        "_low", "_width", f"CASE WHEN _width > 0 THEN least(int(floor((x - _low) / _width + 1e-9D)), {bins - 1}) ELSE 0 END AS bin")
    return placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.expr("first(_low + bin * _width)").alias("bin_start"))


def history_table(coupons: DataFrame, metrics: DataFrame) -> DataFrame:
    """Played coupons with their metrics and the top payout."""
    top = "try_element_at(payouts, concat(n_legs, '_sur_', n_legs))"
    return coupons.join(metrics.select("coupon_id", "moyenne_cote_fav", "nb_surprises"), "coupon_id", "left").selectExpr(
        "coupon_id", "season", "grid_type", "difficulty", "results", f"{Q.profile()} AS profile",
        "moyenne_cote_fav", "nb_surprises", f"{top}.winners AS top_winners", f"{top}.amount AS top_amount")


def metric_scatter(coupons: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mean favourite, deviation, surprises and difficulty of coupons that have odds."""
    return coupons.select("coupon_id", "difficulty").join(metrics.where("moyenne_cote_fav > 0").select(
        "coupon_id", "moyenne_cote_fav", "ecart_type_cotes", "nb_surprises"), "coupon_id")


def payout_tier(coupons: DataFrame, misses: int = 1) -> DataFrame:
    """Payout rows of one rank, named by how many legs it may miss."""
    rank = f"try_element_at(payouts, concat(n_legs - {misses}, '_sur_', n_legs))"
    return coupons.selectExpr(
        "coupon_id", "grid_type", "season", "difficulty", f"{rank} AS tier").where("tier IS NOT NULL").selectExpr(
        "coupon_id", "grid_type", "season", "difficulty",
        "coalesce(tier.winners, 0) AS winners", "coalesce(tier.amount, 0.0D) AS amount")


def tier_summary(tier: DataFrame) -> DataFrame:
    """Paying draws and mean, median, smallest and largest payout per type."""
    paying = tier.where("amount > 0")
    medians = exact_quantiles(paying, ["amount"], [0.5], ["grid_type"]).selectExpr("grid_type", "value AS median_amount")
    sums = tier.groupBy("grid_type").agg(
        F.count(F.lit(1)).alias("n_draws"), F.expr("count_if(amount > 0)").alias("n_paying"),
        F.expr("avg(CASE WHEN amount > 0 THEN amount END)").alias("mean_amount"),
        F.expr("min(CASE WHEN amount > 0 THEN amount END)").alias("min_amount"),
        F.expr("max(CASE WHEN amount > 0 THEN amount END)").alias("max_amount"))
    return sums.join(medians, "grid_type", "left")


# Payout thresholds and the left-closed bands between them.
PAYOUT_EDGES = (50, 100, 200, 500)
PAYOUT_BANDS = ("< 50", "50-100", "100-200", "200-500", "> 500")


def payout_bands(tier: DataFrame) -> DataFrame:
    """Share of paying draws per payout band; empty bands are kept, with a zero share."""
    ladder = "CASE " + " ".join(f"WHEN amount < {e} THEN {k}" for k, e in enumerate(PAYOUT_EDGES)) + f" ELSE {len(PAYOUT_EDGES)} END"
    counted = tier.where("amount > 0").selectExpr(f"{ladder} AS band").groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    items = ", ".join(f"named_struct('band', {k}, 'payout_band', '{b}')" for k, b in enumerate(PAYOUT_BANDS))
    bands = tier.sparkSession.range(1).selectExpr(f"inline(array({items}))")
    return bands.join(counted, "band", "left").selectExpr("payout_band", "coalesce(n, 0) AS n").selectExpr(
        "payout_band", "n", "coalesce(try_divide(n, sum(n) OVER ()), 0.0D) AS share")


def payouts_below(tier: DataFrame) -> DataFrame:
    """Share of paying draws below each threshold."""
    return tier.where("amount > 0").agg(*(
        F.expr(f"avg(int(amount < {e}))").alias(f"below_{e}") for e in PAYOUT_EDGES))


def metric_against_payout(tier: DataFrame, metric: str) -> DataFrame:
    """Correlation of a metric with the payout, its strength and the fitted line; needs five draws."""
    known = tier.where(f"amount > 0 AND {metric} IS NOT NULL")
    sums = known.agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"covar_samp({metric}, amount)").alias("c"),
        F.expr(f"stddev_samp({metric}) * stddev_samp(amount)").alias("s"),
        F.expr(f"regr_slope(amount, {metric})").alias("slope"),
        F.expr(f"regr_intercept(amount, {metric})").alias("intercept")).where("n >= 5")
    return with_exprs(sums, {"r": "try_divide(c, s)"}).selectExpr(
        "n", "r", "CASE WHEN abs(r) < 0.2D THEN 'none' WHEN abs(r) < 0.4D THEN 'weak' ELSE 'moderate' END AS strength",
        "slope", "intercept")


def payout_by_tercile(tier: DataFrame, metric: str) -> DataFrame:
    """Mean payout in the three quantile bands (right-closed) of a metric."""
    known = tier.where(f"amount > 0 AND {metric} IS NOT NULL")
    cuts = exact_quantiles(known, [metric], [1 / 3, 2 / 3]).agg(
        F.min("value").alias("low"), F.max("value").alias("high"))
    low, high = cuts.select("low").scalar(), cuts.select("high").scalar()
    return known.withColumns({"_low": low, "_high": high}).selectExpr(
        f"CASE WHEN {metric} <= _low THEN 1 WHEN {metric} <= _high THEN 2 ELSE 3 END AS tercile", "amount",
    ).groupBy("tercile").agg(F.avg("amount").alias("mean_amount"), F.count(F.lit(1)).alias("n"))


def coupon_history(coupons: DataFrame, stats: DataFrame, grid_type: str | None = None, limit: int = 20) -> DataFrame:
    """Newest coupons first (1 to 100 of them), with their statistics where present."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    kept = coupons if grid_type is None else coupons.where(F.col("grid_type") == grid_type)
    newest = kept.select("coupon_id", "date", "grid_type", "results").orderBy(
        F.col("date").desc(), "coupon_id").limit(limit)
    # At most 100 rows: broadcast, so the statistics are filtered rather than shuffled.
    found = stats.join(F.broadcast(newest.select("coupon_id")), "coupon_id", "left_semi")
    return newest.join(found, "coupon_id", "left")
