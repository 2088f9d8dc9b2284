"""Statistics of a coupon's results string, joined to odds where they exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pooltide.functions import sequences as Q
from pooltide.operators.legs import with_exprs

STRING_STATS = {
    "n_1": Q.count_of("results", "1"), "n_n": Q.count_of("results", "N"), "n_2": Q.count_of("results", "2"),
    "profile": Q.profile(), "entropy": Q.entropy(), "alternation": Q.alternation(), "longest_run": Q.longest_run(),
}


def string_stats(coupons: DataFrame) -> DataFrame:
    """Counts, profile, entropy, alternation and longest run of ``results``."""
    return with_exprs(with_exprs(coupons, {"results": "coalesce(results, '')"}), STRING_STATS)


def coupon_stats(coupons: DataFrame, legs: DataFrame) -> DataFrame:
    """The stored statistics of a coupon.

    Chaos is the share of legs whose realised odds exceed 3. A coupon without
    any leg uses the share of draws and away wins instead; a coupon whose legs
    have no odds scores 0.
    """
    upsets = legs.groupBy("coupon_id").agg(
        F.expr("count_if(CASE result WHEN '1' THEN odds_1 WHEN 'N' THEN odds_n WHEN '2' THEN odds_2 END > 3.0D)")
        .alias("n_upsets"))
    return with_exprs(string_stats(coupons).join(upsets, "coupon_id", "left"), {
        "chaos": "CASE WHEN length(results) = 0 THEN 0.0D WHEN n_upsets IS NOT NULL THEN n_upsets / length(results) "
                 f"ELSE {Q.chaos_without_odds()} END",
    }).select("coupon_id", "n_1", "n_n", "n_2", "chaos", "entropy", "alternation", "profile", "longest_run")


def averages_by_type(coupons: DataFrame, stats: DataFrame) -> DataFrame:
    """Mean statistics per type; coupons without statistics count in the denominator."""
    mean = lambda c: F.expr(f"sum(coalesce({c}, 0)) / count(1)")
    return coupons.select("coupon_id", "grid_type").join(stats, "coupon_id", "left").groupBy("grid_type").agg(
        F.count(F.lit(1)).alias("n_coupons"),
        mean("n_1").alias("mean_1"), mean("n_n").alias("mean_n"), mean("n_2").alias("mean_2"),
        mean("entropy").alias("mean_entropy"), mean("chaos").alias("mean_chaos"),
        mean("alternation").alias("mean_alternation"))
