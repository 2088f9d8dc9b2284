"""Which strategy suits which coupon: performance table, mined rules, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pooltide.functions.numeric import rounded
from pooltide.operators.legs import with_exprs
from pooltide.operators.quantiles import exact_quantiles, unpivoted

STRATEGY_ORDER = ("cautious", "balanced", "bold")

# Metrics and percentiles scanned for rules, and their limits.
RULE_METRICS = ("inv_spread_sum", "std_cote_fav", "accord", "difficulty")
RULE_PERCENTILES = (0.25, 0.33, 0.50, 0.67, 0.75)
MIN_SUPPORT, MIN_ACCURACY, MAX_PER_METRIC, MAX_RULES = 5, 0.40, 2, 8


def strategy_performance(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """Correct legs per strategy, the best strategy (first on ties) and its margin per coupon."""
    wide = scores.groupBy("coupon_id").agg(*(
        F.expr(f"max(CASE WHEN w_name = '{s}' THEN n_correct END)").alias(f"n_correct_{s}") for s in STRATEGY_ORDER))
    a, b, c = (f"n_correct_{s}" for s in STRATEGY_ORDER)
    return with_exprs(wide.join(metrics.selectExpr(
        "coupon_id", "inv_spread_sum", "std_cote_fav", "accord_cotes_joueurs AS accord", "difficulty",
        "moyenne_cote_fav", "nb_matchs_serres"), "coupon_id"), {
            "best_strategy": f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 'cautious' WHEN {b} >= {c} THEN 'balanced' ELSE 'bold' END",
            "margin": f"greatest({a}, {b}, {c}) - element_at(sort_array(array({a}, {b}, {c}), false), 2)"})


def strategy_summary(table: DataFrame) -> DataFrame:
    """Mean correct legs and how often each strategy is the best one."""
    items = ", ".join(
        f"named_struct('strategy', '{s}', 'n_correct', n_correct_{s}, 'is_best', int(best_strategy = '{s}'))"
        for s in STRATEGY_ORDER)
    return table.selectExpr(f"inline(array({items}))").groupBy("strategy").agg(
        F.avg("n_correct").alias("mean_correct"), F.sum("is_best").alias("n_best"),
        F.expr("avg(is_best) * 100").alias("pct_best"))


def _metric_rank(column: str = "metric") -> str:
    return f"array_position(array({', '.join(repr(m) for m in RULE_METRICS)}), {column})"


def mine_rules(table: DataFrame, order: str = "coupon_id") -> DataFrame:
    """Threshold rules that name the winning strategy: at most two per metric and eight in all.

    Groups are counted map-side per (metric, threshold, side, strategy). A tie
    between strategies goes to the one seen first in ``order``.
    """
    thresholds = exact_quantiles(table, list(RULE_METRICS), list(RULE_PERCENTILES)).selectExpr(
        "metric", f"{rounded('value', 9)} AS threshold").distinct()
    sides = (
        unpivoted(table, list(RULE_METRICS), ["best_strategy", f"{order} AS _order"])
        .join(F.broadcast(thresholds), "metric")
        .selectExpr("metric", "threshold", "IF(x < threshold, 'low', 'high') AS direction", "best_strategy", "_order")
    )
    counted = sides.groupBy("metric", "threshold", "direction", "best_strategy").agg(
        F.count(F.lit(1)).alias("wins"), F.min("_order").alias("first_seen"))
    group = "PARTITION BY metric, threshold, direction"
    majority = with_exprs(counted, {
        "support": f"sum(wins) OVER ({group})",
        "place": f"row_number() OVER ({group} ORDER BY wins DESC, first_seen)",
    }).where(f"place = 1 AND support >= {MIN_SUPPORT} AND wins / support >= {MIN_ACCURACY}")
    ranked = majority.selectExpr(
        "metric", f"{rounded('threshold', 4)} AS threshold", "direction", "best_strategy AS recommended",
        f"{rounded('wins / support', 4)} AS accuracy", "support",
        f"struct(-{rounded('wins / support', 4)} AS a, -support AS s, {_metric_rank()} AS m, threshold AS t, "
        "int(direction = 'high') AS d) AS sort_key")
    # At most 4 metrics x 5 thresholds x 2 sides reach these two windows.
    kept = with_exprs(ranked, {"in_metric": "row_number() OVER (PARTITION BY metric ORDER BY sort_key)"}).where(
        f"in_metric <= {MAX_PER_METRIC}")
    return with_exprs(kept, {"rule_id": "row_number() OVER (ORDER BY sort_key)"}).where(
        f"rule_id <= {MAX_RULES}").drop("in_metric", "sort_key")


def recommend(coupons: DataFrame, rules: DataFrame) -> DataFrame:
    """Accuracy-weighted vote of the matching rules per coupon.

    The rules (eight at most) come in as one array, so no coupon is shuffled.
    Without a matching rule the recommendation is ``balanced`` at confidence 0;
    ``voted`` is null then.
    """
    as_array = rules.agg(F.expr(
        "array_sort(collect_list(struct(rule_id, metric, threshold, direction, recommended, accuracy)))").alias("r")).scalar()
    value = "CASE r.metric " + " ".join(f"WHEN '{m}' THEN {m}" for m in RULE_METRICS) + " END"
    votes = {s: f"aggregate(filter(matched, r -> r.recommended = '{s}'), 0.0D, (acc, r) -> acc + r.accuracy)"
             for s in STRATEGY_ORDER}
    matched = with_exprs(coupons.withColumn("_rules", as_array), {
        "matched": f"filter(coalesce(_rules, array()), r -> coalesce(IF(r.direction = 'low', {value} < r.threshold, {value} >= r.threshold), false))",
    })
    scored = with_exprs(matched, {f"vote_{s}": x for s, x in votes.items()})
    scored = with_exprs(scored, {
        "total": " + ".join(f"vote_{s}" for s in STRATEGY_ORDER),
        "best": f"greatest({', '.join(f'vote_{s}' for s in STRATEGY_ORDER)})"})
    # First matched rule whose strategy holds the best vote: ties go to the earlier rule.
    leaders = "CASE r.recommended " + " ".join(f"WHEN '{s}' THEN vote_{s}" for s in STRATEGY_ORDER) + " END"
    voted = with_exprs(scored, {"voted": f"get(filter(matched, r -> {leaders} = best), 0).recommended"})
    reason = ("concat(r.metric, IF(r.direction = 'low', ' < ', ' >= '), format_string('%.2f', r.threshold), ' -> ', "
              "r.recommended, ' (', format_string('%.0f', r.accuracy * 100), '%)')")
    out = with_exprs(voted, {
        "recommended": "coalesce(voted, 'balanced')",
        "confidence": f"IF(total > 0, {rounded('best / total', 3)}, 0.0D)",
        **{f"score_{s}": f"IF(total > 0, {rounded(f'vote_{s} / total', 3)}, 0.0D)" for s in STRATEGY_ORDER},
        "reasoning": f"array_join(transform(slice(matched, 1, 3), r -> {reason}), ' | ')",
    })
    return out.drop("_rules", "matched", "total", "best", *(f"vote_{s}" for s in STRATEGY_ORDER))


def rule_accuracy(recommended: DataFrame) -> DataFrame:
    """Share of all coupons whose vote names the best strategy; no vote counts as wrong."""
    return recommended.agg(
        F.expr("count_if(voted = best_strategy) / count(1)").alias("accuracy"), F.count(F.lit(1)).alias("n_coupons"))
