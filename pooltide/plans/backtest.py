"""Replaying predictions over played coupons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pooltide.functions import odds as O
from pooltide.operators.legs import with_exprs
from pooltide.operators.predict import BALANCED, STRATEGIES, Weights, predict_legs, signals, with_metrics
from pooltide.operators.staging import staged


def played_only(legs: DataFrame) -> DataFrame:
    """Legs of coupons whose every leg has a result."""
    return legs.withColumn("_open", F.expr("count_if(result IS NULL) OVER (PARTITION BY coupon_id)")) \
        .where("_open = 0").drop("_open")


def backtest_legs(legs: DataFrame, metrics: DataFrame | None = None, weights: Weights = BALANCED) -> DataFrame:
    """Predicted against actual outcome per leg."""
    return predict_legs(played_only(legs), metrics, weights).selectExpr(
        "coupon_id", "position", "prediction AS predicted", "result AS actual", "prediction = result AS correct",
        "prob_1", "prob_n", "prob_2", "confidence")


def backtest_coupons(leg_results: DataFrame) -> DataFrame:
    """Predicted and actual strings, correct legs and the perfect flag per coupon."""
    ordered = "array_join(transform(array_sort(collect_list(struct(position, {0}))), x -> x.{0}), '')"
    return leg_results.groupBy("coupon_id").agg(
        F.count(F.lit(1)).alias("n_legs"), F.expr("count_if(correct)").alias("n_correct"),
        F.expr("count_if(NOT correct) = 0").alias("is_perfect"),
        F.expr(ordered.format("actual")).alias("results"), F.expr(ordered.format("predicted")).alias("predicted"))


def _coupon_scores(leg_results: DataFrame) -> DataFrame:
    return leg_results.groupBy("coupon_id").agg(
        F.count(F.lit(1)).alias("n_legs"), F.expr("count_if(correct)").alias("n_correct"))


def backtest_summary(leg_results: DataFrame, min_correct: int = 6) -> DataFrame:
    """Accuracy, mean correct, perfect, near-perfect and ``min_correct``-or-more shares per coupon size."""
    return with_exprs(_coupon_scores(leg_results).groupBy("n_legs").agg(
        F.count(F.lit(1)).alias("n_coupons"), F.sum("n_legs").alias("n_matches"),
        F.sum("n_correct").alias("correct"),
        F.expr("count_if(n_correct = n_legs)").alias("n_perfect"),
        F.expr("count_if(n_correct >= n_legs - 1)").alias("n_near_perfect"),
        F.expr(f"count_if(n_correct >= {min_correct})").alias("n_min_correct")), {
            "grid_type": "concat('LF', n_legs)", "accuracy": "correct / n_matches",
            "mean_correct": "correct / n_coupons", "pct_perfect": "n_perfect / n_coupons * 100",
            "pct_min_correct": "n_min_correct / n_coupons * 100"}).drop("correct", "n_legs")


def correct_distribution(leg_results: DataFrame) -> DataFrame:
    """How many coupons of each size have how many correct legs."""
    return _coupon_scores(leg_results).groupBy("n_legs", "n_correct").agg(F.count(F.lit(1)).alias("n_coupons"))


def candidate_hits(legs: DataFrame, metrics: DataFrame | None, candidates: dict[str, Weights]) -> DataFrame:
    """(coupon_id, n_legs, hits): correct legs per coupon, ``hits`` with one entry per candidate in order.

    A leg stays one row: numpy mixes its signals with all candidates' weights at once, and
    only sums of neighbouring legs of a coupon leave the task. Which signals a leg has is
    one of eight cases, so the weights a missing signal passes on are a table made once.
    """
    weights = [list(w) for w in candidates.values()]
    table = np.zeros((8, len(weights), 5))
    for case in range(8):
        for c, (odds, crowd, tip, difficulty, prior) in enumerate(weights):
            kept = (odds if case & 1 else 0.0, crowd if case & 2 else 0.0, tip if case & 4 else 0.0, difficulty, prior)
            total = kept[0] + kept[1] + kept[2] + kept[3] + kept[4]
            table[case, c] = [k / total if total > 0 else k for k in kept]
    names = [f"{signal}_p{k}" for k in O.SUFFIXES for signal in ("odds", "crowd", "tip", "adjusted")]
    ready = signals(with_metrics(played_only(legs), metrics)).selectExpr(
        "coupon_id", "int(coalesce(has_odds, false)) + 2 * int(coalesce(has_crowd, false)) + 4 * int(coalesce(has_tip, false)) AS signs",
        "int(array_position(array('1', 'N', '2'), result)) - 1 AS won", *(f"coalesce({n}, double('NaN')) AS {n}" for n in names))
    n = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs, won, *probs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 15))
            w = table[signs]
            mixed = []
            for k, prior in enumerate(O.PRIOR):
                odds, crowd, tip, adjusted = (p[:, None] for p in probs[4 * k:4 * k + 4])
                mixed.append(w[..., 0] * odds + w[..., 1] * crowd + w[..., 2] * tip + w[..., 3] * adjusted + w[..., 4] * prior)
            total = mixed[0] + mixed[1] + mixed[2]
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = np.stack([np.where(total > 0, m / total, 1 / 3) for m in mixed])
            hit = (shares.argmax(axis=0) == won[:, None]).astype(np.int32)
            coupon = batch.column(0).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.append(True, coupon[1:] != coupon[:-1]))
            sums = np.add.reduceat(hit, head, axis=0).astype(np.int32)
            legs = np.diff(np.append(head, len(coupon)))
            yield pa.RecordBatch.from_arrays([
                pa.array(coupon[head]), pa.array(legs, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1) * n, pa.int32()), pa.array(sums.ravel()))], ["coupon_id", "n_legs", "hits"])

    parts = ready.mapInArrow(run, f"coupon_id {dict(ready.dtypes)['coupon_id']}, n_legs bigint, hits array<int>")
    return parts.groupBy("coupon_id").agg(
        F.sum("n_legs").alias("n_legs"), F.expr(f"array({', '.join(f'int(sum(hits[{k}]))' for k in range(n))})").alias("hits"))


def candidate_scores(legs: DataFrame, metrics: DataFrame | None, candidates: dict[str, Weights]) -> DataFrame:
    """Correct legs per coupon and weight candidate, as rows."""
    return long_scores(candidate_hits(legs, metrics, candidates), candidates)


def long_scores(hits: DataFrame, candidates: dict[str, Weights]) -> DataFrame:
    names = ", ".join(f"'{name}'" for name in candidates)
    return hits.selectExpr("coupon_id", "n_legs", "posexplode(hits) AS (candidate, n_correct)").selectExpr(
        "coupon_id", "candidate", f"array({names})[candidate] AS w_name", "n_legs", "bigint(n_correct) AS n_correct")


def compare_strategies(scores: DataFrame) -> DataFrame:
    """Accuracy, perfect and near-perfect coupons per strategy and size."""
    return scores.groupBy(F.col("w_name").alias("strategy"), "n_legs").agg(
        F.count(F.lit(1)).alias("n_coupons"), F.expr("sum(n_correct) / sum(n_legs)").alias("accuracy"),
        F.expr("count_if(n_correct = n_legs)").alias("n_perfect"),
        F.expr("count_if(n_correct >= n_legs - 1)").alias("n_near_perfect"))


def full_backtest(legs: DataFrame, metrics: DataFrame | None, headers: DataFrame, candidates: dict[str, Weights]) -> dict[str, DataFrame]:
    """Default backtest, strategy comparison, best candidate and its scores. The sweep is stored once (runs a job)."""
    from pooltide.plans.weights import best_candidate, evaluate_hits

    hits = staged(candidate_hits(legs, metrics, candidates), "candidate_hits")
    best = best_candidate(evaluate_hits(hits, headers, candidates), "accuracy")
    # The chosen candidate is one row; the coupons keep its entry only.
    chosen = hits.crossJoin(F.broadcast(best.select("candidate", "w_name"))).selectExpr(
        "coupon_id", "n_legs", "w_name", "bigint(hits[candidate]) AS n_correct")
    return {
        "default": backtest_summary(backtest_legs(legs, metrics)),
        "strategies": compare_strategies(candidate_scores(legs, metrics, STRATEGIES)),
        "optimized": best,
        "optimized_backtest": compare_strategies(chosen),
    }
