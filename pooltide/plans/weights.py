"""Choosing signal weights: over all coupons, over a trailing window, at random."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pooltide.operators.ordered import dense_sequence, with_halo
from pooltide.operators.predict import BALANCED, Weights, with_window_metrics
from pooltide.plans.backtest import candidate_hits, long_scores

# Steps around the default weights and four further profiles.
STEPS = (-0.10, -0.05, 0.05, 0.10)
PROFILES = (
    Weights(0.80, 0.05, 0.05, 0.05, 0.05),
    Weights(0.50, 0.25, 0.10, 0.10, 0.05),
    Weights(0.40, 0.20, 0.20, 0.10, 0.10),
    Weights(0.70, 0.10, 0.10, 0.05, 0.05),
)

METRICS = ("accuracy", "n_perfect", "n_near_perfect", "roi")


def sweep_candidates(base: Weights = BALANCED) -> dict[str, Weights]:
    """The default, one step up or down per signal (rescaled to one), and the fixed profiles."""
    out = {"default": base}
    for i, field in enumerate(Weights._fields):
        for step in STEPS:
            moved = [max(0.0, w + step) if k == i else w for k, w in enumerate(base)]
            total = sum(moved)
            out[f"{field}{step:+.2f}"] = Weights(*(round(w / total, 4) for w in moved))
    out.update({f"profile_{k}": w for k, w in enumerate(PROFILES, start=1)})
    return out


def random_candidates(n: int, seed: int = 42, base: Weights = BALANCED, spread: float = 0.5) -> dict[str, Weights]:
    """The default plus ``n`` seeded draws, scaled to one by softmax.

    A distributed random search stands in for a simplex search that would score
    the whole history once per step of a single process.
    """
    rng = random.Random(seed)
    out = {"default": base}
    for k in range(n):
        raised = [math.exp(math.log(w + 1e-8) + rng.gauss(0.0, spread)) for w in base]
        out[f"draw_{k + 1}"] = Weights(*(round(x / sum(raised), 4) for x in raised))
    return out


def _matrix(batch: pa.RecordBatch | pa.Table, column: str, width: int) -> np.ndarray:
    """An array column of equal sizes as rows by entries."""
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def evaluate_hits(hits: DataFrame, headers: DataFrame, candidates: dict[str, Weights]) -> DataFrame:
    """All metrics per candidate from ``candidate_hits``. ROI stakes 1 per coupon and wins the top payout when perfect.

    A batch of coupons sends one row per candidate.
    """
    n = len(candidates)
    names = ", ".join(f"'{name}'" for name in candidates)
    paid = hits.join(headers.select("coupon_id", "top_amount"), "coupon_id", "left").selectExpr(
        "n_legs", "hits", "coalesce(top_amount, 0.0D) AS top_amount")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            legs, won = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("n_legs", "top_amount"))
            correct = _matrix(batch, "hits", n)
            perfect = correct == legs
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                np.arange(n, dtype=np.int32), np.full(n, len(legs), np.int64), np.full(n, legs.sum(), np.int64), correct.sum(0, dtype=np.int64),
                perfect.sum(0, dtype=np.int64), (correct >= legs - 1).sum(0, dtype=np.int64), np.where(perfect, won - 1, -1.0).sum(0))], columns)

    columns = ["candidate", "n_coupons", "legs", "correct", "perfect", "near", "gain"]
    parts = paid.mapInArrow(run, "candidate int, n_coupons bigint, legs bigint, correct bigint, perfect bigint, near bigint, gain double")
    return parts.groupBy("candidate").agg(*(F.sum(c).alias(c) for c in columns[1:])).selectExpr(
        "candidate", f"array({names})[candidate] AS w_name", "n_coupons", "correct / legs AS accuracy", "perfect AS n_perfect",
        "near AS n_near_perfect", "gain / n_coupons AS roi")


def best_candidate(evaluated: DataFrame, metric: str) -> DataFrame:
    """The first candidate with the best value of ``metric``."""
    return evaluated.orderBy(F.col(metric).desc(), "candidate").limit(1)


def coupon_sequence(headers: DataFrame) -> DataFrame:
    """List position of every coupon by (date, coupon_id).

    Ids are unique, so a block of one date and 2^20 neighbouring ids is bounded.
    """
    return dense_sequence(
        headers.select("coupon_id", "date"), [], "date", "shiftright(coupon_id, 20)", ["date", "coupon_id"])


def sliding_weights(
    headers: DataFrame, scores: DataFrame, n_candidates: int, window: int = 20, metric: str = "accuracy",
    block_rows: int = 1 << 14,
) -> DataFrame:
    """``sliding_hits`` for scores in rows (coupon_id, candidate, n_legs, n_correct)."""
    slots = ", ".join(f"coalesce(max(CASE WHEN candidate = {k} THEN int(n_correct) END), 0)" for k in range(n_candidates))
    hits = scores.groupBy("coupon_id").agg(F.first("n_legs").alias("n_legs"), F.expr(f"array({slots})").alias("hits"))
    return sliding_hits(headers, hits, n_candidates, window, metric, block_rows)


def sliding_hits(
    headers: DataFrame, hits: DataFrame, n_candidates: int, window: int = 20, metric: str = "accuracy",
    block_rows: int = 1 << 14,
) -> DataFrame:
    """Best candidate over the ``window`` coupons before each coupon.

    A coupon without scores (not fully played) still takes a place in the
    window. Coupons with fewer than ``window`` predecessors have no row. Coupons
    stand in blocks of their sequence together with the ``window`` before; inside
    a block a window is the difference of two prefix sums, for all candidates at once.
    """
    listed = coupon_sequence(headers).join(hits, "coupon_id", "left").join(headers.select("coupon_id", "top_amount") if metric == "roi" else
             headers.select("coupon_id", F.lit(0.0).alias("top_amount")), "coupon_id", "left")
    ready = with_halo(listed.selectExpr(
        "coupon_id", "seq", "n_legs IS NOT NULL AS played", "coalesce(n_legs, 0) AS n_legs", "coalesce(top_amount, 0.0D) AS top_amount",
        f"coalesce(hits, array_repeat(0, {n_candidates})) AS hits"), "seq", window, block_rows)

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("seq")
        seq, played, legs, won, halo = (block.column(c).to_numpy() for c in ("seq", "played", "n_legs", "top_amount", "_halo"))
        correct, legs, ones = _matrix(block, "hits", n_candidates), legs[:, None], played[:, None].astype(np.int64)
        value, size = {
            "accuracy": lambda: (correct.astype(np.int64), legs),
            "n_perfect": lambda: ((correct == legs) * ones, None),
            "n_near_perfect": lambda: ((correct >= legs - 1) * ones, None),
            "roi": lambda: (np.where(correct == legs, won[:, None] - 1, -1.0) * ones, ones),
        }[metric]()
        at = np.flatnonzero(~halo & (seq > window))
        # Sequence numbers follow each other, so the window before a row is the rows before it.
        before = lambda x: (s := np.concatenate((np.zeros((1, x.shape[1]), x.dtype), np.cumsum(x, axis=0))))[at] - s[at - window]
        total = before(value) if len(at) else np.zeros((0, n_candidates))
        if size is not None and len(at):
            count = before(size)
            total = np.divide(total, count, out=np.zeros(total.shape), where=count > 0)
        best = total.argmax(axis=1) if len(at) else np.zeros(0, np.int64)
        return pa.table({"coupon_id": block.column("coupon_id").take(at), "seq": seq[at], "candidate": best.astype(np.int32),
                         "score": total[np.arange(len(at)), best].astype(float)})

    kind = dict(ready.dtypes)["coupon_id"]
    return ready.groupBy("_block").applyInArrow(run, f"coupon_id {kind}, seq bigint, candidate int, score double")


def current_weights(headers: DataFrame, legs: DataFrame, candidates: dict[str, Weights], window: int = 20) -> DataFrame:
    """The candidate with the best accuracy on the last ``window`` coupons; only their legs are scored."""
    recent = headers.orderBy(F.col("date").desc(), F.col("coupon_id").desc()).limit(window).select("coupon_id", "difficulty")
    hits = candidate_hits(with_window_metrics(legs.join(F.broadcast(recent.select("coupon_id")), "coupon_id", "left_semi"), recent), None, candidates)
    return best_candidate(long_scores(hits, candidates).groupBy("candidate", "w_name").agg(
        F.expr("sum(n_correct) / sum(n_legs)").alias("accuracy")), "accuracy")
