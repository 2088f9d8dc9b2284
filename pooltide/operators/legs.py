"""Leg-level view: favourites, margins, agreement with the crowd."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pooltide.functions import odds as O


def with_exprs(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """``withColumns`` for SQL text."""
    return df.withColumns({name: F.expr(text) for name, text in exprs.items()})


def leg_view(legs: DataFrame) -> DataFrame:
    """Add the favourite, outsider, implied and crowd columns every coupon metric reads.

    A leg "has odds" here when any of the three is positive.
    """
    return with_exprs(with_exprs(legs, {"fav": O.FAVOURITE, "outsider": O.OUTSIDER}), {
        "fav_index": O.first_index_of(O.ODDS, "fav"),
        "outsider_index": O.first_index_of(O.ODDS, "outsider"),
        "spread": "outsider - fav",
        "qsum": " + ".join(f"(CASE WHEN {c} > 0 THEN 1.0D / {c} ELSE 0.0D END)" for c in O.ODDS),
        "has_share": " OR ".join(f"({c} > 0)" for c in O.SHARES),
        "ssum": " + ".join(O.SHARES),
        "crowd_index": O.first_max_index(*O.SHARES),
        "realised": "CASE result WHEN '1' THEN {} WHEN 'N' THEN {} WHEN '2' THEN {} END".format(
            *(f"({O.positive(c)})" for c in O.ODDS)),
    })


def leg_scores(view: DataFrame) -> DataFrame:
    """Add concentration, forecast error and vote dispersion per leg."""
    p = {k: f"(CASE WHEN {c} > 0 THEN 1.0D / {c} / qsum ELSE 0.0D END)" for k, c in zip(O.SUFFIXES, O.ODDS)}
    staged = with_exprs(view, {f"p{k}": x for k, x in p.items()})

    def distance(index: str) -> str:
        terms = [f"(p{k} - IF({index} = {i}, 1.0D, 0.0D)) * (p{k} - IF({index} = {i}, 1.0D, 0.0D))"
                 for i, k in enumerate(O.SUFFIXES, start=1)]
        return " + ".join(terms)

    votes = " + ".join(
        f"(CASE WHEN {c} > 0 THEN -({c} / ssum) * log2({c} / ssum) ELSE 0.0D END)" for c in O.SHARES)
    return with_exprs(staged, {
        "result_index": O.RESULT_INDEX,
        "prob_fav": "1.0D / fav",
        "hhi": "CASE WHEN fav IS NOT NULL THEN p1 * p1 + pn * pn + p2 * p2 END",
        "margin": "CASE WHEN fav IS NOT NULL THEN qsum - 1 END",
        "brier_fav": f"CASE WHEN fav IS NOT NULL THEN {distance('fav_index')} END",
        "brier_result": f"CASE WHEN fav IS NOT NULL THEN {distance('(' + O.RESULT_INDEX + ')')} END",
        "dispersion": f"CASE WHEN ssum > 0 THEN ({votes}) / {math.log2(3)!r}D END",
        "share_fav": f"CASE WHEN fav IS NOT NULL AND has_share THEN {O.pick(O.SHARES, 'fav_index')} END",
        "share_outsider": f"CASE WHEN fav IS NOT NULL AND has_share THEN {O.pick(O.SHARES, 'outsider_index')} END",
    })


# 1 when the crowd's pick is the favourite, 0 when not, null when either side is missing.
AGREEMENT = "CASE WHEN fav IS NOT NULL AND has_share THEN IF(crowd_index = fav_index, 1.0D, 0.0D) END"
INVERSE_SPREAD = "CASE WHEN spread > 0 THEN 1.0D / spread WHEN spread IS NOT NULL THEN 10.0D END"


def leg_board(legs: DataFrame) -> DataFrame:
    """Per leg: favourite, outsider, spread and class; legs without odds are absent."""
    return leg_view(legs).where("fav IS NOT NULL").selectExpr(
        "coupon_id", "position", "fav", "fav_index", "outsider", "outsider_index", "spread",
        f"{O.leg_category()} AS category")


def missing_odds(legs: DataFrame) -> DataFrame:
    """Legs lacking at least one of the three odds, per coupon."""
    return legs.groupBy("coupon_id").agg(
        F.expr(f"count_if(NOT {O.ALL_ODDS})").alias("n_missing"), F.count(F.lit(1)).alias("n_legs"))
