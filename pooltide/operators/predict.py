"""Blended outcome prediction of legs.

Each step is its own projection, so Catalyst keeps the shared parts as columns
instead of repeating them inside one large expression.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from pooltide.functions import odds as O
from pooltide.functions.numeric import rounded
from pooltide.operators.coupons import basic_metrics
from pooltide.operators.legs import AGREEMENT, INVERSE_SPREAD, leg_view, with_exprs


class Weights(NamedTuple):
    """Weights of the five signals."""

    odds: float
    crowd: float
    tip: float
    difficulty: float
    prior: float


# Signal weights per strategy.
CAUTIOUS = Weights(0.70, 0.10, 0.05, 0.10, 0.05)
BALANCED = Weights(0.60, 0.15, 0.10, 0.10, 0.05)
BOLD = Weights(0.45, 0.20, 0.15, 0.10, 0.10)
STRATEGIES = {"cautious": CAUTIOUS, "balanced": BALANCED, "bold": BOLD}

METRIC_COLUMNS = ("difficulty", "moyenne_cote_fav", "inv_spread_sum", "std_cote_fav", "accord_cotes_joueurs")

# The ordered rules of the risk profile. A null never matches.
RISK_PROFILE = """CASE
  WHEN inv_spread_sum < 2.0D THEN 'secure'
  WHEN inv_spread_sum > 3.5D THEN 'risky'
  WHEN accord_cotes_joueurs > 0.80D THEN 'secure'
  WHEN std_cote_fav < 0.26D THEN 'secure'
  WHEN difficulty < 5.0D AND moyenne_cote_fav < 1.70D THEN 'secure'
  WHEN difficulty > 8.0D THEN 'risky'
  WHEN moyenne_cote_fav > 2.20D THEN 'risky'
  ELSE 'balanced' END"""

_SIGNALS = ("odds", "crowd", "tip", "adjusted")
LEG_SIGNALS = (*(f"{s}_p{k}" for s in _SIGNALS[:3] for k in O.SUFFIXES), "has_odds", "has_crowd", "has_tip", "top")


def with_window_metrics(legs: DataFrame, headers: DataFrame) -> DataFrame:
    """Legs with the stored-form metrics of their coupon, computed in place.

    Windows over the coupon instead of an aggregate joined back: the legs are
    shuffled once. ``headers`` gives the difficulty. The signals of single legs are
    computed below the windows: together with the blend above them, Spark would
    generate one method, too long for the JVM to compile.
    """
    over = "OVER (PARTITION BY coupon_id)"
    sums = with_exprs(leg_signals(leg_view(legs)), {
        "_mean": f"avg(fav) {over}", "_sd": f"stddev_samp(fav) {over}",
        "_spread": f"sum({INVERSE_SPREAD}) {over}", "_agree": f"avg({AGREEMENT}) {over}"})
    stored = lambda x, digits: f"coalesce({rounded(x, digits)}, 0.0D)"
    rated = sums.selectExpr(
        *legs.columns, *LEG_SIGNALS, f"{stored('_mean', 2)} AS moyenne_cote_fav", f"{stored('_sd', 4)} AS std_cote_fav",
        f"{stored('_spread', 4)} AS inv_spread_sum", f"{stored('_agree', 4)} AS accord_cotes_joueurs")
    return rated.join(headers.select("coupon_id", "difficulty"), "coupon_id", "left")


def with_metrics(legs: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Attach coupon metrics to the legs.

    ``metrics`` holds one row per coupon with any of METRIC_COLUMNS; legs that
    already carry all of them need none. Without a
    ``moyenne_cote_fav`` the mean favourite odds are computed from the legs and
    the other rules stay unused.
    """
    if metrics is None:
        if set(METRIC_COLUMNS) <= set(legs.columns):
            return legs
        metrics = basic_metrics(legs)
    elif "moyenne_cote_fav" not in metrics.columns:
        metrics = metrics.join(basic_metrics(legs).select("coupon_id", "moyenne_cote_fav"), "coupon_id", "left")
    known = [k if k in metrics.columns else f"CAST(NULL AS DOUBLE) AS {k}" for k in METRIC_COLUMNS]
    return legs.join(metrics.selectExpr("coupon_id", *known), "coupon_id", "left")


def leg_signals(legs: DataFrame) -> DataFrame:
    """Add LEG_SIGNALS: the signals that need no coupon, with presence flags and the odds' favourite."""
    first = with_exprs(legs, {
        **O.implied_probabilities(), **O.crowd_probabilities(), **O.tip_probabilities(),
        "has_odds": O.ALL_ODDS, "has_crowd": " + ".join(O.SHARES) + " > 0", "has_tip": O.HAS_TIP})
    return with_exprs(first, {"top": O.first_max_index(*(f"odds_p{k}" for k in O.SUFFIXES))})


def signals(legs_with_metrics: DataFrame) -> DataFrame:
    """Probabilities of the four data-driven signals, with presence flags.

    The fourth signal is the odds signal moved by the risk profile: a secure
    coupon strengthens the favourite, a risky one is flattened. Legs that already
    carry all LEG_SIGNALS keep them.
    """
    ready = legs_with_metrics if set(LEG_SIGNALS) <= set(legs_with_metrics.columns) else leg_signals(legs_with_metrics)
    second = with_exprs(ready, {"risk_profile": RISK_PROFILE})
    p = [f"odds_p{k}" for k in O.SUFFIXES]
    third = with_exprs(second, {
        f"moved_{k}": f"CASE risk_profile WHEN 'secure' THEN {c} + IF(top = {i}, 0.05D, 0.0D) "
                      f"WHEN 'risky' THEN 0.8D * {c} + 0.2D * {O.THIRD} ELSE {c} END"
        for i, (k, c) in enumerate(zip(O.SUFFIXES, p), start=1)})
    total = " + ".join(f"moved_{k}" for k in O.SUFFIXES)
    moved = [f"moved_{k}" for k in O.SUFFIXES]
    return with_exprs(third, {f"adjusted_p{k}": f"moved_{k} / ({total})" for k in O.SUFFIXES}).drop(*moved, "top")


def blended(df: DataFrame, weights: tuple[str, str, str, str, str]) -> DataFrame:
    """Mix the signals with five weight expressions; a missing signal's weight goes to the others.

    The difficulty signal keeps its weight even when the leg has no odds.
    """
    w_odds, w_crowd, w_tip, w_difficulty, w_prior = weights
    kept = with_exprs(df, {
        "k1": f"IF(has_odds, {w_odds}, 0.0D)", "k2": f"IF(has_crowd, {w_crowd}, 0.0D)",
        "k3": f"IF(has_tip, {w_tip}, 0.0D)", "k4": w_difficulty, "k5": w_prior})
    kept = with_exprs(kept, {"kept_weight": "k1 + k2 + k3 + k4 + k5"})
    scaled = with_exprs(kept, {
        f"s{i}": f"IF(kept_weight > 0, k{i} / kept_weight, k{i})" for i in range(1, 6)})
    mixed = with_exprs(scaled, {
        f"mix_{k}": f"s1 * odds_p{k} + s2 * crowd_p{k} + s3 * tip_p{k} + s4 * adjusted_p{k} + s5 * {prior}D"
        for k, prior in zip(O.SUFFIXES, O.PRIOR)})
    total = "(mix_1 + mix_n + mix_2)"
    out = with_exprs(mixed, {
        f"prob_{k}": f"IF({total} > 0, mix_{k} / {total}, {O.THIRD})" for k in O.SUFFIXES})
    return with_exprs(out, {
        "prediction": O.outcome("(" + O.first_max_index("prob_1", "prob_n", "prob_2") + ")"),
    }).drop("kept_weight", *(f"{x}{i}" for x in "ks" for i in range(1, 6)), *(f"mix_{k}" for k in O.SUFFIXES))


def literal_weights(w: Weights) -> tuple[str, ...]:
    return tuple(f"{x!r}D" for x in w)


def score_legs(legs: DataFrame, weights: Weights = BALANCED) -> DataFrame:
    """Prediction of single legs that belong to no coupon: the risk profile stays balanced."""
    bare = with_exprs(legs, {k: "CAST(NULL AS DOUBLE)" for k in METRIC_COLUMNS})
    return _finished(blended(signals(bare), literal_weights(weights)))


def predict_legs(legs: DataFrame, metrics: DataFrame | None = None, weights: Weights = BALANCED) -> DataFrame:
    """Outcome probabilities, pick and confidence per leg.

    Confidence is the gap between the two largest probabilities. The coupon's
    risk profile is kept, for reports.
    """
    return _finished(blended(signals(with_metrics(legs, metrics)), literal_weights(weights)))


def _finished(mixed: DataFrame) -> DataFrame:
    top = "greatest(prob_1, prob_n, prob_2)"
    return with_exprs(mixed, {
        "confidence": f"{top} - (prob_1 + prob_n + prob_2 - {top} - least(prob_1, prob_n, prob_2))",
    }).drop("has_odds", "has_crowd", "has_tip", *METRIC_COLUMNS,
            *(f"{s}_p{k}" for s in _SIGNALS for k in O.SUFFIXES))
