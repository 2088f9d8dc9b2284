"""Evaluating predictions, and four simple predictors to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pooltide.functions import odds as O
from pooltide.operators.legs import with_exprs

_PROBS = ("prob_1", "prob_n", "prob_2")
_CLIP = "greatest(1e-7D, least(1.0D - 1e-7D, {}))"


def _sums(prefix: str, prediction: str, probs: tuple[str, str, str]) -> list[Column]:
    """Aggregates of one predictor, given as SQL expressions over a leg."""
    truth = "CASE result WHEN '1' THEN {} WHEN 'N' THEN {} ELSE {} END".format(*probs)
    backed = f"CASE {prediction} WHEN '1' THEN odds_1 WHEN 'N' THEN odds_n ELSE odds_2 END"
    return [F.expr(x).alias(f"{prefix}_{k}") for k, x in {
        "accuracy": f"avg(int({prediction} = result))", "log_loss": f"avg(-ln({_CLIP.format(truth)}))", "stake": f"count_if({backed} > 0)",
        "gains": f"coalesce(sum(CASE WHEN {backed} > 0 AND {prediction} = result THEN {backed} END), 0.0D)"}.items()]


def _measures(prefix: str) -> str:
    p = f"{prefix}_"
    return (f"n_legs, {p}accuracy AS accuracy, {p}log_loss AS log_loss, {p}stake AS stake, {p}gains AS gains, "
            f"coalesce(try_divide({p}gains - {p}stake, {p}stake), 0.0D) AS roi")


_PLAYED = "result IN ('1', 'N', '2')"


def evaluate(predictions: DataFrame) -> DataFrame:
    """Accuracy, clipped log loss and flat-stake ROI of ``prediction`` and ``prob_*`` against ``result``.

    One unit is staked on every leg whose predicted outcome has positive odds.
    """
    sums = predictions.where(_PLAYED).agg(F.count(F.lit(1)).alias("n_legs"), *_sums("own", "prediction", _PROBS))
    return sums.selectExpr(f"inline(array(struct({_measures('own')})))")


def _draw(seed: int) -> str:
    """SQL: a repeatable number in [0, 1) per leg, free of row order and partitioning."""
    return f"(conv(substr(md5(concat_ws('-', coupon_id, position, {seed})), 1, 8), 16, 10) / 4294967296.0D)"


def _at(draw: str, first: str, second: str) -> str:
    return f"CASE WHEN {draw} < {first} THEN '1' WHEN {draw} < {second} THEN 'N' ELSE '2' END"


def random_baseline(legs: DataFrame, seed: int = 42) -> DataFrame:
    """Any outcome with equal chance."""
    return with_exprs(legs, {**{p: O.THIRD for p in _PROBS}, "prediction": _at(_draw(seed), O.THIRD, f"2 * {O.THIRD}")})


def home_baseline(legs: DataFrame) -> DataFrame:
    """Always the home side."""
    return with_exprs(legs, {"prob_1": "1.0D", "prob_n": "0.0D", "prob_2": "0.0D", "prediction": "'1'"})


def favourite_baseline(legs: DataFrame) -> DataFrame:
    """The most probable outcome: given probabilities, else the odds', else 1/3 each."""
    implied = O.implied_probabilities()
    given = all(p in legs.columns for p in _PROBS)
    exprs = {p: (f"IF(prob_1 IS NOT NULL, {p}, {implied[f'odds_p{k}']})" if given else implied[f"odds_p{k}"])
             for p, k in zip(_PROBS, O.SUFFIXES)}
    return with_exprs(with_exprs(legs, exprs), {"prediction": O.outcome("(" + O.first_max_index(*_PROBS) + ")")})


def distribution_baseline(legs: DataFrame, seed: int = 42) -> DataFrame:
    """Outcomes drawn by their share among all legs."""
    shares = legs.where("result IN ('1', 'N', '2')").agg(F.expr(
        "named_struct('home', avg(int(result = '1')), 'draw', avg(int(result = 'N')), 'away', avg(int(result = '2')))").alias("s")).scalar()
    spread = with_exprs(legs.withColumn("_s", shares), {"prob_1": "_s.home", "prob_n": "_s.draw", "prob_2": "_s.away"}).drop("_s")
    return with_exprs(spread, {"prediction": _at(_draw(seed), "prob_1", "prob_1 + prob_n")})


def compare_baselines(legs: DataFrame, seed: int = 42) -> DataFrame:
    """The four baselines side by side: one pass over the legs, all predictors' sums in one aggregate.

    The shares that the distribution draws from come from the same legs first, as one scalar.
    """
    played = legs.where(_PLAYED)
    shares = played.agg(F.expr("named_struct(" + ", ".join(f"'p{k}', avg(int(result = '{k}'))" for k in "1N2") + ")").alias("s")).scalar()
    third, own = (O.THIRD,) * 3, ("_s.p1", "_s.pN", "_s.p2")
    ready = favourite_baseline(played).withColumnRenamed("prediction", "favourite").withColumn("_s", shares).withColumn("_u", F.expr(_draw(seed)))
    predictors = {
        "random": (_at("_u", O.THIRD, f"2 * {O.THIRD}"), third), "always_home": ("'1'", ("1.0D", "0.0D", "0.0D")),
        "odds_favorite": ("favourite", _PROBS), "distribution": (_at("_u", own[0], f"{own[0]} + {own[1]}"), own)}
    picks = ready.selectExpr("*", *(f"{pick} AS pick_{name}" for name, (pick, _) in predictors.items()))
    sums = picks.agg(F.count(F.lit(1)).alias("n_legs"), *(x for name, (_, probs) in predictors.items() for x in _sums(name, f"pick_{name}", probs)))
    rows = ", ".join("struct('{0}' AS name, {1})".format(name, _measures(name)) for name in predictors)
    return sums.selectExpr(f"inline(array({rows}))")
