"""Match-level analysis: home advantage, bookmaker calibration, result shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pooltide.functions import odds as O
from pooltide.operators.legs import with_exprs

_COUNTS = {"n_1": "count_if(result = '1')", "n_n": "count_if(result = 'N')", "n_2": "count_if(result = '2')"}
_SHARES = {"pct_home": "n_1 / n_matches", "pct_draw": "n_n / n_matches", "pct_away": "n_2 / n_matches"}

# Upper edges of the calibration bands (right-closed).
BANDS = tuple(f"{10 * k}-{10 * (k + 1)}%" for k in range(10))


def with_dimensions(matches: DataFrame, competitions: DataFrame, odds: DataFrame | None = None) -> DataFrame:
    """Matches with their competition, and with their odds when given (one row per match)."""
    out = matches.join(competitions.select(
        F.col("id").alias("competition_id"), F.col("name").alias("league"), "country"), "competition_id")
    if odds is not None:
        out = out.join(odds.select(F.col("match_id").alias("id"), *O.ODDS), "id")
    return out


def home_advantage(matches: DataFrame) -> DataFrame:
    """Shares of home win, draw and away win per league and country, strongest home side first."""
    counted = matches.where("result IN ('1', 'N', '2')").groupBy("league", "country").agg(
        F.count(F.lit(1)).alias("n_matches"), *(F.expr(x).alias(k) for k, x in _COUNTS.items()))
    return with_exprs(counted, _SHARES).drop(*_COUNTS).orderBy(F.col("pct_home").desc(), "league", "country")


def odds_calibration(matches: DataFrame) -> DataFrame:
    """Implied probability against hit rate in ten right-closed bands; empty bands are kept.

    Three rows per match, one per outcome. Matches lacking an odd are left out.
    """
    p = O.implied_probabilities()
    outcomes = ", ".join(
        f"named_struct('p', {p[f'odds_p{k}']}, 'hit', int(result = '{o}'))" for k, o in zip(O.SUFFIXES, O.OUTCOMES))
    ladder = "CASE WHEN p <= 0 THEN NULL " + " ".join(
        f"WHEN p <= {(k + 1) / 10!r}D THEN {k}" for k in range(10)) + " END"
    observed = (
        matches.where(f"result IS NOT NULL AND {O.ALL_ODDS}")
        .selectExpr(f"inline(array({outcomes}))").selectExpr("*", f"{ladder} AS band")
        .groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_implied"), F.avg("hit").alias("hit_rate")))
    names = ", ".join(f"named_struct('band', {k}, 'probability_band', '{b}')" for k, b in enumerate(BANDS))
    bands = matches.sparkSession.range(1).selectExpr(f"inline(array({names}))")
    return bands.join(observed, "band", "left").selectExpr(
        "probability_band", "coalesce(n, 0) AS n_matches", "mean_implied", "hit_rate")


def results_distribution(matches: DataFrame, league: str | None = None, season: str | None = None) -> DataFrame:
    """Counts and shares of the three results, optionally of one league and season."""
    kept = matches.where("result IN ('1', 'N', '2')")
    if league is not None:
        kept = kept.where(F.col("league") == league)
    if season is not None:
        kept = kept.where(F.col("season") == season)
    counted = kept.agg(F.count(F.lit(1)).alias("total"), *(F.expr(x).alias(k) for k, x in _COUNTS.items()))
    return with_exprs(counted, {
        f"pct_{k[2:]}": f"IF(total > 0, {k} / total, 0.0D)" for k in _COUNTS})
