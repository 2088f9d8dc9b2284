"""What goes with what: correlations, combinations, thresholds, profiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pooltide.functions.numeric import rounded
from pooltide.operators.legs import with_exprs
from pooltide.operators.moments import merged_pairs, pair_parts
from pooltide.operators.quantiles import exact_quantiles, unpivoted
from pooltide.plans import metrics as M


def correlation_matrix(features: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every ordered pair of numeric columns; null beside a constant column."""
    pairs = merged_pairs(pair_parts(features, columns, columns), ["left", "right"])
    return pairs.selectExpr("left AS feature_a", "right AS feature_b", "n", "r")


def correlation_coefficients(features: DataFrame, by: str | None = None, minimum: int = 10) -> DataFrame:
    """r, slope and intercept of every pre/post pair with enough coupons and three distinct values a side."""
    keys = [by, "left", "right"] if by else ["left", "right"]
    pairs = merged_pairs(pair_parts(features, list(M.PRE), list(M.POST), by=by), keys)
    return pairs.where(f"n >= {minimum} AND distinct_x >= 3 AND distinct_y >= 3 AND r IS NOT NULL AND NOT isnan(r)")


def correlation_table(features: DataFrame) -> DataFrame:
    """The pre/post correlation table with the share of residuals within one and half a deviation.

    Runs one job: the fitted lines (at most one per pair, 1980) come to the
    driver as model parameters and go back out with the second pass.
    """
    fits = correlation_coefficients(features).select(
        "left", "right", "n", "r", "slope", "intercept", "residual_sd").toPandas()
    groups = []
    for name, part in fits.groupby("left", sort=False):
        groups.append((name, part["right"].tolist(), part["slope"].to_numpy(), part["intercept"].to_numpy(),
                       part["residual_sd"].to_numpy()))

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for name, rights, slope, intercept, sd in groups:
                gap = np.abs(batch[rights].to_numpy(dtype=float)
                             - (batch[[name]].to_numpy(dtype=float) * slope + intercept))
                wide, tight = (gap < sd).sum(axis=0), (gap < 0.5 * sd).sum(axis=0)
                for j, right in enumerate(rights):
                    held = counts.setdefault((name, right), [0, 0])
                    held[0] += int(wide[j])
                    held[1] += int(tight[j])
        if counts:
            yield pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=["left", "right", "wide", "tight"])

    spark = features.sparkSession
    lines = spark.createDataFrame(fits, "left string, right string, n bigint, r double, slope double, intercept double, residual_sd double")
    bands = features.select(*M.PRE, *M.POST).mapInPandas(
        residuals, "left string, right string, wide bigint, tight bigint",
    ).groupBy("left", "right").agg(F.sum("wide").alias("wide"), F.sum("tight").alias("tight"))
    return lines.join(F.broadcast(bands), ["left", "right"]).selectExpr(
        "left AS pre", "right AS post", f"{rounded('r', 4)} AS r", f"{rounded('r * r', 4)} AS r2",
        f"{rounded('slope', 6)} AS slope", f"{rounded('intercept', 4)} AS intercept", "n",
        f"{rounded('wide / n * 100', 1)} AS pct_in_1std", f"{rounded('tight / n * 100', 1)} AS pct_in_half_std",
        f"{rounded('residual_sd', 4)} AS std_residuals")


COMBO_PAIRS = tuple(combinations(M.COMBO_PRE, 2))
COMBO_NAMES = tuple(name for a, b in COMBO_PAIRS for name in (f"{a}/{b}", f"{a}*{b}"))


def _combo_columns(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Ratio and product of every pair of columns; a zero denominator gives NaN."""
    values = {c: frame[c].to_numpy(dtype=float) for c in M.COMBO_PRE}
    out = np.empty((len(frame), len(COMBO_NAMES)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, (a, b) in enumerate(COMBO_PAIRS):
            out[:, 2 * k] = np.where(values[b] != 0, values[a] / values[b], np.nan)
            out[:, 2 * k + 1] = values[a] * values[b]
    return list(COMBO_NAMES), out


def combo_correlations(features: DataFrame, top: int = 50, minimum_r: float = 0.35) -> DataFrame:
    """Ratios and products of two features most correlated with a target."""
    pairs = merged_pairs(pair_parts(
        features, list(M.COMBO_PRE), list(M.COMBO_TARGETS), derive=_combo_columns), ["left", "right"])
    kept = pairs.where(f"n >= 10 AND distinct_x >= 3 AND distinct_y >= 3 AND NOT isnan(r) AND abs(r) > {minimum_r}D")
    names = ", ".join(f"'{n}'" for n in COMBO_NAMES)
    targets = ", ".join(f"'{n}'" for n in M.COMBO_TARGETS)
    place = with_exprs(kept, {
        "p": f"array_position(array({names}), left) - 1", "t": f"array_position(array({targets}), right)"})
    return place.selectExpr(
        "left AS combo", "right AS post", f"{rounded('r', 4)} AS r", f"{rounded('r * r', 4)} AS r2", "n",
        "IF(p % 2 = 0, 'ratio', 'product') AS kind", "p", "t",
    ).orderBy(F.abs("r").desc(), F.expr("p div 2"), "t", "p").limit(top).drop("p", "t")


def profile_analysis(features: DataFrame) -> DataFrame:
    """Frequency of every outcome profile, with means for profiles seen at least twice."""
    means = {
        "moy_difficulty": ("difficulty", 2), "moy_cote_fav": ("moy_cote_fav", 2),
        "moy_nb_surprises": ("nb_surprises", 2), "moy_montant_parfait": ("montant_parfait", 2),
        "moy_gagnants_parfait": ("gagnants_parfait", 1), "moy_pct_fav_gagne": ("pct_fav_gagne", 3),
        "moy_accord_cotes_joueurs": ("accord_cotes_joueurs", 3),
    }
    grouped = features.where("profil <> ''").groupBy("profil").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"_{k}") for k, (c, _) in means.items()))
    return grouped.selectExpr("profil", "n", *(
        f"CASE WHEN n >= 2 THEN {rounded(f'_{k}', d)} END AS {k}" for k, (_, d) in means.items()))


def _with_distinct(long: DataFrame, least: int) -> DataFrame:
    """Metrics holding at least ``least`` distinct values.

    Values of different hash are different, so a bitmap of hashes with that many bits proves it;
    columns it doesn't prove are counted exactly.
    """
    bits = long.groupBy("metric").agg(F.expr("bitmap_count(bitmap_construct_agg(pmod(xxhash64(x), 32768)))").alias("d"))
    poor = long.join(F.broadcast(bits.where(f"d < {least}")), "metric").groupBy("metric").agg(F.countDistinct("x").alias("d"))
    return bits.where(f"d >= {least}").select("metric").unionByName(poor.where(f"d >= {least}").select("metric"))


def threshold_effects(features: DataFrame) -> DataFrame:
    """For each feature and target the quantile split with the largest effect, where it exceeds 0.4.

    Effect is the gap between the two means over the overall deviation. The
    first of equal effects wins.
    """
    pre, targets = list(M.THRESHOLD_PRE), list(M.THRESHOLD_TARGETS)
    cuts = exact_quantiles(features, pre, list(M.THRESHOLD_QUANTILES)).selectExpr(
        "metric", "prob", f"{rounded('value', 9)} AS threshold")
    long = unpivoted(features, pre, targets)
    rich = _with_distinct(long.select("metric", "x"), 5)
    # 18 features x 5 quantiles: the cut table is bounded, so it is broadcast.
    split = long.join(F.broadcast(cuts.join(rich, "metric", "left_semi")), "metric")
    sums = [F.expr("count_if(x <= threshold)").alias("n_below"), F.expr("count_if(x > threshold)").alias("n_above")]
    for t in targets:
        sums += [F.expr(f"avg(CASE WHEN x <= threshold THEN {t} END)").alias(f"b_{t}"),
                 F.expr(f"avg(CASE WHEN x > threshold THEN {t} END)").alias(f"a_{t}"),
                 F.stddev_samp(t).alias(f"s_{t}")]
    per_cut = split.groupBy("metric", "prob", "threshold").agg(*sums).where("n_below >= 5 AND n_above >= 5")
    items = ", ".join(
        f"named_struct('target', '{t}', 'mean_below', b_{t}, 'mean_above', a_{t}, 'sd', s_{t})" for t in targets)
    effects = with_exprs(
        per_cut.selectExpr("metric AS pre", "prob", "threshold", "n_below", "n_above", f"inline(array({items}))"),
        {"effect": rounded("CASE WHEN sd > 0 THEN abs(mean_above - mean_below) / sd ELSE 0.0D END", 9)},
    ).where("effect > 0")
    best = with_exprs(effects, {"place": "row_number() OVER (PARTITION BY pre, target ORDER BY effect DESC, prob)"})
    gap = "abs(mean_above - mean_below) / abs(mean_below) * 100"
    return best.where("place = 1").selectExpr(
        "pre", "target", f"{rounded('threshold', 3)} AS threshold", "prob AS quantile",
        f"{rounded('mean_below', 3)} AS mean_below", f"{rounded('mean_above', 3)} AS mean_above",
        "n_below", "n_above", f"{rounded('effect', 3)} AS effect_size",
        f"CASE WHEN mean_below <> 0 THEN {rounded(gap, 1)} ELSE 0.0D END AS diff_pct",
    ).where("effect_size > 0.4D")


def describe(features: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, median, minimum, maximum and sample deviation per column (and group)."""
    keys = [*(by or []), "metric"]
    basics = unpivoted(features, columns, by or []).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.expr("coalesce(stddev_samp(x), 0.0D)").alias("std"))
    medians = exact_quantiles(features, columns, [0.5], by).selectExpr(*keys, "value AS median")
    return basics.join(medians, keys)
