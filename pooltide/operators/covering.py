"""Reduced covering systems for many selections at once.

A system is one row: the outcomes chosen per leg and the guarantees asked for. A
system of many combinations is split on its widest legs: all outcomes of those are
played, and what is left is covered. Such a part meets the guarantees wherever the
split legs stand, so the whole does, and all parts have the same cover. A cover
depends only on how many outcomes each leg has, so every shape is solved once, by a
greedy set cover in one task over at most ``PART_COMBINATIONS`` combinations.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pooltide.operators.legs import with_exprs
from pooltide.operators.staging import spread, staged

# Fixed value: combinations that are covered as a whole; larger systems are split until their parts have no more.
PART_COMBINATIONS = 5000

#: Combinations compared with a chosen set at a time.
_REACHED_AT_ONCE = 1024

#: Stands in a chosen combination for a leg whose outcomes are all played.
ALL = "*"

# Legs of a system as a SQL array of outcome arrays, in combination order.
COMBINATIONS = """aggregate(selections, array(''), (acc, options) ->
  flatten(transform(acc, a -> transform(options, o -> concat(a, o)))))"""

_ERRORS = f"""CASE
  WHEN selections IS NULL OR size(selections) = 0 THEN 'no selection'
  WHEN exists(selections, s -> s IS NULL OR size(s) = 0) THEN 'leg without option'
  WHEN exists(selections, s -> size(array_distinct(s)) < size(s)) THEN 'duplicate option'
  WHEN exists(selections, s -> size(array_except(s, array('1', 'N', '2'))) > 0) THEN 'invalid option'
  WHEN guarantees IS NULL OR size(guarantees) = 0 THEN 'no guarantee'
  WHEN exists(guarantees, g -> g.radius < 0 OR g.radius >= size(selections)) THEN 'invalid radius'
  WHEN exists(guarantees, g -> g.coverage <= 0 OR g.coverage > 1) THEN 'invalid coverage'
  WHEN n_combinations IS NULL THEN 'too many combinations' END"""


def combination_counts(systems: DataFrame) -> DataFrame:
    """Doubles, triples and the number of combinations per system (null beyond 64 bits)."""
    return with_exprs(systems, {
        "n_doubles": "size(filter(selections, s -> size(s) = 2))",
        "n_triples": "size(filter(selections, s -> size(s) = 3))",
        "n_combinations": "aggregate(selections, CAST(1 AS BIGINT), (acc, s) -> try_multiply(acc, CAST(size(s) AS BIGINT)))",
    })


def validated(systems: DataFrame) -> DataFrame:
    """Systems with their number of combinations and the first validation error, if any."""
    return with_exprs(combination_counts(systems), {"error": _ERRORS})


def _cover(selections: list[list[str]], guarantees: list[tuple[int, float]]) -> list[str]:
    """Greedy cover: per tier, in ascending radius, take the combination that covers most of what is left."""
    combos = ["".join(c) for c in product(*selections)]
    total = len(combos)
    if total == 1:
        return combos
    codes = np.array([np.frombuffer(c.encode("ascii"), dtype=np.uint8) for c in combos])
    distance = np.zeros((total, total), dtype=np.uint8)
    for leg in range(codes.shape[1]):
        distance += codes[:, leg][:, None] != codes[:, leg][None, :]
    chosen: list[int] = []
    for radius, coverage in guarantees:
        # Symmetric, so the rows of newly covered combinations are the columns to subtract.
        within = (distance <= radius).view(np.uint8)
        covered = within[chosen].any(axis=0) if chosen else np.zeros(total, dtype=bool)
        gains = within[~covered].sum(axis=0, dtype=np.int32)
        gains[chosen] = -1
        target = ceil(coverage * total)
        n_covered = int(covered.sum())
        while n_covered < target:
            best = int(gains.argmax())
            fresh = np.flatnonzero(within[best] & ~covered)
            chosen.append(best)
            covered[fresh] = True
            n_covered += len(fresh)
            gains -= within[fresh].sum(axis=0, dtype=np.int32)
            gains[best] = -1
    return [combos[i] for i in chosen]


def split_systems(systems: DataFrame) -> DataFrame:
    """Valid systems with the legs to play in full (``split``, widest first) and the legs that vary beside them."""
    order = "array_sort(transform(selections, (s, i) -> struct(-size(s) AS neg, i AS leg)))"
    split = (f"aggregate({order}, named_struct('left', n_combinations, 'legs', CAST(array() AS ARRAY<INT>)), (acc, x) -> "
             f"IF(acc.left > {PART_COMBINATIONS}, named_struct('left', acc.left DIV -x.neg, 'legs', array_append(acc.legs, x.leg)), acc), acc -> acc.legs)")
    legs = with_exprs(validated(systems).where("error IS NULL"), {"split": split})
    varied = "filter(sequence(0, size(selections) - 1), i -> size(selections[i]) > 1 AND NOT array_contains(split, i))"
    return with_exprs(with_exprs(legs, {"varied": varied}), {
        "shape": "transform(varied, i -> size(selections[i]))", "tiers": "array_sort(transform(guarantees, g -> struct(g.radius, g.coverage)))"})


def covering_systems(systems: DataFrame) -> DataFrame:
    """A set of combinations meeting the guarantees, per system.

    ``systems`` has ``system_id``, ``selections`` (array of outcome arrays) and
    ``guarantees`` (array of radius/coverage structs: that share of all
    combinations lies within ``radius`` wrong legs of a chosen one). ``grids`` has
    ``*`` for a leg whose outcomes are all played: such an entry stands for several
    combinations, which ``n_grids`` counts and ``expanded_grids`` lists.
    """
    parts = staged(split_systems(systems), "system_parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            covers = [[[int(o) for o in c] for c in _cover(["012"[:n] for n in row.shape], [(t["radius"], t["coverage"]) for t in row.tiers])]
                      for row in batch.itertuples(index=False)]
            yield batch[["shape", "tiers"]].assign(cover=covers)

    # Written first: the shuffle of the distinct rows would stand for the one asked for, and be merged into a task by size.
    shapes = spread(staged(parts.select("shape", "tiers").distinct(), "system_shapes"), "shape", "tiers")
    kinds = dict(parts.dtypes)
    solved = shapes.mapInPandas(run, f"shape {kinds['shape']}, tiers {kinds['tiers']}, cover array<array<int>>")
    leg = (f"CASE WHEN array_contains(split, i) THEN '{ALL}' WHEN size(s) = 1 THEN s[0] "
           "ELSE s[c[int(array_position(varied, i)) - 1]] END")
    joined = parts.join(solved, ["shape", "tiers"]).selectExpr(
        "system_id", f"transform(cover, c -> array_join(transform(selections, (s, i) -> {leg}), '')) AS grids",
        "size(cover) * aggregate(split, CAST(1 AS BIGINT), (acc, i) -> acc * size(selections[i])) AS n_grids")
    return with_exprs(validated(systems).join(joined, "system_id", "left"), {"reduction": "1 - n_grids / n_combinations"})


def expanded_grids(covered: DataFrame) -> DataFrame:
    """(system_id, grid): every chosen combination as a row of its own."""
    rows = spread(covered.where("error IS NULL"), "system_id").selectExpr("system_id", "selections", "explode(grids) AS g")
    pick = (f"aggregate(selections, array(''), (acc, options) -> flatten(transform(acc, a -> transform("
            f"IF(substr(g, length(a) + 1, 1) = '{ALL}', options, array(substr(g, length(a) + 1, 1))), o -> concat(a, o)))))")
    return rows.selectExpr("system_id", f"explode({pick}) AS grid")


def _reached(sizes: list[int], codes: list[int]) -> np.ndarray:
    """How many of all combinations differ from the nearest chosen one in 0, 1, 2 ... legs, some combinations at a time."""
    legs = range(len(sizes))
    chosen = [(np.asarray(codes, dtype=np.int64) >> 2 * (len(sizes) - 1 - i) & 3).astype(np.uint8) for i in legs]
    total = int(np.prod(sizes, dtype=np.int64))
    found = np.zeros(len(sizes) + 1, dtype=np.int64)
    for block in range(0, total, _REACHED_AT_ONCE):
        number = np.arange(block, min(block + _REACHED_AT_ONCE, total))
        wrong = np.zeros((len(number), len(codes)), dtype=np.uint8)
        for i in reversed(legs):
            number, place = np.divmod(number, sizes[i])
            wrong += (place + 1).astype(np.uint8)[:, None] != chosen[i][None, :]
        found += np.bincount(wrong.min(axis=1), minlength=len(found))
    return found


def coverage(covered: DataFrame) -> DataFrame:
    """Share of a system's combinations within each guaranteed radius of a chosen one.

    A leg with one outcome, or played in full, is never wrong; the others are
    compared as numbers of two bits a leg, the place of an outcome among those of its
    leg. They have at most ``PART_COMBINATIONS`` combinations, so at most twelve legs.
    Distances depend on these numbers alone: each different set of them is compared
    once, with all its combinations, for all the systems that have it.
    """
    legs = with_exprs(covered.where("error IS NULL"), {
        "compared": f"filter(sequence(0, size(selections) - 1), i -> size(selections[i]) > 1 AND NOT exists(grids, g -> substr(g, i + 1, 1) = '{ALL}'))"})
    grid_code = ("aggregate(compared, CAST(0 AS BIGINT), (acc, i) -> acc * 4 + array_position(selections[i], substr(g, i + 1, 1)))")
    coded = staged(legs.selectExpr(
        "system_id", "guarantees", "transform(compared, i -> size(selections[i])) AS sizes", f"transform(grids, g -> {grid_code}) AS codes"), "coded_systems")
    # Ids are drawn once: the table is written.
    sets = staged(coded.select("sizes", "codes").distinct().withColumn("set_id", F.monotonically_increasing_id()), "coded_sets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(row.set_id, wrong, int(n)) for row in batch.itertuples(index=False)
                                for wrong, n in enumerate(_reached(row.sizes, row.codes)) if n], columns=["set_id", "wrong", "n"])

    nearest = spread(sets, "set_id").mapInPandas(run, "set_id bigint, wrong int, n bigint").groupBy("set_id").agg(
        F.expr("collect_list(struct(wrong, n))").alias("reach"))
    asked = coded.join(sets, ["sizes", "codes"]).join(nearest, "set_id").selectExpr("system_id", "reach", "inline(guarantees)")
    share = "aggregate({}, CAST(0 AS BIGINT), (acc, w) -> acc + w.n)"
    return asked.groupBy("system_id", "radius").agg(
        F.expr("max(coverage)").alias("target"),
        F.expr(f"sum({share.format('filter(reach, w -> w.wrong <= radius)')}) / sum({share.format('reach')})").alias("covered"))
