"""Pearson statistics of many column pairs in one pass.

Each task turns its Arrow batches into centred sums of squares and products for
every pair at once, chunk by chunk, merges them and emits one row per pair; the
rows of all tasks are then merged. What a task holds depends on the pairs, what is shuffled depends on the number of pairs and tasks, not on the
number of coupons.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

_PART_COLUMNS = "n bigint, sx double, sy double, cxx double, cyy double, cxy double, xs array<double>, ys array<double>"


# Rows worked on at once, and chunks whose partial sums are held before they are merged: what a task needs is bounded by both.
_CHUNK_ROWS = 20_000
_HELD_CHUNKS = 8


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join Arrow batches into frames of some size, so that one row per pair covers many coupons."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= _CHUNK_ROWS:
            yield pd.concat(held)
            held, rows = [], 0
    if rows:
        yield pd.concat(held)


def _few_distinct(values: np.ndarray) -> list[float]:
    """Up to three distinct values: enough to tell whether a column has three."""
    if values.size == 0:
        return []
    lo, hi = values.min(), values.max()
    middle = values[(values > lo) & (values < hi)]
    return [float(v) for v in ({lo, hi} | ({middle[0]} if middle.size else set()))]


def _few_of(lists: list[list[float]]) -> list[float]:
    """``_few_distinct`` of what several chunks found; NaN is above all numbers, as in Spark."""
    values = sorted({v for found in lists for v in found}, key=lambda v: (v != v, v))
    return [values[0], *([values[1]] if len(values) > 2 else []), values[-1]] if len(values) > 1 else values


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """One row per (by, left, right) for many, about the mean of all of them; NaN stays NaN."""
    keys = list(parts.columns[:3])
    place = parts.groupby(keys, sort=False).ngroup().to_numpy()
    out = parts[keys].drop_duplicates().reset_index(drop=True)
    n, sx, sy = (parts[c].to_numpy(dtype=float) for c in ("n", "sx", "sy"))

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(place, weights=values, minlength=len(out))

    out["n"], out["sx"], out["sy"] = total(n).astype(np.int64), total(sx), total(sy)
    gx, gy = (s / n - (out[c] / out["n"]).to_numpy()[place] for s, c in ((sx, "sx"), (sy, "sy")))
    for c, shift in (("cxx", gx * gx), ("cyy", gy * gy), ("cxy", gx * gy)):
        out[c] = total(parts[c].to_numpy() + n * shift)
    for c in ("xs", "ys"):
        found: list[list[list[float]]] = [[] for _ in range(len(out))]
        for k, values in zip(place, parts[c]):
            found[k].append(values)
        out[c] = [_few_of(f) for f in found]
    return out


def _pair_sums(x: np.ndarray, y: np.ndarray):
    """Centred sums of every x column against every y column."""
    n = x.shape[0]
    mx, my = x.mean(axis=0), y.mean(axis=0)
    dx, dy = x - mx, y - my
    return n, mx * n, my * n, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), dx.T @ dy


def pair_parts(
    df: DataFrame,
    left: list[str],
    right: list[str],
    derive: Callable[[pd.DataFrame], tuple[list[str], np.ndarray]] | None = None,
    by: str | None = None,
) -> DataFrame:
    """Partial sums per (by, left, right) and task.

    ``derive`` may turn a batch into other left columns; a row whose derived
    value is NaN is left out of that column's pairs.
    """
    group = by or "all_rows"
    source = df if by else df.selectExpr("'all' AS all_rows", "*")
    columns = list(dict.fromkeys([*left, *right]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        chunks = 0
        for chunk in _chunks(batches):
            held += [part for part in sums(chunk) if len(part)]
            chunks += 1
            if chunks % _HELD_CHUNKS == 0 and held:
                held = [_merged(pd.concat(held, ignore_index=True))]
        if held:
            yield _merged(pd.concat(held, ignore_index=True))

    def sums(chunk: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for key, frame in chunk.groupby(group, sort=False):
            y = frame[right].to_numpy(dtype=float)
            names, x = derive(frame) if derive else (left, frame[left].to_numpy(dtype=float))
            dense = ~np.isnan(x).any(axis=0)
            yd = [_few_distinct(y[:, j]) for j in range(y.shape[1])]
            rows = []
            if dense.any():
                n, sx, sy, cxx, cyy, cxy = _pair_sums(x[:, dense], y)
                for i, col in enumerate(np.flatnonzero(dense)):
                    xs = _few_distinct(x[:, col])
                    rows += [(key, names[col], r, n, sx[i], sy[j], cxx[i], cyy[j], cxy[i, j], xs, yd[j])
                             for j, r in enumerate(right)]
            for col in np.flatnonzero(~dense):
                keep = ~np.isnan(x[:, col])
                if not keep.any():
                    continue
                n, sx, sy, cxx, cyy, cxy = _pair_sums(x[keep, col:col + 1], y[keep])
                xs = _few_distinct(x[keep, col])
                rows += [(key, names[col], r, n, sx[0], sy[j], cxx[0], cyy[j], cxy[0, j], xs, _few_distinct(y[keep, j]))
                         for j, r in enumerate(right)]
            yield pd.DataFrame(rows, columns=[group, "left", "right", "n", "sx", "sy", "cxx", "cyy", "cxy", "xs", "ys"])

    parts = source.select(group, *columns).mapInPandas(run, f"{group} string, left string, right string, {_PART_COLUMNS}")
    return parts if by else parts.drop(group)


def merged_pairs(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge partial sums into r, slope, intercept and residual deviation per pair.

    Parts are merged about the mean of all of them, so digits do not cancel when a
    mean is large beside its deviation. A side whose deviation is lost in rounding
    counts as constant; pairs with a constant side have a null r. ``distinct_x``
    and ``distinct_y`` are exact for one and two values and 3 beyond.
    """
    whole = Window.partitionBy(*keys)
    placed = parts.withColumns({
        "mx": F.sum("sx").over(whole) / F.sum("n").over(whole), "my": F.sum("sy").over(whole) / F.sum("n").over(whole),
        **{f"{low}{c}": f(f"{c}s").over(whole) for c in "xy" for low, f in (
            ("lo_", lambda v: F.min(F.array_min(v))), ("hi_", lambda v: F.max(F.array_max(v))))}})
    distinct = {c: f"IF(min(lo_{c}) = max(hi_{c}), 1, 2 + max(int(exists({c}s, v -> v > lo_{c} AND v < hi_{c}))))" for c in "xy"}
    summed = placed.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("mx").alias("mean_x"), F.first("my").alias("mean_y"),
        F.expr("sum(cxx + n * (sx / n - mx) * (sx / n - mx))").alias("cxx"),
        F.expr("sum(cyy + n * (sy / n - my) * (sy / n - my))").alias("cyy"),
        F.expr("sum(cxy + n * (sx / n - mx) * (sy / n - my))").alias("cxy"),
        F.expr(distinct["x"]).alias("distinct_x"), F.expr(distinct["y"]).alias("distinct_y"))
    spread = " AND ".join(f"sqrt(c{c}{c} / n) > 1e-13D * abs(mean_{c})" for c in "xy")
    return summed.selectExpr(
        *keys, "n", "distinct_x", "distinct_y", "mean_x", "mean_y",
        f"CASE WHEN distinct_x > 1 AND distinct_y > 1 AND {spread} THEN try_divide(cxy, sqrt(cxx) * sqrt(cyy)) END AS r",
        "try_divide(cxy, cxx) AS slope",
        "mean_y - try_divide(cxy, cxx) * mean_x AS intercept",
        "sqrt(greatest(cyy - try_divide(cxy * cxy, cxx), 0.0D) / n) AS residual_sd")
