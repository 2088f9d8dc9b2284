"""Merged pair sums: the answer does not depend on how rows are dealt to tasks."""

import numpy as np
import pytest

from pooltide.operators.moments import merged_pairs, pair_parts


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_large_mean_and_constant_columns(spark, parts):
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=600) * 1e-3
    y = rng.normal(size=600) + (x - 1e6) * 500
    nearly = 1.0 + rng.choice([0.0, 2.2e-16], 600)
    rows = [(float(a), float(b), float(c), 5.0) for a, b, c in zip(x, y, nearly)]
    df = spark.createDataFrame(rows, "x double, y double, nearly double, same double").repartition(parts)
    got = {r.left: r for r in merged_pairs(pair_parts(df, ["x", "nearly", "same"], ["y"]), ["left", "right"]).collect()}
    assert abs(got["x"].r - np.corrcoef(x, y)[0, 1]) < 1e-6 and got["x"].distinct_x == 3
    assert got["same"].r is None and got["same"].distinct_x == 1
    assert got["nearly"].r is None and got["nearly"].distinct_x == 2


@pytest.mark.parametrize("margins", [(0.0003, 0.03, None), (-0.3, None), (-0.2, 0.05, None), (None,)])
def test_quantiles_when_brackets_miss(spark, monkeypatch, margins):
    from pooltide.operators import quantiles as Q

    monkeypatch.setattr(Q, "MARGINS", margins)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=400), "b": np.repeat([1.0, 2.0, 7.0], [1, 300, 2]), "c": np.array([5.0]), "d": np.arange(97.0)}
    df = spark.createDataFrame([(k, float(x), None if i % 3 else float(i)) for k, v in groups.items() for i, x in enumerate(v)], "k string, x double, y double")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {(r.k, r.metric, r.prob): r.value for r in Q.exact_quantiles(df, ["x", "y"], probs, ["k"]).collect()}
    want = {}
    for k, v in groups.items():
        for p in probs:
            want[k, "x", p] = np.quantile(v, p)
            want[k, "y", p] = np.quantile(np.arange(0, len(v), 3.0), p)
    assert got == pytest.approx(want)


def test_a_task_merges_its_chunks(spark, monkeypatch):
    """One row a pair leaves a task, however many chunks it works on."""
    from pooltide.operators import moments as M

    monkeypatch.setattr(M, "_CHUNK_ROWS", 50)
    monkeypatch.setattr(M, "_HELD_CHUNKS", 3)
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], float(a), float(b), None if i % 5 else float(a)) for i, (a, b) in enumerate(rng.normal(size=(1000, 2)))]
    df = spark.createDataFrame(rows, "g string, x double, y double, some double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        parts = pair_parts(df, ["x", "some"], ["y"], by="g").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(p.g, p.left): p for p in parts}
    assert len(parts) == 4
    for (g, left), p in got.items():
        x, y = np.array([(r[1] if left == "x" else r[3], r[2]) for r in rows if r[0] == g and (left == "x" or r[3] is not None)]).T
        assert p.n == len(x) and p.cxy == pytest.approx(np.cov(x, y, bias=True)[0, 1] * len(x))
        assert (min(p.xs), max(p.xs), len(p.xs)) == (x.min(), x.max(), 3)
