"""Blocked order-dependent operators, quantiles and moments against brute force, with hot keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from pooltide.operators import moments as M
from pooltide.operators.ordered import dense_sequence, running_totals, with_halo
from pooltide.operators import quantiles as Q

rng = random.Random(7)
# One key holds a third of all rows.
ROWS = [("hot" if i % 3 == 0 else f"k{i % 40}", i * 7 % 1000, i, float(rng.randint(-5, 5))) for i in range(1500)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, t int, id bigint, v double")


def test_dense_sequence_matches_row_number(rows):
    got = dense_sequence(rows, ["k"], "t div 100", "t div 10", ["t", "id"]).withColumn(
        "want", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert got.where("seq <> want").count() == 0 and got.count() == len(ROWS)


def test_dense_sequence_over_everything(rows):
    got = dense_sequence(rows, [], "t div 50", "t", ["t", "id"]).orderBy("seq").select("seq", "t", "id").collect()
    assert [r.seq for r in got] == list(range(1, len(ROWS) + 1))
    assert [(r.t, r.id) for r in got] == sorted((t, i) for _, t, i, _ in ROWS)


def test_running_totals(rows):
    want = F.sum("v").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0))
    got = running_totals(rows, ["k"], "t div 100", ["t", "id"], {"run": "v"}).withColumn("want", want)
    assert got.where("abs(run - want) > 1e-9").count() == 0 and got.count() == len(ROWS)


def test_halo_completes_trailing_frames(rows):
    listed = dense_sequence(rows, [], "t div 50", "t", ["t", "id"])
    over = "OVER ({} ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    want = listed.selectExpr("seq", f"sum(v) {over.format('')} AS s")
    got = with_halo(listed, "seq", 20, block_rows=64).selectExpr(
        "seq", "_halo", f"sum(v) {over.format('PARTITION BY _block')} AS s").where("NOT _halo").drop("_halo")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("margins", [Q.MARGINS, (0.0, None)])
def test_exact_quantiles(spark, monkeypatch, margins):
    # whole = 0 sends every group through the sketch bracket.
    monkeypatch.setattr(Q, "MARGINS", margins)
    gen = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(np.arange(30_000) % 3 == 0, "a", "b"), "x": gen.lognormal(0, 3, 30_000),
                        "y": gen.integers(0, 4, 30_000).astype(float)})
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    probs = [0.0, 0.25, 1 / 3, 0.5, 0.67, 1.0]
    got = {(r.g, r.metric, r.prob): r.value for r in Q.exact_quantiles(df, ["x", "y"], probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for m in ("x", "y"):
            for p in probs:
                assert got[g, m, p] == pytest.approx(np.quantile(part[m].dropna(), p), rel=1e-12), (g, m, p)


def test_pair_moments_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(M, "_CHUNK_ROWS", 100)
    gen = np.random.default_rng(5)
    a = gen.normal(1000, 1, 2000)
    pdf = pd.DataFrame({"g": np.where(np.arange(2000) % 3 == 0, "s", "t"), "a": a, "b": a * 2 + gen.normal(0, 1, 2000),
                        "c": 1.0, "d": gen.integers(0, 2, 2000).astype(float)})
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r.g, r.left, r.right): r for r in M.merged_pairs(
        M.pair_parts(df, ["a", "c", "d"], ["b", "d"], by="g"), ["g", "left", "right"]).collect()}
    for g, part in pdf.groupby("g"):
        r = got[g, "a", "b"]
        assert r.n == len(part) and r.r == pytest.approx(np.corrcoef(part.a, part.b)[0, 1])
        slope, intercept = np.polyfit(part.a - 1000, part.b, 1)
        assert r.slope == pytest.approx(slope) and r.intercept == pytest.approx(intercept - 1000 * slope)
        assert r.residual_sd == pytest.approx(np.std(part.b - (part.a * r.slope + r.intercept)))
        assert got[g, "c", "b"].r is None and got[g, "c", "b"].distinct_x == 1
        assert got[g, "d", "b"].distinct_x == 2 and r.distinct_x >= 3


def test_halo_wider_than_a_block(spark):
    rows = with_halo(spark.range(1, 101).selectExpr("id AS seq"), "seq", 23, block_rows=8).collect()
    for block in range(13):
        own = sorted(r.seq for r in rows if r._block == block and not r._halo)
        assert own == [x for x in range(8 * block + 1, 8 * block + 9) if x <= 100]
        assert sorted(r.seq for r in rows if r._block == block and r._halo) == list(range(max(1, 8 * block - 22), 8 * block + 1))
