"""What one task holds must not grow with the tables."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from pooltide.catalog import ingest
from pooltide.operators import predict as P
from pooltide.operators import quantiles, staging
from pooltide.sources import adapter as A
from pooltide.sources import documents as D
from pooltide.sources import season_csv as CSV


@pytest.fixture()
def lines(spark, tmp_path):
    rows = [(k, n, k, k, 1.0, "ANR"[n % 3]) for k in range(60) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_returnflag string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_legs_are_split_by_their_number(spark, lines, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 10)
    legs = A.legs(spark, lines)
    assert legs.rdd.getNumPartitions() == 24 and legs.count() == 240
    # A coupon stays in one task: grouping it needs no other shuffle.
    assert legs.groupBy("coupon_id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_line_of_a_season_file_is_cut_once(spark):
    """Filters on parsed columns must not cut the lines again."""
    files = spark.createDataFrame([("F1_2425.csv", "Div,Date,HomeTeam,AwayTeam,FTR\nF1,02/03/2024,A,\"B, C\",H\nF1,3/3/98,D,E,d\nF1,03/13/98,D,E,A\n")], "file string, content string")
    valid = CSV.parse_season_files(files).where("valid")
    assert [(r.row_no, str(r.date), r.away) for r in valid.orderBy("row_no").collect()] == [(1, "2024-03-02", "B, C"), (2, "1998-03-03", "E")]
    above, generator = valid._jdf.queryExecution().optimizedPlan().toString().split("Generate ", 1)
    assert "(?=(?:" not in above and "(?=(?:" in generator


def test_quantiles_sort_no_column(spark):
    """Sketches are aggregated in place: with a group per metric, Spark would sort all rows of a long table."""
    names = [f"c{i}" for i in range(20)]
    df = spark.range(1000).selectExpr("concat('t', id % 11) AS t", *(f"IF(id % 7 = 0, NULL, CAST((id * {i + 3}) % 997 AS DOUBLE)) AS {n}" for i, n in enumerate(names)))
    sketch = quantiles._sketch(df, names, ["t"], [0.5], 0.01)
    assert sketch.count() == 220
    assert "Expand" not in (plan := sketch._jdf.queryExecution().executedPlan().toString()) and "inline(array(struct(metric, c0" not in plan
    found = {(r.t, r.metric): r.value for r in quantiles.exact_quantiles(df, names, [0.5], ["t"]).collect()}
    want = df.groupBy("t").agg(*(F.expr(f"percentile({n}, 0.5)").alias(n) for n in names)).collect()
    assert found == {(r.t, n): pytest.approx(r[n]) for r in want for n in names}


def test_documents_are_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "staging_dir", lambda spark: str(tmp_path))
    text = "[" + ",".join('{"grid_number": 7, "matches": []}' for _ in range(2000)) + "]"
    path = ingest._written_text(spark.createDataFrame([("0_1997", text)], "part string, content string"), "history")
    assert sum(f.stat().st_size for f in pathlib.Path(path).rglob("part-*")) < len(text) / 10
    assert D.read_documents(spark, path, D.schemas.HISTORY_DOC).selectExpr("size(docs) AS n").first().n == 2000


def test_methods_of_the_blended_predictions_are_compiled(spark, make_legs):
    """The JVM only interprets methods of more than 8,000 bytes of code."""
    legs = make_legs([(c, p, (1.5 + c, 3.1, 2.0 + p), (50, 30, 20), "1N", "1") for c in range(3) for p in range(1, 4)]).repartition(3, "coupon_id")
    headers = spark.createDataFrame([(c, 5.0) for c in range(3)], "coupon_id bigint, difficulty double")
    wanted = ["coupon_id", "position", "prob_1", "prob_n", "prob_2", "prediction", "confidence"]
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan at once
    try:
        plans = [P.predict_legs(P.with_window_metrics(legs, headers.hint(join))).select(wanted)._jdf.queryExecution().executedPlan() for join in ("BROADCAST", "MERGE")]
        sizes = [int(n) for plan in plans for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 1000 < max(sizes) < 8000
    # Signals computed below the windows are those computed above them.
    rated = P.with_window_metrics(legs, headers)
    assert sorted(P.predict_legs(rated.drop(*P.LEG_SIGNALS)).select(wanted).collect()) == sorted(P.predict_legs(rated).select(wanted).collect())
