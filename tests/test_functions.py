"""Scalar functions on the documented examples."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pooltide.functions import odds as O
from pooltide.functions import sequences as Q
from pooltide.functions import text as X


def one(spark, schema, values, *exprs):
    row = spark.createDataFrame([values], schema).selectExpr(*exprs).first()
    return list(row) if len(exprs) > 1 else row[0]


@pytest.mark.parametrize("results, profile, entropy, alternation, run", [
    ("1N21N12", "3-2-2", None, None, None),
    ("1111111", "7-0-0", 0.0, 0.0, 7),
    ("1111N22", "4-1-2", None, None, 4),
    ("1N2", "1-1-1", math.log2(3), 1.0, 1),
    ("1N1N1N1", "4-3-0", None, 1.0, 1),
    ("", "0-0-0", 0.0, 0.0, 0),
    ("1?1", "2-0-0", -(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3), 1.0, 1),
])
def test_sequence_statistics(spark, results, profile, entropy, alternation, run):
    got = one(spark, "results string", (results,), Q.profile(), Q.entropy(), Q.alternation(), Q.longest_run())
    assert got[0] == profile
    for value, wanted in zip(got[1:], (entropy, alternation, run)):
        if wanted is not None:
            assert value == pytest.approx(wanted)


def test_matching_positions_stop_at_the_shorter_string(spark):
    assert one(spark, "a string, b string", ("1N21", "1N1"), Q.matching_positions("a", "b")) == 2
    assert one(spark, "a string, b string", ("1N21", ""), Q.matching_positions("a", "b")) == 0


@pytest.mark.parametrize("odds, wanted", [
    ((3.0, 3.0, 3.0), (1 / 3,) * 3), ((0.0, 3.0, 3.0), (1 / 3,) * 3), ((-1.5, 3.0, 3.0), (1 / 3,) * 3),
    ((2.0, 4.0, 4.0), (0.5, 0.25, 0.25)),
])
def test_implied_probabilities(spark, odds, wanted):
    got = one(spark, "odds_1 double, odds_n double, odds_2 double", odds, *O.implied_probabilities().values())
    assert got == pytest.approx(wanted)


@pytest.mark.parametrize("tip, wanted", [
    ("1", (0.8, 0.1, 0.1)), ("N2", (0.1, 0.45, 0.45)), ("1N2", (1 / 3,) * 3), ("", (1 / 3,) * 3), ("-", (1 / 3,) * 3),
    (" n ", (0.1, 0.8, 0.1)), ("11", (0.8, 0.1, 0.1)), (None, (1 / 3,) * 3),
])
def test_tip_probabilities(spark, tip, wanted):
    assert one(spark, "tip string", (tip,), *O.tip_probabilities().values()) == pytest.approx(wanted)


@pytest.mark.parametrize("text, wanted", [
    ("15/08/2023", dt.date(2023, 8, 15)), ("15/08/23", dt.date(2023, 8, 15)), ("invalid", None),
    ("01/02/99", dt.date(1999, 2, 1)), ("1/2/68", dt.date(2068, 2, 1)), ("31/02/2023", None), (None, None), (" 05/01/10 ", dt.date(2010, 1, 5)),
])
def test_match_dates(spark, text, wanted):
    assert one(spark, "d string", (text,), X.match_date("d")) == wanted


@pytest.mark.parametrize("code, wanted", [("2324", "2023/2024"), ("9900", "1999/2000"), ("23", "23"), ("", "")])
def test_season_labels(spark, code, wanted):
    assert one(spark, "c string", (code,), X.season_label("c")) == wanted


def test_file_names(spark):
    assert one(spark, "f string", ("E0_2324.csv",), X.league_code("f"), X.season_code("f")) == ["E0", "2324"]
    assert one(spark, "f string", ("plain.csv",), X.league_code("f"), X.season_code("f")) == ["plain", ""]


@pytest.mark.parametrize("cells, wanted", [
    (("1.5", "1.6", "1.55"), 1.55), (("1.5", None, "n/a"), 1.5), ((None, None, "1.0"), None), (("abc", "", None), None),
])
def test_mean_odds(spark, cells, wanted):
    assert one(spark, "a string, b string, c string", cells, X.mean_odds(["a", "b", "c"])) == wanted


@pytest.mark.parametrize("text, wanted", [
    ("45%1,52", (45.0, 1.52)), ("58%", (58.0, 0.0)), ("-1,77", (0.0, 1.77)), ("2.25", (0.0, 2.25)), ("x", (0.0, 0.0)),
    ("64.9%1.35", (64.9, 1.35)), ("", (0.0, 0.0)),
])
def test_odds_cells(spark, text, wanted):
    assert tuple(one(spark, "t string", (text,), *X.odds_cell("t"))) == wanted


def test_results_money_and_teams(spark):
    assert [one(spark, "f string", (f,), X.result_of("f")) for f in ("H", " d ", "A", "x")] == ["1", "N", "2", None]
    assert one(spark, "t string", ("1 210,00 €",), X.money("t")) == 1210.0
    assert one(spark, "t string", ("2 051",), X.whole_number("t")) == 2051
    assert one(spark, "t string", ("  FC Saint-Étienne  A.S. ",), X.normalized_team("t")) == "saintétienne a s".replace("a s", "as")


def test_page_dates(spark):
    schema, exprs = "u string, t string", X.page_date("u", "t", "'2026'")
    assert one(spark, schema, ("2026-07-23 16:55:00", ""), exprs) == dt.date(2026, 7, 23)
    assert one(spark, schema, (None, "Jeudi 23 Juillet à 18h55"), exprs) == dt.date(2026, 7, 23)
    assert one(spark, schema, (None, "bientôt"), exprs) is None
    assert one(spark, "t string", ("fin de valid. 01/07 17h55",), X.day_month("t", "'2025'")) == dt.date(2025, 7, 1)
