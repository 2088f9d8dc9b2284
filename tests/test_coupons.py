"""Leg views, coupon metrics, features, predictions."""

import math
import statistics as st

import pytest

from pooltide.operators import coupon_stats as S
from pooltide.operators import coupons as C
from pooltide.operators import legs as L
from pooltide.operators import predict as P
from pooltide.plans import backtest as B

SAMPLE = [
    (1, 1, (1.35, 3.80, 5.50), (64.9, 20.4, 14.7), "1", "1"),
    (1, 2, (2.25, 3.40, 2.50), (35.2, 28.1, 36.7), "N2", "N"),
    (1, 3, (1.85, 3.50, 3.80), (40.0, 30.0, 30.0), "1", "1"),
]


def test_stored_metrics(make_legs):
    row = C.grid_metrics(make_legs(SAMPLE)).first()
    assert row.somme_cotes_fav == 5.45 and row.nb_surprises == 1 and row.mediane_cote_fav == 1.85
    favs = [1.35, 2.25, 1.85]
    assert row.std_cote_fav == pytest.approx(st.stdev(favs), abs=1e-4)
    assert row.accord_cotes_joueurs == pytest.approx(2 / 3, abs=1e-4)
    assert row.inv_spread_sum == pytest.approx(sum(1 / s for s in (4.15, 1.15, 1.95)), abs=1e-4)


def test_metrics_of_equal_and_missing_odds(make_legs):
    rows = {r.coupon_id: r for r in C.grid_metrics(make_legs([
        (1, 1, (2.0, 3.0, 4.0), (0, 0, 0), "", "1"), (1, 2, (2.0, 3.0, 4.0), (0, 0, 0), "", "N"),
        (2, 1, (0, 0, 0), (0, 0, 0), "", "1"), (3, 1, (0, 3.0, 3.0), (0, 0, 0), "", "2"),
    ])).collect()}
    assert rows[1].ecart_type_cotes == 0.0 and rows[1].accord_cotes_joueurs == 0.0
    assert rows[2].somme_cotes_fav == 0.0 and rows[2].inv_spread_sum == 0.0
    # Favourite is the first of equal odds; no spread counts as ten.
    assert rows[3].nb_surprises == 1 and rows[3].inv_spread_sum == 10.0


def test_features_follow_their_definitions(spark, make_legs):
    legs = make_legs(SAMPLE + [(1, 4, (0, 0, 0), (10, 20, 5), "1N2", "2")])
    headers = spark.createDataFrame([(1, 7.1, 40, 3, 50.0, 9, 8.0)], (
        "coupon_id bigint, difficulty double, n_tips bigint, top_winners bigint, top_amount double, near_winners bigint, near_amount double"))
    f = C.coupon_features(legs, headers).first().asDict()
    favs = [1.35, 2.25, 1.85]
    m, s = st.mean(favs), st.stdev(favs)
    assert f["nb_matchs"] == 4 and f["grid_type"] == "LF4" and f["profil"] == "2-1-1"
    assert f["gini_cotes_fav"] == pytest.approx(sum((2 * i - 4) * x for i, x in enumerate(sorted(favs), 1)) / (3 * sum(favs)))
    assert f["skewness_cotes_fav"] == pytest.approx(sum((x - m) ** 3 for x in favs) / (3 * s ** 3), abs=1e-8)
    assert f["kurtosis_cotes_fav"] == 0.0
    assert f["pos_match_plus_serre"] == 2 and f["pos_match_plus_facile"] == 1
    assert f["gradient_difficulte"] == pytest.approx((1.85 - 1.35) / 2)
    assert f["asymetrie_cotes"] == pytest.approx(abs(1.35 - st.mean([2.25, 1.85])))
    assert f["nb_tip_simple"] == 2 and f["nb_tip_double"] == 1 and f["nb_tip_triple"] == 1
    assert f["tip_accuracy"] == 1.0 and f["plus_longue_suite"] == 1 and f["alternance"] == 1.0
    assert f["prod_cotes_resultat"] == pytest.approx(1.35 * 3.40 * 1.85)
    assert f["log_surprise_index"] == pytest.approx(math.log(1.35 * 3.40 * 1.85))
    assert f["pool_estime_parfait"] == 150.0 and f["joueurs_accuracy"] == pytest.approx(2 / 4)
    assert len(C.FEATURES) == len(set(C.FEATURES))


def test_coupon_without_odds_or_results_has_no_features(spark, make_legs):
    legs = make_legs([(1, 1, (0, 0, 0), (1, 1, 1), "", "1"), (2, 1, (2, 3, 4), (1, 1, 1), "", None)])
    headers = spark.createDataFrame([(1, 1.0, 1, 1, 1.0, 1, 1.0), (2, 1.0, 1, 1, 1.0, 1, 1.0)], (
        "coupon_id bigint, difficulty double, n_tips bigint, top_winners bigint, top_amount double, near_winners bigint, near_amount double"))
    assert C.coupon_features(legs, headers).count() == 0


def test_coupon_stats_chaos(spark, make_legs):
    coupons = spark.createDataFrame([(1, "1N1"), (2, "NN"), (3, "1N")], "coupon_id bigint, results string")
    legs = make_legs(SAMPLE + [(2, 1, (0, 0, 0), (0, 0, 0), "", "N"), (2, 2, (0, 0, 0), (0, 0, 0), "", "N")])
    chaos = {r.coupon_id: r.chaos for r in S.coupon_stats(coupons, legs).collect()}
    assert chaos[1] == pytest.approx(1 / 3)       # only the draw at 3.40 exceeds 3
    assert chaos[2] == 0.0                        # legs without odds
    assert chaos[3] == 0.5                        # no legs at all


@pytest.mark.parametrize("difficulty, mean_fav, wanted", [
    (3.0, 1.40, "secure"), (9.0, 1.80, "risky"), (6.0, 2.50, "risky"), (6.0, 1.80, "balanced"),
])
def test_risk_profiles(spark, difficulty, mean_fav, wanted):
    df = spark.createDataFrame([(difficulty, mean_fav, None, None, None)], (
        "difficulty double, moyenne_cote_fav double, inv_spread_sum double, std_cote_fav double, accord_cotes_joueurs double"))
    assert df.selectExpr(f"{P.RISK_PROFILE} AS p").first().p == wanted


def test_predictions_sum_to_one_and_take_the_largest(make_legs):
    rows = P.predict_legs(make_legs(SAMPLE)).collect()
    for r in rows:
        probs = [r.prob_1, r.prob_n, r.prob_2]
        assert sum(probs) == pytest.approx(1.0)
        assert r.prediction == "1N2"[probs.index(max(probs))]
        top = sorted(probs, reverse=True)
        assert r.confidence == pytest.approx(top[0] - top[1])


def test_missing_signals_give_their_weight_away(make_legs):
    r = P.score_legs(make_legs([(1, 1, (0, 0, 0), (0, 0, 0), "", "1")])).first()
    third, prior = 1 / 3, (0.40, 0.29, 0.31)
    wanted = [(0.10 * third + 0.05 * p) / 0.15 for p in prior]
    assert [r.prob_1, r.prob_n, r.prob_2] == pytest.approx(wanted)


def test_backtest_counts(make_legs):
    results = B.backtest_legs(make_legs(SAMPLE), C.grid_metrics(make_legs(SAMPLE)))
    coupon = B.backtest_coupons(results).first()
    assert coupon.results == "1N1" and coupon.n_correct == sum(a == b for a, b in zip(coupon.predicted, "1N1"))
    assert B.backtest_summary(results).first().n_matches == 3


def test_missing_odds(make_legs):
    row = L.missing_odds(make_legs([(1, 1, (2, 0, 3), (0, 0, 0), "", "1"), (1, 2, (2, 3, 3), (0, 0, 0), "", "1")])).first()
    assert (row.n_missing, row.n_legs) == (1, 2)
