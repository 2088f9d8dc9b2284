"""Two-sided matching of fixtures against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from pooltide.operators import fuzzy as Z

WORDS = ["real", "inter", "sport", "union", "norte", "vale", "arsen", "tur", "bel", "mar", "oss", "ika", "dro", "fen", "wick", "ton", "ham", "ster"]


def a_name(rng):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2]))) for _ in range(rng.choice([1, 1, 2])))


def changed(rng, name):
    letters = list(name)
    for _ in range(rng.choice([0, 1, 2, 5])):
        letters[rng.randrange(len(letters))] = rng.choice("abcdefghijklmnopqrst")
    return "".join(letters).strip() or "x"


def score(a, b):
    return 1.0 if a == b else 0.85 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


def fixtures(rng, n):
    events = list(dict.fromkeys((a_name(rng), a_name(rng)) for _ in range(n)))
    wanted = [tuple(changed(rng, x) for x in rng.choice(events)) for _ in range(n)] + [(a_name(rng), a_name(rng)) for _ in range(n // 2)]
    wanted += [(e[0][:4].strip() or "r", e[1] + " reserves") for e in events[:5]] + [("zzzzzzzz", "qqqqqqqq"), (events[0][0], "qqqqqqqq")]
    return list(dict.fromkeys(wanted)), events


def frames(spark, wanted, events):
    return (spark.createDataFrame(wanted, "h string, a string"),
            spark.createDataFrame([(x, y, 7 + i) for i, (x, y) in enumerate(events)], "eh string, ea string, event_no bigint"))


@pytest.mark.parametrize("seed, per_key", [(1, 4096), (2, 3)])
def test_best_events_equal_all_pairs(spark, monkeypatch, seed, per_key):
    monkeypatch.setattr(Z, "EVENTS_PER_KEY", per_key)  # with 3, common characters are split
    wanted, events = fixtures(random.Random(seed), 40)
    got = {(r.h, r.a): (r.event_no, r.score) for r in Z.best_events(*frames(spark, wanted, events)).collect()}
    want = {}
    for h, a in wanted:
        means = [(score(h, x) + score(a, y)) / 2 for x, y in events]
        if max(means) >= Z.THRESHOLD:
            want[h, a] = (7 + means.index(max(means)), pytest.approx(max(means)))
    assert got == want
    assert any(s < 0.7 for _, s in got.values()) and any(s > 0.85 for _, s in got.values())


def test_no_key_gathers_many_pairs(spark):
    rng = random.Random(3)
    wanted, events = fixtures(rng, 1500)
    own, feed = frames(spark, wanted, events)
    own_chars, event_chars = Z._weighted(own, "h", "a"), Z._weighted(feed, "eh", "ea")
    places = own_chars.select("token").unionByName(event_chars.select("token")).groupBy("token").count().selectExpr(
        "token", "row_number() OVER (ORDER BY count, token) AS place")
    by_own, by_feed = Z._by_rarity(own_chars, places, ["h", "a"]), Z._by_rarity(event_chars, places, ["eh", "ea", "event_no"])
    for threshold, share in ((0.85, 0.08), (0.7, 0.5)):
        pairs = Z.fixture_candidates(by_own, by_feed, threshold)
        per_pair, per_key = pairs.groupBy("h", "a", "eh", "ea").count(), pairs.groupBy("token", "salt").count()
        assert per_pair.agg({"count": "max"}).first()[0] == 1
        assert pairs.count() < share * len(wanted) * len(events)
        assert per_key.agg({"count": "max"}).first()[0] < 0.1 * pairs.count()


def test_bound_is_never_below_the_score(spark):
    rng = random.Random(4)
    pairs = [(a, b) for a in {changed(rng, a_name(rng)) for _ in range(60)} for b in {a_name(rng) for _ in range(40)}]
    df = spark.createDataFrame(pairs, "x string, y string").selectExpr("x", "y", f"{Z.score_bound('x', 'y')} AS bound")
    assert all(r.bound >= score(r.x, r.y) - 1e-9 for r in df.collect())


def test_names_are_normalised_once_a_pair_and_candidates_spread(spark):
    schema = "{} bigint, home string, away string, odds_1 double, odds_n double, odds_2 double"
    legs = spark.createDataFrame([(1, "Nice FC", "Monaco", 0.0, 0.0, 0.0), (2, "Nice", "Monaco", None, 3.0, 3.0), (3, "Nice", "Monaco", 2.0, 3.0, 4.0),
                                  (4, None, "Monaco", 0.0, 0.0, 0.0), (5, "Nice", None, 0.0, 0.0, 0.0), (6, "Nice FC", "Monaco", 0.0, 0.0, 0.0)], schema.format("leg"))
    events = spark.createDataFrame([(1, "Nice", "AS Monaco", 2.2, 3.1, 3.2)], schema.format("event_no"))
    filled = Z.fill_missing_odds(legs, events)
    assert "regexp_replace" not in filled._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.leg, r.odds_1, r.odds_source) for r in filled.collect()) == [
        (1, 2.2, "events"), (2, 2.2, "events"), (3, 2.0, "own"), (4, 0.0, "own"), (5, 0.0, "own"), (6, 2.2, "events")]
    # A hundred names mean ten thousand pairs: their comparison must not be one task, however small their files are.
    names = spark.range(0, 100, 1, 1).selectExpr("concat('ab', id) AS h", "concat('cd', id) AS a", "array(1, 2, 3) AS ranks", "array(2.0D, 1.5D, 1.0D) AS rests")
    pairs = Z.fixture_candidates(names, names.selectExpr("h AS eh", "a AS ea", "1 AS event_no", "ranks", "rests"), 0.7)
    assert pairs.count() == 10_000
    assert pairs.selectExpr("spark_partition_id() AS p").distinct().count() > 1
