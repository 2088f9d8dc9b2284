"""Generation, covering, ledger."""

from itertools import product

import pytest

from pooltide.operators import covering as V
from pooltide.operators import generate as G
from pooltide.operators import ledger as J
from pooltide.plans import rules as R
from pooltide.plans import weights as W


def _predictions(spark, probs):
    rows = []
    for i, p in enumerate(probs, 1):
        top = sorted(p, reverse=True)
        rows.append((1, i, *map(float, p), "1N2"[p.index(max(p))], top[0] - top[1]))
    return spark.createDataFrame(rows, "coupon_id bigint, position int, prob_1 double, prob_n double, prob_2 double, prediction string, confidence double")


PROBS = [(.5, .3, .2), (.4, .3, .3), (.2, .2, .6), (.45, .35, .2), (.34, .33, .33)]


def _brute(probs, k, strategy):
    conf = [sorted(p)[-1] - sorted(p)[-2] for p in probs]
    vary = sorted(range(len(probs)), key=lambda i: conf[i])[:k]
    base = ["1N2"[p.index(max(p))] for p in probs]
    options = []
    for i in vary:
        ranked = [o for o, _ in sorted(zip("1N2", probs[i]), key=lambda x: -x[1])]
        width = 2 if strategy == "cautious" else 3 if strategy == "bold" or conf[i] < 0.15 else 2
        options.append(ranked[:width])
    out = set()
    for combo in product(*options):
        r = list(base)
        for i, o in zip(vary, combo):
            r[i] = o
        out.add("".join(r))
    return out


@pytest.mark.parametrize("strategy, k", [("cautious", 2), ("balanced", 3), ("bold", 5), ("unknown", 3)])
def test_generation_enumerates_scores_and_cuts(spark, strategy, k):
    pred = _predictions(spark, PROBS)
    requests = spark.createDataFrame([(1, strategy, 1000)], "coupon_id bigint, strategy string, budget int")
    metrics = spark.createDataFrame([(1, 5)], "coupon_id bigint, n_legs bigint")
    rows = G.generate(pred, requests, metrics).collect()
    assert {r.results for r in rows} == _brute(PROBS, k, strategy) and len(rows) == len({r.results for r in rows})
    for r in rows:
        want = 1.0
        for p, o in zip(PROBS, r.results):
            want *= p["1N2".index(o)]
        assert r.probability == pytest.approx(want)
    assert [r.rank for r in sorted(rows, key=lambda r: -r.probability)] == sorted(r.rank for r in rows)


def test_budget_takes_distinct_profiles_first(spark):
    pred = _predictions(spark, PROBS)
    requests = spark.createDataFrame([(1, "bold", 4)], "coupon_id bigint, strategy string, budget int")
    metrics = spark.createDataFrame([(1, 5)], "coupon_id bigint, n_legs bigint")
    rows = G.generate(pred, requests, metrics).collect()
    assert len(rows) == 4 and len({r.profile for r in rows}) == 4
    freq = spark.createDataFrame([("LF5", "5-0-0", 0.9), ("LF5", "4-0-1", 0.1)], "grid_type string, profile string, share double")
    weighted = {r.profile: r.profile_weight for r in G.generate(pred, requests, metrics, freq).collect()}
    assert weighted.get("4-0-1", 0.1) == 0.1 and all(w in (0.9, 0.1) or w == pytest.approx(0.01) for w in weighted.values())


@pytest.mark.parametrize("metrics, strategy, wanted", [
    ((1.5, None, None, 0), "cautious", 1), ((1.5, None, None, 0), "bold", 5), ((3.2, None, None, 0), "balanced", 4),
    ((3.2, None, None, 0), "cautious", 2), ((None, 0.2, None, 0), "balanced", 2), ((None, 0.5, None, 3), "bold", 7),
    ((None, None, 9.0, 0), "balanced", 4), ((None, None, 3.0, 0), "balanced", 2), ((2.5, 0.1, 1.0, 0), "balanced", 3),
])
def test_number_of_varied_legs(spark, metrics, strategy, wanted):
    m = spark.createDataFrame([(1, 7, *metrics)], "coupon_id bigint, n_legs bigint, inv_spread_sum double, std_cote_fav double, difficulty double, nb_matchs_serres int")
    r = spark.createDataFrame([(1, strategy, 5)], "coupon_id bigint, strategy string, budget int")
    assert G.legs_to_vary(r, m).first().n_varied == wanted


def _systems(spark, rows):
    return spark.createDataFrame(rows, "system_id bigint, selections array<array<string>>, guarantees array<struct<radius:int,coverage:double>>")


T, D1, S1 = ["1", "N", "2"], ["1", "N"], ["1"]


def test_covering_meets_guarantees(spark):
    rows = [
        (1, [S1, ["N"], ["2"], D1, ["1", "2"]], [(0, 1.0)]),
        (2, [S1, S1, S1, S1, D1, D1, T, T], [(1, 1.0)]),
        (3, [T, T, T], [(1, 1.0)]),
        (4, [T, T, T, D1], [(1, 0.6), (2, 1.0)]),
        (5, [S1, S1], [(0, 1.0)]),
    ]
    out = {r.system_id: r for r in V.covering_systems(_systems(spark, rows)).collect()}
    assert out[1].n_grids == 4 and out[1].reduction == 0.0
    assert 6 <= out[2].n_grids < 36
    assert out[5].grids == ["11"]
    for sid, selections, guarantees in rows:
        combos = ["".join(c) for c in product(*selections)]
        for radius, coverage in guarantees:
            near = sum(any(sum(a != b for a, b in zip(c, g)) <= radius for g in out[sid].grids) for c in combos)
            assert near / len(combos) >= coverage
    cov = {(r.system_id, r.radius): r.covered for r in V.coverage(V.covering_systems(_systems(spark, rows))).collect()}
    assert cov[3, 1] == 1.0 and cov[4, 1] >= 0.6 and cov[4, 2] == 1.0


@pytest.mark.parametrize("selections, guarantees", [
    ([T] * 8, [(1, 1.0)]), ([T, D1, S1, T, T, T, D1, T, T, T, ["1", "2"], S1], [(1, 0.7), (2, 1.0)]), ([D1] * 14, [(2, 1.0)]),
])
def test_large_systems_are_split_and_reduced(spark, selections, guarantees):
    covered = V.covering_systems(_systems(spark, [(1, selections, guarantees)]))
    row = covered.first()
    total = 1
    for s in selections:
        total *= len(s)
    grids = [r.grid for r in V.expanded_grids(covered).collect()]
    assert row.error is None and total == row.n_combinations > V.PART_COMBINATIONS and len(set(grids)) == len(grids) == row.n_grids
    assert row.reduction == pytest.approx(1 - len(grids) / total) and row.reduction > 0.5
    assert all(g[i] in s for g in grids for i, s in enumerate(selections))
    # Brute force on every so many-th combination, and the share over all of them from the operator.
    combos = ["".join(c) for c in product(*selections)]
    for radius, coverage in guarantees:
        near = sum(any(sum(a != b for a, b in zip(c, g)) <= radius for g in grids) for c in combos[::len(combos) // 300])
        assert coverage < 1 or near == len(combos[::len(combos) // 300])
    assert {r.radius: r.covered >= r.target for r in V.coverage(covered).collect()} == {r: True for r, _ in guarantees}


@pytest.mark.parametrize("selections, guarantees, error", [
    ([], [(0, 1.0)], "no selection"), ([[]], [(0, 1.0)], "leg without option"), ([["1", "1"]], [(0, 1.0)], "duplicate option"),
    ([["X"]], [(0, 1.0)], "invalid option"), ([["1"]], [], "no guarantee"), ([["1"]], [(1, 1.0)], "invalid radius"),
    ([["1"]], [(0, 0.0)], "invalid coverage"), ([T] * 8, [(1, 1.0)], None), ([T] * 40, [(1, 1.0)], "too many combinations"), ([T], [(0, 1.0)], None),
])
def test_covering_validation(spark, selections, guarantees, error):
    assert V.validated(_systems(spark, [(1, selections, guarantees)])).first().error == error


def test_ledger_resolution_and_balance(spark):
    subs = spark.createDataFrame([("LF7", 92, None, ["1N21121", "1111111"]), ("LF8", 99, None, ["1" * 8])],
                                 "grid_type string, grid_number bigint, entry_date date, bets array<string>")
    entries = J.pending_entries(subs)
    assert {r.entry_id: (r.cost, r.net) for r in entries.collect()} == {"LF7-92": (2.0, -2.0), "LF8-99": (1.0, -1.0)}
    outcomes = spark.createDataFrame(
        [("LF7", 92, "1N21122", {"6_sur_7": (3, 52.5)}), ("LF8", 99, "N", {})],
        "grid_type string, grid_number bigint, results string, payouts map<string,struct<winners:bigint,amount:double>>")
    done = J.resolve_entries(J.resolve_bets(entries, J.resolvable(outcomes))).collect()
    assert [(r.entry_id, r.best_correct, r.total_payout, r.net) for r in done] == [("LF7-92", 6, 52.5, 50.5)]
    moves = spark.createDataFrame([("a", f"2024-01-0{d} 00:00:00", d, 8.0, 0.0) for d in range(1, 7)],
                                  "account string, ts string, event_id bigint, cost double, payout double").selectExpr(
        "account", "to_timestamp(ts) AS ts", "event_id", "cost", "payout")
    roi = J.return_on_investment(moves).first()
    assert (roi.balance, roi.invested, roi.roi) == (52.0, 48.0, -100.0)
    series = J.evolution(moves).orderBy("ts").collect()
    assert [r.balance for r in series] == [100.0, 92.0, 84.0, 76.0, 68.0, 60.0, 52.0]


def test_weight_candidates():
    c = W.sweep_candidates()
    assert len(c) == 25 and all(sum(w) == pytest.approx(1.0, abs=3e-4) for w in c.values())
    assert list(W.random_candidates(5)) == ["default"] + [f"draw_{k}" for k in range(1, 6)]


def test_rule_votes(spark):
    rules = spark.createDataFrame([
        (1, "inv_spread_sum", 2.0, "low", "cautious", 0.6, 10), (2, "difficulty", 5.0, "high", "bold", 0.5, 10),
        (3, "accord", 0.5, "low", "balanced", 0.5, 10)],
        "rule_id int, metric string, threshold double, direction string, recommended string, accuracy double, support bigint")
    coupons = spark.createDataFrame([(1, 1.0, None, None, 1.0), (2, 3.0, None, 0.1, 9.0), (3, 3.0, 0.1, 0.9, 1.0)],
                                    "coupon_id bigint, inv_spread_sum double, std_cote_fav double, accord double, difficulty double")
    got = {r.coupon_id: r for r in R.recommend(coupons, rules).collect()}
    assert got[1].recommended == "cautious" and got[1].confidence == 1.0
    assert got[2].recommended == "bold" and got[2].confidence == 0.5      # tie: the earlier rule's strategy
    assert got[3].recommended == "balanced" and got[3].voted is None and got[3].confidence == 0.0
    assert got[2].reasoning == "difficulty >= 5.00 -> bold (50%) | accord < 0.50 -> balanced (50%)"
    empty = R.recommend(coupons, rules.where("false")).first()
    assert empty.recommended == "balanced" and empty.voted is None


def test_sliding_window_small_blocks(spark):
    import random
    rng = random.Random(1)
    n = 200
    headers = spark.createDataFrame([(i, f"2020-01-{1 + i % 28:02d}") for i in range(n)], "coupon_id bigint, d string").selectExpr("coupon_id", "to_date(d) AS date")
    hits = {(i, c): rng.randint(0, 3) for i in range(n) for c in range(3)}
    scores = spark.createDataFrame([(i, c, f"w{c}", 3, h) for (i, c), h in hits.items() if i % 9], "coupon_id bigint, candidate int, w_name string, n_legs bigint, n_correct bigint")
    got = {r.coupon_id: (r.candidate, r.score) for r in W.sliding_weights(headers, scores, 3, window=5, block_rows=16).collect()}
    order = sorted(range(n), key=lambda i: (i % 28, i))
    assert len(got) == n - 5
    for at in range(5, n):
        window = [i for i in order[at - 5:at] if i % 9]
        acc = [sum(hits[i, c] for i in window) / (3 * len(window)) if window else 0.0 for c in range(3)]
        assert got[order[at]] == (acc.index(max(acc)), pytest.approx(max(acc)))


@pytest.mark.parametrize("metric", ["accuracy", "n_perfect", "n_near_perfect", "roi"])
def test_sliding_window_longer_than_a_block(spark, metric):
    import random
    rng = random.Random(2)
    n, width = 60, 11
    headers = spark.createDataFrame([(i, 10.0 + i % 4) for i in range(n)], "coupon_id bigint, top_amount double").selectExpr(
        "coupon_id", "DATE'2020-01-01' AS date", "top_amount")
    played = {i: [rng.randint(0, 3) for _ in range(4)] for i in range(n) if i % 7}
    hits = spark.createDataFrame([(i, 3, h) for i, h in played.items()], "coupon_id bigint, n_legs bigint, hits array<int>")
    got = {r.coupon_id: (r.candidate, r.score) for r in W.sliding_hits(headers, hits, 4, window=width, metric=metric, block_rows=4).collect()}
    assert sorted(got) == list(range(width, n))
    for at in range(width, n):
        before = [(i, played[i]) for i in range(at - width, at) if i in played]
        value = {"accuracy": lambda i, h: h / (3 * len(before)), "n_perfect": lambda i, h: h == 3, "n_near_perfect": lambda i, h: h >= 2,
                 "roi": lambda i, h: (9.0 + i % 4 if h == 3 else -1.0) / len(before)}[metric]
        each = [sum(value(i, h[c]) for i, h in before) for c in range(4)]
        assert got[at][1] == pytest.approx(max(each)) and each[got[at][0]] == pytest.approx(max(each))


def test_hits_equal_single_predictions(spark, make_legs):
    import random
    from pooltide.operators import predict as P
    from pooltide.plans import backtest as B
    rng = random.Random(3)
    rows = [(c, p, [rng.choice([0.0, 1.0 + rng.random() * 3]) for _ in range(3)], [rng.choice([0.0, 30.0]) for _ in range(3)],
             rng.choice(["", "1", "N2", "1N2", "-"]), rng.choice("1N2") if c % 6 else rng.choice(["1", None])) for c in range(40) for p in range(1, 8)]
    legs, some = make_legs(rows), W.random_candidates(3)
    got = {r.coupon_id: (r.n_legs, r.hits) for r in B.candidate_hits(legs, None, some).collect()}
    want = [{r.coupon_id: (r.n_legs, r.n_correct) for r in B._coupon_scores(B.backtest_legs(legs, None, w)).collect()} for w in some.values()]
    assert got == {c: (n, [w[c][1] for w in want]) for c, (n, _) in want[0].items()} and len(got) > 30
    long = B.long_scores(B.candidate_hits(legs, None, some), some).where("candidate = 2").first()
    assert long.w_name == list(some)[2] and long.n_correct == got[long.coupon_id][1][2]


def test_equal_sets_of_codes_are_compared_once(spark, monkeypatch):
    """Coverage works on different shapes, not on systems: 40 systems of two shapes are two sets."""
    kept = {}
    staged = V.staged
    monkeypatch.setattr(V, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    rows = [(i, [["1"], ["1", "N"], ["N", "2"]] if i % 2 else [["2", "N", "1"], ["N"], ["2", "1"]], [(1, 1.0), (0, 0.5)]) for i in range(40)]
    got = {(r.system_id, r.radius): r for r in V.coverage(V.covering_systems(_systems(spark, rows))).collect()}
    assert kept["coded_sets"].count() == 2
    assert len(got) == 80 and all(r.covered >= r.target and 0 < r.covered <= 1 for r in got.values())


def test_only_chosen_combinations_become_rows(spark):
    """A request's combinations are cut where they are made: no row of them is exploded, shuffled or sorted."""
    pred = _predictions(spark, PROBS)
    requests = spark.createDataFrame([(1, "bold", 3)], "coupon_id bigint, strategy string, budget int")
    metrics = spark.createDataFrame([(1, 5)], "coupon_id bigint, n_legs bigint")
    made = G.generate(pred, requests, metrics)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    best = sorted(G.combinations(pred, G.legs_to_vary(requests, metrics)).collect(), key=lambda r: (-r.probability, r.ordinal))
    seen, first = set(), []
    for r in best:
        if (r.n_1, r.n_n) not in seen:
            seen.add((r.n_1, r.n_n))
            first.append(r.results)
    assert [r.results for r in made.orderBy("rank").collect()] == first[:3]


def test_a_leg_without_probabilities_keeps_its_combinations(spark):
    pred = spark.createDataFrame([(1, 1, None, None, None, None, None), (1, 2, 0.5, 0.3, 0.2, "1", 0.2)],
                                 "coupon_id bigint, position int, prob_1 double, prob_n double, prob_2 double, prediction string, confidence double")
    requests = spark.createDataFrame([(1, "bold", 100)], "coupon_id bigint, strategy string, budget int")
    metrics = spark.createDataFrame([(1, 2)], "coupon_id bigint, n_legs bigint")
    rows = G.generate(pred, requests, metrics).collect()
    assert len(rows) == 9 and all(r.probability is None and r.score is None and r.confidence is None for r in rows)


def test_two_shares_of_the_same_counts_weigh_twice(spark):
    """Coupons that lack a result give their type a second share for the same counts."""
    pred = _predictions(spark, PROBS)
    requests = spark.createDataFrame([(1, "cautious", 100)], "coupon_id bigint, strategy string, budget int")
    metrics = spark.createDataFrame([(1, 5)], "coupon_id bigint, n_legs bigint")
    plain = G.generate(pred, requests, metrics).collect()
    one = plain[0].profile
    short = "-".join([*one.split("-")[:2], "9"])
    freq = spark.createDataFrame([("LF5", one, 0.6), ("LF5", short, 0.4)], "grid_type string, profile string, share double")
    rows = G.generate(pred, requests, metrics, freq).collect()
    hit = [r for r in plain if r.profile == one]
    assert len(rows) == len(plain) + len(hit)
    assert sorted(r.profile_weight for r in rows if r.profile == one) == [0.4] * len(hit) + [0.6] * len(hit)
