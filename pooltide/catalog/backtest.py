"""Backtest, weights and rules (F-9, H-1 ... H-11, H-17, G-22)."""

from __future__ import annotations

import uuid

from pooltide.catalog.base import LEGS, register, rnd, stored
from pooltide.catalog.legs import BALANCED_SQL, BLEND, STRATEGY_WEIGHTS_SQL, _metrics, predicted, rated_legs
from pooltide.operators.predict import STRATEGIES
from pooltide.operators.staging import staging_dir
from pooltide.plans import backtest as B
from pooltide.plans import baselines as L
from pooltide.plans import rules as R
from pooltide.plans import weights as W
from pooltide.sources import adapter as A
from pooltide.sources import documents as D

DEFAULT = f"WITH {BLEND}, {predicted(BALANCED_SQL)}"
PER_COUPON = f"""{DEFAULT}, per_coupon AS (
  SELECT coupon_id, count(*) AS n_legs, count(*) FILTER (prediction = result) AS n_correct FROM predicted GROUP BY coupon_id)"""


def _leg_results(spark, sf):
    return B.backtest_legs(rated_legs(spark, sf))


@register("backtest_legs", f"""{DEFAULT} SELECT coupon_id, position, prediction AS predicted, result AS actual,
  prediction = result AS correct, prob_1, prob_n, prob_2, confidence FROM predicted""",
          doubles="prob_1 prob_n prob_2 confidence")
def backtest_legs(spark, sf):
    return _leg_results(spark, sf)


@register("backtest_coupons", f"""{DEFAULT}
SELECT coupon_id, count(*) AS n_legs, count(*) FILTER (prediction = result) AS n_correct,
  count(*) FILTER (prediction = result) = count(*) AS is_perfect,
  string_agg(result, '' ORDER BY position) AS results, string_agg(prediction, '' ORDER BY position) AS predicted
FROM predicted GROUP BY coupon_id""")
def backtest_coupons(spark, sf):
    return B.backtest_coupons(_leg_results(spark, sf))


@register("backtest_summary", f"""{PER_COUPON}
SELECT 'LF' || n_legs AS grid_type, count(*) AS n_coupons, CAST(sum(n_legs) AS BIGINT) AS n_matches,
  count(*) FILTER (n_correct = n_legs) AS n_perfect, count(*) FILTER (n_correct >= n_legs - 1) AS n_near_perfect,
  count(*) FILTER (n_correct >= 6) AS n_min_correct, sum(n_correct) / sum(n_legs)::DOUBLE AS accuracy,
  avg(n_correct) AS mean_correct, avg((n_correct = n_legs)::INT) * 100 AS pct_perfect, avg((n_correct >= 6)::INT) * 100 AS pct_min_correct
FROM per_coupon GROUP BY n_legs""", doubles="accuracy mean_correct pct_perfect pct_min_correct")
def backtest_summary(spark, sf):
    return B.backtest_summary(_leg_results(spark, sf))


@register("backtest_distribution", f"""{PER_COUPON}
SELECT n_legs, n_correct, count(*) AS n_coupons FROM per_coupon GROUP BY n_legs, n_correct""")
def backtest_distribution(spark, sf):
    return B.correct_distribution(_leg_results(spark, sf))


STRATEGY_SCORES = f"""WITH {BLEND}, {predicted(STRATEGY_WEIGHTS_SQL)}, scores AS (
  SELECT coupon_id, strategy, strategy_order, count(*) AS n_legs, count(*) FILTER (prediction = result) AS n_correct
  FROM predicted GROUP BY ALL)"""


def _strategy_scores(spark, sf):
    return B.candidate_scores(rated_legs(spark, sf), None, STRATEGIES)


@register("strategy_comparison", f"""{STRATEGY_SCORES}
SELECT strategy, n_legs, count(*) AS n_coupons, sum(n_correct) / sum(n_legs)::DOUBLE AS accuracy,
  count(*) FILTER (n_correct = n_legs) AS n_perfect, count(*) FILTER (n_correct >= n_legs - 1) AS n_near_perfect
FROM scores GROUP BY strategy, n_legs""", doubles="accuracy")
def strategy_comparison(spark, sf):
    return B.compare_strategies(_strategy_scores(spark, sf))


PERFORMANCE = f"""{STRATEGY_SCORES}, wide AS (
  SELECT coupon_id, max(n_correct) FILTER (strategy = 'cautious') AS n_correct_cautious,
    max(n_correct) FILTER (strategy = 'balanced') AS n_correct_balanced, max(n_correct) FILTER (strategy = 'bold') AS n_correct_bold,
    arg_max(strategy, n_correct * 10 - strategy_order) AS best_strategy,
    list_sort(list(n_correct), 'DESC')[1] - list_sort(list(n_correct), 'DESC')[2] AS margin
  FROM scores GROUP BY coupon_id
), performance AS MATERIALIZED (
  SELECT w.*, inv_spread_sum, std_cote_fav, accord_cotes_joueurs AS accord, difficulty, moyenne_cote_fav, nb_matchs_serres
  FROM wide w JOIN profiles USING (coupon_id))"""


def _performance(spark, sf):
    return R.strategy_performance(_strategy_scores(spark, sf), _metrics(spark, sf))


@register("strategy_performance", f"{PERFORMANCE} SELECT * FROM performance",
          doubles="inv_spread_sum std_cote_fav accord difficulty moyenne_cote_fav")
def strategy_performance(spark, sf):
    return _performance(spark, sf)


@register("strategy_summary", f"""{PERFORMANCE}
SELECT s.strategy, avg(CASE s.strategy WHEN 'cautious' THEN n_correct_cautious WHEN 'balanced' THEN n_correct_balanced ELSE n_correct_bold END) AS mean_correct,
  count(*) FILTER (best_strategy = s.strategy) AS n_best, avg((best_strategy = s.strategy)::INT) * 100 AS pct_best
FROM performance CROSS JOIN (VALUES ('cautious'), ('balanced'), ('bold')) s(strategy) GROUP BY s.strategy""",
          doubles="mean_correct pct_best")
def strategy_summary(spark, sf):
    return R.strategy_summary(stored(spark, sf, "performance", _performance))


RULES = f"""{PERFORMANCE}, long AS (
  SELECT coupon_id, best_strategy, metric, x FROM performance
  CROSS JOIN LATERAL (VALUES ('inv_spread_sum', inv_spread_sum), ('std_cote_fav', std_cote_fav), ('accord', accord), ('difficulty', difficulty)) v(metric, x)
), thresholds AS (
  SELECT DISTINCT metric, {rnd("t", 9)} AS threshold FROM (
    SELECT metric, unnest(quantile_cont(x, [0.25, 0.33, 0.5, 0.67, 0.75])) AS t FROM long GROUP BY metric)
), counted AS (
  SELECT metric, threshold, CASE WHEN x < threshold THEN 'low' ELSE 'high' END AS direction, best_strategy, count(*) AS wins, min(coupon_id) AS first_seen
  FROM long JOIN thresholds USING (metric) GROUP BY ALL
), majority AS (
  SELECT metric, threshold, direction, best_strategy AS recommended, wins / support::DOUBLE AS acc, support FROM (
    SELECT *, sum(wins) OVER g AS support, row_number() OVER (PARTITION BY metric, threshold, direction ORDER BY wins DESC, first_seen) AS place
    FROM counted WINDOW g AS (PARTITION BY metric, threshold, direction))
  WHERE place = 1 AND support >= 5 AND wins / support::DOUBLE >= 0.40
), ordered AS (
  SELECT metric, {rnd("threshold", 4)} AS threshold, direction, recommended, {rnd("acc", 4)} AS accuracy, CAST(support AS BIGINT) AS support,
    row_number() OVER (ORDER BY {rnd("acc", 4)} DESC, support DESC, list_position(['inv_spread_sum', 'std_cote_fav', 'accord', 'difficulty'], metric), threshold, direction DESC) AS place
  FROM majority
), rules AS MATERIALIZED (
  SELECT metric, threshold, direction, recommended, accuracy, support, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rule_id
  FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY place) AS in_metric FROM ordered)
  WHERE in_metric <= 2 QUALIFY row_number() OVER (ORDER BY place) <= 8)"""


@register("strategy_rules", f"{RULES} SELECT * FROM rules", doubles="threshold accuracy")
def strategy_rules(spark, sf):
    return R.mine_rules(stored(spark, sf, "performance", _performance))


@register("rules_document", f"{RULES} SELECT * FROM rules", doubles="threshold accuracy")
def rules_document(spark, sf):
    """Rules stored as a document and read back."""
    path = f"{staging_dir(spark)}/pooltide/rules-{uuid.uuid4().hex}"
    D.write_document(D.rules_document(R.mine_rules(stored(spark, sf, "performance", _performance))), path)
    return D.read_rules(spark, path)


VOTES = f"""{RULES}, votes AS (
  SELECT coupon_id, recommended, sum(accuracy) AS vote, min(rule_id) AS first_rule FROM long JOIN rules USING (metric)
  WHERE (direction = 'low' AND x < threshold) OR (direction = 'high' AND x >= threshold) GROUP BY coupon_id, recommended
), voted AS (
  SELECT coupon_id, max(vote) AS best, sum(vote) AS total,
    coalesce(sum(vote) FILTER (recommended = 'cautious'), 0) AS v1, coalesce(sum(vote) FILTER (recommended = 'balanced'), 0) AS v2,
    coalesce(sum(vote) FILTER (recommended = 'bold'), 0) AS v3,
    first(recommended ORDER BY round(vote, 9) DESC, first_rule) AS voted FROM votes GROUP BY coupon_id)"""


@register("strategy_recommendations", f"""{VOTES}
SELECT p.coupon_id, best_strategy, voted, coalesce(voted, 'balanced') AS recommended,
  CASE WHEN total > 0 THEN {rnd("best / total", 3)} ELSE 0e0 END AS confidence,
  CASE WHEN total > 0 THEN {rnd("v1 / total", 3)} ELSE 0e0 END AS score_cautious,
  CASE WHEN total > 0 THEN {rnd("v2 / total", 3)} ELSE 0e0 END AS score_balanced,
  CASE WHEN total > 0 THEN {rnd("v3 / total", 3)} ELSE 0e0 END AS score_bold
FROM performance p LEFT JOIN voted USING (coupon_id)""", doubles="confidence score_cautious score_balanced score_bold")
def strategy_recommendations(spark, sf):
    table = stored(spark, sf, "performance", _performance)
    return R.recommend(table, R.mine_rules(table)).select(
        "coupon_id", "best_strategy", "voted", "recommended", "confidence",
        "score_cautious", "score_balanced", "score_bold")


@register("rule_accuracy", f"""{VOTES}
SELECT count(*) FILTER (voted = best_strategy) / count(*)::DOUBLE AS accuracy, count(*) AS n_coupons
FROM performance LEFT JOIN voted USING (coupon_id)""", doubles="accuracy")
def rule_accuracy(spark, sf):
    table = stored(spark, sf, "performance", _performance)
    return R.rule_accuracy(R.recommend(table, R.mine_rules(table)))


SWEEP = W.sweep_candidates()


def weights_sql(candidates) -> str:
    rows = ", ".join(
        f"({k}, '{name}', " + ", ".join(f"{x!r}::DOUBLE" for x in w) + ")" for k, (name, w) in enumerate(candidates.items()))
    return f"SELECT * FROM (VALUES {rows}) AS v(candidate, w_name, w1, w2, w3, w4, w5)"


def _sweep_sql(candidates) -> str:
    return f"""WITH {BLEND}, {predicted(weights_sql(candidates))}, scores AS MATERIALIZED (
  SELECT coupon_id, candidate, w_name, count(*) AS n_legs, count(*) FILTER (prediction = result) AS n_correct
  FROM predicted GROUP BY ALL)"""


_EVALUATE = """SELECT candidate, w_name, count(*) AS n_coupons, sum(n_correct) / sum(n_legs)::DOUBLE AS accuracy,
  count(*) FILTER (n_correct = n_legs) AS n_perfect, count(*) FILTER (n_correct >= n_legs - 1) AS n_near_perfect,
  avg(CASE WHEN n_correct = n_legs THEN top_amount - 1 ELSE -1e0 END) AS roi
FROM scores JOIN headers USING (coupon_id) GROUP BY candidate, w_name"""


def _sweep(spark, sf, candidates=SWEEP):
    return B.candidate_hits(rated_legs(spark, sf), None, candidates)


@register("weight_sweep", f"{_sweep_sql(SWEEP)} {_EVALUATE}", doubles="accuracy roi")
def weight_sweep(spark, sf):
    return W.evaluate_hits(_sweep(spark, sf), A.headers(spark, sf), SWEEP)


DRAWS = W.random_candidates(40)


@register("weight_search_best", f"{_sweep_sql(DRAWS)}, evaluated AS ({_EVALUATE}) SELECT * FROM evaluated ORDER BY n_near_perfect DESC, candidate LIMIT 1",
          doubles="accuracy roi")
def weight_search_best(spark, sf):
    return W.best_candidate(W.evaluate_hits(_sweep(spark, sf, DRAWS), A.headers(spark, sf), DRAWS), "n_near_perfect")


@register("sliding_weights", f"""{_sweep_sql(SWEEP)}, listed AS (
  SELECT coupon_id, row_number() OVER (ORDER BY date, coupon_id) AS seq FROM headers
), rolled AS (
  SELECT l.coupon_id, seq, c.candidate, coalesce(sum(n_correct) OVER w / sum(n_legs) OVER w::DOUBLE, 0e0) AS score
  FROM listed l CROSS JOIN range({len(SWEEP)}) c(candidate) LEFT JOIN scores s ON s.coupon_id = l.coupon_id AND s.candidate = c.candidate
  WINDOW w AS (PARTITION BY c.candidate ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
)
SELECT coupon_id, seq, CAST(candidate AS INTEGER) AS candidate, score FROM rolled WHERE seq > 20
QUALIFY row_number() OVER (PARTITION BY coupon_id ORDER BY score DESC, candidate) = 1""", doubles="score")
def sliding_weights(spark, sf):
    return W.sliding_hits(A.headers(spark, sf), _sweep(spark, sf), len(SWEEP))


@register("current_weights", f"""{_sweep_sql(SWEEP)}, recent AS (SELECT coupon_id FROM headers ORDER BY date DESC, coupon_id DESC LIMIT 20)
SELECT candidate, w_name, sum(n_correct) / sum(n_legs)::DOUBLE AS accuracy FROM scores JOIN recent USING (coupon_id)
GROUP BY candidate, w_name ORDER BY accuracy DESC, candidate LIMIT 1""", doubles="accuracy")
def current_weights(spark, sf):
    return W.current_weights(A.headers(spark, sf), A.legs(spark, sf), SWEEP)


@register("optimized_backtest", f"""{_sweep_sql(SWEEP)}, evaluated AS ({_EVALUATE}),
best AS (SELECT candidate FROM evaluated ORDER BY accuracy DESC, candidate LIMIT 1)
SELECT w_name AS strategy, n_legs, count(*) AS n_coupons, sum(n_correct) / sum(n_legs)::DOUBLE AS accuracy,
  count(*) FILTER (n_correct = n_legs) AS n_perfect, count(*) FILTER (n_correct >= n_legs - 1) AS n_near_perfect
FROM scores JOIN best USING (candidate) GROUP BY w_name, n_legs""", doubles="accuracy")
def optimized_backtest(spark, sf):
    return B.full_backtest(rated_legs(spark, sf), None, A.headers(spark, sf), SWEEP)["optimized_backtest"]


def _evaluation(name, prediction, p1, pn, p2):
    backed = f"CASE {prediction} WHEN '1' THEN odds_1 WHEN 'N' THEN odds_n ELSE odds_2 END"
    truth = f"CASE result WHEN '1' THEN {p1} WHEN 'N' THEN {pn} ELSE {p2} END"
    return f"""SELECT '{name}' AS name, n_legs, accuracy, log_loss, stake, gains, (gains - stake) / stake AS roi FROM (
  SELECT count(*) AS n_legs, avg(({prediction} = result)::INT) AS accuracy, avg(-ln(greatest(1e-7, least(1 - 1e-7, {truth})))) AS log_loss,
    count(*) FILTER ({backed} > 0) AS stake, sum({backed}) FILTER ({backed} > 0 AND {prediction} = result) AS gains FROM drawn)"""


_THIRD = "(1e0/3e0)"
_INVERSE = {k: f"CASE WHEN odds_1 > 0 THEN (1e0/odds_{k}) / (1e0/odds_1 + 1e0/odds_n + 1e0/odds_2) ELSE {_THIRD} END" for k in "1n2"}
_FAVOURITE = "CASE WHEN f1 >= fn AND f1 >= f2 THEN '1' WHEN fn >= f2 THEN 'N' ELSE '2' END"


@register("baselines", f"""WITH {LEGS}, shares AS (SELECT avg((result = '1')::INT) AS h, avg((result = 'N')::INT) AS d, avg((result = '2')::INT) AS a FROM legs),
drawn AS (SELECT *, {", ".join(f"{x} AS f{k}" for k, x in _INVERSE.items())},
  CAST(('0x' || substr(md5(coupon_id || '-' || position || '-42'), 1, 8)) AS BIGINT) / 4294967296e0 AS u FROM legs, shares)
{_evaluation("random", f"CASE WHEN u < {_THIRD} THEN '1' WHEN u < 2 * {_THIRD} THEN 'N' ELSE '2' END", _THIRD, _THIRD, _THIRD)}
UNION ALL {_evaluation("always_home", "'1'", "1e0", "0e0", "0e0")}
UNION ALL {_evaluation("odds_favorite", _FAVOURITE, "f1", "fn", "f2")}
UNION ALL {_evaluation("distribution", "CASE WHEN u < h THEN '1' WHEN u < h + d THEN 'N' ELSE '2' END", "h", "d", "a")}""",
          doubles="accuracy log_loss gains roi")
def baselines(spark, sf):
    return L.compare_baselines(A.legs(spark, sf))
