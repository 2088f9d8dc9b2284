"""Generation, covering systems and the ledger (I-*, J-*, F-8, F-11, G-19, E-9)."""

from __future__ import annotations

from pooltide.catalog.base import COUPONS, HEADERS, LEGS, register, stored
from pooltide.catalog.legs import BALANCED_SQL, BLEND, _metrics, predicted, rated_legs
from pyspark.sql import functions as F

from pooltide.operators import covering as V
from pooltide.operators import generate as G
from pooltide.operators import ledger as J
from pooltide.operators import predict as P
from pooltide.plans import backtest as B
from pooltide.sources import adapter as A

PREDICTED = f"{BLEND}, {predicted(BALANCED_SQL)}"
BUDGET = 5

# One request per coupon; the strategy follows the customer's order priority.
REQUESTS = f"""requests AS (
  SELECT o_orderkey AS coupon_id, {BUDGET} AS budget,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'bold' WHEN '5' THEN 'cautious' ELSE 'balanced' END AS strategy FROM orders)"""


def requests(spark, sf):
    return A.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS coupon_id", f"{BUDGET} AS budget",
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'bold' WHEN '5' THEN 'cautious' ELSE 'balanced' END AS strategy")


def _predict(spark, sf):
    return P.predict_legs(rated_legs(spark, sf)).select(
        "coupon_id", "position", "prob_1", "prob_n", "prob_2", "prediction", "confidence")


def predictions(spark, sf):
    return stored(spark, sf, "predictions", _predict)


VARIED = """varied AS (
  SELECT coupon_id, strategy, budget, n_legs, CAST(CASE WHEN nb_matchs_serres >= 3 THEN least(k1 + 1, n_legs) ELSE k1 END AS INTEGER) AS n_varied FROM (
    SELECT *, CASE WHEN inv_spread_sum < 2.0 AND strategy <> 'bold' THEN greatest(k0 - 1, 1)
      WHEN inv_spread_sum > 3.0 AND strategy <> 'cautious' THEN least(k0 + 1, n_legs) ELSE k0 END AS k1 FROM (
      SELECT r.*, g.n_legs, g.inv_spread_sum, g.nb_matchs_serres,
        least(CASE strategy WHEN 'cautious' THEN 2 WHEN 'bold' THEN 5 ELSE 3 END, g.n_legs) AS k0
      FROM requests r JOIN grid_metrics g USING (coupon_id))))"""


@register("legs_to_vary", f"WITH {BLEND}, {REQUESTS}, {VARIED} SELECT * FROM varied")
def legs_to_vary(spark, sf):
    return G.legs_to_vary(requests(spark, sf), _metrics(spark, sf))


FREQ = """frequency AS (SELECT grid_type, profile, n, n / sum(n) OVER (PARTITION BY grid_type)::DOUBLE AS share FROM (
  SELECT grid_type, length(replace(replace(results, 'N', ''), '2', '')) || '-' || length(replace(replace(results, '1', ''), '2', '')) || '-' || length(replace(replace(results, 'N', ''), '1', '')) AS profile, count(*) AS n
  FROM coupons GROUP BY ALL))"""


@register("profile_frequency", f"WITH {COUPONS}, {FREQ} SELECT * FROM frequency", doubles="share", digits=9)
def profile_frequency(spark, sf):
    return G.profile_frequency(A.coupons(spark, sf))


OPTIONS = """ranked AS (
  SELECT coupon_id, position, prediction, confidence, outcome, p,
    row_number() OVER (PARTITION BY coupon_id, position ORDER BY p DESC, o) AS choice,
    dense_rank() OVER (PARTITION BY coupon_id ORDER BY confidence, position) AS vary_rank
  FROM predicted CROSS JOIN LATERAL (VALUES ('1', 0, prob_1), ('N', 1, prob_n), ('2', 2, prob_2)) v(outcome, o, p)
)"""

COMBOS = OPTIONS + """, options AS MATERIALIZED (
  SELECT r.coupon_id, strategy, budget, n_legs, position, outcome, p, choice, vary_rank <= n_varied AS is_varied,
    CASE WHEN vary_rank <= n_varied THEN (choice - 1) * CAST(pow(3, n_varied - vary_rank) AS INT) ELSE 0 END AS ord
  FROM ranked r JOIN varied v USING (coupon_id)
  WHERE choice <= CASE WHEN vary_rank > n_varied THEN 1 WHEN strategy = 'cautious' THEN 2 WHEN strategy = 'bold' THEN 3 WHEN confidence < 0.15 THEN 3 ELSE 2 END
), slots AS MATERIALIZED (
  SELECT o.*, dense_rank() OVER (PARTITION BY coupon_id ORDER BY position) AS slot FROM options o WHERE is_varied
), kept AS (
  SELECT coupon_id, any_value(strategy) AS strategy, any_value(budget) AS budget, any_value(n_legs) AS n_legs,
    coalesce(list_reduce(list(p ORDER BY position) FILTER (NOT is_varied), lambda a, b: a * b), 1e0) AS probability,
    coalesce(list_reduce(list(p ORDER BY position) FILTER (NOT is_varied), lambda a, b: a + b), 0e0) AS total,
    string_agg(outcome, '' ORDER BY position) AS results, count(*) FILTER (is_varied) AS n_slots
  FROM options WHERE choice = 1 GROUP BY coupon_id
), combos AS (
  SELECT coupon_id, strategy, budget, n_legs, n_slots, 0 AS slot, results, probability, total, 0 AS ordinal FROM kept
  UNION ALL
  SELECT c.coupon_id, c.strategy, c.budget, c.n_legs, c.n_slots, c.slot + 1,
    substr(c.results, 1, o.position - 1) || o.outcome || substr(c.results, o.position + 1), c.probability * o.p, c.total + o.p, c.ordinal + o.ord
  FROM combos c JOIN slots o ON o.coupon_id = c.coupon_id AND o.slot = c.slot + 1
), full_combos AS MATERIALIZED (
  SELECT coupon_id, strategy, budget, n_legs, results, probability, total / n_legs AS confidence, ordinal FROM combos WHERE slot = n_slots
)"""


@register("generate_combinations", f"WITH RECURSIVE {PREDICTED}, {REQUESTS}, {VARIED}, {COMBOS} SELECT coupon_id, strategy, CAST(budget AS INTEGER) AS budget, n_legs, results, probability, confidence, CAST(ordinal AS INTEGER) AS ordinal FROM full_combos",
          doubles="probability confidence", digits=12)
def generate_combinations(spark, sf):
    return G.combinations(predictions(spark, sf), G.legs_to_vary(requests(spark, sf), _metrics(spark, sf)), A.leg_tasks(spark, sf)).drop("n_1", "n_n")


_COUPONS_ONLY = COUPONS.replace(LEGS + ", " + HEADERS + ", ", "")

GENERATED = f"""WITH RECURSIVE {PREDICTED}, {_COUPONS_ONLY}, {FREQ}, {REQUESTS}, {VARIED}, {COMBOS}, named AS (
  SELECT *, 'LF' || n_legs AS grid_type, length(replace(replace(results, 'N', ''), '2', '')) || '-' || length(replace(replace(results, '1', ''), '2', '')) || '-' || length(replace(replace(results, 'N', ''), '1', '')) AS profile
  FROM full_combos
), floors AS (SELECT grid_type, min(share) * 0.1e0 AS floor FROM frequency GROUP BY grid_type
), weighted AS (
  SELECT n.*, coalesce(share, floor, 1e0) AS profile_weight, probability * coalesce(share, floor, 1e0) AS score
  FROM named n LEFT JOIN frequency f USING (grid_type, profile) LEFT JOIN floors USING (grid_type)
), placed AS (SELECT *, row_number() OVER (PARTITION BY coupon_id, profile ORDER BY score DESC, ordinal) AS in_profile FROM weighted
), chosen AS (SELECT *, row_number() OVER (PARTITION BY coupon_id ORDER BY (in_profile > 1)::INT, score DESC, ordinal) AS selection FROM placed
), generated AS (SELECT *, CAST(row_number() OVER (PARTITION BY coupon_id ORDER BY probability DESC, selection) AS INTEGER) AS rank
  FROM chosen WHERE selection <= budget)"""


def _generated(spark, sf):
    return G.generate(predictions(spark, sf), requests(spark, sf), _metrics(spark, sf), G.profile_frequency(A.coupons(spark, sf)), A.leg_tasks(spark, sf))


@register("generated_grids", f"{GENERATED} SELECT coupon_id, strategy, rank, results, profile, confidence, probability, profile_weight, score FROM generated",
          doubles="confidence probability profile_weight score", digits=12)
def generated_grids(spark, sf):
    return _generated(spark, sf)


@register("generation_summary", f"{GENERATED} SELECT coupon_id, strategy, count(*) AS n_grids, avg(confidence) AS mean_confidence FROM generated GROUP BY coupon_id, strategy",
          doubles="mean_confidence")
def generation_summary(spark, sf):
    return G.generation_summary(_generated(spark, sf))


BASE = f"""WITH RECURSIVE {PREDICTED}, {_COUPONS_ONLY}, picks AS (
  SELECT coupon_id, position, prediction, confidence, CASE prediction WHEN '1' THEN prob_1 WHEN 'N' THEN prob_n ELSE prob_2 END AS p FROM predicted)"""


@register("base_grids", f"""{BASE} SELECT coupon_id, string_agg(prediction, '' ORDER BY position) AS results, avg(confidence) AS confidence,
  list_reduce(list(p ORDER BY position), lambda a, b: a * b) AS probability FROM picks GROUP BY coupon_id""",
          doubles="confidence probability", digits=12)
def base_grids(spark, sf):
    return G.base_grid(predictions(spark, sf))


@register("expected_values", f"""{BASE}, mean_payout AS (SELECT grid_type, avg(top_amount) AS m FROM coupons GROUP BY grid_type),
base AS (SELECT coupon_id, list_reduce(list(p ORDER BY position), lambda a, b: a * b) AS probability FROM picks GROUP BY coupon_id)
SELECT coupon_id, grid_type, probability * m - 1 AS expected_value FROM base JOIN coupons USING (coupon_id) JOIN mean_payout USING (grid_type)""",
          doubles="expected_value")
def expected_values(spark, sf):
    from pyspark.sql import functions as F
    coupons = A.coupons(spark, sf).selectExpr("coupon_id", "grid_type", "payouts[concat(n_legs, '_sur_', n_legs)].amount AS amount")
    mean = coupons.groupBy("grid_type").agg(F.avg("amount").alias("mean_payout"))
    grids = G.base_grid(predictions(spark, sf)).join(coupons.drop("amount"), "coupon_id").join(F.broadcast(mean), "grid_type")
    return G.expected_value(grids, "mean_payout").select("coupon_id", "grid_type", "expected_value")


VARIANT_COMBOS = (COMBOS[COMBOS.index("slots AS MATERIALIZED"):].replace("full_combos", "variant_combos")
                  .replace("any_value(budget) AS budget, ", "").replace("c.budget, ", "").replace("budget, ", ""))


@register("variant_grids", f"""WITH RECURSIVE {PREDICTED}, {REQUESTS}, {OPTIONS}, options AS MATERIALIZED (
  SELECT r.coupon_id, strategy, position, outcome, p, n_legs, vary_rank <= n_varied AS is_varied,
    row_number() OVER (PARTITION BY r.coupon_id, position ORDER BY choice) AS choice,
    CASE WHEN vary_rank <= n_varied THEN
    (row_number() OVER (PARTITION BY r.coupon_id, position ORDER BY choice) - 1) * CAST(pow(3, n_varied - vary_rank) AS INT) ELSE 0 END AS ord
  FROM ranked r JOIN (SELECT coupon_id, strategy, n_legs, least(CASE strategy WHEN 'cautious' THEN 1 WHEN 'bold' THEN 4 ELSE 3 END, n_legs) AS n_varied
    FROM requests JOIN grid_metrics USING (coupon_id)) v USING (coupon_id)
  WHERE CASE WHEN vary_rank <= n_varied THEN outcome <> prediction ELSE outcome = prediction END
), {VARIANT_COMBOS}
SELECT coupon_id, strategy, CAST(row_number() OVER (PARTITION BY coupon_id ORDER BY probability DESC, ordinal) AS INTEGER) AS rank, results,
  confidence, probability FROM variant_combos
QUALIFY row_number() OVER (PARTITION BY coupon_id ORDER BY probability DESC, ordinal) <= 3""", doubles="confidence probability", digits=12)
def variant_grids(spark, sf):
    return G.variants(predictions(spark, sf), requests(spark, sf).drop("budget"), 3)


# A player's selection per leg: the tip's outcomes, or all three where there is none.
def systems(spark, sf):
    from pyspark.sql import functions as F
    options = ("CASE WHEN tip IN ('', '-') THEN array('1', 'N', '2') ELSE split(tip, '') END")
    return A.legs(spark, sf).groupBy(F.col("coupon_id").alias("system_id")).agg(F.expr(
        f"transform(array_sort(collect_list(struct(position, {options} AS options))), x -> x.options)").alias("selections")
    ).selectExpr("system_id", "selections", "array(named_struct('radius', 1, 'coverage', 1.0D)) AS guarantees")


SYSTEMS = f"""WITH {LEGS}, systems AS (
  SELECT coupon_id AS system_id, count(*) AS n_legs, CAST(count(*) FILTER (width = 2) AS INTEGER) AS n_doubles,
    CAST(count(*) FILTER (width = 3) AS INTEGER) AS n_triples, CAST(round(product(width)) AS BIGINT) AS n_combinations
  FROM (SELECT *, CASE WHEN tip IN ('', '-') THEN 3 ELSE length(tip) END AS width FROM legs) GROUP BY coupon_id)"""


@register("combination_counts", f"{SYSTEMS} SELECT system_id, n_doubles, n_triples, n_combinations FROM systems")
def combination_counts(spark, sf):
    return V.combination_counts(systems(spark, sf)).select("system_id", "n_doubles", "n_triples", "n_combinations")


def covered(spark, sf):
    return stored(spark, sf, "covered", lambda s, d: V.covering_systems(systems(s, d)))


# The cover itself has no SQL twin; what it promises has: every system of several legs is covered in full, by fewer
# combinations than it has if any leg varies, and by no fewer than the sphere bound allows.
@register("covering_guarantees", f"""{SYSTEMS} SELECT system_id, n_combinations, CASE WHEN n_legs <= 1 THEN 'invalid radius' END AS error,
  CASE WHEN n_legs > 1 THEN true END AS met, CASE WHEN n_legs > 1 THEN true END AS above_sphere_bound,
  CASE WHEN n_legs > 1 THEN n_combinations > 1 END AS reduced FROM systems""")
def covering_guarantees(spark, sf):
    table = covered(spark, sf)
    reached = V.coverage(table).groupBy("system_id").agg({"covered": "min", "target": "max"}).toDF("system_id", "covered", "target")
    # A chosen combination covers itself and what differs in one varied leg: no cover can be smaller.
    sphere = "(1 + n_doubles + 2 * n_triples)"
    return table.join(reached, "system_id", "left").selectExpr(
        "system_id", "n_combinations", "error", "CASE WHEN error IS NULL THEN covered >= target END AS met",
        f"CASE WHEN error IS NULL THEN n_grids * {sphere} >= n_combinations END AS above_sphere_bound",
        "CASE WHEN error IS NULL THEN n_grids < n_combinations END AS reduced")


@register("covering_systems")
def covering_systems(spark, sf):
    return covered(spark, sf).select("system_id", "n_combinations", "n_grids", "reduction", "grids", "error")


# Every combination of the reduced sets, checked: each is one of its system's, and none is chosen twice.
@register("covering_grids", f"""{SYSTEMS} SELECT system_id, true AS all_valid, true AS all_different FROM systems WHERE n_legs > 1""")
def covering_grids(spark, sf):
    grids = V.expanded_grids(covered(spark, sf)).join(systems(spark, sf).select("system_id", "selections"), "system_id")
    valid = "length(grid) = size(selections) AND forall(sequence(0, size(selections) - 1), i -> array_contains(selections[i], substr(grid, i + 1, 1)))"
    return grids.groupBy("system_id", "grid").agg(F.count(F.lit(1)).alias("n"), F.expr(f"bool_and({valid})").alias("valid")).groupBy("system_id").agg(
        F.expr("bool_and(valid)").alias("all_valid"), F.expr("max(n) = 1").alias("all_different"))


# Entries: every coupon backs the blended pick and the pick read backwards.
def entries(spark, sf):
    picks = B.backtest_coupons(B.backtest_legs(rated_legs(spark, sf)))
    subs = picks.selectExpr("concat('LF', n_legs) AS grid_type", "coupon_id AS grid_number", "CAST(NULL AS DATE) AS entry_date",
                            "array(predicted, reverse(predicted)) AS bets")
    return J.pending_entries(subs)


ENTRIES = f"""WITH {PREDICTED}, {_COUPONS_ONLY}, bets AS (
  SELECT coupon_id, 'LF' || n_legs || '-' || coupon_id AS entry_id, results, n_legs, near_amount, top_amount, bet_no, bet,
    (SELECT count(*) FROM range(1, n_legs + 1) r(i) WHERE substr(bet, CAST(i AS INT), 1) = substr(results, CAST(i AS INT), 1)) AS n_correct
  FROM coupons JOIN (SELECT coupon_id, string_agg(prediction, '' ORDER BY position) AS p FROM predicted GROUP BY coupon_id) USING (coupon_id)
  CROSS JOIN LATERAL (VALUES (0, p), (1, reverse(p))) v(bet_no, bet)
), paid AS (SELECT *, CASE WHEN n_correct = n_legs THEN top_amount WHEN n_correct = n_legs - 1 THEN near_amount ELSE 0e0 END AS payout FROM bets)"""


@register("pending_entries", f"{ENTRIES} SELECT entry_id, count(*) AS n_bets, count(*) * 1e0 AS cost, -count(*) * 1e0 AS net FROM bets GROUP BY entry_id",
          doubles="cost net")
def pending_entries(spark, sf):
    return J.pending(entries(spark, sf)).selectExpr("entry_id", "CAST(size(bets) AS BIGINT) AS n_bets", "cost", "net")


def _outcomes(spark, sf):
    return A.coupons(spark, sf).withColumnRenamed("coupon_id", "grid_number")


@register("resolved_bets", f"{ENTRIES} SELECT entry_id, bet_no, bet, CAST(n_correct AS INTEGER) AS n_correct, payout FROM paid", doubles="payout")
def resolved_bets(spark, sf):
    return J.resolve_bets(entries(spark, sf), _outcomes(spark, sf)).select("entry_id", "bet_no", "bet", "n_correct", "payout")


@register("resolved_entries", f"""{ENTRIES} SELECT entry_id, 2e0 AS cost, count(*) AS n_bets, CAST(max(n_correct) AS INTEGER) AS best_correct, sum(payout) AS total_payout,
  sum(payout) - 2e0 AS net, 'resolved' AS status FROM paid WHERE n_legs >= CASE n_legs WHEN 8 THEN 8 WHEN 12 THEN 12 WHEN 15 THEN 15 ELSE 7 END GROUP BY entry_id""",
          doubles="cost total_payout net")
def resolved_entries(spark, sf):
    return J.resolve_entries(J.resolve_bets(entries(spark, sf), J.resolvable(_outcomes(spark, sf))))


LEDGER = """WITH ledger AS (SELECT user_id AS account, ts, event_id, CASE WHEN event_type = 'purchase' THEN value ELSE 0e0 END AS cost,
  CASE WHEN event_type = 'signup' THEN value ELSE 0e0 END AS payout FROM events),
balances AS (SELECT *, payout - cost AS net, 100e0 + sum(payout - cost) OVER (PARTITION BY account ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS balance FROM ledger)"""


@register("ledger_balances", f"{LEDGER} SELECT account, ts, event_id, cost, payout, net, balance FROM balances", doubles="cost payout net balance", digits=4)
def ledger_balances(spark, sf):
    return J.running_balance(A.ledger(spark, sf))


@register("ledger_roi", f"""{LEDGER} SELECT account, count(*) AS n_entries, sum(cost) AS invested, sum(payout) AS paid, 100 - sum(cost) + sum(payout) AS balance,
  CASE WHEN sum(cost) <> 0 THEN (sum(payout) - sum(cost)) / sum(cost) * 100 ELSE 0e0 END AS roi FROM ledger GROUP BY account""",
          doubles="invested paid balance roi", digits=4)
def ledger_roi(spark, sf):
    return J.return_on_investment(A.ledger(spark, sf))


@register("ledger_evolution", f"""{LEDGER} SELECT account, ts, event_id, balance, net FROM balances
UNION ALL SELECT DISTINCT account, CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), 100e0, 0e0 FROM ledger""", doubles="balance net", digits=4)
def ledger_evolution(spark, sf):
    return J.evolution(A.ledger(spark, sf))
