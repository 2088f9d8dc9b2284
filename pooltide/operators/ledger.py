"""Betting ledger: pending entries, resolution, balances, return on investment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pooltide.functions import sequences as Q
from pooltide.operators.legs import with_exprs
from pooltide.operators.ordered import running_totals

# Results needed before an entry may be resolved; other types need seven.
EXPECTED_RESULTS = "CASE grid_type WHEN 'LF7' THEN 7 WHEN 'LF8' THEN 8 WHEN 'LF12' THEN 12 WHEN 'LF15' THEN 15 ELSE 7 END"


def pending_entries(submissions: DataFrame, unit_cost: float = 1.0) -> DataFrame:
    """New entries from submitted coupons (``bets``: array of results strings)."""
    return submissions.selectExpr(
        "concat(grid_type, '-', grid_number) AS entry_id", "grid_type", "grid_number", "entry_date", "bets",
        "'pending' AS status", f"size(bets) * {unit_cost!r}D AS cost", "0.0D AS total_payout",
        f"-(size(bets) * {unit_cost!r}D) AS net")


def resolvable(outcomes: DataFrame, expected: str = EXPECTED_RESULTS) -> DataFrame:
    """Outcomes complete enough to resolve an entry."""
    return outcomes.where(f"length(coalesce(results, '')) > 0 AND length(results) >= {expected}")


def resolve_bets(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Correct legs and payout of every bet whose coupon has an outcome.

    ``outcomes`` has ``grid_type``, ``grid_number``, ``results`` and the payout
    map keyed ``k_sur_n``.
    """
    joined = entries.join(outcomes.select("grid_type", "grid_number", "results", "payouts"), ["grid_type", "grid_number"])
    bets = joined.selectExpr("entry_id", "cost", "results", "payouts", "posexplode(bets) AS (bet_no, bet)")
    counted = with_exprs(bets, {"n_correct": Q.matching_positions("bet", "results")})
    return with_exprs(counted, {
        "payout": "coalesce(try_element_at(payouts, concat(n_correct, '_sur_', length(results))).amount, 0.0D)",
    }).drop("payouts")


def resolve_entries(bets: DataFrame) -> DataFrame:
    """Totals per entry."""
    return with_exprs(bets.groupBy("entry_id").agg(
        F.first("cost").alias("cost"), F.count(F.lit(1)).alias("n_bets"),
        F.max("n_correct").alias("best_correct"), F.sum("payout").alias("total_payout")), {
            "net": "total_payout - cost", "status": "'resolved'"})


def running_balance(ledger: DataFrame, initial: float = 100.0) -> DataFrame:
    """Balance after every movement, per account in (ts, event_id) order.

    An account is cut into hours, so a busy account spreads over many tasks.
    """
    running = running_totals(
        ledger, ["account"], "date_trunc('hour', ts)", ["ts", "event_id"], {"_paid": "payout - cost"})
    return with_exprs(running, {"net": "payout - cost", "balance": f"{initial!r}D + _paid"}).drop("_paid")


def return_on_investment(ledger: DataFrame, initial: float = 100.0) -> DataFrame:
    """Stake, payout, final balance and ROI in percent per account; 0 without a stake."""
    sums = ledger.groupBy("account").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum("cost").alias("invested"), F.sum("payout").alias("paid"))
    return with_exprs(sums, {
        "balance": f"{initial!r}D - invested + paid",
        "roi": "coalesce(try_divide(paid - invested, invested) * 100, 0.0D)"})


def evolution(ledger: DataFrame, initial: float = 100.0) -> DataFrame:
    """The balance series of every account, opening with its initial balance (``ts`` null)."""
    start = ledger.select("account").distinct().selectExpr(
        "account", "CAST(NULL AS TIMESTAMP) AS ts", "CAST(NULL AS BIGINT) AS event_id",
        f"{initial!r}D AS balance", "0.0D AS net")
    return start.unionByName(running_balance(ledger, initial).select("account", "ts", "event_id", "balance", "net"))


def pending(entries: DataFrame) -> DataFrame:
    """Entries still waiting for their results."""
    return entries.where("status = 'pending'")
