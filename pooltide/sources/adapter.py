"""The driver's star schema read as coupons, legs and a ledger (FIXTURES.md, section 3).

One order is one coupon and one line item is one leg. Columns are plain
expressions over the source columns, so filters and column pruning still reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pooltide.operators.staging import tasks_for

LEG_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _odds(cents: str) -> str:
    return f"IF(l_partkey % 23 = 0, 0.0D, ({cents}) / 100.0D)"


def _share(points: str) -> str:
    return f"IF(l_partkey % 17 = 0, 0.0D, CAST({points} AS DOUBLE))"


_LEG_COLUMNS = (
    # The window names the renamed key, so later grouping by coupon reuses its partitioning.
    "coupon_id", f"row_number() OVER (PARTITION BY coupon_id ORDER BY {LEG_ORDER}) AS position",
    "l_partkey AS part_id", "l_suppkey AS supplier_id",
    f"{_odds('105 + (l_partkey * 37 + l_linenumber * 11) % 420')} AS odds_1",
    f"{_odds('260 + (l_suppkey * 53 + l_partkey) % 240')} AS odds_n",
    f"{_odds('110 + (l_partkey * 91 + l_suppkey * 7) % 650')} AS odds_2",
    f"{_share('10 + l_partkey % 60')} AS share_1",
    f"{_share('10 + l_suppkey % 25')} AS share_n",
    f"{_share('10 + (l_partkey + l_suppkey) % 50')} AS share_2",
    "CASE l_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN 'N' WHEN 3 THEN '2' WHEN 4 THEN '1N' "
    "WHEN 5 THEN 'N2' WHEN 6 THEN '12' WHEN 7 THEN '1N2' ELSE '-' END AS tip",
    "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN 'N' WHEN 'R' THEN '2' END AS result",
)


def leg_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for work on all legs: as many as their number asks for."""
    return tasks_for(table(spark, sf_dir, "lineitem"), f"{sf_dir}/lineitem")


def _raw_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS coupon_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    # Windows and sorts over coupons hold a task's legs several times over, many columns wide: tasks follow the rows, not the bytes.
    return lines.repartition(leg_tasks(spark, sf_dir), "coupon_id").selectExpr(*_LEG_COLUMNS)


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leg, keyed by (coupon_id, position). One shuffle on coupon_id."""
    return _raw_legs(spark, sf_dir).drop("part_id", "supplier_id")


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs as matches, with team, league and country names.

    The dimension sides carry no broadcast hint: Spark broadcasts them while
    their size is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
    them beyond it.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("home"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("away"), F.col("s_nationkey").alias("nation_id"))
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("league"), F.col("n_regionkey").alias("region_id"))
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("country"))
    return (
        _raw_legs(spark, sf_dir)
        .join(part, "part_id").join(supplier, "supplier_id")
        .join(nation, "nation_id").join(region, "region_id")
        .drop("region_id")
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupon-level inputs that need no leg: date, season, difficulty, tips, payouts."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS coupon_id", "to_date(o_orderdate) AS date",
        "concat(year(o_orderdate), '-', year(o_orderdate) + 1) AS season",
        "(o_orderkey % 90) / 10.0D AS difficulty", "o_orderkey % 200 AS n_tips",
        "o_orderkey % 4 AS top_winners", "o_totalprice / 100.0D AS top_amount",
        "o_orderkey % 50 AS near_winners", "o_totalprice / 1000.0D AS near_amount")


def coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per coupon with results and the payout map; a coupon has at least one leg."""
    per_coupon = legs(spark, sf_dir).groupBy("coupon_id").agg(
        F.expr("int(count(1))").alias("n_legs"),
        F.expr("array_join(transform(array_sort(collect_list(struct(position, result))), x -> x.result), '')")
        .alias("results"))
    payout = "named_struct('winners', {}_winners, 'amount', {}_amount)".format
    return headers(spark, sf_dir).join(per_coupon, "coupon_id").selectExpr(
        "coupon_id", "date", "season", "concat('LF', n_legs) AS grid_type", "n_legs", "difficulty", "n_tips", "results",
        "map(concat(n_legs, '_sur_', n_legs), {}, concat(n_legs - 1, '_sur_', n_legs), {}) AS payouts".format(
            payout("top", "top"), payout("near", "near")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money movements per account, ordered by (ts, event_id)."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS account", "ts", "event_id",
        "IF(event_type = 'purchase', value, 0.0D) AS cost", "IF(event_type = 'signup', value, 0.0D) AS payout")
