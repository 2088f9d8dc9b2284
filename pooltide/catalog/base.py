"""Registry and the shared text of the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pooltide.functions.numeric import tidy
from pooltide.operators.staging import staged

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rnd(expr: str, digits: int = 6) -> str:
    """The rounding of ``functions.numeric.rounded`` as SQL."""
    scale = f"{10 ** digits}e0"
    return (
        f"CASE WHEN abs({expr}) < 1e9 THEN floor(({expr}) * {scale} + (0.5e0 + 1e-7)) / {scale} "
        f"ELSE round(({expr}), 2) END"
    )


def register(name: str, oracle: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query; ``doubles`` names the double columns the SQL must round."""

    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if oracle is not None:
            names = doubles.split()
            if names:
                repl = ", ".join(f'{rnd("t." + c, digits)} AS {c}' for c in names)
                ORACLE[name] = f"SELECT * REPLACE ({repl}) FROM (\n{oracle}\n) AS t"
            else:
                ORACLE[name] = oracle
        return fn

    return wrap


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """A derived table several reports read: written once per application, then scanned."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = staged(build(spark, sf_dir), name)
    return _STORED[key]


LEGS = """legs AS (
  SELECT l_orderkey AS coupon_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS position,
    l_partkey AS part_id, l_suppkey AS supplier_id,
    CASE WHEN l_partkey % 23 = 0 THEN 0e0 ELSE (((l_partkey*37 + l_linenumber*11) % 420) + 105) / 100e0 END AS odds_1,
    CASE WHEN l_partkey % 23 = 0 THEN 0e0 ELSE (((l_suppkey*53 + l_partkey) % 240) + 260) / 100e0 END AS odds_n,
    CASE WHEN l_partkey % 23 = 0 THEN 0e0 ELSE (((l_partkey*91 + l_suppkey*7) % 650) + 110) / 100e0 END AS odds_2,
    CASE WHEN l_partkey % 17 = 0 THEN 0e0 ELSE CAST(10 + l_partkey % 60 AS DOUBLE) END AS share_1,
    CASE WHEN l_partkey % 17 = 0 THEN 0e0 ELSE CAST(10 + l_suppkey % 25 AS DOUBLE) END AS share_n,
    CASE WHEN l_partkey % 17 = 0 THEN 0e0 ELSE CAST(10 + (l_partkey + l_suppkey) % 50 AS DOUBLE) END AS share_2,
    CASE l_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN 'N' WHEN 3 THEN '2' WHEN 4 THEN '1N'
      WHEN 5 THEN 'N2' WHEN 6 THEN '12' WHEN 7 THEN '1N2' ELSE '-' END AS tip,
    CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN 'N' WHEN 'R' THEN '2' END AS result
  FROM lineitem
)"""

FIXTURES = LEGS + """, fixtures AS (
  SELECT l.*, p_name AS home, s_name AS away, n_name AS league, r_name AS country
  FROM legs l JOIN part ON p_partkey = part_id JOIN supplier ON s_suppkey = supplier_id
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
)"""

HEADERS = """headers AS (
  SELECT o_orderkey AS coupon_id, CAST(o_orderdate AS DATE) AS date,
    CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS season,
    (o_orderkey % 90) / 10e0 AS difficulty, o_orderkey % 200 AS n_tips,
    o_orderkey % 4 AS top_winners, o_totalprice / 100e0 AS top_amount,
    o_orderkey % 50 AS near_winners, o_totalprice / 1000e0 AS near_amount
  FROM orders
)"""

COUPONS = LEGS + ", " + HEADERS + """, coupons AS (
  SELECT h.coupon_id, h.date, h.season, 'LF' || CAST(n_legs AS VARCHAR) AS grid_type, n_legs,
    h.difficulty, h.n_tips, results, top_winners, top_amount, near_winners, near_amount
  FROM headers h JOIN (
    SELECT coupon_id, CAST(count(*) AS INTEGER) AS n_legs, string_agg(result, '' ORDER BY position) AS results
    FROM legs GROUP BY coupon_id) g USING (coupon_id)
)"""

# Favourite view of a leg: the SQL twin of operators.legs.leg_view.
VIEW = """view AS (
  SELECT *,
    CASE WHEN odds_1 = fav THEN 1 WHEN odds_n = fav THEN 2 WHEN odds_2 = fav THEN 3 END AS fav_index,
    CASE WHEN odds_1 = outsider THEN 1 WHEN odds_n = outsider THEN 2 WHEN odds_2 = outsider THEN 3 END AS outsider_index,
    outsider - fav AS spread,
    CASE WHEN share_1 >= share_n AND share_1 >= share_2 THEN 1 WHEN share_n >= share_2 THEN 2 ELSE 3 END AS crowd_index,
    q1 + qn + q2 AS qsum, share_1 + share_n + share_2 AS ssum,
    (share_1 > 0 OR share_n > 0 OR share_2 > 0) AS has_share
  FROM (
    SELECT *,
      least(CASE WHEN odds_1 > 0 THEN odds_1 END, CASE WHEN odds_n > 0 THEN odds_n END, CASE WHEN odds_2 > 0 THEN odds_2 END) AS fav,
      greatest(CASE WHEN odds_1 > 0 THEN odds_1 END, CASE WHEN odds_n > 0 THEN odds_n END, CASE WHEN odds_2 > 0 THEN odds_2 END) AS outsider,
      CASE WHEN odds_1 > 0 THEN 1e0 / odds_1 ELSE 0e0 END AS q1,
      CASE WHEN odds_n > 0 THEN 1e0 / odds_n ELSE 0e0 END AS qn,
      CASE WHEN odds_2 > 0 THEN 1e0 / odds_2 ELSE 0e0 END AS q2
    FROM legs)
)"""
