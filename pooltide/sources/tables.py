"""Table maintenance: first-wins merges, dimensions, upserts, season cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pooltide.operators.legs import with_exprs
from pooltide.operators.ordered import dense_sequence, with_halo


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key. A minimum, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    lead = [c for c in order if c not in key]
    packed = df.groupBy(*key).agg(F.min(F.struct(*lead, *(c for c in rest if c not in lead))).alias("_row"))
    return packed.selectExpr(*(c if c in key else f"_row.{c} AS {c}" for c in df.columns))


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is absent from ``existing``; the first of equal incoming keys."""
    return first_per_key(incoming, key, order).join(existing.select(*key), key, "left_anti")


def merge_first_wins(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Existing rows plus the new ones; an existing key always wins."""
    return existing.unionByName(new_rows(incoming, existing, key, order), allowMissingColumns=True)


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows replace existing ones of the same key."""
    return existing.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def team_dimension(matches: DataFrame, order: list[str]) -> DataFrame:
    """One row per team name; the country of its first appearance wins."""
    sides = "array(named_struct('side', 0, 'name', home), named_struct('side', 1, 'name', away))"
    seen = matches.selectExpr(*order, "country", f"inline({sides})")
    first = seen.groupBy("name").agg(F.min(F.struct(*order, "side", "country")).alias("f"))
    return first.selectExpr("xxhash64(name) AS team_id", "name", "f.country AS country")


def competition_dimension(matches: DataFrame, order: list[str]) -> DataFrame:
    """One row per (name, season)."""
    first = matches.groupBy(F.col("league").alias("name"), "season").agg(F.min(F.struct(*order, "country")).alias("f"))
    return first.selectExpr("xxhash64(name, season) AS competition_id", "name", "season", "f.country AS country")


def coupon_rows(coupons: DataFrame) -> DataFrame:
    """Coupon records from assembled coupons (``legs``: ordered array with ``result``); ``?`` marks an open leg."""
    return with_exprs(coupons, {
        "results": "array_join(transform(legs, l -> coalesce(l.result, '?')), '')"}).drop("legs")


def coupon_leg_rows(coupons: DataFrame) -> DataFrame:
    """Leg records of assembled coupons, positions from 1."""
    return coupons.selectExpr("coupon_id", "posexplode(legs) AS (i, leg)").selectExpr(
        "coupon_id", "i + 1 AS position", "leg.result AS result")


def is_upcoming(legs: str = "legs", payout: str = "top_amount") -> str:
    """SQL: has legs, none with a result, and no top payout yet."""
    return f"(size({legs}) > 0 AND forall({legs}, l -> l.result IS NULL) AND {payout} IS NULL)"


def not_past(date: str, as_of: str) -> str:
    """SQL: date unknown or not before ``as_of``."""
    return f"({date} IS NULL OR {date} >= {as_of})"


def season_cut(coupons: DataFrame, block_rows: int = 1 << 14) -> DataFrame:
    """Coupons of each (type, season) up to the point where results start to repeat.

    The second consecutive repeat of non-empty results ends the season; the
    first repeat is kept, and coupons without results or legs are dropped.
    Numbers are unique within a season, so a block of 2^16 numbers is bounded.
    """
    parts = ["grid_type", "season"]
    listed = dense_sequence(coupons, parts, "shiftright(number, 16)", "0", ["number"])
    over = "OVER (PARTITION BY grid_type, season, _block ORDER BY seq)"
    marked = with_exprs(with_halo(listed, "seq", 2, block_rows), {
        "repeats": f"results <> '' AND results = lag(results, 1) {over} AND results = lag(results, 2) {over}",
    }).where("NOT _halo")
    ends = marked.where("repeats").groupBy(*parts).agg(F.min("seq").alias("end"))
    return listed.join(ends, parts, "left").where(
        "(end IS NULL OR seq < end) AND results <> '' AND n_legs > 0").drop("seq", "end")


def collection_summary(tables: dict[str, DataFrame], dated: DataFrame, date: str = "date") -> DataFrame:
    """Row count of each table, and the first and last date of one."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).selectExpr(f"'{name}' AS table_name", "n_rows",
             "CAST(NULL AS DATE) AS first_date", "CAST(NULL AS DATE) AS last_date") for name, df in tables.items()]
    period = dated.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("lo"), F.max(date).alias("hi")).selectExpr(
        "'period' AS table_name", "n_rows", "CAST(lo AS DATE) AS first_date", "CAST(hi AS DATE) AS last_date")
    out = period
    for part in parts:
        out = out.unionByName(part)
    return out
