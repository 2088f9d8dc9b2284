"""Numeric helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Sums over a coupon arrive in any order, so a value that is a tie on paper may
# sit one ulp below it. The nudge makes the rounding independent of that order.
_NUDGE = "1e-7D"


def rounded(x: str, digits: int = 6) -> str:
    """SQL: round half up to ``digits`` places, stable against summation order."""
    scale = f"1e{digits}D"
    return (f"CASE WHEN abs({x}) < 1e9D THEN CAST(floor(({x}) * {scale} + (0.5D + {_NUDGE})) AS DOUBLE) / {scale} "
            f"ELSE round({x}, 2) END")


def ratio(num: str, den: str, default: str | None = "0.0D") -> str:
    """SQL: ``num / den``, or ``default`` where the denominator is zero or null."""
    out = f"try_divide(CAST({num} AS DOUBLE), {den})"
    return out if default is None else f"coalesce({out}, {default})"


def share(cond: str) -> Column:
    """Share of rows meeting ``cond`` (null counts as not meeting it)."""
    return F.expr(f"avg(CASE WHEN {cond} THEN 1.0D ELSE 0.0D END)")


def n_where(cond: str) -> Column:
    return F.expr(f"count_if({cond})")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column so that results compare across engines."""
    return df.selectExpr(*[
        f"{rounded(f'`{f.name}`', digits)} AS `{f.name}`" if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields
    ])
