"""Order-dependent operators that never sort one whole group in one task.

A group is cut into blocks that follow its order. Block totals are aggregated
map-side, a prefix sum over the (few) blocks gives each block its start, and the
windows run inside blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def dense_sequence(
    df: DataFrame, parts: list[str], coarse: str, fine: str, order: list[str], name: str = "seq",
) -> DataFrame:
    """Number the rows of each group 1, 2, 3 ... in ``order``.

    ``coarse`` and ``fine`` are SQL expressions that never decrease along
    ``order``: (coarse, fine) names a block, and only the rows of one block
    meet in one task. Choose ``fine`` so that a block is bounded.
    """
    keyed = df.withColumns({"_coarse": F.expr(coarse), "_fine": F.expr(fine)})
    blocks = keyed.groupBy(*parts, "_coarse", "_fine").agg(F.count(F.lit(1)).alias("_rows"))
    inner = blocks.withColumn(
        "_inner", F.coalesce(F.sum("_rows").over(
            Window.partitionBy(*parts, "_coarse").orderBy("_fine").rowsBetween(*_BEFORE)), F.lit(0)))
    outer = blocks.groupBy(*parts, "_coarse").agg(F.sum("_rows").alias("_total")).withColumn(
        "_outer", F.coalesce(F.sum("_total").over(
            Window.partitionBy(*parts).orderBy("_coarse").rowsBetween(*_BEFORE)), F.lit(0)))
    starts = inner.join(outer, [*parts, "_coarse"]).selectExpr(*parts, "_coarse", "_fine", "_inner + _outer AS _start")
    in_block = Window.partitionBy(*parts, "_coarse", "_fine").orderBy(*order)
    return (
        keyed.join(starts, [*parts, "_coarse", "_fine"])
        .withColumn(name, F.col("_start") + F.row_number().over(in_block))
        .drop("_coarse", "_fine", "_start")
    )


def running_totals(
    df: DataFrame, parts: list[str], block: str, order: list[str], totals: dict[str, str],
) -> DataFrame:
    """Running sums within each group, up to and including the current row.

    ``block`` is a SQL expression that never decreases along ``order``;
    ``totals`` maps a new column to the SQL expression summed.
    """
    keyed = df.withColumn("_block", F.expr(block))
    sums = keyed.groupBy(*parts, "_block").agg(*(F.expr(f"sum({x})").alias(f"_s_{k}") for k, x in totals.items()))
    before = Window.partitionBy(*parts).orderBy("_block").rowsBetween(*_BEFORE)
    starts = sums.select(*parts, "_block", *(
        F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in totals))
    in_block = Window.partitionBy(*parts, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return keyed.join(starts, [*parts, "_block"]).withColumns({
        k: F.col(f"_b_{k}") + F.sum(F.expr(x)).over(in_block) for k, x in totals.items()
    }).drop("_block", *(f"_b_{k}" for k in totals))


def with_halo(df: DataFrame, seq: str, width: int, block_rows: int = 1 << 14) -> DataFrame:
    """Cut a sequence (1, 2, 3 ...) into blocks that also hold the ``width`` rows before them.

    Adds ``_block`` and ``_halo``. A trailing frame of up to ``width`` rows taken
    inside a block is then complete for every row that is not ``_halo``.
    """
    home = f"(({seq} - 1) div {block_rows})"
    return df.withColumn(
        "_block", F.expr(f"explode(sequence({home}, ({seq} - 1 + {width}) div {block_rows}))")
    ).withColumn("_halo", F.expr(f"_block <> {home}"))
