"""Running counts and carried values over long ordered groups, without a task that holds a whole group.

A group is cut into blocks by its order; each block is worked on alone, and a small table with a row per group and block carries the totals over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the order in a block.
BLOCK = 50_000


def _named_blocks(keys: Sequence[str], place: str, block: int) -> dict[str, Column]:
    """Keys as text that is never null, so that null keys meet each other, and the block of a row; rows without a place come first."""
    return {f"_mr_k{i}": F.to_json(F.struct(F.col(f"`{k}`"))) for i, k in enumerate(keys)} | {"_mr_block": F.coalesce(F.floor(F.col(place) / block), F.lit(-(2**62)))}


def running_count(df: DataFrame, test: str, keys: Sequence[str], order: Sequence[str], out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with `out`: the number of rows up to and including this one, within its keys, for which the column `test` holds.

    `order` is any leading columns and, last, a whole number; blocks are stretches of `block` numbers. Null keys form a group of their own.
    """
    *lead, place = order
    safe = [*keys, *lead]
    names = [f"_mr_k{i}" for i in range(len(safe))]
    by = [*names, "_mr_block"]
    marked = df.withColumns(_named_blocks(safe, place, block))
    one = F.when(F.col(test), 1).otherwise(0)
    sums = marked.groupBy(*by).agg(F.sum(one).alias("_mr_sum"))
    keyed = names[: len(keys)]
    # A row per group and block: `block` times fewer than rows.
    before = Window.partitionBy(*keyed) if keyed else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_mr_before", F.coalesce(F.sum("_mr_sum").over(before.orderBy(*names[len(keys) :], "_mr_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_mr_sum")
    inner = Window.partitionBy(*by).orderBy(F.col(place)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.withColumn("_mr_in", F.sum(one).over(inner))
    return counted.join(sums, by).withColumn(out, F.col("_mr_in") + F.col("_mr_before")).drop(*by, "_mr_in", "_mr_before")


def carried(df: DataFrame, value: Column, keys: Sequence[str], place: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with `out`: the last value that isn't null at or before this row, within its keys, in the order of the whole number `place`."""
    names = [f"_mr_k{i}" for i in range(len(keys))]
    by = [*names, "_mr_block"]
    marked = df.withColumns(_named_blocks(keys, place, block)).withColumn("_mr_value", value)
    last = marked.groupBy(*by).agg(F.max_by("_mr_value", F.when(F.col("_mr_value").isNotNull(), F.col(place))).alias("_mr_last"))
    before = Window.partitionBy(*names).orderBy("_mr_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_mr_carry", F.last("_mr_last", ignorenulls=True).over(before)).drop("_mr_last")
    inner = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = marked.withColumn("_mr_here", F.last("_mr_value", ignorenulls=True).over(inner))
    return filled.join(last, by).withColumn(out, F.coalesce("_mr_here", "_mr_carry")).drop(*by, "_mr_value", "_mr_here", "_mr_carry")
