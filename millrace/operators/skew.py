"""Per-key results where a few keys hold most rows: two-stage aggregation with salt.

A first, cheap aggregation finds the heavy keys. Their rows get a salt, so that a heavy key's partial results form in many
tasks; light keys keep salt 0. The partial results, a few per key, are then merged by the original key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """A result per key in two stages: `partial` over rows, `merge` over partial results."""

    name: str
    partial: Column
    merge: str  # sum, min or max


def salted(df: DataFrame, keys: Sequence[str], spread: Column, measures: Sequence[Measure], *, salts: int = 64, heavy_share: float = 0.01, sizes: DataFrame | None = None) -> DataFrame:
    """One row per key with its measures.

    Keys that hold `heavy_share` of all rows or more are heavy: 1 / `heavy_share` keys at most, however large the table is, so
    that the list of heavy keys is small by proof and can be broadcast. `spread` is any value that differs between the rows of a key;
    its hash gives the salt, so that a task run again salts the same way. `sizes` are rows with the keys from which the heavy ones are
    found, where that is cheaper than from ``df``; which keys are salted doesn't change the result. Null keys are keys like any other; an empty table gives no rows.
    """
    if not 0 < heavy_share <= 1 or salts < 1:
        raise ValueError("heavy_share lies in (0, 1] and salts is at least 1")
    counts = (df if sizes is None else sizes).groupBy(*keys).count()
    # One row, a scalar: the product with it has the rows of `counts`.
    total = counts.agg(F.sum("count").alias("_mr_total"))
    heavy = counts.crossJoin(F.broadcast(total)).filter(F.col("count") >= F.col("_mr_total") * heavy_share).select(*[F.col(k).alias(f"_mr_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_mr_{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    marked = df.join(F.broadcast(heavy.withColumn("_mr_heavy", F.lit(True))), on, "left").drop(*[f"_mr_{k}" for k in keys])
    salt = F.when(F.col("_mr_heavy"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).alias("_mr_salt")
    partial = marked.groupBy(*keys, salt).agg(*[m.partial.alias(m.name) for m in measures])
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    return partial.groupBy(*keys).agg(*[merge[m.merge](m.name).alias(m.name) for m in measures])
