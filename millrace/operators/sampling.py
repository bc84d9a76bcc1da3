"""Deterministic down-sampling: of the matching records of a key set, a fixed percentage is dropped, in order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranks import running_count


def dropped(nth: Column, percentage: int) -> Column:
    """Whether the nth matching record goes: the first stays; of the next, one goes whenever less than the percentage went so far."""
    up = lambda k: F.floor((k * percentage + 99) / 100)
    return (nth >= 2) & (up(nth - 1) > up(nth - 2))


def keep_share(df: DataFrame, matched: str, percentage: int, keys: Sequence[str], order: Sequence[str], out: str, seen: DataFrame | None = None) -> DataFrame:
    """``df`` with `out`: whether the record is to be dropped, for records for which the column `matched` holds.

    `order` is a source and a whole number in it. Key sets of any size are counted in blocks, so no task holds one whole.
    `seen` has, per key set, how many matched in batches before (`_mr_seen`); without it counting starts at one.
    """
    counted = running_count(df, matched, keys, order, "_mr_nth")
    nth = F.col("_mr_nth")
    if seen is not None:
        counted = counted.join(seen.select(*[seen[k].alias(f"_mr_s{i}") for i, k in enumerate(keys)], "_mr_seen"), _same(counted, keys), "left") if keys else counted.crossJoin(F.broadcast(seen.select("_mr_seen")))
        nth = nth + F.coalesce(F.col("_mr_seen"), F.lit(0))
    return counted.withColumn(out, F.col(matched) & dropped(nth, percentage)).drop("_mr_nth", "_mr_seen", *[f"_mr_s{i}" for i in range(len(keys))])


def _same(df: DataFrame, keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & df[f"`{k}`"].eqNullSafe(F.col(f"_mr_s{i}"))
    return test
