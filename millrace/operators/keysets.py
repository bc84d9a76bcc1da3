"""Key sets: which pipeline a record belongs to, and its tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import Orchestration
from millrace.functions.templates import expand


def key_name(field: str) -> str:
    return f"_mr_key_{field}"


def capture(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with the values of `fields` as they are now, out of reach of later steps."""
    return df.withColumns({key_name(f): F.col(f"`{f}`") for f in fields}) if fields else df


def tag(o: Orchestration) -> Column:
    """The tag of a record, from its captured keys."""
    return expand(o.tag, lambda f: F.col(f"`{key_name(f)}`"))


def distribute(df: DataFrame, o: Orchestration, partitions: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Records of a key set together and in order of arrival, for sinks that need it. A key set with most records makes one large partition: only ordered sinks should ask."""
    keys = [F.col(f"`{key_name(k)}`") for k in o.keys]
    if not keys:
        return df.coalesce(1).sortWithinPartitions(*order) if order else df
    out = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return out.sortWithinPartitions(*keys, *order) if order else out
