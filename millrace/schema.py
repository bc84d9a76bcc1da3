"""The fixed, ordered schema of records: named fields of text, where empty text means missing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ConfigError

#: Columns beside the fields: receipt time or parsed time, bytes of input, whether escapes are gone, whether the record still lives, labels to count.
TIME, SIZE, UNESCAPED, ALIVE, LABELS = "_mr_time", "_mr_size", "_mr_unescaped", "_mr_alive", "_mr_labels"
#: Where a record came from, and its place there: the order of arrival.
SOURCE, ORDER = "_mr_source", "_mr_order"
STATE = (TIME, SIZE, UNESCAPED, ALIVE, LABELS)

#: Fields the syslog parser fills.
SYSLOG_FIELDS = ("facility", "level", "time", "host", "app", "pid", "source", "extradata", "log")


@dataclass(frozen=True)
class Schema:
    fields: tuple[str, ...]
    max_fields: int = 0

    def __post_init__(self) -> None:
        if not self.fields:
            raise ConfigError("schema has no fields")
        for f in self.fields:
            if not isinstance(f, str) or not f:
                raise ConfigError("schema has a field without a name")
            if f.startswith("_mr_"):
                raise ConfigError(f"field names can't start with _mr_: {f}")
        twice = sorted({f for f in self.fields if self.fields.count(f) > 1})
        if twice:
            raise ConfigError(f"fields occur twice: {', '.join(twice)}")
        if self.max_fields and self.max_fields < len(self.fields):
            raise ConfigError(f"maxFields {self.max_fields} is less than the {len(self.fields)} fields")

    def require(self, field: str, line: int | None = None) -> str:
        if field not in self.fields:
            raise ConfigError(f"field '{field}' is not defined in schema", line)
        return field

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f, T.StringType(), False) for f in self.fields])


def start_records(df: DataFrame, schema: Schema, *, time: Column | None = None, size: Column | None = None, unescaped: Column | None = None) -> DataFrame:
    """``df`` as records: every field present and not null, and the state columns set. Other columns of ``df`` stay."""
    have = set(df.columns)
    cols: dict[str, Column] = {f: F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) if f in have else F.lit("") for f in schema.fields}
    cols[TIME] = time if time is not None else F.current_timestamp()
    cols[SIZE] = (size if size is not None else sum((F.octet_length(cols[f]) for f in schema.fields), F.lit(0))).cast("int")
    cols[UNESCAPED] = unescaped if unescaped is not None else F.lit(False)
    cols[ALIVE] = F.lit(True)
    cols[LABELS] = F.array().cast("array<string>")
    return df.withColumns(cols)


def key_columns(keys: Sequence[str]) -> list[Column]:
    """Columns of a key set as a true tuple: ('a', 'bc') and ('ab', 'c') differ."""
    return [F.col(f"`{k}`") for k in keys]


def keep(df: DataFrame, test: Column) -> DataFrame:
    """Rows for which `test` holds, decided where the filter stands.

    The optimizer would move a filter on a computed column below the projections that compute it, copying their expressions into the filter, again and again
    for columns that build on each other. A column that isn't deterministic keeps it in its place, and each expression is evaluated once.
    """
    return df.withColumn("_mr_place", F.spark_partition_id()).filter(test & (F.col("_mr_place") >= 0)).drop("_mr_place")
