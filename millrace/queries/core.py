"""Queries of the core, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.skew import Measure, salted
from millrace.queries import operators
from millrace.session import written

P3 = ["app", "vhost"]


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Records with their key, with those delivered again; narrow, as all of it is shuffled."""
    r = spark.read.parquet(f"{d}/custom_fluentd.parquet")
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(f"environment.{c}"), F.lit(""))))
    return r.select("rec_id", key("app").alias("app"), key("vhost").alias("vhost"), F.coalesce(F.octet_length("log"), F.lit(0)).cast("bigint").alias("n_bytes"), "event_ts")


def _per_key(spark: SparkSession, d: str, measures: list[Measure]) -> DataFrame:
    rows = _keyed(spark, d)
    # Which keys are heavy shows in the rows as they come; the results are of distinct records.
    return salted(rows.dropDuplicates(["rec_id"]), P3, F.col("rec_id"), measures, sizes=rows)


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per key the number of records, the bytes of their text, and the first and last time."""
    return _per_key(spark, d, [Measure("n_records", F.count(F.lit(1)), "sum"), Measure("log_bytes", F.sum("n_bytes"), "sum"), Measure("first_ts", F.min("event_ts"), "min"), Measure("last_ts", F.max("event_ts"), "max")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # A row per key, written: the total and the rows that are compared with it come from one aggregation.
    per_key = written(_per_key(spark, d, [Measure("n", F.count(F.lit(1)), "sum")]))
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return per_key.filter(F.col("n") >= 0.02 * total).select(*P3)


flagship = operators.flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_keys)} | operators.QUERIES

_KEYED = """WITH r AS (SELECT DISTINCT ON (rec_id) lower(trim(coalesce(environment.app, ''))) AS app, lower(trim(coalesce(environment.vhost, ''))) AS vhost,
 coalesce(strlen(log), 0) AS n_bytes, event_ts FROM custom_fluentd) """
SQL: dict[str, str] = {
    "p3_keys": _KEYED + "SELECT app, vhost, count(*) AS n_records, CAST(sum(n_bytes) AS BIGINT) AS log_bytes, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM r GROUP BY app, vhost",
    "p3_found": _KEYED + "SELECT app, vhost FROM r GROUP BY app, vhost HAVING count(*) >= 0.02 * (SELECT count(*) FROM r)",
} | operators.SQL
