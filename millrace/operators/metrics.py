"""Counts of records: passed and dropped by key set, labelled ones, and what each output makes of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.schema import ALIVE, LABELS, SIZE


def process_counts(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key set, as it was before the transformations: passed_count, passed_bytes, dropped_count, dropped_bytes."""
    n = F.col(SIZE).cast("bigint")
    live = F.col(ALIVE)
    return records.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count_if(live).alias("passed_count"), F.coalesce(F.sum(F.when(live, n)), F.lit(0)).alias("passed_bytes"),
        F.count_if(~live).alias("dropped_count"), F.coalesce(F.sum(F.when(~live, n)), F.lit(0)).alias("dropped_bytes"),
    )


def label_counts(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per label and key set: labelled_count, labelled_bytes. Labels add up: a record that was redacted and then dropped counts for both."""
    rows = records.filter(F.size(LABELS) > 0).select(*[F.col(f"`{k}`") for k in keys], F.col(SIZE).cast("bigint").alias("_mr_n"), F.explode(LABELS).alias("label"))
    return rows.groupBy("label", *[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("labelled_count"), F.sum("_mr_n").alias("labelled_bytes"))


def serialized_counts(events: DataFrame) -> DataFrame:
    """Per output: serialized records and bytes."""
    return events.groupBy("output").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("data")).alias("serialized_bytes"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Per output: chunks and their bytes."""
    return chunks.groupBy("output").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("data")).alias("chunk_bytes"))
