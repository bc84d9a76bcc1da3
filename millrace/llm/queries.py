"""Queries of the operators in this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import encoding, mixing, packing, pii, repetition, runs, tokens, truncation
from millrace.session import written


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/custom_fluentd.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(_records(spark, d), "rec_id", "log", "environment.source").select("rec_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """How many and what share of each source's records are cut: the records of `p1_found`, by the same model."""
    return truncation.report(_records(spark, d), "rec_id", "log", "environment.source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # A record delivered again has the same text: it is enough to make the ids of the findings unique.
    return encoding.repair(_records(spark, d).select("rec_id", "log"), "log").filter("garbled").select("rec_id").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every record, once, with its text as it was before decoding went wrong."""
    once = _records(spark, d).select("rec_id", "log").dropDuplicates(["rec_id"])
    return encoding.repair(once, "log").select("rec_id", "garbled", F.col("restored").alias("log"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    r = runs.found(_records(spark, d), "environment.host", "event_ts", "rec_id", "log", min_run=3)
    return r.select(F.col("lo").alias("lo_rec_id"), F.col("hi").alias("hi_rec_id"))


def p4_events(spark: SparkSession, d: str) -> DataFrame:
    """All records of each host with every run as one event; records without text are events of their own."""
    e = runs.collapsed(_records(spark, d), "environment.host", "event_ts", "rec_id", "log", min_run=3, carry=["level", "log"])
    return e.select(F.col("entity").alias("host"), F.col("key").alias("rec_id"), "started_at", "n_records", "duration_s", "level", "log")


def p4_near_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of records that share at least 0.7 of their words, with no hour of silence inside."""
    r = runs.found(_records(spark, d), "environment.host", "event_ts", "rec_id", "log", min_run=3, min_similarity=0.7, max_gap=3600.0)
    return r.select(F.col("entity").alias("host"), F.col("lo").alias("lo_rec_id"), F.col("hi").alias("hi_rec_id"), F.col("n").alias("n_records"), ((F.col("last_at") - F.col("first_at")) / F.lit(1e6)).alias("duration_s"))


def _names(spark: SparkSession, d: str):
    return pii.name_lists(spark.read.parquet(f"{d}/name_parts.parquet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.kinds_found(_records(spark, d), "rec_id", "log", _names(spark, d)).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every record, once, with placeholders for its personal information."""
    once = _records(spark, d).select("rec_id", "log").dropDuplicates(["rec_id"])
    return pii.redact(once, "rec_id", "log", _names(spark, d), redacted="log")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their sizes in tokens, written once: packing and mixing read them several times."""
    return written(tokens.token_counts(_documents(spark, d), "text", {"doc_id": "doc_id", "source": "source"}))


def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    rows = spark.read.parquet(f"{d}/pack_targets.parquet").select("pack_id", "capacity_tokens").limit(packing.MAX_PACKS + 1).collect()
    return sorted(map(tuple, rows))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece, for each capacity."""
    return packing.pack(_sizes(spark, d), "doc_id", _packs(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The fill of every container."""
    packs = _packs(spark, d)
    return packing.containers(packing.pack(_sizes(spark, d), "doc_id", packs), packs)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and mean fill of each capacity, topped up across buckets and with batches from one bucket only."""
    packs, sizes = _packs(spark, d), _sizes(spark, d)

    def total(across: bool, name: str, n_buckets: int) -> DataFrame:
        c = packing.containers(packing.pack(sizes, "doc_id", packs, n_buckets=n_buckets, across=across), packs)
        return c.groupBy("pack_id").agg(F.count(F.lit(1)).alias(f"{name}_containers"), F.avg("fill").alias(f"{name}_fill"))

    return total(True, "topped_up", packing.N_BUCKETS).join(total(False, "one_bucket", 16), "pack_id")


def _mix(spark: SparkSession, d: str, keep: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sizes(spark, d), "doc_id", mixing.read_targets(spark.read.parquet(f"{d}/mix_targets.parquet")), keep=keep)


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their number of uses: mixes of the wanted size, shares as wanted where the repetitions suffice."""
    return _mix(spark, d, "size")[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, weight and actual share of every source of those mixes, and their sizes."""
    return mixing.shares(*_mix(spark, d, "size"))


def p7_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of mixes whose weights are natural shares raised to one exponent, as even as the targets are (the same entropy)."""
    return mixing.shares(*_mix(spark, d, "entropy"))


def p7_held_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of mixes that hold their target shares and get smaller where a source doesn't suffice."""
    return mixing.shares(*_mix(spark, d, "shares"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.over_limits(repetition.repetition(_documents(spark, d), "doc_id", "text"), max_share=0.30).select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of every document."""
    return repetition.repetition(_documents(spark, d), "doc_id", "text").select("doc_id", "n_words", "repeated_words", "repeated_share")


def p8_longest(spark: SparkSession, d: str) -> DataFrame:
    """The longest stretch of words that every document repeats, with the documents over both limits marked."""
    r = repetition.repetition(_documents(spark, d), "doc_id", "text")
    return r.select("doc_id", "longest_repeat", ((F.col("repeated_share") >= 0.30) | (F.col("longest_repeat") > 50)).alias("over_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_restored, p4_found, p4_events, p4_near_runs, p5_found, p5_redacted, p6_pieces, p6_containers, p6_fill, p7_documents, p7_shares, p7_entropy_shares, p7_held_shares, p8_found, p8_shares, p8_longest)}

_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda w: NOT regexp_matches(w, '[\p{{Nd}}²³¹⁰-⁹₀-₉]'))"
_RUNS = (
    """
WITH r AS (SELECT DISTINCT rec_id, coalesce(environment.host, '') AS host, event_ts, level, log FROM custom_fluentd WHERE log IS NOT NULL AND log <> ''),
w AS (SELECT rec_id, host, event_ts, level, log, """
    + _WORDS.format("log")
    + """ AS ws FROM r),
s AS (SELECT *, CASE WHEN ws = lag(ws) OVER o THEN 0 ELSE 1 END AS starts FROM w WINDOW o AS (PARTITION BY host ORDER BY event_ts, rec_id)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY host ORDER BY event_ts, rec_id) AS run FROM s),
n AS (SELECT host, run, count(*) AS n, min(rec_id) AS lo, max(rec_id) AS hi, min(event_ts) AS t0, max(event_ts) AS t1 FROM g GROUP BY host, run)
"""
)
_SHARES = (
    "WITH t AS (SELECT doc_id, "
    + _WORDS.format("coalesce(text, '')")
    + """ AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i, ws FROM t WHERE len(ws) >= 5),
k AS (SELECT doc_id, n, i, ws[i:i+4] AS five FROM u),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, five ORDER BY i) AS nth FROM k),
c AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM f WHERE nth > 1) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(rep, 0) AS BIGINT) AS repeated_words, CASE WHEN len(ws) = 0 THEN 0.0 ELSE CAST(coalesce(rep, 0) AS DOUBLE) / len(ws) END AS repeated_share
FROM t LEFT JOIN c USING (doc_id)"""
)
SQL: dict[str, str] = {
    "p4_found": _RUNS + "SELECT lo AS lo_rec_id, hi AS hi_rec_id FROM n WHERE n >= 3",
    "p4_events": _RUNS
    + """SELECT host, rec_id, event_ts AS started_at, CASE WHEN n >= 3 THEN n ELSE 1 END AS n_records, CASE WHEN n >= 3 THEN (epoch_us(t1) - epoch_us(t0)) / 1e6 ELSE 0.0 END AS duration_s, level, log
FROM g JOIN n USING (host, run) WHERE n < 3 OR starts = 1
UNION ALL SELECT DISTINCT coalesce(environment.host, ''), rec_id, event_ts, 1, 0.0, level, log FROM custom_fluentd WHERE log IS NULL OR log = ''""",
    "p8_shares": _SHARES,
    "p8_found": f"SELECT doc_id FROM ({_SHARES}) WHERE repeated_share >= 0.30",
}
