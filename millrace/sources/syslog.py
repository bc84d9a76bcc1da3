"""Syslog records (RFC 5424) of one or many lines: framing and parsing, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import first_bytes
from millrace.operators.ranks import carried
from millrace.schema import LABELS, ORDER, SIZE, SOURCE, Schema, start_records

# Names of facilities, of severities, and of levels as loggers know them.
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
SEVERITIES = ("emerg", "alert", "crit", "err", "warn", "notice", "info", "debug")
LOG_LEVELS = ("off", "fatal", "crit", "error", "warn", "notice", "info", "debug")
#: Bytes of a message that are kept, and bytes of a record from which on it is cut.
MAX_MESSAGE = 1 << 20
SOFT_LIMIT = MAX_MESSAGE + 256
#: Bytes of an unfinished record that are kept before it is cut.
BUFFER = 3 * SOFT_LIMIT
OVERFLOW = "overflow"

_START = r"\A<[0-9]{1,3}>1 "


def is_start(line: Column) -> Column:
    """Whether a line starts a record: 32 bytes or more, `<`, one to three digits, `>1 `."""
    return (F.octet_length(line) >= 32) & line.rlike(_START)


def frame_text(df: DataFrame, text: str = "value", source: Column | None = None) -> DataFrame:
    """(source, order, record): the records of whole texts, one per file or connection. A text must fit a task; `frame_lines` has no such limit."""
    body = F.regexp_replace(F.col(text), r"\n\z", "")
    parts = F.split(body, r"\n(?=<[0-9]{1,3}>1 )(?=(?s:.{32})|(?s:.*[^\x00-\x7F]))")
    rows = df.select((source if source is not None else F.input_file_name()).alias(SOURCE), F.posexplode(parts).alias(ORDER, "record"))
    return rows.withColumn(ORDER, F.col(ORDER).cast("bigint"))


def read_files(spark: SparkSession, paths: str | Sequence[str], largest: int = 64 << 20) -> DataFrame:
    """(source, order, record) of files, each one connection.

    Files are read whole as long as none is larger than `largest`, so that no record has to move. Larger ones are read in parts of lines:
    a line knows its file, its part by where it starts, and its place in the part, and framing goes by these.
    """
    sizes = spark.read.format("binaryFile").load(paths).select("length").agg(F.max("length")).first()[0] or 0
    if sizes <= largest:
        return frame_text(spark.read.text(paths, wholetext=True))
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("_mr_file"), F.col("_metadata.file_block_start").alias("_mr_at"), F.monotonically_increasing_id().alias("_mr_id"), F.col("value"))
    # A part is read by one task in order, so that its identifiers grow by its lines; parts follow each other by where they start.
    # More lines than bytes of the parts before there can't be: that gives each part numbers of its own.
    first = rows.groupBy("_mr_file", "_mr_at").agg(F.min("_mr_id").alias("_mr_first"))
    numbered = rows.join(first, ["_mr_file", "_mr_at"]).withColumn("_mr_line_no", F.col("_mr_at") + F.col("_mr_id") - F.col("_mr_first"))
    return frame_lines(numbered, "_mr_file", "_mr_line_no", "value")


def frame_lines(df: DataFrame, connection: str, line_no: str, line: str, limit: int = BUFFER) -> DataFrame:
    """(source, order, record) of lines numbered within their connection.

    A line that starts a record closes the one before; other lines continue it. The first line of a connection opens a record whatever it holds.
    Long connections are cut into blocks of lines, so that none has to fit a task; only the lines of one record come together. A record that grows beyond `BUFFER` bytes
    without a next one to end it is cut there, and what follows is framed in pieces of that size, which the parser will reject: no more than one piece is ever in one place. A null line is an empty one.
    """
    rows = df.select(F.col(connection).alias(SOURCE), F.coalesce(F.col(line_no).cast("bigint"), F.lit(0)).alias("_mr_no"), F.coalesce(F.col(line), F.lit("")).alias("_mr_line"))
    opened = carried(rows, F.when(is_start(F.col("_mr_line")), F.col("_mr_no")), [SOURCE], "_mr_no", ORDER)
    # Lines before the first start of a connection form one record, under a number below all others.
    opened = opened.withColumn(ORDER, F.coalesce(ORDER, F.lit(-1).cast("bigint")))
    # Bytes of the record before this line: rows of a window pass one by one, and those held spill. It needs the same partitions as what follows.
    before = Window.partitionBy(SOURCE, ORDER).orderBy("_mr_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.octet_length("_mr_line") + 1).over(before), F.lit(0))
    opened = opened.withColumn("_mr_piece", F.floor(F.greatest(size - 1, F.lit(0)) / limit))
    lines = F.array_sort(F.collect_list(F.struct("_mr_no", "_mr_line")))
    records = opened.groupBy(SOURCE, ORDER, "_mr_piece").agg(lines.alias("_mr_lines"))
    return records.select(SOURCE, F.get("_mr_lines", F.lit(0))["_mr_no"].alias(ORDER), F.array_join(F.transform("_mr_lines", lambda x: x["_mr_line"]), "\n").alias("record"))


MALFORMED = "_mr_malformed"


def parse(df: DataFrame, schema: Schema, levels: Sequence[str] = LOG_LEVELS, record: str = "record") -> DataFrame:
    """Records parsed into fields, with their state columns; `_mr_malformed` says why a record can't be used, or is null.

    Rules: 32 bytes or more, `<pri>1`, a known facility, and six fields after it, each closed by a space; fields may be empty, and the rest is the message. A message
    over 1 MiB is cut and labelled. A null record is malformed.
    """
    raw = F.coalesce(F.col(record), F.lit(""))
    parts = F.split(raw, " ", 8)
    first = F.get("_mr_parts", F.lit(0))
    number = F.substr(first, F.lit(2), F.greatest(F.length(first) - 3, F.lit(0)))
    plain = first.endswith(">1") & ~first.contains("\t") & ~first.contains("\n")
    df = df.withColumn("_mr_parts", parts).withColumn("_mr_pri", F.when(plain, number.try_cast("int")))
    part = lambda i: F.coalesce(F.get("_mr_parts", F.lit(i)), F.lit(""))
    pri = F.col("_mr_pri")
    facility = F.shiftright(pri, 3)
    why = (
        F.when((F.octet_length(raw) < 32) | ~raw.startswith("<"), "no record")
        .when(~part(0).endswith(">1") | (F.octet_length(part(0)) < 2), "version")
        .when(pri.isNull(), "priority")
        .when((facility < 0) | (facility >= len(FACILITIES)), "facility")
        .when(F.size("_mr_parts") < 8, "fields")
    )
    message = part(7)
    long = F.octet_length(message) > MAX_MESSAGE
    log = F.when(long, first_bytes(message, MAX_MESSAGE)).otherwise(message)
    names = F.array(*[F.lit(x) for x in FACILITIES])
    level = F.array(*[F.lit(x) for x in levels])
    fields = {
        "facility": F.coalesce(F.get(names, facility), F.lit("")), "level": F.coalesce(F.get(level, pri.bitwiseAND(7)), F.lit("")),
        **{f: part(i) for i, f in enumerate(("time", "host", "app", "pid", "source", "extradata"), 1)}, "log": log,
    }
    size = F.octet_length(raw)
    out = df.withColumn(MALFORMED, why).withColumns({f: c for f, c in fields.items() if f in schema.fields})
    out = start_records(out, schema, size=size, unescaped=F.coalesce(F.col("log"), F.lit("")).contains("\n"))
    return out.withColumn(LABELS, F.when(long & F.col(MALFORMED).isNull(), F.array(F.lit(OVERFLOW))).otherwise(F.col(LABELS))).drop("_mr_parts", "_mr_pri")


def input_counts(parsed: DataFrame) -> DataFrame:
    """One row: records and bytes that passed the parser, and that it dropped."""
    ok = F.col(MALFORMED).isNull()
    n = F.col(SIZE).cast("bigint")
    return parsed.agg(
        F.count_if(ok).alias("passed_count"), F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("passed_bytes"),
        F.count_if(~ok).alias("dropped_count"), F.coalesce(F.sum(F.when(~ok, n)), F.lit(0)).alias("dropped_bytes"),
        F.count_if(F.array_contains(LABELS, OVERFLOW)).alias("overflow_count"),
    )
