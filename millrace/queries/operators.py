"""A query for each operator of the log program, over the driver's tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Node, Rewrite, Step, read_steps
from millrace.functions.matchers import match_column, predicate
from millrace.functions.text import redact_email
from millrace.operators.keysets import key_name
from millrace.operators.metrics import chunk_counts, serialized_counts
from millrace.operators.rewriters import rewritten
from millrace.plans import pipeline
from millrace.plans.steps import run_steps
from millrace.queries.sample import program
from millrace.schema import ALIVE, LABELS, ORDER, SIZE, SOURCE, TIME, Schema, start_records
from millrace.sinks import chunks
from millrace.sinks.events import event_columns, event_json, serialize
from millrace.sources.syslog import FACILITIES, LOG_LEVELS, MALFORMED, frame_lines, input_counts, is_start, parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/syslog_lines.parquet")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return frame_lines(_lines(spark, d), "conn_id", "line_no", "line")


# Framing and parsing

_FRAMED = r"""
WITH l AS (SELECT conn_id, line_no, coalesce(line, '') AS line, strlen(coalesce(line, '')) >= 32 AND regexp_matches(coalesce(line, ''), '^<[0-9]{1,3}>1 ') AS starts FROM syslog_lines),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id ORDER BY line_no) AS rec FROM l),
framed AS (SELECT conn_id, min(line_no) AS line_no, string_agg(line, chr(10) ORDER BY line_no) AS record FROM g GROUP BY conn_id, rec)
"""


@query("framing", _FRAMED + "SELECT conn_id, line_no, record FROM framed")
def framing(spark: SparkSession, d: str) -> DataFrame:
    """Records of one or many lines, per connection."""
    return _raw(spark, d).select(F.col(SOURCE).alias("conn_id"), F.col(ORDER).alias("line_no"), "record")


@query("record_start", "SELECT line_id FROM syslog_lines WHERE strlen(line) >= 32 AND regexp_matches(line, '^<[0-9]{1,3}>1 ')")
def record_start(spark: SparkSession, d: str) -> DataFrame:
    """Lines that start a record."""
    return _lines(spark, d).filter(is_start(F.col("line"))).select("line_id")


_PARSED = (
    _FRAMED
    + r""", t AS (SELECT *, string_split(record, ' ') AS w, regexp_extract(record, '^<([0-9]{1,9})>1 ', 1) AS pri FROM framed),
ok AS (SELECT *, CAST(pri AS INT) AS p FROM t WHERE strlen(record) >= 32 AND pri <> '' AND CAST(pri AS INT) // 8 < 24 AND len(w) >= 8),
parsed AS (SELECT conn_id, line_no, record, list_extract(["""
    + ", ".join(f"'{x}'" for x in FACILITIES)
    + "], p // 8 + 1) AS facility, list_extract(["
    + ", ".join(f"'{x}'" for x in LOG_LEVELS)
    + r"], p % 8 + 1) AS level, w[2] AS time, w[3] AS host, w[4] AS app, w[5] AS pid, w[6] AS source, w[7] AS extradata, array_to_string(w[8:], ' ') AS log FROM ok) "
)


@query("parse_fields", _PARSED + "SELECT conn_id, line_no, facility, level, time, host, app, pid, source, extradata, log, CAST(strlen(record) AS INT) AS n_bytes FROM parsed")
def parse_fields(spark: SparkSession, d: str) -> DataFrame:
    """Well-formed records as fields; facility and level come from their tables."""
    p = parse(_raw(spark, d), program().schema).filter(F.col(MALFORMED).isNull())
    return p.select(F.col(SOURCE).alias("conn_id"), F.col(ORDER).alias("line_no"), "facility", "level", "time", "host", "app", "pid", "source", "extradata", "log", F.col(SIZE).alias("n_bytes"))


@query("malformed", _PARSED + "SELECT conn_id, line_no FROM framed ANTI JOIN parsed USING (conn_id, line_no)")
def malformed(spark: SparkSession, d: str) -> DataFrame:
    """Records that can't be parsed."""
    return parse(_raw(spark, d), program().schema).filter(F.col(MALFORMED).isNotNull()).select(F.col(SOURCE).alias("conn_id"), F.col(ORDER).alias("line_no"))


@query(
    "input_counters",
    _PARSED + """, n AS (SELECT count(*) AS c, coalesce(sum(strlen(record)), 0) AS b FROM parsed), a AS (SELECT count(*) AS c, coalesce(sum(strlen(record)), 0) AS b FROM framed)
SELECT n.c AS passed_count, CAST(n.b AS BIGINT) AS passed_bytes, a.c - n.c AS dropped_count, CAST(a.b - n.b AS BIGINT) AS dropped_bytes, (SELECT count(*) FROM parsed WHERE strlen(log) > 1048576) AS overflow_count FROM n, a""",
)
def input_counters(spark: SparkSession, d: str) -> DataFrame:
    """Records and bytes that the parser passed and dropped."""
    return input_counts(parse(_raw(spark, d), program().schema))


_APP = "app_rec_id, facility, level, time_raw, host, app, pid, source, extradata, log, class, task, coalesce(vhost, '') AS vhost, pnum, ddsource, ddtags, hostname, service"


@query(
    "extractions",
    _PARSED
    + r""", e AS (SELECT *, regexp_matches(log, '^\[.*?\] - ') AND starts_with(log, '[') AND strlen(split_part(substr(log, 2), '] - ', 1)) + 4 <= 100 AS has_class,
 regexp_matches(source, ':[0-9a-f-]*$') AND strlen(regexp_extract(source, ':([0-9a-f-]*)$', 1)) + 1 <= 41 AS has_task, contains(app, '/') AND strlen(regexp_extract(app, '/([^/]*)$', 1)) + 1 <= 100 AS has_vhost FROM parsed),
x AS (SELECT *, CASE WHEN has_class THEN trim(split_part(substr(log, 2), '] - ', 1)) ELSE '' END AS class, CASE WHEN has_task THEN regexp_extract(source, ':([0-9a-f-]*)$', 1) ELSE '' END AS t0 FROM e)
SELECT line_id, '' AS facility, level, time AS time_raw, host, CASE WHEN has_vhost THEN regexp_replace(app, '/[^/]*$', '') ELSE app END AS app, '' AS pid, CASE WHEN has_task THEN regexp_replace(source, ':[0-9a-f-]*$', '') ELSE source END AS source, '' AS extradata,
 CASE WHEN has_class THEN substr(log, instr(log, '] - ') + 4) ELSE log END AS log, class, CASE WHEN class <> '' AND t0 <> '' THEN t0 || ':' || class ELSE t0 END AS task, CASE WHEN has_vhost THEN regexp_extract(app, '/([^/]*)$', 1) ELSE '' END AS vhost, right(t0, 1) AS pnum
FROM x JOIN syslog_lines USING (conn_id, line_no)""",
)
def extractions(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines, framed, parsed and put through the sample program's extractions."""
    p = program()
    parsed = parse(_raw(spark, d), p.schema, p.inputs[0].levels).filter(F.col(MALFORMED).isNull()).drop("record")
    r = run_steps(parsed, p.inputs[0].extractions, p.schema, (), (SOURCE, ORDER)).filter(ALIVE)
    ids = _lines(spark, d).select("line_id", F.col("conn_id").alias(SOURCE), F.col("line_no").alias(ORDER))
    return r.join(ids, [SOURCE, ORDER]).select("line_id", "facility", "level", F.col("time").alias("time_raw"), "host", "app", "pid", "source", "extradata", "log", "class", "task", "vhost", "pnum")


# Predicates, over texts of many kinds

_LOGS = "(SELECT DISTINCT rec_id, coalesce(log, '') AS log FROM custom_fluentd)"
_PREDICATES = {
    "str": ("str", "Keepalive from 192.0.2.3 slot 66", "log = 'Keepalive from 192.0.2.3 slot 66'"),
    "str_eq": ("str-eq", "Still retrying silo upload…", "log = 'Still retrying silo upload…'"),
    "str_not": ("str-not", "Still retrying silo upload…", "log <> 'Still retrying silo upload…'"),
    "str_any": ("str-any", "", "log <> ''"),
    "str_start": ("str-start", "class=Kiln", "starts_with(log, 'class=Kiln')"),
    "str_end": ("str-end", "permission denied", "ends_with(log, 'permission denied')"),
    "str_contain": ("str-contain", "replica", "contains(log, 'replica')"),
    "glob": ("glob", 'P[OU][ST]* "/{north,south}*params=**', """regexp_full_match(log, 'P[OU][ST].* "/(north|south).*params=.*', 's')"""),
    "regex": ("regex", r"^class=\w+ (Started|Finished) .*(removed|job)\b", r"regexp_matches(log, '^class=\w+ (Started|Finished) .*(removed|job)\b')"),
    "len_gt": ("len-gt", "300", "strlen(log) > 300"),
    "len_lt": ("len-lt", "30", "strlen(log) < 30"),
}


def _predicate_query(tag: str, operand: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        logs = spark.read.parquet(f"{d}/custom_fluentd.parquet").select("rec_id", F.coalesce("log", F.lit("")).alias("log"))
        return logs.filter(predicate(tag, operand).column(F.col("log"))).select("rec_id").distinct()

    return run


for _name, (_tag, _operand, _test) in _PREDICATES.items():
    QUERIES[f"match_{_name}"] = _predicate_query(_tag, _operand)
    SQL[f"match_{_name}"] = f"SELECT rec_id FROM {_LOGS} WHERE {_test}"


@query("match_all", f"SELECT rec_id FROM {_LOGS.replace('AS log FROM', 'AS log, level FROM')} WHERE coalesce(level, '') <> 'debug' AND contains(log, 'volume') AND regexp_matches(log, '[0-9]{{3}} after')")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    """Several predicates, cheapest first; a missing level is an empty one."""
    logs = spark.read.parquet(f"{d}/custom_fluentd.parquet").select("rec_id", F.coalesce("log", F.lit("")).alias("log"), F.coalesce("level", F.lit("")).alias("level"))
    m = {"log": predicate("regex", "[0-9]{3} after"), "level": predicate("str-not", "debug")}
    both = match_column(m, F.col) & match_column({"log": predicate("str-contain", "volume")}, F.col)
    return logs.filter(both).select("rec_id").distinct()


# Steps, over the application records


def app_records(spark: SparkSession, d: str) -> DataFrame:
    """The application records, each once, as records of the program."""
    rows = spark.read.parquet(f"{d}/app_records.parquet").distinct().withColumnRenamed("time_raw", "time")
    fields = program().schema.fields
    rows = rows.select(F.lit("app").alias(SOURCE), F.col("app_rec_id").alias(ORDER), *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields])
    return start_records(rows, program().schema, unescaped=F.col("log").contains("\n"), time=F.timestamp_seconds(F.lit(0)))


def steps(text: str, schema: Schema | None = None) -> list[Step]:
    import yaml

    return read_steps(Node(yaml.compose(text, Loader=yaml.SafeLoader), "steps"), schema or program().schema)


_A = f"(SELECT DISTINCT {_APP} FROM app_records)"


def _step_query(name: str, text: str, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = run_steps(app_records(spark, d), steps(text), program().schema, ("app",), (SOURCE, ORDER))
        return r.filter(ALIVE).select(F.col(ORDER).alias("app_rec_id"), *columns)

    QUERIES[name] = run
    SQL[name] = sql


_step_query("step_add_fields", "[{type: addFields, fields: {ddtags: 'a:$app,h:${host[:4]}-${pid[-2:]}', service: '${vhost[1:-3]}', class: '$class'}}]", ["ddtags", "service", "class"],
    f"SELECT app_rec_id, 'a:' || app || ',h:' || left(host, 4) || '-' || right(pid, 2) AS ddtags, CASE WHEN length(vhost) > 4 THEN substr(vhost, 2, length(vhost) - 4) ELSE service END AS service, class FROM {_A}")
_step_query("step_del_fields", "[{type: delFields, keys: [facility, pid]}]", ["facility", "pid", "host"], f"SELECT app_rec_id, '' AS facility, '' AS pid, host FROM {_A}")
_step_query("step_map_value", "[{type: mapValue, key: level, mapping: {error: ERROR, warn: WARNING}, default: OTHER}, {type: mapValue, key: class, mapping: {KilnLoader: kiln}}]", ["level", "class"],
    f"SELECT app_rec_id, CASE level WHEN '' THEN '' WHEN 'error' THEN 'ERROR' WHEN 'warn' THEN 'WARNING' ELSE 'OTHER' END AS level, CASE class WHEN 'KilnLoader' THEN 'kiln' ELSE '' END AS class FROM {_A}")
_step_query("step_extract", r"[{type: extract, key: log, pattern: '(?P<class>\w+) (?P<task>[0-9.]+) (s|segments|rows)\b'}]", ["class", "task"],
    rf"SELECT app_rec_id, CASE WHEN regexp_matches(log, '(\w+) ([0-9.]+) (s|segments|rows)\b') THEN regexp_extract(log, '(\w+) ([0-9.]+) (s|segments|rows)\b', 1) ELSE class END AS class, "
    rf"CASE WHEN regexp_matches(log, '(\w+) ([0-9.]+) (s|segments|rows)\b') THEN regexp_extract(log, '(\w+) ([0-9.]+) (s|segments|rows)\b', 2) ELSE task END AS task FROM {_A}")  # fmt: skip
_step_query("step_extract_head", "[{type: extractHead, key: log, pattern: '[a-zA-Z] ', maxLen: 9, destKey: class}]", ["log", "class"],
    rf"SELECT app_rec_id, CASE WHEN regexp_matches(log, '^[a-zA-Z]{{1,8}} ') THEN substr(log, instr(log, ' ') + 1) ELSE log END AS log, CASE WHEN regexp_matches(log, '^[a-zA-Z]{{1,8}} ') THEN substr(log, 1, instr(log, ' ') - 1) ELSE class END AS class FROM {_A}")
_step_query("step_extract_tail", "[{type: extractTail, key: log, pattern: ' [0-9]', maxLen: 6, destKey: task}]", ["log", "task"],
    rf"SELECT app_rec_id, CASE WHEN regexp_matches(log, ' [0-9]{{1,5}}$') THEN regexp_replace(log, ' [0-9]{{1,5}}$', '') ELSE log END AS log, CASE WHEN regexp_matches(log, ' [0-9]{{1,5}}$') THEN regexp_extract(log, ' ([0-9]{{1,5}})$', 1) ELSE task END AS task FROM {_A}")
_step_query("step_replace", r"[{type: replace, key: log, pattern: '(?P<n>\d+)\.\d+ s', replacement: 'about ${n} s ($$1)'}]", ["log"],
    rf"SELECT app_rec_id, regexp_replace(log, '(\d+)\.\d+ s', 'about \1 s ($1)', 'g') AS log FROM {_A}")
_step_query("step_truncate", "[{type: truncate, key: log, maxLen: 37, suffix: '...'}]", ["log"],
    f"SELECT app_rec_id, CASE WHEN strlen(log) > 40 THEN left(log, CAST(list_max(list_filter(range(0, 38), lambda k: strlen(left(log, CAST(k AS INT))) <= 37)) AS INT)) || '...' ELSE log END AS log FROM {_A}")
_step_query("step_if", "[{type: if, match: {level: error, log: !!str-contain ':'}, then: [{type: addFields, fields: {class: 'bad', level: 'worse'}}, {type: if, match: {level: worse}, then: [{type: delFields, keys: [pid]}]}]}]", ["class", "level", "pid"],
    f"SELECT app_rec_id, CASE WHEN b THEN 'bad' ELSE class END AS class, CASE WHEN b THEN 'worse' ELSE level END AS level, CASE WHEN b THEN '' ELSE pid END AS pid FROM (SELECT *, level = 'error' AND contains(log, ':') AS b FROM {_A})")
_step_query("step_switch", "[{type: switch, cases: [{match: {source: audit.log}, then: [{type: addFields, fields: {class: audit, source: http.log}}]}, {match: {source: http.log}, then: [{type: addFields, fields: {class: web}}]}, {match: {level: !!str-any ''}, then: [{type: addFields, fields: {class: '$level'}}]}]}]", ["class", "source"],
    f"SELECT app_rec_id, CASE WHEN source = 'audit.log' THEN 'audit' WHEN source = 'http.log' THEN 'web' WHEN level <> '' THEN level ELSE class END AS class, CASE WHEN source = 'audit.log' THEN 'http.log' ELSE source END AS source FROM {_A}")
_step_query("step_block", "[{type: block, steps: [{type: addFields, fields: {class: x}}, {type: drop, match: {level: debug}, percentage: 100, metricLabel: debug}]}]", ["class", "level"],
    f"SELECT app_rec_id, 'x' AS class, level FROM {_A} WHERE level <> 'debug'")
_step_query("step_drop", "[{type: drop, match: {source: ui.log, level: !!str-not error}, percentage: 100, metricLabel: ui}]", ["source", "level"], f"SELECT app_rec_id, source, level FROM {_A} WHERE NOT (source = 'ui.log' AND level <> 'error')")
_step_query("step_drop_share", "[{type: drop, match: {level: info}, percentage: 33, metricLabel: sampled}]", ["app", "level"],
    f"""SELECT app_rec_id, app, level FROM (SELECT *, row_number() OVER (PARTITION BY app, level = 'info' ORDER BY app_rec_id) AS n FROM {_A})
WHERE NOT (level = 'info' AND n >= 2 AND (33 * (n - 1) + 99) // 100 > (33 * (n - 2) + 99) // 100)""")  # fmt: skip


@query("step_unescape", r"SELECT dd_id, replace(replace(replace(replace(replace(replace(replace(coalesce(log, ''), '\\', chr(57591)), '\b', chr(8)), '\f', chr(12)), '\n', chr(10)), '\r', chr(13)), '\t', chr(9)), chr(57591), '\') AS log FROM datadog_api")
def step_unescape(spark: SparkSession, d: str) -> DataFrame:
    s = Schema(("log",))
    rows = spark.read.parquet(f"{d}/datadog_api.parquet").select("dd_id", "log")
    return run_steps(start_records(rows, s), steps("[{type: unescape, key: log}]", s), s).select("dd_id", "log")


@query("step_parse_time", rf"""SELECT app_rec_id, CASE WHEN ts IS NULL THEN CAST(0 AS BIGINT) ELSE epoch_us(ts) END AS time_us, time_raw <> '' AND ts IS NULL AS failed FROM (SELECT app_rec_id, time_raw,
CASE WHEN regexp_full_match(time_raw, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:?\d{{2}})?') THEN TRY_CAST(regexp_replace(time_raw, '([+-]\d{{2}})(\d{{2}})$', '\1:\2') AS TIMESTAMPTZ) END AS ts FROM {_A})""")
def step_parse_time(spark: SparkSession, d: str) -> DataFrame:
    r = run_steps(app_records(spark, d), steps("[{type: parseTime, key: time, errorLabel: timeError}]"), program().schema)
    return r.select(F.col(ORDER).alias("app_rec_id"), F.unix_micros(TIME).alias("time_us"), F.array_contains(LABELS, "timeError").alias("failed"))


# E-mail addresses for an engine without look-around: every character that can't be in one stands between marks, so that each address can take a mark on both sides.
_WORD, _RUN, _END = "[A-Za-z0-9_-]*", "[A-Za-z0-9._-]*", r"(\\x01|$)".replace("\\\\", "\\")
_DOMAIN = "(?:" + "|".join([
    rf"[A-Za-z]{_WORD}\.[A-Za-z0-9]{_RUN}", rf"[A-Za-z]{_WORD}\.?$", rf"[0-9]{_WORD}\.(?:[A-Za-z]|[A-Za-z0-9]{_RUN}[A-Za-z._-])", rf"[0-9]{_WORD}\.$", "[0-9]$", rf"[0-9](?:{_WORD}[A-Za-z_-])$",
]) + ")"


def _redacted(column: str) -> str:
    """SQL of a text with its e-mail addresses replaced."""
    sql = rf"regexp_replace({column}, '([^A-Za-z0-9._-])', chr(1) || '\1' || chr(1), 'g')"
    sql = rf"regexp_replace({sql}, '(^|[^/]\x01){_RUN}[A-Za-z0-9]\x01@\x01{_DOMAIN}{_END}', '\1REDACTED\2', 'g')"
    for _ in range(4):  # an address may follow at once, without a local part of its own
        sql = rf"regexp_replace({sql}, 'REDACTED\x01@\x01{_DOMAIN}{_END}', 'REDACTEDREDACTED\1', 'g')"
    return f"replace({sql}, chr(1), '')"


@query("step_redact_email", f"SELECT DISTINCT rec_id, {_redacted('log')} AS log FROM custom_fluentd")
def step_redact_email(spark: SparkSession, d: str) -> DataFrame:
    """Every record, once, with its e-mail addresses redacted."""
    logs = spark.read.parquet(f"{d}/custom_fluentd.parquet").select("rec_id", "log").dropDuplicates(["rec_id"])
    return logs.select("rec_id", redact_email(F.col("log")).alias("log"))


# The whole program


def _run(spark: SparkSession, d: str) -> pipeline.Result:
    return pipeline.transform(program(), app_records(spark, d))


def _staged(base: str, order: str) -> str:
    """CTEs that end in x: records with their case of the switch (cs), what became of them, and their times. `base` ends in a CTE a."""
    return base + rf""",
k AS (SELECT *, strlen(facility) + strlen(level) + strlen(time_raw) + strlen(host) + strlen(app) + strlen(pid) + strlen(source) + strlen(extradata) + strlen(log) + strlen(class) + strlen(task) + strlen(vhost) + strlen(pnum) + strlen(ddsource) + strlen(ddtags) + strlen(hostname) + strlen(service) AS n_bytes,
 CASE WHEN ends_with(source, 'mail.log') OR source = 'sync.log' THEN 1 WHEN source = 'audit.log' AND level <> 'warn' THEN 2 WHEN source = 'http.log' AND regexp_full_match(log, 'P[OU][ST].* "/.*params=.*', 's') THEN 3 WHEN strlen(log) > 60 AND task = '' THEN 4 ELSE 0 END AS cs FROM a),
s AS (SELECT *, cs = 2 AND regexp_matches(log, '^Session\b') AS gone1, cs = 2 AND NOT regexp_matches(log, '^Session\b') AND contains(log, 'rejected') AS m2, CASE WHEN cs = 1 THEN {_redacted('log')} ELSE log END AS masked FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY app, level, m2 ORDER BY {order}) AS nth FROM s),
x AS (SELECT *, m2 AND nth >= 2 AND (33 * (nth - 1) + 99) // 100 > (33 * (nth - 2) + 99) // 100 AS gone2,
 CASE WHEN regexp_full_match(time_raw, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:?\d{{2}})?') THEN TRY_CAST(regexp_replace(time_raw, '([+-]\d{{2}})(\d{{2}})$', '\1:\2') AS TIMESTAMPTZ) END AS ts FROM r)
"""


_STAGED = _staged(f"WITH a AS (SELECT DISTINCT {_APP} FROM app_records)", "app_rec_id")


@query("process_counters", _STAGED + """SELECT app AS key_app, level AS key_level, vhost AS key_vhost, source AS key_source, count(*) FILTER (NOT (gone1 OR gone2)) AS passed_count, CAST(coalesce(sum(n_bytes) FILTER (NOT (gone1 OR gone2)), 0) AS BIGINT) AS passed_bytes,
 count(*) FILTER (gone1 OR gone2) AS dropped_count, CAST(coalesce(sum(n_bytes) FILTER (gone1 OR gone2), 0) AS BIGINT) AS dropped_bytes FROM x GROUP BY app, level, vhost, source""")
def process_counters(spark: SparkSession, d: str) -> DataFrame:
    """Passed and dropped records and bytes by key set."""
    return _run(spark, d).process_counts()


@query("label_counters", _STAGED + """, lab AS (SELECT *, 'chatter' AS label FROM x WHERE gone1 UNION ALL SELECT *, 'thinned' FROM x WHERE gone2 UNION ALL SELECT *, '!thinned' FROM x WHERE m2 AND NOT gone2
 UNION ALL SELECT *, 'bad-time' FROM x WHERE ts IS NULL AND time_raw <> '' UNION ALL SELECT *, 'masked' FROM x WHERE masked <> log)
SELECT label, app AS key_app, level AS key_level, vhost AS key_vhost, source AS key_source, count(*) AS labelled_count, CAST(sum(n_bytes) AS BIGINT) AS labelled_bytes FROM lab GROUP BY label, app, level, vhost, source""")
def label_counters(spark: SparkSession, d: str) -> DataFrame:
    """Labelled records by key set."""
    return _run(spark, d).label_counts()


@query("key_sets", f"SELECT app, level, 'mill.' || app AS tag, count(*) AS n FROM {_A} GROUP BY app, level")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Pipelines by key set, with their tags."""
    r = _run(spark, d).records
    return r.groupBy(F.col(key_name("app")).alias("app"), F.col(key_name("level")).alias("level"), F.col(pipeline.TAG).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


_UNESCAPED = r"CASE WHEN contains(log, chr(10)) THEN lo ELSE replace(replace(replace(replace(replace(replace(replace(lo, '\\', chr(57591)), '\b', chr(8)), '\f', chr(12)), '\n', chr(10)), '\r', chr(13)), '\t', chr(9)), chr(57591), '\') END"


def _events(staged: str, columns: str) -> str:
    """CTEs that end in `forward_out` and `api_out`: the events of both outputs, with `columns` to tell them by."""
    return staged + rf""", p AS (SELECT *, CASE cs WHEN 1 THEN masked WHEN 3 THEN CASE WHEN strlen(log) > 76 THEN left(log, CAST(list_max(list_filter(range(0, 61), lambda i: strlen(left(log, CAST(i AS INT))) <= 60)) AS INT)) || ' (rest left out)' ELSE log END
 WHEN 4 THEN regexp_replace(log, '([0-9a-f]{{8}})-[0-9a-f-]+', '\1-...', 'g') ELSE log END AS lo,
 CASE WHEN level = '' THEN '' WHEN level IN ('fatal', 'crit') THEN 'high' WHEN level = 'error' THEN 'error' WHEN level = 'warn' THEN 'warning' WHEN level IN ('notice', 'info') THEN 'plain' ELSE 'low' END AS le FROM x WHERE NOT gone1 AND NOT gone2),
forward_out AS (SELECT {columns}, 'mill.' || app AS tag, coalesce(epoch_us(ts), 0) AS time_us, nullif(facility, '') AS facility, nullif(pid, '') AS pid, nullif(extradata, '') AS extradata, nullif(le, '') AS level, nullif(CASE WHEN log <> '' AND class <> '' THEN 'class=' || class || ' ' ELSE '' END || {_UNESCAPED}, '') AS log, app AS env_app, host AS env_host, source AS env_source, vhost AS env_vhost FROM p),
api_out AS (SELECT {columns}, 'mill.' || app AS tag, nullif(facility, '') AS facility, nullif(pid, '') AS pid, nullif(extradata, '') AS extradata, 'shopfloor' AS ddsource, CASE WHEN ddtags <> '' THEN ddtags ELSE 'mill.' || app END AS ddtags, nullif(CASE WHEN host <> '' THEN host ELSE hostname END, '') AS hostname, nullif(le, '') AS level, nullif(lo, '') AS log,
 nullif(CASE WHEN vhost <> '' THEN vhost ELSE service END, '') AS service, CAST(coalesce(epoch_us(ts), 0) // 1000 AS VARCHAR) AS timestamp FROM p)
"""


_EVENTS = _events(_STAGED, "app_rec_id")
_FORWARD = ("facility", "pid", "extradata", "level", "log")
_API = ("ddsource", "ddtags", "extradata", "facility", "hostname", "level", "log", "pid", "service", "timestamp")


@query("forward_events", _EVENTS + "SELECT * FROM forward_out")
def forward_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the forward output as columns."""
    p, r = program(), _run(spark, d)
    e = event_columns(r.passed(), p.schema, p.outputs[0])
    env = [F.col(f"environment.{f}").alias(f"env_{f}") for f in ("app", "host", "source", "vhost")]
    return e.select(F.col(ORDER).alias("app_rec_id"), "tag", F.unix_micros("event_ts").alias("time_us"), *_FORWARD, *env)


@query("api_events", _EVENTS + f"SELECT app_rec_id, {', '.join(_API)} FROM api_out")
def api_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the API output as columns."""
    p, r = program(), _run(spark, d)
    return event_columns(r.passed(), p.schema, p.outputs[1]).select(F.col(ORDER).alias("app_rec_id"), *_API)


def _chunks(r: pipeline.Result, index: int) -> DataFrame:
    o = r.program.outputs[index]
    return chunks.pack(r.events(o), o)


def _text_bytes(v: str) -> str:
    """SQL of the bytes of a text in MessagePack."""
    return f"(strlen({v}) + CASE WHEN strlen({v}) < 32 THEN 1 WHEN strlen({v}) < 256 THEN 2 WHEN strlen({v}) < 65536 THEN 3 ELSE 5 END)"


_ENVIRONMENT = ("app", "host", "source", "vhost")
# An array of two, a time of ten bytes, a map of fields and in it the environment, whole.
_FORWARD_BYTES = "1 + 10 + 1 + 12 + 1 + " + " + ".join([
    *[f"coalesce({len(f) + 1} + {_text_bytes(f)}, 0)" for f in _FORWARD], *[f"{len(f) + 1} + {_text_bytes('env_' + f)}" for f in _ENVIRONMENT],
])
_API_BYTES = "1 + " + " + ".join(f"coalesce(strlen(CAST(to_json({f}) AS VARCHAR)) + {len(f) + 4}, 0)" for f in _API)


@query("forward_bytes", _EVENTS + f"SELECT app_rec_id, CAST({_FORWARD_BYTES} AS INT) AS n_bytes FROM forward_out")
def forward_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each event of the forward output as it is serialized."""
    r = _run(spark, d)
    return r.events(r.program.outputs[0]).select(F.col(ORDER).alias("app_rec_id"), F.octet_length("data").alias("n_bytes"))


@query("forward_chunks", _EVENTS + "SELECT tag, count(*) AS n_records, TRUE AS whole FROM forward_out GROUP BY tag")
def forward_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Per tag the records its chunks hold, as they are read back, and whether they are as many as the chunks say."""
    return _read_back(_chunks(_run(spark, d), 0), "fluentdForward")


@query("api_chunks", _EVENTS + "SELECT tag, count(*) AS n_records, TRUE AS whole FROM api_out GROUP BY tag")
def api_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same of the API output."""
    return _read_back(_chunks(_run(spark, d), 1), "datadog")


def _read_back(packed: DataFrame, kind: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"tag": f["tag"], "says": f["n_records"], "holds": [len(chunks.decode(kind, bytes(x))) for x in f["data"]]})

    got = packed.select("tag", "n_records", "data").mapInPandas(run, "tag string, says bigint, holds bigint")
    return got.groupBy("tag").agg(F.sum("holds").alias("n_records"), F.every(F.col("says") == F.col("holds")).alias("whole"))


@query("output_counters", _EVENTS + f"""SELECT 'archive' AS output, count(*) AS records, CAST(sum({_FORWARD_BYTES}) AS BIGINT) AS serialized_bytes FROM forward_out
UNION ALL SELECT 'search', count(*), CAST(sum({_API_BYTES}) AS BIGINT) FROM api_out""")
def output_counters(spark: SparkSession, d: str) -> DataFrame:
    """Serialized records and bytes of both outputs."""
    r = _run(spark, d)
    parts = [serialize(r.passed(), r.program.schema, o).select(F.lit(o.name).alias("output"), "data") for o in r.program.outputs]
    return serialized_counts(parts[0].unionByName(parts[1]))


@query("chunk_counters")
def chunk_counters(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and their bytes, of both outputs. Without SQL: it has no gzip."""
    r = _run(spark, d)
    parts = [_chunks(r, i).select("output", "data") for i in range(2)]
    return chunk_counts(parts[0].unionByName(parts[1]))


@query("rewriters", rf"""SELECT app_rec_id, nullif(log, '') AS copied, CASE WHEN log = '' THEN NULL ELSE CASE WHEN class <> '' THEN 'class=' || class || ' ' ELSE '' END || CASE WHEN level <> '' THEN 'level=' || level || ' ' ELSE '' END || log END AS inlined,
 nullif({_UNESCAPED.replace('lo ', 'log ').replace('(lo,', '(log,')}, '') AS unescaped FROM {_A}""")
def rewriters(spark: SparkSession, d: str) -> DataFrame:
    """A field copied, with others put before it, and with its escapes decoded."""
    chains = {"copied": [Rewrite("copy")], "inlined": [Rewrite("inline", "class"), Rewrite("inline", "level"), Rewrite("copy")], "unescaped": [Rewrite("unescape")]}
    out = {name: rewritten("log", chain) for name, chain in chains.items()}
    return app_records(spark, d).select(F.col(ORDER).alias("app_rec_id"), *[F.when(F.octet_length(v) > 0, v).alias(n) for n, v in out.items()])


# Two lines that start a record don't follow each other in one connection here, so records by connection are one per starting line.
_FROM_LINES = _staged(
    _PARSED
    + r""", e AS (SELECT *, regexp_matches(log, '^\[.*?\] - ') AND starts_with(log, '[') AND strlen(split_part(substr(log, 2), '] - ', 1)) + 4 <= 100 AS has_class,
 regexp_matches(source, ':[0-9a-f-]*$') AND strlen(regexp_extract(source, ':([0-9a-f-]*)$', 1)) + 1 <= 41 AS has_task, contains(app, '/') AND strlen(regexp_extract(app, '/([^/]*)$', 1)) + 1 <= 100 AS has_vhost FROM parsed),
y AS (SELECT *, CASE WHEN has_class THEN trim(split_part(substr(log, 2), '] - ', 1)) ELSE '' END AS cls, CASE WHEN has_task THEN regexp_extract(source, ':([0-9a-f-]*)$', 1) ELSE '' END AS t0 FROM e),
a AS (SELECT conn_id, line_no, '' AS facility, level, time AS time_raw, host, CASE WHEN has_vhost THEN regexp_replace(app, '/[^/]*$', '') ELSE app END AS app, '' AS pid, CASE WHEN has_task THEN regexp_replace(source, ':[0-9a-f-]*$', '') ELSE source END AS source, '' AS extradata,
 CASE WHEN has_class THEN substr(log, instr(log, '] - ') + 4) ELSE log END AS log, cls AS class, CASE WHEN cls <> '' AND t0 <> '' THEN t0 || ':' || cls ELSE t0 END AS task, CASE WHEN has_vhost THEN regexp_extract(app, '/([^/]*)$', 1) ELSE '' END AS vhost, right(t0, 1) AS pnum,
 '' AS ddsource, '' AS ddtags, '' AS hostname, '' AS service FROM y)""",
    "conn_id, line_no",
)


@query("program_from_lines", _events(_FROM_LINES, "conn_id, line_no, ts") + f"SELECT conn_id, line_no, tag, {', '.join(_API[:-1])}, CASE WHEN ts IS NULL THEN NULL ELSE timestamp END AS timestamp FROM api_out")
def program_from_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines to the events of the API output: framing, parsing, the whole program. Records without a time of their own have that of their arrival, here null."""
    p = program()
    r = pipeline.run(p, _raw(spark, d))
    e = event_columns(r.passed().withColumn(TIME, F.when(F.array_contains(LABELS, "bad-time") | (F.col(TIME) > F.current_timestamp() - F.expr("INTERVAL 1 DAY")), None).otherwise(F.col(TIME))), p.schema, p.outputs[1])
    return e.select(F.col(SOURCE).alias("conn_id"), F.col(ORDER).alias("line_no"), "tag", *_API)


@query("two_inputs", _PARSED + f""", both_inputs AS (SELECT 'first' AS input, conn_id, line_no, level, log FROM parsed UNION ALL SELECT 'second', conn_id, line_no, list_extract(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], list_position({list(LOG_LEVELS)}, level)), log FROM parsed)
SELECT input, conn_id, line_no, level, log FROM both_inputs""")
def two_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Two inputs with levels and extractions of their own that feed one orchestration."""
    p = program()
    kept = steps("[{type: delFields, keys: [pid]}]")
    inputs = [replace(p.inputs[0], extractions=kept), replace(p.inputs[0], levels=tuple("abcdefgh"), extractions=kept)]
    raw = _raw(spark, d)
    by_input = [raw.withColumn(SOURCE, F.concat(F.lit(n), SOURCE)) for n in ("first:", "second:")]
    r = pipeline.run(replace(p, inputs=inputs, transformations=[]), by_input)
    return r.passed().select(F.split(SOURCE, ":", 2)[0].alias("input"), F.split(SOURCE, ":", 2)[1].alias("conn_id"), F.col(ORDER).alias("line_no"), "level", "log")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines to the events of the API output: framing, parsing, the whole program, serialization."""
    p = program()
    r = pipeline.run(p, _raw(spark, d))
    return event_json(r.passed(), p.schema, p.outputs[1]).select(F.col(SOURCE).alias("conn_id"), F.col(ORDER).alias("line_no"), "tag", "json")


@query("single_pipeline", f"SELECT 'all' AS tag, count(*) AS n FROM {_A}")
def single_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The same program with one pipeline for all records."""
    from millrace.config import Orchestration

    p = replace(program(), orchestration=Orchestration("singleton", (), "all"))
    r = pipeline.transform(p, app_records(spark, d))
    return r.records.groupBy(F.col(pipeline.TAG).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["QUERIES", "SQL", "Column", "flagship"]
