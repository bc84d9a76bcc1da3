"""Records as the events of an output: what each field becomes, and its bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import Output
from millrace.operators.rewriters import rewritten
from millrace.plans.pipeline import TAG
from millrace.schema import ORDER, SOURCE, TIME, Schema
from millrace.sinks import msgpack


def visible(schema: Schema, o: Output) -> list[str]:
    """Fields on the top level of an event."""
    return [f for f in schema.fields if f not in o.hidden and f not in o.environment]


def _values(schema: Schema, o: Output) -> dict[str, Column]:
    return {f: rewritten(f, o.rewrites.get(f, [])) for f in visible(schema, o)}


def event_columns(records: DataFrame, schema: Schema, o: Output) -> DataFrame:
    """Events as columns: source, order, tag, event_ts, one column per visible field (null where missing), and for the forward output `environment` (every field of it, even where empty)."""
    shown = {f: F.when(F.octet_length(v) > 0, v).alias(f) for f, v in _values(schema, o).items()}
    extra: list[Column] = []
    if o.type == "fluentdForward":
        extra = [F.struct(*[F.col(f"`{f}`").alias(f) for f in sorted(o.environment)]).alias("environment")]
    elif "ddtags" in shown:
        # A record without tags of its own gets the pipeline's.
        shown["ddtags"] = F.coalesce(F.when(F.octet_length("ddtags") > 0, F.col("ddtags")), F.col(TAG)).alias("ddtags")
    elif o.type == "datadog":
        shown["ddtags"] = F.col(TAG).alias("ddtags")
    if o.type == "datadog":
        extra = [F.unix_millis(TIME).cast("string").alias("timestamp")]
    return records.select(SOURCE, ORDER, F.col(TAG).alias("tag"), F.col(TIME).alias("event_ts"), *shown.values(), *extra)


def event_json(records: DataFrame, schema: Schema, o: Output) -> DataFrame:
    """(source, order, tag, json): a flat object with sorted keys for the API output; [tag, seconds, fields] for the forward output."""
    e = event_columns(records, schema, o)
    fields = sorted(c for c in e.columns if c not in (SOURCE, ORDER, "tag", "event_ts"))
    body = F.to_json(F.struct(*[F.col(f"`{f}`") for f in fields]))
    if o.type == "datadog":
        return e.select(SOURCE, ORDER, "tag", body.alias("json"))
    seconds = F.format_string("%d.%06d", F.floor(F.unix_micros("event_ts") / 1_000_000).cast("bigint"), F.pmod(F.unix_micros("event_ts"), F.lit(1_000_000)))
    return e.select(SOURCE, ORDER, "tag", F.concat(F.lit("["), F.to_json(F.array("tag")).substr(F.lit(2), F.length(F.to_json(F.array("tag"))) - 2), F.lit(","), seconds, F.lit(","), body, F.lit("]")).alias("json"))


def serialize(records: DataFrame, schema: Schema, o: Output) -> DataFrame:
    """(source, order, tag, data): the bytes of each event, ready to be put into chunks."""
    if o.type == "datadog":
        return event_json(records, schema, o).select(SOURCE, ORDER, "tag", F.col("json").cast("binary").alias("data"))
    e = event_columns(records, schema, o)
    names = visible(schema, o)
    env = sorted(o.environment)
    us = F.unix_micros("event_ts")
    parts = [F.lit(b"\x92\xd7\x00"), _big_endian(F.floor(us / 1_000_000).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), 4), _big_endian(F.pmod(us, F.lit(1_000_000)) * 1000, 4)]
    # A map of the fields that have a value, and the environment, whole.
    present = sum((F.when(F.octet_length(F.col(f"`{f}`")) > 0, 1).otherwise(0) for f in names), F.lit(1))
    parts.append(F.unhex(F.lpad(F.hex(present + 0x80), 2, "0")) if len(names) < 15 else F.concat(F.lit(b"\xde"), _big_endian(present, 2)))
    for f in names:
        v = F.col(f"`{f}`")
        parts.append(F.when(F.octet_length(v) > 0, F.concat(F.lit(msgpack.text(f)), _text(v))).otherwise(F.lit(b"")))
    parts.append(F.lit(msgpack.text("environment") + msgpack.mapping(len(env))))
    for f in env:
        parts += [F.lit(msgpack.text(f)), _text(F.coalesce(F.col("environment")[f], F.lit("")))]
    return e.select(SOURCE, ORDER, "tag", F.concat(*parts).alias("data"))


def _big_endian(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * size, "0"))


def _text(v: Column) -> Column:
    """A text in MessagePack: its length in as few bytes as it takes, and its bytes."""
    n = F.octet_length(v)
    head = F.when(n < 32, _big_endian(n + 0xA0, 1)).when(n < 1 << 8, F.concat(F.lit(b"\xd9"), _big_endian(n, 1))).when(n < 1 << 16, F.concat(F.lit(b"\xda"), _big_endian(n, 2))).otherwise(F.concat(F.lit(b"\xdb"), _big_endian(n, 4)))
    return F.concat(head, v.cast("binary"))
