"""Chunks: serialized events packed greedily up to a limit, compressed and wrapped as an output's endpoint takes them."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import Output
from millrace.schema import ORDER, SOURCE
from millrace.session import ship
from millrace.sinks import msgpack


@dataclass(frozen=True)
class Limits:
    """Bytes before compression and, where there is one, records of a chunk; bytes a chunk has from the start, and besides each record."""

    max_bytes: int
    max_records: int | None
    first: int
    each: int
    suffix: str


# Limits of the endpoints.
LIMITS = {"fluentdForward": Limits(7 << 20, None, 0, 0, ".ff"), "datadog": Limits(5 << 20, 1000, 1, 1, ".dd")}


def groups(sizes: list[int], limits: Limits) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of records that share a chunk. A record that would exceed a limit opens the next chunk; one larger than the limit goes alone."""
    start, size = 0, limits.first
    for i, n in enumerate(sizes):
        full = limits.max_records is not None and i - start >= limits.max_records
        if i > start and (full or size + n + limits.each > limits.max_bytes):
            yield start, i
            start, size = i, limits.first
        size += n + limits.each
    if start < len(sizes):
        yield start, len(sizes)


def build(kind: str, mode: str, tag: str, chunk_id: str, records: list[bytes]) -> bytes:
    """The bytes of one chunk."""
    if kind == "datadog":
        return gzip.compress(b"[" + b",".join(records) + b"]", 1, mtime=0)
    body = b"".join(records)
    option = {"size": len(records), "chunk": chunk_id}
    if mode == "Forward":
        return msgpack.array(3) + msgpack.text(tag) + msgpack.array(len(records)) + body + msgpack.pack(option)
    if mode == "CompressedPackedForward":
        body = gzip.compress(body, 1, mtime=0)
        option["compressed"] = "gzip"
    return msgpack.array(3) + msgpack.text(tag) + msgpack.binary(body) + msgpack.pack(option)


def chunk_id(batch: int, group: int, n: int, suffix: str) -> str:
    """Sorts by batch, then by group and place in it."""
    return f"{batch:019d}-{group & 0xFFFFFFFFFFFFFFFF:016x}{n:08d}{suffix}"


#: Bytes of a tag that are packed in one place, about, and lines of a source that stay together.
GROUP_BYTES, GROUP_LINES = 64 << 20, 50_000


def pack(events: DataFrame, output: Output, *, batch: int = 0, ordered: bool = True) -> DataFrame:
    """(output, tag, chunk_id, n_records, n_bytes, data) from (source, order, tag, data).

    A tag with many bytes is packed in several groups, by a hash of source and stretch of its lines, so that a tag with most records makes no long task. Records of a group
    come in order of (source, order). Which group a record is in, and so every chunk and its identifier, depends on the records of the batch alone, not on how they are
    spread over tasks. Null tags form one tag. Without ``ordered`` nothing is shuffled: each part packs what it has, tag by tag, in the order it comes, and only the outbox keeps
    what a batch made once from changing.
    """
    ship(events.sparkSession)
    if not ordered:
        return _pack_in_place(events, output, batch)
    limits, kind, mode, name = LIMITS[output.type], output.type, output.message_mode, output.name
    tag = F.coalesce("tag", F.lit("")).alias("tag")
    rows = events.select(tag, SOURCE, ORDER, "data", F.xxhash64(SOURCE, F.floor(F.col(ORDER) / GROUP_LINES)).alias("_mr_spread"))
    sizes = rows.groupBy("tag").agg((F.floor(F.sum(F.octet_length("data")) / GROUP_BYTES) + 1).alias("_mr_groups"))
    rows = rows.join(sizes, "tag").withColumn("_mr_group", F.xxhash64("tag", F.pmod("_mr_spread", "_mr_groups"))).drop("_mr_spread", "_mr_groups")
    rows = rows.repartition("_mr_group").sortWithinPartitions("_mr_group", "tag", SOURCE, ORDER)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        at: tuple[int, str] | None = None
        held: list[bytes] = []

        def flush(last: bool) -> Iterator[dict]:
            nonlocal n, held
            cuts = list(groups([len(x) for x in held], limits))
            keep = [] if last or not cuts else cuts[-1:]
            for a, b in cuts[: len(cuts) - len(keep)]:
                c = chunk_id(batch, at[0], n, limits.suffix)
                n += 1
                data = build(kind, mode, at[1], c, held[a:b])
                yield {"output": name, "tag": at[1], "chunk_id": c, "n_records": b - a, "n_bytes": len(data), "data": data}
            held = held[keep[0][0] :] if keep else []

        for f in frames:
            out: list[dict] = []
            for g, t, d in zip(f["_mr_group"].tolist(), f["tag"].tolist(), f["data"].tolist()):
                if (g, t) != at:
                    out += flush(True)
                    if at is None or at[0] != g:
                        n = 0
                    at = (g, t)
                held.append(bytes(d))
            out += flush(False)
            if out:
                yield pd.DataFrame(out)
        out = list(flush(True))
        if out:
            yield pd.DataFrame(out)

    return rows.select("_mr_group", "tag", "data").mapInPandas(run, SCHEMA)


SCHEMA = "output string, tag string, chunk_id string, n_records bigint, n_bytes bigint, data binary"
#: Bytes of all tags together that a part holds before it closes its largest open chunk.
HELD_BYTES = 64 << 20


def _pack_in_place(events: DataFrame, output: Output, batch: int) -> DataFrame:
    limits, kind, mode, name = LIMITS[output.type], output.type, output.message_mode, output.name

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        held: dict[str, tuple[list[bytes], int]] = {}

        def close(tag: str) -> dict:
            nonlocal n, total
            records, size = held.pop(tag)
            total -= size
            c = chunk_id(batch, part, n, limits.suffix)
            n += 1
            data = build(kind, mode, tag, c, records)
            return {"output": name, "tag": tag, "chunk_id": c, "n_records": len(records), "n_bytes": len(data), "data": data}

        for f in frames:
            out: list[dict] = []
            for tag, data in zip(f["tag"].tolist(), f["data"].tolist()):
                records, size = held.get(tag, ([], limits.first))
                if records and ((limits.max_records is not None and len(records) >= limits.max_records) or size + len(data) + limits.each > limits.max_bytes):
                    out.append(close(tag))
                    records, size = [], limits.first
                if not records:
                    total += size
                records.append(bytes(data))
                grown = size + len(data) + limits.each
                total += grown - size
                held[tag] = (records, grown)
                if total > HELD_BYTES:
                    out.append(close(max(held, key=lambda t: (held[t][1], t))))
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([close(t) for t in sorted(held)])

    return events.select(F.coalesce("tag", F.lit("")).alias("tag"), "data").mapInPandas(run, SCHEMA)


def decode(kind: str, data: bytes) -> list:
    """The records of a chunk: [tag, time, fields] of the forward output, objects of the API output."""
    if kind == "datadog":
        return json.loads(gzip.decompress(data))
    (tag, entries, option), end = msgpack.unpack(data)
    if end != len(data):
        raise ValueError("bytes after the chunk")
    if isinstance(entries, bytes):
        body = gzip.decompress(entries) if option.get("compressed") == "gzip" else entries
        out, at = [], 0
        while at < len(body):
            v, at = msgpack.unpack(body, at)
            out.append(v)
        entries = out
    if option["size"] != len(entries):
        raise ValueError(f"{len(entries)} records, not {option['size']}")
    return [[tag, *e] for e in entries]
