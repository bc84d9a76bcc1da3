"""Sinks for tests and inspection: a file per chunk, and the records of chunks as lines of JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.config import Output
from millrace.session import ship
from millrace.sinks import chunks as C


def save_chunks(chunks: DataFrame, folder: str) -> int:
    """Writes each chunk to a file under its identifier, in a folder that driver and tasks share, and returns how many.

    A file appears whole or not at all, and a chunk written again takes its own place, so that a task may run twice.
    """
    ship(chunks.sparkSession)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = f"{folder}/.{i}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(d)
                os.replace(part, f"{folder}/{i}")
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["chunk_id"])

    return chunks.select("chunk_id", "data").mapInArrow(run, "chunk_id string").distinct().count()


def chunk_lines(chunks: DataFrame, output: Output) -> DataFrame:
    """(chunk_id, place, json): the records of chunks, read back; [tag, seconds, fields] of the forward output, objects of the API output."""
    ship(chunks.sparkSession)
    kind = output.type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in C.decode(kind, d)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["chunk_id", "place", "json"])

    return chunks.select("chunk_id", "data").mapInArrow(run, "chunk_id string, place bigint, json string")
