"""Chunks on their way out: a table of those written and one of those acknowledged, per output.

A chunk is written before it is sent and acknowledged after; what lies between, after a failure, is sent again. Delivery is at least once.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = "output string, tag string, chunk_id string, n_records bigint, n_bytes bigint, data binary"


def folder_name(name: str) -> str:
    """A folder for any name: its safe characters and the last 8 of its MD5."""
    return f"{re.sub(r'[^A-Za-z0-9._-]', '_', name)}.{hashlib.md5(name.encode()).hexdigest()[-8:]}"


@dataclass(frozen=True)
class Put:
    """What became of the chunks of a batch: put into the outbox, or lost to a full one."""

    chunks: int
    bytes: int
    dropped_chunks: int
    dropped_bytes: int


class Outbox:
    def __init__(self, spark: SparkSession, root: str, name: str, max_bytes: int | None = None) -> None:
        self.spark, self.root, self.max_bytes = spark, f"{root.rstrip('/')}/{folder_name(name)}", max_bytes

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def put(self, chunks: DataFrame, batch: int) -> Put:
        """Writes the chunks of a batch, as many as there is room for, the first ones first: what is newest is lost.

        A batch is written once. One that runs again, after a failure, finds its chunks and leaves them as they are: some may have been sent
        and acknowledged under their identifiers, which thus never stand for anything else. A try that didn't finish leaves no mark of success and is written over.
        """
        path = f"{self.root}/chunks/batch={batch:019d}"
        if self._exists(f"{path}/_SUCCESS"):
            return Put(0, 0, 0, 0)
        room = None if self.max_bytes is None else max(0, self.max_bytes - self.size())
        chunks.write.mode("overwrite").parquet(path if room is None else f"{path}.full")
        if room is None:
            n, size = self._totals(path)
            return Put(n, size, 0, 0)
        whole = f"{path}.full"
        n, size = self._totals(whole)
        made = self.spark.read.schema(CHUNKS).parquet(whole)
        if size > room:
            # Identifiers and sizes of one batch; a chunk has up to some megabytes, so they are few. Running sums by stretches of identifiers, then inside them.
            by = made.select("chunk_id", "n_bytes", F.substring("chunk_id", 21, 2).alias("_mr_part"))
            sums = by.groupBy("_mr_part").agg(F.sum("n_bytes").alias("_mr_sum"))
            before = Window.partitionBy(F.lit(0)).orderBy("_mr_part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
            sums = sums.select("_mr_part", F.coalesce(F.sum("_mr_sum").over(before), F.lit(0)).alias("_mr_before"))
            upto = by.join(F.broadcast(sums), "_mr_part").withColumn("_mr_upto", F.col("_mr_before") + F.sum("n_bytes").over(Window.partitionBy("_mr_part").orderBy("chunk_id")))
            made = made.join(upto.filter(F.col("_mr_upto") <= room).select("chunk_id"), "chunk_id", "left_semi").select(*made.columns)
        made.write.mode("overwrite").parquet(path)
        self._delete(whole)
        kept, kept_bytes = self._totals(path)
        return Put(kept, kept_bytes, n - kept, size - kept_bytes)

    def _totals(self, path: str) -> tuple[int, int]:
        """Chunks and bytes of a table of chunks; the chunks themselves aren't read."""
        return tuple(self.spark.read.schema(CHUNKS).parquet(path).agg(F.count("chunk_id"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first())

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _batches(self, kind: str) -> list[tuple[int, str]]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [e.getPath().getName() for e in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(n[6:]), f"{self.root}/{kind}/{n}") for n in names if n.startswith("batch=") and n[6:].isdigit())

    def _table(self, kind: str, schema: str) -> DataFrame:
        paths = [p for _, p in self._batches(kind)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def written(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    def acknowledge(self, ids: DataFrame, batch: int) -> None:
        ids.select("chunk_id").write.mode("append").parquet(f"{self.root}/acknowledged/batch={batch:019d}")

    def acknowledged(self) -> DataFrame:
        return self._table("acknowledged", "chunk_id string")

    def pending_ids(self) -> DataFrame:
        """(chunk_id, n_records, n_bytes) of chunks that were written and not acknowledged. Empty chunks are corrupt and left out."""
        return self.written().filter("n_bytes > 0").select("chunk_id", "n_records", "n_bytes").join(self.acknowledged().distinct(), "chunk_id", "left_anti")

    def pending(self) -> DataFrame:
        """Those chunks. A batch is written once, so that no identifier occurs twice."""
        return self.written().filter("n_bytes > 0").join(self.acknowledged().distinct(), "chunk_id", "left_anti").select("output", "tag", "chunk_id", "n_records", "n_bytes", "data")

    def waiting(self) -> tuple[int, int]:
        """Chunks and bytes that wait."""
        return tuple(self.pending_ids().agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first())

    def compact(self, batch: int) -> None:
        """Removes what batches before `batch` left, once nothing waits: the outbox is as large as what wasn't acknowledged yet, and no larger."""
        if self.waiting()[0]:
            return
        for kind in ("chunks", "acknowledged"):
            for number, path in self._batches(kind):
                if number < batch:
                    self._delete(path)

    def size(self) -> int:
        """Bytes that wait."""
        return self.waiting()[1]
