"""A program as a streaming query: framing, the program, chunks into the outbox of each output, delivery, counters."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import Program, Step, check_reload
from millrace.operators.keysets import key_name
from millrace.plans import pipeline
from millrace.sinks import chunks
from millrace.sinks.delivery import Connection, deliver, max_duration, opener
from millrace.sinks.outbox import Outbox, Put
from millrace.streaming.sampling import SamplingState


def sampling_lines(steps: list[Step]) -> list[int]:
    """Lines of the steps that sample."""
    out = []
    for s in steps:
        if s.type == "drop" and s.options["percentage"] < 100:
            out.append(s.line)
        out += sampling_lines(s.steps)
        for _, inner in s.cases:
            out += sampling_lines(inner)
    return out


OUTPUT_METRICS = "output string, queued_chunks bigint, queued_bytes bigint, dropped_chunks bigint, dropped_bytes bigint, sent_chunks bigint, sent_bytes bigint, pending_chunks bigint, pending_bytes bigint"
#: Key sets a scrape reports, those with most records; the tables have all.
SCRAPED = 10_000


@dataclass
class Runner:
    """Runs a program over a stream of (source, order, record) frames. The folder holds checkpoint, outboxes, counters and sampling state.

    Chunks carry the number of their batch and are written once: a batch that runs again after a failure finds them and sends those not acknowledged yet.
    """

    spark: SparkSession
    program: Program
    folder: str
    connect: dict[str, Callable[[], Connection]] = field(default_factory=dict)
    send: bool = True
    reloads: dict[str, int] = field(default_factory=lambda: {"success": 0, "failure": 0})
    query: StreamingQuery | None = None
    _source: Callable[[], DataFrame] | None = None
    _sending: threading.Lock = field(default_factory=threading.Lock)
    _trigger: dict = field(default_factory=dict)

    def outbox(self, name: str) -> Outbox:
        o = next(o for o in self.program.outputs if o.name == name)
        return Outbox(self.spark, f"{self.folder}/outbox", name, o.buffer.max_size if o.buffer else None)

    def batch(self, raw: DataFrame, number: int) -> None:
        """One micro-batch."""
        keys = tuple(key_name(k) for k in self.program.orchestration.keys)
        state = SamplingState(self.spark, f"{self.folder}/sampling", keys)
        lines = sampling_lines(self.program.transformations)
        seen = {n: s for n in lines if (s := state.before(number, n)) is not None}
        result = pipeline.run(self.program, raw, seen=seen, marks=True)
        # Every output and counter reads the same records.
        result.records = result.records.persist()
        try:
            for n in lines:
                state.after(number, n, result.records)
            put = {o.name: self.outbox(o.name).put(chunks.pack(result.events(o), o, batch=number), number) for o in self.program.outputs}
            at = f"batch={number:019d}"
            result.process_counts().write.mode("overwrite").parquet(f"{self.folder}/metrics/process/{at}")
            result.label_counts().write.mode("overwrite").parquet(f"{self.folder}/metrics/labels/{at}")
            result.input_counts().write.mode("overwrite").parquet(f"{self.folder}/metrics/input/{at}")
        finally:
            result.records.unpersist()
        self.deliver(number, put)

    def deliver(self, number: int, put: dict[str, Put] | None = None) -> None:
        """Sends what waits in the outboxes, and notes what became of it under the number of the batch."""
        rows = []
        with self._sending:
            for o in self.program.outputs:
                box = self.outbox(o.name)
                before = box.waiting()
                if self.send and before[0]:
                    done = deliver(box.pending(), self.connect.get(o.name) or opener(o), max_duration=max_duration(o))
                    box.acknowledge(done, number)
                after = box.waiting() if self.send and before[0] else before
                if self.send:
                    box.compact(number)
                p = (put or {}).get(o.name) or Put(0, 0, 0, 0)
                rows.append((o.name, p.chunks, p.bytes, p.dropped_chunks, p.dropped_bytes, before[0] - after[0], before[1] - after[1], after[0], after[1]))
        name = f"batch={number:019d}" if put is not None else f"batch={number:019d}.again{time.time_ns()}"
        self.spark.createDataFrame(rows, OUTPUT_METRICS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/metrics/output/{name}")

    def send_waiting(self) -> bool:
        """Tries again to send what an earlier batch couldn't, where no batch is under way: with no new records there is no batch to do it. Whether anything waited."""
        if not self.send or self._sending.locked() or not any(self.outbox(o.name).waiting()[0] for o in self.program.outputs):
            return False
        # The number of the last batch that was written: its successors don't exist yet.
        last = max((n for o in self.program.outputs for n, _ in self.outbox(o.name)._batches("chunks")), default=0)
        self.deliver(last)
        return True

    def output_totals(self) -> DataFrame:
        """Per output over all batches: chunks and bytes queued, dropped and sent; and pending ones as they are now."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/metrics/output")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [f"{self.folder}/metrics/output/{e.getPath().getName()}" for e in fs.listStatus(folder)] if fs.exists(folder) else []
        m = self.spark.read.schema(OUTPUT_METRICS).parquet(*paths) if paths else self.spark.createDataFrame([], OUTPUT_METRICS)
        sums = m.groupBy("output").agg(*[F.sum(f"{k}_{u}").alias(f"{k}_{u}") for k in ("queued", "dropped", "sent") for u in ("chunks", "bytes")])
        now = self.spark.createDataFrame([(o.name, *self.outbox(o.name).waiting()) for o in self.program.outputs], "output string, pending_chunks bigint, pending_bytes bigint")
        return now.join(sums, "output", "left").na.fill(0)

    def prometheus(self) -> str:
        """Counters and gauges as text for a scraper: records by key set, chunks by output, reloads."""
        quoted = lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        lines = []
        try:
            for r in self.totals().orderBy(F.desc("passed_count")).limit(SCRAPED).collect():
                labels = ",".join(f"{k}={quoted(r[k])}" for k in r.asDict() if k.startswith("key_"))
                lines += [f"millrace_process_{c}{{{labels}}} {r[c]}" for c in ("passed_count", "passed_bytes", "dropped_count", "dropped_bytes")]
        except AnalysisException:  # no batch has run yet
            pass
        for r in self.output_totals().collect():
            for k in ("queued", "dropped", "sent", "pending"):
                lines += [f"millrace_output_{k}_{u}{{output={quoted(r['output'])}}} {r[f'{k}_{u}']}" for u in ("chunks", "bytes")]
        lines += [f"millrace_reloads_total{{status={quoted(k)}}} {n}" for k, n in self.reloads.items()]
        return "\n".join(lines) + "\n"

    def start(self, source: Callable[[], DataFrame], **trigger) -> StreamingQuery:
        """Starts the query; `source` gives the framed stream, anew for each start."""
        self._source, self._trigger = source, trigger or {"processingTime": "1 second"}
        self.query = source().writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**self._trigger).start()
        return self.query

    def reload(self, new: Program) -> bool:
        """Replaces the program of a running query, from the same checkpoint. A program that may not take its place leaves the old one running."""
        try:
            check_reload(self.program, new)
        except ValueError:
            self.reloads["failure"] += 1
            return False
        running = self.query is not None and self.query.isActive
        if running:
            # What was read and not finished is read again from the checkpoint.
            self.query.stop()
        self.program = new
        if self._source is not None and running:
            self.start(self._source, **self._trigger)
        self.reloads["success"] += 1
        return True

    def totals(self) -> DataFrame:
        """Passed and dropped records and bytes by key set over all batches."""
        m = self.spark.read.parquet(f"{self.folder}/metrics/process")
        keys = [c for c in m.columns if c.startswith("key_")]
        return m.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("passed_count", "passed_bytes", "dropped_count", "dropped_bytes")])
