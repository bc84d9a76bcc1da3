"""Command line: run a program over files or a port, or measure it.

    python -m millrace.cli run --config program.yml --input 'logs/*.log' --output out
    python -m millrace.cli run --config program.yml --output out --listen
    python -m millrace.cli benchmark --config program.yml --input 'logs/*.log' --repeat 100
    python -m millrace.cli check --config program.yml
"""

from __future__ import annotations

import argparse
import functools
import http.server
import signal
import sys
import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace import config
from millrace.plans import pipeline
from millrace.schema import ORDER, SOURCE
from millrace.session import written
from millrace.sinks import chunks
from millrace.sinks.events import event_json
from millrace.sources.syslog import read_files


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "benchmark", "check"):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True)
        if name != "check":
            p.add_argument("--input")
            p.add_argument("--output")
        if name == "run":
            p.add_argument("--listen", action="store_true", help="take records from the program's address until stopped")
            p.add_argument("--test_mode", action="store_true", help="write chunks to the outbox and send nothing")
            p.add_argument("--chunks", action="store_true", help="write the chunks of each output as well, a row each")
            p.add_argument("--metrics_addr", help="host:port at which counters can be read while listening")
            p.add_argument("--allow_reload", action="store_true", help="read the program again on SIGHUP")
        if name == "benchmark":
            p.add_argument("--repeat", type=int, default=1)
    a = parser.parse_args(args)
    program = config.load(a.config)
    if program.unused_fields():
        print(f"unused fields: {', '.join(program.unused_fields())}", file=sys.stderr)
    if a.command == "check":
        return 0
    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "benchmark":
        raw = read_files(spark, a.input)
        if a.repeat > 1:
            raw = raw.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(a.repeat)))).withColumn(SOURCE, F.concat(SOURCE, F.lit("#"), "_n")).drop("_n")
        began = time.time()
        n = raw.count()
        read = time.time() - began
        for o in program.outputs:
            began = time.time()
            r = pipeline.run(program, [raw] * len(program.inputs))
            chunks.pack(r.events(o), o).write.format("noop").mode("overwrite").save()
            print(f"{o.name}: {n} records in {time.time() - began:.2f} s, reading alone {read:.2f} s")
        return 0
    if a.listen:
        return _listen(spark, program, a)
    # One set of files per input of the program, separated by commas; the last serves the inputs that have none of their own.
    inputs = a.input.split(",")
    r = pipeline.run(program, [read_files(spark, inputs[min(i, len(inputs) - 1)]) for i in range(len(program.inputs))])
    # Every output and counter reads the same records.
    r.records = written(r.records)
    for o in program.outputs:
        event_json(r.passed(), program.schema, o).sortWithinPartitions(SOURCE, ORDER).select("json").write.mode("overwrite").text(f"{a.output}/{o.name}")
        if a.chunks:
            chunks.pack(r.events(o), o).write.mode("overwrite").parquet(f"{a.output}/{o.name}.chunks")
    r.process_counts().write.mode("overwrite").parquet(f"{a.output}/metrics/process")
    r.label_counts().write.mode("overwrite").parquet(f"{a.output}/metrics/labels")
    return 0


def _listen(spark: SparkSession, program: config.Program, a: argparse.Namespace) -> int:
    from millrace.sources.tcp import SyslogTcpSource
    from millrace.streaming.framing import frame_stream
    from millrace.streaming.runner import Runner

    spark.dataSource.register(SyslogTcpSource)
    runner = Runner(spark, program, a.output, send=not a.test_mode)

    def source():
        frames = []
        for i, x in enumerate(program.inputs):
            lines = spark.readStream.format("syslog_tcp").option("address", x.address).load().withColumn("connection", F.concat(F.lit(f"{i}/"), "connection"))
            frames.append(frame_stream(lines, "connection", "line", "line_no").withColumn(pipeline.INPUT, F.lit(i)))
        return functools.reduce(lambda a, b: a.unionByName(b), frames)

    runner.start(source)
    if a.metrics_addr:
        serve_metrics(runner, a.metrics_addr)
    if a.allow_reload:
        signal.signal(signal.SIGHUP, lambda *_: runner.reload(config.load(a.config)))
    while runner.query is not None and runner.query.isActive:
        if not runner.query.awaitTermination(10):
            runner.send_waiting()
    return 0


def serve_metrics(runner, address: str):
    """Serves the runner's counters at /metrics from a thread of their own."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            body = runner.prometheus().encode() if self.path == "/metrics" else b""
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    host, _, port = address.rpartition(":")
    server = http.server.ThreadingHTTPServer((host or "localhost", int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


if __name__ == "__main__":
    sys.exit(main())
