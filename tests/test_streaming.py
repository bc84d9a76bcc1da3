import socket
import time
from dataclasses import replace

from pyspark.sql import functions as F

from millrace import config
from millrace.plans import pipeline
from millrace.queries.sample import PROGRAM, program
from millrace.schema import ALIVE, LABELS, ORDER, SOURCE
from millrace.sinks import delivery
from millrace.sinks.events import event_json
from millrace.sources.tcp import Listener, SyslogTcpReader
from millrace.streaming.framing import frame_stream
from millrace.streaming.runner import Runner
from tests.test_outputs import Flaky
from tests.test_syslog import A, B

RECORD = "<134>1 2024-03-01T00:00:{:02}.000Z h1 app/v.example 1 {} - {}"


def lines_of(n, text="Login rejected for acc1: x", source="audit.log"):
    return [RECORD.format(i % 60, source, text) for i in range(n)]


def write(folder, name, rows, spark):
    spark.createDataFrame(rows, "conn string, no long, line string").coalesce(1).write.mode("append").json(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema("conn string, no long, line string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(folder)


def test_framing_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    write(src, "a", [("c1", 1, A), ("c1", 2, "  more"), ("c2", 1, "junk"), ("c1", 3, B)], spark)
    q = frame_stream(stream(spark, src), "conn", "line", "no", idle_seconds=1).writeStream.format("memory").queryName("framed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        # A query that waits for timeouts never runs out of batches, so the test looks for the rows instead.
        got = lambda: sorted((r[SOURCE], r[ORDER], r["record"]) for r in spark.table("framed").collect())
        end = time.time() + 40
        while time.time() < end and len(got()) < 2:
            time.sleep(0.5)
        # The last record closes when the connection falls silent; what never looked like a record is discarded.
        assert got() == [("c1", 0, A + "\n  more"), ("c1", 1, B)]
    finally:
        q.stop()


def settled(query, seconds=60):
    end = time.time() + seconds
    idle = 0
    while time.time() < end and idle < 3:
        time.sleep(0.5)
        s = query.status
        idle = idle + 1 if not s["isDataAvailable"] and not s["isTriggerActive"] and query.recentProgress else 0
    assert query.exception() is None


def raw_stream(spark, folder):
    return stream(spark, folder).select(F.col("conn").alias(SOURCE), F.col("no").alias(ORDER), F.col("line").alias("record"))


def test_runner_equals_batch(spark, tmp_path):
    """Batches of a stream give what one batch gives: sampling goes on where it stopped."""
    src = str(tmp_path / "in")
    lines = lines_of(30) + lines_of(5, "a@b.example wrote", "mail.log") + ["junk"]
    rows = [("c", i, x) for i, x in enumerate(lines)]
    for k in range(0, len(rows), 12):
        write(src, f"f{k:03}", rows[k : k + 12], spark)
    got = {}
    p = program()
    runner = Runner(spark, p, str(tmp_path / "out"), send=False)
    q = runner.start(lambda: raw_stream(spark, src), availableNow=True)
    q.awaitTermination(120)
    assert q.exception() is None
    whole = pipeline.run(p, spark.createDataFrame(rows, f"{SOURCE} string, {ORDER} long, record string"))
    want = {tuple(r) for r in whole.process_counts().collect()}
    assert {tuple(r) for r in runner.totals().select(*whole.process_counts().columns).collect()} == want
    for o in p.outputs:
        from millrace.sinks import chunks

        events = [e for c in runner.outbox(o.name).pending().collect() for e in chunks.decode(o.type, bytes(c["data"]))]
        got[o.name] = len(events)
        assert len(events) == event_json(whole.passed(), p.schema, o).count()
    labels = whole.records.filter(~F.col(ALIVE)).select(LABELS).distinct().collect()
    assert labels and got


def test_runner_sends_and_reloads(spark, tmp_path):
    src = str(tmp_path / "in")
    write(src, "f1", [("c", i, x) for i, x in enumerate(lines_of(6))], spark)
    runner = Runner(spark, program(), str(tmp_path / "out"), {"archive": Flaky, "search": Flaky})
    q = runner.start(lambda: raw_stream(spark, src), processingTime="1 second")
    try:
        settled(q)
        assert all(runner.outbox(o).pending().count() == 0 and runner.outbox(o).written().count() > 0 for o in ("archive", "search"))
        assert not runner.reload(replace(program(), orchestration=config.Orchestration("singleton", (), "x"))) and runner.query.isActive
        assert runner.reload(config.loads(PROGRAM.replace("metricKeys: [source, vhost]", "metricKeys: [source, vhost, host]")))
        write(src, "f2", [("c", 100 + i, x) for i, x in enumerate(lines_of(4))], spark)
        settled(runner.query)
        assert runner.totals().agg(F.sum("passed_count"), F.sum("dropped_count")).first()[0] > 0
        assert runner.reloads == {"success": 1, "failure": 1}
        totals = {r["output"]: r for r in runner.output_totals().collect()}
        assert totals.keys() == {"archive", "search"} and all(r["sent_chunks"] == r["queued_chunks"] > 0 and r["pending_chunks"] == r["dropped_chunks"] == 0 for r in totals.values())
        text = runner.prometheus()
        assert 'millrace_reloads_total{status="failure"} 1' in text and 'millrace_output_sent_chunks{output="archive"}' in text and "millrace_process_passed_count{" in text
    finally:
        runner.query.stop()


def test_tcp_listener():
    r = SyslogTcpReader("127.0.0.1", 0)
    listener: Listener = r.listener
    try:
        with socket.create_connection(("127.0.0.1", listener.port)) as s:
            s.sendall(f"{A}\n{B}\n".encode())
        start = r.initialOffset()
        end = time.time() + 10
        rows, offset = [], start
        while time.time() < end and len(rows) < 2:
            it, offset = r.read(start)
            rows = list(it)
            time.sleep(0.05)
        assert [(n, x) for _, n, x in rows] == [(0, A), (1, B)] and offset == {"line": 2}
        assert list(r.readBetweenOffsets(start, offset)) == rows  # a batch that runs again
        r.commit(offset)
        assert list(r.read(offset)[0]) == []
    finally:
        listener.close()


def test_tcp_listener_after_a_restart():
    """The driver starts again with offset 1000 of its checkpoint and a listener that knows of no lines: what comes now follows."""
    r = SyslogTcpReader("127.0.0.1", 0)
    listener: Listener = r.listener
    try:
        with listener.room:
            listener.lines += [("c", i, f"line {i}") for i in range(10)]
        rows, offset = r.read({"line": 1000})
        assert [x for _, _, x in rows] == [f"line {i}" for i in range(10)] and offset == {"line": 1010}
        assert [x for _, _, x in r.readBetweenOffsets({"line": 1000}, offset)] == [f"line {i}" for i in range(10)]
        r.commit(offset)
        assert list(r.read(offset)[0]) == [] and listener.first == 1010
    finally:
        listener.close()


class Refusing(Flaky):
    """An endpoint that is not there."""

    def __init__(self):
        raise ConnectionError("nobody listens")


def test_a_batch_that_runs_again_loses_nothing(spark, tmp_path, monkeypatch):
    """A crash after chunks were acknowledged and before the batch was: the batch runs again, even with other contents, and sends what is left under the same identifiers."""
    from millrace.streaming import runner as R

    monkeypatch.setattr(delivery, "WAIT", 0.0)
    raw = lambda n: spark.createDataFrame([("c", i, x) for i, x in enumerate(lines_of(n, "Ticket 1 assigned", "store.log"))], f"{SOURCE} string, {ORDER} long, record string")
    Flaky.arrived, Flaky.failures = [], []
    first = R.Runner(spark, program(), str(tmp_path / "out"), {"archive": Flaky, "search": Flaky})
    first.batch(raw(20), 0)
    before = {r["chunk_id"]: bytes(r["data"]) for o in ("archive", "search") for r in first.outbox(o).written().collect()}
    again = R.Runner(spark, program(), str(tmp_path / "out"), {"archive": Flaky, "search": Flaky})
    again.batch(raw(25), 0)
    assert {r["chunk_id"]: bytes(r["data"]) for o in ("archive", "search") for r in again.outbox(o).written().collect()} == before
    again.batch(raw(25), 1)
    assert {i[:19] for i in (r["chunk_id"] for r in again.outbox("search").written().collect())} == {f"{1:019d}"}  # batch 0 was acknowledged and is gone


def test_waiting_chunks_are_sent_without_a_new_batch(spark, tmp_path, monkeypatch):
    from millrace.streaming import runner as R

    real = R.deliver
    monkeypatch.setattr(R, "deliver", lambda *a, **k: real(*a, wait=0.0, **k))
    raw = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines_of(9, "Ticket 1 assigned", "store.log"))], f"{SOURCE} string, {ORDER} long, record string")
    runner = R.Runner(spark, program(), str(tmp_path / "out"), {"archive": Refusing, "search": Refusing})
    runner.batch(raw, 0)
    totals = {r["output"]: r for r in runner.output_totals().collect()}
    assert all(r["pending_chunks"] == r["queued_chunks"] > 0 and r["sent_chunks"] == 0 for r in totals.values())
    runner.connect = {"archive": Flaky, "search": Flaky}
    Flaky.failures = []
    assert runner.send_waiting() and not runner.send_waiting()
    totals = {r["output"]: r for r in runner.output_totals().collect()}
    assert all(r["sent_chunks"] == r["queued_chunks"] and r["pending_chunks"] == 0 for r in totals.values())


def test_metrics_address(spark, tmp_path):
    import urllib.request

    from millrace import cli

    server = cli.serve_metrics(Runner(spark, program(), str(tmp_path)), "127.0.0.1:0")
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/metrics") as answer:
            assert b'millrace_output_pending_chunks{output="search"} 0' in answer.read()
    finally:
        server.shutdown()


def test_cli(spark, tmp_path, capsys):
    from millrace import cli

    (tmp_path / "p.yml").write_text(PROGRAM)
    (tmp_path / "a.log").write_text("\n".join(lines_of(3)) + "\n")
    assert cli.main(["check", "--config", str(tmp_path / "p.yml")]) == 0
    assert cli.main(["run", "--config", str(tmp_path / "p.yml"), "--input", str(tmp_path / "a.log"), "--output", str(tmp_path / "o"), "--chunks"]) == 0
    assert spark.read.parquet(str(tmp_path / "o" / "archive.chunks")).count() > 0
    assert spark.read.text(str(tmp_path / "o" / "search")).count() > 0
    assert cli.main(["benchmark", "--config", str(tmp_path / "p.yml"), "--input", str(tmp_path / "a.log"), "--repeat", "3"]) == 0
    assert "9 records" in capsys.readouterr().out
