import gzip
import json
import socketserver
import threading
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.config import Output, Rewrite
from millrace.operators import metrics
from millrace.plans import pipeline
from millrace.queries.operators import app_records
from millrace.queries.sample import program
from millrace.schema import ORDER, SOURCE, Schema, start_records
from millrace.sinks import chunks, delivery, msgpack
from millrace.sinks.events import event_columns, event_json, serialize
from millrace.sinks.files import chunk_lines, save_chunks
from millrace.sinks.outbox import Outbox, folder_name

S = Schema(("vhost", "app", "message", "extra", "comp"))
ROWS = [("foo", "myapp", "Hello\\nWorld", "x", ""), ("bar", "myapp", "Test", "", "c"), ("", "sshd", "", "", ""), (None, "sshd2", None, None, None)]
FORWARD = Output("f", "fluentdForward", ("vhost", "app"), ("extra",), {"message": [Rewrite("inline", "comp"), Rewrite("unescape")]})
API = Output("d", "datadog", (), ("extra",))


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(ROWS)], f"{SOURCE} string, {ORDER} long, vhost string, app string, message string, extra string, comp string")
    return start_records(df, S, time=F.timestamp_micros(F.lit(1_500_000_000_123_456).cast("long"))).withColumn(pipeline.TAG, F.concat(F.lit("t."), "app"))


def test_forward_events(records):
    rows = [json.loads(r[0]) for r in event_json(records, S, FORWARD).orderBy(ORDER).select("json").collect()]
    assert rows[0] == ["t.myapp", 1500000000.123456, {"message": "Hello\nWorld", "environment": {"app": "myapp", "vhost": "foo"}}]
    assert rows[1][2] == {"message": "comp=c Test", "comp": "c", "environment": {"app": "myapp", "vhost": "bar"}}
    assert rows[2] == ["t.sshd", 1500000000.123456, {"environment": {"app": "sshd", "vhost": ""}}]  # the environment is whole, other missing fields are absent
    assert rows[3][2]["environment"] == {"app": "sshd2", "vhost": ""}


def test_api_events(records):
    rows = [json.loads(r[0]) for r in event_json(records, S, API).orderBy(ORDER).select("json").collect()]
    assert rows[0] == {"vhost": "foo", "app": "myapp", "message": "Hello\\nWorld", "ddtags": "t.myapp", "timestamp": "1500000000123"}
    assert rows[2] == {"app": "sshd", "ddtags": "t.sshd", "timestamp": "1500000000123"}
    keys = event_json(records, S, API).first()["json"]
    assert list(json.loads(keys)) == sorted(json.loads(keys))
    assert "environment" not in event_columns(records, S, API).columns


@pytest.mark.parametrize("mode", ["Forward", "PackedForward", "CompressedPackedForward"])
def test_forward_chunks(records, mode):
    o = replace(FORWARD, message_mode=mode)
    got = chunks.pack(serialize(records, S, o), o, batch=3).collect()
    assert sorted(c["tag"] for c in got) == ["t.myapp", "t.sshd", "t.sshd2"] and all(c["chunk_id"].endswith(".ff") and c["chunk_id"].startswith("0" * 18 + "3-") for c in got)
    events = [e for c in sorted(got, key=lambda c: c["tag"]) for e in chunks.decode("fluentdForward", bytes(c["data"]))]
    want = [json.loads(r[0]) for r in event_json(records, S, o).orderBy(ORDER).select("json").collect()]
    assert [(e[0], e[2]) for e in events] == [(w[0], w[2]) for w in want] and all(abs(e[1] - w[1]) < 1e-6 for e, w in zip(events, want))


def test_api_chunks(records):
    got = chunks.pack(serialize(records, S, API), API).collect()
    events = [e for c in sorted(got, key=lambda c: c["tag"]) for e in chunks.decode("datadog", bytes(c["data"]))]
    assert events == [json.loads(r[0]) for r in event_json(records, S, API).orderBy(ORDER).select("json").collect()]


def plain_groups(sizes, limits):
    out, cur, size = [], [], limits.first
    for i, n in enumerate(sizes):
        if cur and ((limits.max_records and len(cur) >= limits.max_records) or size + n + limits.each > limits.max_bytes):
            out.append(cur)
            cur, size = [], limits.first
        cur.append(i)
        size += n + limits.each
    return out + ([cur] if cur else [])


@settings(max_examples=200)
@given(st.lists(st.integers(0, 40)), st.sampled_from([chunks.Limits(50, None, 0, 0, ""), chunks.Limits(50, 3, 1, 1, "")]))
def test_greedy_groups(sizes, limits):
    assert [list(range(a, b)) for a, b in chunks.groups(sizes, limits)] == plain_groups(sizes, limits)


def test_many_chunks_keep_order(spark, monkeypatch):
    monkeypatch.setitem(chunks.LIMITS, "datadog", chunks.Limits(300, 5, 1, 1, ".dd"))
    rows = [("s", i, f"t{i % 3}", json.dumps({"i": i, "x": "y" * (i % 70)}).encode()) for i in range(500)]
    df = spark.createDataFrame(rows, f"{SOURCE} string, {ORDER} long, tag string, data binary").repartition(7)
    got = sorted(chunks.pack(df, API).collect(), key=lambda c: c["chunk_id"])
    seen = {}
    for c in got:
        assert c["n_records"] <= 5
        seen.setdefault(c["tag"], []).extend(e["i"] for e in chunks.decode("datadog", bytes(c["data"])))
    assert {t: v == sorted(v) for t, v in seen.items()} == {f"t{k}": True for k in range(3)} and sum(map(len, seen.values())) == 500
    assert len({c["chunk_id"] for c in got}) == len(got)


def test_packing_in_place(spark, monkeypatch):
    monkeypatch.setitem(chunks.LIMITS, "datadog", chunks.Limits(300, 5, 1, 1, ".dd"))
    rows = [("s", i, f"t{i % 3}", json.dumps({"i": i, "x": "y" * (i % 70)}).encode()) for i in range(500)]
    df = spark.createDataFrame(rows, f"{SOURCE} string, {ORDER} long, tag string, data binary").coalesce(1)
    got = chunks.pack(df, API, ordered=False).collect()
    seen = {}
    for c in sorted(got, key=lambda c: c["chunk_id"]):
        assert c["n_records"] <= 5
        seen.setdefault(c["tag"], []).extend(e["i"] for e in chunks.decode("datadog", bytes(c["data"])))
    assert seen == {f"t{k}": list(range(k, 500, 3)) for k in range(3)} and len({c["chunk_id"] for c in got}) == len(got)
    for k in range(3):
        sizes = [len(d) for _, i, t, d in rows if t == f"t{k}"]
        assert sum(c["tag"] == f"t{k}" for c in got) == len(plain_groups(sizes, chunks.LIMITS["datadog"]))
    assert chunks.pack(df.limit(0), API, ordered=False).count() == 0


@settings(max_examples=200)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.text(max_size=40) | st.binary(max_size=40) | st.floats(allow_nan=False), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=20), max_leaves=30))
def test_msgpack_round_trip(x):
    assert msgpack.unpack(msgpack.pack(x)) == (x, len(msgpack.pack(x)))


def test_msgpack_sizes():
    for n in (0, 15, 16, 31, 32, 255, 256, 65535, 65536):
        for x in ("a" * n, b"a" * n, [1] * n, {str(i): i for i in range(n)}):
            assert msgpack.unpack(msgpack.pack(x))[0] == x
    assert msgpack.unpack(msgpack.event_time(5, 500_000_000))[0] == 5.5


def test_counters(spark, data):
    r = pipeline.transform(program(), app_records(spark, data))
    n = r.process_counts().agg(F.sum("passed_count"), F.sum("dropped_count")).first()
    assert n[0] == r.passed().count() and n[0] + n[1] == r.records.count()
    o = program().outputs[1]
    e = serialize(r.passed(), program().schema, o).withColumn("output", F.lit(o.name))
    counted, packed = metrics.serialized_counts(e).first(), metrics.chunk_counts(chunks.pack(e, o)).first()
    assert counted["records"] == n[0] and packed["chunk_bytes"] < counted["serialized_bytes"]


# Outbox and delivery


def made(spark, ids):
    return spark.createDataFrame([("o", "t", i, 1, n, b"x" * n) for i, n in ids], "output string, tag string, chunk_id string, n_records long, n_bytes long, data binary")


def test_outbox(spark, tmp_path):
    box = Outbox(spark, str(tmp_path), "a/b")
    assert box.pending().count() == 0 and box.size() == 0
    assert box.put(made(spark, [(f"id{i}", i) for i in range(5)]), 0).chunks == 5
    # A batch that runs again, even with other chunks, leaves what was written.
    assert box.put(made(spark, [("id4", 9), ("id7", 7)]), 0).chunks == 0
    assert sorted((r["chunk_id"], r["n_bytes"]) for r in box.pending().collect()) == [("id1", 1), ("id2", 2), ("id3", 3), ("id4", 4)]  # the empty one is corrupt
    assert box.waiting() == (4, 10)
    box.acknowledge(spark.createDataFrame([("id2",), ("id3",)], "chunk_id string"), 0)
    assert sorted(r["chunk_id"] for r in Outbox(spark, str(tmp_path), "a/b").pending().collect()) == ["id1", "id4"]
    box.put(made(spark, [("next", 3)]), 1)
    box.compact(1)
    assert box.written().count() == 6  # something waits
    box.acknowledge(box.pending(), 1)
    box.compact(1)
    assert box.written().count() == 1 and box.pending().count() == 0
    assert folder_name("a/b") != folder_name("a_b") and folder_name("a/b").startswith("a_b.")


def test_a_full_outbox_loses_what_is_newest(spark, tmp_path):
    box = Outbox(spark, str(tmp_path), "o", max_bytes=100)
    ids = [f"{0:019d}-{k:016x}{0:08d}.ff" for k in (0x01 << 56, 0x55 << 56, 0x55 << 56 | 9, 0xF0 << 56)]
    put = box.put(made(spark, zip(ids, (40, 30, 25, 20))), 0)
    assert (put.chunks, put.bytes, put.dropped_chunks, put.dropped_bytes) == (3, 95, 1, 20)
    assert sorted(r["chunk_id"] for r in box.pending().collect()) == ids[:3]
    assert box.put(made(spark, [("later", 6)]), 1).dropped_chunks == 1 and box.put(made(spark, [("small", 5)]), 2).chunks == 1


@pytest.mark.parametrize("index", [0, 1])
def test_chunks_of_a_batch_are_the_same_however_it_is_spread(spark, monkeypatch, index):
    """Packed twice from 300,000 events that lie in different partitions, with adaptive plans: the same chunks, byte for byte."""
    monkeypatch.setattr(chunks, "GROUP_BYTES", 1 << 20)
    o = program().outputs[index]
    ids = spark.range(300_000)
    tag = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string")))
    df = ids.select(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias(SOURCE), F.floor(F.col("id") / 5).alias(ORDER), tag.alias("tag"), F.concat(F.lit('{"i":'), F.col("id").cast("string"), F.lit("}")).cast("binary").alias("data"))
    packed = [{r["chunk_id"]: (r["tag"], r["n_records"], bytes(r["data"])) for r in chunks.pack(x, o, batch=7).collect()} for x in (df, df.repartition(13))]
    assert packed[0] == packed[1] and sum(n for _, n, _ in packed[0].values()) == 300_000
    assert sum(t == "hot" for t, _, _ in packed[0].values()) > 1


class Flaky:
    """Fails at given sends, forgets what was in flight then, and notes what arrived."""

    arrived: list = []
    failures: list = []

    def __init__(self):
        self.sent = []

    def send(self, i, data):
        if Flaky.failures and Flaky.failures[0] == i:
            Flaky.failures.pop(0)
            raise ConnectionError(i)
        Flaky.arrived.append(i)
        self.sent.append(i)

    def ping(self):
        Flaky.arrived.append("ping")

    def acknowledged(self):
        return self.sent.pop(0)

    def close(self):
        Flaky.arrived.append("close")


def test_send_again_after_errors():
    Flaky.arrived, Flaky.failures = [], ["c05", "c07"]
    todo = [(f"c{i:02}", b"") for i in range(30)]
    assert sorted(delivery.send_all(iter(todo), Flaky, wait=0)) == [c for c, _ in todo]
    assert set(Flaky.arrived) - {"close"} == {c for c, _ in todo} and len(Flaky.arrived) >= 30
    Flaky.failures = ["c00"] * 9
    assert list(delivery.send_all(iter(todo), Flaky, wait=0, tries=3)) == []
    Flaky.failures = ["c00"] * 9
    assert len(list(delivery.send_all(iter(todo), Flaky, wait=0, tries=None))) == 30


def test_signs_of_life_and_renewal(monkeypatch):
    """Each chunk takes four seconds to come: after ten the connection is told so, and after sixty it is opened anew with nothing in flight."""
    now = [0.0]

    def slow():
        for i in range(40):
            now[0] += 12.0 if i % 4 == 3 else 4.0
            yield f"c{i:02}", b""

    monkeypatch.setattr(delivery, "UNACKNOWLEDGED", 1)
    Flaky.arrived, Flaky.failures = [], []
    assert list(delivery.send_all(slow(), Flaky, wait=0, max_duration=60.0, clock=lambda: now[0])) == [f"c{i:02}" for i in range(40)]
    assert Flaky.arrived.count("ping") > 4 and Flaky.arrived.count("close") >= 3
    # A chunk in flight is never cut off: each is sent once.
    assert sorted(x for x in Flaky.arrived if x[0] == "c" and x != "close") == [f"c{i:02}" for i in range(40)]
    assert delivery.max_duration(program().outputs[0]) == 1200 and delivery.max_duration(program().outputs[1]) is None


@pytest.fixture
def receiver():
    """An endpoint of the forward protocol: checks the shared key, and acknowledges."""
    import hashlib

    got = []

    class Handler(socketserver.BaseRequestHandler):
        def handle(self):
            held = b""

            def read():
                nonlocal held
                while True:
                    try:
                        v, end = msgpack.unpack(held)
                        held = held[end:]
                        return v
                    except Exception:
                        more = self.request.recv(65536)
                        if not more:
                            return None
                        held += more

            if self.server.secret:
                self.request.sendall(msgpack.pack(["HELO", {"nonce": b"nnn", "auth": b"", "keepalive": True}]))
                _, name, salt, digest, *_ = read()
                ok = digest == hashlib.sha512(salt + name.encode() + b"nnn" + self.server.secret.encode()).hexdigest()
                self.request.sendall(msgpack.pack(["PONG", ok, "" if ok else "wrong key", "me", hashlib.sha512(salt + b"me" + b"nnn" + self.server.secret.encode()).hexdigest()]))
                if not ok:
                    return
            while (m := read()) is not None:
                got.append(m)
                self.request.sendall(msgpack.pack({"ack": m[2]["chunk"]}))

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

    server = Server(("127.0.0.1", 0), Handler)
    server.secret, server.got = "guess", got
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def test_forward_connection(spark, records, receiver):
    port = receiver.server_address[1]
    o = replace(FORWARD, upstream={"address": f"127.0.0.1:{port}", "tls": "false", "secret": "guess"})
    packed = chunks.pack(serialize(records, S, o), o)
    ids = [r[0] for r in packed.select("chunk_id").collect()]
    assert sorted(r[0] for r in delivery.deliver(packed, delivery.opener(o), wait=0).collect()) == sorted(ids)
    assert sorted(m[0] for m in receiver.got) == ["t.myapp", "t.sshd", "t.sshd2"]
    with pytest.raises(ConnectionError):
        delivery.ForwardConnection("127.0.0.1", port, secret="wrong")


def test_api_connection():
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            got.append((self.headers["DD-API-KEY"], json.loads(gzip.decompress(body))))
            self.send_response(202 if len(got) > 1 else 500)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    o = replace(API, upstream={"address": f"http://127.0.0.1:{server.server_address[1]}/api", "httpTimeout": "5s", "apiKey": "k"})
    data = chunks.build("datadog", "", "t", "id", [b'{"a":1}', b'{"a":2}'])
    assert list(delivery.send_all(iter([("id", data)]), delivery.opener(o), wait=0)) == ["id"]
    assert got == [("k", [{"a": 1}, {"a": 2}])] * 2
    server.shutdown()
    server.server_close()
    assert delivery.seconds("30s") == 30 and delivery.seconds("500ms") == 0.5 and delivery.seconds("2m") == 120


@pytest.mark.parametrize("o", [FORWARD, API], ids=["forward", "api"])
def test_chunk_files(spark, records, tmp_path, o):
    packed = chunks.pack(serialize(records, S, o), o)
    n = packed.count()
    for _ in range(2):
        assert save_chunks(packed, str(tmp_path / "out")) == n
    files = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()}
    assert files == {r["chunk_id"]: bytes(r["data"]) for r in packed.collect()}
    lines = [json.loads(r["json"]) for r in chunk_lines(packed, o).orderBy("chunk_id", "place").collect()]
    want = [json.loads(r[0]) for r in event_json(records, S, o).select("json").collect()]
    bare = (lambda e: [e[0], e[2]]) if o is FORWARD else (lambda e: e)
    assert sorted(json.dumps(bare(x), sort_keys=True) for x in lines) == sorted(json.dumps(bare(x), sort_keys=True) for x in want)
