"""Chunks sent to their endpoints from the tasks that hold them: pipelined, acknowledged, sent again after errors."""

from __future__ import annotations

import hashlib
import os
import socket
import ssl
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.config import Output
from millrace.errors import ConfigError
from millrace.session import ship
from millrace.sinks import msgpack

#: Chunks sent and not yet acknowledged; tries per chunk, and seconds between them.
UNACKNOWLEDGED, TRIES, WAIT = 10, 5, 10.0


#: Seconds without a chunk after which a connection that is kept open gets a sign of life.
PING = 10.0


class Connection(Protocol):
    def send(self, chunk_id: str, data: bytes) -> None: ...
    def ping(self) -> None: ...
    def acknowledged(self) -> str: ...
    def close(self) -> None: ...


class ForwardConnection:
    """The forward protocol over TCP or TLS: an optional handshake with a shared key, then chunks with acknowledgements by identifier."""

    def __init__(self, host: str, port: int, *, tls: bool = False, secret: str = "", timeout: float = 30.0, name: str | None = None) -> None:
        raw = socket.create_connection((host, port), timeout)
        if tls:
            # Endpoints commonly have certificates of their own making; the shared key is what authenticates.
            context = ssl.create_default_context()
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
            raw = context.wrap_socket(raw)
        self.socket, self.held = raw, b""
        if secret:
            self._handshake(secret, name or socket.gethostname())

    def _read(self):
        while True:
            if self.held:
                try:
                    value, end = msgpack.unpack(self.held)
                    self.held = self.held[end:]
                    return value
                except (IndexError, ValueError, OSError, __import__("struct").error):
                    pass
            more = self.socket.recv(65536)
            if not more:
                raise ConnectionError("closed by the other side")
            self.held += more

    def _handshake(self, secret: str, name: str) -> None:
        helo = self._read()
        if helo[0] != "HELO":
            raise ConnectionError(f"HELO was expected, not {helo[0]}")
        nonce, auth = helo[1].get("nonce", b""), helo[1].get("auth", b"")
        as_bytes = lambda x: x if isinstance(x, bytes) else x.encode()
        salt = os.urandom(16)
        digest = hashlib.sha512(salt + name.encode() + as_bytes(nonce) + secret.encode()).hexdigest()
        if as_bytes(auth):
            raise ConnectionError("user names are not supported")
        self.socket.sendall(msgpack.pack(["PING", name, salt, digest, "", ""]))
        pong = self._read()
        if pong[0] != "PONG" or not pong[1]:
            raise ConnectionError(f"refused: {pong[2] if len(pong) > 2 else pong}")
        if pong[4] != hashlib.sha512(salt + pong[3].encode() + as_bytes(nonce) + secret.encode()).hexdigest():
            raise ConnectionError("the other side doesn't know the shared key")

    def send(self, chunk_id: str, data: bytes) -> None:
        self.socket.sendall(data)

    def ping(self) -> None:
        """A message without records and without an identifier: nobody answers it."""
        self.socket.sendall(msgpack.pack(["ping", [], {"size": 0}]))

    def acknowledged(self) -> str:
        return self._read()["ack"]

    def close(self) -> None:
        self.socket.close()


class ApiConnection:
    """Chunks posted as compressed JSON; a status of 300 or more is an error."""

    def __init__(self, url: str, key: str, timeout: float = 30.0) -> None:
        self.url, self.key, self.timeout, self.done = url, key, timeout, []

    def send(self, chunk_id: str, data: bytes) -> None:
        request = urllib.request.Request(self.url, data, {"Content-Type": "application/json", "Content-Encoding": "gzip", "DD-API-KEY": self.key}, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            if answer.status >= 300:
                raise ConnectionError(f"status {answer.status}")
        self.done.append(chunk_id)

    def ping(self) -> None:
        """Requests stand by themselves: there is nothing to keep alive."""

    def acknowledged(self) -> str:
        return self.done.pop(0)

    def close(self) -> None:
        pass


def seconds(text: str) -> float:
    """'30s', '5m', '1h', '500ms' or a plain number as seconds."""
    for unit, n in (("ms", 0.001), ("s", 1), ("m", 60), ("h", 3600)):
        if text.endswith(unit) and text[: -len(unit)].replace(".", "").isdigit():
            return float(text[: -len(unit)]) * n
    return float(text)


def opener(output: Output) -> Callable[[], Connection]:
    """How to connect to the endpoint of an output."""
    u = output.upstream
    if output.type == "fluentdForward":
        host, _, port = u["address"].rpartition(":")
        tls, secret = str(u.get("tls", "false")).lower() == "true", u.get("secret", "")
        return lambda: ForwardConnection(host, int(port), tls=tls, secret=secret)
    if output.type == "datadog":
        url, timeout = u["address"], seconds(u.get("httpTimeout", "30s"))
        return lambda: ApiConnection(url, os.environ.get("DD_API_KEY", u.get("apiKey", "")), timeout)
    raise ConfigError(f"no endpoint for {output.type}")


def send_all(
    chunks: Iterator[tuple[str, bytes]], connect: Callable[[], Connection], *, tries: int | None = TRIES, wait: float = WAIT, max_duration: float | None = None, ping: float = PING, clock: Callable[[], float] = time.monotonic
) -> Iterator[str]:
    """Identifiers of chunks as they are acknowledged; chunks are taken from the iterator as they are sent, so that few are held.

    After an error those in flight are sent again, in order, over a new connection; with `tries` None that goes on without end. After `max_duration` seconds
    the connection is closed, once what is in flight is acknowledged, and opened anew. When the next chunk is `ping` seconds or more in coming, the connection gets a sign of life before it.
    """
    failed, opened_at, last_sent = 0, 0.0, 0.0
    connection: Connection | None = None
    again: list[tuple[str, bytes]] = []
    flight: list[tuple[str, bytes]] = []
    more = True
    while more or again or flight:
        try:
            worn = connection is not None and bool(max_duration) and clock() - opened_at > max_duration
            while not worn and len(flight) < UNACKNOWLEDGED and (again or more):
                if not again:
                    c = next(chunks, None)
                    more = c is not None
                    if c is None:
                        break
                    again.append(c)
                if connection is None:
                    connection, opened_at = connect(), clock()
                    last_sent = opened_at
                elif clock() - last_sent >= ping:
                    connection.ping()
                connection.send(*again[0])
                last_sent = clock()
                flight.append(again.pop(0))
            if not flight:
                if worn:
                    connection.close()
                    connection = None
                continue
            done = connection.acknowledged()
            hit = [c for c in flight if c[0] == done]
            if hit:
                flight.remove(hit[0])
                failed = 0
                yield done
        except (OSError, ConnectionError, KeyError, TypeError):
            failed += 1
            if connection is not None:
                try:
                    connection.close()
                except OSError:
                    pass
                connection = None
            # Leftovers go first, each once, in order of their identifiers.
            again = sorted({c[0]: c for c in [*flight, *again]}.values())
            flight = []
            if tries is not None and failed >= tries:
                return
            time.sleep(wait)
    if connection is not None:
        connection.close()


def max_duration(output: Output) -> float | None:
    """How long a connection to the endpoint of an output may stay open."""
    return seconds(output.upstream["maxDuration"]) if output.upstream.get("maxDuration") else None


def deliver(chunks: DataFrame, connect: Callable[[], Connection], *, tries: int | None = TRIES, wait: float = WAIT, connections: int = 4, max_duration: float | None = None) -> DataFrame:
    """(chunk_id) of the chunks that were acknowledged. `connections` tasks send at a time, each over one connection."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), d.as_py()) for b in batches for i, d in zip(b.column(0), b.column(1)))
        done: list[str] = []
        for i in send_all(rows, connect, tries=tries, wait=wait, max_duration=max_duration):
            done.append(i)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["chunk_id"])
                done = []
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["chunk_id"])

    return chunks.select("chunk_id", "data").repartitionByRange(connections, "chunk_id").sortWithinPartitions("chunk_id").mapInArrow(run, "chunk_id string")
