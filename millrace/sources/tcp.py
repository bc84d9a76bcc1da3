"""A streaming source of lines that senders write to a TCP port, for Spark's data source interface.

The listener lives on the driver, as a port has one owner. Lines stay in memory until the batch that holds them is committed, and a batch that
runs again gets the same lines; what was not committed when the driver dies is lost, as with any sender that doesn't wait for an answer.
Large flows should write to files or a log service that the executors read by themselves.
"""

from __future__ import annotations

import socketserver
import threading
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "connection string, line_no long, line string"
#: Lines given out at a time, and lines held before senders have to wait.
BATCH, HELD = 50_000, 500_000


class Listener:
    """Lines by number, of all connections."""

    _open: dict[tuple[str, int], Listener] = {}

    def __init__(self, host: str, port: int) -> None:
        self.lines: list[tuple[str, int, str]] = []
        self.first = 0
        self.room = threading.Condition()
        outer = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                name = f"{self.client_address[0]}:{self.client_address[1]}"
                n = 0
                for raw in self.rfile:
                    with outer.room:
                        outer.room.wait_for(lambda: len(outer.lines) < HELD)
                        outer.lines.append((name, n, raw.rstrip(b"\n").decode("utf-8", "replace")))
                    n += 1

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self.server = Server((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @classmethod
    def at(cls, host: str, port: int) -> Listener:
        key = (host, port)
        if key not in cls._open:
            cls._open[key] = cls(host, port)
        return cls._open[key]

    def take(self, start: int, end: int | None = None) -> tuple[list[tuple[str, int, str]], int]:
        with self.room:
            if start > self.first + len(self.lines):
                # A new listener after a restart: what it holds comes after all that was read before.
                self.first = start
            a = max(0, start - self.first)
            b = min(len(self.lines), a + BATCH) if end is None else max(a, end - self.first)
            return self.lines[a:b], self.first + b

    def forget(self, before: int) -> None:
        with self.room:
            n = max(0, before - self.first)
            del self.lines[:n]
            self.first += n
            self.room.notify_all()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
        for k in [k for k, v in self._open.items() if v is self]:
            del self._open[k]


class SyslogTcpReader(SimpleDataSourceStreamReader):
    def __init__(self, host: str, port: int) -> None:
        self.listener = Listener.at(host, port)

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.listener.take(start["line"])
        return iter(rows), {"line": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.listener.take(start["line"], end["line"])[0])

    def commit(self, end: dict) -> None:
        self.listener.forget(end["line"])


class SyslogTcpSource(DataSource):
    """`spark.dataSource.register(SyslogTcpSource)`, then `spark.readStream.format("syslog_tcp").option("address", "0.0.0.0:5140")`."""

    @classmethod
    def name(cls) -> str:
        return "syslog_tcp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SyslogTcpReader:
        host, _, port = self.options.get("address", "localhost:5140").rpartition(":")
        return SyslogTcpReader(host or "localhost", int(port))
