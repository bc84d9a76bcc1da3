"""Framing of lines that arrive over time: a record ends when the next one starts, or when its connection falls silent."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.schema import ORDER, SOURCE
from millrace.session import ship
from millrace.sources.syslog import BUFFER

_START = re.compile(rb"<[0-9]{1,3}>1 ")


def starts(line: bytes) -> bool:
    return len(line) >= 32 and _START.match(line) is not None


class Framer:
    """The unfinished record of one connection."""

    def __init__(self, held: str | None = None, limit: int = BUFFER) -> None:
        self.lines: list[str] = [] if held is None else held.split("\n")
        self.size = sum(len(x.encode()) + 1 for x in self.lines)
        self.limit = limit

    def feed(self, line: str) -> list[str]:
        """Records that this line completes. The first line of a connection is taken as it is."""
        out: list[str] = []
        raw = line.encode()
        if self.lines and starts(raw):
            out.append("\n".join(self.lines))
            self.lines, self.size = [], 0
        self.lines.append(line)
        self.size += len(raw) + 1
        if self.size > self.limit:
            out += self.flush()
        return out

    def flush(self) -> list[str]:
        """The unfinished record as it is, if it looks like one; anything else is discarded."""
        text = "\n".join(self.lines)
        self.lines, self.size = [], 0
        return [text] if starts(text.encode()) else []

    @property
    def held(self) -> str | None:
        return "\n".join(self.lines) if self.lines else None


def frame_stream(lines: DataFrame, source: str, line: str, order: str, idle_seconds: float = 1.0, limit: int = BUFFER) -> DataFrame:
    """(source, order, record) of a stream of lines, keyed by connection.

    Lines of a batch are taken by `order`. A record stays open until the next starts or nothing came for `idle_seconds`; a line that continues it after that
    opens a record of its own, which the parser will reject. Records of a connection are numbered in order of completion.
    """
    ship(lines.sparkSession)
    wait = max(1, int(idle_seconds * 1000))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else (None, 0)
        framer = Framer(held or None, limit)
        out: list[str] = []
        if state.hasTimedOut:
            out += framer.flush()
        else:
            rows = pd.concat(list(frames)).sort_values("_mr_no", kind="stable")
            for text in rows["_mr_line"]:
                out += framer.feed(text or "")
        state.update((framer.held or "", n + len(out)))
        if framer.lines:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({SOURCE: [key[0]] * len(out), ORDER: range(n, n + len(out)), "record": out})

    named = lines.selectExpr(f"`{source}` as _mr_conn", f"coalesce(`{line}`, '') as _mr_line", f"`{order}` as _mr_no")
    return named.groupBy("_mr_conn").applyInPandasWithState(run, f"{SOURCE} string, {ORDER} long, record string", "held string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
