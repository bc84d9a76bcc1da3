"""Whether a group of a pattern takes part in a match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spans(java: str) -> list[tuple[int, int, int]]:
    """(number, start, end) of each group, numbered for capturing ones, 0 for others."""
    out, stack, number, i = [], [], 0, 0
    while i < len(java):
        c = java[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            j = i + 2 if java.startswith("[^", i) else i + 1
            while j < len(java) and (java[j] != "]" or j == i + 1):
                j += 2 if java[j] == "\\" else 1
            i = j + 1
            continue
        if c == "(":
            capturing = not java.startswith("(?", i)
            number += capturing
            stack.append((number if capturing else 0, i))
        elif c == ")" and stack:
            n, a = stack.pop()
            out.append((n, a, i + 1))
        i += 1
    return out


def always_takes_part(java: str, i: int) -> bool:
    """Whether group i is part of every match: neither it nor a group around it is optional or one of several choices."""
    spans = _spans(java)
    a, b = next((a, b) for n, a, b in spans if n == i)
    for n, x, y in spans:
        if x <= a and y >= b:
            if re.match(r"[?*]|\{0?,|\{0\}", java[y:]):
                return False
            if _has_choice(java[x + 1 : y - 1]) and (x, y) != (a, b):
                return False
    return not _has_choice(java)


def _has_choice(body: str) -> bool:
    bare = re.sub(r"\\.", "", body, flags=re.S)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    while (inner := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = inner
    return "|" in bare


_OPTIONAL = re.compile(r"\?\??|\*\??|\{0?,\d*\}\??")


def probe(value: Column, java: str, i: int) -> Column:
    """Whether group i took part in the first match of `value`: the pattern with that group required finds the same match.

    Where a group could be left out or be empty at one place alike, it counts as taking part.
    """
    spans = _spans(java)
    a, b = next((a, b) for n, a, b in spans if n == i)
    required = java
    # The group and those around it lose what makes them optional, the last in the pattern first, so that places before stay.
    for y in sorted({y for _, x, y in spans if x <= a and y >= b}, reverse=True):
        m = _OPTIONAL.match(required, y)
        if m:
            required = required[:y] + required[m.end() :]
    return value.rlike(required) & (F.regexp_extract(value, java, 0) == F.regexp_extract(value, required, 0))
