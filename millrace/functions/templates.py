"""Templates such as `$app:${task[-1:]}` as expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ConfigError

_NAME = re.compile(r"\w+", re.ASCII)
_BRACED = re.compile(r"(\w+)(?:\[(-?\d*):(-?\d*)\])?", re.ASCII)


@dataclass(frozen=True)
class Part:
    """A literal, or a field with an optional slice of bytes."""

    literal: str = ""
    field: str = ""
    start: int = 0
    end: int | None = None
    sliced: bool = False


def parse(template: str) -> list[Part]:
    """The parts of a template; what isn't allowed is an error: `$$`, a `$` without a name, braces that don't close."""
    out: list[Part] = []
    at = 0
    while at < len(template):
        dollar = template.find("$", at)
        if dollar < 0:
            out.append(Part(literal=template[at:]))
            break
        if dollar > at:
            out.append(Part(literal=template[at:dollar]))
        at = dollar + 1
        if template.startswith("{", at):
            close = template.find("}", at)
            if close < 0:
                raise ConfigError(f"unenclosed variable quotes: '{template}'")
            inner = template[at + 1 : close]
            m = _BRACED.fullmatch(inner)
            if not m:
                raise ConfigError(f"invalid variable '${{{inner}}}' in '{template}'")
            sliced = m[2] is not None
            out.append(Part(field=m[1], start=int(m[2] or 0) if sliced else 0, end=int(m[3]) if sliced and m[3] else None, sliced=sliced))
            at = close + 1
        else:
            m = _NAME.match(template, at)
            if not m:
                raise ConfigError(f"invalid variable at {dollar} in '{template}'")
            out.append(Part(field=m[0]))
            at = m.end()
    return out


def fields_of(template: str) -> list[str]:
    return [p.field for p in parse(template) if p.field]


def slice_bytes(value: Column, start: int, end: int | None) -> Column:
    """``value[start:end]`` in bytes, as Python slices: negative places count from the end, and places beyond are moved in.

    For text of several bytes a character, a slice through a character loses that character.
    """
    n = F.octet_length(value)
    first = F.lit(start) if start >= 0 else F.greatest(n + F.lit(start), F.lit(0))
    last = n if end is None else F.least(F.lit(end), n) if end >= 0 else n + F.lit(end)
    size = F.greatest(last - first, F.lit(0))
    by_char = F.substr(value, first + 1, size)
    by_byte = F.replace(F.make_valid_utf8(F.substr(value.cast("binary"), first + 1, size).cast("string")), F.lit("�"), F.lit(""))
    return F.when(F.length(value) == n, by_char).otherwise(by_byte)


def expand(template: str, column) -> Column:
    """The template as an expression; `column` gives the column of a field, or raises for one that is unknown."""
    cols = [F.lit(p.literal) if not p.field else slice_bytes(column(p.field), p.start, p.end) if p.sliced else column(p.field) for p in parse(template)]
    if not cols:
        return F.lit("")
    return cols[0] if len(cols) == 1 else F.concat(*cols)
