"""Predicates on fields: all must hold, and the cheapest are tested first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.functions.patterns import glob_to_java, to_java


@dataclass(frozen=True)
class Predicate:
    """A test of one value, with its relative cost and a description for listings."""

    tag: str
    operand: str
    cost: float
    line: int | None = None

    def column(self, value: Column) -> Column:
        v, x = value, self.operand
        match self.tag:
            case "str" | "str-eq":
                return v == F.lit(x)
            case "str-not":
                return v != F.lit(x)
            case "str-any":
                return F.octet_length(v) > 0
            case "str-start":
                return v.startswith(F.lit(x))
            case "str-end":
                return v.endswith(F.lit(x))
            case "str-contain":
                return v.contains(F.lit(x))
            case "glob":
                return v.rlike(glob_to_java(x))
            case "regex":
                return v.rlike(to_java(x)[0])
            case "len-gt":
                return F.octet_length(v) > int(x)
            case "len-lt":
                return F.octet_length(v) < int(x)
        raise ConfigError(f"Unsupported value-match tag: !!{self.tag}", self.line)

    def describe(self) -> str:
        return f"!!{self.tag} {self.operand}".rstrip()


def predicate(tag: str, operand: str, line: int | None = None, column: int | None = None) -> Predicate:
    """The predicate of a tag, verified: an unknown tag, a missing operand, a bad pattern or number are errors."""
    n = len(operand.encode())
    # Relative costs.
    costs = {"str": 1 + n / 2, "str-eq": 1 + n / 2, "str-not": 1 + n / 2, "str-any": 0, "str-start": 1 + n / 2, "str-end": 1 + n / 2, "str-contain": 500 + n, "glob": 2000 + n, "regex": 20000 + n, "len-gt": 0, "len-lt": 0}
    if tag not in costs:
        raise ConfigError(f"Unsupported value-match tag: !!{tag}", line, column)
    if tag == "str-any":
        if operand:
            raise ConfigError("!!str-any takes no value", line, column)
    elif not operand:
        raise ConfigError(f"!!{tag} needs a value", line, column)
    if tag in ("len-gt", "len-lt"):
        try:
            int(operand)
        except ValueError:
            raise ConfigError(f"!!{tag} needs a whole number: {operand}", line, column) from None
    p = Predicate(tag, operand, costs[tag], line)
    if tag == "glob":
        glob_to_java(operand)
    elif tag == "regex":
        to_java(operand)
    return p


def ordered(match: dict[str, Predicate]) -> list[tuple[str, Predicate]]:
    """Fields and predicates, cheapest first; equal costs keep their order."""
    return sorted(match.items(), key=lambda x: x[1].cost)


def match_column(match: dict[str, Predicate], column) -> Column:
    """All predicates together: in this order, as conjunctions stop at the first that fails."""
    out: Column | None = None
    for field, p in ordered(match):
        c = p.column(column(field))
        out = c if out is None else out & c
    return F.lit(True) if out is None else out
