"""Rewrites of a field as it is written: other fields put before it, escapes decoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import Rewrite
from millrace.functions.text import unescape
from millrace.schema import UNESCAPED


def rewritten(field: str, chain: list[Rewrite]) -> Column:
    """The value of a field after its chain of rewrites; a missing value stays missing."""
    value = F.col(f"`{field}`")
    last = chain[-1].type if chain else "copy"
    out = F.when(F.col(UNESCAPED), value).otherwise(unescape(value)) if last == "unescape" else value
    for r in reversed(chain[:-1] if chain and chain[-1].type != "inline" else chain):
        other = F.col(f"`{r.field}`")
        out = F.concat(F.when(F.octet_length(other) > 0, F.concat(F.lit(f"{r.field}="), other, F.lit(" "))).otherwise(F.lit("")), out)
    return F.when(F.octet_length(value) > 0, out).otherwise(value)
