"""Words of a text: its longest stretches of letters and digits, in lower case, without those that hold a digit."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRETCH = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    out = _STRETCH.findall(text.lower())
    return [w for w in out if w.isalpha() or not any(c.isdigit() for c in w)]


def words_column(text: Column) -> Column:
    """The words joined by single spaces, as an expression: nothing leaves the JVM. Null stays null.

    Digits are those of any script, with raised and lowered ones, as `str.isdigit` takes them.
    """
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    plain = F.regexp_replace(spaced, r"(?<![^ ])[^ ]*[\p{Nd}²³¹⁰-⁹₀-₉][^ ]*(?![^ ])", "")
    return F.trim(F.regexp_replace(plain, " +", " "))
