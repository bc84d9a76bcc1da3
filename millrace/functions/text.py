"""Text functions of programs as expressions; lengths are in bytes throughout."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ConfigError

#: Stands for a pair of backslashes while other escapes are decoded; a private character that logs don't hold.
_SENTINEL = "\ue0f7"
# Escapes and what they stand for.
ESCAPES = {"\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t"}

# Fixed value: e-mail addresses as they are redacted. The local part has letters, digits, `.`, `_` and `-`, isn't preceded by `/`, and continues from the
# address before; the domain's first dot is followed by a letter or digit, or the text ends there; a domain that starts and ends with a digit is a number.
EMAIL = (
    r"(?:\G(?<=[A-Za-z0-9])|(?<![A-Za-z0-9._/-])[A-Za-z0-9._-]*+(?<=[A-Za-z0-9]))@(?:[A-Za-z][A-Za-z0-9_-]*+(?:\z|\.\z|\.[A-Za-z0-9][A-Za-z0-9._-]*+)"
    r"|[0-9][A-Za-z0-9_-]*+\.\z|[0-9]\z|[0-9][A-Za-z0-9_-]*+(?<![0-9])\z|[0-9][A-Za-z0-9_-]*+\.[A-Za-z0-9][A-Za-z0-9._-]*+(?<![0-9]))"
)
REDACTED = "REDACTED"


def has_email(value: Column) -> Column:
    # A plain search for @ goes first: most values have none.
    return value.contains("@") & value.rlike(EMAIL)


def redact_email(value: Column) -> Column:
    return F.when(value.contains("@"), F.regexp_replace(value, F.lit(EMAIL), F.lit(REDACTED))).otherwise(value)


def unescape(value: Column) -> Column:
    """Decodes \\b \\f \\n \\r \\t and double backslashes; other escapes, and a last lone backslash, stay."""
    v = F.replace(value, F.lit("\\\\"), F.lit(_SENTINEL))
    for escape, plain in ESCAPES.items():
        v = F.replace(v, F.lit(escape), F.lit(plain))
    decoded = F.replace(v, F.lit(_SENTINEL), F.lit("\\"))
    return F.when(value.contains("\\"), decoded).otherwise(value)


def clean_end(value: Column) -> Column:
    """Text from bytes that may end inside a character: what is broken after the last plain character goes."""
    return F.regexp_replace(F.make_valid_utf8(value), "�+\\z", "")


def first_bytes(value: Column, n: int) -> Column:
    return clean_end(F.substr(value.cast("binary"), F.lit(1), F.lit(n)).cast("string"))


def truncate(value: Column, max_len: int, suffix: str) -> Column:
    """`max_len` bytes and the suffix, where the value is longer than both together; a character cut through goes."""
    limit = max_len + len(suffix.encode())
    return F.when(F.octet_length(value) > limit, F.concat(first_bytes(value, max_len), F.lit(suffix))).otherwise(value)


# Labels cut from the start or the end of a value


@dataclass(frozen=True)
class LabelPattern:
    """`left`, then any text (`*`) or a run of bytes of a class, then `right`."""

    left: str
    right: str
    char_class: str | None  # as for a regular expression, None for `*`


def label_pattern(pattern: str) -> LabelPattern:
    """Reads a pattern: one `*` or `[class]` between two boundaries; `\\[ \\] \\* \\\\` stand for themselves. An unescaped `*` wins over brackets."""
    star = _find(pattern, "*")
    if star >= 0:
        if _find(pattern, "*", star + 1) >= 0:
            raise ConfigError(f"more than one *: {pattern}")
        return LabelPattern(_plain(pattern[:star]), _plain(pattern[star + 1 :]), None)
    a = _find(pattern, "[")
    b = _find(pattern, "]", a + 1) if a >= 0 else -1
    if a < 0 or b < 0:
        raise ConfigError(f"pattern has neither * nor [..]: {pattern}")
    return LabelPattern(_plain(pattern[:a]), _plain(pattern[b + 1 :]), _class(pattern[a + 1 : b]))


def _find(s: str, c: str, at: int = 0) -> int:
    while at < len(s):
        if s[at] == "\\":
            at += 2
            continue
        if s[at] == c:
            return at
        at += 1
    return -1


def _plain(s: str) -> str:
    return re.sub(r"\\([\[\]*\\])", r"\1", s)


def _class(body: str) -> str:
    neg = body.startswith("^")
    body = body[1:] if neg else body
    if not body:
        raise ConfigError("empty character class")
    out, i = "", 0

    def literal(c: str) -> str:
        return ("\\" if c in r"[]\^-&~" else "") + c

    units: list[str] = []
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            units.append(body[i + 1])
            i += 2
            out += "x"
        else:
            units.append(body[i])
            out += "-" if body[i] == "-" else "x"
            i += 1
    text, k = "", 0
    while k < len(units):
        if out[k] == "-" and 0 < k < len(units) - 1 and out[k + 1] == "-":
            raise ConfigError(f"double hyphen in character class: [{body}]")
        if k + 2 < len(units) and out[k + 1] == "-" and out[k] != "-":
            if out[k + 2] == "-":
                raise ConfigError(f"double hyphen in character class: [{body}]")
            if ord(units[k]) > ord(units[k + 2]):
                raise ConfigError(f"range out of order in character class: [{body}]")
            text += literal(units[k]) + "-" + literal(units[k + 2])
            k += 3
        else:
            text += literal(units[k])
            k += 1
    return f"[{'^' if neg else ''}{text}]"


def check_label(p: LabelPattern, at_start: bool) -> LabelPattern:
    """`*` needs a boundary on its inner side, where the label ends."""
    if p.char_class is None and not (p.right if at_start else p.left):
        raise ConfigError("* needs a boundary where the label ends")
    return p


def _quoted(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s, flags=re.ASCII)


def cut_head(value: Column, p: LabelPattern, max_len: int) -> tuple[Column, Column, Column]:
    """(found, label, rest) of a label at the start of a value: `left`, label and `right` are cut."""
    has_left = value.startswith(F.lit(p.left)) if p.left else F.lit(True)
    x = F.substr(value, F.lit(len(p.left) + 1)) if p.left else value
    if p.right:
        k = F.instr(x, F.lit(p.right))
        tag = F.substr(x, F.lit(1), F.greatest(k - 1, F.lit(0)))
        ok = has_left & (k > 0) & (F.octet_length(tag) + F.lit(len(p.right.encode())) <= max_len)
        if p.char_class:
            ok = ok & x.rlike(rf"\A(?s:{p.char_class})") & tag.rlike(rf"\A{p.char_class}*\z")
        return ok, trimmed(tag), F.substr(x, F.lit(len(p.right)) + k)
    tag = F.regexp_extract(x, rf"\A({p.char_class}{{1,{max_len}}})", 1)
    return has_left & (F.octet_length(tag) > 0), trimmed(tag), F.substr(x, F.length(tag) + 1)


def cut_tail(value: Column, p: LabelPattern, max_len: int) -> tuple[Column, Column, Column]:
    """(found, label, rest) of a label at the end of a value."""
    has_right = value.endswith(F.lit(p.right)) if p.right else F.lit(True)
    x = F.substr(value, F.lit(1), F.greatest(F.length(value) - len(p.right), F.lit(0))) if p.right else value
    if p.left:
        tag = F.substring_index(x, p.left, -1)
        ok = has_right & x.contains(p.left) & (F.octet_length(tag) + F.lit(len(p.left.encode())) <= max_len)
        if p.char_class:
            ok = ok & (x.rlike(rf"(?s:{p.char_class})\z") | (F.octet_length(x) == 0)) & tag.rlike(rf"\A{p.char_class}*\z")
        return ok, trimmed(tag), F.substr(x, F.lit(1), F.greatest(F.length(x) - F.length(tag) - len(p.left), F.lit(0)))
    tag = F.regexp_extract(x, rf"({p.char_class}{{1,{max_len}}})\z", 1)
    return has_right & (F.octet_length(tag) > 0), trimmed(tag), F.substr(x, F.lit(1), F.length(x) - F.length(tag))


def trimmed(value: Column) -> Column:
    """Without blanks and control characters at both ends."""
    return F.btrim(value, F.lit("".join(map(chr, range(33)))))
