"""Regular expressions of RE2 syntax, replacement templates and globs, translated for the JVM's engine."""

from __future__ import annotations

import re

from millrace.errors import ConfigError

_CLASSES = {"s": r"\t\n\f\r ", "d": "0-9", "w": "0-9A-Za-z_"}


def to_java(pattern: str) -> tuple[str, dict[str, int]]:
    """(pattern, group numbers by name). Names of groups become numbers; `$`, `.`, `\\s` and the like keep RE2's meaning.

    What RE2 lacks (look-around, back references, possessive repeats) is an error here too.
    """
    out: list[str] = []
    names: dict[str, int] = {}
    groups = 0
    i, n = 0, len(pattern)
    flags: list[tuple[bool, bool]] = [(False, False)]  # (multi-line, dot matches newline), by depth
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise ConfigError(f"trailing backslash in pattern: {pattern}")
            d = pattern[i + 1]
            if d == "Q":
                end = pattern.find("\\E", i + 2)
                text = pattern[i + 2 : end if end >= 0 else n]
                out.append(re.sub(r"([^\w\s])", r"\\\1", text))
                i = n if end < 0 else end + 2
                continue
            if d in "123456789":
                raise ConfigError(f"back references are not supported: {pattern}")
            if d in "sdw":
                out.append(f"[{_CLASSES[d]}]")
            elif d in "SDW":
                out.append(f"[^{_CLASSES[d.lower()]}]")
            elif d == "z":
                out.append(r"\z")
            elif d in "pP" and pattern.startswith("{", i + 2):
                end = pattern.find("}", i)
                name = pattern[i + 3 : end]
                neg = name.startswith("^")
                out.append(f"\\{'P' if neg else d}{{{'Is' if len(name.lstrip('^')) > 2 else ''}{name.lstrip('^')}}}")
                i = end + 1
                continue
            elif d == "C":
                raise ConfigError(f"\\C is not supported: {pattern}")
            else:
                out.append("\\" + d)
            i += 2
        elif c == "[":
            end, text = _char_class(pattern, i)
            out.append(text)
            i = end
        elif c == "(":
            flags.append(flags[-1])
            if pattern.startswith("(?", i):
                m = re.match(r"\(\?P?<(\w+)>", pattern[i:])
                f = re.match(r"\(\?([imsU]*)(?:-([imsU]+))?(:|\))", pattern[i:])
                if m:
                    groups += 1
                    if m[1] in names:
                        raise ConfigError(f"group {m[1]} occurs twice: {pattern}")
                    names[m[1]] = groups
                    out.append("(")
                    i += len(m[0])
                elif f:
                    if "U" in f[1] + (f[2] or ""):
                        raise ConfigError(f"flag U is not supported: {pattern}")
                    multi, dot = flags[-1]
                    on, off = f[1], f[2] or ""
                    state = ((multi or "m" in on) and "m" not in off, (dot or "s" in on) and "s" not in off)
                    if f[3] == ")":
                        flags.pop()
                        flags[-1] = state
                    else:
                        flags[-1] = state
                    keep = "".join(x for x in on if x == "i")
                    gone = "".join(x for x in off if x == "i")
                    out.append(f"(?{keep}{'-' + gone if gone else ''}{f[3]}" if keep or gone or f[3] == ":" else "")
                    i += len(f[0])
                else:
                    raise ConfigError(f"look-around and other extensions are not supported: {pattern}")
            else:
                groups += 1
                out.append("(")
                i += 1
        elif c == ")":
            if len(flags) < 2:
                raise ConfigError(f"unbalanced parenthesis: {pattern}")
            flags.pop()
            out.append(c)
            i += 1
        elif c == "$":
            out.append(r"(?=\n|\z)" if flags[-1][0] else r"\z")
            i += 1
        elif c == "^":
            out.append(r"(?<=\n|\A)" if flags[-1][0] else r"\A")
            i += 1
        elif c == ".":
            out.append(r"[\s\S]" if flags[-1][1] else r"[^\n]")
            i += 1
        elif c in "*+?}" and pattern.startswith("+", i + 1):
            raise ConfigError(f"possessive repeats are not supported: {pattern}")
        else:
            out.append(c)
            i += 1
    if len(flags) != 1:
        raise ConfigError(f"unbalanced parenthesis: {pattern}")
    java = "".join(out)
    _probe(java, pattern)
    return java, names


def _probe(java: str, pattern: str) -> None:
    """Fails on a pattern no engine takes, while the program is read and not when it runs."""
    try:
        import regex as engine
    except ImportError:
        return
    try:
        engine.compile(java.replace(r"\z", r"\Z"))
    except engine.error as e:
        raise ConfigError(f"invalid pattern {pattern}: {e}") from None


def _char_class(pattern: str, i: int) -> tuple[int, str]:
    """(end, text) of the character class that opens at i."""
    j, text = i + 1, "["
    if pattern.startswith("^", j):
        text += "^"
        j += 1
    first = True
    while j < len(pattern):
        c = pattern[j]
        if c == "]" and not first:
            return j + 1, text + "]"
        if pattern.startswith("[:", j):
            end = pattern.find(":]", j)
            if end > 0:
                name = pattern[j + 2 : end]
                posix = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "0-9a-zA-Z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "punct": r"!-/:-@\[-`{-~", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f", "blank": r"\t "}
                if name not in posix:
                    raise ConfigError(f"unknown class [:{name}:]: {pattern}")
                text += posix[name]
                j = end + 2
                first = False
                continue
        if c == "\\" and j + 1 < len(pattern):
            d = pattern[j + 1]
            text += _CLASSES[d] if d in _CLASSES else "\\" + d
            j += 2
        elif c in "[&~":
            text += "\\" + c
            j += 1
        elif c == "]":
            text += r"\]"
            j += 1
        else:
            text += c
            j += 1
        first = False
    raise ConfigError(f"missing ]: {pattern}")


def replacement_to_java(template: str, names: dict[str, int], groups: int) -> str:
    """A replacement with `$1`, `${name}` and `$$`. `$1x` names the group `1x`, which there isn't: it gives nothing."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c != "$":
            out.append("\\\\" if c == "\\" else c)
            i += 1
            continue
        if template.startswith("$$", i):
            out.append("\\$")
            i += 2
            continue
        m = re.compile(r"\$(?:\{(\w+)\}|(\w+))", re.ASCII).match(template, i)
        if not m:
            out.append("\\$")
            i += 1
            continue
        name = m[1] or m[2]
        number = int(name) if name.isdigit() else names.get(name)
        if number is not None and number <= groups:
            follows = template[m.end() : m.end() + 1]
            # A digit that follows must not join the number.
            out.append(f"${number}" + (f"\\{follows}" if follows.isdigit() else ""))
            i = m.end() + bool(follows.isdigit())
        else:
            i = m.end()
    return "".join(out)


def group_count(java: str) -> int:
    """Capturing groups of a translated pattern."""
    bare = re.sub(r"\\.", "", java, flags=re.S)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)", bare))


def glob_to_java(glob: str) -> str:
    """An anchored glob: `*` and `**` any text, `?` a character, `[..]`, `[!..]`, `{a,b}`, `\\` before a plain character."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\":
            if i + 1 >= len(glob):
                raise ConfigError(f"trailing backslash in glob: {glob}")
            i += 1
            out.append(_quote(glob[i]))
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ConfigError(f"missing ] in glob: {glob}")
            body = glob[i + 1 : end]
            neg = body.startswith("!")
            body = body[1:] if neg else body
            out.append("[" + ("^" if neg else "") + re.sub(r"([\\\[\]&^~])", r"\\\1", body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(_quote(c))
        i += 1
    if depth:
        raise ConfigError(f"missing }} in glob: {glob}")
    return r"(?s)\A" + "".join(out) + r"\z"


def _quote(c: str) -> str:
    return c if c.isalnum() or c in "_ \n" or ord(c) > 127 else "\\" + c
