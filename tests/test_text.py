import re
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import ConfigError
from millrace.functions.patterns import glob_to_java, group_count, replacement_to_java, to_java
from millrace.functions.templates import expand, parse
from millrace.functions.text import EMAIL, cut_head, cut_tail, has_email, label_pattern, redact_email, truncate, unescape
from millrace.functions.times import parse_time

many = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


# Labels at the ends of a value

LABELS = [
    # (at the start?, pattern, longest, value, (label, rest) or None)
    (True, "<*>", 20, "<weaver> loom 7 idle", ("weaver", " loom 7 idle")),
    (True, "<*>", 7, "<weaver> loom 7 idle", ("weaver", " loom 7 idle")),  # label and closing mark fit exactly
    (True, "<*>", 6, "<weaver> loom 7 idle", None),
    (True, "<*>", 20, "weaver> loom", None),
    (True, "<*>", 20, "<>bare", ("", "bare")),
    (True, "*: ", 30, " \tmill 4 : grinds: on", ("mill 4", "grinds: on")),
    (True, "[0-9]-", 9, "0042-17-x", ("0042", "17-x")),
    (True, "[0-9]-", 9, "4a2-17", None),
    (True, "[^,],", 9, "rye,wheat,oat", ("rye", "wheat,oat")),
    (True, "[a-c]", 2, "abcabc", ("ab", "cabc")),  # without a boundary the longest allowed run is taken
    (True, "[\\]x]}", 9, "]x]}tail", ("]x]", "tail")),
    (False, "/*", 30, "depot/north/7", ("7", "depot/north")),
    (False, "/*", 30, "depot", None),
    (False, "#[0-9]", 5, "bale #123", ("123", "bale ")),
    (False, "#[0-9]", 5, "bale #12345", None),
    (False, "#[0-9]", 9, "bale #12b", None),
    (False, "([a-z])", 9, "spindle (worn)", ("worn", "spindle ")),
    (False, "([a-z])", 9, "spindle (worn) ", None),
    (False, "[a-z]", 4, "12-abcdef", ("cdef", "12-ab")),
    (False, "=*;", 12, "a=1;b= two ;", ("two", "a=1;b")),
]


def test_labels(spark):
    asked = []
    for at_start, pattern, most, text, _ in LABELS:
        p = label_pattern(pattern)
        asked.append(F.struct(*(cut_head if at_start else cut_tail)(F.lit(text), p, most)))
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(asked)]).first()
    assert [((r[1], r[2]) if r[0] else None) for r in got] == [want for *_, want in LABELS]


@many
@given(st.lists(st.text("ab<> -", max_size=12), min_size=60, max_size=60))
def test_labels_like_a_plain_cut(spark, texts):
    """A label between two marks, by the first closing one; and after the last mark."""
    p, q = label_pattern("<*>"), label_pattern("-*")

    def head(t):
        label, mark, rest = t[1:].partition(">")
        return (label.strip(), rest) if t.startswith("<") and mark and len(label) + 1 <= 6 else None

    def tail(t):
        rest, mark, label = t.rpartition("-")
        return (label.strip(), rest) if mark and len(label) + 1 <= 6 else None

    for cut, pattern, plain in ((cut_head, p, head), (cut_tail, q, tail)):
        got = column(spark, texts, lambda v: F.struct(*cut(v, pattern, 6)))
        assert [((g[1], g[2]) if g[0] else None) for g in got] == [plain(t) for t in texts]


@pytest.mark.parametrize("bad", ["[d--f]", "plain words", "*/*", "x[]y", "[9-0]", "[^]"])
def test_label_patterns_that_cannot_be(bad):
    with pytest.raises(ConfigError):
        label_pattern(bad)


# E-mail addresses

ADDRESSES = {
    "": "", "@": "@", "no address at all": "no address at all", "miller@flour.example": "REDACTED", "ask miller@flour.example, or ring": "ask REDACTED, or ring", "<m.i-l_l@sub.flour.example>": "<REDACTED>",
    "a@b.c;d@e.f": "REDACTED;REDACTED", "one@first.orgtwo@second.org": "REDACTEDREDACTED", "miller@localhost then": "miller@localhost then", "sent to miller@localhost": "sent to REDACTED", "cut at miller@flour.": "cut at REDACTED", "cut at miller@flour. Next": "cut at miller@flour. Next",
    "12@34.56": "12@34.56", "rate 12@34.5x": "rate REDACTED", "lock@9f3c77/4410": "lock@9f3c77/4410", "/srv/miller@flour.example": "/srv/miller@flour.example", "git://pull@flour.example": "git://pull@flour.example", "https://u:pw@flour.example": "https://u:REDACTED",
    "dot.@flour.example": "dot.@flour.example", "miller@-flour.example": "miller@-flour.example", "müller@flour.example": "müller@flour.example".replace("ller@flour.example", "REDACTED"), "two@@flour.example": "two@@flour.example",
}


def by_runs(text):
    """Redaction said another way: the text falls into runs of characters that addresses are made of, and single other ones; each @ between two runs is judged by them."""
    runs = re.findall(r"[A-Za-z0-9._-]+|[^A-Za-z0-9._-]", text)
    name = re.compile(r"[A-Za-z0-9._-]+")
    gone = [False] * len(runs)  # runs that went with the address before
    out, last = [], -1  # the run at which the last address ended
    for i, r in enumerate(runs):
        if r == "@" and 0 < i < len(runs) - 1 and name.fullmatch(runs[i - 1]) and name.fullmatch(runs[i + 1]):
            local, domain, ends = runs[i - 1], runs[i + 1], i + 2 == len(runs)
            follows = last == i - 1  # right after an address: its end serves as the local part
            bad_start = not follows and i > 1 and runs[i - 2] == "/"
            host, dot, rest = domain.partition(".")
            shaped = bool(rest) and rest[0].isalnum() or ends and not rest
            number = domain[0].isdigit() and domain[-1].isdigit() and len(domain) > 1
            if local[-1].isalnum() and domain[0].isalnum() and not bad_start and shaped and not number:
                if not follows:
                    gone[i - 1] = True
                out.append((i, follows))
                gone[i] = gone[i + 1] = True
                last = i + 1
    marks = {i for i, _ in out}
    return "".join("REDACTED" if i in marks else "" if gone[i] else r for i, r in enumerate(runs))


def test_addresses(spark):
    assert column(spark, list(ADDRESSES), redact_email) == list(ADDRESSES.values())
    assert column(spark, list(ADDRESSES), has_email) == [k != v for k, v in ADDRESSES.items()]
    assert {k: by_runs(k) for k in ADDRESSES} == ADDRESSES
    assert re.compile(EMAIL.replace("*+", "*").replace(r"\G", "").replace(r"\z", r"\Z"))


@many
@given(st.lists(st.text("ab1@.-_/ ", max_size=14), min_size=300, max_size=300))
def test_addresses_like_runs(spark, texts):
    got = column(spark, texts, redact_email)
    assert [(t, g) for t, g in zip(texts, got)] == [(t, by_runs(t)) for t in texts]


# Bytes, escapes, times


@many
@given(st.lists(st.text("aé世🌾", max_size=12), min_size=60, max_size=60), st.integers(1, 9))
def test_truncate(spark, texts, limit):
    def plain(t):
        raw = t.encode()
        return t if len(raw) <= limit + 3 else raw[:limit].decode("utf-8", "ignore") + "~~~"

    assert column(spark, texts, lambda v: truncate(v, limit, "~~~")) == [plain(t) for t in texts]


@many
@given(st.lists(st.text("\\nrtbfx ", max_size=12), min_size=60, max_size=60))
def test_unescape(spark, texts):
    known = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\\": "\\"}
    plain = lambda t: re.sub(r"\\(.)", lambda m: known.get(m[1], m[0]), t)
    assert column(spark, texts, unescape) == [plain(t) for t in texts]


@many
@given(st.lists(st.tuples(st.datetimes(datetime(1971, 1, 1), datetime(2199, 1, 1)), st.integers(-14 * 60, 14 * 60), st.sampled_from(["", ":"])), min_size=40, max_size=40))
def test_times(spark, cases):
    texts, want = [], []
    for t, minutes, colon in cases:
        sign, m = "-" if minutes < 0 else "+", abs(minutes)
        texts.append(f"{t.isoformat(timespec='microseconds')}{sign}{m // 60:02}{colon}{m % 60:02}")
        want.append((t.replace(tzinfo=timezone(timedelta(minutes=minutes))) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1))
    assert column(spark, texts, lambda v: F.unix_micros(parse_time(v))) == want


def test_times_by_hand(spark):
    zulu = {"1999-12-31T23:59:59Z": 946684799_000000, "1999-12-31T23:59:59.5Z": 946684799_500000, "1999-12-31T23:59:59.0000019Z": 946684799_000001}
    assert column(spark, list(zulu), lambda v: F.unix_micros(parse_time(v))) == list(zulu.values())
    none = ["", "soon", "1999-12-31", "1999-12-31 23:59:59Z", "1999-12-32T00:00:00Z", "1999-12-31T24:30:00Z", "1999-12-31T23:59Z", " 1999-12-31T23:59:59Z"]
    assert column(spark, none, parse_time) == [None] * len(none)


# Templates and patterns


def filled(spark, template, **fields):
    return spark.createDataFrame([fields]).select(expand(template, lambda f: F.col(f))).first()[0]


def test_templates(spark):
    assert filled(spark, "bin/$crop-${year}.csv", crop="rye", year="1887") == "bin/rye-1887.csv"
    assert filled(spark, "$crop$year", crop="rye", year="") == "rye"
    assert filled(spark, "${crop[:1]}${crop[-1:]}|${crop[1:-1]}|${crop[3:1]}|${crop[-9:2]}", crop="wheat") == "wt|hea||wh"
    for bad in ("a ${open", "50$", "$$", "${two words}"):
        with pytest.raises(ConfigError):
            parse(bad)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abcdef", max_size=9), st.integers(-12, 12), st.one_of(st.none(), st.integers(-12, 12))), min_size=40, max_size=40))
def test_slices_as_in_python(spark, cases):
    cols = [expand("${v[%s:%s]}" % (a, "" if b is None else b), lambda f, v=v: F.lit(v)) for v, a, b in cases]
    assert list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()) == [v[a:b] for v, a, b in cases]


MATCHES = [
    # (pattern, text, whether it matches): where the two dialects differ
    ("mill.rye", "mill\nrye", False), ("(?s)mill.rye", "mill\nrye", True), ("rye$", "rye\n", False), ("(?m)rye$", "rye\noat", True), (r"^\s$", "\x0b", False), (r"[[:digit:]]{2}", "a17", True), (r"\Q1+1\E", "1+1", True), (r"\Q1+1\E", "111", False),
    ("(?i:RYE) oat", "rye oat", True), ("(?i:RYE) oat", "rye OAT", False), ("[a&&z]", "&", True), (r"\p{Greek}", "λ", True), (r"\pN", "7", True), (r"\w", "é", False), ("x*?$", "", True),
]


def test_patterns(spark):
    got = spark.range(1).select(*[F.lit(t).rlike(to_java(p)[0]).alias(f"c{i}") for i, (p, t, _) in enumerate(MATCHES)]).first()
    assert [(p, g) for (p, _, _), g in zip(MATCHES, got)] == [(p, w) for p, _, w in MATCHES]
    assert to_java(r"(?P<a>x)(y(?P<b>z))")[1] == {"a": 1, "b": 3}
    for bad in ("(?!rye)", "(?<=rye)", r"(r)\1", "r*+", "(rye", "[rye", "rye\\", "(?P<n>r)(?P<n>y)", "+rye"):
        with pytest.raises(ConfigError):
            to_java(bad)


def test_replacements(spark):
    def run(pattern, new, text):
        java, names = to_java(pattern)
        return spark.range(1).select(F.regexp_replace(F.lit(text), F.lit(java), F.lit(replacement_to_java(new, names, group_count(java))))).first()[0]

    assert run(r"(\d+)(?P<unit>kg|t)\b", "${unit}:$1", "12kg, 3t") == "kg:12, t:3"
    assert run("(r)(y)", "$2$$${1}7$9", "rye") == "y$r7e"
    assert run("e", r"\d", "rye") == r"ry\d"


GLOBS = [("rye*.bin", "rye/2024.bin", True), ("rye*.bin", "my rye.bin", False), ("{rye,oat}-?", "oat-7", True), ("{rye,oat}-?", "oat-77", False), ("[!r-t]ye", "aye", True), ("[!r-t]ye", "rye", False), ("a\\?b", "a?b", True), ("a\\?b", "axb", False), ("a**b", "a\n\nb", True), ("r.e", "rye", False)]


def test_globs(spark):
    got = spark.range(1).select(*[F.lit(t).rlike(glob_to_java(g)).alias(f"c{i}") for i, (g, t, _) in enumerate(GLOBS)]).first()
    assert [(g, x) for (g, _, _), x in zip(GLOBS, got)] == [(g, w) for g, _, w in GLOBS]
    for bad in ("x[y", "x{y", "x\\"):
        with pytest.raises(ConfigError):
            glob_to_java(bad)
