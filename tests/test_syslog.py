import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranks
from millrace.schema import LABELS, ORDER, SIZE, SOURCE, SYSLOG_FIELDS, UNESCAPED, Schema
from millrace.sources.syslog import FACILITIES, MALFORMED, SEVERITIES, frame_lines, frame_text, input_counts, is_start, parse, read_files
from millrace.streaming.framing import Framer, starts

S = Schema(SYSLOG_FIELDS)
HEADER = ("2031-05-06T07:08:09.123456+02:00", "quern", "mill", "4711", "belt", "-")


def line(priority=46, text="belt slipped", header=HEADER):
    return f"<{priority}>1 {' '.join(header)} {text}"


A, B = line(), line(9, "stone [3] hot: 71 °C", ("2031-05-06T07:08:10Z", "quern2", "sieve", "-", "motor", "[a]"))


def parsed(spark, records, levels=SEVERITIES):
    df = spark.createDataFrame([("c", i, r) for i, r in enumerate(records)], f"{SOURCE} string, {ORDER} long, record string")
    return parse(df, S, levels).orderBy(ORDER)


def test_parse(spark):
    rows = parsed(spark, [A, B]).collect()
    assert [tuple(r[f] for f in SYSLOG_FIELDS) for r in rows] == [
        ("syslog", "info", *HEADER, "belt slipped"), ("user", "alert", "2031-05-06T07:08:10Z", "quern2", "sieve", "-", "motor", "[a]", "stone [3] hot: 71 °C"),
    ]
    assert [r[SIZE] for r in rows] == [len(A), len(B.encode())]
    assert [r["level"] for r in parsed(spark, [A, B], tuple("abcdefgh")).collect()] == ["g", "b"]


def test_every_priority(spark):
    rows = parsed(spark, [line(p) for p in range(200)]).collect()
    assert [(r["facility"], r["level"]) for r in rows[:192]] == [(f, s) for f in FACILITIES for s in SEVERITIES]
    assert all(r[MALFORMED] is None for r in rows[:192]) and all(r[MALFORMED] for r in rows[192:])


WRONG = [
    "plain words that are long enough to be one", "", None, "<46>1 too short", line("-3"), line("x"), line(""), line("4711000000000"), line().replace(">1 ", ">2 ", 1), line().replace("<", "", 1), line().replace(">1 ", "> ", 1),
    "<46>1 " + " ".join(HEADER[:5]) + " wholly-without-a-message",
]


def test_what_cannot_be_parsed(spark):
    assert all(r[MALFORMED] for r in parsed(spark, WRONG).collect())
    size = sum(len(w or "") for w in WRONG)
    assert tuple(input_counts(parsed(spark, [*WRONG, A])).first()) == (1, len(A), len(WRONG), size, 0)


def test_empty_fields_and_messages(spark):
    rows = parsed(spark, [line(text=""), line(text="two  blanks "), line(header=("2031-05-06T07:08:09.123456+02:00", "", "", "", "", ""))]).collect()
    assert [r[MALFORMED] for r in rows] == [None] * 3
    assert [(r["host"], r["log"]) for r in rows] == [("quern", ""), ("quern", "two  blanks "), ("", "belt slipped")]


def test_messages_over_the_limit(spark):
    limit = 1 << 20
    cases = ["x" * limit, "x" * (limit + 1), "x" * (limit - 1) + "µ", "µ" * (limit // 2) + "x"]
    r = parsed(spark, [line(text=t) for t in cases]).select(F.octet_length("log"), LABELS, MALFORMED).collect()
    # A character cut through goes.
    assert [(x[0], x[1]) for x in r] == [(limit, []), (limit, ["overflow"]), (limit - 1, ["overflow"]), (limit, ["overflow"])]
    assert input_counts(parsed(spark, [line(text=t) for t in cases])).first()["overflow_count"] == 3


def test_real_line_breaks_count_as_unescaped(spark):
    assert [r[UNESCAPED] for r in parsed(spark, [A, A + "\nand a second line", A + "\\n"]).collect()] == [False, True, False]


STARTS = {A: True, B: True, line(7): True, line(777): True, line(7777): False, line("a"): False, "x" + A: False, A[:31]: False, A[:32]: True, "<46>1" + "y" * 40: False, "": False}


def test_record_start(spark):
    df = spark.createDataFrame(list(enumerate(STARTS)), "i int, l string")
    assert [r[0] for r in df.orderBy("i").select(is_start(F.col("l"))).collect()] == list(STARTS.values())
    assert [starts(x.encode()) for x in STARTS] == list(STARTS.values())


def test_endless_records_are_cut(spark):
    """A record that no other ends is cut at the limit, by lines; what follows is no record."""
    rows = [("c", i, A if i == 0 else "z" * 99) for i in range(50)] + [("c", 50, B), ("d", 0, A), ("d", 1, "short")]
    df = spark.createDataFrame(rows, "conn string, no long, line string")
    got = [r["record"] for r in frame_lines(df, "conn", "no", "line", limit=1000).orderBy(SOURCE, ORDER).collect()]
    f = Framer(limit=1000)
    first = [r for i in range(51) for r in f.feed(rows[i][2])][0]
    assert got[0] == first and got[-2:] == [B, A + "\nshort"]
    assert "\n".join(got[:-2]) == "\n".join(x for _, _, x in rows[:50]) and max(map(len, got)) <= 1000 + 100
    assert sum(r[MALFORMED] is None for r in parsed(spark, got).collect()) == 3


def brute(lines):
    f = Framer()
    out = [r for x in lines for r in f.feed(x)]
    return out + (["\n".join(f.lines)] if f.lines else [])


def test_framing_of_lines(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 7)
    rng = random.Random(1)
    conns = {f"c{k}": [rng.choice([A, B, "  more", "", "<1>1 x", "é" * 3]) for _ in range(rng.choice([1, 3, 40]))] for k in range(12)}
    conns["dull"] = ["no start"] * 5
    rows = [(c, i + 1, x) for c, lines in conns.items() for i, x in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conn string, no long, line string")
    got = {}
    for r in frame_lines(df, "conn", "no", "line").orderBy(SOURCE, ORDER).collect():
        got.setdefault(r[SOURCE], []).append(r["record"])
    assert got == {c: brute(lines) for c, lines in conns.items()}


def test_framing_keeps_lines_without_a_connection(spark):
    df = spark.createDataFrame([(None, 1, A), (None, 2, "more"), ("c", None, A), ("c", 1, None)], "conn string, no long, line string")
    got = sorted(((r[SOURCE], r["record"]) for r in frame_lines(df, "conn", "no", "line").collect()), key=str)
    assert got == [("c", A + "\n"), (None, A + "\nmore")]
    assert frame_lines(df.limit(0), "conn", "no", "line").count() == 0


def test_framing_of_text(spark, tmp_path):
    text = f"{A}\n{B}\n  one\n\n  two\n{A}\n"
    (tmp_path / "x.log").write_text(text)
    rows = read_files(spark, str(tmp_path / "*.log")).orderBy(ORDER).collect()
    assert [r["record"] for r in rows] == [A, f"{B}\n  one\n\n  two", A]
    # Larger files are read in parts.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        for name in ("y", "z"):
            (tmp_path / f"{name}.txt").write_text(text * 7)
        parts = read_files(spark, str(tmp_path / "*.txt"), largest=50)
        got = {}
        for r in parts.orderBy(SOURCE, ORDER).collect():
            got.setdefault(r[SOURCE][-5:], []).append(r["record"])
        assert got == {n: [A, f"{B}\n  one\n\n  two", A] * 7 for n in ("y.txt", "z.txt")} and parts.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    df = spark.createDataFrame([(text.rstrip("\n"),), ("",)], "value string")
    assert frame_text(df, source=F.lit("s")).count() == 4


def test_framer():
    f = Framer()
    assert f.feed("garbage") == [] and f.feed(A) == ["garbage"] and f.feed("more") == [] and f.flush() == [A + "\nmore"]
    assert f.feed("late") == [] and f.flush() == []
    small = Framer(limit=200)
    out = [r for _ in range(20) for r in small.feed(A if not small.lines else "x" * 20)]
    assert out and all(len(r) <= 260 for r in out)
    again = Framer("a\nb")
    assert again.held == "a\nb" and again.feed(A) == ["a\nb"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ranks(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", None]), "s", i, rng.random() < 0.5, rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, s string, i long, t boolean, v long")
    counted = {r["i"]: r["n"] for r in ranks.running_count(df, "t", ["k"], ["s", "i"], "n", block).collect()}
    seen = {}
    for k, _, i, t, _ in rows:
        seen[k] = seen.get(k, 0) + t
        assert counted[i] == seen[k]
    filled = {r["i"]: r["last"] for r in ranks.carried(df, F.col("v"), ["k"], "i", "last", block).collect()}
    last = {}
    for k, _, i, _, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert filled[i] == last[k]
    assert ranks.running_count(df.limit(0), "t", ["k"], ["s", "i"], "n", block).count() == 0
