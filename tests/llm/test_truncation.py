import random

import numpy as np
import pytest

from millrace.llm import truncation as X
from millrace.llm.encoding import restore

WORDS = "north south harbour cliff valley ridge lantern trellis pulley bobbin anvil silo crate kiln ferry spool".split()


def intact(rng):
    w = lambda: rng.choice(WORDS)
    return rng.choice([
        lambda: ("a", f"Compacted {rng.randint(1, 900)} segments of {w()} in {rng.random() * 9:.3f} s"), lambda: ("a", f"Slow write on {w()} replica {w()}, {rng.random() * 9:.3f} s"), lambda: ("b", f"Still retrying {w()} upload…"), lambda: ("b", f"Waiting for {w()} {w()} lock..."),
        lambda: ("c", '{"panel":"%s","owner":{"depth":%d}}' % (w(), rng.randint(1, 99999))), lambda: ("c", f"The importer asked the {w()} for a copy of the {w()} after the third attempt. The {w()} paused while the {w()} was rebuilt."), lambda: ("b", f"Login rejected for acc{rng.randint(1, 999)}: permission denied"),
    ])()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out, truth = [], set()
    for i in range(6000):
        source, text = intact(rng)
        if rng.random() < 0.03:
            n = rng.randint(5, len(text) - 3)
            text = text[:n].rstrip() + rng.choice(["", "", " ... (cut)", "<snip>"])
            truth.add(i)
        out.append((i, source, text))
    return out, truth


def test_finds_what_was_cut(spark, rows):
    data, truth = rows
    df = spark.createDataFrame(data, "id long, source string, log string")
    found = {r["id"] for r in X.found(df, "id", "log", "source").collect()}
    assert len(found & truth) / len(truth) > 0.9, (len(found & truth), len(truth))
    assert len(found & truth) / max(1, len(found)) > 0.9, (len(found & truth), len(found))
    # The report is of the same model.
    report = {r["source"]: r for r in X.report(df, "id", "log", "source").collect()}
    assert sum(r["n_records"] for r in report.values()) == len(data) and sum(r["n_truncated"] for r in report.values()) == len(found)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, 0.5), (2, "s", "", 0.5), (3, None, "x", 0.5), (3, None, "x", 0.5), (4, "s", "word " * 100_000, 0.5)], "id long, src string, log string, probability double")
    got = sorted(map(tuple, X.scores(df, "id", "log", "src").select("id", "source").collect()))
    assert got == [(1, ""), (2, "s"), (3, ""), (3, ""), (4, "s")]
    assert X.scores(df, "id", "log", "src").filter("id < 3 and probability > 0").count() == 0
    assert X.scores(df.limit(0), "id", "log", "src").count() == 0 and X.report(df.limit(0), "id", "log", "src").count() == 0


def test_lengths_where_texts_pile_up(spark):
    rows = [("s", n, 3) for n in range(100, 200)] + [("s", 256, 90), ("t", 300, 9), ("s", 150, 40)]
    df = spark.createDataFrame([r for r in rows if r[:2] != ("s", 150) or r[2] == 40], "source string, n_bytes int, n long")
    assert sorted(map(tuple, X.limits_of(df).collect())) == [("s", 150), ("s", 256)]


def test_cut():
    rng = random.Random(1)
    assert X.cut("abc", [], rng) is None
    for _ in range(200):
        piece, at_limit = X.cut("é" * 50 + " tail", [31], rng)
        assert piece.encode().decode() == piece and (not at_limit or len(piece.encode()) >= 30)


def test_parts_come_from_the_ends():
    """What is taken from the short end of a text is what the long one gives."""
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab1.(\" ,µ") for _ in range(rng.randint(0, 120)))
        long = tuple([X._shape(t) for t in X._TOKEN.findall(text.lower().encode().translate(X._ZERO).decode().rstrip()[-70:])[-4:]])
        assert X.parts("s", text, False)[2] == long


def test_counts_are_of_all_texts(spark, monkeypatch):
    """Counts don't depend on the sample that weights are trained on."""
    monkeypatch.setattr(X, "SAMPLE_ROWS", 50)
    texts = [(i, f"Silo {i} is full today") for i in range(400)] + [(1000 + i, "Silo 7 is fu") for i in range(3)]
    seen = {}

    class Spy(X.Corpus):
        def __init__(self, distinct, words):
            super().__init__(distinct, words)
            rows = distinct.filter(X.F.array_contains("ends", X.number("00silo 0\ntoday")) | X.F.array_contains("ends", X.number("00silo 0\nfu")))
            seen["counts"] = sorted((r["c0"], r["n0"]) for r in self.counts(rows, "parts", X.F.lit(True)).collect())
            seen["words"] = {r["at"]: r["count"] for r in self.words.collect()}
            seen["total"] = self.total

    monkeypatch.setattr(X, "Corpus", Spy)
    X.scores(spark.createDataFrame([(i, t, "s") for i, t in texts], "id long, log string, src string"), "id", "log", "src").count()
    assert seen["total"] == 403 and seen["words"][X.word_key("silo")] == 403 and seen["words"][X.word_key("is")] == 403
    # Of the others that open alike, 399 of 402 end as a whole one does, and 2 as a cut one.
    assert set(seen["counts"]) == {(399, 402), (2, 402)}


def test_limits_are_joined_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", "x" * (30 + i % 50) if i % 4 else "y" * 64) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, source string, log string")
    some = sorted(map(tuple, X.scores(df, "id", "log", "source").collect()))
    monkeypatch.setattr(X, "BROADCAST_LIMITS", 0)
    assert sorted(map(tuple, X.scores(df, "id", "log", "source").collect())) == some


def test_garbled_endings_are_judged_by_what_they_stand_for(spark):
    """Garbled whole texts don't count as cut, and what is only restored where it looks cut is found as if all were restored first."""
    rng = random.Random(8)
    whole = [f"Zähler {rng.randint(1, 99)} meldet Übertragung für Behälter {rng.choice(WORDS)} beendet, Größe geprüft" for _ in range(3000)]
    rows = []
    for i, t in enumerate(whole):
        t = t[: rng.randint(8, len(t) - 4)] if i % 40 == 0 else t
        rows.append((i, "s", t.encode().decode("cp1252", "replace") if i % 10 == 5 else t))
    df = spark.createDataFrame(rows, "id long, source string, log string")
    first = spark.createDataFrame([(i, s, restore(t)[1]) for i, s, t in rows], "id long, source string, log string")
    got, want = ({r["id"] for r in X.found(x, "id", "log", "source").collect()} for x in (df, first))
    # Nothing is lost that restoring first would find, and what comes beside it is really cut, not garbled.
    assert len(got & want) / len(want) > 0.97 and sum(i % 40 != 0 for i in got) <= 0.02 * len(got)


def test_names_with_numbers_are_no_codes():
    """The number after a name has any length, though the letters of some names are those of codes."""
    assert X._shape("acc0") == X._shape("acc00") == X._shape("acc000") == "acc0"
    assert X._shape("0f0a") == "h4" and X._shape("000e000") == "h7" and X._shape("abc00000") == "h8"


def test_openings_of_few_texts_stand_back():
    """An opening that no other text has is no sign of a cut: the first words decide."""
    row = lambda a, b: np.array([[a, a, b, b]], float)
    args = np.array([3 << 5]), np.zeros(1), 1000.0
    got = lambda c, n, s: X.counted(args[0], c, n, s, args[1], args[2]).tolist()
    assert got(row(80, 0), row(100, 4), row(6000, 0)) == got(row(80, 80), row(100, 100), row(6000, 6000))
    assert got(row(80, 0), row(100, 5), row(6000, 0)) != got(row(80, 80), row(100, 100), row(6000, 6000))


def test_usual_endings_of_rare_messages_are_whole(spark, rows):
    """Whole messages of rare kinds, whose endings and names vary, are not found, and what is cut of them is."""
    rng = random.Random(6)
    data, truth = list(rows[0]), set(rows[1])
    name = lambda: "".join(rng.choice(("ba", "ri", "lo", "ne", "tu", "ka")) for _ in range(3)).title()
    numbers = (lambda: f"555.01{rng.randint(10, 99)}", lambda: f"0046-8-465-004-{rng.randint(10, 99)}", lambda: f"07700 9001{rng.randint(10, 99)}", lambda: f"+1 212-555-01{rng.randint(10, 99)} x{rng.randint(1, 99)}")
    kinds = (
        lambda: f"Session {rng.getrandbits(32):08x} closed by account acc{rng.randint(1, 999)}",
        lambda: f"Kept note {rng.getrandbits(32):08x}: customer {name()} {name()} moved, new number {rng.choice(numbers)()}",
        lambda: f"Card of {rng.choice((f'{name()}, {name()}', f'{name()} {name()}', f'{name()} B. {name()}'))} opened, panel {rng.randint(1, 999)}",
    )
    rare = set()
    for i in range(10_000, 10_000 + 900):
        text = kinds[i % 3]()
        if rng.random() < 0.04:
            text = text[: rng.randint(6, text.rindex(" ") - 1)]
            truth.add(i)
        rare.add(i)
        data.append((i, "d", text))
    found = {r["id"] for r in X.found(spark.createDataFrame(data, "id long, source string, log string"), "id", "log", "source").collect()}
    assert len((found & rare) - truth) <= 0.01 * len(rare - truth), len((found & rare) - truth)
    assert len(found & truth) > 0.9 * len(truth) and len(found & truth) > 0.95 * len(found), (len(found & truth), len(truth), len(found))
