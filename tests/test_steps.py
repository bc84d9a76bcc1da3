import pytest
import yaml
from pyspark.sql import functions as F

from millrace.config import Node, read_steps
from millrace.errors import ConfigError
from millrace.functions.matchers import ordered, predicate
from millrace.plans.steps import run_steps
from millrace.schema import ALIVE, LABELS, ORDER, SIZE, SOURCE, TIME, UNESCAPED, Schema, start_records


def steps(text, schema):
    return read_steps(Node(yaml.compose(text, Loader=yaml.SafeLoader), "steps"), schema)


def run(spark, fields, rows, text, **state):
    """Records with these fields, in this order, after the steps."""
    s = Schema(tuple(fields.split()))
    df = spark.createDataFrame([("mill", i, *r) for i, r in enumerate(rows)], f"{SOURCE} string, {ORDER} long, " + ", ".join(f"{f} string" for f in s.fields))
    df = start_records(df, s, time=F.timestamp_seconds(F.lit(86_400)), **state)
    return run_steps(df, steps(text, s), s, (), (SOURCE, ORDER)).orderBy(ORDER)


def values(df, *fields):
    return [tuple(r) if len(fields) > 1 else r[0] for r in df.select(*fields).collect()]


GRAIN = [("rye", "12", "wet"), ("oat", "7", "dry"), ("", "", "dry")]


def test_add_fields_in_order(spark):
    r = run(spark, "crop bales state", GRAIN, "[{type: addFields, fields: {bales: '${bales}x$crop', state: $bales, crop: ''}}]")
    # A text with words of its own is always set; a bare reference to nothing, and an empty text, change nothing.
    assert values(r, "crop", "bales", "state") == [("rye", "12xrye", "12xrye"), ("oat", "7xoat", "7xoat"), ("", "x", "x")]
    assert values(run(spark, "crop bales", [(None, "kept")], "[{type: addFields, fields: {bales: $crop}}]"), "crop", "bales") == [("", "kept")]


def test_conditions_look_at_what_was_there_before(spark):
    text = "[{type: if, match: {crop: rye}, then: [{type: delFields, keys: [crop, bales]}, {type: addFields, fields: {state: 'was rye, $state'}}]}]"
    assert values(run(spark, "crop bales state", GRAIN, text), "crop", "bales", "state") == [("", "", "was rye, wet"), ("oat", "7", "dry"), ("", "", "dry")]


def test_switch_takes_one_case(spark):
    text = """[{type: switch, cases: [
      {match: {state: dry, crop: !!str-any ''}, then: [{type: addFields, fields: {state: wet, bales: first}}]},
      {match: {state: wet}, then: [{type: addFields, fields: {bales: second}}]},
      {match: {crop: !!len-lt 1}, then: [{type: addFields, fields: {bales: third}}]}]}]"""
    assert values(run(spark, "crop bales state", GRAIN, text), "bales") == ["second", "first", "third"]


def test_nested_guards(spark):
    text = "[{type: block, steps: [{type: if, match: {state: dry}, then: [{type: switch, cases: [{match: {crop: oat}, then: [{type: if, match: {bales: !!len-gt 0}, then: [{type: addFields, fields: {bales: 'dry oat'}}]}]}]}]}]}]"
    assert values(run(spark, "crop bales state", GRAIN, text), "bales") == ["12", "dry oat", ""]


def test_map_value(spark):
    assert values(run(spark, "crop", [("rye",), ("oat",), ("",)], "[{type: mapValue, key: crop, mapping: {rye: bread, oat: ''}, default: other}]"), "crop") == ["bread", "", ""]
    assert values(run(spark, "crop", [("rye",), ("hop",)], "[{type: mapValue, key: crop, mapping: {rye: bread}}]"), "crop") == ["bread", ""]


def test_extract_leaves_what_took_no_part(spark):
    text = r"[{type: extract, key: slip, pattern: '^(?P<crop>[a-z]+)(?: (?P<bales>[0-9]+))?(?P<state>!)?$'}]"
    rows = [("rye 12", "a", "b", "c"), ("oat!", "a", "b", "c"), ("12", "a", "b", "c"), ("", "a", "b", "c")]
    assert values(run(spark, "slip crop bales state", rows, text), "crop", "bales", "state") == [("rye", "12", "c"), ("oat", "b", "!"), ("a", "b", "c"), ("a", "b", "c")]


def test_labels_without_a_match(spark):
    rows = [("<rye > sack", "old"), ("sack", "old"), ("", "old"), ("<> sack", "old")]
    assert values(run(spark, "slip crop", rows, "[{type: extractHead, key: slip, pattern: '<*> ', maxLen: 9, destKey: crop}]"), "slip", "crop") == [("sack", "rye"), ("sack", "old"), ("", "old"), ("sack", "")]
    assert values(run(spark, "slip", [("sack/7",), ("sack",)], "[{type: extractTail, key: slip, pattern: '/[0-9]', maxLen: 9, destKey: slip}]"), "slip") == ["7", "sack"]


def test_replace_and_truncate(spark):
    text = "[{type: replace, key: slip, pattern: '([0-9]+) (?P<u>kg)', replacement: '${u} $1'}, {type: truncate, key: slip, maxLen: 6, suffix: ..}]"
    assert values(run(spark, "slip", [("5 kg",), ("12 kg 13 kg",), ("",)], text), "slip") == ["kg 5", "kg 12 ..", ""]


def test_drop_all(spark):
    text = "[{type: drop, match: {state: dry}, percentage: 100, metricLabel: chaff}, {type: redactEmail, key: crop, metricLabel: late}, {type: addFields, fields: {bales: '0'}}]"
    r = run(spark, "crop bales state", [("a@b.c", "1", "dry"), ("a@b.c", "22", "wet")], text)
    assert values(r, ALIVE) == [False, True] and values(r, LABELS) == [["chaff"], ["late"]]
    assert values(r, SIZE) == [5 + 1 + 3, 5 + 2 + 3]  # as they came


def kept_by_share(n, percentage):
    """Of n matching records those that stay: a record goes whenever fewer than the percentage of those before it went; the first stays."""
    kept, gone = [], 0
    for seen in range(n):
        goes = seen > 0 and 100 * gone < percentage * seen
        gone += goes
        kept.append(not goes)
    return kept


@pytest.mark.parametrize("percentage", [1, 25, 33, 50, 75, 99])
def test_drop_share(spark, percentage):
    rows = [("husk" if i % 4 else "grain",) for i in range(240)]
    r = run(spark, "crop", rows, f"[{{type: drop, match: {{crop: husk}}, percentage: {percentage}, metricLabel: sieve}}]")
    got = values(r, "crop", ALIVE, LABELS)
    husks = [(alive, labels) for crop, alive, labels in got if crop == "husk"]
    assert [alive for alive, _ in husks] == kept_by_share(180, percentage)
    assert all(labels == (["!sieve"] if alive else ["sieve"]) for alive, labels in husks)
    assert all(alive and not labels for crop, alive, labels in got if crop == "grain")


def test_parse_time(spark):
    rows = [("2001-02-03T04:05:06Z",), ("yesterday",), ("",)]
    r = run(spark, "at", rows, "[{type: parseTime, key: at, errorLabel: no-time}]")
    assert values(r.withColumn("us", F.unix_micros(TIME)), "us") == [981_173_106_000_000, 86_400_000_000, 86_400_000_000]
    assert values(r, LABELS) == [[], ["no-time"], []]


def test_unescape_once_per_record(spark):
    r = run(spark, "slip note", [("a\\tb", "c\\nd")], "[{type: unescape, key: note}, {type: unescape, key: slip}]")
    assert values(r, "slip", "note", UNESCAPED) == [("a\\tb", "c\nd", True)]
    assert values(run(spark, "note", [("c\\nd",)], "[{type: unescape, key: note}]", unescaped=F.lit(True)), "note") == ["c\\nd"]
    guarded = run(spark, "note slip", [("a\\n", "x"), ("b\\n", "")], "[{type: if, match: {slip: x}, then: [{type: unescape, key: note}]}]")
    assert values(guarded, "note", UNESCAPED) == [("a\n", True), ("b\\n", False)]


def test_redacted_records_are_counted_once(spark):
    r = run(spark, "note", [("to rye@farm.example and oat@farm.example",), ("to nobody",)], "[{type: redactEmail, key: note, metricLabel: hidden}, {type: drop, match: {note: !!str-contain REDACTED}, percentage: 100, metricLabel: held}]")
    assert values(r, "note", LABELS) == [("to REDACTED and REDACTED", ["hidden", "held"]), ("to nobody", [])]


def test_empty_table(spark):
    assert run(spark, "crop", [], "[{type: addFields, fields: {crop: rye}}, {type: drop, match: {crop: rye}, percentage: 40, metricLabel: sieve}]").count() == 0


def test_other_columns_stay(spark):
    s = Schema(("note",))
    df = start_records(spark.createDataFrame([("a", 1, [1])], "note string, tag int, log array<int>"), s)
    assert run_steps(df, steps("[{type: addFields, fields: {note: b}}]", s), s).select("note", "tag", "log").first() == ("b", 1, [1])


def test_cheap_predicates_come_first():
    m = {"a": predicate("regex", "r.e"), "b": predicate("str-contain", "a rather long text"), "c": predicate("str-not", "x"), "d": predicate("str-any", ""), "e": predicate("str-contain", "rye")}
    places = [f for f, _ in ordered(m)]
    assert places[0] == "d" and places[-1] == "a" and places.index("c") < places.index("e") < places.index("a")


PREDICATES = {
    "str": ("rye", lambda v: v == "rye"), "str-eq": ("rye", lambda v: v == "rye"), "str-not": ("rye", lambda v: v != "rye"), "str-any": ("", lambda v: v != ""), "str-start": ("ry", lambda v: v.startswith("ry")), "str-end": ("e", lambda v: v.endswith("e")),
    "str-contain": ("ye", lambda v: "ye" in v), "len-gt": ("3", lambda v: len(v.encode()) > 3), "len-lt": ("4", lambda v: len(v.encode()) < 4), "regex": ("^r[xy]", lambda v: v[:2] in ("rx", "ry")), "glob": ("{ry,o}*", lambda v: v.startswith(("ry", "o"))),
}


@pytest.mark.parametrize("tag", PREDICATES)
def test_predicates(spark, tag):
    operand, plain = PREDICATES[tag]
    cases = ["", "rye", "rye\n", "oat", "aye", "ryee", "röe", "rx", "e"]
    p = predicate(tag, operand)
    assert list(spark.range(1).select(*[p.column(F.lit(c)).alias(f"c{i}") for i, c in enumerate(cases)]).first()) == [plain(c) for c in cases]


@pytest.mark.parametrize("text", [
    "[{type: winnow}]", "[{type: addFields, fields: {hay: x}}]", "[{type: addFields, fields: {note: $hay}}]", "[{key: note, type: unescape}]", "[{type: unescape, key: note, twice: 1}]", "[{type: drop, match: {note: x}, percentage: 101, metricLabel: y}]", "[{type: drop, match: {note: x}, percentage: 0, metricLabel: y}]",
    "[{type: drop, match: {note: !!str-end ''}, percentage: 5, metricLabel: y}]", "[{type: if, match: {note: !!sieve x}, then: [{type: unescape, key: note}]}]", "[{type: block, steps: []}]", "[{type: extractTail, key: note, pattern: '*x', maxLen: 5, destKey: note}]",
    "[{type: extract, key: note, pattern: '(?P<hay>x)'}]", "[{type: extract, key: note, pattern: 'x'}]", "[{type: truncate, key: note, maxLen: 0, suffix: x}]", "[{type: mapValue, key: note, mapping: {}}]",
])
def test_programs_with_errors(text):
    with pytest.raises(ConfigError):
        steps(text, Schema(("note",)))


def test_an_unknown_tag_names_its_place():
    with pytest.raises(ConfigError, match=r"line 1:\d+.*!!sieve"):
        steps("[{type: if, match: {note: !!sieve x}, then: [{type: unescape, key: note}]}]", Schema(("note",)))
