"""The step types of programs: how each is read and verified, and how it compiles to columns.

A compiled program is a chain of projections. Each step sees the columns as the step before left them. Conditions become
boolean columns once, before the steps they guard, so that what those steps change can't change the condition, and no
expression is repeated in many branches.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import STEP_READERS, Node, Step, read_match, read_steps
from millrace.errors import ConfigError
from millrace.functions import templates
from millrace.functions.groups import always_takes_part, probe
from millrace.functions.matchers import match_column
from millrace.functions.patterns import group_count, replacement_to_java, to_java
from millrace.functions.text import check_label, cut_head, cut_tail, has_email, label_pattern, redact_email, truncate, unescape
from millrace.functions.times import parse_time
from millrace.operators.sampling import keep_share
from millrace.schema import ALIVE, LABELS, TIME, UNESCAPED, Schema, keep

_guards = count()


class Context:
    """A frame of records under way, and the columns that guard the steps at hand."""

    def __init__(self, df: DataFrame, schema: Schema, keys: tuple[str, ...], order: tuple[str, ...], guard: str | None = None) -> None:
        self.df, self.schema, self.keys, self.order, self.guard = df, schema, keys, order, guard
        #: Of sampling steps, by line: what matched in batches before, and the column of what matches in this one.
        self.seen: dict[int, DataFrame] = {}
        self.matched: dict[int, str] = {}

    def col(self, field: str) -> Column:
        return F.col(f"`{field}`")

    def when(self, test: Column | None = None) -> Column | None:
        """`test` where the guard holds; None stands for always."""
        g = F.col(self.guard) if self.guard else None
        return test if g is None else g if test is None else g & test

    def set(self, values: dict[str, Column], test: Column | None = None) -> None:
        """Sets fields where the guard, and `test`, hold."""
        on = self.when(test)
        self.df = self.df.withColumns({k: v if on is None else F.when(on, v).otherwise(self.col(k)) for k, v in values.items()})

    def label(self, name: str, test: Column) -> Column:
        """The labels with `name` added to living records for which `test` and the guard hold."""
        on = self.when(test)
        return F.when(on & F.col(ALIVE), F.array_append(LABELS, F.lit(name))).otherwise(F.col(LABELS))

    def named(self, test: Column) -> str:
        """A column that holds `test`, as it is now."""
        name = f"_mr_if{next(_guards)}"
        self.df = self.df.withColumn(name, test)
        return name

    def inside(self, guard: str, steps: list[Step]) -> None:
        outer = self.guard
        self.guard = guard
        for s in steps:
            run_step(self, s)
        self.guard = outer


#: Compilers by step type.
STEPS: dict[str, Callable[[Context, Step], None]] = {}
#: Fields a step names, by step type.
FIELDS: dict[str, Callable[[Step], set[str]]] = {}


def register_step(name: str, reader: Callable[[Node, Schema], Step], compiler: Callable[[Context, Step], None], fields: Callable[[Step], set[str]] = lambda s: set()) -> None:
    """Adds a step type to the language: how it is read, what it does, which fields it uses."""
    if name in STEPS:
        raise ValueError(f"{name} is registered already")
    STEP_READERS[name], STEPS[name], FIELDS[name] = reader, compiler, fields


def run_step(c: Context, s: Step) -> None:
    STEPS[s.type](c, s)


def run_steps(df: DataFrame, steps: list[Step], schema: Schema, keys: tuple[str, ...] = (), order: tuple[str, ...] = (), seen: dict[int, DataFrame] | None = None, marks: bool = False) -> DataFrame:
    """The records after `steps`. Dropped ones stay in the frame, marked, until they are counted.

    `keys` are columns that hold the key set of each record as the orchestration saw it; `order` gives the order of arrival. Both matter to sampling only,
    as does `seen`: per sampling step (by its line) what each key set matched in batches before. With `marks` a column `_mr_matched<line>` says what it matched now.
    """
    c = Context(df, schema, keys, order)
    c.seen = seen or {}
    for s in steps:
        run_step(c, s)
    if marks:
        c.df = c.df.withColumns({f"_mr_matched{line}": F.col(m) for line, m in c.matched.items()})
    return c.df.drop(*[x for x in c.df.columns if x.startswith("_mr_if")])


def fields_of_steps(steps: list[Step]) -> set[str]:
    out: set[str] = set()
    for s in steps:
        out |= FIELDS[s.type](s) | fields_of_steps(s.steps)
        for match, inner in s.cases:
            out |= set(match) | fields_of_steps(inner)
    return out


# Grouping and conditions


def _read_block(n: Node, schema: Schema) -> Step:
    return Step("block", n.line, steps=read_steps(n.take(("type", "steps"))["steps"], schema, 1))


def _block(c: Context, s: Step) -> None:
    for x in s.steps:
        run_step(c, x)


def _read_if(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "match", "then"))
    return Step("if", n.line, {"match": read_match(m["match"], schema)}, steps=read_steps(m["then"], schema, 1))


def _if(c: Context, s: Step) -> None:
    c.inside(c.named(c.when(match_column(s.options["match"], c.col))), s.steps)


def _read_switch(n: Node, schema: Schema) -> Step:
    cases = []
    for x in n.take(("type", "cases"))["cases"].sequence(1):
        m = x.take(("match", "then"))
        cases.append((read_match(m["match"], schema), read_steps(m["then"], schema, 1)))
    return Step("switch", n.line, cases=cases)


def _switch(c: Context, s: Step) -> None:
    # One number per record says which case is first to match: all matches are made before any case runs.
    which: Column = F.lit(-1)
    for i, (match, _) in reversed(list(enumerate(s.cases))):
        which = F.when(match_column(match, c.col), i).otherwise(which)
    on = c.when()
    chosen = c.named(which if on is None else F.when(on, which).otherwise(F.lit(-1)))
    for i, (_, steps) in enumerate(s.cases):
        c.inside(c.named(F.col(chosen) == i), steps)


# Fields


def _read_add(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "fields"))
    fields = {}
    for k, v in m["fields"].mapping().items():
        schema.require(k, v.line)
        t = v.text(allow_empty=True)
        try:
            for f in templates.fields_of(t):
                schema.require(f, v.line)
        except ConfigError as e:
            raise v.error(str(e)) from None
        fields[k] = t
    if not fields:
        raise m["fields"].error("is empty")
    return Step("addFields", n.line, {"fields": fields})


def _add(c: Context, s: Step) -> None:
    # In the order they are written, each seeing the ones before. An empty result changes nothing.
    for k, t in s.options["fields"].items():
        v = templates.expand(t, c.col)
        parts = templates.parse(t)
        if any(p.literal for p in parts):
            c.set({k: v})
        elif parts:
            c.set({k: F.when(F.octet_length(v) > 0, v).otherwise(c.col(k))})


def _read_delete(n: Node, schema: Schema) -> Step:
    return Step("delFields", n.line, {"keys": [schema.require(k.text(), k.line) for k in n.take(("type", "keys"))["keys"].sequence(1)]})


def _delete(c: Context, s: Step) -> None:
    c.set({k: F.lit("") for k in s.options["keys"]})


def _key(m: dict[str, Node], schema: Schema) -> str:
    return schema.require(m["key"].text(), m["key"].line)


def _read_map(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "key", "mapping"), ("default",))
    mapping = {k: v.text(allow_empty=True) for k, v in m["mapping"].mapping().items()}
    if not mapping:
        raise m["mapping"].error("is empty")
    return Step("mapValue", n.line, {"key": _key(m, schema), "mapping": mapping, "default": m["default"].text(allow_empty=True) if "default" in m else ""})


def _map(c: Context, s: Step) -> None:
    v = c.col(s.options["key"])
    table = F.create_map(*[F.lit(x) for kv in s.options["mapping"].items() for x in kv])
    mapped = F.coalesce(F.try_element_at(table, v), F.lit(s.options["default"]))
    c.set({s.options["key"]: F.when(F.octet_length(v) > 0, mapped).otherwise(v)})


# Extraction and replacement


def _read_extract(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "key", "pattern"))
    key, pattern = _key(m, schema), m["pattern"].text()
    java, names = _pattern(m["pattern"], pattern)
    if not names:
        raise m["pattern"].error("names no group")
    for f in names:
        schema.require(f, m["pattern"].line)
    return Step("extract", n.line, {"key": key, "pattern": pattern})


def _pattern(n: Node, pattern: str) -> tuple[str, dict[str, int]]:
    try:
        return to_java(pattern)
    except ConfigError as e:
        raise n.error(str(e)) from None


def _extract(c: Context, s: Step) -> None:
    java, names = to_java(s.options["pattern"])
    v = c.col(s.options["key"])
    found = c.named(c.when(v.rlike(java)) if c.guard else v.rlike(java))
    new = {f: F.when(F.col(found) & _group_took_part(v, java, i), F.regexp_extract(v, java, i)).otherwise(c.col(f)) for f, i in names.items()}
    c.df = c.df.withColumns(new)


def _group_took_part(v: Column, java: str, i: int) -> Column:
    """Whether the first match used the group: an optional group that was left out leaves its field alone."""
    return F.lit(True) if always_takes_part(java, i) else probe(v, java, i)


def _read_label(kind: str):
    def read(n: Node, schema: Schema) -> Step:
        m = n.take(("type", "key", "pattern", "maxLen", "destKey"))
        try:
            check_label(label_pattern(m["pattern"].text()), kind == "extractHead")
        except ConfigError as e:
            raise m["pattern"].error(str(e)) from None
        return Step(kind, n.line, {"key": _key(m, schema), "pattern": m["pattern"].text(), "max": m["maxLen"].integer(1, 1 << 30), "dest": schema.require(m["destKey"].text(), m["destKey"].line)})

    return read


def _label(c: Context, s: Step) -> None:
    o = s.options
    cut = cut_head if s.type == "extractHead" else cut_tail
    v = c.col(o["key"])
    ok, label, rest = cut(v, label_pattern(o["pattern"]), o["max"])
    found = c.named(c.when((F.octet_length(v) > 0) & ok))
    c.df = c.df.withColumns({o["dest"]: F.when(F.col(found), label).otherwise(c.col(o["dest"])), o["key"]: F.when(F.col(found), rest).otherwise(v)} if o["dest"] != o["key"] else {o["key"]: F.when(F.col(found), label).otherwise(v)})


def _read_replace(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "key", "pattern", "replacement"))
    _pattern(m["pattern"], m["pattern"].text())
    return Step("replace", n.line, {"key": _key(m, schema), "pattern": m["pattern"].text(), "replacement": m["replacement"].text(allow_empty=True)})


def _replace(c: Context, s: Step) -> None:
    java, names = to_java(s.options["pattern"])
    new = replacement_to_java(s.options["replacement"], names, group_count(java))
    v = c.col(s.options["key"])
    c.set({s.options["key"]: F.when(F.octet_length(v) > 0, F.regexp_replace(v, F.lit(java), F.lit(new))).otherwise(v)})


def _read_truncate(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "key", "maxLen", "suffix"))
    return Step("truncate", n.line, {"key": _key(m, schema), "max": m["maxLen"].integer(1, 1 << 30), "suffix": m["suffix"].text()})


def _truncate(c: Context, s: Step) -> None:
    c.set({s.options["key"]: truncate(c.col(s.options["key"]), s.options["max"], s.options["suffix"])})


def _read_unescape(n: Node, schema: Schema) -> Step:
    return Step("unescape", n.line, {"key": _key(n.take(("type", "key")), schema)})


def _unescape(c: Context, s: Step) -> None:
    k = s.options["key"]
    # Once per record: a record that came with real line breaks, or was decoded before, is left alone.
    c.set({k: F.when(F.col(UNESCAPED), c.col(k)).otherwise(unescape(c.col(k)))})
    on = c.when()
    c.df = c.df.withColumn(UNESCAPED, F.lit(True) if on is None else F.col(UNESCAPED) | on)


# Redaction, times, drops


def _read_redact(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "key", "metricLabel"))
    return Step("redactEmail", n.line, {"key": _key(m, schema), "label": m["metricLabel"].text()})


def _redact(c: Context, s: Step) -> None:
    k = s.options["key"]
    found = c.named(has_email(c.col(k)) if not c.guard else c.when(has_email(c.col(k))))
    c.df = c.df.withColumns({k: F.when(F.col(found), redact_email(c.col(k))).otherwise(c.col(k)), LABELS: c.label(s.options["label"], F.col(found))})


def _read_time(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "key", "errorLabel"))
    return Step("parseTime", n.line, {"key": _key(m, schema), "label": m["errorLabel"].text()})


def _time(c: Context, s: Step) -> None:
    v = c.col(s.options["key"])
    parsed = c.named(parse_time(v))
    on = c.when()
    got = F.col(parsed).isNotNull()
    c.df = c.df.withColumns({TIME: F.when(got if on is None else on & got, F.col(parsed)).otherwise(F.col(TIME)), LABELS: c.label(s.options["label"], (F.octet_length(v) > 0) & ~got)})


def _read_drop(n: Node, schema: Schema) -> Step:
    m = n.take(("type", "match", "percentage", "metricLabel"))
    return Step("drop", n.line, {"match": read_match(m["match"], schema), "percentage": m["percentage"].integer(1, 100), "label": m["metricLabel"].text()})


def _drop(c: Context, s: Step) -> None:
    o = s.options
    matched = c.named(F.col(ALIVE) & (c.when(match_column(o["match"], c.col)) if c.guard else match_column(o["match"], c.col)))
    hit = F.col(matched)
    if o["percentage"] == 100:
        c.df = c.df.withColumns({LABELS: F.when(hit, F.array_append(LABELS, F.lit(o["label"]))).otherwise(F.col(LABELS)), ALIVE: F.col(ALIVE) & ~hit})
        return
    if not c.order:
        raise ConfigError("a drop of less than 100 percent needs the order of arrival", s.line)
    share = lambda df: keep_share(df, matched, o["percentage"], c.keys, c.order, "_mr_ifdrop", c.seen.get(s.line))
    if c.matched:
        c.df = share(c.df)
    else:
        # Only what matches has to meet its key set; the rest, most records, passes by without a shuffle. Both branches compute the records, so
        # a second sampling step would compute them four times: it shuffles instead.
        rest = keep(c.df, ~hit).withColumn("_mr_ifdrop", F.lit(False))
        c.df = rest.unionByName(share(keep(c.df, hit)))
    c.matched[s.line] = matched
    gone = hit & F.col("_mr_ifdrop")
    c.df = c.df.withColumns({
        LABELS: F.when(gone, F.array_append(LABELS, F.lit(o["label"]))).when(hit, F.array_append(LABELS, F.lit("!" + o["label"]))).otherwise(F.col(LABELS)),
        ALIVE: F.col(ALIVE) & ~gone,
    }).drop("_mr_ifdrop")


_one = lambda s: {s.options["key"]}
register_step("block", _read_block, _block)
register_step("if", _read_if, _if, lambda s: set(s.options["match"]))
register_step("switch", _read_switch, _switch)
register_step("addFields", _read_add, _add, lambda s: set(s.options["fields"]) | {f for t in s.options["fields"].values() for f in templates.fields_of(t)})
register_step("delFields", _read_delete, _delete, lambda s: set(s.options["keys"]))
register_step("mapValue", _read_map, _map, _one)
register_step("extract", _read_extract, _extract, lambda s: {s.options["key"], *to_java(s.options["pattern"])[1]})
register_step("extractHead", _read_label("extractHead"), _label, lambda s: {s.options["key"], s.options["dest"]})
register_step("extractTail", _read_label("extractTail"), _label, lambda s: {s.options["key"], s.options["dest"]})
register_step("replace", _read_replace, _replace, _one)
register_step("truncate", _read_truncate, _truncate, _one)
register_step("unescape", _read_unescape, _unescape, _one)
register_step("redactEmail", _read_redact, _redact, _one)
register_step("parseTime", _read_time, _time, _one)
register_step("drop", _read_drop, _drop, lambda s: set(s.options["match"]))
