"""Programs: read from YAML, strictly, into typed parts.

Every node keeps the line it stands on. Unknown keys and types, missing values, fields the schema lacks and patterns that don't compile are
errors when the program is read. `type` comes first in a node that has one; the section `anchors` is skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from millrace.errors import ConfigError
from millrace.functions.matchers import Predicate, predicate
from millrace.schema import SYSLOG_FIELDS, Schema

_STR = "tag:yaml.org,2002:"


class Node:
    """A YAML node whose parts are asked for by name, and which knows what was asked."""

    def __init__(self, node: yaml.Node, what: str) -> None:
        self.node, self.what = node, what
        self.line, self.column = node.start_mark.line + 1, node.start_mark.column + 1

    def error(self, message: str) -> ConfigError:
        return ConfigError(f"{self.what}: {message}", self.line)

    def mapping(self) -> dict[str, Node]:
        if not isinstance(self.node, yaml.MappingNode):
            raise self.error("a mapping is needed")
        out: dict[str, Node] = {}
        for k, v in self.node.value:
            if k.tag == f"{_STR}merge":
                raise self.error("merge keys are not supported")
            if k.value in out:
                raise ConfigError(f"{self.what}: {k.value} occurs twice", k.start_mark.line + 1)
            out[k.value] = Node(v, f"{self.what}.{k.value}")
        return out

    def sequence(self, least: int = 0) -> list[Node]:
        if isinstance(self.node, yaml.ScalarNode) and self.node.tag == f"{_STR}null":
            items: list[Node] = []
        elif isinstance(self.node, yaml.SequenceNode):
            items = [Node(x, f"{self.what}[{i}]") for i, x in enumerate(self.node.value)]
        else:
            raise self.error("a list is needed")
        if len(items) < least:
            raise self.error("is empty")
        return items

    def text(self, allow_empty: bool = False) -> str:
        if not isinstance(self.node, yaml.ScalarNode):
            raise self.error("a text is needed")
        if self.node.tag == f"{_STR}null" and self.node.style is None:
            value = ""
        else:
            value = self.node.value
        if not value and not allow_empty:
            raise self.error("is empty")
        return value

    def integer(self, low: int, high: int) -> int:
        try:
            n = int(self.text())
        except ValueError:
            raise self.error(f"a whole number is needed: {self.text()}") from None
        if not low <= n <= high:
            raise self.error(f"must be from {low} to {high}: {n}")
        return n

    def boolean(self) -> bool:
        v = self.text().lower()
        if v not in ("true", "false", "yes", "no", "on", "off"):
            raise self.error(f"true or false is needed: {v}")
        return v in ("true", "yes", "on")

    def take(self, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> dict[str, Node]:
        m = self.mapping()
        for k in m:
            if k not in required and k not in optional:
                raise ConfigError(f"{self.what}: unknown key {k}", m[k].line)
        for k in required:
            if k not in m:
                raise self.error(f"{k} is missing")
        return m

    def typed(self) -> str:
        """The value of `type`, which must be the first key."""
        if not isinstance(self.node, yaml.MappingNode) or not self.node.value or self.node.value[0][0].value != "type":
            raise self.error("the first key must be type")
        return self.mapping()["type"].text()


def read_match(node: Node, schema: Schema) -> dict[str, Predicate]:
    out: dict[str, Predicate] = {}
    for name, v in node.mapping().items():
        schema.require(name, v.line)
        if not isinstance(v.node, yaml.ScalarNode):
            raise v.error("a value is needed")
        tag = v.node.tag
        tag = tag.removeprefix(_STR) if tag.startswith(_STR) else tag.lstrip("!")
        if tag in ("int", "float", "bool", "null", "timestamp"):
            tag = "str"
        value = "" if v.node.tag == f"{_STR}null" and v.node.style is None else v.node.value
        out[name] = predicate(tag, value, v.line, v.column)
    if not out:
        raise node.error("is empty")
    return out


@dataclass
class Step:
    """One transformation, with the steps inside it."""

    type: str
    line: int
    options: dict[str, Any] = field(default_factory=dict)
    #: Steps of a block or a condition; the cases of a switch as (match, steps).
    steps: list[Step] = field(default_factory=list)
    cases: list[tuple[dict[str, Predicate], list[Step]]] = field(default_factory=list)


#: Readers of step types by name: (node, schema) -> Step. `millrace.plans.steps` registers those of the language.
STEP_READERS: dict[str, Callable[[Node, Schema], Step]] = {}


def read_steps(node: Node, schema: Schema, least: int = 0) -> list[Step]:
    out = []
    for n in node.sequence(least):
        kind = n.typed()
        if kind not in STEP_READERS:
            raise ConfigError(f"{n.what}: unknown type {kind}", n.line)
        out.append(STEP_READERS[kind](n, schema))
    return out


@dataclass
class SyslogInput:
    address: str
    levels: tuple[str, ...]
    extractions: list[Step]
    source: str = ""


@dataclass
class Orchestration:
    """`byKeySet`: one pipeline per distinct key set, whose records keep their order. `singleton`: one for all."""

    type: str
    keys: tuple[str, ...]
    tag: str


@dataclass
class Rewrite:
    type: str  # inline, copy, unescape
    field: str = ""


@dataclass
class Buffer:
    type: str
    root_path: str
    max_size: int


@dataclass
class Output:
    name: str
    type: str
    environment: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    rewrites: dict[str, list[Rewrite]] = field(default_factory=dict)
    message_mode: str = "CompressedPackedForward"
    upstream: dict[str, Any] = field(default_factory=dict)
    buffer: Buffer | None = None


@dataclass
class Program:
    schema: Schema
    inputs: list[SyslogInput]
    orchestration: Orchestration
    metric_keys: tuple[str, ...]
    transformations: list[Step]
    outputs: list[Output]

    def fields_used(self) -> set[str]:
        from millrace.plans.steps import fields_of_steps

        used = set(self.orchestration.keys) | set(self.metric_keys) | set(SYSLOG_FIELDS) & set(self.schema.fields)
        used |= fields_of_steps([*[s for i in self.inputs for s in i.extractions], *self.transformations])
        for o in self.outputs:
            used |= set(o.environment) | set(o.rewrites) | {r.field for rs in o.rewrites.values() for r in rs if r.field}
        return used

    def unused_fields(self) -> list[str]:
        return [f for f in self.schema.fields if f not in self.fields_used()]

    def fixed_fields(self) -> set[str]:
        """Fields that inputs and orchestration use: a reload may not move them."""
        from millrace.plans.steps import fields_of_steps

        return set(SYSLOG_FIELDS) & set(self.schema.fields) | set(self.orchestration.keys) | fields_of_steps([s for i in self.inputs for s in i.extractions])


def load(path: str | Path) -> Program:
    return loads(Path(path).read_text(encoding="utf-8"))


def loads(text: str) -> Program:
    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from None
    if root is None:
        raise ConfigError("the program is empty")
    return read_program(Node(root, "program"))


def read_program(root: Node) -> Program:
    import millrace.plans.steps  # noqa: F401  # registers the step types

    m = root.take(("schema", "inputs", "orchestration", "outputBufferPairs"), ("anchors", "metricKeys", "transformations"))
    s = m["schema"].take(("fields",), ("maxFields",))
    fields = tuple(f.text() for f in s["fields"].sequence(1))
    schema = Schema(fields, s["maxFields"].integer(1, 10_000) if "maxFields" in s else len(fields))
    inputs = [_read_input(n, schema) for n in m["inputs"].sequence(1)]
    orchestration = _read_orchestration(m["orchestration"], schema)
    keys: list[str] = []
    for n in m["metricKeys"].sequence() if "metricKeys" in m else []:
        k = schema.require(n.text(), n.line)
        if k in orchestration.keys:
            raise n.error(f"{k} is a key of the orchestration already")
        if k in keys:
            raise n.error(f"{k} occurs twice")
        keys.append(k)
    steps = read_steps(m["transformations"], schema) if "transformations" in m else []
    outputs = [_read_output(n, schema) for n in m["outputBufferPairs"].sequence(1)]
    names = [o.name for o in outputs]
    if len(set(names)) < len(names):
        raise m["outputBufferPairs"].error("names occur twice")
    return Program(schema, inputs, orchestration, tuple(keys), steps, outputs)


def _read_input(n: Node, schema: Schema) -> SyslogInput:
    kind = n.typed()
    if kind != "syslog":
        raise n.error(f"unknown type {kind}")
    m = n.take(("type", "address", "levelMapping", "extractions"))
    for f in SYSLOG_FIELDS:
        schema.require(f, n.line)
    levels = tuple(x.text(allow_empty=True) for x in m["levelMapping"].sequence())
    if len(levels) != 8:
        raise m["levelMapping"].error(f"8 levels are needed, not {len(levels)}")
    return SyslogInput(m["address"].text(), levels, read_steps(m["extractions"], schema, 1))


def _read_orchestration(n: Node, schema: Schema) -> Orchestration:
    from millrace.functions.templates import fields_of

    kind = n.typed()
    if kind == "byKeySet":
        m = n.take(("type", "keys", "tag"))
        keys = tuple(schema.require(k.text(), k.line) for k in m["keys"].sequence(1))
        if len(set(keys)) < len(keys):
            raise m["keys"].error("keys occur twice")
        tag = m["tag"].text()
        for f in fields_of(tag):
            if f not in keys:
                raise m["tag"].error(f"{f} is not one of the keys")
        return Orchestration(kind, keys, tag)
    if kind == "singleton":
        m = n.take(("type", "tag"))
        if fields_of(m["tag"].text()):
            raise m["tag"].error("has no fields to use")
        return Orchestration(kind, (), m["tag"].text())
    raise n.error(f"unknown type {kind}")


_UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "KIB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "MIB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "GIB": 1 << 30, "T": 1 << 40, "TB": 1 << 40, "TIB": 1 << 40}


def _size(n: Node) -> int:
    t = n.text().strip()
    digits = t.rstrip("".join({c for u in _UNITS for c in u + u.lower()}) + " ")
    unit = t[len(digits) :].strip().upper()
    try:
        return int(float(digits) * _UNITS[unit])
    except (ValueError, KeyError):
        raise n.error(f"not a size: {t}") from None


def _read_output(n: Node, schema: Schema) -> Output:
    m = n.take(("name", "buffer", "output"))
    name = m["name"].text()
    kind = m["buffer"].typed()
    if kind != "hybridBuffer":
        raise m["buffer"].error(f"unknown type {kind}")
    b = m["buffer"].take(("type", "rootPath", "maxBufSize"))
    buffer = Buffer(kind, b["rootPath"].text(), _size(b["maxBufSize"]))
    o = m["output"]
    kind = o.typed()
    listed = lambda x: tuple(schema.require(f.text(), f.line) for f in x.sequence())
    if kind == "fluentdForward":
        p = o.take(("type", "serialization", "messageMode", "upstream"))
        s = p["serialization"].take(("environmentFields",), ("hiddenFields", "rewriteFields"))
        env = tuple(schema.require(f.text(), f.line) for f in s["environmentFields"].sequence(1))
        mode = p["messageMode"].text()
        if mode not in ("Forward", "PackedForward", "CompressedPackedForward"):
            raise p["messageMode"].error(f"unknown mode {mode}")
        rewrites = {}
        for f, x in (s["rewriteFields"].mapping() if "rewriteFields" in s else {}).items():
            schema.require(f, x.line)
            rewrites[f] = [_read_rewrite(r, schema) for r in x.sequence(1)]
            if rewrites[f][-1].type == "inline":
                raise x.error("inline can't be the last rewrite")
            if any(r.type != "inline" for r in rewrites[f][:-1]):
                raise x.error("copy and unescape must be the last rewrite")
        return Output(name, kind, env, listed(s["hiddenFields"]) if "hiddenFields" in s else (), rewrites, mode, _plain(p["upstream"]), buffer)
    if kind == "datadog":
        p = o.take(("type", "serialization", "upstream"))
        s = p["serialization"].take((), ("hiddenFields",))
        return Output(name, kind, (), listed(s["hiddenFields"]) if "hiddenFields" in s else (), {}, "", _plain(p["upstream"]), buffer)
    raise o.error(f"unknown type {kind}")


def _read_rewrite(n: Node, schema: Schema) -> Rewrite:
    kind = n.typed()
    if kind == "inline":
        m = n.take(("type", "field"))
        return Rewrite(kind, schema.require(m["field"].text(), m["field"].line))
    if kind in ("copy", "unescape"):
        n.take(("type",))
        return Rewrite(kind)
    raise n.error(f"unknown type {kind}")


def _plain(n: Node) -> dict[str, Any]:
    return {k: v.text(allow_empty=True) for k, v in n.mapping().items()}


# Reload


def check_reload(old: Program, new: Program) -> None:
    """Whether a running program may be replaced: inputs, orchestration and the places of fields they use must stay, fields may be appended."""
    if old.schema.max_fields != new.schema.max_fields:
        raise ConfigError(f"maxFields can't change: {old.schema.max_fields} to {new.schema.max_fields}")
    if [(i.address, i.levels, i.extractions) for i in old.inputs] != [(i.address, i.levels, i.extractions) for i in new.inputs]:
        # Lines may move; what the inputs say may not.
        if _bare(old.inputs) != _bare(new.inputs):
            raise ConfigError("inputs can't change")
    if old.orchestration.type != new.orchestration.type:
        raise ConfigError(f"orchestration can't change from {old.orchestration.type} to {new.orchestration.type}")
    if old.orchestration.keys != new.orchestration.keys:
        raise ConfigError(f"orchestration keys can't change: {list(old.orchestration.keys)} to {list(new.orchestration.keys)}")
    for f in sorted(old.fixed_fields()):
        before = old.schema.fields.index(f)
        after = new.schema.fields.index(f) if f in new.schema.fields else -1
        if before != after:
            raise ConfigError(f"field {f} is used by inputs or orchestration and can't move from place {before} to {after}")


def _bare(x: Any) -> Any:
    """Without line numbers."""
    if isinstance(x, (list, tuple)):
        return [_bare(v) for v in x]
    if isinstance(x, dict):
        return {k: _bare(v) for k, v in x.items()}
    if hasattr(x, "__dataclass_fields__"):
        return {k: _bare(getattr(x, k)) for k in x.__dataclass_fields__ if k != "line"}
    return x
