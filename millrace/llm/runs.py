"""Runs of the same event in ordered sequences, collapsed into one event with its count and duration.

Adjacent agglomeration: the runs of a sequence form a linked list, and a priority queue holds the similarity of each pair of
neighbours. The most similar pair merges first; the merged run is compared anew with both its neighbours; and so on until no pair meets
the similarity and gap limits. Two runs are as similar as any of their records surely are: a run knows, for each word, the least and the
most times one of its records says it, and the similarity of two runs is the share of words all their records have in common. A run so
never drifts from one event to another over small changes, as it would if only the records were compared where runs touch.

Merging makes a run less similar to its neighbours, never more. Two things follow, which let a sequence be cut anywhere and worked on in
pieces with the same result. Neighbours below the limit never merge, so they part a sequence for good. And a pair more similar than the
pairs on both its sides merges whatever lies beyond them; only pairs whose turn depends on what lies outside a piece wait until the pieces are put
together, which goes by a tree over their numbers. Pairs of the same similarity take turns by a hash of the record they meet at, so
that few have to wait. The table is cut by ranges of (entity, order), not by entity: one entity with most of all records is no burden.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.words import words_column
from millrace.session import ship, written

#: Pieces whose ends one task puts together.
FAN = 64
_NEVER = -(2**62)


@dataclass(frozen=True)
class Said:
    """What the records of a run say: their words if they all say the same, and how often each word occurs at least and at most."""

    same: str | None
    low: Counter
    high: Counter

    @staticmethod
    def of(words: str) -> Said:
        c = Counter(words.split())
        return Said(words, c, c)

    def join(self, other: Said) -> Said:
        return self if self.same is not None and self.same == other.same else Said(None, self.low & other.low, self.high | other.high)


def similarity(a: Said, b: Said) -> float:
    """Share of words that any record of one run has in common with any of the other, counted as often as they occur; 1 only for the same words in the same order."""
    if a.same is not None and a.same == b.same:
        return 1.0
    both = sum((a.low & b.low).values())
    return min(2.0 * both / max(1, a.high.total() + b.high.total()), 1.0 - 1e-9)


@dataclass(frozen=True)
class Limits:
    least: float
    #: Microseconds.
    max_gap: float | None
    min_run: int

    @property
    def exact(self) -> bool:
        """Whether runs say the same words in the same order: a digest then stands for what they say."""
        return self.least >= 1.0


def agglomerate(said: Sequence, near: np.ndarray, ties: np.ndarray, limits: Limits, open_left: bool = False, open_right: bool = False) -> tuple[list[int], list, set[int]]:
    """(first item of each run, what each run says, waiting): items merged with their neighbours, the most similar pair first.

    ``near[i]`` says whether item i may merge with the one before it; `said` holds digests with exact limits and `Said` else. With an open side there are more
    items there that aren't known: a pair whose turn depends on them stays unmerged, and `waiting` holds the first items of the right sides of such pairs.
    """
    n = len(said)
    said = list(said)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    score = [-1.0] * (n + 1)  # of the pair whose right run starts at i
    queue: list[tuple[float, int, int]] = []
    dead, waiting = set(), set()

    def rate(i: int) -> None:
        a, b = said[before[i]], said[i]
        s = float(a == b) if limits.exact else similarity(a, b)
        if s >= limits.least:
            score[i] = s
            heapq.heappush(queue, (-s, int(ties[i]), i))
        else:
            score[i] = -1.0

    if limits.exact:
        words = np.array(said, object)
        pairs = np.flatnonzero(near[1:] & (words[1:] == words[:-1])) + 1 if n > 1 else []
    else:
        pairs = np.flatnonzero(near[1:]) + 1 if n > 1 else []
    for i in map(int, pairs):
        rate(i)
    while queue:
        s, _, b = heapq.heappop(queue)
        if b in dead or score[b] != -s or b in waiting:
            continue
        a, c = before[b], after[b]
        left = open_left if a == 0 else a in waiting
        right = open_right if c == n else c in waiting
        # The same words change nothing about the run they join; anything else has to wait for a pair that may come first.
        if (left or right) and s > -1.0:
            waiting.add(b)
            continue
        said[a] = said[a] if limits.exact else said[a].join(said[b])
        after[a] = c
        dead.add(b)
        if c < n:
            before[c] = a
        for i in (a, c):
            if 0 < i < n and score[i] >= 0 and i not in waiting and s > -1.0:
                rate(i)
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = after[i]
    return starts, [said[i] for i in starts], waiting


def _ties(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A hash of a record's place, the same wherever a sequence is cut."""
    with np.errstate(over="ignore"):
        x = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(1)).astype(np.int64)


#: Parallel arrays of records or runs under way.
Items = dict[str, np.ndarray]
_NAMES = ("entity", "first_at", "last_at", "first_id", "known", "lo", "hi", "n", "said", "carry", "members")


def _objects(values: Sequence) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values if len(values) else []
    return out


def _records(entity: np.ndarray, at: np.ndarray, ids: np.ndarray, known: np.ndarray, said: Sequence, carry: Sequence | None) -> Items:
    n = len(at)
    boxed = np.empty(n, object)
    for i, x in enumerate(said):
        boxed[i] = x
    held = np.empty(n, object)
    if carry is not None:
        for i, x in enumerate(carry):
            held[i] = x
    return {
        "entity": entity, "first_at": at, "last_at": at, "first_id": ids, "known": known, "lo": np.where(known, ids, np.iinfo(np.int64).max), "hi": np.where(known, ids, np.iinfo(np.int64).min),
        "n": np.ones(n, np.int64), "said": boxed, "carry": held, "members": np.empty(n, object),
    }


def _pick(items: Items, rows: np.ndarray) -> Items:
    return {k: v[rows] for k, v in items.items()}


def _chain(a: Items | None, b: Items) -> Items:
    return b if a is None else {k: np.concatenate([a[k], b[k]]) for k in _NAMES}


def _member(items: Items, i: int) -> list[dict]:
    return items["members"][i] if items["n"][i] > 1 else [{"id": int(items["first_id"][i]) if items["known"][i] else None, "at": int(items["first_at"][i]), "carry": items["carry"][i]}]


def settle(items: Items, limits: Limits, open_left: bool, open_right: bool, apart: np.ndarray | None = None) -> tuple[Items, np.ndarray, np.ndarray]:
    """(runs, head, tail): items merged as far as it can be told. `head` and `tail` mark the runs that still depend on what lies beyond the open sides;
    `apart` marks items that don't touch the one before them."""
    m = len(items["n"])
    near = np.zeros(m, bool)
    near[1:] = items["entity"][1:] == items["entity"][:-1]
    if limits.max_gap is not None:
        near[1:] &= items["first_at"][1:] - items["last_at"][:-1] <= limits.max_gap
    if apart is not None:
        near &= ~apart
    starts_, said, waiting = agglomerate(items["said"], near, _ties(items["first_at"], items["first_id"]), limits, open_left, open_right)
    starts = np.array(starts_, np.int64)
    stops = np.r_[starts[1:], m]
    runs = {k: items[k][starts] for k in ("entity", "first_at", "first_id", "known", "carry", "members")}
    runs |= {"last_at": items["last_at"][stops - 1], "lo": np.minimum.reduceat(items["lo"], starts), "hi": np.maximum.reduceat(items["hi"], starts), "n": np.add.reduceat(items["n"], starts)}
    boxed = np.empty(len(starts), object)
    for i, x in enumerate(said):
        boxed[i] = x
    runs["said"] = boxed
    for k in np.flatnonzero(stops - starts > 1):
        runs["members"][k] = [x for i in range(starts[k], stops[k]) for x in _member(items, i)] if runs["n"][k] < limits.min_run else None
    k = len(starts)
    head, tail = np.zeros(k, bool), np.zeros(k, bool)
    if open_left:
        p = 1
        while p < k and starts_[p] in waiting:
            p += 1
        head[:p] = True
    if open_right:
        q = k - 1
        while q > 0 and starts_[q] in waiting:
            q -= 1
        tail[q:] = True
    return runs, head, tail


COLUMNS = ["entity", "first_at", "last_at", "first_id", "lo", "hi", "n", "part", "seq", "head", "tail", "same", "low", "high", "carry", "members"]


def _frame(runs: Items, rows: np.ndarray, limits: Limits, part: int, seq: int, head: np.ndarray, tail: np.ndarray) -> pd.DataFrame:
    """Runs as rows; what an open run says goes along."""
    r = _pick(runs, rows)
    n = len(rows)
    is_open = (head | tail)[rows]
    same, low, high = np.full(n, None, object), np.full(n, None, object), np.full(n, None, object)
    for i in np.flatnonzero(is_open):
        s = r["said"][i]
        if limits.exact:
            same[i] = s
        else:
            same[i], low[i], high[i] = s.same, " ".join(s.low.elements()), " ".join(s.high.elements())
    any_id = r["lo"] <= r["hi"]
    optional = lambda values, there: pd.arrays.IntegerArray(values.astype(np.int64), ~there)
    return pd.DataFrame({
        "entity": r["entity"], "first_at": r["first_at"], "last_at": r["last_at"], "first_id": optional(r["first_id"], r["known"]), "lo": optional(r["lo"], any_id), "hi": optional(r["hi"], any_id), "n": r["n"],
        "part": part, "seq": np.arange(seq, seq + n), "head": head[rows], "tail": tail[rows], "same": same, "low": low, "high": high, "carry": r["carry"], "members": r["members"],
    }, columns=COLUMNS)


def _items(f: pd.DataFrame, limits: Limits) -> Items:
    """Open runs read back."""
    if limits.exact:
        said = f["same"].tolist()
    else:
        said = [Said(s, Counter(a.split()), Counter(b.split())) for s, a, b in zip(f["same"], f["low"], f["high"])]
    ids = f["first_id"]
    known = ids.notna().to_numpy()
    out = _records(f["entity"].to_numpy(object), f["first_at"].to_numpy("int64"), ids.fillna(0).to_numpy("int64"), known, said, f["carry"].tolist())
    lo, hi = f["lo"], f["hi"]
    out |= {"last_at": f["last_at"].to_numpy("int64"), "n": f["n"].to_numpy("int64"), "lo": lo.fillna(np.iinfo(np.int64).max).to_numpy("int64"), "hi": hi.fillna(np.iinfo(np.int64).min).to_numpy("int64")}
    for i, m in enumerate(f["members"]):
        out["members"][i] = None if m is None else list(m)
    return out


def _pieces(limits: Limits, carried: bool, least_n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        held: Items | None = None  # runs at the end of what was read so far that may go on
        at_start = True  # whether the held runs reach back to the start of the piece
        last: tuple | None = None
        for f in frames:
            if not len(f):
                continue
            e, t, i = f["entity"].to_numpy(object), f["at"].to_numpy("int64"), f["id"]
            known = i.notna().to_numpy()
            ids = i.fillna(0).to_numpy("int64")
            # A record delivered again follows itself.
            again = np.r_[False, (e[1:] == e[:-1]) & (t[1:] == t[:-1]) & (ids[1:] == ids[:-1]) & known[1:] & known[:-1]]
            again[0] = last is not None and last == (e[0], t[0], ids[0], True) and bool(known[0])
            last = (e[-1], t[-1], ids[-1], bool(known[-1]))
            rows = np.flatnonzero(~again)
            if not len(rows):
                continue
            w = f["words"].to_numpy(object)[rows]
            said = w if limits.exact else [Said.of(x) for x in w]
            items = _chain(held, _records(e[rows], t[rows], ids[rows], known[rows], said, f["carry"].to_numpy(object)[rows] if carried else None))
            runs, head, tail = settle(items, limits, at_start, True)
            done = np.flatnonzero(~tail & (head | (runs["n"] >= least_n)))
            if len(done):
                yield _frame(runs, done, limits, part, seq, head, tail)
                seq += len(done)
            at_start = at_start and bool((head & tail).any())
            held = _pick(runs, np.flatnonzero(tail))
        if held is not None:
            whole = np.ones(len(held["n"]), bool)
            yield _frame(held, np.arange(len(whole)), limits, part, seq, whole & at_start, whole)

    return run


def _stitch(limits: Limits, closed: bool):
    """The open runs of neighbouring pieces put together; `closed` where no other pieces are left."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "seq"], kind="stable").reset_index(drop=True)
        part, head, tail = f["part"].to_numpy(), f["head"].to_numpy(bool), f["tail"].to_numpy(bool)
        # Inside a piece, what is open to its start doesn't touch what is open to its end: closed runs lie between.
        apart = np.zeros(len(f), bool)
        apart[1:] = (part[1:] == part[:-1]) & (tail[1:] != tail[:-1])
        runs, h, t = settle(_items(f, limits), limits, not closed, not closed, apart)
        return _frame(runs, np.arange(len(h)), limits, int(key[0]), 0, h, t)

    return run


def runs(
    df: DataFrame,
    entity: str | Column,
    at: str | Column,
    key: str | Column,
    text: str | Column,
    *,
    min_run: int = 3,
    min_similarity: float = 1.0,
    max_gap: float | None = None,
    carry: Sequence[str] = (),
    only_long: bool = False,
) -> DataFrame:
    """One row per run, runs of one record included: entity, first_at, last_at, first_id, n, lo, hi, carry (of its first record), members.

    The records of an entity are taken in the order of (`at`, `key`); `key` is a whole number that identifies a record, so
    that a record that occurs again counts once. A null `key` is always a record of its own. Null entities form one sequence
    and null times come first. Records whose text is null or empty are left out. Texts without any word are alike. `members` lists
    the records of runs of two and more that are shorter than `min_run`. With `only_long` runs shorter than `min_run` are left out.

    ``min_similarity`` 1 asks for the same words in the same order; less compares the words as bags. ``max_gap`` is in seconds, between records next to each other.
    """
    ship(df.sparkSession)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    t = col(text)
    limits = Limits(min(min_similarity, 1.0), None if max_gap is None else max_gap * 1e6, min_run)
    said = words_column(t)
    fields = [
        F.coalesce(col(entity), F.lit("")).alias("entity"),
        F.coalesce(F.unix_micros(col(at).cast("timestamp")), F.lit(_NEVER)).alias("at"),
        col(key).cast("bigint").alias("id"),
        # Without near-matches a digest of the words is enough, and the text stays behind.
        (F.md5(said) if limits.exact else said).alias("words"),
    ]
    if carry:
        fields.append(F.struct(*carry).alias("carry"))
    source = df.filter(t.isNotNull() & (t != "")).select(*fields)
    kind = source.schema["carry"].dataType if carry else T.StringType()
    ordered = source.repartitionByRange("entity", "at", "id").sortWithinPartitions("entity", "at", "id")
    member = T.StructType().add("id", "long").add("at", "long").add("carry", kind)
    schema = T.StructType()
    for name in COLUMNS:
        schema.add(name, {"entity": "string", "head": "boolean", "tail": "boolean", "same": "string", "low": "string", "high": "string", "carry": kind, "members": T.ArrayType(member)}.get(name, "long"))
    pieces = ordered.mapInPandas(_pieces(limits, bool(carry), min_run if only_long else 1), schema)
    # Written, as it is read more than once, and so that a lost executor can't give the pieces other borders.
    pieces = written(pieces)
    out, ends = [pieces.filter("not (head or tail)")], pieces.filter("head or tail")
    n = ends.agg(F.max("part")).first()[0]
    n = 0 if n is None else n + 1
    while n:
        n = -(-n // FAN) if n > 1 else 0
        ends = ends.groupBy(F.floor(F.col("part") / FAN).alias("_mr_group")).applyInPandas(_stitch(limits, n <= 1), schema)
        if n <= 1:
            out.append(ends)
            break
        out.append(ends.filter("not (head or tail)"))
        ends = ends.filter("head or tail")
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole.drop("part", "seq", "head", "tail", "same", "low", "high").filter(F.col("n") >= (min_run if only_long else 1))


def found(df: DataFrame, entity: str | Column, at: str | Column, key: str | Column, text: str | Column, *, min_run: int = 3, **limits) -> DataFrame:
    """Runs of at least `min_run` records: entity, lo, hi (smallest and largest key), n, first_at, last_at."""
    return runs(df, entity, at, key, text, min_run=min_run, only_long=True, **limits)


def collapsed(df: DataFrame, entity: str | Column, at: str | Column, key: str | Column, text: str | Column, *, carry: Sequence[str] = (), min_run: int = 3, **limits) -> DataFrame:
    """One row per event: a run of at least `min_run` records as one event, any other record unchanged.

    Records whose text is null or empty are events of their own, each key once; they neither belong to a run nor end one.

    Columns: entity, key (of the first record), started_at, n_records, duration_s, and the `carry` columns of the first record.
    """
    kind = df.select(F.col(at) if isinstance(at, str) else at).schema[0].dataType
    r = runs(df, entity, at, key, text, min_run=min_run, carry=carry, **limits)
    long = F.col("n") >= min_run
    first = F.array(F.struct(F.col("first_id").alias("id"), F.col("first_at").alias("at"), "carry"))
    rows = r.select("entity", "n", (F.col("last_at") - F.col("first_at")).alias("span"), F.explode(F.when(long | (F.col("n") == 1), first).otherwise(F.col("members"))).alias("e"))
    events = rows.select(
        "entity",
        F.col("e.id").alias("key"),
        F.when(F.col("e.at") > _NEVER, F.timestamp_micros("e.at")).cast(kind).alias("started_at"),
        F.when(long, F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("n_records"),
        F.when(long, F.col("span") / F.lit(1e6)).otherwise(F.lit(0.0)).alias("duration_s"),
        *[F.col(f"e.carry.{c}").alias(c) for c in carry],
    )
    col = lambda c: F.col(c) if isinstance(c, str) else c
    t = col(text)
    rest = df.filter(t.isNull() | (t == "")).select(
        F.coalesce(col(entity), F.lit("")).alias("entity"), col(key).cast("bigint").alias("key"), col(at).alias("started_at"), F.lit(1).cast("bigint").alias("n_records"), F.lit(0.0).alias("duration_s"), *carry
    )
    # As in runs: a record that occurs again has the same entity, time and key, and a null key is a record of its own.
    once = rest.filter("key is not null").dropDuplicates(["entity", "started_at", "key"])
    return events.unionByName(once).unionByName(rest.filter("key is null"))
