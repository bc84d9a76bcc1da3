"""Texts cut off by a field limit or in transfer, found by hashed logistic regression on how texts end.

No text comes with a label. Texts of a bounded sample serve as intact ones, and cutting them, at any place or at a length where
texts of their source pile up, with a mark of truncation or without, makes the positives. Some of the sample are really cut: texts
that a model trained on the others takes for cut are set aside, and the last model is trained on the rest. It scores every text.

Features: the closing characters and words, alone and with the words a text opens with; open brackets and quotes; how often the
last word stands inside texts; how alike texts that open alike end, and what share of them end as this one; whether the length is one where texts of the source pile up.
Only the weights come from the sample. Counts are of all texts, and enter as shares, so that they mean the same at every size.

Every text is read once. What its features depend on (its parts) is a few tokens, and texts share them: tasks write the parts of each text as a
number, and what the number stands for once. Counts are joined to distinct parts, these are scored, and the scores joined back to the texts by number.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.encoding import restore
from millrace.session import ship, written

#: Bounds of the sample that the weights are trained on: rows, and bytes of text, both on average.
SAMPLE_ROWS, SAMPLE_BYTES = 24_000, 32_000_000
#: Cut copies of each intact text.
COPIES = 2
N_HASH = 1 << 18
#: Gradient steps of a model and rows of each, parts of the sample, and rounds of setting aside.
STEPS, STEP_ROWS, FOLDS, ROUNDS = 400, 2048, 3, 2
#: Share of cut texts assumed in training: cut copies weigh as much together.
PRIOR = 0.25
#: A text is set aside from this log-odds of being cut on.
ASIDE = -1.5
#: Texts that end as this share of this many texts that open alike are not set aside, unless at a limit or in dots: so many aren't cut at the same word by chance.
USUAL_SHARE, USUAL_TEXTS = 0.03, 50
#: A text counts as cut from this probability on.
THRESHOLD = 0.5
#: From this probability on a text beyond ASCII is judged by what it stands for, should it be garbled: a garbled ending looks new.
DOUBT = 0.1
#: Limits whose cut copies the sample is given, the most frequent ones. Texts at any limit, however many there are, have the feature.
COPIED_LIMITS = 20_000
#: Rows of limits, or of parts of restored texts, that are broadcast once they are counted; more of them are joined by shuffle.
BROADCAST_LIMITS = 100_000
# Marks that programs leave where they cut.
MARKS = ("...", "…", "...", "…", "...", "…", "…", "…", " ...", " …", " ... (cut)", " [..]", "[...]", " [...]", "<snip>", " <snip>", "\n  ... [truncated]", " [truncated]", "(truncated)", " ... [cut]", "...(more)", " (more)", "[cut]", "~")

#: A text that ends so is neither taken as intact nor as cut in training.
_MARKED = re.compile(r"[\[(<]\s*(?:\.{2,}|…|cut|snip|truncated|more)\s*[\])>]\s*\Z")
_DOTS = re.compile(r"(?:\.{2,}|…|~)\s*\Z")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TAIL = re.compile(r"[^\W_]+|[^\w\s]|_|\s+$")
_ZERO = bytes.maketrans(b"123456789", b"000000000")
_RUN = re.compile("0{2,}")
_HEX = re.compile(r"[0a-f]{4,}")
#: A name and its number, such as `acc678`, whose letters happen to be those of codes. Codes of 8 digits or more that look so are rare.
_NUMBERED = re.compile(r"([a-f]{3,6})0{1,4}")


@lru_cache(maxsize=200_000)
def _shape(token: str) -> str:
    """A token without what varies: numbers by length, codes by length, words as they are."""
    if token.isalpha() and token.isascii() is False:
        return token
    if "0" in token:
        n = len(token)
        if token == "0" * n:  # short numbers vary in length, and a cut one looks like any other
            return "0" if n < 5 else f"N{min(n, 14)}"
        if n < 8 and (m := _NUMBERED.fullmatch(token)):  # as for other names, the number may have any length
            return m[1] + "0"
        if _HEX.fullmatch(token):
            return f"h{min(n, 17)}"
        return _RUN.sub("0", token)
    if len(token) >= 4 and _HEX.fullmatch(token):
        return f"h{len(token)}" if len(token) in (4, 8, 12, 16) else token
    return token


def _head_keys(head: tuple) -> tuple[str, str]:
    """What a text opens with: its first words, and the words after a first setting such as `class=Name`."""
    return " ".join(head[:2]), " ".join(head[3:5])


def _tail_keys(tail: tuple) -> tuple[str, str]:
    return " ".join(tail[-1:]), " ".join(tail[-2:])


def _coarse_keys(tail: tuple) -> tuple[str, str]:
    """Tail keys without a full stop at the very end."""
    if len(tail) > 1 and tail[-1] in (".", "!") and tail[-2] not in (".", "!", "…"):
        tail = tail[:-1]
    return _tail_keys(tail)


def number(text: str) -> int:
    """64 bits that stand for a text, alike in every process."""
    n = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def parts(source: str, text: str, limit: bool) -> tuple:
    """What the features of a text depend on: texts with the same parts score the same."""
    # Digits are bytes of their own in UTF-8, and replacing bytes is faster than replacing characters.
    low = text.lower().encode("utf-8", "surrogatepass").translate(_ZERO).decode("utf-8", "surrogatepass")
    body = low.rstrip()
    head = tuple([_shape(m[0]) for m in islice(_TOKEN.finditer(low[:90]), 6)])
    end = body[-70:]
    # The first token of a piece may be half of one, so it takes five to have four.
    tokens = _TOKEN.findall(end[-32:])
    if len(tokens) < 5:
        tokens = _TOKEN.findall(end)
    last = tokens[-1] if tokens else ""
    opened = (text.count('"') % 2, min(max(text.count("{") - text.count("}"), 0), 2), min(max(text.count("[") - text.count("]"), 0), 1), min(max(text.count("(") - text.count(")"), 0), 1))
    return source, head, tuple([_shape(t) for t in tokens[-4:]]), _RUN.sub("0", end[-24:])[-4:], last if last.isalpha() else "", len(body) < len(low), opened, limit, body[-1:].isalnum()


#: Features that need no counts, and all.
N_FIXED, N_FEATURES = 24, 34


def fixed(p: tuple) -> list[int]:
    """Numbers of the features that need no counts."""
    source, head, tail, end, _, spaced, opened, limit, alnum = p
    (h2, h4), (t1, t2), h1, h5 = _head_keys(head), _tail_keys(tail), " ".join(head[:1]), " ".join(head[3:4])
    t3, o, lim = " ".join(tail[-3:]), "%d%d%d%d" % opened, "L" if limit else "-"
    names = (
        "b", f"s{source}", f"t1{t1}", f"t2{t2}", f"t3{t3}", f"e1{end[-1:]}", f"e2{end[-2:]}", f"e3{end[-3:]}", f"e4{end}", f"o{o}", f"os{o}{source}", f"l{lim}", f"la{lim}{source}{end[-1:] if not alnum else 'a'}", f"lo{lim}{o}",
        f"sp{spaced}{alnum}", f"h2{h2}|{t1}", f"h2{h2}|{t2}", f"h4{h4}|{t1}", f"h4{h4}|{t2}", f"hh{h2}", f"h1{h1}", f"h5{h5}", f"he{h2}{end[-1:]}", f"h4e{h4}{end[-1:]}",
    )
    return [crc32(x.encode("utf-8", "surrogatepass")) & (N_HASH - 1) for x in names]


def keys(p: tuple) -> tuple[list[int], list[int]]:
    """(openings, endings after them) whose counts the features need: for each of two openings and each of two endings."""
    heads, ends = [], []
    for i, h in enumerate(_head_keys(p[1])):
        for j, t in enumerate(_coarse_keys(p[2])):
            heads.append(number(f"{i}{j}{h}"))
            ends.append(number(f"{i}{j}{h}\n{t}"))
    return heads, ends


def word_key(word: str) -> int:
    return number(f"word {word}")


def _context(p: tuple) -> int:
    """The parts that counted features are combined with, in one number: source, length of the last word, whether it ends in a letter or digit, whether at a limit."""
    return (crc32(p[0].encode("utf-8", "surrogatepass")) & 0xFFFFF) << 5 | min(len(p[4]), 5) << 2 | bool(p[8]) << 1 | bool(p[7])


def _steps(x: np.ndarray, bounds: list[float]) -> np.ndarray:
    return np.searchsorted(bounds, x, side="right")


def counted(context: np.ndarray, count: np.ndarray, n: np.ndarray, square: np.ndarray, words: np.ndarray, total: float) -> np.ndarray:
    """Numbers of the features that need counts, a row per text.

    For each pair of opening and ending: how many other texts open so, how likely two of them end alike, and what share ends as this one. And how many times in `total` texts
    the last word stands inside one.
    """
    # An opening that hardly any other text has says nothing of how texts end: the words a text opens with stand for it.
    few = n[:, 2:] < 5
    back = lambda x: np.concatenate([x[:, :2], np.where(few, x[:, :2], x[:, 2:])], 1)
    count, n, square = back(count), back(n), back(square)
    share = count / np.maximum(n, 1)
    alike = square / np.maximum(n * (n - 1), 1)
    e = (_steps(n, [5, 20, 100]) * 7 + _steps(alike, [1e-3, 1e-2, 0.05, 0.2, 0.5])) * 8 + _steps(share, [1e-12, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 5e-2])
    seen = _steps(words / max(total, 1.0), [1e-12, 1e-5, 7.5e-5, 5e-4])
    source, length, alnum, limit = context >> 5, context >> 2 & 7, context >> 1 & 1, context & 1
    k = seen * 8 + length
    codes = [k, k << 20 | source, *e.T, e[:, 1] << 10 | e[:, 3], e[:, 0] << 10 | e[:, 2], (e[:, 1] << 10 | e[:, 3]) << 4 | seen << 1 | alnum, e[:, 1] << 2 | limit << 1 | alnum]
    with np.errstate(over="ignore"):
        mixed = [(c.astype(np.uint64) + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) for i, c in enumerate(codes)]
        return np.stack([((m ^ (m >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) & (N_HASH - 1) for m in mixed], 1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights of a logistic regression over feature numbers, by gradient steps that shrink feature by feature."""
    seen = np.bincount(x.ravel(), minlength=N_HASH)
    # What a single row shows is no rule: such features share one number, which stays 0.
    used = np.flatnonzero(seen >= 2)
    place = np.full(N_HASH, len(used))
    place[used] = np.arange(len(used))
    x = place[x]
    rng = np.random.default_rng(seed)
    w, sq = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-4)
    order, at = rng.permutation(len(y)), 0
    for _ in range(STEPS if len(y) else 0):
        rows = order[at : at + STEP_ROWS]
        at += STEP_ROWS
        if at >= len(order):
            order, at = rng.permutation(len(y)), 0
        f = x[rows]
        p = 1 / (1 + np.exp(-np.clip(w[f].sum(1), -30, 30)))
        d = np.repeat(weight[rows] * (y[rows] - p), f.shape[1])
        g = np.bincount(f.ravel(), d, len(w)) / 32 - 5e-6 * w
        g[-1] = 0.0
        sq += g * g
        w += 0.4 * g / np.sqrt(sq)
    out = np.zeros(N_HASH, np.float32)
    out[used] = w[:-1]
    return out


def cut(text: str, limits: list[int], rng: random.Random) -> tuple[str, bool] | None:
    """(a cut copy, whether it was cut at a limit), or None for a text too short to cut."""
    if len(text) < 4:
        return None
    raw = text.encode()
    fit = [x for x in limits if x < len(raw)]
    mark = rng.choice(MARKS) if rng.random() < 0.4 else ""
    if fit and rng.random() < 0.5:
        return raw[: rng.choice(fit)].decode("utf-8", "ignore") + mark, True
    n = rng.randint(max(1, len(text) // 8), len(text) - 1)
    if rng.random() < 0.3:
        n = rng.randint(max(1, len(text) - 12), len(text) - 1)
    return text[:n].rstrip() + mark if mark and rng.random() < 0.5 else text[:n] + mark, False


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# Operators


def limits_of(lengths: DataFrame) -> DataFrame:
    """Lengths at which the texts of a source pile up, from rows (source, n_bytes, n): as many as 4 times what lengths nearby hold, and 10 at least.

    The table of lengths has a row per source and length that occurs, so the work doesn't grow with the number of texts.
    """
    near = lengths.select("source", "n_bytes", "n", F.explode(F.sequence(F.col("n_bytes") - 5, F.col("n_bytes") + 5)).alias("at"))
    around = near.filter(F.col("at") != F.col("n_bytes")).groupBy("source", F.col("at").alias("n_bytes")).agg((F.sum("n") / 10).alias("usual"))
    return lengths.join(around, ["source", "n_bytes"], "left").filter((F.col("n") >= 10) & (F.col("n") >= 4 * F.coalesce("usual", F.lit(0.0)))).select("source", "n_bytes")


#: What a task remembers of parts it wrote, and of words it counts, at most.
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+(?=\W)")
_PARTS = "feats array<int>, heads array<bigint>, ends array<bigint>, word bigint, context bigint"


class _Writer:
    """Rows of parts: the number of each text's parts, and what the number stands for where this task didn't say so yet."""

    def __init__(self) -> None:
        self.said: dict[tuple, int] = {}
        self.numbers: list = []
        self.full: list[list] = [[], [], [], [], []]

    def add(self, p: tuple | None) -> None:
        if p is None:
            self.numbers.append(None)
            for c in self.full:
                c.append(None)
            return
        k = self.said.get(p)
        if k is not None:
            self.numbers.append(k)
            for c in self.full:
                c.append(None)
            return
        if len(self.said) >= REMEMBERED:
            self.said.clear()
        k = self.said[p] = number(repr(p))
        self.numbers.append(k)
        heads, ends = keys(p)
        for c, v in zip(self.full, (fixed(p), heads, ends, word_key(p[4]) if p[4] else None, _context(p))):
            c.append(v)

    def take(self) -> list[pa.Array]:
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
        out = [pa.array(self.numbers, pa.int64()), *[pa.array(c, k) for c, k in zip(self.full, kinds)]]
        self.numbers, self.full = [], [[], [], [], [], []]
        return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, source, doubtful text, parts, words) of (key, source, text, limit); words and how often they stand inside texts come as rows of their own."""
    out, words = _Writer(), Counter()
    names = ["key", "source", "text", "parts", "feats", "heads", "ends", "word", "context", "times", "is_text"]

    def flush(like: pa.RecordBatch) -> pa.RecordBatch:
        n = len(words)
        none = lambda k: pa.nulls(n, k)
        cols = [none(like.column(0).type), none(pa.string()), none(pa.string()), none(pa.int64()), none(pa.list_(pa.int32())), none(pa.list_(pa.int64())), none(pa.list_(pa.int64())), pa.array([word_key(w) for w in words], pa.int64()), none(pa.int64()), pa.array(list(words.values()), pa.int64()), pa.array([False] * n)]
        words.clear()
        return pa.RecordBatch.from_arrays(cols, names=names)

    last = None
    for b in batches:
        last, texts = b, b.column(2).to_pylist()
        for s, t, at in zip(b.column(1).to_pylist(), texts, b.column(3).to_pylist()):
            out.add(parts(s, t, at) if t else None)
        words.update(_WORD.findall("\n".join([t for t in texts if t]).lower()))
        doubtful = pa.array([t if t and not t.isascii() else None for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), doubtful, *out.take(), pa.nulls(len(texts), pa.int64()), pa.array([True] * len(texts))], names=names)
        if len(words) > REMEMBERED:
            yield flush(b)
    if last is not None and words:
        yield flush(last)


def _reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of what garbled texts stand for; texts that stand for themselves have none and keep their probability."""
    out = _Writer()
    for b in batches:
        for s, t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            fixed_ = restore(t)[1]
            out.add(parts(s, fixed_, bool(c & 1)) if fixed_ != t else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), *out.take()], names=["key", "source", "probability", "parts", "feats", "heads", "ends", "word", "context"])


def _examples(limits):
    """Training rows of (source, text, limit, rows): the text, as often as it occurs, and cut copies of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_source = limits.value
        for b in batches:
            ids, labels, unsure, dots, times, out = [], [], [], [], [], _Writer()
            for s, t, at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                k = number(f"{s}\n{t}")
                rng = random.Random(k)
                t = t if t.isascii() else restore(t)[1]
                rows = [(t, at, False)] + [(c[0], c[1], True) for c in (cut(t, by_source.get(s, []), rng) for _ in range(COPIES)) if c and c[0].strip() and c[0].strip() != t.strip()]
                for i, (x, limit, is_cut) in enumerate(rows):
                    out.said.clear()
                    out.add(parts(s, x, limit))
                    times.append(1 if is_cut else n)
                    ids.append(number(f"{k} {i}"))
                    labels.append(is_cut)
                    unsure.append(not is_cut and bool(_MARKED.search(x)))
                    dots.append(bool(_DOTS.search(x)))
            cols = out.take()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels), pa.array(unsure), pa.array(dots), pa.array(times, pa.int64()), *cols[1:]], names=["id", "cut", "unsure", "dots", "times", "feats", "heads", "ends", "word", "context"])

    return run


class Corpus:
    """Counts over all texts."""

    def __init__(self, distinct: DataFrame, words: DataFrame) -> None:
        """From distinct parts with the number of texts that have them (`n`), and words with how often they stand inside texts."""
        pairs = distinct.select("n", F.explode(F.arrays_zip("heads", "ends")).alias("p"))
        self.ends = written(pairs.groupBy(F.col("p.heads").alias("head"), F.col("p.ends").alias("at")).agg(F.sum("n").alias("count")), "snappy")
        self.heads = _heads(self.ends)
        self.words = words.groupBy(F.col("word").alias("at")).agg(F.sum("times").alias("count"))
        self.total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def counts(self, rows: DataFrame, key: str, own: Column, few: bool = False) -> DataFrame:
        """(key, counts of the four pairs and of the last word) of rows of parts. Where `own` holds the row is one of the texts counted, and leaves itself out.

        With `few`, `rows` were counted and are few enough to be broadcast: the tables of counts are then narrowed to what they ask for, and not shuffled.
        """
        one = F.col("one")
        wanted = rows.select(key, own.cast("int").alias("one"), F.posexplode(F.arrays_zip("heads", "ends")).alias("i", "p")).select(key, "one", "i", F.col("p.heads").alias("head"), F.col("p.ends").alias("at"))
        said = rows.filter("word is not null").select(key, F.lit(0).alias("one"), F.lit(4).alias("i"), F.lit(None).cast("bigint").alias("head"), F.col("word").alias("at"))
        ends, heads, words = self.ends, self.heads, self.words
        if few:
            ends = self.ends.join(F.broadcast(wanted.select("at").distinct()), "at", "left_semi")
            heads = _heads(self.ends.join(F.broadcast(wanted.select("head").distinct()), "head", "left_semi"))
            words = self.words.join(F.broadcast(said.select("at").distinct()), "at", "left_semi")
        known = ends.select("at", "count").unionByName(words)
        found = wanted.join(heads, "head", "left").unionByName(said.withColumns({"n": F.lit(None).cast("bigint"), "square": F.lit(None).cast("bigint")})).join(known, "at", "left")
        c = F.coalesce("count", F.lit(0))
        values = {"c": F.greatest(c - one, F.lit(0)), "n": F.greatest(F.coalesce("n", F.lit(0)) - one, F.lit(0)), "s": F.greatest(F.coalesce("square", F.lit(0)) - 2 * one * (c - one), F.lit(0))}
        columns = [F.max(F.when(F.col("i") == i, v)).alias(f"{name}{i}") for name, v in values.items() for i in range(4)]
        return found.groupBy(key).agg(*columns, F.max(F.when(F.col("i") == 4, c)).alias("words"))

    def numbered(self, rows: DataFrame, key: str, own: Column, few: bool = False) -> DataFrame:
        """``rows`` with their counts beside them."""
        return rows.join(self.counts(rows, key, own, few), key)


def _heads(ends: DataFrame) -> DataFrame:
    """Openings with the texts that have them, and how many pairs of those end alike."""
    return ends.groupBy("head").agg(F.sum("count").alias("n"), F.sum(F.col("count") * (F.col("count") - 1)).alias("square"))


_COUNTS = [f"{name}{i}" for name in "cns" for i in range(4)] + ["words"]


def _matrix(b: pa.RecordBatch, total: float) -> np.ndarray:
    """Feature numbers of rows with feats, context and counts."""
    column = lambda c: b.column(b.schema.names.index(c))
    feats = column("feats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FIXED).astype(np.int64)
    at = {c: column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) for c in _COUNTS}
    four = lambda name: np.stack([at[f"{name}{i}"] for i in range(4)], 1)
    return np.concatenate([feats, counted(column("context").to_numpy(zero_copy_only=False).astype(np.int64), four("c"), four("n"), four("s"), at["words"], total)], 1)


def _rate(weights, total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            p = probability(w[_matrix(b, total)].sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), b.column(2)], names=["parts", "probability", "context"])

    return run


def _train(examples: DataFrame, total: float) -> np.ndarray:
    """Weights from examples with their counts: folds are judged in tasks by models that haven't seen them, then all that stays is learnt."""
    spark = examples.sparkSession
    table = examples.select("cut", "unsure", "id", "times", "dots", "feats", "context", *_COUNTS).toArrow()
    if not table.num_rows:
        return np.zeros(N_HASH)
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    b = table.combine_chunks().to_batches()[0]
    x = _matrix(b, total)[order].astype(np.int32)
    y = b.column(0).to_numpy(zero_copy_only=False)[order].astype(bool)
    unsure = b.column(1).to_numpy(zero_copy_only=False)[order].astype(bool)
    times = b.column(3).to_numpy()[order].astype(np.float32)
    dots = b.column(4).to_numpy(zero_copy_only=False)[order].astype(bool)
    limit, alike, others = (b.column(b.schema.names.index(c)).fill_null(0).to_numpy(zero_copy_only=False)[order] for c in ("context", "c1", "n1"))
    usual = (others >= USUAL_TEXTS) & (alike >= USUAL_SHARE * others) & ~dots & (limit & 1 == 0)
    fold = np.random.default_rng(11).integers(0, FOLDS, len(y))
    whole = ~y
    # The examples of a bounded sample.
    shared = spark.sparkContext.broadcast((x, y, times))

    def weights(rows: np.ndarray) -> np.ndarray:
        x, y, times = shared.value
        n, m = float(times[rows & ~y].sum()), int((rows & y).sum())
        return fit(x[rows], y[rows].astype(float), np.where(y[rows], PRIOR * n / max(1, m), times[rows])) if n and m else np.zeros(N_HASH)

    def models(jobs: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
        packed = [(k, np.packbits(rows).tobytes()) for k, rows in jobs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(shared.value[1])).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([weights(rows).astype(np.float32).tobytes()], pa.binary())], names=["k", "w"])

        df = spark.createDataFrame(packed, "k int, rows binary").repartition(len(packed), "k")
        return {r["k"]: np.frombuffer(bytes(r["w"]), np.float32) for r in df.mapInArrow(run, "k int, w binary").collect()}

    keep = whole & ~unsure
    for _ in range(ROUNDS):
        made = models([(k, (keep | y) & (fold != k)) for k in range(FOLDS)])
        aside = unsure.copy()
        for k, w in made.items():
            aside |= (fold == k) & (w[x].sum(1) > ASIDE) & ~usual
        keep = whole & ~aside
    return models([(0, keep | y)])[0].copy()


def scores(df: DataFrame, key: str, text: str | Column, source: str | Column) -> DataFrame:
    """One row per row of ``df``: `key`, source, probability that the text was cut.

    Null and empty texts have the probability 0. A null source counts as ''. All texts give the lengths where they pile up and the counts, and all are scored;
    training takes rows by a hash of their content and key, about `SAMPLE_ROWS` and `SAMPLE_BYTES` at most. Repeated rows are scored alike; an empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(F.col(key).alias("key"), F.coalesce(col(source), F.lit("")).alias("source"), col(text).alias("text"), F.octet_length(col(text)).alias("n_bytes"))
    lengths = written(rows.filter("n_bytes > 0").groupBy("source", "n_bytes").agg(F.count(F.lit(1)).alias("n")))
    n, size = lengths.agg(F.sum("n"), F.sum(F.col("n") * F.col("n_bytes"))).first()
    limits = written(limits_of(lengths).join(lengths, ["source", "n_bytes"]))
    flags = limits.select("source", "n_bytes", F.lit(True).alias("limit"))
    if limits.count() <= BROADCAST_LIMITS:
        flags = F.broadcast(flags)
    marked = rows.join(flags, ["source", "n_bytes"], "left").select("key", "source", "text", F.coalesce("limit", F.lit(False)).alias("limit"))
    kind = rows.schema["key"].dataType.simpleString()
    read = written(marked.mapInArrow(_read, f"key {kind}, source string, text string, parts bigint, {_PARTS}, times bigint, is_text boolean"), "snappy")
    texts = read.filter("is_text")
    names = ["feats", "heads", "ends", "word", "context"]
    meant = texts.filter("feats is not null").select("parts", *names).dropDuplicates(["parts"])
    distinct = written(texts.filter("parts is not null").groupBy("parts").agg(F.count(F.lit(1)).alias("n")).join(meant, "parts"), "snappy")
    corpus = Corpus(distinct, read.filter("not is_text").select("word", "times"))
    by_source: dict[str, list[int]] = {}
    for r in limits.orderBy(F.desc("n"), "source", "n_bytes").limit(COPIED_LIMITS).collect():
        by_source.setdefault(r["source"], []).append(r["n_bytes"])
    part = min(1.0, 0.97 * SAMPLE_ROWS / n, SAMPLE_BYTES / size) if n else 0.0
    picked = marked.filter((F.octet_length("text") > 0) & (F.pmod(F.xxhash64("text", "source", "key"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))).groupBy("source", "text", "limit").agg(F.count(F.lit(1)).alias("times"))
    examples = written(picked.mapInArrow(_examples(spark.sparkContext.broadcast(by_source)), f"id bigint, cut boolean, unsure boolean, dots boolean, times bigint, {_PARTS}"))
    # Texts and examples look up their counts together. Numbers of examples are odd and those of parts even, so that no two are the same.
    asking = distinct.select(F.shiftleft("parts", 1).alias("id"), "parts", F.lit(None).cast("boolean").alias("cut"), F.lit(None).cast("boolean").alias("unsure"), F.lit(None).cast("boolean").alias("dots"), F.lit(None).cast("bigint").alias("times"), *names)
    asking = asking.unionByName(examples.select(F.shiftleft("id", 1).bitwiseOR(F.lit(1)).alias("id"), F.lit(None).cast("bigint").alias("parts"), "cut", "unsure", "dots", "times", *names))
    answered = written(corpus.numbered(asking, "id", ~F.coalesce("cut", F.lit(False))).select("id", "parts", "cut", "unsure", "dots", "times", "feats", "context", *_COUNTS), "snappy")
    total = float(corpus.total)
    weights = spark.sparkContext.broadcast(_train(answered.filter("cut is not null"), total))

    def rated(rows: DataFrame) -> DataFrame:
        return rows.select("parts", "feats", "context", *_COUNTS).mapInArrow(_rate(weights, total), "parts bigint, probability double, context bigint")

    first = written(rated(answered.filter("parts is not null")), "snappy")
    doubt = texts.filter("text is not null").select("key", "source", "text", "parts").join(first.filter(F.col("probability") > DOUBT), "parts").select("key", "source", "text", "context", "probability")
    again = written(doubt.mapInArrow(_reread, f"key {kind}, source string, probability double, parts bigint, {_PARTS}"))
    restored = again.filter("feats is not null").select("parts", *names).dropDuplicates(["parts"])
    few = restored.count() <= BROADCAST_LIMITS
    rerated = rated(corpus.numbered(restored, "parts", F.lit(False), few)).select("parts", "probability")
    second = again.filter("parts is not null").select("key", "source", "parts").join(rerated, "parts").unionByName(again.filter("parts is null").select("key", "source", "parts", "probability"))
    sure = texts.select("key", "source", "parts", F.col("text").isNotNull().alias("beyond")).join(first.select("parts", "probability"), "parts", "left")
    sure = sure.filter(~(F.col("beyond") & (F.coalesce("probability", F.lit(0.0)) > DOUBT)))
    out = sure.select("key", "source", F.coalesce("probability", F.lit(0.0)).alias("probability")).unionByName(second.select("key", "source", "probability"))
    return out.withColumnRenamed("key", key)


def found(df: DataFrame, key: str, text: str | Column, source: str | Column, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `scores` that count as cut."""
    return scores(df, key, text, source).filter(F.col("probability") >= threshold)


def report(df: DataFrame, key: str, text: str | Column, source: str | Column, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: n_records, n_truncated, share_truncated. Rows of the same key, source and probability are one record; rows with a null key count one by one."""
    s = scores(df, key, text, source)
    once = s.filter(F.col(key).isNotNull()).distinct().unionByName(s.filter(F.col(key).isNull()))
    return once.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("probability") >= threshold).alias("n_truncated")).withColumn("share_truncated", F.col("n_truncated") / F.col("n_records"))
