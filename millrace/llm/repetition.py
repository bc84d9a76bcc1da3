"""Share of a document that repeats what it said before, from a suffix array over its words.

The suffixes of many documents are sorted together in numpy, by prefix doubling; a word counts as another word in
another document, so no match leaves its document. Longest common prefixes come from the ranks of each doubling. Suffixes
that share `span` words or more form an interval; all of an interval's starts but the earliest are repeats, and the union
of their spans is the repeated part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import words
from millrace.session import ship

#: Words sorted at once. A longer document is sorted alone, whole.
CHUNK_WORDS = 400_000


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by doubling) of `ids`. Equal ranks at level k mean equal first 2**k items.

    Ranks are the places of groups in the sorted order, so that only suffixes still tied are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.r_[True, ids[order][1:] != ids[order][:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    levels = [rank.copy()]
    tied = ~(new & np.r_[new[1:], True])
    k = 1
    while tied.any():
        at = np.flatnonzero(tied)  # places in the order
        suffix = order[at]
        head = rank[suffix]
        key = head * (n + 2) + rank[np.minimum(suffix + k, n)] + 1
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[at] = suffix
        new = np.r_[True, key[1:] != key[:-1]]
        rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank.copy())
        tied[at] = ~(new & np.r_[new[1:], True])
        k *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the order."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    i, j = order[:-1], order[1:]
    live = np.flatnonzero(levels[0][i] == levels[0][j])
    a, b = i[live].copy(), j[live].copy()
    start = b.copy()
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        same = (ranks[np.minimum(a, n)] == ranks[np.minimum(b, n)]) & (a < n) & (b < n)
        step = same * (1 << level)
        a, b = a + step, b + step
    out[live + 1] = b - start
    return out


def repeated(docs: list[np.ndarray], span: int) -> list[tuple[int, int, int]]:
    """(words, repeated words, longest repeat) of each document, given as arrays of word numbers."""
    sizes = np.array([len(d) for d in docs], np.int64)
    n = int(sizes.sum())
    if not n:
        return [(0, 0, 0)] * len(docs)
    flat = np.concatenate(docs).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    # A word of one document is unlike the same word of another; the last suffixes of a document end in its own mark.
    ids = np.empty(n + len(docs), np.int64)
    at = np.arange(n) + doc
    vocabulary = int(flat.max()) + 2
    ids[at] = doc * vocabulary + flat
    ends = np.cumsum(sizes) + np.arange(len(docs))
    ids[ends] = np.arange(len(docs)) * vocabulary + vocabulary - 1
    order, levels = suffix_array(ids)
    lcp = common_prefixes(order, levels)
    heads = np.flatnonzero(lcp < span)
    earliest = np.minimum.reduceat(order, heads)
    group = np.cumsum(lcp < span) - 1
    later = order[order != earliest[group]]
    cover = np.zeros(len(ids) + span + 1, np.int64)
    np.add.at(cover, later, 1)
    np.add.at(cover, later + span, -1)
    covered = np.cumsum(cover)[: len(ids)] > 0
    covered[ends] = False
    longest_at = np.zeros(len(ids), np.int64)
    longest_at[order] = lcp
    first = ends - sizes
    total = np.add.reduceat(covered, first)
    longest = np.maximum.reduceat(longest_at, first)
    return [(int(s), int(c), int(m)) if s else (0, 0, 0) for s, c, m in zip(sizes, total, longest)]


def _batches(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            results: list[tuple[int, int, int]] = []
            vocabulary: dict[str, int] = {}
            docs: list[np.ndarray] = []
            held = 0
            for text in texts:
                t = text.as_py()
                found = [vocabulary.setdefault(w, len(vocabulary)) for w in words(t)] if t else []
                docs.append(np.array(found, np.int64))
                held += len(found)
                if held >= CHUNK_WORDS:
                    results += repeated(docs, span)
                    docs, held, vocabulary = [], 0, {}
            results += repeated(docs, span)
            n, rep, longest = (list(x) for x in zip(*results)) if results else ([], [], [])
            share = [r / k if k else 0.0 for k, r in zip(n, rep)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(rep, pa.int64()), pa.array(share, pa.float64()), pa.array(longest, pa.int64())], names=["key", "n_words", "repeated_words", "repeated_share", "longest_repeat"])

    return run


def repetition(df: DataFrame, key: str, text: str | Column, span: int = 5) -> DataFrame:
    """One row per row of ``df``: `key`, n_words, repeated_words, repeated_share, longest_repeat (words of the longest repeated stretch).

    A word is repeated if it lies in a stretch of `span` words that also starts at an earlier word of the text, overlaps
    included. Null and empty texts, and texts of under `span` words, have the share 0. Rows are not joined or gathered:
    repeated and null keys stay rows of their own, and other columns of ``df`` are not touched.
    """
    ship(df.sparkSession)
    t = F.col(text) if isinstance(text, str) else text
    source = df.select(F.col(key).alias("key"), t.alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(_batches(span), f"key {kind}, n_words bigint, repeated_words bigint, repeated_share double, longest_repeat bigint")
    return out.withColumnRenamed("key", key) if key not in ("n_words", "repeated_words", "repeated_share", "longest_repeat") else out


def over_limits(df: DataFrame, max_share: float = 0.30, max_longest: int | None = None) -> DataFrame:
    """Rows of `repetition` whose share reaches `max_share`, or whose longest repeat exceeds `max_longest` words."""
    test = F.col("repeated_share") >= max_share
    return df.filter(test if max_longest is None else test | (F.col("longest_repeat") > max_longest))
