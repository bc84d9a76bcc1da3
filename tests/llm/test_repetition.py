import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import repetition as R
from millrace.llm.words import words, words_column
from pyspark.sql import functions as F


def brute(w, span):
    seen, covered = set(), set()
    for i in range(len(w) - span + 1):
        k = tuple(w[i : i + span])
        if k in seen:
            covered.update(range(i, i + span))
        seen.add(k)
    return len(w), len(covered)


def longest(w):
    best = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=8), st.integers(1, 6))
def test_like_brute_force(docs, span):
    got = R.repeated([np.array(d, np.int64) for d in docs], span)
    assert [g[:2] for g in got] == [brute(d, span) for d in docs]
    assert [g[2] for g in got] == [longest(d) for d in docs]


@settings(max_examples=100)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(x):
    order, _ = R.suffix_array(np.array(x, np.int64)) if x else (np.zeros(0, int), [])
    assert list(order) == sorted(range(len(x)), key=lambda i: x[i:])


def test_operator(spark):
    rng = random.Random(1)
    texts = [None, "", "a b c d", "a b c d e " * 3, "one two three four five six", " ".join(rng.choice("xyz") for _ in range(300)), "a1 b2 c3", "word " * 200_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a b c d e a b c d e", "z"), (3, texts[3], "z")], "n_words long, text string, key string")
    rows = R.repetition(df, "n_words", "text").collect()
    got = {r["key"]: r for r in rows}
    assert len(rows) == len(texts) + 2
    for i, t in enumerate(texts):
        n, rep = brute(words(t or ""), 5)
        assert got[i][1:4] == (n, rep, rep / n if n else 0.0)
    assert got[7]["longest_repeat"] == 199_999 and got[None]["repeated_words"] == 5
    assert R.over_limits(R.repetition(df, "key", "text")).count() == 5
    assert R.over_limits(R.repetition(df, "key", "text"), 1.1, 100_000).count() == 1
    assert R.repetition(df.limit(0), "key", "text").count() == 0


def test_words(spark):
    texts = ["Hello, World! x1 22 _a_b", "É à ²x ½y ٣z", "", "naïve-coöp", "a\tb\nc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(words_column(F.col("t"))).collect()]
    assert got == [" ".join(words(t)) for t in texts]
