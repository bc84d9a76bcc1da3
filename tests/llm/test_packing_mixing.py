import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing as M
from millrace.llm import packing as P
from millrace.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 20), min_size=2, max_size=9), st.integers(1, 5))
def test_buckets_of_least_padding(hist, k):
    counts = np.zeros(15, int)
    for s, n in hist.items():
        counts[s] = n
    sizes = sorted(hist)

    def padding(bounds):
        return sum(hist[s] * (min(b for b in bounds if b >= s) - s) for s in sizes)

    best = min(padding([*c, sizes[-1]]) for c in itertools.combinations(sizes[:-1], min(k, len(sizes)) - 1))
    got = list(P.length_buckets(counts, k))
    assert len(got) <= k and padding(got) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(1, 50), st.integers(1, 60), st.booleans())
def test_plan(sizes, capacity, n_buckets, across):
    sizes = [s for s in sizes if s <= capacity]
    counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
    p = P.plan(counts, capacity, n_buckets, across)
    s = np.array(sizes, int)
    b = p.bucket(s)
    rank = np.array([list(b[:i]).count(x) for i, x in enumerate(b)], int)
    c = p.container(b, rank)
    fill = np.bincount(c, s, minlength=1) if len(s) else np.zeros(1)
    assert (fill <= capacity).all()
    assert len(set(c[s > 0])) == p.n_containers and (not len(s) or not p.n_containers or c.max() < p.n_containers)


def test_pack(spark):
    rows = [(None, 0), (1, None), (2, 10), (3, 25), (3, 25), (4, 7), (5, 3), (6, 20), (7, 1000)] + [(100 + i, 5) for i in range(300)]
    df = spark.createDataFrame([(k, n, "x", 1) for k, n in rows], "k long, n_tokens long, size string, pack int")
    packs = [("a", 10), ("b", 64)]
    out = P.pack(df, "k", packs).collect()
    for name, cap in packs:
        own = [r for r in out if r["pack_id"] == name]
        assert sum(r["n_tokens"] for r in own) == sum(n or 0 for _, n in rows)
        pieces = sum(max(1, math.ceil((n or 0) / cap)) for _, n in rows)
        assert len(own) == pieces
        fill = {}
        for r in own:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
            assert r["n_tokens"] == cap or r["n_tokens"] < cap and r["start_token"] == r["piece_no"] * cap
        assert max(fill.values()) <= cap and len(fill) <= math.ceil(sum(fill.values()) / cap) + 2
        assert sorted(fill) == list(range(len(fill)))
    c = P.containers(P.pack(df, "k", packs), packs)
    assert c.filter("fill > 1 or fill is null").count() == 0
    assert P.pack(df.limit(0), "k", packs).count() == 0 and P.pack(df, "k", []).count() == 0
    for bad in (0, -1, None, P.MAX_CAPACITY + 1):
        with pytest.raises(ValueError):
            P.pack(df, "k", [("x", bad)])


def test_hot_sizes_are_ranked_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED_TOGETHER", 10)
    df = spark.createDataFrame([(i, 3) for i in range(500)], "k long, n_tokens long")
    out = P.pack(df, "k", [("a", 10)]).groupBy("container_id").count().collect()
    assert len(out) == 167 and sorted(r["count"] for r in out)[1:] == [3] * 166


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>"), (5, "é" * 3), (6, "a" * 200_000)], "i int, t string")
    got = {r["i"]: r["n_tokens"] for r in tokens.token_counts(df, "t", {"i": "i"}).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1 and got[6] > 1000


def test_temperature():
    assert M.temperature([0.5, 0.5, 0.0], 3) == [0.5, 0.5, 0.0]
    s = [0.7, 0.2, 0.1]
    for target in (0.3, 0.6, 0.9):
        assert abs(M.entropy(M.temperature(s, M.exponent_for_entropy(s, target))) - target) < 1e-9
    assert M.between([0.9, 0.1], [0.5, 0.5], 0) == pytest.approx([0.9, 0.1]) and M.between([0.9, 0.1], [0.5, 0.5], 1) == pytest.approx([0.5, 0.5])


def test_budgets():
    t = [M.Target("m", "a", 0.5, 1, 1.0), M.Target("m", "b", 0.4, 2, 1.0), M.Target("m", "none", 0.1, 9, 1.0)]
    tokens_ = {"a": 900, "b": 100}
    for keep in ("shares", "size", "entropy"):
        got, _ = M.budgets(t, tokens_, 1000, keep)
        assert got[2][2] == 0 and all(x <= c.repeats * tokens_.get(c.source, 0) + 1e-6 for c, _, x in got)
    held, _ = M.budgets(t, tokens_, 1000, "shares")
    assert held[0][2] / held[1][2] == pytest.approx(5 / 4) and held[1][2] == pytest.approx(200)
    sized, e = M.budgets(t, tokens_, 1000)
    assert sized[0][2] + sized[1][2] == pytest.approx(1000) and sized[1][2] == pytest.approx(200) and 0 < e < 1
    loose = [M.Target("m", "a", 0.5, 9, 1.0), M.Target("m", "b", 0.5, 9, 1.0)]
    reached, e = M.budgets(loose, tokens_, 1000)
    assert e == 1.0 and reached[0][2] == pytest.approx(500)
    even, e = M.budgets(loose, tokens_, 1000, "entropy")
    assert e == pytest.approx(0, abs=1e-6) and even[0][2] == pytest.approx(500, rel=1e-3)
    # What is wanted is more than even natural shares allow: each source gives all it may.
    most, _ = M.budgets([M.Target("m", "a", 0.5, 1, 5.0), M.Target("m", "b", 0.5, 9, 5.0)], tokens_, 1000)
    assert [x for _, _, x in most] == pytest.approx([900, 900])


@settings(max_examples=200)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.floats(0, 100)), min_size=1, max_size=6), st.floats(0, 1))
def test_filled(parts, how_full):
    weights, caps = [w for w, _ in parts], [c for _, c in parts]
    size = how_full * sum(caps)
    got = M.filled(weights, caps, size)
    assert sum(got) == pytest.approx(size, abs=1e-6) and all(x <= c + 1e-9 for x, c in zip(got, caps))
    # Sources below their caps keep their proportions.
    rates = [x / w for x, w, c in zip(got, weights, caps) if x < c - 1e-9]
    assert not rates or max(rates) - min(rates) < 1e-6 * max(1.0, max(rates))


@pytest.mark.parametrize("blocks", [1, 3, 4096])
def test_mix(spark, monkeypatch, blocks):
    monkeypatch.setattr(M, "BLOCKS", blocks)
    monkeypatch.setattr(M, "BLOCK_TEXTS", 5)
    rows = [(i, "big" if i % 10 else "small", 1 + i % 7) for i in range(2000)] + [(9001, "big", 0), (9002, None, 5), (9003, "big", None), (9004, "other", 50)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id long, source string, n_tokens long, mix_id string")
    targets = [M.Target("x", "big", 0.5, 1, 0.2), M.Target("x", "small", 0.5, 3, 0.2), M.Target("y", "small", 0.9, 2, 1.0), M.Target("y", "absent", 0.1, 2, 1.0)]
    chosen, plan = M.mix(df, "id", targets, keep="shares")
    got = {r["mix_id"] + r["source"]: r for r in M.shares(chosen, plan).collect()}
    assert abs(got["xbig"]["actual_share"] - 0.5) < 0.01 and got["xbig"]["most_uses"] == 1 and got["xsmall"]["most_uses"] <= 3
    assert got["yabsent"]["tokens"] == 0 and got["ysmall"]["most_uses"] == 2 and got["ysmall"]["actual_share"] == 1.0
    sized = {r["mix_id"] + r["source"]: r for r in M.shares(*M.mix(df, "id", targets)).collect()}
    assert sized["xbig"]["mix_tokens"] == pytest.approx(sized["xbig"]["wanted_tokens"], rel=0.01) and sized["xbig"]["most_uses"] == 1 and sized["xsmall"]["most_uses"] <= 3
    assert chosen.groupBy("mix_id", "id").count().filter("count > 1").count() == 0
    assert M.mix(df.limit(0), "id", targets)[0].count() == 0 and M.mix(df, "id", [])[0].count() == 0


def test_read_targets(spark):
    df = spark.createDataFrame([("m", "a", 0.1, 2, 1.0), ("m", "a", 0.2, 3, None), ("m", None, None, None, 1.0)], "mix_id string, source string, target_share double, max_repeats int, size_factor double")
    t = M.read_targets(df)
    assert [(x.source, round(x.share, 3), x.repeats) for x in t] == [(None, 0.0, 1), ("a", 0.3, 3)]
