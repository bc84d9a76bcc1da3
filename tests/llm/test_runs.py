import datetime
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import runs as R

T0, EPOCH = datetime.datetime(2024, 1, 1), datetime.datetime(1970, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "host string, ts timestamp_ntz, id long, log string, n string, level string")


def counted(groups):
    """What all records of some runs say of each word, at least and at most."""
    every = [Counter(r[3].split()) for g in groups for r in g]
    words = set().union(*every)
    return {w: min(c[w] for c in every) for w in words}, {w: max(c[w] for c in every) for w in words}


def alike(a, b):
    if len({r[3] for r in a + b}) == 1:
        return 1.0
    (la, ha), (lb, hb) = counted([a]), counted([b])
    return min(2 * sum(min(n, lb.get(w, 0)) for w, n in la.items()) / max(1, sum(ha.values()) + sum(hb.values())), 1 - 1e-9)


def records_of(rows):
    seen, recs = set(), []
    for h, t, i, log, *_ in rows:
        if not log or (i is not None and (h, t, i) in seen):
            continue
        seen.add((h, t, i))
        recs.append((h or "", t or datetime.datetime.min, -1 if i is None else i, " ".join(w for w in log.lower().split() if not any(c.isdigit() for c in w))))
    return sorted(recs, key=lambda r: r[:3])


def brute(rows, least=1.0, gap=None):
    """Runs as (host, n, lo, hi): all records in one place, and the best pair of all merged until none is left."""
    out = [[r] for r in records_of(rows)]
    tie = lambda r: int(R._ties(np.array([(r[1] - EPOCH) // datetime.timedelta(microseconds=1)]), np.array([r[2]]))[0])
    rated = {}
    while True:
        best = None
        for i in range(1, len(out)):
            a, b = out[i - 1], out[i]
            if a[0][0] != b[0][0] or (gap is not None and (b[0][1] - a[-1][1]).total_seconds() > gap):
                continue
            k = (a[0][2], b[0][2], b[-1][2])
            if k not in rated:
                rated[k] = alike(a, b)
            if rated[k] >= least and (best is None or (-rated[k], tie(b[0])) < best[:2]):
                best = (-rated[k], tie(b[0]), i)
        if best is None:
            return sorted((g[0][0], len(g), min(x[2] for x in g), max(x[2] for x in g)) for g in out)
        out[best[2] - 1 : best[2] + 1] = [out[best[2] - 1] + out[best[2]]]


def by_threshold(rows, least):
    """What merging wherever two records touch would give."""
    out = []
    for r in records_of(rows):
        if out and out[-1][-1][0] == r[0] and alike([out[-1][-1]], [r]) >= least:
            out[-1].append(r)
        else:
            out.append([r])
    return sorted((g[0][0], len(g), min(x[2] for x in g), max(x[2] for x in g)) for g in out)


def sample(seed, n=400):
    rng = random.Random(seed)
    texts = ["same event 1", "same event 22", "Other thing", "other THING", "x", "12 34", "a b c d e", "a b c d f", "a b c g f", "a h c g f", None, ""]
    rows, i = [], 0
    while len(rows) < n:
        text = rng.choice(texts)
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            i += 1
            host = rng.choice(["hot"] * 6 + ["b", None])
            rows.append((host, T0 + datetime.timedelta(seconds=i * rng.choice([1, 1, 50])), i, text, "z", "info"))
            if rng.random() < 0.1:
                rows.append(rows[-1])  # delivered again
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, least, gap, parts", [(1, 1.0, None, 1), (2, 1.0, None, 7), (3, 0.6, None, 7), (3, 0.6, None, 40), (3, 0.6, None, 1), (4, 1.0, 30, 5), (5, 0.7, 30, 11), (6, 0.6, None, 150)])
def test_like_brute_force(spark, monkeypatch, seed, least, gap, parts):
    monkeypatch.setattr(R, "FAN", 4)
    rows = sample(seed, 300)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = R.runs(frame(spark, rows), "host", "ts", "id", "log", min_run=3, min_similarity=least, max_gap=gap)
        assert sorted((r["entity"], r["n"], r["lo"], r["hi"]) for r in got.collect()) == brute(rows, least, gap)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_do_not_drift():
    """A chain of small changes is one run where records touch, and several by what all records of a run share."""
    rows = [("h", T0 + datetime.timedelta(seconds=i), i, text, "", "") for i, text in enumerate(["a b c d e", "a b c d f", "a b c g f", "a b h g f", "a i h g f"])]
    assert by_threshold(rows, 0.7) == [("h", 5, 0, 4)]
    assert len(brute(rows, 0.7)) > 1
    assert any(by_threshold(sample(s, 300), 0.6) != brute(sample(s, 300), 0.6) for s in (3, 5))


def test_collapsed_keeps_all_other_events(spark):
    rows = sample(9)
    out = R.collapsed(frame(spark, rows), "host", "ts", "id", "log", carry=["level", "log"]).collect()
    assert sum(r["n_records"] for r in out) == len({r[2] for r in rows})
    runs = [b for b in brute(rows) if b[1] >= 3]
    assert sorted(r["n_records"] for r in out if r["n_records"] > 1) == sorted(b[1] for b in runs)
    logs = {r[2]: r[3] for r in rows}
    assert all(r["log"] == logs[r["key"]] and r["level"] == "info" for r in out)
    assert all(r["duration_s"] == 0.0 for r in out if r["n_records"] == 1)


def test_edges(spark):
    rows = [("h", T0, None, "same", None, None)] * 3 + [("h", None, 5, "first", None, None)]
    got = sorted((r["n"], r["entity"]) for r in R.runs(frame(spark, rows), "host", "ts", "id", "log").collect())
    assert got == [(1, "h"), (3, "h")]  # records without an identifier are each their own
    assert R.found(frame(spark, []), "host", "ts", "id", "log").count() == 0
    assert R.collapsed(frame(spark, []), "host", "ts", "id", "log", carry=["n"]).count() == 0
    one = frame(spark, [("h", T0 + datetime.timedelta(seconds=i), i, "word " * 20_000, None, None) for i in range(5)])
    r = R.found(one, "host", "ts", "id", "log").first()
    assert (r["n"], r["lo"], r["hi"]) == (5, 0, 4)


def test_agglomerate():
    say = [R.Said.of(x) for x in ("a b c d", "a b c e", "x y", "x y", "x z")]
    assert R.similarity(say[0], say[1]) == 0.75 and R.similarity(R.Said.of("a b"), R.Said.of("b a")) < 1.0 and R.similarity(R.Said.of(""), R.Said.of("")) == 1.0
    assert R.similarity(say[0].join(say[1]), say[0]) == 2 * 3 / 9
    near, ties, limits = np.ones(5, bool), np.arange(5), R.Limits(0.5, None, 3)
    assert R.agglomerate(say, near, ties, limits)[0] == [0, 2]
    # With an open side the pair next to it waits, unless its records say the same.
    assert R.agglomerate(say[:2], near[:2], ties[:2], limits, open_right=True) == ([0, 1], say[:2], {1})
    assert R.agglomerate(say[2:4], near[:2], ties[:2], limits, True, True)[0] == [0]


def test_collapsed_with_records_without_text(spark):
    rows = [*sample(9), ("b", None, None, None, "z", "info"), ("b", None, None, None, "z", "info")]
    df = frame(spark, rows)
    out = R.collapsed(df, "host", "ts", "id", "log", carry=["level", "log"]).collect()
    distinct = {r[2] for r in rows if r[2] is not None}
    assert sum(r["n_records"] for r in out) == len(distinct) + 2
    bare = [r for r in out if not r["log"]]
    assert sorted(r["key"] for r in bare if r["key"] is not None) == sorted({r[2] for r in rows if r[2] is not None and not r[3]})
    assert all((r["n_records"], r["duration_s"], r["level"]) == (1, 0.0, "info") for r in bare)
    times = {r[2]: (r[0] or "", r[1], r[3]) for r in rows}
    assert all((r["entity"], r["started_at"], r["log"]) == times[r["key"]] for r in bare if r["key"] is not None)
