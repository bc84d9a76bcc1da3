import itertools
import pickle
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import pii as P
from millrace.llm import pii_examples as X

GIVEN, FAMILY = ("Berae", "Lola", "Keen", "Vara"), ("Dumoforth", "Hiweigo", "Kilmoowicz", "Trellis")


@pytest.fixture(scope="module")
def tagger():
    return P.trained(GIVEN, FAMILY)


def test_lines_of_forms_it_has_not_seen():
    """Trained without a third of the labelled rows, judged by those rows: recall and precision per kind and line, with names that are on no list half of the time."""
    given = tuple({P._word(random.Random(i)).title() for i in range(70)})
    family = tuple({P._word(random.Random(500 + i), 1, 2).title() + "son" for i in range(70)})
    learnt, judged = X.held_out([x for x in X.LINES.split("\n") if x], 1)
    assert not set(learnt) & set(judged)
    t = P.Tagger(given, family)
    t.fit(P.examples(given, family, rows=learnt))
    lines = P.examples(given, family, draws=6, seed=99, rows=judged)
    right, found, there = Counter(), Counter(), Counter()
    for (_, spans), got in zip(lines, t.find([text for text, _ in lines])):
        a, b = {k for *_, k in spans}, {k for *_, k in got}
        there.update(a), found.update(b), right.update(a & b)
    recall, precision = {k: right[k] / there[k] for k in P.KINDS}, {k: right[k] / found[k] for k in P.KINDS}
    assert min(precision.values()) > 0.9, precision
    assert min(recall.values()) > 0.8 and sum(recall.values()) / 5 > 0.9, recall


def kinds(tagger, text):
    return {k for *_, k in tagger.find([text])[0]}


@pytest.mark.parametrize("text, want", [
    ("Consent form signed by Berae Dumoforth on 2024-01-02T03:04:05.678Z", {"name"}), ("Node Lola rejoined ring harbour, term 12", set()), ("Waiting for keen trellis lock...", set()), ("Recovery number changed to +44 1632 960094 on acc12", {"phone"}),
    ("Delivered notice 814177402 to <lola.hiweigo@mill-lane.invalid>", {"email"}), ("Handed notice 2557580611 to relay pool@406bab77", set()), ("image silo@sha256:9dbe423d3a01045d resolved, version v3.7.8@latest", set()), ("Identity check passed, SSN 908-30-4953, case 6548207497", {"id_number"}),
    ("Row 12 lacks town, kept street 102 Kiln Road, Drirby", {"address"}), ("Street tiles 841 loaded, lane 136 of north map hidden", set()), ("Masked value REDACTED kept in tally export 321", set()), ("Upstream moor refused shelf request 768024e2-13e7-1811-9090-005555558068: stale handle", set()),
])
def test_lines(tagger, text, want):
    assert kinds(tagger, text) == want


@pytest.mark.parametrize("kind, text, want", [
    ("phone", "+44 1632 960094", True), ("phone", "89312498/1745174106973", False), ("id_number", "12345678z", True), ("id_number", "ab123456c", True), ("id_number", "98-7654321", True), ("id_number", "1234abcd5678", False), ("id_number", "12345", False),
    ("name", "Lola Trellis", True), ("name", "Trellis, L.", True), ("name", "LOLA TRELLIS", True), ("name", "Lola rejoined", False), ("name", "À MANHÃ", False), ("name", "Lola A Trellis", True), ("email", "a.b (at) c (dot) d", True), ("address", "Lane", False),
])
def test_checks(kind, text, want):
    assert P.passes(kind, text) is want


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    k = P.N_LABELS
    em, moves = rng.normal(size=(6, 4, k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32)
    sizes = np.array([1, 2, 3, 4, 4, 2])
    got = P._viterbi(em.copy(), moves, sizes)

    def allowed(a, b):
        return b == 0 or b % 2 or a in (b - 1, b)

    for r, n in enumerate(sizes):
        best = max((sum(em[r, i, t[i]] for i in range(n)) + sum(moves[t[i], t[i + 1]] for i in range(n - 1)), t) for t in itertools.product(range(k), repeat=int(n)) if (t[0] == 0 or t[0] % 2) and all(allowed(a, b) for a, b in zip(t, t[1:])))
        assert tuple(got[r, :n]) == best[1]


def test_gradient():
    rng = np.random.default_rng(1)
    k = P.N_LABELS
    em, moves = rng.normal(size=(2, 3, k)), rng.normal(size=(k, k))
    y, m = rng.integers(0, k, (2, 3)), np.array([[True, True, True], [True, True, False]])

    def likelihood(em, moves):
        total = 0.0
        for r in range(2):
            n = int(m[r].sum())
            score = lambda t: sum(em[r, i, t[i]] for i in range(n)) + sum(moves[t[i], t[i + 1]] for i in range(n - 1))  # noqa: B023, E731
            total += score(y[r]) - np.log(sum(np.exp(score(t)) for t in itertools.product(range(k), repeat=n)))
        return total

    g, gm = P._gradient(em, moves, y, m)
    for r, i, c in ((0, 0, 1), (0, 2, 3), (1, 1, 0)):
        e = em.copy()
        e[r, i, c] += 1e-5
        assert abs((likelihood(e, moves) - likelihood(em, moves)) / 1e-5 - g[r, i, c]) < 1e-3
    mv = moves.copy()
    mv[2, 3] += 1e-5
    assert abs((likelihood(em, mv) - likelihood(em, moves)) / 1e-5 - gm[2, 3]) < 1e-3


def test_tokens_cover_the_text():
    text = " a\\nb  c@d.e\n\n7"
    assert "".join(P.TOKEN.findall(text)) == text
    assert list(P.labels(["x", " y", " z"], [(2, 5, "name")])) == [0, 1 + 2 * P.KINDS.index("name"), 2 + 2 * P.KINDS.index("name")]


def test_pickled_tagger_decodes_alike(tagger):
    again = pickle.loads(pickle.dumps(tagger))
    lines = [t for t, _ in P.examples(GIVEN, FAMILY, draws=1, seed=9)]
    assert [s for s in again.find(lines)] == [s for s in tagger.find(lines)]


def test_operators(spark):
    rows = [(1, None), (2, ""), (3, "Consent form signed by Berae Dumoforth on 2024-01-02T03:04:05.678Z"), (3, "Consent form signed by Berae Dumoforth on 2024-01-02T03:04:05.678Z"), (4, "Delivered notice 814177402 to lola.hiweigo@mill-lane.invalid"), (5, "word " * 30_000), (None, "plain")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "key long, text string, kinds string")
    names = (GIVEN, FAMILY)
    assert sorted(map(tuple, P.kinds_found(df, "key", "text", names).collect())) == [(3, "name"), (3, "name"), (4, "email")]
    got = {r["key"]: r for r in P.redact(df, "key", "text", names).collect()}
    assert got[1]["redacted"] is None and got[2]["redacted"] == "" and got[3]["redacted"] == "Consent form signed by [NAME] on 2024-01-02T03:04:05.678Z" and got[4]["redacted"] == "Delivered notice 814177402 to [EMAIL]"
    assert got[5]["redacted"] == "word " * 30_000 and got[None]["redacted"] == "plain"
    assert P.redact(df.limit(0), "key", "text", names).count() == 0
    parts = spark.createDataFrame([("given", "Lola"), ("family", "Hiweigo"), ("given", None), ("given", ""), ("given", "Lola")], "part_kind string, part_value string")
    assert P.name_lists(parts) == (("Lola",), ("Hiweigo",))
