"""Personal information in free text: found by a linear-chain conditional random field, replaced by typed placeholders.

Tokens get features of their shape, ends and place among lists of names, and so do their neighbours. The weights come from a
small labelled table (`pii_examples`), by gradient steps on the exact likelihood (forward-backward). Decoding is Viterbi in
numpy, over many texts at a time. A found span must then pass a plain check of its kind (an e-mail address has a domain,
a phone number enough digits); the check can only refuse.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import pii_examples as X
from millrace.session import ship

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: O, then B and I of each kind.
N_LABELS = 1 + 2 * len(KINDS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
N_HASH = 1 << 15
#: Bound of the list of name parts, which every task holds.
MAX_PARTS = 200_000
#: Share of lines with other words around what is labelled.
LOOSE = 0.4
#: Lines drawn from each labelled row for training, and gradient steps.
DRAWS, STEPS = 30, 90

#: Groups of digits with a mark or a blank between them are one token, as are words; any other mark is its own.
_GROUPS = r"\+?\(?\d+(?:\)?[ .\-/(]\(?\d+)+"
TOKEN = re.compile(rf"\s*(?:\\[nrt]|{_GROUPS}(?![^\W_])|[^\W_]+|[^\w\s]|_)")
_SEPARATORS = re.compile(r"\D+")
_ALIKE = re.compile(r"0+|A+|a+")
_DIGITS = str.maketrans("123456789", "000000000")
_HEX = re.compile(r"(?=.*0)(?=.*[a-f])[0a-f]{4,}")
# Words that go with names, streets and papers.
TITLES = frozenset("herr frau mme mlle mr mrs ms miss dr prof m sr sra srta don doña señor señora signor signora pan pani sir lady".split())
STREETS = frozenset("street st lane avenue ave road rd calle rue ul al weg straße strasse gasse allee drive close square court place terrace boulevard via viale plaza avenida rua flat apt apartment unit way old upper lower du de".split())
ID_WORDS = frozenset("ssn social security passport reisepass ausweis personalausweis nr no dni nie nif personnummer national tax nino ni pesel cpf identity id steuer codice fiscale sécurité sociale инн паспорт licence driving".split())
PHONE_WORDS = frozenset("phone phones tel telephone telefon teléfono téléphone telefone call called calls caller ring rings rang dial dialled sms fax mobile cell handy numéro número numer rückruf llamar rufen телефон позвонить номер".split())
PERSON_WORDS = frozenset("name names named fullname customer client cliente kunde kundin klient клиент patient owner holder contact kontakt visitor applicant tenant beneficiary member signed signs dear letter note by für mit con z with from von de".split())
#: Ends of words that are streets by themselves.
STREET_ENDS = ("straße", "strasse", "weg", "gasse", "allee", "platz")


@lru_cache(maxsize=500_000)
def _hash(s: str) -> int:
    h = 2166136261
    for c in s.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) % N_HASH


N_FEATURES = 13


def features(raw: str, given: frozenset, family: frozenset) -> list[int]:
    """Hashed features of one token; `raw` has the white space before it."""
    w = raw.lstrip()
    space = "n" if "\n" in raw[: len(raw) - len(w)] else "s" if len(w) < len(raw) else "j"
    low = w.lower().translate(_DIGITS)
    if _HEX.fullmatch(low) and low != "0" * len(low):
        low = f"<hex{min(len(low), 9)}>"
    kind = "d" if w.isdigit() else "a" if w.isalpha() else "m" if w.isalnum() else "p"
    case = "U" if w.isupper() else "T" if w[:1].isupper() else "l" if w.islower() else "-"
    lead = w[0] if w[0].isdigit() and w[0] in "01" else ""
    long = min(len(w), 12)
    lists = ("g" if low in given else "") + ("f" if low in family else "") + ("t" if low in TITLES else "") + ("r" if low in STREETS or low.endswith(STREET_ENDS) else "") + ("i" if low in ID_WORDS else "") + ("p" if low in PHONE_WORDS else "") + ("n" if low in PERSON_WORDS else "")
    groups = _SEPARATORS.split(w.lstrip("+(")) if w[-1:].isdigit() and not w.isalnum() else []
    if groups:
        digits, plus, marks = sum(map(len, groups)), "+" if w[0] == "+" else "(" if w[0] == "(" else "", "".join(sorted(set(_SEPARATORS.findall(w.lstrip("+(")))))
        return [_hash(f) for f in (f"w={low}", f"g={plus}{marks}", f"gd={digits}{plus}", f"gn={len(groups)}", f"ge={len(groups[0])}.{len(groups[-1])}", f"gs={len(groups[0])}{lead}{marks}", f"gl={digits}.{len(groups)}.{marks}", f"gm={marks}{len(groups)}", f"sp={space}g", f"gp={space}{plus}{digits >= 7}", f"gt={digits >= 7}{len(groups) > 2}", f"gz={w.lstrip('+(')[:1]}{len(groups)}", "b")]
    form = _ALIKE.sub(lambda m: f"{m[0][0]}{len(m[0])}", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" for c in w)) if kind == "m" else ""
    alpha = kind == "a"
    return [
        _hash(f"w={low}"),
        _hash(f"k={kind}{case}"),
        _hash(f"kl={kind}{long}{lead}"),
        _hash(f"s4={low[-4:]}" if alpha and len(w) > 4 else f"k4={kind}{form}"),
        _hash(f"s3={low[-3:]}" if alpha and len(w) > 3 else f"k3={kind}"),
        _hash(f"p3={low[:3]}" if alpha and len(w) > 3 else f"q3={kind}"),
        _hash(f"l={lists}{case}"),
        _hash(f"l={lists}"),
        _hash(f"sp={space}{kind}"),
        _hash(f"ws={low}{space}" if kind == "p" else f"ks={kind}{case}{space}"),
        _hash(f"kc={kind}{case}{min(len(w), 5)}"),
        _hash(f"v={sum(c in 'aeiou' for c in low)}{min(len(w), 9)}" if alpha else "v"),
        _hash("b"),
    ]


class Tagger:
    """A linear-chain conditional random field over hashed features of a token and its neighbours."""

    def __init__(self, given: Sequence[str] = (), family: Sequence[str] = ()) -> None:
        self.given, self.family = frozenset(x.lower() for x in given), frozenset(x.lower() for x in family)
        self.weights = np.zeros((len(OFFSETS), N_HASH, N_LABELS), np.float32)
        self.moves = np.zeros((N_LABELS, N_LABELS), np.float32)
        self._clear()

    def _clear(self) -> None:
        self._ids: dict[str, int] = {}
        self._rows = np.zeros((1, len(OFFSETS), N_LABELS), np.float32)  # row 0: beyond the ends

    def __getstate__(self) -> dict:
        s = self.__dict__ | {"_ids": {}, "_rows": self._rows[:1]}
        used = np.flatnonzero(np.abs(self.weights).max(axis=(0, 2)) > 1e-4)
        return s | {"weights": (used, self.weights[:, used].astype(np.float16))}

    def __setstate__(self, s: dict) -> None:
        used, w = s["weights"]
        full = np.zeros((len(OFFSETS), N_HASH, N_LABELS), np.float32)
        full[:, used] = w
        self.__dict__ = s | {"weights": full}
        self._clear()

    # Training

    def fit(self, lines: list[tuple[str, list[tuple[int, int, str]]]], steps: int = STEPS, rate: float = 0.5, l2: float = 1e-5, hide: float = 0.3, seed: int = 7) -> None:
        rng = random.Random(seed)
        vocabulary: dict[tuple[str, bool], int] = {}
        table: list[list[int]] = [[0] * N_FEATURES]
        seqs, golds = [], []
        for text, spans in lines:
            toks = TOKEN.findall(text)
            blind = rng.random() < hide  # the lists of names are not complete, so part of the lines goes without them
            ids = []
            for raw in toks:
                k = (raw, blind)
                if k not in vocabulary:
                    vocabulary[k] = len(table)
                    table.append(features(raw, frozenset(), frozenset()) if blind else features(raw, self.given, self.family))
                ids.append(vocabulary[k])
            seqs.append(np.array(ids))
            golds.append(labels(toks, spans))
        feats = np.array(table)
        order = np.argsort([len(s) for s in seqs], kind="stable")
        chunks = [order[i : i + 256] for i in range(0, len(order), 256)]
        packed = []
        for c in chunks:
            t = max(len(seqs[i]) for i in c)
            x, y, m = np.zeros((len(c), t), int), np.zeros((len(c), t), int), np.zeros((len(c), t), bool)
            for r, i in enumerate(c):
                x[r, : len(seqs[i])], y[r, : len(seqs[i])], m[r, : len(seqs[i])] = seqs[i], golds[i], True
            packed.append((x, y, m))
        # Where the gradient of each token and offset, and of each feature, adds up: sorted once, summed by stretches.
        spots = []
        for off in OFFSETS:
            at = np.concatenate([_shift(x, off).ravel() for x, _, _ in packed])
            by = np.argsort(at, kind="stable")
            spots.append((by, *_stretches(at[by])))
        by_feature = np.argsort(feats.ravel(), kind="stable")
        owner, (starts, which) = by_feature // N_FEATURES, _stretches(feats.ravel()[by_feature])
        sq, sq_moves = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(steps):
            grad, grad_moves = np.zeros_like(self.weights), np.zeros_like(self.moves)
            rows = np.stack([w[feats].sum(1) for w in self.weights], 1)
            rows[0] = 0
            parts = []
            for x, y, m in packed:
                g, gm = _gradient(self._emit(rows, x), self.moves, y, m)
                grad_moves += gm
                parts.append(g.reshape(-1, N_LABELS))
            flat = np.concatenate(parts)
            for o, (by, first, token) in enumerate(spots):
                by_token = np.zeros((len(feats), N_LABELS), np.float32)
                by_token[token] = np.add.reduceat(flat[by], first)
                by_token[0] = 0
                grad[o, which] = np.add.reduceat(by_token[owner], starts)
            for p, d, s in ((self.weights, grad / len(seqs), sq), (self.moves, grad_moves / len(seqs), sq_moves)):
                d -= l2 * p
                s += d * d
                p += rate * d / np.sqrt(s)
        self._clear()

    # Decoding

    def _emit(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        em = rows[x, OFFSETS.index(0)]
        for o, off in enumerate(OFFSETS):
            if off:
                em = em + rows[_shift(x, off), o]
        return em

    def _lookup(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._ids) > 400_000:
            self._clear()
        ids, new, seqs = self._ids, [], []
        for t in texts:
            out = []
            for raw in TOKEN.findall(t):
                k = ids.get(raw)
                if k is None:
                    k = ids[raw] = len(ids) + 1
                    new.append(raw)
                out.append(k)
            seqs.append(np.array(out, np.int32))
        if new:
            known: dict[tuple, int] = {}
            f = [features(r, self.given, self.family) for r in new]
            unique = [known.setdefault(tuple(x), len(known)) for x in f]
            table = np.array(list(known), int).reshape(-1, N_FEATURES)
            rows = np.stack([w[table].sum(1) for w in self.weights], 1)
            self._rows = np.concatenate([self._rows, rows[unique]])
        return seqs

    def decode(self, texts: list[str]) -> list[np.ndarray]:
        """The best labels of the tokens of each text."""
        seqs = self._lookup(texts)
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(seqs)
        # Texts whose tokens have the same features get the same labels.
        same: dict[bytes, list[int]] = {}
        for i, s in enumerate(seqs):
            same.setdefault(s.tobytes(), []).append(i)
        first = [v[0] for v in same.values()]
        first.sort(key=lambda i: len(seqs[i]))
        a = 0
        while a < len(first):
            b = a + 1
            while b < len(first) and (b - a + 1) * len(seqs[first[b]]) <= 60_000:
                b += 1
            group = first[a:b]
            t = len(seqs[group[-1]])
            if t:
                x = np.zeros((len(group), t), np.int32)
                for r, i in enumerate(group):
                    x[r, : len(seqs[i])] = seqs[i]
                sizes = np.array([len(seqs[i]) for i in group])
                best = _viterbi(self._emit(self._rows, x), self.moves, sizes)
                for r, i in enumerate(group):
                    out[i] = best[r, : sizes[r]]
            a = b
        for v in same.values():
            for i in v[1:]:
                out[i] = out[v[0]]
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (from, to, kind) of each text that pass the check of their kind."""
        result = []
        for text, tags in zip(texts, self.decode(texts)):
            spans: list[tuple[int, int, str]] = []
            if tags.any():
                at, k = 0, 0
                toks = TOKEN.findall(text)
                starts, stops = [], []
                for raw in toks:
                    stops.append(at := at + len(raw))
                    starts.append(at - len(raw.lstrip()))
                while k < len(tags):
                    if tags[k] and tags[k] % 2:
                        j = k + 1
                        while j < len(tags) and tags[j] == tags[k] + 1:
                            j += 1
                        kind = KINDS[(tags[k] - 1) // 2]
                        a, b = starts[k], stops[j - 1]
                        if passes(kind, text[a:b]) and (kind not in ("phone", "id_number") or _stands_alone(text, a, b)):
                            spans.append((a, b, kind))
                        k = j
                    else:
                        k += 1
            result.append(spans)
        return result


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the stretches of equal values in a sorted array."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, values[starts]


def _shift(x: np.ndarray, off: int) -> np.ndarray:
    out = np.zeros_like(x)
    if off == 0:
        return x
    if off > 0:
        out[:, :-off] = x[:, off:]
    else:
        out[:, -off:] = x[:, :off]
    return out


def _gradient(em: np.ndarray, moves: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood by emissions and by moves: observed less expected counts, with scaled forward and backward passes."""
    n, t, k = em.shape
    e = np.exp(em - em.max(2, keepdims=True))
    mv = np.exp(moves)
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = alpha[:, i - 1] @ mv * e[:, i]
        alpha[:, i] = np.where(m[:, i, None], a / a.sum(1, keepdims=True), alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        b = (beta[:, i + 1] * e[:, i + 1]) @ mv.T
        beta[:, i] = np.where(m[:, i + 1, None], b / b.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    g = np.where(m[..., None], np.eye(k, dtype=np.float32)[y] - p, 0)
    gm = np.zeros_like(moves)
    for i in range(1, t):
        live = m[:, i]
        pair = alpha[live, i - 1][:, :, None] * mv * (beta[live, i] * e[live, i])[:, None, :]
        gm -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        np.add.at(gm, (y[live, i - 1], y[live, i]), 1)
    return g.astype(np.float32), gm


def _viterbi(em: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, t, k = em.shape
    back = np.zeros((t, n, k), np.int8)
    score = em[:, 0].copy()
    last = np.where((sizes == 1)[:, None], score, 0)
    # I of a kind follows B or I of it only.
    lock = moves.copy()
    for kind in range(len(KINDS)):
        for frm in range(k):
            if frm not in (1 + 2 * kind, 2 + 2 * kind):
                lock[frm, 2 + 2 * kind] = -1e4
    score[:, 2::2] -= 1e4
    last = np.where((sizes == 1)[:, None], score, last)
    by_to = np.ascontiguousarray(lock.T)
    for i in range(1, t):
        both = score[:, None, :] + by_to
        arg = both.argmax(2)
        back[i] = arg
        score = np.take_along_axis(both, arg[:, :, None], 2)[:, :, 0] + em[:, i]
        ends = sizes == i + 1
        if ends.any():
            last[ends] = score[ends]
    out = np.zeros((n, t), np.int8)
    rows = np.arange(n)
    tag = last.argmax(1)
    for i in range(t - 1, -1, -1):
        live = i < sizes
        out[live, i] = tag[live]
        move = live & (i > 0)
        tag = np.where(move, back[i, rows, tag], tag)
    return out


_CHECKS = {
    "email": re.compile(r"(?s).*[\w.+-]+\s*(?:@|\(at\)|\[at\])\s*[\w-]+\s*(?:\.|\(dot\)|\[dot\])\s*[\w-]+.*", re.I),
    # The longest numbers have 15 digits; an extension may follow.
    "phone": re.compile(r"(?si)(?:[^\dx]*\d){7,15}\D*(?:(?:x|ext)\W*\d{1,6})?\W*"),
    # Small letters stand at one end at most, and a code in hexadecimal digits is no number that authorities give.
    "id_number": re.compile(r"(?s)(?!.*(?<!\w)(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{8,}(?!\w)(?<![0-9][a-f]))(?=(?:.*\d){6})[a-z]{0,3}[^a-z]*[a-z]{0,3}"),
    "address": re.compile(r"(?s)(?=.*\d)(?=.*[^\W\d_]{2}).*"),
    "name": re.compile(r"(?s)(?=.*[^\W\d_]{2})[^\d@]*[^\W\d_]+[^\w]+[^\W\d_]+[^\d@]*"),
}


def _stands_alone(text: str, a: int, b: int) -> bool:
    """Whether a number is not a piece of a longer code, such as an identifier in groups of hexadecimal digits."""
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    joined = before[-1:].isalnum() or after[:1].isalnum() or (before[-1:] in ("-", ".") and before[:-1].isalnum()) or (after[:1] == "-" and after[1:].isalnum())
    return not joined and text[b - 1].isalnum()


#: Small words inside names.
_PARTICLES = frozenset("de da di del der den von van zu la le y e du dos das al bin".split())


def passes(kind: str, found: str) -> bool:
    if _CHECKS[kind].fullmatch(found) is None:
        return False
    if kind != "name":
        return True
    # A letter alone is an initial with a full stop, or stands between other parts.
    if re.match(r"\W*[^\W\d_](?![\w.])", found) or re.search(r"(?<!\w)[^\W\d_]\W*\Z", found) and not found.endswith("."):
        return False
    # The parts of a name are written alike: all with a capital, or none.
    parts = [w for w in re.findall(r"[^\W\d_]{2,}", found) if w.lower() not in TITLES and w.lower() not in _PARTICLES]
    return len({w[0].isupper() for w in parts if w.lower() != w.upper()}) < 2


def labels(tokens: list[str], spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Labels of tokens from spans of characters."""
    out = np.zeros(len(tokens), int)
    at = 0
    for i, raw in enumerate(tokens):
        at += len(raw)
        start = at - len(raw.lstrip())
        for a, b, kind in spans:
            if start >= a and at <= b:
                k = 1 + 2 * KINDS.index(kind)
                begins = i == 0 or out[i - 1] not in (k, k + 1) or start == a
                out[i] = k if begins else k + 1
    return out


# The labelled table filled in


Forms = dict[str, list[str]]


def examples(given: Sequence[str], family: Sequence[str], draws: int = DRAWS, seed: int = 5, rows: Sequence[str] | None = None, forms: Forms | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines with their spans: every labelled row `draws` times with other fillings, part of them in capitals, with wide spaces or cut short."""
    rng = random.Random(seed)
    out = []
    for row in X.LINES.split("\n") if rows is None else rows:
        if row:
            row = row.replace("\\\\n", "\0").replace("\\n", "\n").replace("\0", "\\n")
            slots = re.findall(r"\{(\w+)\}", row)
            # Papers are written in more ways than anything else.
            for _ in range(draws * (1 + ("id" in slots)) if slots else max(1, draws // 4)):
                loose = rng.random() < LOOSE  # what stands around says little there, so the shape of a value has to
                out.append(_fill(_swapped(row, rng) if loose else row, rng, given, family, forms or X.FORMS))
    return out


def _swapped(row: str, rng: random.Random) -> str:
    """A row with half of its plain words put in place of others."""

    def other(m: re.Match) -> str:
        if rng.random() < 0.5:
            return m[0]
        w = rng.choice(_PLAIN) if rng.random() < 0.7 else _word(rng)
        return w.upper() if m[0].isupper() else w.title() if m[0][0].isupper() else w

    return "".join(x if i % 2 else re.sub(r"(?<![\\\w])[^\W\d_]{3,}(?!\w)", other, x) for i, x in enumerate(re.split(r"(\{\w+\})", row)))


_PLAIN = "north south harbour cliff valley ridge moor delta west east lantern trellis pulley bobbin anvil silo crate kiln ferry spool dusty keen copper amber steep quiet narrow warm pale idle early rapid velvet barrel ledger harness paddock roster sluice tally".split()
_KIND = {"id": "id_number", "addr": "address"}


def _word(rng: random.Random, low: int = 2, high: int = 3) -> str:
    return "".join(rng.choice("bdfghklmnprstvw") + rng.choice(["a", "e", "i", "o", "u", "ai", "ei", "ie"]) + rng.choice(["", "", "n", "r", "l", "s"]) for _ in range(rng.randint(low, high)))


def _fill(row: str, rng: random.Random, given: Sequence[str], family: Sequence[str], forms: Forms) -> tuple[str, list[tuple[int, int, str]]]:
    ends = [x.lower()[-5:] for x in family] or ["son"]

    def first() -> str:
        return rng.choice(given) if given and rng.random() < 0.6 else _word(rng).title()

    def last() -> str:
        if family and rng.random() < 0.5:
            return rng.choice(family)
        return (_word(rng, 1, 2) + (rng.choice(ends) if rng.random() < 0.7 else _word(rng, 1, 1))).title()

    def digits(form: str) -> str:
        return re.sub("A", lambda _: rng.choice("ABCDEFGHKLMNPRSTUVWXYZ"), re.sub("9", lambda _: rng.choice("0123456789"), form))

    def form(kind: str) -> tuple[str, int, int]:
        f = rng.choice(forms[kind])
        if kind in ("phone", "id"):
            if "[" in f:
                a, b = f.index("["), f.index("]")
                return f[:a] + digits(f[a + 1 : b]) + f[b + 1 :], a, b - 1
            return digits(f), 0, len(f)
        if kind == "addr":
            place = rng.choice(_PLAIN) if rng.random() < 0.7 else _word(rng)
            town = (_word(rng, 1, 1) + rng.choice(X.TOWN_ENDS)).title()
            f = re.sub(r"\bW(?=\b|weg|straße|gasse)", place.title(), f)
            f = re.sub(r"\bF(?=\b|straße)", last(), f)
            f = re.sub(r"\bT$", town, f)
            f = re.sub("9A", lambda _: "9" + rng.choice("ABCD"), f)
            return re.sub("9", lambda _: rng.choice("0123456789"), f), 0, len(re.sub("9", "0", f))
        g, l = first(), last()
        if kind == "name":
            if f == "g f":
                v = f"{g} {l}".lower()
            elif f == "G-U F-U":
                v = f"{g} {l}".upper()
            else:
                v = re.sub(r"\b[GFA]\b", lambda m: {"G": g, "F": l, "A": rng.choice("ABCDEFGHIJKLMNOPRSTUVWZ")}[m[0]], f)
            return v, 0, len(v)
        host = rng.choice(X.HOSTS) if rng.random() < 0.7 else f"{_word(rng)}.{rng.choice(['com', 'org', 'net', 'test', 'example', 'de', 'invalid'])}"
        upper = f.endswith("-U")
        f = f.removesuffix("-U")
        f = re.sub("9", lambda _: rng.choice("0123456789"), f)
        v = ""
        for c in f if not f.startswith("mailto:") else f[7:]:
            v += {"g": g.lower(), "f": l.lower(), "G": g.lower(), "F": l.lower(), "D": host, "O": host.replace(".", " (dot) "), "x": g[0].lower(), "w": rng.choice(_PLAIN)}.get(c, c)
        v = v.replace(f"+{l.lower()[:0]}", "+")
        if "+" in f:
            v = f"{l.lower()}+list" + v[v.index("@") if "@" in v else v.index(" (") :] + (">" if f.startswith("<") and not v.endswith(">") else "")
            v = ("<" if f.startswith("<") else "") + v
        elif "(at)" in f:
            local = f[: f.index(" (at)")]
            v = "".join({"g": g.lower(), "f": l.lower()}.get(c, c) for c in local) + " (at) " + host.replace(".", " (dot) ")
        if f.startswith("mailto:"):
            v = "mailto:" + v
        v = v.upper() if upper else v
        a = 7 if v.lower().startswith("mailto:") else 1 if v.startswith("<") else 0
        return v, a, len(v) - v.endswith(">")

    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    plain = {
        "num": lambda: str(rng.randint(10**7, 10**10)), "n": lambda: str(rng.randint(0, 999)), "hex": lambda: hexes(8), "uuid": lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), "w": lambda: rng.choice(_PLAIN), "W": lambda: rng.choice(_PLAIN).title(),
        "why": lambda: rng.choice(X.WHY), "acc": lambda: f"acc{rng.randint(1, 999)}", "ip": lambda: f"192.0.2.{rng.randint(1, 254)}", "dec": lambda: f"{rng.random() * 9:.3f}", "hms": lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
        "ts": lambda: f"2024-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}.{rng.randint(0, 999):03}{rng.choice(['Z', '+02:00', '-03:00'])}",
        "Cls": lambda: rng.choice(_PLAIN).title() + rng.choice(["Keeper", "Broker", "Loader", "Watcher", "Sweeper"]), "given": first,
    }
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(\w+)\}", row):
        text += row[at : m.start()]
        at = m.end()
        if m[1] in plain:
            text += re.sub("9", lambda _: rng.choice("0123456789"), plain[m[1]]())
            continue
        v, a, b = form(m[1])
        spans.append((len(text) + a, len(text) + b, _KIND.get(m[1], m[1])))
        text += v
    text += row[at:]
    text = re.sub("1799999999999", lambda _: f"17{rng.randint(10**10, 10**11 - 1)}", text)
    how = rng.random()
    if how < 0.15:
        up = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
        text = up
    elif how < 0.22:
        out, shift, marks = "", [], 0
        for c in text:
            shift.append(len(out))
            out += c * 2 if c == " " else c
        shift.append(len(out))
        spans = [(shift[a], shift[b - 1] + 1, k) for a, b, k in spans]
        text = out
    elif how < 0.30:  # cut short, after the last span
        least = spans[-1][1] + 1 if spans else len(text) // 4
        if len(text) - least > 3:
            text = text[: rng.randint(least, len(text))]
    return text, spans


@lru_cache(maxsize=4)
def trained(given: tuple[str, ...], family: tuple[str, ...]) -> Tagger:
    """The tagger for these lists of names, trained once per process."""
    t = Tagger(given, family)
    t.fit(examples(given, family))
    return t


# Operators


def name_lists(parts: DataFrame, kind: str = "part_kind", value: str = "part_value") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(given, family) names from a table, of `MAX_PARTS` rows at most; nulls and empty values are left out."""
    rows = parts.select(kind, value).limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} name parts")
    pick = lambda k: tuple(sorted({r[1] for r in rows if r[0] == k and r[1]}))
    return pick("given"), pick("family")


def _run(tagger: Tagger, replace: bool):
    shared: list[Tagger] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared:
            shared.append(tagger.value if hasattr(tagger, "value") else tagger)
        tag = shared[0]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = tag.find(texts)
            kinds = [sorted({k for *_, k in s}) for s in found]
            cols = [batch.column(0), pa.array(kinds, pa.list_(pa.string()))]
            if replace:
                new = []
                for t, s, null in zip(texts, found, batch.column(1).is_null().to_pylist()):
                    out, at = "", 0
                    for a, b, k in s:
                        out += t[at:a] + PLACEHOLDERS[k]
                        at = b
                    new.append(None if null else out + t[at:] if s else t)
                cols.append(pa.array(new, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "kinds", "redacted"][: len(cols)])

    return run


def _tag(df: DataFrame, key: str, text: str | Column, names: tuple[Sequence[str], Sequence[str]], replace: bool) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    tagger = spark.sparkContext.broadcast(trained(tuple(names[0]), tuple(names[1])))
    source = df.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, kinds array<string>" + (", redacted string" if replace else "")
    return source.mapInArrow(_run(tagger, replace), schema)


def kinds_found(df: DataFrame, key: str, text: str | Column, names: tuple[Sequence[str], Sequence[str]] = ((), ())) -> DataFrame:
    """One row per row of ``df`` and kind of personal information in its text: `key`, kind. Null and empty texts give none."""
    return _tag(df, key, text, names, False).select(F.col("key").alias(key), F.explode("kinds").alias("kind"))


def redact(df: DataFrame, key: str, text: str | Column, names: tuple[Sequence[str], Sequence[str]] = ((), ()), redacted: str = "redacted", kinds: str = "kinds") -> DataFrame:
    """One row per row of ``df``: `key`, the kinds found, and the text with each replaced by a placeholder. Null stays null."""
    return _tag(df, key, text, names, True).select(F.col("key").alias(key), F.col("kinds").alias(kinds), F.col("redacted").alias(redacted))
