"""Text decoded with the wrong character encoding: found with one automaton of garbled sequences, restored in place.

Every pair (encoding the text had, encoding it was read with) gives the sequences its characters turn into. All of them
go into one Aho-Corasick automaton; only the matched spans of a text change, whatever is right around them stays. Of UTF-8
the automaton holds the first two bytes of every sequence, and a match counts where the bytes from there on are valid.

Null gives (false, null), an empty text (false, ''). A text can be garbled more than once; restoring repeats until nothing matches.
U+FFFD marks a place whose bytes are lost: it is found, and left as it is.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

# Encodings that UTF-8 bytes are often read as.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "koi8-r", "cp866")
# Fixed values: (had, read as) of one-byte encodings whose alphabet lies wholly above ASCII, with the language's alphabet.
ALPHABETS = (
    ("cp1251", "cp1252", "ru"), ("cp1251", "koi8-r", "ru"), ("cp1251", "mac_roman", "ru"), ("cp1251", "cp866", "ru"), ("koi8-r", "cp1251", "ru"), ("koi8-r", "cp1252", "ru"),
    ("cp866", "cp1251", "ru"), ("cp866", "cp1252", "ru"), ("iso8859-5", "cp1252", "ru"), ("iso8859-5", "cp1251", "ru"), ("cp1253", "cp1252", "el"), ("cp1253", "mac_roman", "el"), ("cp1253", "cp1251", "el"),
)
# Fixed values: (had, read as) of one-byte encodings of Latin alphabets, whose few letters above ASCII sit between plain ones.
LATIN = (
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "cp1251"),
)
# Fixed values: (had, read as) of two-byte encodings.
DOUBLE_BYTE = (("cp932", "cp1252"), ("euc_jp", "cp1252"), ("cp932", "mac_roman"), ("cp932", "latin-1"))
# Fixed values: (had, read as) of two-byte encodings without kana, in the order they are preferred in.
HAN_HANGUL = (("gbk", "cp1252"), ("gbk", "latin-1"), ("big5", "cp1252"), ("big5", "latin-1"), ("euc_kr", "cp1252"), ("euc_kr", "latin-1"))
# Two-byte encodings UTF-8 is read as.
WIDE_READ_AS = ("cp932", "gbk")
# First bytes of the commoner characters of an encoding, punctuation included.
COMMON_ROWS = {"gbk": ((0xA1, 0xA4), (0xB0, 0xD8)), "big5": ((0xA1, 0xA4), (0xA4, 0xC7)), "euc_kr": ((0xB0, 0xC9),)}
# Characters so common that a few words hold some.
FREQUENT = frozenset("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处队南给色光门即保治北造百规热领七海口东导器压志世金增争济阶油思术极交受联认六共权收证改清己美再采转更单风切打白教速花带安场身车例真务具万每目至达走积示议声报斗完类八离华名确才科张信马节话米整空元况今集温传土许步群广石记需段研界拉林律叫且究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严错误失败请求服务网络用户登录超启停")
# Letters that words of one language combine. A sequence made of one language's letters may be right text.
LANGUAGES = (
    "àâæçéèêëîïôœùûüÿ", "äöüß", "áéíñóúü", "ãáâàçéêíóôõúü", "ąćęłńóśźż", "áčďéěíňóřšťúůýžľĺŕôä", "åäöéæø", "çğıöşü", "ăâîșțşţ", "áéíóöőúüű",
    "ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ", "àèéìòù", "čđšžć", "āčēģīķļņšūž", "ąčęėįšųūž", "áðéíóúýþæö",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "ёабвгдежзийклмнопрстуфхцчшщъыьэюя", "ґєіїабвгдежзийклмнопрстуфхцчшщьюя", "ђјљњћџабвгдежзиклмнопрстуфхцчш", "ўіабвгдежзйклмнопрстуфхцчшыьэюяё", "ѓѕјљњќџабвгдежзиклмнопрстуфхцчш",
    "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ",
)
# Marks that may follow or precede a letter in right text.
PLAIN_MARKS = frozenset("‘’“”„‚«»‹›–—…\xa0 ·°ºª•†‡")
# General text of a language, whose pairs of letters count as common: the Universal Declaration of Human Rights, preamble and first articles.
GENERAL = {
    "ru": """Принимая во внимание, что признание достоинства, присущего всем членам человеческой семьи, и равных и неотъемлемых прав их является основой свободы, справедливости и всеобщего мира;
        и принимая во внимание, что пренебрежение и презрение к правам человека привели к варварским актам, которые возмущают совесть человечества, и что создание такого мира, в котором люди будут иметь свободу слова
        и убеждений и будут свободны от страха и нужды, провозглашено как высокое стремление людей. Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении
        друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, пола, языка, религии,
        политических или иных убеждений, национального или социального происхождения, имущественного, сословного или иного положения. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.
        Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах. Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его достоинство
        обращению и наказанию. Каждый человек, где бы он ни находился, имеет право на признание его правосубъектности.""",
    "el": """Επειδή η αναγνώριση της αξιοπρέπειας, που είναι σύμφυτη σε όλα τα μέλη της ανθρώπινης οικογένειας, καθώς και των ίσων και αναπαλλοτρίωτων δικαιωμάτων τους αποτελεί το θεμέλιο της ελευθερίας, της δικαιοσύνης
        και της ειρήνης στον κόσμο. Επειδή η παραγνώριση και η περιφρόνηση των δικαιωμάτων του ανθρώπου οδήγησαν σε πράξεις βαρβαρότητας, που εξεγείρουν την ανθρώπινη συνείδηση. Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην
        αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες που
        προκηρύσσει η παρούσα Διακήρυξη, χωρίς καμία απολύτως διάκριση, ειδικότερα ως προς τη φυλή, το χρώμα, το φύλο, τη γλώσσα, τις θρησκείες, τις πολιτικές ή οποιεσδήποτε άλλες πεποιθήσεις, την εθνική ή κοινωνική καταγωγή,
        την περιουσία, τη γέννηση ή οποιαδήποτε άλλη κατάσταση. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια. Κανείς δεν επιτρέπεται να ζει υπό καθεστώς δουλείας, ολικής ή μερικής.
        Κανείς δεν επιτρέπεται να υποβάλλεται σε βασανιστήρια ούτε σε ποινή ή μεταχείριση σκληρή, απάνθρωπη ή ταπεινωτική. Καθένας, όπου και αν βρίσκεται, έχει δικαίωμα στην αναγνώριση της νομικής του προσωπικότητας.""",
}
# Letters words of these languages, and of others of the alphabet, are made of.
WORD_LETTERS = {"ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґўђѓѕјљњћќџ", "el": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ"}
VOWELS = {"ru": frozenset("аеёиоуыэюяіїєј"), "el": frozenset("αεηιουωάέήίόύώϊϋΐΰ")}


class Pair(NamedTuple):
    had: str
    read_as: str
    kind: str  # utf8, wide, alphabet, latin, double, han, lost


@lru_cache(maxsize=None)
def _byte_table(read_as: str) -> tuple[str, ...]:
    """The character of each byte; bytes the encoding leaves open stay the control characters of their value, as most decoders do."""
    return tuple(bytes([b]).decode(read_as, "ignore") or chr(b) for b in range(256))


def garble(text: str, had: str, read_as: str) -> str:
    """``text`` as it looks when its bytes in ``had`` are read as ``read_as``."""
    table = _byte_table(read_as)
    return "".join(table[b] for b in text.encode(had))


def _repertoire() -> list[str]:
    """Characters whose UTF-8 bytes are taken for garbled text wherever right text could not hold them."""
    spans = [(0xA0, 0x250), (0x370, 0x400), (0x400, 0x530), (0x5D0, 0x5EB), (0x621, 0x64B), (0x1E00, 0x2000), (0x2010, 0x2045), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2190, 0x2200), (0x2500, 0x2580), (0x25A0, 0x2600), (0x2713, 0x2719), (0x3000, 0x3100), (0xFF01, 0xFFEF)]
    return [chr(c) for a, b in spans for c in range(a, b) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]


def _ideographs() -> list[str]:
    """The Chinese characters of the first level of the Japanese and of the simplified Chinese character sets."""
    out = set()
    for enc, rows in (("euc_jp", range(0xB0, 0xD0)), ("gb2312", range(0xB0, 0xD8))):
        for a, b in itertools.product(rows, range(0xA1, 0xFF)):
            out.update(bytes([a, b]).decode(enc, "ignore"))
    return sorted(out)


@lru_cache(maxsize=None)
def _ordinary(seq: str) -> bool:
    """Whether right text could hold ``seq``: letters of one language, with common marks."""
    letters = {c.lower() for c in seq if c.isalpha() and c not in "ºª"}
    return all(c in PLAIN_MARKS or c.isalpha() for c in seq) and any(letters <= set(x) for x in _language_sets())


@lru_cache(maxsize=1)
def _language_sets() -> tuple[frozenset, ...]:
    plain = frozenset("abcdefghijklmnopqrstuvwxyz")
    return tuple(frozenset(x) | (plain if not "а" <= x[-1] <= "я" and x[0] != "α" else frozenset()) for x in LANGUAGES)


class Entry(NamedTuple):
    pair: int
    original: str
    strong: bool


@lru_cache(maxsize=1)
def automaton():
    """(automaton, pairs): each sequence with its entries, one for each pair that yields it."""
    import ahocorasick

    pairs: list[Pair] = []
    found: dict[str, list[Entry]] = {}

    def add(seq: str, pair: int, original: str, strong: bool) -> None:
        at = found.setdefault(seq, [])
        if all(e.pair != pair for e in at):
            at.append(Entry(pair, original, strong))

    ideographs = _ideographs()
    for enc in READ_AS:
        pairs.append(Pair("utf-8", enc, "utf8"))
        k, table = len(pairs) - 1, _byte_table(enc)
        for a, b in itertools.product(range(0xC2, 0xF5), range(0x80, 0xC0)):
            add(table[a] + table[b], k, "", False)
            if b == 0xA0 and a >= 0xE0 and enc in SPACED:  # a no-break space may have become a space since
                add(table[a] + " ", k, "", False)
    for had, enc, lang in ALPHABETS:
        pairs.append(Pair(had, enc, "alphabet"))
        k = len(pairs) - 1
        for x, y in itertools.product(WORD_LETTERS[lang], repeat=2):
            for form in (x + y, x.upper() + y, x.upper() + y.upper()):
                try:
                    seq = garble(form, had, enc)
                except UnicodeEncodeError:
                    continue
                if seq != form and len(seq) == len(form):
                    add(seq, k, form, False)
    letters = "äöüßÄÖÜáéíóúñçàèêëîïôûùâãõąćęłńóśźżřšžčěåæø"
    for had, enc in LATIN:
        pairs.append(Pair(had, enc, "latin"))
        k = len(pairs) - 1
        for ch in letters:
            try:
                seq = garble(ch, had, enc)
            except UnicodeEncodeError:
                continue
            latin = seq.isalpha() and unicodedata.name(seq, "").startswith("LATIN") or seq in "ºª"
            if seq != ch and not latin and seq not in PLAIN_MARKS and not seq.isspace() and unicodedata.category(seq) not in ("Cc", "Pd", "Po", "Sk"):
                add(seq, k, ch, False)
    for had, enc in DOUBLE_BYTE:
        pairs.append(Pair(had, enc, "double"))
        k = len(pairs) - 1
        for ch in [chr(c) for c in range(0x3041, 0x30FB)] + ["。", "、"] + ideographs:
            try:
                add(garble(ch, had, enc), k, ch, "ぁ" <= ch <= "ー")
            except UnicodeEncodeError:
                continue
    for had, enc in HAN_HANGUL:
        pairs.append(Pair(had, enc, "han"))
        k, table = len(pairs) - 1, _byte_table(enc)
        for first, last in COMMON_ROWS[had]:
            for a, b in itertools.product(range(first, last), range(0x40, 0xFF)):
                if ch := bytes([a, b]).decode(had, "ignore"):
                    if len(ch) == 1:
                        add(table[a] + table[b], k, ch, False)
    pairs += [Pair("utf-8", enc, "wide") for enc in WIDE_READ_AS]
    pairs.append(Pair("", "", "lost"))
    add("�", len(pairs) - 1, "�", True)
    auto = ahocorasick.Automaton()
    for seq, entries in found.items():
        auto.add_word(seq, (len(seq), entries))
    auto.make_automaton()
    return auto, pairs


# Encodings whose no-break space a later step may have made a space.
SPACED = ("cp1252", "latin-1")
# Signs that right text sets behind a letter.
SIGNS = re.compile("[¹²³®™©±¼½¾]")


@lru_cache(maxsize=1)
def _known_characters() -> tuple[frozenset, frozenset]:
    return frozenset(_repertoire()), frozenset(_ideographs())


@lru_cache(maxsize=None)
def _back_utf8(read_as: str) -> dict[str, int]:
    table = _byte_table(read_as)
    return {table[b]: b for b in range(255, 127, -1)}


@lru_cache(maxsize=None)
def _lengths(read_as: str) -> dict[str, int]:
    """The length of the UTF-8 sequence each character starts."""
    table = _byte_table(read_as)
    return {table[b]: 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(0xC2, 0xF5)}


@lru_cache(maxsize=200_000)
def _utf8_sequence(seq: str, read_as: str) -> tuple[str, bool | None] | None:
    """The character whose UTF-8 bytes look like ``seq``, and whether right text could not hold it; None where they are not valid.

    Of letters of one language that spell a rarer character ('шиб' in cp866) it is None instead: words are full of them, so
    even two in a row say nothing, and they are only restored beside surer ones. Such letters in odd case ('шЩи') count
    where nothing but sequences is around them.
    """
    back, spaces = _back_utf8(read_as), 0
    data = bytearray()
    for c in seq:
        if c == " " and read_as in SPACED:
            spaces += 1
            data.append(0xA0)
        elif c in back:
            data.append(back[c])
        else:
            return None
    try:
        ch = data.decode()
    except UnicodeDecodeError:
        return None
    usual, ideographs = _known_characters()
    known = ch in usual or ch in ideographs and read_as not in ("cp1254", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1253")
    if spaces:
        return (ch, False) if known or spaces == 1 and not all(c in PLAIN_MARKS or c == " " for c in seq[1:]) else None
    if known:
        return ch, not _ordinary(seq)
    if unicodedata.category(ch) in ("Cn", "Co") or all("─" <= c <= "▟" for c in seq):
        return ch, None
    if "\U0001d000" <= ch <= "\U0001ffff":  # their first two bytes ('рџ', 'ЁЯ') start no word
        return ch, True
    return ch, not _ordinary(SIGNS.sub("", seq)) or (False if len(seq) == 2 else None)


@lru_cache(maxsize=None)
def _to_bytes(read_as: str) -> dict[str, int]:
    back = {c: b for b, c in reversed(list(enumerate(_byte_table(read_as))))}
    for b in range(0x80, 0xA0):
        back.setdefault(chr(b), b)
    return back


def _reread(run: str, pair: Pair) -> str | None:
    """``run`` with its bytes read as what they were, or None where they can't be that."""
    back = _to_bytes(pair.read_as)
    try:
        return bytes([back[c] for c in run]).decode(pair.had)
    except (KeyError, UnicodeDecodeError):
        return None


CJK = re.compile(r"[぀-ヿ一-鿿]")
LETTERS = re.compile(r"[^\W\d_]+")


def _hits(text: str, lang: str) -> tuple[int, int]:
    """Common pairs of letters in the words of ``text``, and all pairs."""
    common, n, all_ = _common(lang), 0, 0
    for w in LETTERS.findall(text.lower()):
        all_ += len(w) - 1
        n += sum(w[i : i + 2] in common for i in range(len(w) - 1))
    return n, all_


@lru_cache(maxsize=None)
def _common(lang: str) -> frozenset:
    """Pairs of letters that occur more than once in general text."""
    n = Counter(w[i : i + 2] for w in LETTERS.findall(GENERAL[lang].lower()) for i in range(len(w) - 1))
    return frozenset(x for x, k in n.items() if k > 1)


def _odd_case(words: list[str]) -> bool:
    """Words such as 'ъБЗТХЪ': small first, then capitals, which right text hardly has."""
    return any(len(w) > 4 and w[0].islower() and w[1:].isupper() for w in words)


def _alphabet_spans(text: str, pair: Pair, lang: str) -> list[tuple[int, int, str]]:
    """Spans of words that make sense only when read with the pair's first encoding."""
    back = _to_bytes(pair.read_as)
    out: list[tuple[int, int, str]] = []
    for m in (WORDS_OF_CP866 if pair.had == "cp866" else WORDS).finditer(text):
        w = m[0]
        if w.isascii():
            continue
        i, j = 0, len(w)
        while i < j and w[i].isascii():
            i += 1
        while j > i and w[j - 1].isascii():
            j -= 1
        run = w[i:j]
        if any(c not in back for c in run):
            continue
        new = _reread(run, pair)
        if new is None or any(ord(c) > 127 and not c.isalpha() for c in new):
            continue
        out.append((m.start() + i, m.start() + j, new))
    return out


@lru_cache(maxsize=200_000)
def _alphabet_word(old: str, new: str, lang: str) -> tuple[bool, bool]:
    """Whether a word makes sense only as ``new``, and whether it may."""
    words = LETTERS.findall(old)
    letters = "".join(sorted(set("".join(words))))
    gain = _hits(new, lang)[0] - max(_hits(old, x)[0] for x in GENERAL)
    usual = _ordinary("".join(sorted(set(old)))) and (old.islower() or old.istitle() or old.isupper() and new.isupper() or len(old) <= 4 and old[0].islower() and old[1:].isupper())  # 'мРНК'
    cased = new.islower() or new.istitle() or new.isupper()
    n = len(new)
    odd = len(words) != 1 or len(words[0]) != len(old) or not _ordinary("".join(sorted(set(old)))) or _odd_case(words)
    # Latin letters that no language combines, and that spell a word throughout, need no common pair.
    spelt = set(new.lower())
    sure = n >= 4 and not GREEK_CYRILLIC.search(old) and 2 * sum(map(len, words)) >= n and not _ordinary(letters) and spelt <= set(WORD_LETTERS[lang]) and _ordinary("".join(sorted(spelt))) and bool(spelt & VOWELS[lang]) and bool(spelt - VOWELS[lang])
    return cased and not usual and n >= 3 and (sure or gain >= (1 if odd and words else max(2, n // 2))), cased and not usual


GREEK_CYRILLIC = re.compile("[Ͱ-ӿ]")
WORDS = re.compile(r"\S+")
WORDS_OF_CP866 = re.compile(r"[^ \t\n\r\f\v]+")  # its letters look like a no-break space and a line end, too


def _alphabet(text: str, pair: Pair, lang: str) -> list[tuple[int, int, str]]:
    """Word spans to restore. A word counts by the common letter pairs it gains; once one does, what looks alike goes with it."""
    spans = _alphabet_spans(text, pair, lang)
    good, maybe = [], []
    for a, b, new in spans:
        sense, may = _alphabet_word(text[a:b], new, lang)
        good.append(sense)
        maybe.append(may)
    if not any(good):
        return []
    latin = [not re.search("[Ͱ-ӿ]", text[a:b]) for a, b, _ in spans]
    keep = list(good)
    for order in (range(len(spans)), range(len(spans) - 1, -1, -1)):
        for i in order:  # a short word beside a restored one
            near = (i and keep[i - 1]) or (i + 1 < len(spans) and keep[i + 1])
            short = len(spans[i][2]) == 1 and text[spans[i][0]].isupper() and spans[i][2].islower()
            keep[i] = keep[i] or maybe[i] and bool(near or not latin[i]) or bool(near and (latin[i] or short) and spans[i][2].islower())
    return [s for s, k in zip(spans, keep) if k]


def _double(text: str, pair: Pair) -> list[tuple[int, int, str]]:
    """Runs that read as Japanese in the pair's first encoding: with kana in them, or beside Japanese that is right."""
    out = []
    right = CJK.search(text) is not None
    for m in re.finditer(r"\S+", text):
        w = m[0]
        if w.isascii() or CJK.search(w):
            continue
        new = _reread(w, pair)
        if new is None:
            continue
        kana = sum("ぁ" <= c <= "ー" for c in new)
        most = sum(bool(CJK.match(c)) or c in "。、・「」" for c in new)
        halfwidth = any("｡" <= c <= "ﾟ" for c in new)
        if not halfwidth and most >= 0.6 * len(new) and (kana >= 2 or (right or out) and most == len(new)):
            out.append((m.start(), m.end(), new))
    return out


def _alphabet_rank(text: str, pair: Pair, spans: list[tuple[int, int, str]]) -> float:
    """How well words read: by the share of common pairs of letters, in the script of the rest of the text, and not all in capitals."""
    lang = next(x[2] for x in ALPHABETS if x[:2] == pair[:2])
    new = " ".join(o for *_, o in spans)
    n, all_ = _hits(new, lang)
    beside = re.search("[Ͱ-Ͽ]" if lang == "el" else "[Ѐ-ӿ]", text) is not None
    return n / max(all_, 1) + 0.5 * beside - 0.5 * new.isupper()


@lru_cache(maxsize=None)
def _units(had: str, read_as: str) -> re.Pattern:
    """Two or more two-byte characters of ``had`` in a row."""
    table = _byte_table(read_as)
    lead = "".join(map(re.escape, table[0x81:0xFF]))
    trail = "".join(map(re.escape, table[0x40:0x7F] + table[0x80:0xFF]))
    return re.compile(f"(?:[{lead}][{trail}]){{2,}}")


def _han(text: str, pair: Pair) -> list[tuple[int, int, str]]:
    """Runs that read as Chinese or Korean in the pair's first encoding, in commoner characters, and are no right words."""
    out, back = [], _to_bytes(pair.read_as)
    for m in _units(pair.had, pair.read_as).finditer(text):
        run = m[0]
        new = _reread(run, pair)
        if new is None or _ordinary("".join(sorted(set(run)))) or 4 * sum(c.isalpha() for c in run) < len(run) or sum(not c.isascii() for c in run) < 0.6 * len(run):
            continue
        rows = COMMON_ROWS[pair.had]
        common = sum(any(a <= back[c] < b for a, b in rows) for c in run[::2])
        letters = sum("一" <= c <= "鿿" or "가" <= c <= "힣" for c in new)
        if letters >= 2 and letters >= 0.6 * len(new) and common >= 0.6 * len(new):
            out.append((m.start(), m.end(), new))
    return out


def _han_rank(spans: list[tuple[int, int, str]]) -> float:
    """How well spans read: Chinese by characters that any text holds, Korean by being all Hangul."""
    new = "".join(o for *_, o in spans)
    hangul = all("가" <= c <= "힣" for c in new)
    return 0.2 if hangul else sum(c in FREQUENT for c in new) / len(new)


WIDE = re.compile("[\u2010-\uff9f]+")


def _wide_sense(new: str, text: str, a: int, b: int) -> bool:
    """Whether a run that is valid UTF-8 in a two-byte encoding reads as text."""
    if any(unicodedata.category(c) in ("Cc", "Cn", "Co") for c in new):
        return False
    if all(ord(c) >= 0x800 for c in new):
        return len(new) >= 2 or ord(new) > 0xFFFF
    letters = {c.lower() for c in new if c.isalpha()}
    if not all(c.isalpha() or c in PLAIN_MARKS for c in new) or not letters:
        return False
    if all("Ͱ" <= c <= "ӿ" for c in letters):
        return len(new) >= 3 and (new.islower() or new.istitle() or new.isupper()) and max(_hits(new, x)[0] for x in GENERAL) >= 1 and _ordinary(new)
    return _ordinary(new) and (text[a - 1 : a].isascii() and text[a - 1 : a].isalpha() or text[b : b + 1].isascii() and text[b : b + 1].isalpha())


def _wide(text: str, pair: Pair) -> list[tuple[int, int, str]]:
    """Runs whose bytes in a two-byte encoding are UTF-8. A character cut off at their end is lost."""
    out = []
    for m in WIDE.finditer(text):
        try:
            data = m[0].encode("gb18030" if pair.read_as == "gbk" else pair.read_as)  # what GBK leaves open has private characters there
        except UnicodeEncodeError:
            continue
        try:
            new, cut = data.decode(), False
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data" or e.start < 3:
                continue
            new, cut = data[: e.start].decode(), True
        if _wide_sense(new, text, m.start(), m.end()):
            out.append((m.start(), m.end(), new + "�" * cut))
    return out


LOWER = re.compile(r"[a-z]")


def garbled_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (from, to, original) of ``text`` that one round restores; U+FFFD gives itself."""
    auto, pairs = automaton()
    by: dict[int, list[tuple[int, int, str, bool]]] = {}
    for end, (n, entries) in auto.iter(text):
        for e in entries:
            pair = pairs[e.pair]
            if pair.kind == "utf8":
                a = end + 1 - n
                b = a + _lengths(pair.read_as)[text[a]]
                known = _utf8_sequence(text[a:b], pair.read_as) if b <= len(text) else None
                if known:
                    by.setdefault(e.pair, []).append((a, b, *known))
            else:
                by.setdefault(e.pair, []).append((end + 1 - n, end + 1, e.original, e.strong))
    if WIDE.search(text):
        for k, pair in enumerate(pairs):
            if pair.kind == "wide":
                by[k] = []
    accepted: dict[int, list[tuple[int, int, str]]] = {}
    for k, hits in by.items():
        pair = pairs[k]
        spans: list[tuple[int, int, str]] = []
        if pair.kind == "lost":
            spans = [h[:3] for h in hits]
        elif pair.kind == "utf8":
            spans = _utf8(text, hits)
        elif pair.kind == "latin":
            spans = [h[:3] for h in hits if _between(text, h[0], h[1])]
        elif pair.kind == "alphabet":
            spans = _alphabet(text, pair, next(x[2] for x in ALPHABETS if x[:2] == pair[:2]))
        elif pair.kind == "wide":
            spans = _wide(text, pair)
        elif pair.kind == "han":
            if len(hits) >= 2:
                spans = _han(text, pair)
        elif len(hits) >= 2 or CJK.search(text):
            spans = _double(text, pair)
        if spans:
            accepted[k] = _apart(spans)
    # What is UTF-8 nearly throughout can be two-byte characters or words by chance only; words go before rare ideographs.
    valid = {i for k, spans in accepted.items() if pairs[k].kind == "utf8" for a, b, _ in spans for i in range(a, b)}
    words = {i for k, spans in accepted.items() if pairs[k].kind == "alphabet" for a, b, _ in spans for i in range(a, b)}

    def within(a: int, b: int, places: set[int]) -> bool:
        beyond = [i for i in range(a, b) if not text[i].isascii()]
        return bool(places) and sum(i in places for i in beyond) >= 0.9 * len(beyond)

    for k in list(accepted):
        if pairs[k].kind in ("han", "alphabet"):
            accepted[k] = [x for x in accepted[k] if not within(x[0], x[1], valid)]
        if pairs[k].kind == "han" and accepted[k] and _han_rank(accepted[k]) < 0.3:
            accepted[k] = [x for x in accepted[k] if not within(x[0], x[1], words)]
        if not accepted[k]:
            del accepted[k]
    # The pair that explains most of the text goes first, and others get what it leaves; of equals the surer kind.
    def first(k: int) -> tuple:
        spans = accepted[k]
        kind = pairs[k].kind
        gain = _alphabet_rank(text, pairs[k], spans) if kind == "alphabet" else _han_rank(spans) if kind == "han" else 0
        return -sum(b - a for a, b, _ in spans), -_KINDS[pairs[k].kind], -gain, k

    rank = sorted(accepted, key=first)
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))
    for k in rank:
        for a, b, o in accepted[k]:
            if not any(used[a:b]):
                used[a:b] = b"\1" * (b - a)
                taken.append((a, b, o))
    return sorted(taken)


_KINDS = {"utf8": 3, "wide": 3, "double": 2, "han": 2, "alphabet": 1, "latin": 0, "lost": 3}


def _apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Leftmost and longest first, without overlaps."""
    out: list[tuple[int, int, str]] = []
    for a, b, o in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, o))
    return out


def _between(text: str, a: int, b: int) -> bool:
    """Inside a word of small plain letters, where right text has no sign or letter of another script."""
    return 0 < a and b < len(text) and bool(LOWER.match(text[a - 1])) and bool(LOWER.match(text[b])) and (a < 2 or text[a - 2].isascii()) and not re.match(r"[A-Z]", text[b])


def _settled(text: str, hits: list[tuple[int, int, str, bool | None]]) -> list[tuple[int, int, str, bool | None]]:
    """Matches without those letters of words that no surer match touches."""
    out: list[tuple[int, int, str, bool | None]] = []
    chain: list[tuple[int, int, str, bool | None]] = []
    for h in [*sorted(hits, key=lambda x: x[:2]), None]:
        if chain and (h is None or h[0] != chain[-1][1]):
            a, b = chain[0][0], chain[-1][1]
            alone = not any(c and not c.isascii() for c in (text[a - 1 : a], text[b : b + 1]))
            odd = any(x.islower() and y.isupper() for s in chain for x, y in zip(text[s[0] : s[1]], text[s[0] + 1 : s[1]]))
            run = text[a:b]
            mixed = len(chain) > 2 and not run.isalpha() and sum(c.isalpha() for c in run) >= len(chain)
            if alone and (odd and len(chain) > 1 or mixed):
                out += [s[:3] + (True,) for s in chain]
            elif any(s[3] is not None for s in chain):
                out += chain
            chain = []
        if h:
            chain.append(h)
    return out


def _utf8(text: str, hits: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Matches of UTF-8 bytes read otherwise. A sequence that right text could hold needs another beside it, or an odd place."""
    if any(h[3] is None for h in hits):
        hits = _settled(text, hits)
    if any(h[3] for h in hits):
        return [h[:3] for h in hits]
    surer = [h for h in hits if h[3] is not None]
    starts, stops = {h[0] for h in surer}, {h[1] for h in surer}
    for a, b, _, _ in surer:
        before, after = text[a - 1 : a], text[b : b + 1]
        lead, rest = text[a], text[a + 1 : b]
        lone = lead.isupper() and not before.isalpha() and not any(c.isalpha() for c in rest) and lead.lower() not in "àéèêôóáí"
        inside = lead.isupper() and before.islower() and (after.islower() or not after.isalpha())
        followed = any(c in "‘’“”„‚«»‹›–—…†‡•" for c in rest) and after.isalpha() and lead.isalpha()
        turned = b - a > 2 and text[a:b].isalpha() and text[a : b - 1].isupper() and text[b - 1].islower() and not before.isalpha() and not after.isalpha()
        if b in starts or a in stops or lone or inside or followed or turned:
            return [h[:3] for h in hits]
    return []


def restore(text: str | None) -> tuple[bool, str | None]:
    """(garbled, restored text)."""
    if not text or text.isascii():
        return False, text
    garbled, seen = False, set()
    # Until nothing is left to restore; a text that comes back would go round for ever.
    while text not in seen:
        seen.add(text)
        spans = [s for s in garbled_spans(text)]
        garbled |= bool(spans)
        spans = [s for s in spans if s[2] != text[s[0] : s[1]]]
        if not spans:
            break
        out, at = [], 0
        for a, b, o in spans:
            out += [text[at:a], o]
            at = b
        text = "".join(out) + text[at:]
    return garbled, text


def _restore_batch(texts: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple[bool, str | None]] = {}
    rows = []
    for t in texts:
        if t is None:
            rows.append((False, None))
            continue
        r = known.get(t)
        if r is None:
            r = known[t] = restore(t)
        rows.append(r)
    return pd.DataFrame(rows, columns=["garbled", "restored"])


def repair(df: DataFrame, text: str | Column, garbled: str = "garbled", restored: str = "restored") -> DataFrame:
    """``df`` with a flag for garbled text and the text restored as far as it can be.

    Plain ASCII can't be garbled: such rows, most of a log, never leave the JVM. Columns of ``df`` named as the two new
    ones are replaced.
    """
    ship(df.sparkSession)
    t = F.col(text) if isinstance(text, str) else text
    odd = F.when(t.rlike(r"[^\x00-\x7F]"), t)
    out = df.withColumn("_mr_text", t).withColumn("_mr_fix", F.pandas_udf(_restore_batch, "garbled boolean, restored string")(odd))
    fix = F.col("_mr_fix")
    return out.withColumns({garbled: F.coalesce(fix["garbled"], F.lit(False)), restored: F.coalesce(fix["restored"], F.col("_mr_text"))}).drop(*{"_mr_text", "_mr_fix"} - {garbled, restored})
