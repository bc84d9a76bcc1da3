import pytest
from pyspark.sql import functions as F

from millrace.llm import encoding as E

RIGHT = [
    "plain text", "Größe 12, Straße, Übergabe", "déjà vu « très élevé » gardé", "ATENÇÃO: CONEXÃO, SÃO, IRMÃ DE MANHÃ", "żądany źródło część", "Ошибка записи: каталог, повтор через 5 секунд", "архив свободного места", "Σφάλμα σύνδεσης με τον κόμβο", "接続が拒否されました。番号 5",
    "Đã nhận yêu cầu", "20 °C ± 1, “steady” – fee 5 €", "├── a\n└── b", "naïve coöp façade", "„Äpfel“ und ‚Birnen‘", "МОСКВА И РИМ", "Київ і Львів", "m³ und m²", "don’t — École", "½ ¼", "ÀÉÈ", "ÅÄÖ åäö",
]
GARBLED = [
    ("Größe 5, Straße", "utf-8", "cp1252"), ("Größe 5, Straße", "utf-8", "latin-1"), ("Größe 5, Straße", "utf-8", "mac_roman"), ("Größe 5, Straße", "utf-8", "cp437"), ("Größe 5, Straße", "utf-8", "cp850"), ("relevé contrôle déjà", "utf-8", "cp1250"), ("Ошибка записи", "utf-8", "cp1251"),
    ("Ошибка записи каталога", "utf-8", "cp1252"), ("żądany źródło", "utf-8", "cp1252"), ("20 °C ± 1 “steady”", "utf-8", "cp1252"), ("Загрузка завершена, каталог", "cp1251", "cp1252"), ("Загрузка завершена, каталог", "koi8-r", "cp1251"), ("Σφάλμα σύνδεσης με τον κόμβο", "cp1253", "cp1252"),
    ("画面の更新が完了しました", "cp932", "cp1252"), ("接続が拒否されました", "utf-8", "cp1252"), ("接続が拒否されました", "utf-8", "latin-1"), ("Đã nhận yêu cầu", "utf-8", "cp1252"),
]


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_is_left_alone(text):
    assert E.restore(text) == (False, text)


@pytest.mark.parametrize("text, had, read_as", GARBLED)
def test_round_trip(text, had, read_as):
    bad = E.garble(text, had, read_as)
    assert bad != text and E.restore(bad) == (True, text)


def test_twice_and_in_places():
    twice = E.garble(E.garble("größte Länge", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert E.restore(twice) == (True, "größte Länge")
    mixed = "Größe und " + E.garble("Länge", "utf-8", "cp1252") + " und Übergabe"
    assert E.restore(mixed) == (True, "Größe und Länge und Übergabe")


def test_lost_text_is_found_and_left():
    assert E.restore("Stra�e 5") == (True, "Stra�e 5")
    assert E.restore(None) == (False, None) and E.restore("") == (False, "")


def test_long_text():
    text = "über " * 40_000 + E.garble("Länge", "utf-8", "cp1252")
    assert E.restore(text) == (True, "über " * 40_000 + "Länge")


def test_repair(spark):
    bad = E.garble("Größe", "utf-8", "cp1252")
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, bad, "x"), (4, bad, "x"), (5, "Größe", None)], "id int, log string, garbled string")
    rows = sorted(map(tuple, E.repair(df, "log").select("id", "log", "garbled", "restored").collect()), key=str)
    assert rows == [(1, None, False, None), (2, "", False, ""), (3, "plain", False, "plain"), (4, bad, True, "Größe"), (4, bad, True, "Größe"), (5, "Größe", False, "Größe")]
    assert E.repair(df.limit(0), "log").count() == 0
    assert E.repair(df, F.col("log"), "log", "_mr_text").filter("log").count() == 2  # the new columns take the place of any by their names


@pytest.mark.parametrize("text, had, read_as", [
    ("deploy 🚀 done", "utf-8", "cp1252"), ("서버 연결", "utf-8", "latin-1"), ("เชื่อมต่อ", "utf-8", "cp1252"), ("सर्वर त्रुटि", "utf-8", "mac_roman"), ("错误", "utf-8", "koi8-r"), ("错误", "utf-8", "cp866"),
    ("连接失败", "utf-8", "iso8859-15"), ("bəli", "utf-8", "cp1252"), ("bəli", "utf-8", "cp437"), ("deploy 🚀 done", "utf-8", "cp1251"), ("deploy 🚀 done", "utf-8", "cp866"), ("შეცდომა", "utf-8", "mac_roman"), ("连接失败", "gbk", "cp1252"), ("连接失败，错误", "gbk", "latin-1"), ("서버 연결이 끊어졌습니다", "euc_kr", "cp1252"), ("連線失敗，請稍後再試", "big5", "latin-1"),
])
def test_all_scripts_and_encodings(text, had, read_as):
    bad = E.garble(text, had, read_as)
    assert bad != text and E.restore(bad) == (True, text)


@pytest.mark.parametrize("text, read_as", [("接続が拒否されました番号", "cp932"), ("错误错误", "gb18030"), ("🚀", "gbk"), ("ошибка", "gbk")])
def test_read_as_two_bytes(text, read_as):
    assert E.restore(text.encode().decode(read_as)) == (True, text)


def test_cut_off_two_bytes():
    assert E.restore("謗･邯壹") == (True, "接続�")


@pytest.mark.parametrize("text", ["CAFÉ® et CAFÉ™", "╔╗╔╗ │", "сначала щипцами", "Ёлка", "连接失败，错误", "用户登录", "서버 연결이 끊어졌습니다", "🚀 ok", "étés créées", "діє мрії", "サーバーに接続できません", "連線失敗", "ﾃｽﾄ ｻｰﾊﾞ", "à  à  b"])
def test_right_text_of_all_scripts_is_left_alone(text):
    assert E.restore(text) == (False, text)


def test_twice_garbled_is_not_chinese():
    text = "Échec de la requête vers contrôle, délai dépassé après 2.781 s"
    assert E.restore(E.garble(E.garble(text, "utf-8", "cp1252"), "utf-8", "cp1252")) == (True, text)
    assert E.restore(E.garble("模块 加载 失败", "gbk", "cp1252")) == (True, "模块 加载 失败")


@pytest.mark.parametrize("text, had", [
    ("вход: report.txt", "cp1251"), ("ошибка", "cp1251"), ("Ακύρωση 3", "cp1253"), ("Λήψη", "cp1253"), ("файл 7", "koi8-r"), ("Нажмите кнопку", "cp866"), ("Αποθήκευση αρχείου", "cp1253"), ("щётка", "iso8859-5"),
])
def test_short_words_of_one_byte_alphabets(text, had):
    assert E.restore(E.garble(text, had, "cp1252")) == (True, text)


@pytest.mark.parametrize("text", ["мРНК и кВт", "“…”—", "ПЫЛЬ", "БВГД", "Îles Çà", "Þórður Ægir", "ΑΒΓ", "Łódź Żółć", "Ñandú ÑOÑO"])
def test_right_words_of_alphabets_are_left_alone(text):
    assert E.restore(text) == (False, text)


SENTENCES = {
    "de": "Der Zähler meldet größere Abweichungen, bitte prüfen Sie die Übertragung später.", "fr": "La clé périmée a été remplacée à l’entrepôt, délai dépassé après 5 s.", "es": "La dirección está vacía, se omitió el envío mañana por la línea.", "pt": "Atenção: a conexão não está disponível amanhã às 9 horas.",
    "pl": "Żaden z węzłów nie zgłosił gotowości, spróbuj później ponownie.", "ru": "Остальные строки будут проверены следующей ночью, ошибок нет.", "el": "Η σύνδεση με τον κόμβο έληξε, δοκιμάστε ξανά αργότερα.", "ja": "接続が拒否されました。番号を確認してください。", "zh": "连接失败，请稍后再试。", "ko": "서버 연결이 끊어졌습니다.",
    "vi": "Đã nhận yêu cầu của kho hàng phía đông.",
}


def garbled_by_construction(pairs):
    for language, text in SENTENCES.items():
        for had, read_as in pairs:
            try:
                bad = E.garble(text, had, read_as)
            except UnicodeError:
                continue
            if bad != text and "�" not in bad:
                yield language, had, read_as, f"Job 5: {bad} (end)", f"Job 5: {text} (end)"


def test_restored_against_the_truth():
    """What share of texts garbled by every pair is found, and what share is restored to the letter: the figures of the README."""
    utf8 = [E.restore(bad) == (True, good) for *_, bad, good in garbled_by_construction([("utf-8", r) for r in E.READ_AS])]
    assert len(utf8) > 60 and sum(utf8) / len(utf8) > 0.95
    pairs = [*[(a, b) for a, b, _ in E.ALPHABETS], *E.LATIN, *E.DOUBLE_BYTE, *E.HAN_HANGUL]
    rest = [(E.restore(bad), good) for *_, bad, good in garbled_by_construction(pairs)]
    assert len(rest) > 60 and sum(found for (found, _), _ in rest) / len(rest) > 0.75


def test_garbled_more_often_than_twice():
    text = "größte Länge"
    for _ in range(5):
        text = E.garble(text, "utf-8", "cp1252")
    assert E.restore(text) == (True, "größte Länge")


def test_restored_table(spark):
    rows = [(i, bad, good) for i, (*_, bad, good) in enumerate(garbled_by_construction([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437")]))]
    df = spark.createDataFrame(rows, "id int, log string, truth string")
    got = E.repair(df, "log").select("garbled", (E.F.col("restored") == E.F.col("truth")).alias("right")).collect()
    assert all(r["garbled"] for r in got) and sum(r["right"] for r in got) == len(rows)
