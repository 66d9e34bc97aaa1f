import pytest

from codeloom.llm import mojibake as M

TEXTS = ["prüft, ob die Größe der Liste zulässig ist", "vérifie que la clé n'est pas déjà utilisée", "comprueba que la sesión esté activa", "configuração padrão até à próxima versão", "zwróć błąd, jeśli żądanie wygasło", "проверяем, что запись не устарела", "从配置中读取默认值", "期限切れのデータを削除します"]
CORRECT = [*TEXTS, "NÃO alterar a ordem", "SÃO necessárias", "price in £ or ¥, see §3 ¶2", "tolerance ±0.5 °C, drift in µs", "manifest → folder → done ✓", "cost is Θ(n) while ≤ √m, else Σ", "½ of it × 3 ÷ 2", "“a” and ‘b’ are quoted as in the form…", "├── a │ └── b", "üüüüüüüüüüüüüüüü", "界界界界界界界界", "НЕ МЕНЯТЬ ПОРЯДОК ВЫЗОВОВ", "检查draft是否已经过期", "año_fiscal", "größenrechner", "naïve café", "注意：此处不能并发调用", "Ünal Ömer", "x²+y² ≈ 3 m²"]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_is_no_case(text):
    assert M.field(f"# {text}\nx = 1\n") is None and M.field(text) is None


PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "cp1251")]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("meant", "read"), PAIRS)
def test_round_trip(text, meant, read):
    try:
        damaged = text.encode(meant).decode(read)
    except UnicodeDecodeError:
        pytest.skip("not readable")
    found = M.field(f"a = 1\n# {damaged}\n")
    assert found, damaged
    if found[1]:
        assert found[0] == f"a = 1\n# {text}\n"


@pytest.mark.parametrize(("text", "meant", "read"), [(TEXTS[5], "cp1251", "cp1252"), (TEXTS[5], "koi8-r", "cp1251"), (TEXTS[5], "cp1251", "koi8-r"), (TEXTS[6], "gb18030", "latin-1"), (TEXTS[7], "euc_jp", "latin-1"), (TEXTS[7], "cp932", "latin-1"), (TEXTS[4], "cp1250", "cp1252"), (TEXTS[0], "cp1252", "cp437"), (TEXTS[1], "cp1252", "mac-roman"), (TEXTS[6], "utf-8", "gb18030")])
def test_other_ways(text, meant, read):
    try:
        damaged = text.encode(meant).decode(read)
    except UnicodeDecodeError:
        pytest.skip("not readable")
    assert M.field("# " + damaged)


def test_read_twice_and_lost():
    twice = TEXTS[0].encode().decode("cp1252").encode().decode("cp1252")
    assert M.field(twice) == (TEXTS[0], True)
    lost = TEXTS[1].encode("latin-1").decode("utf-8", "replace")
    assert M.field(lost) == (None, False)
    assert M.field("caf\\u00c3\\u00a9") and M.field("caf\\u00e9") is None


def test_long_runs_are_searched_whole():
    long_text = "".join(TEXTS[6] for _ in range(80))
    damaged = long_text.encode().decode("latin-1")
    assert len(damaged) > 2 * M.MAX_SEGMENT and M.field("x " + damaged) == ("x " + long_text, True)
    assert M.field(long_text) is None and M.field("é" * 3000) is None
    assert M.field("a" * 3000 + TEXTS[0].replace(" ", "_").encode().decode("cp1252"))
    assert M.field("a" * 3000 + "caf\\u00c3\\u00a9") and M.field("a=1&b=2 &amp; %20 " * 300) is None


def test_table(spark):
    bad = TEXTS[0].encode().decode("cp1252")
    rows = [(1, bad, "/a.py", "clash"), (1, bad, "/a.py", "clash"), (2, None, "/" + bad, None), (3, TEXTS[0], None, None), (4, "", "", None), (None, bad, bad, None)]
    df = spark.createDataFrame(rows, "file_id long, source_code string, path string, field_name string")
    assert {(r.file_id, r.field_name, r.original) for r in M.damaged(df).collect()} == {(1, "source_code", TEXTS[0]), (2, "path", "/" + TEXTS[0])}
    assert M.damaged(df.limit(0)).count() == 0


WORDS = "Größe über Übersicht Schlüssel prüfen zulässig Straße für Änderung löschen müssen schließen être été déjà vérifie clé réglage français garçon où à Noël cœur está también año contraseña niño señal público acción não são coração até configuração ошибка проверка ключ это код данные привет配置 检查 用户 密码 注意 パスワード 設定 確認 łódź żółć ważny klucz_główny".split()


def _sloppy(raw):
    return "".join(M._SLOPPY[b] for b in raw)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "twice"])
def test_words_come_back_or_stay_open(read):
    right = total = 0
    for word in WORDS:
        try:
            damaged = _sloppy(_sloppy(word.encode()).encode()) if read == "twice" else _sloppy(word.encode()) if read == "cp1252" else word.encode().decode(read)
        except UnicodeDecodeError:
            continue
        for text, want in ((damaged, word), (f"x = 1  # {damaged} here", f"x = 1  # {word} here")):
            found = M.field(text)
            assert found and found in ((want, True), (None, False)), (word, damaged, found)
            right += found[1]
            total += 1
    assert right >= 0.97 * total


def test_words_of_legacy_pages():
    for word in ("ошибка", "проверка", "данные"):
        assert M.field(_sloppy(word.encode("cp1251"))) == (word, True)
    assert M.field("//  кэш и РєРѕРґ ключа") == ("//  кэш и код ключа", True)  # one damaged word in a right line of the same script
    assert M.field("# żółć") is None and M.field("# Übersicht der Größen über alles") is None


@pytest.mark.parametrize("n", [30, 120])
def test_one_damaged_word_in_a_long_line(n):
    words = "die Größe der Liste ist für alle Schlüssel zulässig und muss vor dem Löschen geprüft werden".split()
    line = [words[k % len(words)] for k in range(n)]
    for at in range(len(words)):
        if line[at].isascii():
            continue
        broken = [*line[:at], _sloppy(line[at].encode()), *line[at + 1:]]
        assert M.field("// " + " ".join(broken)) == ("// " + " ".join(line), True)


def test_read_four_times():
    text = TEXTS[0]
    for _ in range(4):
        text = _sloppy(text.encode())
    assert M.field(text) == (TEXTS[0], True)
