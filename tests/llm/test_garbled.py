import html

import pytest

from quillgraph.llm import garbled as g

TEXTS = [
    "J'ai vérifié 75 fois et le gâteau déplace bientôt le réseau. À mon avis, il faut un câble gelé.",
    "El cañón pequeño añade el ratón también. ¿Qué código recibió el vídeo?",
    "O avião não fechará o coração já. A solução é só água amanhã.",
    "Für den Kühler schließt plötzlich die Tür, außerdem geprüft und größer.",
    "That’s what I don’t get… “quoted” words – and an em dash — here.",
    "Попробуйте другой насос, ещё один счётчик нужен всегда. Мой старый мотор снова греет.",
    "なぜ 小さな 歯車 は 動かない のか。 試しました が 棚 は 壊れ ました。",
]
PLAIN = [
    "[ ├ and ┤ are box signs, Delyonpra ]", "ÂGE and SÃO are on the label. ATENÇÃO: NÃO", "Ð is a letter, so is Ø. Ñ and Õ print as boxes.", "About 316 €, plus 5 °C margin, 10 µF ±5 %",
    "├── sensor_id\n│   ├── replicas.cfg\n└── README", "Résumé: a minimal façade, naïve «Æther» “Île” CAFÉ™", "caf&#233; it&#8217;s fine &#8211; trust me &lt;b&gt; &eacute;", "α ≤ β, ½ × ¼ → √2", "Łódź żółć Dvořák İstanbul", "",
    "no​space and\xa0nbsp", "👍 ok", None,
]


def garble(text, page):
    return "".join(chr(b) if page == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(page) for b in text.encode())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("page", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850"])
def test_utf8_read_by_a_page_is_restored(text, page):
    once = garble(text, page)
    assert g.examine(once)[:3] == (True, text, True)
    if page == "cp1252":
        assert g.examine(garble(once, page))[:3] == (True, text, True)
        refs = "".join(c if c.isascii() else f"&#{ord(c)};" for c in once)
        assert g.examine(refs)[:2] == (True, text)
        assert html.unescape(refs) == once


@pytest.mark.parametrize("text", TEXTS[:3])
@pytest.mark.parametrize("page", ["cp437", "mac_roman"])
def test_western_pages_are_told_apart(text, page):
    hit, restored, *_ = g.examine(text.encode("cp1252").decode(page))
    same = sum(a == b for a, b in zip(restored.split(), text.split()))
    assert hit and same >= 0.65 * len(text.split())


@pytest.mark.parametrize("pages", [("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1251", "koi8_r")])
def test_cyrillic_pages_are_told_apart(pages):
    hit, restored, *_ = g.examine(TEXTS[5].encode(pages[0]).decode(pages[1]))
    same = sum(a == b for a, b in zip(restored.split(), TEXTS[5].split()))
    assert hit and same >= 0.8 * len(TEXTS[5].split())


@pytest.mark.parametrize("word", ["café", "probaré", "está", "más", "citará", "voilà", "über", "también", "você", "école", "ágil", "être", "índice", "Éveil", "canción", "español", "dragón", "CAFÉ"])
def test_one_word_read_as_cp437_is_found(word):
    assert g.examine(f"All is well, {word.encode('cp1252').decode('cp437')} so far.")[:3] == (True, f"All is well, {word} so far.", True)


@pytest.mark.parametrize("text", ["groß, größer, gemäß, Fuß, STRAßE, ß", "sinθ, cosφ, Δx, Δtime, Σvalue, xα, 10kΩ, MΩ, Ωcm, σmax, TNFα", "El cañón de la compañía, cañón, cañón, cañón", "a note‡ and † another·", "└── a ┬ b ┴ c ┼"])
def test_correct_letters_that_look_like_another_page(text):
    assert g.examine(text)[:2] == (False, text)


def test_references_that_were_escaped_again():
    assert g.examine("a caf&amp;Atilde;&amp;copy; here")[:3] == (True, "a café here", True)
    assert g.examine("a caf&amp;amp;#195;&amp;amp;#169; here")[:2] == (True, "a café here")
    assert not g.examine("a caf&amp;eacute; &amp;lt;b&amp;gt; here")[0]


def test_part_of_a_text_and_lost_characters():
    assert g.examine("All is well. " + garble("Déjà vu", "cp1252") + " and more é.")[1] == "All is well. Déjà vu and more é."
    assert g.examine("don�t")[:3] == (True, "don�t", False)


@pytest.mark.parametrize("text", [*TEXTS, *PLAIN])
def test_correct_text_is_no_case(text):
    assert g.examine(text)[:2] == (False, text)


def test_long_text_without_spaces():
    long = garble("é" * 5000, "cp1252") + "漢" * 5000
    assert g.examine(long)[0]
    assert not g.examine("漢字かな" * 5000)[0]


@pytest.mark.parametrize("n", [192, 960, 4800])
def test_length_changes_nothing(n):
    text = ("日本語の文章がここにあります機械は毎日動いています" * 300)[:n]
    assert g.examine(garble(text, "latin_1"))[:3] == (True, text, True)


@pytest.mark.parametrize("word", ["Île", "Über", "Šárka", "Ärger", "Éveil"])
def test_one_capital_read_as_cp1250_is_found(word):
    assert g.examine(f"All is well. {garble(word, 'cp1250')} so far.")[:2] == (True, f"All is well. {word} so far.")


def test_a_guess_is_not_called_certain():
    korean = "한국어 문장은 여기에 있습니다".encode("cp949").decode("latin_1")
    assert g.examine(korean)[0] and not g.examine(korean)[4]
    assert g.examine(garble("Le gâteau est gelé, déjà vu", "cp1252"))[4]
    assert not g.examine("All is well, ⁿber so far.")[4]


def exhaustive(word):
    """The cheapest of all states that up to four changes reach, by breadth."""
    start = g._unescape(word)
    costs, level = {start: 0.0}, {start: 0.0}
    for depth in range(4):
        after = {}
        for at, steps in level.items():
            for way, new in g._neighbours(at, False):
                more = steps + g._likely(way)
                if more < after.get(new, costs.get(new, 99.0)):
                    after[new] = more
        costs |= after
        level = after
    return min(g.cost(t) + s for t, s in costs.items())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437", "cp1250"])
def test_the_search_finds_the_cheapest_text(text, page):
    for once in (text, garble(text, page) if page != "cp1250" else text.encode().decode("cp1250", "ignore")):
        for word in {*once.split(), *garble(once, "latin_1").split(" ")}:
            new, gain, ways, utf8 = g.search(word)
            if utf8:
                assert abs(g.cost(new) + sum(map(g._likely, ways.split(" + "))) - exhaustive(word)) < 1e-6


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "cafÃ©", 5), (1, "cafÃ©", 6), (2, None, 1), (None, "cafÃ©", 1), (3, "", 1), (4, "fine", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored int")
    got = g.find_garbled(df).collect()
    assert [(r.doc_id, r.restored, r.complete) for r in got] == [(1, "café", True)]
    assert g.find_garbled(df.limit(0)).count() == 0
