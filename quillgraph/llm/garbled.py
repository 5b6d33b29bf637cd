"""Garbled text from wrong character encoding: a best-first search for the most plausible text that explains it.

A state is a word. Its neighbours are what it becomes when it is encoded by one code page and decoded as UTF-8 or by
another page, or when character references are resolved. The search always expands the cheapest state known, by the
plausibility of its characters and a little for each step, and never visits a state twice. A word is garbled if a
state is reached that is cheaper by a margin; characters that stand for lost ones can't be undone, but are cases too.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code pages by which UTF-8 is commonly misread, and pages that are mistaken for one another.
MISREAD_UTF8 = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "iso8859_2", "iso8859_15", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp932", "gbk")
READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250")
WRITTEN_AS = ("cp1252", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "cp1250", "euc_jp", "cp932")
#: Further pages that the same bytes could be of: not searched, but a restoration isn't certain if one of them explains it as well.
RIVALS = ("cp949", "gbk", "big5", "cp1253", "cp1254", "cp1255")
_MULTIBYTE = {"euc_jp", "cp932", "gbk", "cp949", "big5"}

STEP_COST = 0.1
#: Gain in plausibility from which a word that is UTF-8 read by a code page is garbled: that it is valid UTF-8 is evidence in itself.
UTF8_GAIN = 0.5
#: Gain of one word, or of all words by the same change, for pages mistaken for one another.
PAGE_GAIN = 1.9
PAGE_GAIN_ALL = 3.0
#: Cost from which a word is searched for that: less are rarer letters, pairs of accents and Greek variables (0.9) of correct text, which would add up.
PAGE_COST = 1.0
#: Words of more characters are not remembered.
REMEMBERED = 256
#: A restoration isn't certain if another change explains a word by another text that is less than this costlier.
CERTAIN = 0.3

_SUSPECT = regex.compile(r"[^ \t\r\n]*(?:[^\x00-\x7f]|&#?[0-9A-Za-z]{1,31};)[^ \t\r\n]*")
_REFERENCE = regex.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][0-9A-Za-z]{1,30});")
_SEQUENCES = re.compile(
    rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3})+"
)
_RUN = regex.compile(r"[^\x00-\x7f]+")

# Ranges of characters that texts are commonly written in.
_COMMON = (
    (0xA0, 0x17F), (0x300, 0x36F), (0xFB00, 0xFB06), (0x2C6, 0x2DD), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x590, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x214F),
    (0x2150, 0x23FF), (0x2460, 0x27BF), (0x3000, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0E, 0xFE0F), (0xFF01, 0xFF5E), (0x1F000, 0x1FAFF),
)
_QUOTES = set("“”‘’«»‹›…–—¿¡„‚ ​­")
_SPACING = set("¬¨´¸¯ˆ˜˘˙˝˛ˇ¦¤")
_AFTER_LETTER = set("™®©°²³¹ªº•·")
_RARE = dict.fromkeys("хжшюцщэфъёХЖШЮЦЩЭФЪЁ", 0.06) | dict.fromkeys("ýþðÿøåæœšžłőűÝÞÐŸØÅÆŒŠŽŁ", 0.1)
_MICRO = set("µμΩ℃№")
_VOWELS = set("aeiouyäöüAEIOUYÄÖÜ")
_FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp", "lim", "max", "min", "arg", "det")


@lru_cache(maxsize=20_000)
def kind(c: str) -> str:
    """Class of a character: a A latin, e E latin with accents, g greek, c C cyrillic, k han and kana, q typography, b boxes, z accents that stand alone, s symbols, x no text, d digit, p ascii."""
    o = ord(c)
    if o < 128:
        return "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "d" if c.isdigit() else "p"
    if c in _QUOTES:
        return "q"
    if c in _SPACING:
        return "z"
    if c in _MICRO:
        return "m"
    if c in _AFTER_LETTER:
        return "t"
    if o < 0xA0 or o == 0xFFFD or unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs"):
        return "x"
    if 0x2500 <= o < 0x25A0:
        return "b"
    if 0x370 <= o < 0x400:
        return "g"
    if 0x400 <= o < 0x530:
        return "C" if c.isupper() else "c"
    if 0x2E80 <= o < 0xA000 or 0xFF00 <= o < 0xFFF0:
        return "h" if 0xFF61 <= o <= 0xFF9F else "k"
    if c.isalpha():
        return ("E" if c.isupper() else "e") if o < 0x250 or 0x1E00 <= o < 0x1F00 else "l"
    return "s"


_LATIN, _CYR, _LETTER = set("aAeE"), set("cC"), set("aAeEcCgl")


def _run_of_small(k: list[str], i: int, step: int) -> int:
    """How many small Latin letters follow one another from i on."""
    n = 0
    while 0 <= i < len(k) and k[i] in "ae":
        n += 1
        i += step
    return n


def _glued(word: str, k: list[str], i: int) -> bool:
    """Whether a Greek letter or ⁿ begins or ends a word of small Latin letters, and is no variable, index or unit."""
    c, left, right = word[i], _run_of_small(k, i - 1, -1), _run_of_small(k, i + 1, 1)
    if left:
        return left >= 2 and not right and not word[i - left : i].endswith(_FUNCTIONS)
    if i and k[i - 1] in _LETTER:
        return False
    return right >= (1 if c == "ⁿ" else 3 if c in "ΘΓΩ" else 99 if c in "ΔΣΠµμ" else 5)


def cost(word: str) -> float:
    """:func:`_cost`, remembered for words that aren't very long."""
    return _known_cost(word) if len(word) <= REMEMBERED else _cost(word)


def _cost(word: str) -> float:
    """How implausible a word's characters and their neighbours are; 0 for ordinary text of any language."""
    k = [kind(c) for c in word]
    total = 0.0
    n = len(k)
    for i, (c, x) in enumerate(zip(word, k)):
        if x in "aAdp":
            continue
        o = ord(c)
        before, after = k[i - 1] if i else " ", k[i + 1] if i + 1 < n else " "
        inside = before in _LETTER and after in _LETTER
        if x == "x":
            total += 5.0 if o == 0xFFFD else 4.0
        elif not any(a <= o <= z for a, z in _COMMON):
            total += 1.5
        elif 0x300 <= o < 0x370 and before not in _LETTER:
            total += 1.5
        if x == "E":
            if before in "ae":
                total += 2.0
            if c in "ÃÂÐÑâ" and after not in _LETTER and after not in " pd":
                total += 1.5
            if after == "q" and word[i + 1] not in "’”»… ":
                total += 0.8
        if x == "E" and before == "E" and after in "ae":
            total += 0.5  # two capitals with accents begin no word of small letters
        if c in "ĂĹ" and i + 1 < n and word[i + 1] in "ŚŤŽŹšśťžźŁĄŞŻłąşĽľż":
            total += 0.5  # letters of no common language
        if x in "eE" and before in "eE":
            pair = word[i - 1 : i + 1]
            total += 0.0 if pair.lower() in ("çã", "çõ") else 0.7 if o < 0x100 and ord(pair[0]) < 0x100 else 0.2
        if x == "e" and after in "sztxb":
            total += 0.8
        if c == "ƒ":
            total += 1.0
        if x == "g":
            total += 1.5 * sum(y in _LATIN or y in _CYR for y in (before, after)) * (1.0 if inside else 0.6)
        if (x == "g" or c in "Ωⁿ") and _glued(word, k, i):
            total += 1.1
        if c == "ß" and (before in _LATIN and word[i - 1] not in _VOWELS or before not in _LETTER and after in "ae"):
            total += 2.0  # it follows vowels only
        if x in "cC":
            total += 2.0 * sum(y in _LATIN for y in (before, after))
            if x == "C" and before == "c":
                total += 2.0
            if not (0x410 <= o <= 0x44F or c in "ЁёІіЇїЄєҐґ"):
                total += 1.0 if any(y in "cC" for y in (before, after)) or n > 2 else 2.0
            if after in "stzb" or (after == "q" and word[i + 1] in "‚„‹›…“‘"):
                total += 1.0
        if x == "b":
            glued = 2.0 if 0x2550 <= o <= 0x256C or o >= 0x2580 or c in "┴┬┼" else 1.25  # double lines, crossings and blocks are rarer than tree lines
            total += glued * sum(y in _LETTER or y in "ks" for y in (before, after))
        if c == "¬" and n <= 2:
            total += 0.5
        elif x == "z":
            total += 2.0 * sum(y in _LETTER for y in (before, after)) if before in _LETTER or after in _LETTER else 1.0
        if x == "s":
            total += 1.2 * sum(y in _LETTER for y in (before, after)) + 0.5 * (after in "stzqm")
            if c in "≤≥≈∞√∩±÷" and ((before in "ae" and k[max(0, i - 2)] in "ae" and i > 1 and after in " p") or (c == "∞" and after in _LETTER)):
                total += 0.8  # an operator without an operand
        if x == "t":
            dot = c == "·" and word[i - 1 : i + 2].lower() != "l·l"
            total += (2.0 if dot else 1.5 if c != "·" else 0.0) * inside + (1.0 if before in "z" or after in "z" else 0.0) + (0.6 if before in "E" else 0.0)
        if x == "m":
            total += 1.0 if c == "Ω" and before not in _LETTER and _glued(word, k, i) else 2.0 if inside else 1.0 if before in _LETTER or before in "sz" else 0.0
        if c in "\u2013\u2014\u2026" and inside:
            total += 0.3
        if x == "q" and c not in "’ ​­–—…":
            total += (1.0 if inside else 0.0) + (0.5 if before == "q" and c in "‚„" else 0.0) + (0.7 if c in "‚„" and before in _LETTER else 0.0)
        if x == "k":
            total += 1.0 * sum(y in "aeE" for y in (before, after)) if inside else 0.0
        if x == "h":
            total += 0.7
        if x == "l":
            total += 0.9 if inside else 0.3
        # Of equally sound texts the one of more usual letters and signs is nearer.
        total += _RARE.get(c, 0.04 if x in "eE" else 0.0)
        if c == "ã" and word[i + 1 : i + 2] not in ("o", "e", "s", ""):
            total += 0.1
        if c in "‘“«‹„‚" and before in _LETTER and after not in _LETTER:
            total += 0.5
        if x == "t" and after in _LETTER and c not in "°·":
            total += 0.6
        if c == "™" and before == "a":
            total += 0.3
    if n >= 2 and all(x in "eE" for x in k) and all(ord(c) < 0x100 for c in word):
        total += 1.0
    wide = [x for x in k if x in "eEcC"]
    if len(wide) >= 2 and all(x in "EC" for x in wide) and not any(x in "aA" for x in k):
        total += 0.3
    return total


_known_cost = lru_cache(maxsize=200_000)(_cost)


class _Page(dict):
    """Characters of a one-byte code page to their bytes; what the page doesn't have is 0.

    Bytes the page doesn't define stand for the control characters of the same number.
    """

    def __init__(self, page: str) -> None:
        super().__init__({i: i for i in range(128)})
        for b in range(0x80, 0x100):
            self[ord(bytes([b]).decode(page, "ignore") or chr(b))] = b

    def __missing__(self, _: int) -> int:
        return 0


_PAGES = {p: _Page(p) for p in {*MISREAD_UTF8, *READ_AS} - _MULTIBYTE}


def _encode(text: str, page: str) -> bytes | None:
    """Bytes of a text in a code page, 0 for what a one-byte page doesn't have; None if another page hasn't all of it."""
    if page not in _MULTIBYTE:
        return text.translate(_PAGES[page]).encode("latin_1")
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, page: str) -> str | None:
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        return None


def _as_utf8(word: str, page: str) -> str | None:
    """The word with its runs of other than ASCII characters read as UTF-8, those that are; None if none is."""
    if page in _MULTIBYTE:
        data = _encode(word, page)
        return _decode(data, "utf-8") if data else None
    changed = False

    def read(m) -> str:
        """The run if it is UTF-8 read by the page, or else those parts of it that are."""
        nonlocal changed
        data = _encode(m[0], page)
        if not _SEQUENCES.search(data):
            return m[0]
        changed = True
        out = _decode(data, "utf-8") if 0 not in data else None
        if out is not None:
            return out
        parts, end = [], 0
        for x in _SEQUENCES.finditer(data):
            parts += [m[0][end : x.start()], x[0].decode()]
            end = x.end()
        return "".join([*parts, m[0][end:]])

    out = _RUN.sub(read, word)
    return out if changed else None


def _repage(word: str, read_as: str, written_as: str) -> str | None:
    if written_as in _MULTIBYTE:
        data = _encode(word, read_as)
        return _decode(data, written_as) if data and 0 not in data else None
    out = []
    for c in word:
        if ord(c) < 128:
            out.append(c)
            continue
        data = _encode(c, read_as)
        out.append(_decode(data, written_as) or c if data != b"\0" else c)
    return "".join(out)


def _likely(change: str) -> float:
    """Cost of a step: what western and cyrillic pages are usually mistaken for is cheaper than the rest."""
    usual = change.startswith(("utf-8", "cp1252 read", "unescape", "lost", "cp1251 read as cp1252", "cp1251 read as koi8_r", "koi8_r read as cp1252", "koi8_r read as cp1251", "euc_jp read as cp1252", "cp932 read as cp1252"))
    return STEP_COST if usual else 2 * STEP_COST


def _neighbours(word: str, pages: bool):
    """(change, new state) of a state."""
    if "&" in word and _REFERENCE.search(word):
        yield "unescape", html.unescape(word)
    if word.isascii():
        return
    for page in MISREAD_UTF8:
        new = _as_utf8(word, page)
        if new is not None:
            yield f"utf-8 read as {page}", new
    if word[-1] in "Ãà" and len(word) > 1 and kind(word[-2]) in "ae":
        yield "lost space", word + " "
    if pages:
        for r in READ_AS:
            for w in WRITTEN_AS:
                if r != w:
                    new = _repage(word, r, w)
                    if new is not None and new != word:
                        yield f"{w} read as {r}", new


def _unescape(word: str) -> str:
    """The word with its character references resolved, also those that were escaped again."""
    while "&" in word and (new := html.unescape(word)) != word:
        word = new
    return word


def search(word: str) -> tuple[str, float, str, bool]:
    """The cheapest reachable text: (text, gain over the word, changes, whether the evidence is valid UTF-8).

    All states are visited that can be cheaper than the best one: a state costs what its characters do and a little for each
    step, so what has as many steps as the best state costs in all can't be, nor can anything reached from it. There is no other
    limit; the steps can't be more than the word's cost allows.
    Changes between pages are tried only if no state that is valid UTF-8 is better, and only on words of at least PAGE_COST, as no
    gain is more than the word's own cost.
    """
    return _known_search(word) if len(word) <= REMEMBERED else _search(word)


def _search(word: str) -> tuple[str, float, str, bool]:
    start = _unescape(word)
    base = cost(start)
    for pages in (False, True):
        if pages and base < PAGE_COST:
            break
        seen, best = {start}, (base, start, ())
        heap: list = [(base, 0, start, (), 0.0)]
        tie = 0
        while heap:
            c, _, at, ways, steps = heapq.heappop(heap)
            if c < best[0] - 1e-9:
                best = (c, at, ways)
            if steps + STEP_COST >= best[0] - 1e-9:
                continue  # nothing reached from here is cheaper than the best
            for way, new in _neighbours(at, pages and not ways):
                more = steps + _likely(way)
                if new not in seen and more < best[0]:
                    seen.add(new)
                    tie += 1
                    heapq.heappush(heap, (cost(new) + more, tie, new, (*ways, way), more))
        gain = base - cost(best[1])
        if best[2] and gain > (UTF8_GAIN if not pages else 0):
            utf8 = any(w.startswith("utf-8") for w in best[2])
            return best[1], gain, " + ".join(best[2]), utf8
    return word, 0.0, "", False


_known_search = lru_cache(maxsize=100_000)(_search)


def _step(word: str, change: str) -> str | None:
    """A state after one change by its name; None if it doesn't apply."""
    if change == "unescape":
        return _unescape(word)
    if change == "lost space":
        return word + "\xa0" if word[-1:] in "Ãà" else word
    written, page = change.split(" read as ")
    return _as_utf8(word, page) if written == "utf-8" else _repage(word, page, written)


def _apply(word: str, ways: str) -> str | None:
    for change in ways.split(" + "):
        new = _step(word, change)
        if new is None:
            return None
        word = new
    return word


def _rivalled(picks: list[tuple[str, str]], how: str, others) -> bool:
    """Whether another change explains the words (as they were, as they are now) about as well as ``how``, by another text."""
    ways = [lambda w, k=k.removeprefix("unescape + "): _apply(w, k) for k in others if k != how]
    if "utf-8" not in how and " read as " in how:
        page = how.split(" + ")[0].removeprefix("unescape + ").split(" read as ")[1]
        ways += [lambda w, k=k: _repage(w, page, k) for k in (*WRITTEN_AS, *RIVALS) if k != page]
    for way in ways:
        worse, differs = 0.0, False
        for plain, pick in picks:
            alt = way(plain)
            kinds = set(map(kind, alt or ""))
            # A word of two scripts is none, and neither is one that the change doesn't explain.
            worse += 2.0 if alt is None or ("l" in kinds and kinds & _LATIN) else cost(alt) - cost(pick)
            differs |= alt != pick
        if differs and worse <= CERTAIN:
            return True
    return False


def examine(text: str | None) -> tuple[bool, str | None, bool, str, bool]:
    """(garbled, restored text, whether no character is lost, the changes, whether the restoration is certain) of a text.

    It isn't certain if characters are lost, or if another change explains the words by another text about as well (see CERTAIN and RIVALS).
    A word may be explained by several changes equally well. So the change that explains most of a text's words is
    preferred for all of them where it is about as good.
    """
    if not text or (text.isascii() and "&" not in text):
        return False, text, True, "", True
    found, lost = [], False
    by_way: dict[str, float] = {}
    utf8_hit, page_best = False, 0.0
    for m in _SUSPECT.finditer(text):
        at, w = m.start(), m[0]
        plain = _unescape(w)
        if plain.isascii():
            continue
        lost |= "\ufffd" in plain
        new, gain, ways, utf8 = search(w)
        found.append((at, w, plain, new, gain, ways, utf8))
        if ways:
            by_way[ways] = by_way.get(ways, 0.0) + gain
            utf8_hit |= utf8
            page_best = max(page_best, 0.0 if utf8 else gain)
    page_all = max((v for k, v in by_way.items() if "utf-8" not in k), default=0.0)
    page_hit = page_best >= PAGE_GAIN or page_all >= PAGE_GAIN_ALL
    by_way = {k: v for k, v in by_way.items() if (utf8_hit if "utf-8" in k else page_hit)}
    if not by_way:
        return lost, text, not lost, "lost" if lost else "", not lost
    if utf8_hit:
        by_way |= {k: 0.0 for p in MISREAD_UTF8 if (k := f"utf-8 read as {p}") not in by_way}
    if page_hit:
        by_way |= {k: 0.0 for p in ("cp437", "cp850", "mac_roman", "cp1251") if (k := f"cp1252 read as {p}") not in by_way}
    gains = {k: [cost(p) - cost(a) for _, _, p, *_ in found if (a := _apply(p, k.removeprefix("unescape + "))) not in (None, p)] for k in by_way}
    top = max(sorted(gains), key=lambda k: (round(sum(max(0.0, x) for x in gains[k]), 3), sum(x > -0.5 for x in gains[k])))
    strong = sum(x > 0.5 for x in gains[top]) >= max(3, len(found) / 2)
    out, end, used = [], 0, {}
    for at, w, plain, new, gain, ways, utf8 in found:
        pick, how = (new, ways) if ways in by_way else (plain, "")
        if how != top:
            alt = _apply(plain, top.removeprefix("unescape + "))
            slack = 0.45 if how else 0.3 if "utf-8" in top else 0.06 if strong else 0.0
            if alt is not None and alt != plain and cost(alt) <= cost(pick) + slack - (0.0 if how else 0.01):
                pick, how = alt, top
        if how and pick != w:
            out += [text[end:at], pick]
            end = at + len(w)
            used.setdefault(how, []).append((plain, pick))
    if not used:
        return lost, text, not lost, "lost" if lost else "", not lost
    restored = "".join([*out, text[end:]])
    certain = not lost and not any(_rivalled(picks, how, gains) for how, picks in used.items())
    return True, restored, not lost, ", ".join(sorted({*used} | ({"lost"} if lost else set()))), certain


def find_garbled(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, complete, certain, changes) of the documents with garbled text in any part.

    ``restored`` is the whole text with the garbled words replaced by what the search found; ``complete`` is false if characters are lost
    for good, and ``certain`` also if another text explains the same bytes about as well. Each text is looked at where it is read; only the documents found are shuffled, as a repeated id counts once (the least
    restored text). Null ids and texts give no rows, empty texts aren't garbled, texts of any length are handled whole;
    other columns aren't read.
    """
    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Plain ASCII without references can't be garbled: it never leaves the JVM.
    src = src.where(F.col("text").rlike(r"[^\x00-\x7F]|&#?[0-9A-Za-z]"))

    def run(batches):
        for b in batches:
            ids, rows = b.column(0), []
            for i, t in enumerate(b.column(1).to_pylist()):
                hit, restored, complete, changes, certain = examine(t)
                if hit:
                    rows.append((ids[i].as_py(), restored, complete, certain, changes))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()))], names=["doc_id", "restored", "complete", "certain", "changes"])

    found = src.mapInArrow(run, "doc_id long, restored string, complete boolean, certain boolean, changes string")
    one = found.groupBy("doc_id").agg(F.min(F.struct("restored", "complete", "certain", "changes")).alias("x"))
    return one.select("doc_id", "x.restored", "x.complete", "x.certain", "x.changes")
