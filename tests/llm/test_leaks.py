import random

import pytest

from quillgraph.llm import leaks


def edit_distance_within(passage, doc, most):
    """Least edits between the passage and any part of the document, by the plain table."""
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) <= most


def plain(item, doc):
    """The definition: some passage of at least 20 words with at most one edit in ten; a shorter item in full."""
    if len(item) < 20:
        return bool(item) and edit_distance_within(item, doc, len(item) // 10)
    return any(edit_distance_within(item[a : a + n], doc, n // 10) for n in range(20, min(len(item), 41) + 1) for a in range(len(item) - n + 1))


def change(words, rate, r):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 3:
            continue
        if x < 2 * rate / 3:
            out.append(f"new{r.randint(0, 99)}")
            continue
        out.append(w)
        if x < rate:
            out.append(f"add{r.randint(0, 99)}")
    return out


def test_every_single_edit_of_items_of_all_lengths():
    for n in range(1, 61):
        item = [f"v{k}" for k in range(n)]
        docs = []
        for at in range(n):
            for new in ([], ["other"], [item[at], "more"]):
                docs.append(["before", "it", *item[:at], *new, *item[at + 1 :], "and", "after"])
        got = {d for d, _ in leaks.Index([(7, " ".join(item))]).find([" ".join(d) for d in docs])}
        assert got == {d for d, words in enumerate(docs) if n >= 10 or plain(item, words)}


@pytest.mark.parametrize("seed", range(6))
def test_against_the_definition(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([12, 19, 20, 35, 60])))) for k in range(8)]
    docs = []
    for _ in range(40):
        w = items[r.randrange(8)][1].split()
        a = r.randint(0, max(0, len(w) - 15))
        part = change(w[a : a + r.randint(14, 45)], r.choice([0, 0.05, 0.12, 0.2]), r)
        docs.append(" ".join([*(r.choice(vocabulary) for _ in range(r.randint(0, 20))), *part, *(r.choice(vocabulary) for _ in range(r.randint(0, 20)))]))
    got = set(leaks.Index(items).find(docs))
    want = {(d, k) for d, t in enumerate(docs) for k, x in items if plain(x.split(), t.split())}
    assert got == want


def test_markup_of_any_length_is_removed():
    long = "w " * 3000
    for mark in (f'<a title="{long}" href=x>', f"<img\n alt='{long}'\n hidden/>", f"<!-- {long}\n-->"):
        assert leaks.words(f"one {mark} two") == ["one", "two"]
    assert leaks.words(f"[one](http://x/{'w-' * 3000}) two") == ["one", "two"]
    assert len(leaks.words(f"i <b and {long} > c")) == 3004  # no tag
    assert leaks.words("<!-- one") == ["one"]
    for part in ("<a b='", "<!-- ", "](", '<a b="c" '):
        leaks.words(part * 100_000)  # takes long unless it is linear


@pytest.mark.parametrize("n", range(10, 20))
def test_short_items_with_one_edit_anywhere(n):
    w = [f"w{i}" for i in range(n)]
    docs = [[*w[:i], *new, *w[i + cut :]] for i in range(n) for new, cut in (([], 1), (["x"], 1), (["x"], 0))]
    got = leaks.Index([(7, " ".join(w))]).find([" ".join(["a", *d, "b"]) for d in docs])
    assert sorted(got) == [(k, 7) for k in range(len(docs))]


ITEM = "Explain briefly why uneven mixer copies Delber in case 115. Table 128 lists Haxvel as cracked, hedge as heavy. Pupils patched 213 bucket cards, Murber profiled 237."


@pytest.mark.parametrize(
    "text",
    [
        ITEM.upper(),
        "> " + ITEM.replace(". ", ".\n> "),
        "<p>" + ITEM.replace("mixer", "<b>mixer</b>").replace("lists", "&#108;ists") + "</p>",
        "before " + ITEM.replace(" ", " - ").replace(",", "!") + " after",
        "// " + ITEM.replace(" case", "\n// case").replace("Table", "**Table**"),
        ITEM.replace("mixer", "toaster").replace("hedge ", ""),
        ITEM.replace(" ", "\xa0").replace("e", "e​"),
    ],
)
def test_form_does_not_matter(text):
    assert leaks.Index([(1, ITEM)]).find([text]) == [(0, 1)]


def test_too_short_or_too_different_passages_are_no_leaks():
    w = leaks.words(ITEM)
    ix = leaks.Index([(1, ITEM)])
    assert ix.find([" ".join(w[:17]), " ".join(x if i % 5 else "zz" for i, x in enumerate(w)), "", None]) == []


def test_nulls_repeats_blocks_and_clashes(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 6), (2, None, 1), (None, ITEM, 1), (3, "", 1), (4, "x " * 20000 + ITEM, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (None, ITEM), (9, ""), (10, "one two three"), (11, ITEM[20:])], "item_id long, text string")
    for seeds in (10**6, 1):
        got = {tuple(r) for r in leaks.find_leaks(docs, items, block_seeds=seeds).collect()}
        assert got == {(1, 7), (4, 7), (1, 11), (4, 11)}
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0
