"""Evaluation texts leaking into training text: spaced seeds, joined by hash, verified by counting edits around hits."""

from __future__ import annotations

import functools
import html
import itertools
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import materialize

#: Which words of a window count (1) and which are ignored (0). The first ignores none: a passage of 20 words with two
#: edits, or of 30 with three, always has six words in a row unchanged, also where words were added
#: or dropped, and so has a whole item of 12 to 19 words with one edit; the others lie across changed words.
MASKS = ("111111", "11101011", "110011011")
#: Of a whole item of 10 or 11 words with one edit only five words in a row are sure to be unchanged.
SHORT_MASK, SHORT_WORDS = "11111", (10, 11)
#: Words of a passage, and one edit is allowed for so many of them.
PASSAGE = 20
PER_EDIT = 10
#: Seeds of the evaluation items that are sent to all tasks at once; more items are taken in blocks.
BLOCK_SEEDS = 2_000_000

# A tag of one line and 200 characters is taken as it is; a longer one must have the syntax of attributes, as prose and code
# hold < and > too. No part but a link's target goes beyond the next <, so the time is linear.
_TAG = regex.compile(
    r"""</?[a-zA-Z!][^<>\n]{0,200}>|</?[a-zA-Z][\w:-]*+(?:\s++(?:[\w:@.-]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>=`]++)"""
    r"""|(?:checked|disabled|selected|hidden|async|defer|required|readonly|multiple|controls|autoplay|loop|muted|nowrap)(?![\w=-])))*+\s*+/?>"""
)
_LINK = regex.compile(r"\]\([^()\s]*+\)")
_PREFIX = regex.compile(r"^[ \t]*(?:(?:>|--|//|#+|\*|-|\+|•|;|%|\|)[ \t]*)+", regex.M)
_INVISIBLE = regex.compile(r"[­​-‏⁠﻿]")
_APOSTROPHE = regex.compile(r"(?<=\p{L})['’](?=\p{L})")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\W_\p{Han}\p{Hiragana}\p{Katakana}]+")


def _untagged(text: str) -> str:
    """The text without comments and tags; a comment that isn't closed is text."""
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (z := text.find("-->", a + 4)) >= 0:
        out += [text[at:a], " "]
        at = z + 3
    return _TAG.sub(" ", "".join([*out, text[at:]]))


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, line prefixes and invisible characters."""
    if not text:
        return []
    t = _untagged(text) if "<" in text else text
    if "&" in t:
        t = html.unescape(t)
        t = _untagged(t) if "<" in t else t
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    t = _LINK.sub("]", t) if "](" in t else t
    return _WORD.findall(_APOSTROPHE.sub("", _PREFIX.sub("", t)).casefold())


def _reach(a: list[int], b: list[int], i: int, j: int, step: int, most: int) -> list[int]:
    """For 0 to ``most`` edits the most words of ``a`` from i on (in the direction ``step``) that align with ``b`` from j on."""
    n, m = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    far = {0: 0}

    def slide(x: int, k: int) -> int:
        y = x + k
        while x < n and y < m and a[i + step * x] == b[j + step * y] and a[i + step * x] > 0:
            x += 1
            y += 1
        return x

    far = {0: slide(0, 0)}
    out = [far[0]]
    for _ in range(most):
        nxt: dict[int, int] = {}
        for k, x in far.items():
            for k2, x2 in ((k, x + 1), (k - 1, x + 1), (k + 1, x)):
                y2 = x2 + k2
                if x2 <= n and 0 <= y2 <= m and nxt.get(k2, -1) < x2:
                    nxt[k2] = x2
        far = {k: slide(x, k) for k, x in nxt.items()}
        out.append(max([out[-1], *far.values()]))
    return out


def is_leak(item: list[int], doc: list[int], i: int, j: int) -> bool:
    """Whether a passage of the item around (i, j) is in the document with at most one edit in PER_EDIT words.

    A longer passage with its share of edits always holds one of PASSAGE words with PASSAGE // PER_EDIT edits, or of
    PER_EDIT more words with one edit more, so only these need be looked for. An item shorter than a passage must be held in full.
    """
    whole = len(item)
    most = (PASSAGE + PER_EDIT) // PER_EDIT
    right, left = _reach(item, doc, i, j, 1, most), _reach(item, doc, i - 1, j - 1, -1, most)
    for e in range(most + 1):
        n = max(left[x] + right[e - x] for x in range(e + 1))
        if whole < PASSAGE:
            if n >= whole and e * PER_EDIT <= whole:
                return True
        elif n >= max(PASSAGE, e * PER_EDIT):
            return True
    return False


def _seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows without unknown words at the mask's positions, and their hashes."""
    span = len(mask)
    if len(ids) < span:
        return np.array([], np.int64), np.array([], np.uint64)
    n = len(ids) - span + 1
    h, ok = np.full(n, len(mask) * 31 + mask.count("1"), np.uint64), np.ones(n, bool)
    for k, on in enumerate(mask):
        if on == "1":
            w = ids[k : k + n]
            h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            ok &= w > 0
    at = np.flatnonzero(ok)
    return at, h[at]


class Index:
    """Seeds of some items: sorted hashes with the item and position of each."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.short: dict[int, list[int]] = defaultdict(list)
        hashes, where = [], []
        for item_id, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            if not w:
                continue
            k = len(self.items)
            self.items.append((item_id, w))
            ids = np.array(w, np.int64)
            if len(w) < len(MASKS[0]):
                self.short[w[0]].append(k)
            for m, mask in enumerate((*MASKS, SHORT_MASK) if len(w) in SHORT_WORDS else MASKS):
                at, h = _seeds(ids, mask)
                hashes.append(h ^ np.uint64(m))
                where.append(np.stack([np.full(len(at), k), at], 1))
        self.masks = (*MASKS, SHORT_MASK) if any(len(w) in SHORT_WORDS for _, w in self.items) else MASKS
        h = np.concatenate(hashes) if hashes else np.array([], np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.where = np.concatenate(where)[order] if where else np.zeros((0, 2), np.int64)

    def find(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(number of the text, item_id) of all leaks."""
        docs = [[self.vocabulary.get(x, 0) for x in words(t)] for t in texts]
        gap = [0] * max(map(len, MASKS))
        start = np.cumsum([0, *(len(d) + len(gap) for d in docs)])
        flat = np.array([x for d in docs for x in (*d, *gap)], np.int64)
        hits: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for m, mask in enumerate(self.masks):
            at, h = _seeds(flat, mask)
            h = h ^ np.uint64(m)
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            on = np.flatnonzero(hi > lo)
            doc = np.searchsorted(start, at[on], "right") - 1
            for x, d in zip(on.tolist(), doc.tolist()):
                for k, i in self.where[lo[x] : hi[x]].tolist():
                    hits[d, k].add((i, int(at[x] - start[d])))
        out = []
        for (d, k), pairs in hits.items():
            item_id, item = self.items[k]
            done: dict[int, int] = {}
            for i, j in sorted(pairs):
                if done.get(j - i, -9) == i - 1:  # the diagonal goes on
                    done[j - i] = i
                    continue
                done[j - i] = i
                if is_leak(item, docs[d], i, j):
                    out.append((d, item_id))
                    break
        for d, doc in enumerate(docs):  # items of fewer words than a seed: held word for word
            for j, w in enumerate(doc):
                for k in self.short.get(w, ()):
                    item_id, item = self.items[k]
                    if doc[j : j + len(item)] == item:
                        out.append((d, item_id))
        return list(dict.fromkeys(out))


def _blocks(items: DataFrame, item_id: str, text: str, seeds: int):
    """Items in blocks whose seeds fit; each item once (the least text of an id)."""
    one = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).groupBy(item_id).agg(F.min(text).alias("text")).orderBy(item_id)
    held, n = [], 0
    for r in one.toLocalIterator():
        held.append((r[0], r[1]))
        n += len(MASKS) * (len(r[1]) // 2 + 1)
        if n >= seeds:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id): documents that hold an item fully or in a passage of at least 20 words, one edit in ten allowed.

    The items' seeds are an index of bounded size, against which the seeds of all documents are looked up where the
    documents are read: no shuffle of the corpus. More items than fit are taken in blocks, each a scan; only one
    block's index is alive at a time, and the hits of each are written. The rows found are the
    only ones shuffled, as repeated documents count once. Null ids and null texts give no rows, empty texts match
    nothing, texts of any length are handled whole; other columns aren't read.
    """
    spark = docs.sparkSession
    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long"

    def scan(block: list[tuple[int, str]]):
        index = spark.sparkContext.broadcast(Index(block))

        def run(batches):
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                for a in range(0, len(ids), 1000):
                    got = index.value.find(texts.slice(a, 1000).to_pylist())
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([ids[a + d] for d, _ in got], pa.int64()), pa.array([i for _, i in got], pa.int64())], names=["doc_id", "item_id"])

        return index, src.mapInArrow(run, schema)

    blocks = _blocks(items, item_id, text, block_seeds)
    first, after = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if after is None:
        return scan(first)[1].distinct()
    # One index at a time: each block's hits are written before the next block is indexed and sent.
    parts = []
    for block in itertools.chain([first, after], blocks):
        index, hits = scan(block)
        parts.append(materialize(hits.distinct()))
        index.destroy()
    return functools.reduce(DataFrame.unionByName, parts)
