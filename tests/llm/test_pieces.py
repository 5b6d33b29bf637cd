import random

import pytest

from quillgraph.llm import pieces

ENTRY = "entry_id long, file_id long, file_size long, file_start long, splittable boolean"
LINE = "file_id long, line_no int, byte_start long, line string"


def plain(entries, lines, limit, overlap):
    """The rule, one entry and one piece at a time."""
    out = set()
    for entry, file, size, start, splittable in set(entries):
        if not splittable:
            continue
        own = sorted({(b, t) for f, _, b, t in lines if f == file})
        own = [(b, t.encode()) for b, t in own if (start < b and (size is None or b <= start + size)) or (b == 0 and start == 0)]
        if sum(len(t) + 1 for _, t in own) <= limit:
            continue
        begins, ends = [b for b, _ in own], [b + len(t) + 1 for b, t in own]
        data, base = b"".join(t + b"\n" for _, t in own), begins[0]

        def back(at):
            while data[at - base] & 0xC0 == 0x80:
                at -= 1
            return at

        s, before, no = begins[0], begins[0], 1
        while True:
            if ends[-1] <= s + limit:
                out.add((entry, no, s, ends[-1]))
                break
            fit = [e for e in ends if before < e <= s + limit and e > s]
            e = max(fit) if fit else back(s + limit)
            out.add((entry, no, s, e))
            s = min([b for b in [*begins, e] if b > s and e - overlap <= b <= e]) if fit else back(e - overlap)
            before, no = e, no + 1
    return out


def make(seed, files=3, letters="abé漢"):
    r = random.Random(seed)
    entries, lines, k = [], [], 0
    for f in range(files):
        at = 0
        for i in range(r.randint(1, 260)):
            n = r.choice([0, 1, 5, 20, 40, r.randint(60, 140), r.choice([3, 900])]) if r.random() < 0.9 else r.randint(0, 30)
            text = "".join(r.choice(letters) for _ in range(n))
            lines.append((f, i, at, text))
            at += len(text.encode()) + 1
        cuts = sorted({0, *(r.randint(0, at) for _ in range(r.randint(0, 2)))})
        for a, z in zip(cuts, [*cuts[1:], None]):
            entries.append((k, f, None if z is None else z - a, a, r.random() < 0.9))
            k += 1
    return entries + entries[:1], lines + lines[:3]


def bisected(entries, lines, limit, overlap):
    """Recursive bisection of whole entries at once."""
    out = set()
    for entry, file, size, start, splittable in set(entries):
        own = sorted({(b, t) for f, _, b, t in lines if f == file})
        own = [(b, b + len(t.encode()) + 1, t.encode()) for b, t in own if (start < b and (size is None or b <= start + size)) or (b == 0 and start == 0)]
        if not splittable or sum(e - b for b, e, _ in own) <= limit:
            continue
        strength = [1 + (i > 0 and own[i - 1][2] == b"") + (own[i][2] == b"") for i in range(len(own))]

        def cut(lo, hi):
            a, z = own[lo][0], own[hi - 1][1]
            if z - a <= limit - overlap or hi - lo < 2:
                return [(lo, hi)]
            mid, third = (a + z) // 2, (z - a) // 6
            near = [i for i in range(lo + 1, hi) if abs(own[i][0] - mid) <= third]
            after = [i for i in range(lo + 1, hi) if own[i][0] >= mid]
            at = min(near, key=lambda i: (-strength[i], abs(own[i][0] - mid), i)) if near else after[0] if after else hi - 1
            return cut(lo, at) + cut(at, hi)

        def back(lo, at):
            i = max(k for k in range(len(own)) if own[k][0] <= at)
            b, _, t = own[i]
            while b < at < b + len(t) and t[at - b] & 0xC0 == 0x80:
                at -= 1
            return at

        for lo, hi in cut(0, len(own)):
            s, z = min((b for b, _, _ in own if own[lo][0] - overlap <= b <= own[lo][0])), own[hi - 1][1]
            while z - s > limit:
                e = back(lo, s + limit)
                out.add((entry, s, e))
                s = max(back(lo, e - overlap), s + 1)
            out.add((entry, s, z))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bisection_does_not_depend_on_blocks(spark, seed):
    entries, lines = make(seed + 20)
    want = bisected(entries, lines, 120, 40)
    for block in (400, 1500, 1 << 20):
        got = pieces.bisect_entries(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(lines, LINE), limit=120, overlap=40, block=block)
        assert {tuple(r) for r in got.collect()} == want


def test_stretches_of_blocks_are_composed(spark, monkeypatch):
    entries, lines = make(1)
    compose = pieces.compose
    monkeypatch.setattr(pieces, "compose", lambda ways: compose(ways, 3))
    got = pieces.split_entries(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(lines, LINE), limit=120, overlap=40, block=400)
    assert {tuple(r) for r in got.collect()} == plain(entries, lines, 120, 40)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_follow_the_rule_across_blocks(spark, seed):
    entries, lines = make(seed)
    got = pieces.split_entries(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(lines, LINE), limit=120, overlap=40, block=400)
    rows = [tuple(r) for r in got.select("entry_id", "piece_no", "piece_start", "piece_end").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == plain(entries, lines, 120, 40)


def test_bisection_covers_all_and_stays_below_the_limit(spark):
    entries, lines = make(3)
    got = pieces.bisect_entries(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(lines, LINE), limit=120, overlap=40, block=400).collect()
    spans = {e[0]: (p[2], max(x[3] for x in plain(entries, lines, 120, 40) if x[0] == e[0])) for e in entries for p in plain(entries, lines, 120, 40) if p[0] == e[0] and p[1] == 1}
    assert {r.entry_id for r in got} == set(spans)
    for e, (a, z) in spans.items():
        own = sorted((r.piece_start, r.piece_end) for r in got if r.entry_id == e)
        assert own[0][0] == a and max(x for _, x in own) == z
        assert all(0 < y - x <= 120 for x, y in own)
        assert all(n[0] <= p[1] for p, n in zip(own, own[1:]))


def test_empty_null_and_clashing_columns(spark):
    none = pieces.split_entries(spark.createDataFrame([], ENTRY), spark.createDataFrame([], LINE))
    assert none.count() == 0
    entries = [(1, 1, None, 0, True), (None, 1, 5, 0, True), (2, None, None, 0, True), (3, 2, None, None, True), (4, 2, None, 0, None)]
    lines = [(1, 0, 0, "x" * 9000), (1, 1, None, "y"), (1, 2, 9001, None), (None, 0, 0, "z")]
    df = spark.createDataFrame([(*e, 7) for e in entries], ENTRY + ", block long")
    rows = sorted(tuple(r) for r in pieces.split_entries(df, spark.createDataFrame(lines, LINE)).collect())
    assert rows == [(1, 1, 0, 4096), (1, 2, 3840, 7936), (1, 3, 7680, 9001)]
