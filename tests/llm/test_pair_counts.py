import random
from itertools import combinations

import pytest

from quillgraph.llm import pair_counts as pc

SCHEMA = "id long, items array<long>, w long, n_ab int"


def make(seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        items = None if r.random() < 0.05 else [r.choice([7, 7, 2**55, r.randint(0, 30), None]) for _ in range(r.randint(0, 8))]
        rows.append((r.choice([i, i, None]), items, r.choice([None, -1, 0, 1, 2, 9]), 1))
    return rows + rows[:20]


def plain(rows):
    once, free = {}, []
    for b, items, w, _ in rows:
        (free.append((items, w)) if b is None else once.__setitem__(b, (items, w)))
    data = [(set(x or []) - {None}, w) for x, w in [*once.values(), *free] if w and w > 0]
    n = {}
    for s, w in data:
        for x in s:
            n[x] = n.get(x, 0) + w
    pairs = {}
    for s, w in data:
        for a, b in combinations(sorted(s), 2):
            k = pairs.setdefault((a, b), [0, 0])
            k[0] += w
            k[1] += 1
    return sum(w for _, w in data), {(a, b): (n[a], n[b], w, k) for (a, b), (w, k) in pairs.items()}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_pairs_against_plain_counts(spark, broadcast, monkeypatch):
    monkeypatch.setattr(pc, "RUN_PAIRS", 50)
    rows = make(2)
    total, want = plain(rows)
    df, n = pc.cooccurrence(spark.createDataFrame(rows, SCHEMA), "id", "items", "w", broadcast_items=broadcast)
    got = df.collect()
    assert n == total
    assert {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n_baskets) for r in got} == want
    for r in got:
        a, b, ab = r.n_a, r.n_b, r.n_ab
        assert r.lift == pytest.approx(ab * total / (a * b))
        assert r.odds_ratio == pytest.approx((ab + 0.5) * (total - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5)))


def test_leaving_out_rare_items_keeps_the_others(spark):
    rows = make(3)
    total, want = plain(rows)
    df, _ = pc.cooccurrence(spark.createDataFrame(rows, SCHEMA), "id", "items", "w", min_item_weight=80)
    assert {(r.item_a, r.item_b): r.n_ab for r in df.collect()} == {k: v[2] for k, v in want.items() if min(v[0], v[1]) >= 80}


def test_one_long_basket_and_nothing(spark):
    df, n = pc.cooccurrence(spark.createDataFrame([(1, list(range(400)), 2, 0)], SCHEMA), "id", "items", "w")
    assert df.count() == 400 * 399 // 2 and n == 2
    df, n = pc.cooccurrence(spark.createDataFrame([], SCHEMA), "id", "items", "w")
    assert df.count() == 0 and n == 0
