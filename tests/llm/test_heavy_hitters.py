from collections import Counter

from quillgraph.llm import heavy_hitters as hh


def test_all_heavy_terms_with_exact_counts(spark):
    rows = [f"rare{i}" for i in range(30_000)] + ["hot"] * 20_000 + [f"w{i % 100}" for i in range(20_000)] + [""] * 500 + [None] * 9
    got = hh.frequent_terms(spark.createDataFrame([(x,) for x in rows], "term string"), "term", 400).collect()
    total = sum(x is not None for x in rows)
    want = {t: n for t, n in Counter(x for x in rows if x is not None).items() if n * 400 >= total}
    assert {r.term: r.n_rows for r in got} == want
    assert all(r.total_rows == total and abs(r.estimate - r.n_rows) <= 6 * r.error + 1 for r in got)


def test_sketches_of_parts_add_up(spark):
    df = spark.range(5000).selectExpr("cast(id % 50 as string) as term", "id")
    whole = {r.cell: r.value for r in hh.sketch(df, df.term).collect()}
    parts = Counter()
    for half in (df.where("id < 1000"), df.where("id >= 1000")):
        parts.update({r.cell: r.value for r in hh.sketch(half, half.term).collect()})
    assert {k: v for k, v in parts.items() if v} == {k: v for k, v in whole.items() if v}


def test_empty_and_ties(spark):
    assert hh.frequent_terms(spark.createDataFrame([], "term string"), "term", 250).count() == 0
    df = spark.createDataFrame([(x, 1) for x in "aabbcc"], "term string, estimate int")
    assert [r.term for r in hh.top_terms(df, "term", 2, 3).collect()] == ["a", "b"]


def test_none_is_missed_however_many_are_sought(spark):
    rows = [f"w{i % 3000}" for i in range(60_000)] + [f"rare{i}" for i in range(60_000)]
    df = spark.createDataFrame([(x,) for x in rows], "term string")
    for share in (250, 2000, 8000, 10_000):
        want = {t: n for t, n in Counter(rows).items() if n * share >= len(rows)}
        assert {r.term: r.n_rows for r in hh.frequent_terms(df, "term", share).collect()} == want
    assert len(want) == 3000


def test_a_wider_sketch_is_made_where_the_first_is_too_coarse(spark):
    df = spark.createDataFrame([(f"w{i % 4000}",) for i in range(40_000)] + [("hot",)] * 400 + [("warm",)] * 120, "term string")
    prefixes, guess, total, _ = hh._descend(df, "term", 400, 1 << 8, 1 << 16)
    assert prefixes is not None and total == 40_520 and sum(guess >= 0.5 * total / 400) >= 2
    assert hh._descend(df, "term", 400, 1 << 8, 1 << 9)[0] is None
