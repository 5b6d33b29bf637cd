import os
import random

import pytest

from quillgraph.llm import mixing
from quillgraph.llm.queries import TOKENIZER

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
GOAL = "source string, target_share double, max_repeats int"


def test_route_fills_quotas_with_the_fewest_repeats():
    size, ways = mixing.route({("a",): 100, ("b",): 10}, {"a": (0.5, 1), "b": (0.5, 4)})
    assert size == 81  # quotas are rounded down: 40 tokens each
    used = {}
    for (_, k, s), n in ways.items():
        used[s, k] = n
    assert used == {("a", 1): 40, ("b", 1): 10, ("b", 2): 10, ("b", 3): 10, ("b", 4): 10}


def test_shared_texts_go_where_they_are_needed():
    size, ways = mixing.route({("a",): 50, ("a", "b"): 50}, {"a": (0.5, 1), "b": (0.5, 1)})
    assert size >= 100
    assert ways[("a",), 1, "a"] == 50 and ways[("a", "b"), 1, "b"] == 50


@needs_tokenizer
def test_sample_meets_shares_and_caps(spark):
    r = random.Random(4)
    words = ["pump", "valve", "sensor", "reads", "slowly", "after", "minutes"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 12))) + f" {i}", r.choice(["a"] * 8 + ["b", "c", "zzz", None])) for i in range(1200)]
    rows += rows[:30] + [(5000, None, "a"), (None, "x", "a"), (5001, "", "a"), (5002, rows[0][1], "b")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, copies int")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 3), (None, 0.1, 1)], GOAL)
    sample, report = mixing.mix(docs, goal, tokenizer=TOKENIZER)
    got = sample.collect()
    caps = {"a": 1, "b": 4, "c": 3}
    text_of, sources = {}, {}
    for i, t, s, in rows:
        if i is not None:
            text_of[i] = t
            sources.setdefault((i, s), 1)
    assert all((x.doc_id, x.source) in sources and 1 <= x.copies <= caps[x.source] for x in got)
    assert len({(x.doc_id, x.source) for x in got}) == len(got)
    shares = {x.source: (x.target_share, x.actual_share) for x in report.collect()}
    assert all(abs(t - a) < 0.02 for t, a in shares.values())
    total = sum(x.copies * x.n_tokens for x in got)
    assert abs(total - report.first().planned_tokens) < 0.03 * total
    again = mixing.mix(docs.orderBy("text"), goal, tokenizer=TOKENIZER)[0].collect()
    assert set(map(tuple, again)) == set(map(tuple, got))
    other = mixing.mix(docs, goal, tokenizer=TOKENIZER, total=800, seed=1)[0].collect()
    assert abs(sum(x.copies * x.n_tokens for x in other) - 800) < 120


@needs_tokenizer
def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 1.0, 1)], GOAL)
    sample, report = mixing.mix(docs, goal, tokenizer=TOKENIZER)
    assert sample.count() == 0 and [r.tokens for r in report.collect()] == [0]


@needs_tokenizer
def test_a_document_with_two_texts_or_sources_is_one_and_copies_of_a_text_are_all_used(spark):
    rows = [(1, "alpha one two", "a"), (1, "beta one two", "a"), (1, "beta one two", "b"), (2, "same text here", "a"), (3, "same text here", "a"), (4, "same text here", "b"), (5, "same text here", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 2)], GOAL)
    sample, report = mixing.mix(docs, goal, tokenizer=TOKENIZER)
    got = {(x.doc_id, x.source): x.copies for x in sample.collect()}
    assert got == {(1, "a"): 1, (2, "a"): 1, (3, "a"): 1, (5, "a"): 1, (4, "b"): 1} or got == {(2, "a"): 1, (3, "a"): 1, (5, "a"): 1, (4, "b"): 1}
    assert all(n <= {"a": 1, "b": 2}[s] for (_, s), n in got.items())


@needs_tokenizer
def test_caps_hold_for_every_document_of_a_hot_text(spark):
    r = random.Random(2)
    rows = [(i, "hot text of many copies" if i % 3 == 0 else f"text number {i} {r.random()}", r.choice(["a", "a", "b"])) for i in range(600)]
    rows += [(i, f"another text for {i}", "b") for i in range(0, 600, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], GOAL)
    got = mixing.mix(docs, goal, tokenizer=TOKENIZER)[0].collect()
    held = {(i, s) for i, _, s in rows}
    assert all((x.doc_id, x.source) in held and x.copies <= {"a": 2, "b": 3}[x.source] for x in got)
    assert len({x.doc_id for x in got}) == len(got)  # one source for each document
    assert len({x.doc_id for x in got if x.doc_id % 3 == 0}) > 150
