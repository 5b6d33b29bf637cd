import itertools
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import distinct_runs as dr


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_runs_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (dr.decode_run(dr.encode_run(v)) == v).all()


def make(n, seed):
    r = random.Random(seed)
    return [(r.choice(["d1", "d2", None]), r.choice(["a", "b", "c"]), r.choice(["hot"] * 5 + [f"s{r.randint(0, 400)}", None]), r.choice(["x", f"o{r.randint(0, 50)}"])) for _ in range(n)]


def plain(rows):
    out = {}
    for mask in range(4):
        for d, g, s, o in rows:
            key = (mask, d if mask & 1 else None, g if mask & 2 else None)
            a, b = out.setdefault(key, (set(), set()))
            a.add(s)
            b.add(o)
    return {k: (len(a - {None}), len(b - {None})) for k, (a, b) in out.items()}


def counts(df):
    got = df.collect()
    assert all(r.collisions_s == r.n_s * (r.n_s - 1) / 2.0**65 for r in got)
    return {(r.grouped_by, r.d, r.g): (r.n_s, r.n_o) for r in got}


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1) for x in rows], "d string, g string, s string, o string, n int")


DIMS = {"d": F.col, "g": F.col}


def run(df, **kw):
    return dr.distinct_counts(df, {k: F.col(k) for k in DIMS}, {"s": F.col("s"), "o": F.col("o")}, **kw)


def test_all_groups_against_sets(spark, monkeypatch):
    rows = make(3000, 1)
    want = plain(rows)
    assert counts(run(frame(spark, rows))) == want
    assert counts(run(frame(spark, rows), parts=F.col("g") == "a")) == want
    monkeypatch.setattr(dr, "HEAVY_ENTRIES", 2)  # so that identifiers in many groups take their own way
    monkeypatch.setattr(dr, "CHUNK_ROWS", 100)
    assert counts(run(frame(spark, rows))) == want


def test_states_of_different_bucket_sizes_merge(spark):
    rows = [make(400, i) for i in range(3)]
    dims, members = [F.col("d"), F.col("g")], {"s": F.col("s"), "o": F.col("o")}
    states = [dr.build_runs(frame(spark, x), dims, members, bits) for x, bits in zip(rows, (3, 5, 6))]
    merged = dr.merge_runs(*states)
    got = dr.count_distinct(merged, ["s", "o"]).withColumnsRenamed({"d0": "d", "d1": "g"})
    assert counts(got) == plain(list(itertools.chain(*rows)))
    assert merged.groupBy("member", "bucket").count().where("count > 1").count() == 0


def test_many_small_loads_merge_into_buckets_that_a_task_can_hold(spark, monkeypatch):
    monkeypatch.setattr(dr, "BUCKET_ENTRIES", 150)
    rows = [make(120, i) + [("d1", "a", f"own{i}-{k}", f"t{i}-{k}") for k in range(60)] for i in range(50)]
    dims, members = [F.col("d"), F.col("g")], {"s": F.col("s"), "o": F.col("o")}
    load = spark.createDataFrame([(i, *x) for i, part in enumerate(rows) for x in part], "load int, d string, g string, s string, o string").repartition(10, "load")
    state = dr.materialize(dr.build_runs(load, dims, members, 3))
    merged = dr.materialize(dr.merge_runs(*[state.where(F.spark_partition_id() % 2 == k) for k in (0, 1)]))
    most = merged.agg(F.max("n"), F.min("bits")).first()
    assert most[0] <= 4 * 150 and most[1] >= 5
    assert counts(dr.count_distinct(merged, ["s", "o"]).withColumnsRenamed({"d0": "d", "d1": "g"})) == plain(list(itertools.chain(*rows)))


def test_empty_and_only_nulls(spark):
    assert run(frame(spark, make(5, 1)).limit(0)).count() == 0
    assert run(frame(spark, [("a", "b", None, None)])).count() == 0
