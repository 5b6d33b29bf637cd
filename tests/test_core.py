import random

import pytest
from pyspark.sql import functions as F

from quillgraph.config import EncodeConfig, Popularity, parse_args
from quillgraph.functions import codecs, hashes, strings
from quillgraph.operators import badrows, dictionary, encode, hierarchy, partition, patterns, prefix, schema, sketches, skew
from quillgraph.sources import ntriples as nt
from quillgraph.sources import splits, stores

XSD = "^^<http://www.w3.org/2001/XMLSchema#string>"
GOLDEN = [
    ("<a> <b> <c> .", True), ("<a> <b> <c>", True), ('_:x <b> "l\\"q"@en-GB .', True), (f'<a><b>"1"{XSD}.', True), ("<aé> <b> <c\\x> .", True), ("<> <b> _: .", True), ("<a> <b> <c\\\\\\> .", True),
    ("<a> <b> <c> <g> .", False), ('"l" <b> <c> .', False), ("<a> _:p <c> .", False), ("<a b> <p> <c> .", False), ("<a\\u00g9> <b> <c> .", False), ('<a> <b> "x\\q" .', False), ("<a> <b> <c> . # c", False),
    ("<a> <b> <" + "x" * 16381 + "> .", False), ("<a> <b> <" + "x" * 16380 + "> .", True), ('<a> <b> "' + "x" * 16380 + f'"{XSD} .', True), ("   ", False), ("\t<a>\x0b<b> <c> . \r", True), ("<a> <b> <c\\u00e9> .", True),
    ('<a> <b> "x', False), ("<a> <b>", False), ("<a> <b> <c> . .", False), ('<a> <b> "x"@ .', False), ("<a> <b> <c|d> .", False), ("<a> <b> <c`d> .", True), ("_:*a-b_c:d <b> _:z", True), ("_:a.b <b> <c> .", False),
    ("<a> <b> \"\\U0001F600\\t\" .", True), ("<a> <b> <c\\U12> .", False), ("<a> <b> <c\\\\u12> .", False), (".", False), ("<a> <b> <c>\n.", True),
]


def triples(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "triple_id long, s string, p string, o string")


def test_golden_lines_by_both_parsers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)] + [(900, ""), (901, "# c"), (902, None)], "line_no int, line string")
    want = {i for i, (_, ok) in enumerate(GOLDEN) if ok}
    assert {r.line_no for r in nt.parse_lines(df).collect()} == want
    out = badrows.split_rows(df, ["line_no"]).collect()
    assert {r.line_no for r in out if r.reason is None} == want
    assert {r.line_no for r in out} == set(range(len(GOLDEN)))
    assert all((badrows.diagnose(t) == "") == ok for t, ok in GOLDEN)
    assert next(r.o for r in out if r.line_no == 3) == '"1"'


def test_bad_rows_agree_with_the_strict_parser_on_random_lines():
    import pyarrow as pa

    r = random.Random(5)
    parts = ["<a>", "<b\\u12>", "<é>", '"x"', '"\\n"', '"\\x"', "_:b", "_:", ".", " ", "\t", "@en", "^^<t>", "<", ">", '"', "\\", "#", XSD]
    lines = ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    got = badrows.parse_batch(pa.array(lines), block=64)
    assert [x is None for x in got.field(3).to_pylist()] == [badrows.diagnose(x) == "" for x in lines]


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_are_judged_line_by_line_in_the_end(block):
    import pyarrow as pa

    long = "<a> <b> <" + "x" * 16380 + "> ."
    lines = ["<a> <b>", "<c> .", '<a> <b> "x', 'y" .', '<a> <b> "nul \0 in it" .', "<a> <b> <c> .", "<a> <b> <c> .\0<a> <b> <c> .", long, long[:-3] + "y> .", "", "<a> <b> <c> ."] * 3
    got = badrows.parse_batch(pa.array(lines), block)
    assert [x is None for x in got.field(3).to_pylist()] == [badrows.diagnose(x) == "" for x in lines]
    assert got.field(2).to_pylist()[4] == '"nul \0 in it"' and got.field(2).to_pylist()[7] == "<" + "x" * 16380 + ">"
    assert badrows.parse_batch(pa.array([], pa.string()), block).to_pylist() == []


def test_bad_rows_nulls_repeats_and_clashes(spark):
    rows = [(1, 1, "bad", "k"), (1, 1, "bad", "k"), (None, 2, "worse", "k"), (1, 3, "<a> <b> <c> .", None), (1, 3, "<a> <b> <c> .", None), (1, 4, None, "k")]
    df = spark.createDataFrame(rows, "file_id int, line_no int, line string, s string")
    assert sorted((r.line_no, r.line) for r in badrows.rejected(df, ["file_id", "line_no"]).collect()) == [(1, "bad"), (2, "worse")]
    assert [(r.key_s, r.s) for r in badrows.accepted(df, ["s", "line_no"]).collect()] == [(None, "<a>")]
    assert badrows.rejected(df.limit(0), ["file_id"]).count() == 0


def test_tree_aggregate_against_plain_counts(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + [f"k{r.randint(0, 300)}", None]), r.choice(["x", "y", None]), r.choice([f"s{r.randint(0, 900)}", None]), r.choice([None, f"2024-03-{r.randint(10, 28)} 00:00:00"])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "p string, o string, s string, t string").withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("node", F.lit(1))
    for chunk, fan in ((64, 2), (65536, 16)):
        got = {(x.pos, x.term): (x.n_rows, x.n_s, str(x.first_seen), str(x.last_seen)) for x in skew.tree_aggregate(df, ["p", "o"], "s", "t", chunk_rows=chunk, fan_in=fan).collect()}
        want = {}
        for pos, i in (("p", 0), ("o", 1)):
            for k in {x[i] for x in rows} - {None}:
                own = [x for x in rows if x[i] == k]
                times = [x[3] for x in own if x[3]]
                want[pos, k] = (len(own), len({x[2] for x in own} - {None}), min(times, default="None"), max(times, default="None"))
        assert got == want
    assert skew.tree_aggregate(df.limit(0), ["p"], "s", "t").count() == 0


def plain_tree(rows):
    parent = {}
    for k, p in rows:
        if k is not None:
            parent.setdefault(k, []).append(p)
    parent = {k: min((x for x in v if x is not None), default=None) for k, v in parent.items()}
    orphan = {k for k, p in parent.items() if p is not None and p not in parent}
    up = {k: (p if p in parent else None) for k, p in parent.items()}
    out = {}
    for k in parent:
        path, x, seen = [k], up[k], {k}
        while x is not None and x not in seen:
            path.append(x)
            seen.add(x)
            x = up[x]
        if x is not None:
            ring = path[path.index(x) :]
            out[k] = ("cycle" if k in ring else "below_cycle", None, None, None)
        else:
            out[k] = ("node" if up[k] is not None else "orphan" if k in orphan else "top", path[-1], len(path) - 1, "/".join(map(str, path[::-1])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_against_walking_up(spark, seed, monkeypatch):
    monkeypatch.setattr(hierarchy, "FEW", 20)  # so that hot parents take their own way
    r = random.Random(seed)
    n = 150
    rows = [(k, r.choice([None, 0, 0, 0, r.randint(0, n + 5), max(0, k - 1), max(0, k - 1)])) for k in range(n)] + [(n + k, n + (k + 1) % 5) for k in range(3 + seed)] + [(None, 4), (3, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "id long, up long, path int")
    want = plain_tree(rows)
    got = {x.node_key: x for x in hierarchy.hierarchy(df, "id", "up").collect()}
    assert {k: (x.status, x.root_key, x.depth, x.path) for k, x in got.items()} == want
    inside = {k: set(v[3].split("/")) if v[3] else set() for k, v in want.items()}
    for a in got.values():
        if a.root_key is not None:
            below = {k for k, v in inside.items() if str(a.node_key) in v and k != a.node_key}
            assert a.n_descendants == len(below)
            assert below == {b.node_key for b in got.values() if b.range_start is not None and a.range_start < b.range_start < a.range_end}
    assert {x.node_key for x in hierarchy.cycle_nodes(df, "id", "up").collect()} == {k for k, v in want.items() if v[0] == "cycle"}


@pytest.mark.parametrize("seed", range(2))
def test_nodes_on_and_below_cycles_have_heights_and_descendants(spark, seed, monkeypatch):
    monkeypatch.setattr(hierarchy, "FEW", 20)
    r = random.Random(seed)
    up = {0: None} | {k: r.choice([None, k - 1, r.randint(0, k - 1)]) for k in range(1, 60)}
    up |= {100: 100, 110: 111, 111: 112, 112: 113, 113: 110}  # rings of one and of four
    up |= {200: 113} | {k: r.choice([100, 110, 112, 112, r.randint(200, k - 1), k - 1]) for k in range(201, 260)}
    df = spark.createDataFrame([(k, p, 2) for k, p in up.items()], "id long, up long, high int")
    below = {k: set() for k in up}
    far = {k: {} for k in up}
    for k in up:
        x, n, seen = up[k], 1, set()
        while x is not None and x not in seen:
            seen.add(x)
            below[x].add(k)
            far[x][k] = n
            x, n = up[x], n + 1
    ring = {k for k in up if k in below[k]}
    tree = hierarchy.materialize(hierarchy.hierarchy(df, "id", "up", recorded="high", below_cycles=True))
    got = {x.node_key: x for x in tree.collect()}
    assert ring == {k for k, x in got.items() if x.status == "cycle"} == {100, 110, 111, 112, 113}
    for k, x in got.items():
        want = None if k in ring else max(far[k].values(), default=0)
        assert (x.height, x.n_descendants) == (want, len(below[k] - {k}))
        assert x.height_matches == (None if want is None else want == 2)
        assert (x.root_key is None) == (x.status in ("cycle", "below_cycle"))
        assert below[k] - {k} == {b.node_key for b in got.values() if x.range_start <= b.range_start < x.range_end and b.node_key != k}
    pairs = [(x.ancestor_key, x.node_key) for x in hierarchy.descendants(tree, tree, blocks=16).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(k, b) for k, v in below.items() for b in v - {k}}


def test_descendants_of_every_node_are_listed(spark, tmp_path):
    import __spark_entry__

    up = {1: None, 2: 1, 3: 2, 5: 6, 6: 5, 7: 6, 8: 7}
    spark.createDataFrame(list(up.items()), "node_key long, parent_key long").write.parquet(f"{tmp_path}/class_nodes.parquet")
    got = sorted(map(tuple, __spark_entry__.queries()["p7_descendants"](spark, str(tmp_path)).collect()))
    assert got == [(1, 2), (1, 3), (2, 3), (5, 6), (5, 7), (5, 8), (6, 5), (6, 7), (6, 8), (7, 8)]


def test_hierarchy_of_nothing_and_of_a_long_chain(spark):
    df = spark.createDataFrame([], "id long, up long")
    assert hierarchy.hierarchy(df, "id", "up").count() == 0 and hierarchy.cycle_nodes(df, "id", "up").count() == 0
    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    out = hierarchy.hierarchy(chain, "id", "up", with_path=False).agg(F.max("depth"), F.max("height"), F.max("range_end")).first()
    assert tuple(out) == (299, 299, 301)


def test_prefix_sums_with_a_hot_group(spark):
    rows = [("hot" if i % 4 else None, i, i % 7) for i in range(500)]
    got = prefix.prefix_sums(spark.createDataFrame(rows, "g string, k long, v long"), "g", [F.col("k")], "v", "before").collect()
    for x in got:
        assert x.before == sum(v for g, k, v in rows if g == x.g and k < x.k)


def test_dictionaries_and_encoding(spark):
    rows = [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<a>"), ("<a>", "<p>", "<b>"), ("<é>", "<q>", '"x"')]
    t = triples(spark, rows)
    occ = dictionary.explode_terms(t)
    words = dictionary.lexicographic(occ)
    terms = sorted({x for r in rows for x in r}, key=str.encode)
    assert {r.term: r.id for r in words.collect()} == {x: i for i, x in enumerate(terms)}
    coded = encode.encode(t, words)
    assert sorted(map(tuple, encode.decode(coded, words).collect())) == sorted((i, *r) for i, r in enumerate(rows))
    assert encode.distinct_spo(coded).count() == 3
    assert encode.encode(t, words, ignore_predicates=True).agg(F.max("p")).first()[0] == 0
    first = dictionary.popular_first(dictionary.term_frequency(occ), 1)
    assert {r.term for r in first.where("id = 0").collect()} == {"<p>"}
    more = dictionary.extend(words, spark.createDataFrame([("<a>",), ("<zz>",), ("<c>",)], "term string")).collect()
    assert sorted((r.id, r.term) for r in more) == [(len(terms), "<c>"), (len(terms) + 1, "<zz>")]
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "id long, term string")
    assert [tuple(r) for r in dictionary.conflicts(twice).collect()] == [(1, 2, "a")]
    assert encode.parse_signature(63) == list(range(6)) and encode.add_permutation(1, 5) == 33
    assert {r.perm for r in encode.permutations(coded.select("s", "p", "o"), 1 | 1 << 3).collect()} == {"spo", "sop"}
    assert dictionary.lexicographic(occ.limit(0)).count() == 0


def test_schema_with_diamond_redundant_edge_and_cycle(spark):
    sub, typ, dom = schema.SUBCLASS, schema.TYPE, schema.DOMAIN
    g = spark.createDataFrame([("A", sub, "B"), ("A", sub, "C"), ("B", sub, "D"), ("C", sub, "D"), ("A", sub, "D"), ("X", sub, "Y"), ("Y", sub, "X"), ("A", sub, "A"), ("i", typ, "A"), ("p", dom, "B"), ("p", dom, "D"), ("j", "p", "k")], "s string, p string, o string")
    tree = {r["class"]: r.parent for r in schema.tree(schema.subclass_edges(g)).collect()}
    assert tree == {"A": "B", "B": "D", "C": "D", "D": schema.CLASS, schema.CLASS: None, "X": "Y", "Y": "X"}
    tax = {r["class"]: (r.height, r.assigned_id) for r in schema.taxonomy(schema.tree(schema.subclass_edges(g))).collect()}
    assert tax == {"A": (0, 0), "B": (1, 1), "C": (0, 2), "D": (2, 3), schema.CLASS: (3, 4), "X": (None, None), "Y": (None, None)}
    assert sorted(map(tuple, schema.term_classes(g).collect())) == [("i", "A"), ("j", "B")]


def test_patterns(spark):
    t = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y", "z"]), ("c", ["x"])], "term string, items array<string>")
    assert {(tuple(r.items), r.freq) for r in patterns.frequent_patterns(t, 1, 3).collect()} == {(("x",), 3), (("y",), 2), (("x", "y"), 2)}
    assert patterns.frequent_patterns(t.limit(0), 1, 3).count() == 0


def test_sketches_never_undercount_and_stay_near(spark):
    occ = spark.range(4000).select((F.col("id") % 300).cast("string").alias("term"), F.col("id").alias("triple_id"), F.lit(0).alias("pos"))
    exact = {r.term: r.freq for r in dictionary.term_frequency(occ).collect()}
    est = {r.term: r.estimate for r in sketches.count_min_estimate(occ.select("term").distinct(), sketches.count_min(occ, 512), 512).collect()}
    assert all(est[k] >= n for k, n in exact.items()) and len(est) == 300
    assert abs(sketches.approx_distinct(occ, "term").first()[0] - 300) <= 20
    by = sketches.distinct_sketch(occ.withColumn("g", F.col("triple_id") % 3), "term", "g")
    assert abs(sketches.united_distinct(by).first()[0] - 300) <= 20
    assert sketches.top_k_sketch(occ, 5).count() == 5
    assert sketches.sample_occurrences(occ, 10000).count() == 4000


def test_partitions(spark):
    df = spark.createDataFrame([(x,) for x in "abcdefgh"], "v string")
    b = partition.boundaries(df, "v", 4)
    assert sorted(map(tuple, b.collect())) == [(0, "b"), (1, "d"), (2, "f")]
    assert {r.v: r.part for r in partition.assign(df, "v", b).collect()} == {x: i // 2 for i, x in enumerate("abcdefgh")}


def signed(text):
    return [b - 256 if b > 127 else b for b in text.encode()]


def test_hashes_and_strings(spark):
    texts = ["", "a", "<http://x#y>", "é漢", "zz" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", hashes.polynomial_hash(F.col("t")).alias("d"), hashes.fnv1a_56(F.col("t")).alias("f")).collect():
        d, f = 5381, 0
        for b in signed(r.t):
            d = (d * 33 + b) % (1 << 56)
            f = ((f ^ b) % (1 << 56) * 16777619) % (1 << 56)
        assert (r.d, r.f) == (d, f)
    split = df.select("t", *strings.prefix_split(F.col("t"))).collect()
    assert [tuple(r)[1:] for r in split if r.t == "<http://x#y>"] == [("<http://x#", "y>")]
    pair = spark.createDataFrame([("éa", "éb"), ("", "x"), ("ab", "abc"), (None, "x")], "a string, b string")
    assert [r[0] for r in pair.select(strings.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, None]
    nums = spark.createDataFrame([(0,), (1,), (31,), (32,), (127,), (128,), (1 << 40,), ((1 << 61) - 1,)], "x long")
    rows = nums.select("x", strings.leading_zeros(F.col("x")), strings.varint_bytes(F.col("x")), strings.vlong_bytes(F.col("x")), strings.least_set_bit(F.col("x")), strings.first_zero_bit(F.col("x"))).collect()
    for x, lz, v, vl, low, zero in rows:
        assert lz == 64 - x.bit_length() and v == len(codecs.encode_varint(x)) and vl == len(codecs.encode_sized(x))
        assert low == (None if x == 0 else (x & -x).bit_length() - 1) and zero == ((x + 1) & ~x).bit_length() - 1


def test_murmur(spark):
    from quillgraph.functions import murmur

    assert murmur.murmur3_32(b"") == 0 and murmur.murmur3_32(b"hello") == 0x248BFA47 and murmur.murmur3_128(b"") == (0, 0)
    assert murmur.murmur3_128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert murmur.murmur3_128(b"The quick brown fox jumps over the lazy dog") == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)
    df = spark.createDataFrame([("hello",), (None,), ("é",)], "t string")
    got = [r[0] for r in df.select(murmur.murmur3_56_column(F.col("t"))).collect()]
    assert got == [murmur.murmur3_56(b"hello"), None, murmur.murmur3_56("é".encode())] and 0 <= got[0] < 1 << 56
    pair = spark.createDataFrame([([1, 2],), ([2, 1],), (None,), ([],)], "a array<long>").select(hashes.hash_array(F.col("a"))).collect()
    assert pair[0] != pair[1] and pair[2][0] is None and pair[3][0] == 0


def test_codecs_round_trip(spark):
    for x in [0, 1, 127, 128, 510, 1 << 20, (1 << 56) + 7, (1 << 61) - 1]:
        assert codecs.decode_varint(codecs.encode_varint(x)) == x == codecs.decode_varint(codecs.encode_varint(x, big=True), big=True)
        assert codecs.decode_sized(codecs.encode_sized(x)) == x and codecs.decode_headed(codecs.encode_headed(x, 1)) == (x, 1)
        assert codecs.decode_fixed(codecs.encode_fixed(x, 8)) == x == codecs.decode_fixed(codecs.encode_fixed(x, 8, little=True), little=True)
    df = spark.createDataFrame([(5,), (None,), (300,)], "x long")
    assert [r[0] for r in df.select(codecs.varint_value(codecs.varint_column(F.col("x")))).collect()] == [5, None, 300]
    assert [r[0] for r in df.select(codecs.sized_value(codecs.sized_column(F.col("x")))).collect()] == [5, None, 300]


def test_sources_and_sinks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a1.nt").write_text("<a> <b> <c> .\n# no\n\nbad\n<a> <b> \"x\" .\n")
    import gzip

    (src / "a2.nt.gz").write_bytes(gzip.compress(b"<z> <b> <c> .\n"))
    (src / "b.nt").write_text("<skip> <b> <c> .\n")
    assert {r.s for r in nt.read_ntriples(spark, str(src), "a").collect()} == {"<a>", "<z>"}
    assert nt.read_ntriples(spark, str(src)).count() == 4
    plan = splits.plan_splits([(str(f), f.stat().st_size) for f in splits.list_inputs(str(src))], 2)
    assert sum(p.size for x in plan for p in x) == sum(f.stat().st_size for f in src.iterdir()) and not splits.is_splittable("x.GZ")
    assert splits.input_stats(spark, str(src)).where("compressed").count() == 1
    words = spark.createDataFrame([(1, "<a b>"), (2, '"é x"@en')], "id long, term string")
    stores.write_dictionary_text(words, str(tmp_path / "dict"))
    assert sorted(map(tuple, stores.read_dictionary_text(spark, str(tmp_path / "dict")).collect())) == sorted(map(tuple, words.collect()))
    coded = spark.createDataFrame([(3, 1, 2), (1, 2, 3), (1, 2, 3)], "s long, p long, o long")
    stores.write_triples_text(coded, str(tmp_path / "triples"))
    assert sorted(map(tuple, stores.read_triples_text(spark, str(tmp_path / "triples")).collect())) == [(1, 2, 3), (3, 1, 2)]
    stores.write_permutations(coded, str(tmp_path / "perms"), 1 | 1 << 1)
    assert sorted(map(tuple, stores.read_permutation(spark, str(tmp_path / "perms"), "ops").collect())) == [(2, 1, 3), (3, 2, 1), (3, 2, 1)]
    tax = spark.createDataFrame([("A", None, 1, 1), ("B", "A", 0, 0)], "class string, parent string, height long, assigned_id long")
    stores.write_taxonomy_text(schema.taxonomy_lines(tax), str(tmp_path / "tax"))
    ids, parents = stores.read_taxonomy_text(spark, str(tmp_path / "tax"))
    assert sorted(map(tuple, ids.collect())) == [("A", 1), ("B", 0)] and {r["class"]: r.parent for r in parents.collect()} == {"A": None, "B": "A"}
    stores.write_sorted_runs(coded, str(tmp_path / "runs"), ["s", "p", "o"], 1)
    stores.write_graph_dot(tax.select("class", "parent"), str(tmp_path / "dot"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 3 and spark.read.text(str(tmp_path / "dot")).count() == 1


def test_streaming_dictionary(spark, tmp_path):
    from quillgraph.streaming import dictionary as stream

    def add(name, rows):
        spark.createDataFrame(rows, "triple_id long, s string, p string, o string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def go():
        src = spark.readStream.schema("triple_id long, s string, p string, o string").parquet(str(tmp_path / "in" / "*"))
        q = stream.run(src, str(tmp_path / "dict"), str(tmp_path / "out"), str(tmp_path / "check"))
        assert q.awaitTermination(120)

    add("one", [(1, "<b>", "<p>", "<a>")])
    go()
    add("two", [(2, "<c>", "<p>", "<a>")])
    go()
    words = {r.term: r.id for r in stream.read_dictionary(spark, str(tmp_path / "dict")).collect()}
    assert words == {"<a>": 0, "<b>": 1, "<p>": 2, "<c>": 3}
    assert {(r.triple_id, r.s, r.p, r.o) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1, 2, 0), (2, 3, 2, 0)}


def test_config():
    src, out, cfg = parse_args(["--input", "a", "--output", "b", "--top-k", "7", "--ignore-predicates", "--popularity", "cms"])
    assert (src, out, cfg.top_k, cfg.ignore_predicates, cfg.popularity) == ("a", "b", 7, True, Popularity.COUNT_MIN)
    with pytest.raises(ValueError):
        EncodeConfig(permutations=64)


def test_pipeline_encodes_and_writes(spark, tmp_path):
    from quillgraph import pipeline
    from quillgraph.session import cleanup

    typ, sub = schema.TYPE, schema.SUBCLASS
    rows = [("<C1>", sub, "<C2>"), ("<a>", typ, "<C1>"), ("<b>", typ, "<C2>"), ("<a>", "<p>", "<b>"), ("<a>", "<p>", "<b>"), ("<z>", "<p>", '"x y"')]
    src = tmp_path / "in.nt"
    src.write_text("".join(f"{s} {p} {o} .\n" for s, p, o in rows) + "broken\n")
    for way in Popularity:
        cfg = EncodeConfig(popularity=way, top_k=2, start_counter=10, write_taxonomy=True, sample_per_10000=10000)
        out = pipeline.encode_graph(nt.read_ntriples(spark, str(src)), cfg)
        words = {r.id: r.term for r in out.dictionary.collect()}
        assert sorted(words) == list(range(10, 10 + len({x for r in rows for x in r})))
        assert {tuple(words[i] for i in r) for r in map(tuple, out.triples.collect())} == set(rows)
        if way is Popularity.EXACT:
            assert (words[10], words[11]) == ("<a>", "<b>")  # with <p> the most frequent terms: ties by text
    pipeline.run(spark, str(src), str(tmp_path / "out"), cfg)
    assert {r.term for r in stores.read_dictionary_text(spark, str(tmp_path / "out" / "dict_text")).collect()} == set(words.values())
    assert stores.read_permutation(spark, str(tmp_path / "out" / "permutations"), "pso").count() == 5
    ids, _ = stores.read_taxonomy_text(spark, str(tmp_path / "out" / "taxonomy_text"))
    assert ids.count() == 3
    cleanup(spark)


def test_pipeline_with_patterns_and_with_hash_ids(spark, tmp_path):
    from quillgraph import pipeline
    from quillgraph.functions import murmur
    from quillgraph.session import cleanup

    typ, sub = schema.TYPE, schema.SUBCLASS
    rows = [(f"<C{k}>", sub, "<Top>") for k in range(4)]
    rows += [(f"<t{i}>", typ, f"<C{c}>") for i in range(4) for c in (0, 3)] + [("<u>", typ, "<C1>"), ("<t1>", "<p>", "<v>"), ("<w>", "<p>", "<u>")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    plain = pipeline.encode_graph(df, EncodeConfig(top_k=1))
    mined = pipeline.encode_graph(df, EncodeConfig(top_k=1, mine_patterns=True, min_support=2, max_pattern_length=2))
    order = lambda x: [r["class"] for r in x.taxonomy.orderBy("assigned_id").collect() if r.parent == "<Top>"]
    assert order(plain) == ["<C0>", "<C1>", "<C2>", "<C3>"] and order(mined) == ["<C0>", "<C3>", "<C1>", "<C2>"]
    assert {(tuple(r["items"]), r.freq) for r in mined.patterns.collect()} == {(("<C0>",), 4), (("<C3>",), 4), (("<C0>", "<C3>"), 4)} and plain.patterns is None
    assert mined.stats.first().n_occurrences == 3 * len(rows)
    src = tmp_path / "in.nt"
    src.write_text("".join(f"{s} {p} {o} .\n" for s, p, o in rows))
    pipeline.run(spark, str(src), str(tmp_path / "out"), EncodeConfig(hash_ids=True, permutations=1))
    ids = {r.term: r.id for r in spark.read.parquet(str(tmp_path / "out" / "dictionary")).collect()}
    assert ids == {t: murmur.murmur3_56(t.encode()) for r in rows for t in r}
    got = spark.read.parquet(str(tmp_path / "out" / "permutations")).select("c0", "c1", "c2").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(ids[x] for x in r) for r in rows)
    cleanup(spark)


def test_neighbour_classes_and_roots(spark):
    rows = [("<a>", schema.TYPE, "<A>"), ("<b>", schema.TYPE, "<B>"), ("<a>", "<p>", "<x>"), ("<x>", "<q>", "<b>"), ("<y>", "<p>", "<z>")]
    best = spark.createDataFrame([("<a>", 3), ("<b>", 1)], "term string, class_id long")
    got = schema.neighbour_class(spark.createDataFrame(rows, "s string, p string, o string"), best)
    assert {(r.term, r.class_id2) for r in got.collect()} == {("<x>", 1)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("d", "e"), ("x", "y"), ("y", "x")], "sub string, sup string")
    assert {r["class"] for r in schema.roots(edges).collect()} == {"c", "e"}
    assert schema.roots(edges.limit(0)).count() == 0


def test_count_min_top_keeps_ties_and_threshold(spark):
    occ = spark.createDataFrame([(x,) for x in ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d", None]], "term string").repartition(3)
    counters = sketches.count_min(occ, 1 << 12)
    assert [tuple(r) for r in sketches.count_min_top(occ, counters, 1 << 12, 2).collect()] == [("a", 5), ("b", 3)]
    assert [r.term for r in sketches.count_min_top(occ, counters, 1 << 12, 9, 3).collect()] == ["a", "b", "c"]
    assert sketches.count_min_top(occ.limit(0), counters.limit(0), 1 << 12, 2).count() == 0
    assert (sketches.counters_for_input(10, 100), sketches.counters_for_input(10**12, 5), sketches.counters_for_input(10**6, 5, compressed=True)) == (100, 1957341, 10_000)


def test_lookup_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FEW", 10)
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(90)] + [(5, "hot")] * 20, "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3), ("other", 4)], "k string, v long")
    value = {"hot": 1, "k0": 2, "k6": 3}
    for n in (None, 110):
        got = sorted(map(tuple, hierarchy.lookup(left, right, "k", n).collect()), key=str)
        assert got == sorted(((r.i, r.k, value.get(r.k)) for r in left.collect()), key=str)
    assert hierarchy.hot_keys(left, "k") and hierarchy.lookup(left.limit(0), right, "k").count() == 0


def test_parts_of_nulls_and_many_bounds(spark):
    bounds = spark.createDataFrame([(i, f"{i:03d}") for i in range(0, 100)], "part int, bound string")
    rows = spark.createDataFrame([("000",), ("0005",), ("099",), ("zzz",), ("",), (None,)], "v string")
    assert {r.v: r.part for r in partition.assign(rows, "v", bounds).collect()} == {"000": 0, "0005": 1, "099": 99, "zzz": 100, "": 0, None: 0}
    assert {r.part for r in partition.assign(rows, "v", bounds.limit(0)).collect()} == {0}
    assert partition.spread(rows, "v", bounds).count() == 6


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from quillgraph import session

    conf = SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_codecs_and_hashes_of_columns(spark):
    from quillgraph.functions import murmur

    r = random.Random(1)
    xs = [0, 31, 32, 127, 128, 2**31, 2**56 - 1, 2**61 - 1, 2**61, 2**63 - 1, -1, None] + [r.getrandbits(r.randint(1, 61)) for _ in range(20)]
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in xs], "x long").select(
        "x", codecs.varint_column(x).alias("v"), codecs.varint_column(x, big=True).alias("b"), codecs.fixed_column(x, 8, little=True).alias("f"), codecs.fixed_column(x, 2).alias("s"), codecs.sized_column(x).alias("z"),
        codecs.headed_column(x, F.lit(1)).alias("h"), codecs.varint_value(codecs.varint_column(x, big=True), big=True).alias("bv"), codecs.fixed_value(codecs.fixed_column(x, 8, little=True), little=True).alias("fv"),
    )
    for o in rows.collect():
        if o.x is None or o.x < 0:
            assert o.v is o.b is o.f is o.s is o.z is o.h is None
            continue
        assert (bytes(o.v), bytes(o.b), bytes(o.f), bytes(o.h)) == (codecs.encode_varint(o.x), codecs.encode_varint(o.x, big=True), codecs.encode_fixed(o.x, 8, little=True), codecs.encode_headed(o.x, 1))
        assert (o.bv, o.fv) == (o.x, o.x) and (o.s is None) == (o.x >= 1 << 16) and (o.z is None) == (o.x >= 1 << 61)
    import pyarrow as pa

    texts = pa.array(["", "a", "é" * 40, "x" * 15, "y" * 16, "z" * 17, "w" * 5000, None, *["".join(r.choice("abcdé漢") for _ in range(r.randint(0, 70))) for _ in range(100)]]).slice(1)
    low, high = murmur.murmur3_128_all(texts)
    for t, a, b, c, d in zip(texts.to_pylist(), low, high, murmur.murmur3_32_all(texts), murmur.murmur3_56_all(texts)):
        if t is not None:
            assert (int(a), int(b)) == murmur.murmur3_128(t.encode()) and int(c) == murmur.murmur3_32(t.encode()) and int(d) == murmur.murmur3_56(t.encode())


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (5, 6, 7)} <= set(entry.queries())
