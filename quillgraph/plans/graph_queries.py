"""Queries of the encoding engine, one or more for each operator, with the SQL they are held against.

The graph is the table ``triples`` (each id once, rows with all three terms); its schema statements are the links of
``class_nodes`` and a few literal rows (domains, ranges, a diamond, a redundant edge, a cycle of two).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph import pipeline
from quillgraph.config import EncodeConfig
from quillgraph.functions import codecs, hashes, murmur, strings
from quillgraph.operators import dictionary as dic
from quillgraph.operators import encode as enc
from quillgraph.operators import partition as part
from quillgraph.operators import patterns as pat
from quillgraph.operators import schema as sch
from quillgraph.operators import sketches as sk
from quillgraph.session import materialize, shared_dir
from quillgraph.sources import ntriples as nt
from quillgraph.sources import splits, stores
from quillgraph.sources.tables import statements, table

POPULAR = 500
WIDTH = 4096
_NS = "http://kg.example"
#: Literal rows of the schema: (subject, predicate, object).
TBOX = [
    (f"<{_NS}/p/measuredBy>", sch.RANGE, f"<{_NS}/class/Sensor>"), (f"<{_NS}/p/locatedIn>", sch.RANGE, f"<{_NS}/class/Place>"), (f"<{_NS}/p/locatedIn>", sch.RANGE, f"<{_NS}/class/Zone>"),
    (f"<{_NS}/p/partOf>", sch.DOMAIN, f"<{_NS}/class/Part>"), (f"<{_NS}/p/active>", sch.DOMAIN, f"<{_NS}/class/Device>"),
    (f"<{_NS}/class/Sensor>", sch.SUBCLASS, f"<{_NS}/class/Device>"), (f"<{_NS}/class/Sensor>", sch.SUBCLASS, f"<{_NS}/class/Station>"),
    (f"<{_NS}/class/Device>", sch.SUBCLASS, f"<{_NS}/class/Thing>"), (f"<{_NS}/class/Station>", sch.SUBCLASS, f"<{_NS}/class/Thing>"),
    (f"<{_NS}/class/Sensor>", sch.SUBCLASS, f"<{_NS}/class/Thing>"), (f"<{_NS}/class/Loop1>", sch.SUBCLASS, f"<{_NS}/class/Loop2>"), (f"<{_NS}/class/Loop2>", sch.SUBCLASS, f"<{_NS}/class/Loop1>"),
]


def _class(c: str):
    return F.concat(F.lit(f"<{_NS}/class/C"), F.col(c).cast("string"), F.lit(">"))


def graph(spark: SparkSession, d: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """(s, p, o): statements (with ``predicates`` only those of them) and schema."""
    links = table(spark, d, "class_nodes").where(F.col("node_key").isNotNull() & F.col("parent_key").isNotNull())
    tbox = links.select(_class("node_key").alias("s"), F.lit(sch.SUBCLASS).alias("p"), _class("parent_key").alias("o")).distinct()
    literal = spark.createDataFrame(TBOX, "s string, p string, o string")
    return statements(spark, d, predicates).select("s", "p", "o").unionByName(tbox).unionByName(literal)


def _schema(spark: SparkSession, d: str) -> DataFrame:
    """The statements that a schema is made of: the others aren't read beyond their predicate. Written once."""
    return materialize(graph(spark, d, sch.VOCABULARY))


def _occ(spark, d):
    return dic.explode_terms(statements(spark, d))


def _freq(spark, d):
    return dic.term_frequency(_occ(spark, d))


def triples_scan(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d)


def term_explode(spark: SparkSession, d: str) -> DataFrame:
    out = _occ(spark, d)
    return out.withColumn("origin", dic.origin_tag(F.col("triple_id"), F.col("pos")))


def distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    return _occ(spark, d).select("term").distinct()


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d)


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return dic.top_terms(_freq(spark, d), POPULAR)


def tail_terms(spark: SparkSession, d: str) -> DataFrame:
    freq = _freq(spark, d)
    return dic.tail_terms(freq, dic.top_terms(freq, POPULAR))


def tail_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return dic.tail_occurrences(statements(spark, d), dic.top_terms(_freq(spark, d), POPULAR))


def popular_threshold(spark: SparkSession, d: str) -> DataFrame:
    occ = _occ(spark, d)
    n = occ.select("term").distinct().count()
    return sk.popular_threshold(n, WIDTH, materialize(sk.count_min(occ, WIDTH)), POPULAR)


def dict_lexicographic(spark: SparkSession, d: str) -> DataFrame:
    return dic.lexicographic(_occ(spark, d))


def dict_popular_first(spark: SparkSession, d: str) -> DataFrame:
    return dic.popular_first(materialize(_freq(spark, d)), POPULAR)


def dict_no_predicates(spark: SparkSession, d: str) -> DataFrame:
    return dic.lexicographic(dic.explode_terms(statements(spark, d), ignore_predicates=True), start=1)


def dict_hash(spark: SparkSession, d: str) -> DataFrame:
    return dic.hashed(_occ(spark, d))


def dict_hash_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts of ids cut to 20 bits, so that there are some."""
    short = dic.hashed(_occ(spark, d)).withColumn("id", F.pmod("id", F.lit(1 << 20)))
    return dic.conflicts(short)


def _graph(spark, d):
    """The graph, written once, as schema and classes read it several times."""
    return materialize(graph(spark, d))


def _taxonomy(g):
    return materialize(sch.taxonomy(materialize(sch.tree(materialize(sch.subclass_edges(g))))))


def _clustered(spark, d, g, tax):
    best = materialize(sch.min_class(materialize(sch.term_classes(g)), tax))
    return dic.class_clustered(materialize(_freq(spark, d)), best, POPULAR)


def dict_class_clustered(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return _clustered(spark, d, g, _taxonomy(g))


def _encoded(spark, d, t=None):
    t = materialize(statements(spark, d)) if t is None else t
    freq = materialize(dic.term_frequency(dic.explode_terms(t)))
    return enc.encode(t, materialize(dic.lexicographic(freq, unique=True)), freq=freq)


def encode_spo(spark: SparkSession, d: str) -> DataFrame:
    return enc.distinct_spo(_encoded(spark, d))


def encode_all(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates kept, by id of the triple."""
    return _encoded(spark, d)


def encode_no_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(statements(spark, d))
    freq = materialize(dic.term_frequency(dic.explode_terms(t, ignore_predicates=True)))
    return enc.encode(t, materialize(dic.lexicographic(freq, start=1, unique=True)), ignore_predicates=True, freq=freq)


def encode_hybrid_join(spark: SparkSession, d: str) -> DataFrame:
    freq = materialize(_freq(spark, d))
    head = materialize(dic.popular_ids(dic.top_terms(freq, POPULAR, ties_descending=True), ties_descending=True))
    tail = materialize(dic.lexicographic(dic.tail_terms(freq, head), head.count(), unique=True))
    return enc.encode_hybrid(statements(spark, d), head, tail)


def encode_hash(spark: SparkSession, d: str) -> DataFrame:
    return enc.hash_encode(statements(spark, d), 1 | 1 << 5)[0]


def decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(statements(spark, d))
    words = materialize(dic.lexicographic(dic.explode_terms(t)))
    return enc.decode(materialize(enc.encode(t, words)), words)


def permutations_6(spark: SparkSession, d: str) -> DataFrame:
    return enc.permutations(_encoded(spark, d).select("s", "p", "o"))


def perm_signature(spark: SparkSession, d: str) -> DataFrame:
    sig = spark.range(64).select(F.col("id").cast("int").alias("signature"))
    return sig.select("signature", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("perm")).where(enc.has_permutation(F.col("signature"), F.col("perm")))


def incremental_encode(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the triples with even ids first, then the new ones of the others."""
    occ = _occ(spark, d)
    first = materialize(dic.lexicographic(occ.where(F.col("triple_id") % 2 == 0)))
    return first.unionByName(dic.extend(first, occ.where(F.col("triple_id") % 2 != 0)))


def hybrid_dictionary_stats(spark: SparkSession, d: str) -> DataFrame:
    freq = _freq(spark, d)
    return dic.dictionary_stats(freq, dic.top_terms(freq, POPULAR))


def ntriples_parse(spark: SparkSession, d: str) -> DataFrame:
    return nt.parse_lines(table(spark, d, "ntriples_lines").select("file_id", "line_no", "line")).select("file_id", "line_no", "s", "p", "o").distinct()


def ntriples_invalid_count(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "ntriples_lines")
    got = nt.parse_columns(F.col("line"))
    fits = F.lit(True)
    for c in got.values():
        fits = fits & F.octet_length(c).between(1, nt.MAX_TERM_BYTES)
    return lines.agg(
        F.count_if(~nt.is_data(F.col("line"))).alias("n_skipped"), F.count_if(nt.is_data(F.col("line")) & fits).alias("n_valid"), F.count_if(nt.is_data(F.col("line")) & ~fits).alias("n_invalid")
    )


def ntriples_serialize(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).select("triple_id", nt.serialize(F.col("s"), F.col("p"), F.col("o")).alias("line"))


def ntriples_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return nt.parse_lines(ntriples_serialize(spark, d)).select("triple_id", "s", "p", "o")


def xsd_string_strip(spark: SparkSession, d: str) -> DataFrame:
    typed = statements(spark, d).select("triple_id", F.when(F.col("o").endswith('"'), F.concat("o", F.lit(nt.XSD_STRING))).otherwise(F.col("o")).alias("o"))
    return typed.select("triple_id", nt.strip_xsd_string(F.col("o")).alias("o"))


def schema_classes(spark: SparkSession, d: str) -> DataFrame:
    return sch.explicit_classes(graph(spark, d, sch.VOCABULARY))


def schema_subclass_edges(spark: SparkSession, d: str) -> DataFrame:
    return sch.subclass_edges(_schema(spark, d))


def schema_domains(spark: SparkSession, d: str) -> DataFrame:
    return sch.domains(graph(spark, d, sch.VOCABULARY))


def schema_ranges(spark: SparkSession, d: str) -> DataFrame:
    return sch.ranges(graph(spark, d, sch.VOCABULARY))


def class_closure(spark: SparkSession, d: str) -> DataFrame:
    return sch.closure(sch.stated_edges(graph(spark, d, sch.VOCABULARY)))


def direct_subclass(spark: SparkSession, d: str) -> DataFrame:
    return sch.direct_edges(materialize(sch.subclass_edges(_schema(spark, d))))


def taxonomy_tree(spark: SparkSession, d: str) -> DataFrame:
    return sch.tree(materialize(sch.subclass_edges(_schema(spark, d))))


def taxonomy_postorder(spark: SparkSession, d: str) -> DataFrame:
    return _taxonomy(_schema(spark, d))


def taxonomy_text(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    tax = _taxonomy(g)
    return sch.taxonomy_lines(tax, sch.class_ranges(_clustered(spark, d, g, tax)))


def term_class_candidates(spark: SparkSession, d: str) -> DataFrame:
    return sch.term_classes(_graph(spark, d))


def term_min_class(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return sch.min_class(materialize(sch.term_classes(g)), _taxonomy(g))


def class_id_ranges(spark: SparkSession, d: str) -> DataFrame:
    return sch.class_ranges(dict_class_clustered(spark, d))


def id_to_class(spark: SparkSession, d: str) -> DataFrame:
    words = materialize(dict_class_clustered(spark, d))
    return sch.class_of_id(words.select("id"), sch.class_ranges(words))


def class_frequency(spark: SparkSession, d: str) -> DataFrame:
    return sch.class_frequency(sch.term_classes(_graph(spark, d)))


def _transactions(spark, d):
    classes = materialize(sch.term_classes(_graph(spark, d)))
    return materialize(pat.transactions(classes, materialize(sch.class_frequency(classes)), 3))


def mining_transactions(spark: SparkSession, d: str) -> DataFrame:
    return _transactions(spark, d).select("term", F.array_join("items", " ").alias("items"))


def frequent_classes(spark: SparkSession, d: str) -> DataFrame:
    return pat.item_supports(_transactions(spark, d))


def frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pat.frequent_pairs(_transactions(spark, d), 5)


def frequent_patterns(spark: SparkSession, d: str) -> DataFrame:
    return pat.frequent_patterns(_transactions(spark, d), 5, 3).select(F.array_join("items", " ").alias("items"), "freq")


def sibling_order_by_patterns(spark: SparkSession, d: str) -> DataFrame:
    return pat.sibling_order(_taxonomy(_graph(spark, d)).select("class", "parent"), pat.frequent_pairs(_transactions(spark, d), 5))


def cm_estimate(spark: SparkSession, d: str) -> DataFrame:
    occ = _occ(spark, d)
    return sk.count_min_estimate(occ.select("term").distinct(), sk.count_min(occ, WIDTH), WIDTH)


def mg_candidates(spark: SparkSession, d: str) -> DataFrame:
    return sk.rescored_candidates(_occ(spark, d), 100, WIDTH, 1)


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return sk.approx_distinct(_occ(spark, d), "term")


def approx_distinct_by_property(spark: SparkSession, d: str) -> DataFrame:
    return sk.approx_distinct(statements(spark, d), "o", "p")


def merged_distinct_sketches(spark: SparkSession, d: str) -> DataFrame:
    return sk.united_distinct(sk.distinct_sketch(statements(spark, d), "s", "p"))


def sampled_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return dic.top_terms(dic.term_frequency(sk.sample_occurrences(_occ(spark, d), 500)), 100)


def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    terms = _occ(spark, d).select("term").distinct()
    prefix, local = strings.prefix_split(F.col("term"))
    return terms.select("term", prefix.alias("prefix"), local.alias("local_name"))


def hash_partition(spark: SparkSession, d: str) -> DataFrame:
    terms = _occ(spark, d).select("term").distinct()
    return terms.groupBy(hashes.bucket(F.col("term"), 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first_term"))


def range_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return part.boundaries(_occ(spark, d).select("term").distinct(), "term", 8)


def range_partition(spark: SparkSession, d: str) -> DataFrame:
    terms = materialize(_occ(spark, d).select("term").distinct())
    return part.assign(terms, "term", part.boundaries(terms, "term", 8)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def external_sort(spark: SparkSession, d: str) -> DataFrame:
    """The distinct encoded triples with their place in (s, p, o) order."""
    return dic.dense_ids(enc.distinct_spo(_encoded(spark, d)), ["s", "p", "o"], "place")


def dbj2_hash(spark: SparkSession, d: str) -> DataFrame:
    terms = statements(spark, d).select(F.col("p").alias("term")).distinct()
    return terms.select("term", hashes.polynomial_hash(F.col("term")).alias("hash"))


def string_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("term")
    return _occ(spark, d).select("term").distinct().agg(
        F.count_if(t.startswith("<http://")).alias("n_iri"), F.count_if(t.endswith("@en")).alias("n_en"), F.count_if(t.contains("/class/")).alias("n_class"), F.count_if(t < "<").alias("n_before")
    )


def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    pairs = statements(spark, d).select("s", "o").distinct()
    return pairs.select("s", "o", strings.common_prefix(F.col("s"), F.col("o")).alias("n_bytes"))


def leading_zeros(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).select("triple_id", strings.leading_zeros(F.col("triple_id")).alias("zeros_64"), strings.leading_zeros(F.col("triple_id"), 32).alias("zeros_32"))


def varint_length(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "class_nodes").where(F.col("node_key").isNotNull()).select("node_key").distinct()
    return keys.select("node_key", strings.varint_bytes(F.col("node_key")).alias("n_varint"), strings.fixed_bytes(F.col("node_key")).alias("n_fixed"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "file_infos").where(F.col("file_path").isNotNull()).select("file_path").distinct()
    return paths.withColumns(strings.path_parts(F.col("file_path")))


def _written(spark: SparkSession) -> str:
    """A new folder for what a query writes and reads back."""
    path = f"{shared_dir(spark)}/quillgraph-{uuid.uuid4().hex}"
    if not hasattr(spark, "_quillgraph_tables"):
        spark._quillgraph_tables = []
    spark._quillgraph_tables.append(path)
    return path


def dict_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary written as text in gzip and read again."""
    at = _written(spark)
    stores.write_dictionary_text(dic.lexicographic(_occ(spark, d)), at)
    return stores.read_dictionary_text(spark, at)


def triples_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    at = _written(spark)
    stores.write_triples_text(_encoded(spark, d), at)
    return stores.read_triples_text(spark, at)


def permutations_written(spark: SparkSession, d: str) -> DataFrame:
    """Two orders of the triples from the files of all six."""
    at = _written(spark)
    stores.write_permutations(_encoded(spark, d), at, rows_per_file=10_000)
    out = [stores.read_permutation(spark, at, p).withColumn("perm", F.lit(p)) for p in ("pos", "osp")]
    return out[0].unionByName(out[1]).select("perm", "c0", "c1", "c2")


def sorted_runs_written(spark: SparkSession, d: str) -> DataFrame:
    """Per file of sorted runs whether it is sorted and short, and over all files the rows."""
    at = _written(spark)
    stores.write_sorted_runs(enc.distinct_spo(_encoded(spark, d)), at, ["s", "p", "o"], 5_000)
    rows = spark.read.parquet(at).withColumn("file", F.input_file_name())
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "p", "o")).alias("first"), F.max(F.struct("s", "p", "o")).alias("last"))
    after = F.lead("first").over(Window.orderBy("first"))
    return files.withColumn("after", after).agg(
        F.sum("n").alias("n_rows"), F.bool_and(F.col("n") <= 5_000).alias("all_short"), F.bool_and(F.coalesce(F.col("last") < F.col("after"), F.lit(True))).alias("all_disjoint")
    )


def taxonomy_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    at = _written(spark)
    stores.write_taxonomy_text(sch.taxonomy_lines(_taxonomy(_schema(spark, d))), at)
    ids, parents = stores.read_taxonomy_text(spark, at)
    return ids.join(parents, "class")


def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the class tree as a DOT graph."""
    at = _written(spark)
    stores.write_graph_dot(_taxonomy(_schema(spark, d)), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


def _lines_of(spark, d):
    return statements(spark, d).select(nt.serialize(F.col("s"), F.col("p"), F.col("o")).alias("value"))


def _read_compressed(spark, d, codec):
    at = _written(spark)
    _lines_of(spark, d).write.option("compression", codec).text(at)
    return nt.read_ntriples(spark, at).distinct()


def ntriples_gzip(spark: SparkSession, d: str) -> DataFrame:
    """The statements written as N-Triples in gzip and read again."""
    return _read_compressed(spark, d, "gzip")


def ntriples_bzip2(spark: SparkSession, d: str) -> DataFrame:
    return _read_compressed(spark, d, "bzip2")


def input_files(spark: SparkSession, d: str) -> DataFrame:
    """Written files by kind: how many are compressed and hold anything, and whether the listing agrees."""
    at = _written(spark)
    lines = materialize(_lines_of(spark, d))
    for codec in ("gzip", "none"):
        lines.repartition(3).write.mode("append").option("compression", codec).text(at)
    stats = splits.input_stats(spark, at).where(F.col("path").contains("part-"))
    listed = len([f for f, _ in splits.list_files(spark, at, "part-")])
    return stats.groupBy("compressed").agg(F.count(F.lit(1)).alias("n_files"), F.bool_and(F.col("size") > 0).alias("all_filled"), F.lit(listed).cast("long").alias("n_listed"))


def input_splits(spark: SparkSession, d: str) -> DataFrame:
    """Files (the entries' ends make their sizes) cut into ranges of a 16th of all bytes."""
    t = table(spark, d, "file_infos").where(F.col("file_id").isNotNull())
    files = t.groupBy(F.col("file_id").alias("path")).agg(F.max(F.col("file_start") + F.col("file_size")).alias("size"), F.bool_and("splittable").alias("splittable"))
    return splits.cut_ranges(files, 16).withColumnRenamed("path", "file_id")


def sketch_widths(spark: SparkSession, d: str) -> DataFrame:
    """Counters that inputs of the sizes of ``file_infos`` get: for all together, and compressed."""
    n = table(spark, d, "file_infos").select("entry_id", "file_size").distinct().agg(F.sum("file_size")).first()[0] or 0
    rows = [(f, c, sk.counters_for_input(int(n * f), POPULAR, compressed=c)) for f in (1, 1000, 1000_000) for c in (False, True)]
    return spark.createDataFrame(rows, "factor long, compressed boolean, width long")


def cms_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms with the greatest count-min estimates, kept in bounded memory."""
    occ = _occ(spark, d)
    return sk.count_min_top(occ, sk.count_min(occ, WIDTH), WIDTH, 100)


def mg_recall(spark: SparkSession, d: str) -> DataFrame:
    """Terms with at least 1/200 of the occurrences, and how many of them each top-k sketch (in one, and united of two) and its rescored candidates lack."""
    occ = materialize(_occ(spark, d))
    freq = dic.term_frequency(occ)
    total = occ.count()
    heavy = materialize(freq.where(F.col("freq") * 200 >= total).select("term"))
    one = sk.top_k_sketch(occ, 400)
    two = sk.united_top_k(sk.top_k_state(occ.withColumn("half", F.pmod("triple_id", F.lit(2))), "half"), 400)
    rescored = sk.rescored_candidates(occ, 400, WIDTH, 1)
    missing = [heavy.join(F.broadcast(x.select("term").limit(400)), "term", "left_anti").count() for x in (one, two, rescored)]
    return spark.createDataFrame([(heavy.count(), *missing)], "n_heavy long, missing_one long, missing_united long, missing_rescored long")


def approx_distinct_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per predicate the exact number of distinct objects, and whether the estimate is within five of its standard errors."""
    t = materialize(statements(spark, d))
    exact = t.groupBy("p").agg(F.countDistinct("o").alias("n_exact"))
    both = exact.join(sk.approx_distinct(t, "o", "p", 0.02), "p")
    return both.select("p", "n_exact", (F.abs(F.col("n_approx") - F.col("n_exact")) <= 1 + 5 * 0.02 * F.col("n_exact")).alias("within"))


def distinct_sketches_checked(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of distinct terms and subjects, and whether the estimates, the latter united of stored sketches, are near."""
    t, occ = materialize(statements(spark, d)), _occ(spark, d)
    n_terms, n_s = occ.agg(F.countDistinct("term")).first()[0], t.agg(F.countDistinct("s")).first()[0]
    terms, united = sk.approx_distinct(occ, "term").first()[0], sk.united_distinct(sk.distinct_sketch(t, "s", "p")).first()[0]
    return spark.createDataFrame([(n_terms, abs(terms - n_terms) <= 0.1 * n_terms, n_s, abs(united - n_s) <= 0.1 * n_s)], "n_terms long, terms_within boolean, n_s long, s_within boolean")


def dict_hash_murmur(spark: SparkSession, d: str) -> DataFrame:
    """Hash ids by the 56 bits of a 128-bit hash: as many ids as terms (less conflicts), all in range, and the hash of every term the same when it is computed alone."""
    words = materialize(dic.hashed(_occ(spark, d), murmur.murmur3_56_column))
    return words.agg(F.count(F.lit(1)).alias("n_terms"), F.countDistinct("id").alias("n_ids"), F.bool_and(F.col("id").between(0, (1 << 56) - 1)).alias("in_range"))


def murmur_32(spark: SparkSession, d: str) -> DataFrame:
    """The 32-bit hash of every predicate, over its UTF-8 bytes."""
    terms = statements(spark, d).select(F.col("p").alias("term")).distinct()
    return terms.select("term", murmur.murmur3_32_column(F.col("term")).alias("hash"))


def murmur_known(spark: SparkSession, d: str) -> DataFrame:
    """Published values of the 32-bit and 128-bit hashes."""
    texts = spark.createDataFrame([("",), ("hello",), ("The quick brown fox jumps over the lazy dog",)], "term string")
    both = murmur.murmur3_128_column(F.col("term"))
    return texts.select("term", murmur.murmur3_32_column(F.col("term")).alias("h32"), both["low"].alias("low"), both["high"].alias("high"))


def byte_hashes(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a and times-33 hashes of terms (subjects and predicates), in 32 and 56 bits."""
    t = statements(spark, d)
    terms = t.select(F.col("p").alias("term")).unionByName(spark.createDataFrame([("",), ("é",), ("漢字\U0001f600",), ("naïve café",)], "term string")).distinct()
    x = F.col("term")
    return terms.select("term", hashes.fnv1a_32(x).alias("fnv_32"), hashes.fnv1a_56(x).alias("fnv_56"), hashes.times33_32(x).alias("times33_32"), hashes.polynomial_hash(x).alias("times33_56"))


def array_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of every array of ``patterns``, nulls left out."""
    arrays = table(spark, d, "patterns").select(F.array_compact("pattern_elements").alias("items")).where(F.col("items").isNotNull()).distinct()
    return arrays.select(F.array_join("items", " ").alias("items"), hashes.hash_array(F.col("items")).alias("hash"))


def bit_positions(spark: SparkSession, d: str) -> DataFrame:
    t = statements(spark, d).select("triple_id")
    return t.select("triple_id", strings.least_set_bit(F.col("triple_id")).cast("int").alias("least_set"), strings.first_zero_bit(F.col("triple_id")).cast("int").alias("first_zero"))


def _numbers(spark, d):
    """Numbers of all lengths, from the keys of ``class_nodes``."""
    keys = table(spark, d, "class_nodes").where(F.col("node_key").isNotNull()).select("node_key").distinct()
    return keys.select("node_key", F.expr("pmod(node_key, shiftleft(1L, cast(node_key % 61 as int)))").alias("x"))


def integer_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Numbers encoded in six ways, as hex digits."""
    x = F.col("x")
    return _numbers(spark, d).select(
        "node_key", F.hex(codecs.varint_column(x)).alias("varint"), F.hex(codecs.varint_column(x, big=True)).alias("varint_big"), F.hex(codecs.fixed_column(x, 8)).alias("fixed"),
        F.hex(codecs.fixed_column(x, 8, little=True)).alias("fixed_little"), F.hex(codecs.sized_column(x)).alias("sized"), F.hex(codecs.headed_column(x, F.lit(1))).alias("headed"),
        strings.vlong_bytes(x).alias("n_sized"),
    )


def integer_codecs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """What six decoders make of the encoded numbers."""
    x = F.col("x")
    value, header = codecs.headed_value(codecs.headed_column(x, F.lit(1)))
    return _numbers(spark, d).select(
        "node_key", codecs.varint_value(codecs.varint_column(x)).alias("varint"), codecs.varint_value(codecs.varint_column(x, big=True), big=True).alias("varint_big"),
        codecs.fixed_value(codecs.fixed_column(x, 8)).alias("fixed"), codecs.fixed_value(codecs.fixed_column(x, 8, little=True), little=True).alias("fixed_little"),
        codecs.sized_value(codecs.sized_column(x)).alias("sized"), value.alias("headed"), header.alias("header"),
    )


def short_iris(spark: SparkSession, d: str) -> DataFrame:
    terms = graph(spark, d).select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()
    return terms.select("term", strings.short_iri(F.col("term")).alias("short"))


def schema_roots(spark: SparkSession, d: str) -> DataFrame:
    return sch.roots(sch.stated_edges(graph(spark, d, sch.VOCABULARY)))


def taxonomy_check(spark: SparkSession, d: str) -> DataFrame:
    g = _schema(spark, d)
    return sch.check_taxonomy(sch.subclass_edges(g), _taxonomy(g))


def class_instances(spark: SparkSession, d: str) -> DataFrame:
    return sch.instances(graph(spark, d, sch.VOCABULARY))


def term_neighbour_class(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return sch.neighbour_class(g, materialize(sch.min_class(materialize(sch.term_classes(g)), _taxonomy(g))))


def range_spread(spark: SparkSession, d: str) -> DataFrame:
    """How many parts of a range partition share a task with another, of terms moved by ranges."""
    terms = materialize(_occ(spark, d).select("term").distinct())
    moved = part.spread(terms, "term", part.boundaries(terms, "term", 4)).withColumn("task", F.spark_partition_id())
    spans = moved.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first_term"))
    return spans.select("part", "n", "first_term")


def pipeline_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of the whole encoding run over the graph."""
    out = pipeline.encode_graph(graph(spark, d), EncodeConfig(top_k=POPULAR))
    return out.dictionary.select("id", "term", "class_id")


def pipeline_triples(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.encode_graph(graph(spark, d), EncodeConfig(top_k=POPULAR)).triples


QUERIES = {
    f.__name__: f
    for f in (
        triples_scan, term_explode, distinct_terms, term_frequency, top_terms, tail_terms, tail_occurrences, popular_threshold, dict_lexicographic, dict_popular_first, dict_no_predicates,
        dict_hash, dict_hash_conflicts, dict_class_clustered, encode_spo, encode_all, encode_no_predicates, encode_hybrid_join, encode_hash, decode_roundtrip, permutations_6, perm_signature,
        incremental_encode, hybrid_dictionary_stats, ntriples_parse, ntriples_invalid_count, ntriples_serialize, ntriples_roundtrip, xsd_string_strip, schema_classes, schema_subclass_edges,
        schema_domains, schema_ranges, class_closure, direct_subclass, taxonomy_tree, taxonomy_postorder, taxonomy_text, term_class_candidates, term_min_class, class_id_ranges, id_to_class,
        class_frequency, mining_transactions, frequent_classes, frequent_pairs, frequent_patterns, sibling_order_by_patterns, cm_estimate, mg_candidates, approx_distinct,
        approx_distinct_by_property, merged_distinct_sketches, sampled_top_terms, prefix_split, hash_partition, range_boundaries, range_partition, external_sort, dbj2_hash, string_predicates,
        common_prefix, leading_zeros, varint_length, path_parts, dict_text_roundtrip, triples_text_roundtrip, permutations_written, sorted_runs_written, taxonomy_text_roundtrip, graph_dot,
        ntriples_gzip, ntriples_bzip2, input_files, input_splits, sketch_widths, cms_top_terms, mg_recall, approx_distinct_checked, distinct_sketches_checked, dict_hash_murmur, murmur_32, murmur_known,
        byte_hashes, array_hash, bit_positions, integer_codecs, integer_codecs_roundtrip, short_iris, schema_roots, taxonomy_check, class_instances, term_neighbour_class, range_spread,
        pipeline_dictionary, pipeline_triples,
    )
}
