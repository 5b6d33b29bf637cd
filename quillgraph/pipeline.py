"""The whole encoding run: text in, dictionary, triples and taxonomy out."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import EncodeConfig, Popularity
from quillgraph.functions.murmur import murmur3_56_column
from quillgraph.operators import dictionary as dic
from quillgraph.operators import encode as enc
from quillgraph.operators import patterns as pat
from quillgraph.operators import schema as sch
from quillgraph.operators import sketches as sk
from quillgraph.session import intermediates, materialize
from quillgraph.sources import ntriples, splits, stores

#: Counters of a row of the count-min sketch where neither the options nor the size of the input tell.
SKETCH_WIDTH = 1 << 20
log = logging.getLogger(__name__)


@dataclass
class Encoded:
    """What a run gives."""

    dictionary: DataFrame
    triples: DataFrame
    taxonomy: DataFrame
    class_ranges: DataFrame
    popular: DataFrame  #: (term, freq) of the popular terms, by counts or estimates
    stats: DataFrame  #: see :func:`quillgraph.operators.dictionary.dictionary_stats`
    patterns: DataFrame | None = None  #: (items, freq), if patterns are mined


def popular_terms(occurrences: DataFrame, cfg: EncodeConfig, input_bytes: int | None = None, compressed: bool = False) -> DataFrame:
    """(term, freq) of at most ``top_k`` terms, by the way of finding them that is configured."""
    if cfg.popularity is Popularity.EXACT:
        return dic.top_terms(dic.term_frequency(occurrences), cfg.top_k, min_freq=cfg.min_freq)
    width = cfg.sketch_width or (sk.counters_for_input(input_bytes, cfg.top_k, compressed=compressed) if input_bytes else SKETCH_WIDTH)
    if cfg.popularity is Popularity.TOPK_SKETCH:
        found = sk.rescored_candidates(occurrences, cfg.top_k, width, cfg.min_freq)
    elif cfg.popularity is Popularity.COUNT_MIN:
        counters = materialize(sk.count_min(occurrences, width))
        n_terms = sk.approx_distinct(occurrences, "term").first()[0]
        least = sk.popular_threshold(n_terms, width, counters, max(1, cfg.top_k)).first()[0]
        found = sk.count_min_top(occurrences, counters, width, cfg.top_k, max(least, cfg.min_freq))
    else:
        found = dic.term_frequency(sk.sample_occurrences(occurrences, cfg.sample_per_10000)).withColumnRenamed("freq", "estimate")
    return dic.top_terms(found.withColumnRenamed("estimate", "freq"), cfg.top_k, min_freq=cfg.min_freq)


def _taxonomy(graph: DataFrame, classes: DataFrame, cfg: EncodeConfig) -> tuple[DataFrame, DataFrame | None]:
    """The taxonomy, and the patterns if they are mined: then siblings stand in the order these suggest."""
    edges = materialize(sch.subclass_edges(graph))
    tree = materialize(sch.tree(edges))
    order = found = None
    if cfg.mine_patterns:
        trans = materialize(pat.transactions(classes, materialize(sch.class_frequency(classes)), cfg.max_pattern_length))
        found = materialize(pat.frequent_patterns(trans, cfg.min_support, cfg.max_pattern_length))
        order = materialize(pat.sibling_order(tree, pat.frequent_pairs(trans, cfg.min_support)))
    tax = materialize(sch.taxonomy(tree, order))
    check = sch.check_taxonomy(edges, tax).first()
    log.info("taxonomy: %d classes, %d numbered, %d roots", check.n_classes, check.n_numbered, check.n_roots)
    if check.n_roots != 1 and check.n_classes:
        log.warning("the schema has %d roots; %d classes that don't hang below rdfs:Class have no id", check.n_roots, check.n_outside)
    return tax, found


def encode_graph(triples: DataFrame, cfg: EncodeConfig | None = None, *, input_bytes: int | None = None, compressed: bool = False) -> Encoded:
    """Encode (s, p, o): popular terms first, then the others clustered by class and in the order of their texts."""
    cfg = cfg or EncodeConfig()
    rows = materialize(triples.select("s", "p", "o").withColumn("triple_id", F.monotonically_increasing_id()))
    occ = dic.explode_terms(rows, ignore_predicates=cfg.ignore_predicates)
    graph = rows.select("s", "p", "o")
    classes = materialize(sch.term_classes(graph))
    tax, patterns = _taxonomy(graph, classes, cfg)
    best = materialize(sch.min_class(classes, tax))
    freq = materialize(dic.term_frequency(occ))
    popular = materialize(popular_terms(occ, cfg, input_bytes, compressed))
    head = materialize(dic.popular_ids(popular, cfg.start_counter))
    n_head = head.count()
    log.info("%d popular terms", n_head)
    tail = dic.tail_terms(freq.select("term"), head).join(best, "term", "left")
    order = [F.col("class_id").asc_nulls_last(), F.col("term")]
    if cfg.mine_patterns:
        tail = tail.join(sch.neighbour_class(graph, best), "term", "left")
        order.insert(1, F.col("class_id2").asc_nulls_last())
    rest = dic.dense_ids(tail, order, "id", cfg.start_counter + n_head)
    words = materialize(head.withColumn("class_id", F.lit(None).cast("long")).unionByName(rest.select("id", "term", "class_id")))
    coded = enc.encode_hybrid(rows, head, words.where(F.col("id") >= cfg.start_counter + n_head))
    coded = coded.withColumn("p", F.lit(0).cast("long")) if cfg.ignore_predicates else coded
    spo = coded.select("s", "p", "o")
    return Encoded(words, spo.distinct() if cfg.distinct else spo, tax, sch.class_ranges(words), popular, dic.dictionary_stats(freq, popular), patterns)


def run(spark: SparkSession, source: str, target: str, cfg: EncodeConfig) -> None:
    """Read N-Triples from ``source`` and write everything below ``target``: parquet, and text in gzip. Intermediate tables are deleted in the end."""
    files = splits.list_files(spark, source)
    log.info("%d input files of %d bytes", len(files), sum(n for _, n in files))
    triples = ntriples.read_ntriples(spark, source)
    with intermediates(spark):
        if cfg.hash_ids:
            perms, words = enc.hash_encode(triples, cfg.permutations, murmur3_56_column)
            words.write.mode("overwrite").parquet(f"{target}/dictionary")
            perms.write.mode("overwrite").partitionBy("perm").parquet(f"{target}/permutations")
            return
        out = encode_graph(triples, cfg, input_bytes=sum(n for _, n in files), compressed=any(not splits.is_splittable(f) for f, _ in files))
        out.dictionary.write.mode("overwrite").parquet(f"{target}/dictionary")
        stores.write_dictionary_text(out.dictionary, f"{target}/dict_text")
        triples = materialize(out.triples)
        stores.write_triples_text(triples, f"{target}/triples_text")
        stores.write_permutations(triples, f"{target}/permutations", cfg.permutations)
        if cfg.write_taxonomy:
            stores.write_taxonomy_text(sch.taxonomy_lines(out.taxonomy, out.class_ranges), f"{target}/taxonomy_text")
        if out.patterns is not None:
            out.patterns.write.mode("overwrite").parquet(f"{target}/patterns")
