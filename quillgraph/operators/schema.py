"""RDFS schema of a graph and the taxonomy of its classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import hierarchy
from quillgraph.session import drop, materialize, materialize_counted

# The vocabulary.
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
SUBCLASS = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
DOMAIN = "<http://www.w3.org/2000/01/rdf-schema#domain>"
RANGE = "<http://www.w3.org/2000/01/rdf-schema#range>"
CLASS = "<http://www.w3.org/2000/01/rdf-schema#Class>"
#: The predicates of the statements that a schema is made of.
VOCABULARY = (TYPE, SUBCLASS, DOMAIN, RANGE)


def explicit_classes(triples: DataFrame) -> DataFrame:
    """(class): objects of type, domain and range; both sides of subClassOf."""
    p = F.col("p")
    objects = triples.where(p.isin(TYPE, DOMAIN, RANGE, SUBCLASS)).select(F.col("o").alias("class"))
    return objects.unionByName(triples.where(p == SUBCLASS).select(F.col("s").alias("class"))).distinct()


def stated_edges(triples: DataFrame) -> DataFrame:
    """(sub, sup) as stated, without self-loops."""
    rows = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("sub"), F.col("o").alias("sup"))
    return rows.where(F.col("sub") != F.col("sup")).distinct()


def subclass_edges(triples: DataFrame) -> DataFrame:
    """(sub, sup): stated edges, and one from every explicit class to rdfs:Class."""
    top = explicit_classes(triples).where(F.col("class") != CLASS).select(F.col("class").alias("sub"), F.lit(CLASS).alias("sup"))
    return stated_edges(triples).unionByName(top).distinct()


def domains(triples: DataFrame) -> DataFrame:
    """(property, class): of several domains the least."""
    return triples.where(F.col("p") == DOMAIN).groupBy(F.col("s").alias("property")).agg(F.min("o").alias("class"))


def ranges(triples: DataFrame) -> DataFrame:
    """(property, class): of several ranges the least."""
    return triples.where(F.col("p") == RANGE).groupBy(F.col("s").alias("property")).agg(F.min("o").alias("class"))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(sub, sup): all pairs joined by a path of edges; with ``starts`` (sub) only those from these classes.

    Round k adds to the paths of up to 2^k edges those that go on by exactly 2^k more, so a pair of a tree is made
    once and a tree of depth d takes log2(d) rounds; cycles end when a round adds nothing.
    """
    jump = materialize(edges.distinct())
    now, n = materialize_counted(jump if starts is None else jump.join(starts.distinct(), "sub", "left_semi"), F.lit(True))
    before = 0
    while n != before:
        far = jump.select(F.col("sub").alias("sup"), F.col("sup").alias("far"))
        longer = now.join(far, "sup").select("sub", F.col("far").alias("sup"))
        old = now
        before = n
        now, n = materialize_counted(now.unionByName(longer).distinct(), F.lit(True))
        drop(old)
        if n != before:
            jump = materialize(jump.join(far, "sup").select("sub", F.col("far").alias("sup")).distinct())
    return now


def direct_edges(edges: DataFrame) -> DataFrame:
    """(sub, sup): edges that no other superclass of ``sub`` implies.

    Every class has an edge to rdfs:Class, so that one is implied as soon as there is any other; for the rest only what
    can be reached from classes side by side under one class has to be known, not the whole closure. What is above rdfs:Class is
    reached from everything, so paths need not be followed through it.
    """
    stated = materialize(edges.where(F.col("sup") != CLASS))
    several = materialize(stated.groupBy("sub").count().where(F.col("count") > 1).select("sub"))
    beside = materialize(stated.join(several, "sub", "left_semi").withColumnRenamed("sup", "mid"))
    top = edges.sparkSession.createDataFrame([(CLASS,)], "sub string")
    reach = closure(stated, beside.select(F.col("mid").alias("sub")).unionByName(top)).withColumnRenamed("sub", "mid")
    reach = materialize(reach.where(F.col("sup") != CLASS))
    via = beside.join(reach.where(F.col("mid") != CLASS), "mid").where((F.col("mid") != F.col("sup")) & (F.col("mid") != F.col("sub"))).select("sub", "sup")
    above_top = reach.where(F.col("mid") == CLASS).select("sup")
    over = stated.join(above_top, "sup", "left_semi").where(F.col("sub") != CLASS)
    left = stated.join(via.unionByName(over).distinct(), ["sub", "sup"], "left_anti")
    only_top = edges.where(F.col("sup") == CLASS).join(stated.select("sub").distinct(), "sub", "left_anti")
    return left.unionByName(only_top)


def tree(edges: DataFrame) -> DataFrame:
    """(class, parent): for each class the least of its direct superclasses, null for rdfs:Class and members of cycles without one."""
    parents = direct_edges(edges).groupBy(F.col("sub").alias("class")).agg(F.min("sup").alias("parent"))
    nodes = edges.select(F.col("sub").alias("class")).unionByName(edges.select(F.col("sup").alias("class"))).distinct()
    return nodes.join(parents, "class", "left").withColumn("parent", F.when(F.col("class") != CLASS, F.col("parent")))


def roots(edges: DataFrame) -> DataFrame:
    """(class): superclasses without a superclass other than themselves. A sound schema has one; of one that is only cycles there is none."""
    real = edges.where(F.col("sub") != F.col("sup"))
    return edges.select(F.col("sup").alias("class")).distinct().join(real.select(F.col("sub").alias("class")).distinct(), "class", "left_anti")


def check_taxonomy(edges: DataFrame, tax: DataFrame) -> DataFrame:
    """(n_classes, n_numbered, n_outside, n_roots): classes with and without an id, and the roots of the edges."""
    n = tax.agg(F.count(F.lit(1)).alias("n_classes"), F.count("assigned_id").alias("n_numbered"), F.count_if(F.col("assigned_id").isNull()).alias("n_outside"))
    return n.withColumn("n_roots", F.lit(roots(edges).count()).cast("long"))


def taxonomy(tree_df: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(class, parent, height, assigned_id): ids in post-order from 0, the deepest sibling first, then by name.

    With ``order`` (class, position), siblings that have a position come first, by it.

    Only what hangs below rdfs:Class is numbered; other classes have null for height and id. Post-order ids follow from
    the nested-set ranges: the number of nodes before a node in pre-order, less its ancestors, plus its descendants.
    """
    h = materialize(hierarchy.hierarchy(tree_df, "class", "parent", with_path=False, deepest_first=True, first=order and order.select(F.col("class").alias("node"), "position")))
    known = F.col("root_key") == CLASS
    top = h.where(F.col("node_key") == CLASS).select("range_start").first()
    base = top[0] if top else 0
    out = h.select(
        F.col("node_key").alias("class"),
        F.col("parent_key").alias("parent"),
        F.when(known, F.col("height")).alias("height"),
        F.when(known, F.col("range_start") - F.lit(base) - F.col("depth") + F.col("n_descendants")).alias("assigned_id"),
    )
    return out


def taxonomy_lines(tax: DataFrame, class_ranges: DataFrame | None = None) -> DataFrame:
    """(section, line): the text form, ``class TAB id [TAB begin TAB end]`` and ``class TAB parent`` (NULL without)."""
    known = tax.where(F.col("assigned_id").isNotNull())
    if class_ranges is not None:
        spans = class_ranges.select(F.col("class_id").alias("assigned_id"), "begin", "end")
        ids = known.join(spans, "assigned_id", "left")
        first = F.concat_ws("\t", "class", F.col("assigned_id").cast("string"), F.col("begin").cast("string"), F.col("end").cast("string"))
    else:
        ids, first = known, F.concat_ws("\t", "class", F.col("assigned_id").cast("string"))
    second = F.concat_ws("\t", "class", F.coalesce("parent", F.lit("NULL")))
    return ids.select(F.lit("Ranges").alias("section"), first.alias("line")).unionByName(known.select(F.lit("Taxonomy").alias("section"), second.alias("line")))


def term_classes(triples: DataFrame) -> DataFrame:
    """(term, class): classes of a term by its type, the domains of its predicates and the ranges it is object of.

    The maps are small next to the data but not bounded, so they are joined by :func:`hierarchy.lookup`.
    """
    typed = triples.where(F.col("p") == TYPE).select(F.col("s").alias("term"), F.col("o").alias("class"))
    plain = triples.where(F.col("p") != TYPE).select("s", "o", F.col("p").alias("property"))
    dom = hierarchy.lookup(plain, materialize(domains(triples)).withColumnRenamed("class", "d"), "property")
    both = hierarchy.lookup(dom, materialize(ranges(triples)).withColumnRenamed("class", "r"), "property")
    by_domain = both.where(F.col("d").isNotNull()).select(F.col("s").alias("term"), F.col("d").alias("class"))
    by_range = both.where(F.col("r").isNotNull()).select(F.col("o").alias("term"), F.col("r").alias("class"))
    return typed.unionByName(by_domain).unionByName(by_range).distinct()


def min_class(term_class: DataFrame, tax: DataFrame) -> DataFrame:
    """(term, class_id): the least assigned id of its classes, the most specific; terms without one are left out."""
    ids = tax.where(F.col("assigned_id").isNotNull()).select("class", F.col("assigned_id").alias("class_id"))
    found = hierarchy.lookup(term_class, ids, "class")
    return found.where(F.col("class_id").isNotNull()).groupBy("term").agg(F.min("class_id").alias("class_id"))


def neighbour_class(triples: DataFrame, best: DataFrame) -> DataFrame:
    """(term, class_id2): the least class of the terms that are at the other end of a triple with this one, its subject or object.

    ``best`` is (term, class_id). A second class for terms of few statements of their own; terms without any are left out.
    """
    ends = triples.where(F.col("p") != TYPE).select("s", "o").distinct()
    ends = materialize(ends)
    own = best.select(F.col("term").alias("other"), "class_id")
    both = ends.select(F.col("s").alias("term"), F.col("o").alias("other")).unionByName(ends.select(F.col("o").alias("term"), F.col("s").alias("other")))
    found = hierarchy.lookup(both, own, "other").where(F.col("class_id").isNotNull())
    return found.groupBy("term").agg(F.min("class_id").alias("class_id2"))


def instances(triples: DataFrame) -> DataFrame:
    """(class, term): the terms that are stated to be of a class."""
    return triples.where(F.col("p") == TYPE).select(F.col("o").alias("class"), F.col("s").alias("term")).distinct()


def class_ranges(dictionary: DataFrame) -> DataFrame:
    """(class_id, begin, end): the half-open range of ids of each class in a class-clustered dictionary."""
    own = dictionary.where(F.col("class_id").isNotNull())
    return own.groupBy("class_id").agg(F.min("id").alias("begin"), (F.max("id") + 1).alias("end"))


def class_of_id(ids: DataFrame, spans: DataFrame, block: int = 65_536) -> DataFrame:
    """(id, class_id): the range an id lies in, null without; a join on blocks of ids, as ranges don't overlap."""
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    at = ids.withColumn("_b", F.floor(F.col("id") / block))
    on = (at["_b"] == cut["_b"]) & (at["id"] >= cut["begin"]) & (at["id"] < cut["end"])
    return at.join(cut, on, "left").select(at["id"], "class_id")


def class_frequency(term_class: DataFrame) -> DataFrame:
    """(class, freq): terms per class."""
    return term_class.groupBy("class").agg(F.count(F.lit(1)).alias("freq"))
