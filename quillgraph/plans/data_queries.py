"""Queries p5, p6 and p7 with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import badrows, hierarchy, skew
from quillgraph.sources import ntriples
from quillgraph.sources.tables import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return skew.tree_aggregate(table(spark, d, "triples"), ["p", "o"], "s", "seen_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "triples").count()
    return skew.heavy_keys(_terms(spark, d), {"p": rows, "o": rows}, 50).select("pos", "term")


def p5_term_results(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(table(spark, d, "ntriples_lines"), ["file_id", "line_no"]).select("file_id", "line_no")


def p6_rejected(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(table(spark, d, "ntriples_lines"), ["file_id", "line_no"])


def p6_rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rejected lines, and whether each has a reason."""
    return p6_rejected(spark, d).select("file_id", "line_no", "line", (F.length("reason") > 0).alias("has_reason"))


def p6_valid_triples(spark: SparkSession, d: str) -> DataFrame:
    return badrows.accepted(table(spark, d, "ntriples_lines"), ["file_id", "line_no"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_nodes(table(spark, d, "class_nodes"), "node_key", "parent_key")


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "class_nodes"), "node_key", "parent_key", recorded="node_depth")


def p7_top_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node at depth 1."""
    tree = hierarchy.materialize(hierarchy.hierarchy(table(spark, d, "class_nodes"), "node_key", "parent_key", with_path=False))
    return hierarchy.descendants(tree, tree.where(F.col("depth") == 1))


def _whole(spark: SparkSession, d: str, **kw) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "class_nodes"), "node_key", "parent_key", below_cycles=True, **kw)


def p7_whole_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """As p7_hierarchy, with heights and ranges on and below cycles too."""
    return _whole(spark, d, recorded="node_depth")


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node, also of those on and below cycles."""
    tree = hierarchy.materialize(_whole(spark, d, with_path=False))
    return hierarchy.descendants(tree, tree)


QUERIES = {
    f.__name__: f for f in (p5_found, p5_term_results, p6_found, p6_rejected, p6_rejected_lines, p6_valid_triples, p7_found, p7_hierarchy, p7_top_descendants, p7_whole_hierarchy, p7_descendants)
}

_NODES = """
nodes AS (SELECT node_key, min(parent_key) AS parent_key, min(node_depth) AS recorded FROM class_nodes WHERE node_key IS NOT NULL GROUP BY 1),
tree AS (SELECT a.node_key, a.recorded, a.parent_key IS NOT NULL AS had_parent, b.node_key AS parent_key FROM nodes a LEFT JOIN nodes b ON a.parent_key = b.node_key),
walk(node_key, root_key, depth, path) AS (
  SELECT node_key, node_key, CAST(0 AS BIGINT), CAST(node_key AS VARCHAR) FROM tree WHERE parent_key IS NULL
  UNION ALL
  SELECT t.node_key, w.root_key, w.depth + 1, w.path || '/' || CAST(t.node_key AS VARCHAR) FROM tree t JOIN walk w ON t.parent_key = w.node_key)"""

_LINE = ntriples.LINE.replace("'", "''")
_PARSED = f"""
parsed AS (
  SELECT file_id, line_no, line, regexp_matches(line, '{_LINE}') AS fits, regexp_extract(line, '{_LINE}', 1) AS s,
         regexp_extract(line, '{_LINE}', 2) AS p, regexp_extract(line, '{_LINE}', 3) AS o0
  FROM ntriples_lines WHERE line <> '' AND NOT starts_with(line, '#')),
judged AS (
  SELECT *, CASE WHEN ends_with(o0, '{ntriples.XSD_STRING}') THEN left(o0, length(o0) - {len(ntriples.XSD_STRING)}) ELSE o0 END AS o FROM parsed),
cases AS (
  SELECT *, fits AND strlen(s) <= {ntriples.MAX_TERM_BYTES} AND strlen(p) <= {ntriples.MAX_TERM_BYTES} AND strlen(o) <= {ntriples.MAX_TERM_BYTES} AS valid FROM judged)"""

_PAIRS = ",".join(f"SELECT '{k}' AS pos, {k} AS term, s, seen_at FROM triples" for k in "po").replace(",SELECT", " UNION ALL SELECT")

ORACLE = {
    "p5_found": f"""
SELECT pos, term FROM ({_PAIRS}) WHERE term IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM triples)""",
    "p5_term_results": f"""
SELECT pos, term, count(*) AS n_rows, count(DISTINCT s) AS n_s, min(seen_at) AS first_seen, max(seen_at) AS last_seen
FROM ({_PAIRS}) WHERE term IS NOT NULL GROUP BY 1, 2""",
    "p6_found": f"WITH {_PARSED} SELECT DISTINCT file_id, line_no FROM cases WHERE NOT valid",
    "p6_rejected_lines": f"WITH {_PARSED} SELECT file_id, line_no, min(line) AS line, TRUE AS has_reason FROM cases WHERE NOT valid GROUP BY 1, 2",
    "p6_valid_triples": f"WITH {_PARSED} SELECT DISTINCT file_id, line_no, s, p, o FROM cases WHERE valid",
    "p7_hierarchy": f"""
WITH RECURSIVE {_NODES},
keys(node_key, trail) AS (
  SELECT node_key, [node_key] FROM tree WHERE parent_key IS NULL
  UNION ALL SELECT t.node_key, list_append(k.trail, t.node_key) FROM tree t JOIN keys k ON t.parent_key = k.node_key),
above(node_key, anc, dist) AS (
  SELECT node_key, node_key, CAST(0 AS BIGINT) FROM walk
  UNION ALL SELECT a.node_key, t.parent_key, a.dist + 1 FROM above a JOIN tree t ON a.anc = t.node_key WHERE t.parent_key IS NOT NULL),
below AS (SELECT anc AS node_key, max(dist) AS height, count(*) AS size FROM above GROUP BY 1),
ring(node_key, anc) AS (
  SELECT node_key, parent_key FROM tree WHERE parent_key IS NOT NULL
  UNION SELECT r.node_key, t.parent_key FROM ring r JOIN tree t ON r.anc = t.node_key WHERE t.parent_key IS NOT NULL),
cyc AS (SELECT node_key FROM ring WHERE node_key = anc),
pre AS (SELECT node_key, row_number() OVER (ORDER BY trail) AS range_start FROM keys)
SELECT t.node_key, t.parent_key, w.root_key, w.depth, b.height, b.size - 1 AS n_descendants, p.range_start, p.range_start + b.size AS range_end, w.path,
       CASE WHEN c.node_key IS NOT NULL THEN 'cycle' WHEN w.node_key IS NULL THEN 'below_cycle' WHEN t.parent_key IS NOT NULL THEN 'node'
            WHEN t.had_parent THEN 'orphan' ELSE 'top' END AS status,
       b.height = t.recorded AS height_matches
FROM tree t LEFT JOIN walk w USING (node_key) LEFT JOIN below b USING (node_key) LEFT JOIN pre p USING (node_key) LEFT JOIN cyc c USING (node_key)""",
    "p7_found": """
WITH RECURSIVE nodes AS (SELECT node_key, min(parent_key) AS parent_key FROM class_nodes WHERE node_key IS NOT NULL GROUP BY 1),
up(node_key, anc) AS (
  SELECT node_key, parent_key FROM nodes WHERE parent_key IS NOT NULL
  UNION
  SELECT u.node_key, n.parent_key FROM up u JOIN nodes n ON u.anc = n.node_key WHERE n.parent_key IS NOT NULL)
SELECT node_key FROM up WHERE node_key = anc""",
    "p7_top_descendants": f"""
WITH RECURSIVE {_NODES},
down(ancestor_key, node_key) AS (
  SELECT node_key, node_key FROM walk WHERE depth = 1
  UNION ALL SELECT d.ancestor_key, t.node_key FROM tree t JOIN down d ON t.parent_key = d.node_key)
SELECT ancestor_key, node_key FROM down WHERE node_key <> ancestor_key""",
    "p7_whole_hierarchy": f"""
WITH RECURSIVE {_NODES},
ring(node_key, anc) AS (
  SELECT node_key, parent_key FROM tree WHERE parent_key IS NOT NULL
  UNION SELECT r.node_key, t.parent_key FROM ring r JOIN tree t ON r.anc = t.node_key WHERE t.parent_key IS NOT NULL),
cyc AS (SELECT node_key, min(anc) AS head, count(*) - 1 AS others FROM ring GROUP BY 1 HAVING bool_or(node_key = anc)),
spot(node_key, part, trail) AS (
  SELECT t.node_key, CASE WHEN c.head IS NULL THEN 0 ELSE 1 END, [coalesce(c.head, t.node_key)] FROM tree t LEFT JOIN cyc c USING (node_key)
  WHERE t.parent_key IS NULL OR c.head IS NOT NULL
  UNION ALL SELECT t.node_key, s.part, list_append(s.trail, t.node_key) FROM tree t JOIN spot s ON t.parent_key = s.node_key
  WHERE t.node_key NOT IN (SELECT node_key FROM cyc)),
pos AS (SELECT node_key, dense_rank() OVER (ORDER BY part, trail) AS range_start FROM spot),
above(node_key, anc, dist) AS (
  SELECT node_key, node_key, CAST(0 AS BIGINT) FROM tree WHERE node_key NOT IN (SELECT node_key FROM cyc)
  UNION ALL SELECT a.node_key, t.parent_key, a.dist + 1 FROM above a JOIN tree t ON a.anc = t.node_key
  WHERE t.parent_key IS NOT NULL AND t.node_key NOT IN (SELECT node_key FROM cyc)),
below AS (SELECT coalesce(c.head, a.anc) AS head, max(a.dist) AS height, count(*) + CASE WHEN any_value(c.head) IS NULL THEN 0 ELSE 1 END AS size
          FROM above a LEFT JOIN cyc c ON a.anc = c.node_key GROUP BY 1)
SELECT t.node_key, t.parent_key, w.root_key, w.depth, CASE WHEN c.head IS NULL THEN b.height END AS height, coalesce(b.size, 1) - 1 + coalesce(c.others, 0) AS n_descendants,
       p.range_start, p.range_start + coalesce(b.size, 1) AS range_end, w.path,
       CASE WHEN c.head IS NOT NULL THEN 'cycle' WHEN w.node_key IS NULL THEN 'below_cycle' WHEN t.parent_key IS NOT NULL THEN 'node'
            WHEN t.had_parent THEN 'orphan' ELSE 'top' END AS status,
       CASE WHEN c.head IS NULL THEN b.height = t.recorded END AS height_matches
FROM tree t LEFT JOIN walk w USING (node_key) LEFT JOIN cyc c USING (node_key) JOIN pos p USING (node_key) LEFT JOIN below b ON b.head = coalesce(c.head, t.node_key)""",
    "p7_descendants": f"""
WITH RECURSIVE {_NODES},
down(ancestor_key, node_key) AS (
  SELECT parent_key, node_key FROM tree WHERE parent_key IS NOT NULL
  UNION SELECT d.ancestor_key, t.node_key FROM tree t JOIN down d ON t.parent_key = d.node_key)
SELECT ancestor_key, node_key FROM down WHERE node_key <> ancestor_key""",
}
