"""Queries of the operators for training data, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import distinct_runs, garbled, heavy_hitters, leaks, mixing, pair_counts, pieces
from quillgraph.sources.tables import table


def _p1(spark: SparkSession, d: str, **kw) -> DataFrame:
    t = table(spark, d, "triples")
    dims = {"day": F.to_date("seen_at"), "graph_name": F.col("graph_name"), "p": F.col("p")}
    out = distinct_runs.distinct_counts(t, dims, {"s": F.col("s"), "o": F.col("o")}, **kw)
    return out.withColumn("day", F.to_date("day"))


def p1_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)


def p1_merged_loads(spark: SparkSession, d: str) -> DataFrame:
    """The same from two partial loads (rows loaded up to the middle of the month, and after) put together."""
    return _p1(spark, d, parts=F.dayofmonth("loaded_at") <= 15)


def _p2(spark: SparkSession, d: str, **kw) -> tuple[DataFrame, int]:
    return pair_counts.cooccurrence(table(spark, d, "patterns"), "pattern_id", "pattern_elements", "support", **kw)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items below N / 200 or in fewer than 4 patterns can't be in a case, so they are left out before pairing."""
    rows = table(spark, d, "patterns")
    n = pair_counts.baskets(rows, "pattern_id", "pattern_elements", "support").agg(F.sum("weight")).first()[0] or 0
    pairs, total = _p2(spark, d, min_item_weight=-(-n // 200), min_item_baskets=4)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    case = (F.col("n_baskets") >= 4) & (big("n_ab") * 200 >= total) & (big("n_ab") * F.lit(total).cast("decimal(19,0)") >= big("n_a") * big("n_b") * 4)
    return pairs.where(case).select("item_a", "item_b")


def p2_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = pieces.split_entries(table(spark, d, "file_infos"), table(spark, d, "ntriples_lines"))
    return out.withColumn("piece_no", F.col("piece_no").cast("int"))


def p3_bisection(spark: SparkSession, d: str) -> DataFrame:
    return pieces.bisect_entries(table(spark, d, "file_infos"), table(spark, d, "ntriples_lines"))


_COLUMNS = {"occurrences": "term", "dict_pairs": "dict_value"}


def _p4(spark: SparkSession, d: str, share: int) -> DataFrame:
    parts = [heavy_hitters.frequent_terms(table(spark, d, t), c, share).withColumn("src_table", F.lit(t)) for t, c in _COLUMNS.items()]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d, 250).select("src_table", "term")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d, 250)


def p4_exact_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the second scan, and whether the sketch's estimates are within six of their standard errors."""
    near = F.abs(F.col("estimate") - F.col("n_rows")) <= 6 * F.col("error") + 1
    return _p4(spark, d, 250).select("src_table", "term", "n_rows", "total_rows", near.alias("near"))


def p4_many_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms with at least 1/5000 of the rows, far more than one sketch of the first width tells apart."""
    return _p4(spark, d, 5000).select("src_table", "term", "n_rows")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


#: Vocabulary file that problem 9 counts tokens with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=TOKENIZER)


def p9_mix_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0]


def p9_mix_report(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether its share is met within a hundredth, no document is taken too often, and all documents taken are its own."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sample, report = _p9(spark, d)
    held = docs.select("doc_id", "source").distinct().withColumn("own", F.lit(True))
    taken = sample.join(held, ["doc_id", "source"], "left").groupBy("source").agg(F.bool_and(F.coalesce("own", F.lit(False))).alias("own"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    both = report.join(taken, "source", "left")
    return targets.select("source").join(both, "source", "left").select(
        "source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01).alias("share_met"), (F.coalesce("most_copies", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"),
        F.coalesce(F.col("own") & (F.col("n") == F.col("n_docs")), F.lit(True)).alias("all_own"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_distinct_counts, p1_merged_loads, p2_found, p2_cooccurrence, p3_found, p3_bisection, p4_found, p4_counts, p4_exact_counts, p4_many_terms, p8_found, p9_mix_sample, p9_mix_report, p9_checks, p10_found, p10_restored)
}

_P1 = """
WITH t AS (SELECT CAST(seen_at AS DATE) AS day, graph_name, p, s, o FROM triples)
SELECT CAST(7 - grouping(p, graph_name, day) AS INTEGER) AS grouped_by, day, graph_name, p, n_s, n_o,
       CASE WHEN n_s > 0 THEN CAST(n_s AS DOUBLE) * CAST(n_s - 1 AS DOUBLE) / 2.0 / 18446744073709551616.0 ELSE 0.0 END AS collisions_s,
       CASE WHEN n_o > 0 THEN CAST(n_o AS DOUBLE) * CAST(n_o - 1 AS DOUBLE) / 2.0 / 18446744073709551616.0 ELSE 0.0 END AS collisions_o
FROM (SELECT day, graph_name, p, count(DISTINCT s) AS n_s, count(DISTINCT o) AS n_o, grouping(p, graph_name, day) AS g FROM t
      GROUP BY CUBE (day, graph_name, p) HAVING count(s) + count(o) > 0)""".replace(
    "CAST(7 - grouping(p, graph_name, day) AS INTEGER)", "CAST(7 - g AS INTEGER)"
)

_P2 = """
WITH baskets AS (SELECT pattern_id, max(support) AS w, any_value(pattern_elements) AS items FROM patterns WHERE support > 0 GROUP BY 1),
item AS (SELECT DISTINCT pattern_id, w, unnest(items) AS item FROM baskets),
one AS (SELECT item, sum(w) AS n FROM item WHERE item IS NOT NULL GROUP BY 1),
total AS (SELECT CAST(sum(w) AS DOUBLE) AS n FROM baskets),
pair AS (SELECT a.item AS item_a, b.item AS item_b, CAST(sum(a.w) AS BIGINT) AS n_ab, count(*) AS n_baskets
         FROM item a JOIN item b ON a.pattern_id = b.pattern_id AND a.item < b.item GROUP BY 1, 2),
full_pair AS (SELECT p.*, CAST(x.n AS BIGINT) AS n_a, CAST(y.n AS BIGINT) AS n_b, t.n AS n FROM pair p JOIN one x ON x.item = item_a JOIN one y ON y.item = item_b, total t)
"""

_P3 = """WITH RECURSIVE one AS (SELECT entry_id, min(file_id) AS file_id, min(file_start) AS file_start, min(file_size) AS file_size FROM file_infos
  WHERE splittable AND entry_id IS NOT NULL AND file_start IS NOT NULL GROUP BY 1),
ln AS (SELECT file_id, byte_start AS b, byte_start + min(strlen(line)) + 1 AS e, arg_min(line, strlen(line)) AS line FROM ntriples_lines WHERE line IS NOT NULL AND byte_start IS NOT NULL GROUP BY 1, 2),
own AS (SELECT entry_id, b, e, line FROM one JOIN ln USING (file_id)
  WHERE (b > file_start AND (file_size IS NULL OR b <= file_start + file_size)) OR (b = 0 AND file_start = 0)),
ent AS (SELECT entry_id, min(b) AS a, max(e) AS z FROM own GROUP BY 1 HAVING sum(e - b) > 4096),
big AS (SELECT own.* FROM own JOIN ent USING (entry_id)),
marks AS (SELECT entry_id, b + strlen(left(line, CAST(i AS INTEGER))) AS pos FROM (SELECT entry_id, b, line, unnest(range(0, length(line) + 1)) AS i FROM big WHERE e - b > 3800)),
piece(entry_id, piece_no, s, before, e, at_line) AS (
  SELECT x.entry_id, 1, a, a, CASE WHEN z <= a + 4096 THEN z WHEN n.e IS NOT NULL THEN n.e ELSE m.pos END, z <= a + 4096 OR n.e IS NOT NULL
  FROM ent x LEFT JOIN (SELECT o.entry_id, max(o.e) AS e FROM big o JOIN ent y USING (entry_id) WHERE o.e <= y.a + 4096 GROUP BY 1) n USING (entry_id)
  LEFT JOIN (SELECT o.entry_id, max(pos) AS pos FROM marks o JOIN ent y USING (entry_id) WHERE pos <= y.a + 4096 GROUP BY 1) m USING (entry_id)
  UNION ALL
  SELECT entry_id, piece_no, s, before, CASE WHEN z <= s + 4096 THEN z WHEN e IS NOT NULL THEN e ELSE pos END, z <= s + 4096 OR e IS NOT NULL FROM (
    SELECT q.entry_id, q.piece_no, q.s, q.before, q.z,
      (SELECT max(o.e) FROM big o WHERE o.entry_id = q.entry_id AND o.e <= q.s + 4096 AND o.e > q.before AND o.e > q.s) AS e,
      (SELECT max(o.pos) FROM marks o WHERE o.entry_id = q.entry_id AND o.pos <= q.s + 4096) AS pos
    FROM (SELECT p.entry_id, p.piece_no + 1 AS piece_no, p.e AS before, x.z,
        CASE WHEN p.at_line THEN (SELECT min(o.b) FROM big o WHERE o.entry_id = p.entry_id AND o.b > p.s AND o.b >= p.e - 256)
             ELSE greatest((SELECT max(o.pos) FROM marks o WHERE o.entry_id = p.entry_id AND o.pos <= p.e - 256), p.s + 1) END AS s
      FROM piece p JOIN ent x USING (entry_id) WHERE p.e < x.z) q) r)
SELECT entry_id, CAST(piece_no AS INTEGER) AS piece_no, s AS piece_start, e AS piece_end FROM piece"""

_P4 = " UNION ALL ".join(
    f"SELECT '{t}' AS src_table, {c} AS term FROM {t} WHERE {c} IS NOT NULL GROUP BY 2 HAVING count(*) * 250 >= (SELECT count({c}) FROM {t})"
    for t, c in _COLUMNS.items()
)

_P4_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS src_table, {c} AS term, count(*) AS n_rows, (SELECT count({c}) FROM {t}) AS total_rows, TRUE AS near FROM {t} WHERE {c} IS NOT NULL GROUP BY 2 HAVING count(*) * {{share}} >= (SELECT count({c}) FROM {t})"
    for t, c in _COLUMNS.items()
)

ORACLE = {
    "p3_found": _P3,
    "p4_found": _P4,
    "p4_exact_counts": _P4_COUNTS.format(share=250),
    "p4_many_terms": f"SELECT src_table, term, n_rows FROM ({_P4_COUNTS.format(share=5000)})",
    "p9_checks": "SELECT source, TRUE AS share_met, TRUE AS cap_kept, TRUE AS all_own FROM mix_targets",
    "p1_distinct_counts": _P1,
    "p1_merged_loads": _P1,
    "p2_found": _P2 + "SELECT item_a, item_b FROM full_pair WHERE n_baskets >= 4 AND 200 * n_ab >= n AND n_ab * n >= 4 * CAST(n_a AS DOUBLE) * n_b",
    "p2_cooccurrence": _P2
    + """SELECT item_a, item_b, n_a, n_b, n_ab, n_baskets, CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE)) AS lift,
  (n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)) AS odds_ratio,
  sqrt(1.0 / (n_ab + 0.5) + 1.0 / (n_a - n_ab + 0.5) + 1.0 / (n_b - n_ab + 0.5) + 1.0 / (n - n_a - n_b + n_ab + 0.5)) AS log_odds_error FROM full_pair""",
}
