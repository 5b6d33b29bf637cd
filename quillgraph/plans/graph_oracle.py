"""SQL for the queries of the encoding engine."""

from __future__ import annotations

from quillgraph.operators import schema as sch
from quillgraph.plans.graph_queries import _NS, POPULAR, TBOX, WIDTH
from quillgraph.sources import ntriples as nt

_T = "t AS (SELECT triple_id, min(s) AS s, min(p) AS p, min(o) AS o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL GROUP BY 1)"
_OCC = _T + ", occ AS (SELECT triple_id, 0 AS pos, s AS term FROM t UNION ALL SELECT triple_id, 1, p FROM t UNION ALL SELECT triple_id, 2, o FROM t)"
_TERMS = _OCC + ", terms AS (SELECT DISTINCT term FROM occ)"
_FREQ = _OCC + ", freq AS (SELECT term, count(*) AS freq FROM occ GROUP BY 1)"
_TOP = _FREQ + f", top AS (SELECT term, freq FROM freq ORDER BY freq DESC, term LIMIT {POPULAR})"
_TOPB = _FREQ + f""", topb AS (SELECT term, freq FROM freq ORDER BY freq DESC, term DESC LIMIT {POPULAR}),
headb AS (SELECT row_number() OVER (ORDER BY freq DESC, term DESC) - 1 AS id, term FROM topb),
dictb AS (SELECT id, term FROM headb UNION ALL
  SELECT row_number() OVER (ORDER BY term) - 1 + (SELECT count(*) FROM headb), term FROM freq WHERE term NOT IN (SELECT term FROM headb))"""
_DICT = _TERMS + ", dict AS (SELECT row_number() OVER (ORDER BY term) - 1 AS id, term FROM terms)"
_ENC = _DICT + ", e AS (SELECT triple_id, a.id AS s, b.id AS p, c.id AS o FROM t JOIN dict a ON t.s = a.term JOIN dict b ON t.p = b.term JOIN dict c ON t.o = c.term)"


def _md5(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 14) AS BIGINT)"


_C = f"'<{_NS}/class/C' || CAST({{}} AS VARCHAR) || '>'"
_ROWS = ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in TBOX)
_G = _T + f""", g AS (SELECT s, p, o FROM t
  UNION ALL SELECT DISTINCT {_C.format('node_key')}, '{sch.SUBCLASS}', {_C.format('parent_key')} FROM class_nodes WHERE node_key IS NOT NULL AND parent_key IS NOT NULL
  UNION ALL SELECT * FROM (VALUES {_ROWS}) v(s, p, o)),
classes AS (SELECT o AS class FROM g WHERE p IN ('{sch.TYPE}', '{sch.DOMAIN}', '{sch.RANGE}', '{sch.SUBCLASS}') UNION SELECT s FROM g WHERE p = '{sch.SUBCLASS}'),
stated AS (SELECT DISTINCT s AS sub, o AS sup FROM g WHERE p = '{sch.SUBCLASS}' AND s <> o),
edges AS (SELECT sub, sup FROM stated UNION SELECT class, '{sch.CLASS}' FROM classes WHERE class <> '{sch.CLASS}'),
doms AS (SELECT s AS property, min(o) AS class FROM g WHERE p = '{sch.DOMAIN}' GROUP BY 1),
rngs AS (SELECT s AS property, min(o) AS class FROM g WHERE p = '{sch.RANGE}' GROUP BY 1),
tc AS (SELECT s AS term, o AS class FROM g WHERE p = '{sch.TYPE}'
  UNION SELECT g.s, d.class FROM g JOIN doms d ON g.p = d.property WHERE g.p <> '{sch.TYPE}'
  UNION SELECT g.o, r.class FROM g JOIN rngs r ON g.p = r.property WHERE g.p <> '{sch.TYPE}'),
cfreq AS (SELECT class, count(*) AS freq FROM tc GROUP BY 1),
ranked AS (SELECT term, tc.class, row_number() OVER (PARTITION BY term ORDER BY f.freq DESC, tc.class) AS k FROM tc JOIN cfreq f ON tc.class = f.class),
items AS (SELECT term, class AS item, k FROM ranked WHERE k <= 3)"""
_TAX = _G + f""",
reach(sub, sup) AS (SELECT sub, sup FROM edges UNION SELECT r.sub, e.sup FROM reach r JOIN edges e ON r.sup = e.sub),
implied AS (SELECT DISTINCT m.sub, r.sup FROM edges m JOIN reach r ON r.sub = m.sup WHERE m.sup <> r.sup AND m.sup <> m.sub),
direct AS (SELECT e.sub, e.sup FROM edges e LEFT JOIN implied i ON e.sub = i.sub AND e.sup = i.sup WHERE i.sub IS NULL),
nodes AS (SELECT sub AS class FROM edges UNION SELECT sup FROM edges),
tree AS (SELECT n.class, CASE WHEN n.class <> '{sch.CLASS}' THEN min(d.sup) END AS parent FROM nodes n LEFT JOIN direct d ON d.sub = n.class GROUP BY n.class),
down(class, depth) AS (SELECT class, 0 FROM tree WHERE class = '{sch.CLASS}' UNION ALL SELECT t.class, d.depth + 1 FROM tree t JOIN down d ON t.parent = d.class),
above(class, anc, dist) AS (SELECT class, class, CAST(0 AS BIGINT) FROM down UNION ALL SELECT a.class, t.parent, a.dist + 1 FROM above a JOIN tree t ON a.anc = t.class WHERE t.parent IS NOT NULL),
sizes AS (SELECT anc AS class, max(dist) AS height, count(*) AS size FROM above GROUP BY 1),
trail(class, keys, depth) AS (
  SELECT class, [CAST('' AS VARCHAR)], 0 FROM tree WHERE class = '{sch.CLASS}'
  UNION ALL SELECT t.class, list_append(r.keys, lpad(CAST(99999 - z.height AS VARCHAR), 5, '0') || t.class), r.depth + 1
  FROM tree t JOIN trail r ON t.parent = r.class JOIN sizes z ON z.class = t.class),
numbered AS (SELECT class, row_number() OVER (ORDER BY keys) - 1 AS pre, depth FROM trail),
tax AS (SELECT t.class, t.parent, z.height, n.pre - n.depth + z.size - 1 AS assigned_id FROM tree t LEFT JOIN numbered n ON n.class = t.class LEFT JOIN sizes z ON z.class = t.class),
best AS (SELECT tc.term, min(x.assigned_id) AS class_id FROM tc JOIN tax x ON x.class = tc.class WHERE x.assigned_id IS NOT NULL GROUP BY 1)"""
_CLUSTER = _TAX + _TOP.removeprefix(_T) + """,
head AS (SELECT row_number() OVER (ORDER BY freq DESC, term) - 1 AS id, term FROM top),
clustered AS (SELECT id, term, CAST(NULL AS BIGINT) AS class_id FROM head UNION ALL
  SELECT row_number() OVER (ORDER BY b.class_id ASC NULLS LAST, f.term) - 1 + (SELECT count(*) FROM head), f.term, b.class_id
  FROM freq f LEFT JOIN best b ON b.term = f.term WHERE f.term NOT IN (SELECT term FROM head)),
spans AS (SELECT class_id, min(id) AS begin, max(id) + 1 AS "end" FROM clustered WHERE class_id IS NOT NULL GROUP BY 1)"""
#: The same over all statements of the graph, as the whole encoding run takes them.
_RUN = _TAX + ", gocc AS (SELECT s AS term FROM g UNION ALL SELECT p FROM g UNION ALL SELECT o FROM g), freq AS (SELECT term, count(*) AS freq FROM gocc GROUP BY 1)" + _CLUSTER.removeprefix(_TAX)[
    len(_TOP.removeprefix(_T)) - len(_TOP.removeprefix(_FREQ)) :
]
_X = """k AS (SELECT DISTINCT node_key FROM class_nodes WHERE node_key IS NOT NULL),
x AS (SELECT node_key, node_key % (CAST(1 AS BIGINT) << (node_key % 61)) AS x FROM k)"""
_CM = " UNION ALL ".join(f"SELECT {r} AS r, term, {_md5(f"'{r}:' || term")} % {WIDTH} AS cell FROM occ" for r in range(3))
_CMT = f", cells AS ({_CM}), counters AS (SELECT r, cell, count(*) AS n FROM cells GROUP BY 1, 2)"
_LINE = nt.LINE.replace("'", "''")
_STRIP = f"CASE WHEN ends_with({{0}}, '{nt.XSD_STRING}') THEN left({{0}}, length({{0}}) - {len(nt.XSD_STRING)}) ELSE {{0}} END"
_PARSE = f"""
d AS (SELECT file_id, line_no, regexp_extract(line, '{_LINE}', 1) AS s, regexp_extract(line, '{_LINE}', 2) AS p, regexp_extract(line, '{_LINE}', 3) AS o0
      FROM ntriples_lines WHERE line <> '' AND NOT starts_with(line, '#')),
n AS (SELECT file_id, line_no, s, p, {_STRIP.format('o0')} AS o FROM d),
v AS (SELECT *, {" AND ".join(f"strlen({c}) BETWEEN 1 AND {nt.MAX_TERM_BYTES}" for c in "spo")} AS valid FROM n)"""
_NAME = "regexp_extract(file_path, '[^/]*$')"

ORACLE = {
    "triples_scan": f"WITH {_T} SELECT * FROM t",
    "term_explode": f"WITH {_OCC} SELECT triple_id, CAST(pos AS TINYINT) AS pos, term, triple_id * 4 + pos AS origin FROM occ",
    "distinct_terms": f"WITH {_TERMS} SELECT term FROM terms",
    "term_frequency": f"WITH {_FREQ} SELECT * FROM freq",
    "top_terms": f"WITH {_TOP} SELECT * FROM top",
    "tail_terms": f"WITH {_TOP} SELECT * FROM freq WHERE term NOT IN (SELECT term FROM top)",
    "tail_occurrences": f"""WITH {_TOP}, x AS (
        SELECT triple_id, 0 AS pos, s AS term, {_md5('p')} AS hash_1, {_md5('o')} AS hash_2 FROM t UNION ALL SELECT triple_id, 1, p, {_md5('s')}, {_md5('o')} FROM t
        UNION ALL SELECT triple_id, 2, o, {_md5('s')}, {_md5('p')} FROM t) SELECT * FROM x WHERE term NOT IN (SELECT term FROM top)""",
    "popular_threshold": f"""WITH {_FREQ} {_CMT}, k AS (SELECT r, n, row_number() OVER (PARTITION BY r ORDER BY n DESC) AS i FROM counters),
        kth AS (SELECT r.r, coalesce(max(k.n), 1) AS v FROM (VALUES (0), (1), (2)) r(r) LEFT JOIN k ON k.r = r.r AND k.i = {POPULAR} GROUP BY 1)
        SELECT CAST(greatest(4 * greatest(1, (SELECT count(*) FROM freq) // {WIDTH}), min(v)) AS BIGINT) AS threshold FROM kth""",
    "dict_lexicographic": f"WITH {_DICT} SELECT * FROM dict",
    "dict_popular_first": f"WITH {_TOPB} SELECT * FROM dictb",
    "dict_no_predicates": f"WITH {_OCC}, x AS (SELECT DISTINCT term FROM occ WHERE pos <> 1) SELECT row_number() OVER (ORDER BY term) AS id, term FROM x",
    "dict_hash": f"WITH {_TERMS} SELECT {_md5('term')} AS id, term FROM terms",
    "dict_hash_conflicts": f"WITH {_TERMS}, h AS (SELECT {_md5('term')} % {1 << 20} AS id, term FROM terms) SELECT id, count(*) AS n_terms, min(term) AS term FROM h GROUP BY 1 HAVING count(*) > 1",
    "dict_class_clustered": f"WITH RECURSIVE {_CLUSTER} SELECT * FROM clustered",
    "encode_spo": f"WITH {_ENC} SELECT DISTINCT s, p, o FROM e",
    "encode_all": f"WITH {_ENC} SELECT * FROM e",
    "encode_no_predicates": f"""WITH {_OCC}, x AS (SELECT DISTINCT term FROM occ WHERE pos <> 1), dict AS (SELECT row_number() OVER (ORDER BY term) AS id, term FROM x)
        SELECT triple_id, a.id AS s, CAST(0 AS BIGINT) AS p, c.id AS o FROM t JOIN dict a ON t.s = a.term JOIN dict c ON t.o = c.term""",
    "encode_hybrid_join": f"WITH {_TOPB} SELECT triple_id, a.id AS s, b.id AS p, c.id AS o FROM t JOIN dictb a ON t.s = a.term JOIN dictb b ON t.p = b.term JOIN dictb c ON t.o = c.term",
    "encode_hash": f"""WITH {_T}, h AS (SELECT {_md5('s')} AS s, {_md5('p')} AS p, {_md5('o')} AS o FROM t)
        SELECT 'spo' AS perm, s AS c0, p AS c1, o AS c2 FROM h UNION ALL SELECT 'pso', p, s, o FROM h""",
    "decode_roundtrip": f"WITH {_T} SELECT * FROM t",
    "permutations_6": f"WITH {_ENC} " + " UNION ALL ".join(f"SELECT '{x}' AS perm, {x[0]} AS c0, {x[1]} AS c1, {x[2]} AS c2 FROM e" for x in ("spo", "ops", "pos", "sop", "osp", "pso")),
    "perm_signature": "SELECT CAST(a.i AS INTEGER) AS signature, CAST(b.i AS INTEGER) AS perm FROM range(64) a(i), range(6) b(i) WHERE (a.i >> b.i) & 1 = 1",
    "incremental_encode": f"""WITH {_OCC}, a AS (SELECT DISTINCT term FROM occ WHERE triple_id % 2 = 0), b AS (SELECT DISTINCT term FROM occ WHERE triple_id % 2 <> 0 AND term NOT IN (SELECT term FROM a))
        SELECT row_number() OVER (ORDER BY term) - 1 AS id, term FROM a UNION ALL SELECT row_number() OVER (ORDER BY term) - 1 + (SELECT count(*) FROM a), term FROM b""",
    "hybrid_dictionary_stats": f"""WITH {_TOP} SELECT count(*) AS n_terms, CAST(sum(freq) AS BIGINT) AS n_occurrences, (SELECT CAST(sum(freq) AS BIGINT) FROM top) AS n_popular,
        CAST(sum(freq) // 3 AS BIGINT) AS n_triples FROM freq""",
    "ntriples_parse": f"WITH {_PARSE} SELECT DISTINCT file_id, line_no, s, p, o FROM v WHERE valid",
    "ntriples_invalid_count": f"WITH {_PARSE} SELECT (SELECT count(*) FROM ntriples_lines) - count(*) AS n_skipped, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid FROM v",
    "ntriples_serialize": f"WITH {_T} SELECT triple_id, s || ' ' || p || ' ' || o || ' .' AS line FROM t",
    "ntriples_roundtrip": f"WITH {_T} SELECT triple_id, s, p, {_STRIP.format('o')} AS o FROM t WHERE regexp_matches(s || ' ' || p || ' ' || o || ' .', '{_LINE}')",
    "xsd_string_strip": f"WITH {_T} SELECT triple_id, {_STRIP.format('o')} AS o FROM t",
    "schema_classes": f"WITH {_G} SELECT class FROM classes",
    "schema_subclass_edges": f"WITH {_G} SELECT * FROM edges",
    "schema_domains": f"WITH {_G} SELECT * FROM doms",
    "schema_ranges": f"WITH {_G} SELECT * FROM rngs",
    "class_closure": f"WITH RECURSIVE {_G}, r(sub, sup) AS (SELECT sub, sup FROM stated UNION SELECT r.sub, e.sup FROM r JOIN stated e ON r.sup = e.sub) SELECT * FROM r",
    "direct_subclass": f"WITH RECURSIVE {_TAX} SELECT * FROM direct",
    "taxonomy_tree": f"WITH RECURSIVE {_TAX} SELECT * FROM tree",
    "taxonomy_postorder": f"WITH RECURSIVE {_TAX} SELECT * FROM tax",
    "taxonomy_text": f"""WITH RECURSIVE {_CLUSTER} SELECT 'Ranges' AS section, concat_ws(chr(9), x.class, CAST(x.assigned_id AS VARCHAR), CAST(s.begin AS VARCHAR), CAST(s."end" AS VARCHAR)) AS line
        FROM tax x LEFT JOIN spans s ON s.class_id = x.assigned_id WHERE x.assigned_id IS NOT NULL
        UNION ALL SELECT 'Taxonomy', class || chr(9) || coalesce(parent, 'NULL') FROM tax WHERE assigned_id IS NOT NULL""",
    "term_class_candidates": f"WITH {_G} SELECT * FROM tc",
    "term_min_class": f"WITH RECURSIVE {_TAX} SELECT * FROM best",
    "class_id_ranges": f"WITH RECURSIVE {_CLUSTER} SELECT * FROM spans",
    "id_to_class": f"WITH RECURSIVE {_CLUSTER} SELECT id, class_id FROM clustered",
    "class_frequency": f"WITH {_G} SELECT * FROM cfreq",
    "mining_transactions": f"WITH {_G} SELECT term, string_agg(item, ' ' ORDER BY k) AS items FROM items GROUP BY 1",
    "frequent_classes": f"WITH {_G} SELECT item, count(*) AS freq FROM items GROUP BY 1",
    "frequent_pairs": f"WITH {_G} SELECT a.item AS item_a, b.item AS item_b, count(*) AS freq FROM items a JOIN items b ON a.term = b.term AND a.item < b.item GROUP BY 1, 2 HAVING count(*) > 5",
    "frequent_patterns": f"""WITH {_G}, x AS (SELECT item AS items FROM items UNION ALL SELECT a.item || ' ' || b.item FROM items a JOIN items b ON a.term = b.term AND a.item < b.item
        UNION ALL SELECT a.item || ' ' || b.item || ' ' || c.item FROM items a JOIN items b ON a.term = b.term AND a.item < b.item JOIN items c ON b.term = c.term AND b.item < c.item)
        SELECT items, count(*) AS freq FROM x GROUP BY 1 HAVING count(*) > 5""",
    "cm_estimate": f"""WITH {_TERMS} {_CMT}, one AS (SELECT DISTINCT r, term, cell FROM cells)
        SELECT term, min(n) AS estimate FROM one JOIN counters USING (r, cell) GROUP BY 1""",
    "sampled_top_terms": f"WITH {_OCC} SELECT term, count(*) AS freq FROM occ WHERE {_md5("term || '|' || triple_id || '|' || pos")} % 10000 < 500 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "prefix_split": f"""WITH {_TERMS}, c AS (SELECT term, starts_with(term, '<http://') AND strlen(term) > 10 AS fits, substr(term, 9) AS rest FROM terms),
        k AS (SELECT term, fits, CASE WHEN instr(rest, '#') > 0 THEN instr(rest, '#') ELSE instr(rest, '/') END AS cut FROM c),
        q AS (SELECT term, CASE WHEN fits AND cut > 0 THEN substr(term, 1, cut + 8) ELSE '' END AS prefix FROM k) SELECT term, prefix, substr(term, length(prefix) + 1) AS local_name FROM q""",
    "hash_partition": f"WITH {_TERMS} SELECT CAST({_md5('term')} % 16 AS INTEGER) AS bucket, count(*) AS n, min(term) AS first_term FROM terms GROUP BY 1",
    "range_boundaries": f"""WITH {_DICT}, z AS (SELECT count(*) AS n FROM dict) SELECT CAST(k.i AS INTEGER) AS part, term AS bound FROM range(7) k(i), z, dict WHERE id = z.n * (k.i + 1) // 8 - 1""",
    "range_partition": f"""WITH {_DICT}, z AS (SELECT count(*) AS n FROM dict), b AS (SELECT term AS bound FROM range(7) k(i), z, dict WHERE id = z.n * (k.i + 1) // 8 - 1),
        x AS (SELECT term, (SELECT count(*) FROM b WHERE bound < term) AS part FROM terms) SELECT CAST(part AS INTEGER) AS part, count(*) AS n, min(term) AS first_term, max(term) AS last_term FROM x GROUP BY 1""",
    "external_sort": f"WITH {_ENC}, u AS (SELECT DISTINCT s, p, o FROM e) SELECT s, p, o, row_number() OVER (ORDER BY s, p, o) - 1 AS place FROM u",
    "dbj2_hash": f"""WITH {_T}, u AS (SELECT DISTINCT p AS term FROM t)
        SELECT term, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(term, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (h * 33 + b) % 72057594037927936) AS hash FROM u""",
    "string_predicates": f"""WITH {_TERMS} SELECT count(*) FILTER (WHERE starts_with(term, '<http://')) AS n_iri, count(*) FILTER (WHERE ends_with(term, '@en')) AS n_en,
        count(*) FILTER (WHERE contains(term, '/class/')) AS n_class, count(*) FILTER (WHERE term < '<') AS n_before FROM terms""",
    "common_prefix": f"""WITH {_T}, u AS (SELECT DISTINCT s, o FROM t)
        SELECT s, o, CAST(len(list_filter(range(1, least(length(s), length(o)) + 1), lambda i: left(s, i) = left(o, i))) AS INTEGER) AS n_bytes FROM u""",
    "leading_zeros": f"""WITH {_T} SELECT triple_id, CAST(CASE WHEN triple_id = 0 THEN 64 ELSE 64 - length(bin(triple_id)) END AS INTEGER) AS zeros_64,
        CAST(CASE WHEN triple_id = 0 THEN 32 ELSE 32 - length(bin(triple_id)) END AS INTEGER) AS zeros_32 FROM t""",
    "varint_length": """SELECT DISTINCT node_key, CAST(greatest(1, ceil(length(bin(node_key)) / 7.0)) AS INTEGER) AS n_varint, CAST(greatest(1, ceil(length(bin(node_key)) / 8.0)) AS INTEGER) AS n_fixed
        FROM class_nodes WHERE node_key IS NOT NULL""",
    "path_parts": f"""SELECT DISTINCT file_path, {_NAME} AS file_name, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS parent,
        CASE WHEN contains({_NAME}, '.') THEN regexp_extract({_NAME}, '\\.[^.]*$') ELSE '' END AS extension, regexp_extract({_NAME}, '^[^.]*') AS stem,
        CASE WHEN contains({_NAME}, '.') THEN regexp_replace({_NAME}, '\\.[^.]*$', '') ELSE {_NAME} END AS base FROM file_infos WHERE file_path IS NOT NULL""",
    "dict_text_roundtrip": f"WITH {_DICT} SELECT * FROM dict",
    "triples_text_roundtrip": f"WITH {_ENC} SELECT DISTINCT s, p, o FROM e",
    "permutations_written": f"WITH {_ENC} SELECT 'pos' AS perm, p AS c0, o AS c1, s AS c2 FROM e UNION ALL SELECT 'osp', o, s, p FROM e",
    "sorted_runs_written": f"WITH {_ENC}, u AS (SELECT DISTINCT s, p, o FROM e) SELECT count(*) AS n_rows, TRUE AS all_short, TRUE AS all_disjoint FROM u",
    "taxonomy_text_roundtrip": f"WITH RECURSIVE {_TAX} SELECT class, assigned_id, parent FROM tax WHERE assigned_id IS NOT NULL",
    "graph_dot": f"WITH RECURSIVE {_TAX} SELECT '\"' || class || '\" -> \"' || parent || '\";' AS line FROM tree WHERE parent IS NOT NULL",
    "ntriples_gzip": f"WITH {_T} SELECT DISTINCT s, p, {_STRIP.format('o')} AS o FROM t WHERE regexp_matches(s || ' ' || p || ' ' || o || ' .', '{_LINE}')",
    "ntriples_bzip2": f"WITH {_T} SELECT DISTINCT s, p, {_STRIP.format('o')} AS o FROM t WHERE regexp_matches(s || ' ' || p || ' ' || o || ' .', '{_LINE}')",
    "input_files": "SELECT * FROM (VALUES (TRUE, CAST(3 AS BIGINT), TRUE, CAST(6 AS BIGINT)), (FALSE, 3, TRUE, 6)) v(compressed, n_files, all_filled, n_listed)",
    "input_splits": """WITH f AS (SELECT file_id, max(file_start + file_size) AS size, bool_and(splittable) AS splittable FROM file_infos WHERE file_id IS NOT NULL GROUP BY 1),
        k AS (SELECT * FROM f WHERE size IS NOT NULL), e AS (SELECT greatest(1, CAST((sum(size) + 15) // 16 AS BIGINT)) AS each FROM k),
        s AS (SELECT file_id, size, CASE WHEN splittable THEN each ELSE greatest(size, 1) END AS step FROM k, e),
        x AS (SELECT *, unnest(range(0, greatest(size, 1), step)) AS start FROM s) SELECT file_id, start, least(step, size - start) AS size FROM x""",
    "sketch_widths": f"""WITH n AS (SELECT CAST(sum(file_size) AS BIGINT) AS b FROM (SELECT DISTINCT entry_id, file_size FROM file_infos)),
        f AS (SELECT * FROM (VALUES (1), (1000), (1000000)) v(factor), (VALUES (FALSE), (TRUE)) c(compressed))
        SELECT CAST(factor AS BIGINT) AS factor, compressed, CAST(least(greatest({POPULAR}, b * factor // CASE WHEN compressed THEN 100 ELSE 1000 END), 1957341) AS BIGINT) AS width FROM f, n""",
    "cms_top_terms": f"""WITH {_TERMS} {_CMT}, one AS (SELECT DISTINCT r, term, cell FROM cells), est AS (SELECT term, min(n) AS estimate FROM one JOIN counters USING (r, cell) GROUP BY 1)
        SELECT term, estimate FROM est ORDER BY estimate DESC, term LIMIT 100""",
    "mg_recall": f"""WITH {_FREQ} SELECT count(*) FILTER (WHERE freq * 200 >= (SELECT sum(freq) FROM freq)) AS n_heavy, CAST(0 AS BIGINT) AS missing_one, CAST(0 AS BIGINT) AS missing_united,
        CAST(0 AS BIGINT) AS missing_rescored FROM freq""",
    "approx_distinct_checked": f"WITH {_T} SELECT p, count(DISTINCT o) AS n_exact, TRUE AS within FROM t GROUP BY 1",
    "distinct_sketches_checked": f"WITH {_OCC} SELECT count(DISTINCT term) AS n_terms, TRUE AS terms_within, (SELECT count(DISTINCT s) FROM t) AS n_s, TRUE AS s_within FROM occ",
    "dict_hash_murmur": f"WITH {_TERMS} SELECT count(*) AS n_terms, count(*) AS n_ids, TRUE AS in_range FROM terms",
    "murmur_32": f"""WITH {_T}, u AS (SELECT DISTINCT p AS term FROM t), h AS (SELECT term, hex(encode(term)) AS x, strlen(term) AS n FROM u),
        w AS (SELECT term, n, list_transform(range(0, (n + 3) // 4), lambda i: list_sum(list_transform(range(0, 4), lambda j:
              CASE WHEN i * 4 + j < n THEN CAST('0x' || substr(x, i * 8 + j * 2 + 1, 2) AS BIGINT) << (8 * j) ELSE 0 END))) AS words FROM h),
        k AS (SELECT term, n, list_transform(words, lambda v: ((((v * 3432918353) % 4294967296) << 15) | (((v * 3432918353) % 4294967296) >> 17)) % 4294967296 * CAST(461845907 AS HUGEINT) % 4294967296) AS ks FROM w),
        b AS (SELECT term, n, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(0, len(ks)), lambda i: ks[i + 1] + CASE WHEN i * 4 + 4 <= n THEN CAST(0 AS HUGEINT) ELSE CAST(4294967296 AS HUGEINT) END)),
              lambda h, v: CASE WHEN v >= 4294967296 THEN xor(h, v - 4294967296) ELSE (((xor(h, v) << 13) | (xor(h, v) >> 19)) % 4294967296 * 5 + 3864292196) % 4294967296 END) AS h FROM k),
        f1 AS (SELECT term, xor(h, CAST(n AS HUGEINT)) AS h FROM b), f2 AS (SELECT term, xor(h, h >> 16) * 2246822507 % 4294967296 AS h FROM f1),
        f3 AS (SELECT term, xor(h, h >> 13) * 3266489909 % 4294967296 AS h FROM f2), f4 AS (SELECT term, xor(h, h >> 16) AS h FROM f3)
        SELECT term, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash FROM f4""",
    "murmur_known": """SELECT term, CAST(h32 AS INTEGER) AS h32, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM (VALUES ('', 0, 0, 0), ('hello', 613153351, -3758069500696749310, 6565844092913065241),
        ('The quick brown fox jumps over the lazy dog', 776992547, -2068352364225029268, 8809951995912426311)) v(term, h32, low, high)""",
    "byte_hashes": f"""WITH {_T}, u AS (SELECT DISTINCT p AS term FROM t UNION SELECT * FROM (VALUES (''), ('é'), ('漢字😀'), ('naïve café')) v(x)),
        h AS (SELECT term, list_transform(range(0, strlen(term)), lambda i: CAST('0x' || substr(hex(encode(term)), i * 2 + 1, 2) AS HUGEINT)) AS raw FROM u),
        b AS (SELECT term, list_transform(raw, lambda v: CASE WHEN v > 127 THEN v - 256 ELSE v END) AS bytes FROM h),
        g AS (SELECT term, list_reduce(list_prepend(CAST(0 AS HUGEINT), bytes), lambda h, v: (xor(h, (v + 4294967296) % 4294967296) * 16777619) % 4294967296) AS f32,
              list_reduce(list_prepend(CAST(0 AS HUGEINT), bytes), lambda h, v: (xor(h, (v + 72057594037927936) % 72057594037927936) * 16777619) % 72057594037927936) AS f56,
              list_reduce(list_prepend(CAST(5381 AS HUGEINT), bytes), lambda h, v: (h * 33 + v + 4294967296) % 4294967296) AS t32,
              list_reduce(list_prepend(CAST(5381 AS HUGEINT), bytes), lambda h, v: (h * 33 + v + 72057594037927936) % 72057594037927936) AS t56 FROM b)
        SELECT term, CAST(CASE WHEN f32 >= 2147483648 THEN f32 - 4294967296 ELSE f32 END AS INTEGER) AS fnv_32, CAST(f56 AS BIGINT) AS fnv_56,
               CAST(CASE WHEN t32 >= 2147483648 THEN t32 - 4294967296 ELSE t32 END AS INTEGER) AS times33_32, CAST(t56 AS BIGINT) AS times33_56 FROM g""",
    "array_hash": """WITH a AS (SELECT DISTINCT list_filter(pattern_elements, lambda x: x IS NOT NULL) AS items FROM patterns WHERE pattern_elements IS NOT NULL),
        h AS (SELECT items, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(items, lambda x: CAST(x AS HUGEINT))),
              lambda h, v: xor(h, (v + 2654435769 + (h * 64) % 18446744073709551616 + h // 4) % 18446744073709551616)) AS h FROM a)
        SELECT array_to_string(items, ' ') AS items, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM h""",
    "bit_positions": f"""WITH {_T} SELECT triple_id, CAST(CASE WHEN triple_id <> 0 THEN instr(reverse(bin(triple_id)), '1') - 1 END AS INTEGER) AS least_set,
        CAST(instr(reverse(bin(triple_id)) || '0', '0') - 1 AS INTEGER) AS first_zero FROM t""",
    "integer_codecs": f"""WITH {_X}, n AS (SELECT *, CAST(greatest(1, ceil(length(bin(x)) / 7.0)) AS BIGINT) AS v, CAST(CASE WHEN x < 32 THEN 0 ELSE ceil((length(bin(x)) - 5) / 8.0) END AS BIGINT) AS m FROM x)
        SELECT node_key, array_to_string(list_transform(range(0, v), lambda i: printf('%02X', ((x >> (7 * i)) & 127) + CASE WHEN i < v - 1 THEN 128 ELSE 0 END)), '') AS varint,
        array_to_string(list_transform(range(0, v), lambda i: printf('%02X', ((x >> (7 * (v - 1 - i))) & 127) + CASE WHEN i < v - 1 THEN 128 ELSE 0 END)), '') AS varint_big,
        array_to_string(list_transform(range(0, 8), lambda i: printf('%02X', (x >> (8 * (7 - i))) & 255)), '') AS fixed, array_to_string(list_transform(range(0, 8), lambda i: printf('%02X', (x >> (8 * i)) & 255)), '') AS fixed_little,
        array_to_string(list_transform(range(0, m + 1), lambda i: printf('%02X', ((x >> (8 * (m - i))) & 255) + CASE WHEN i = 0 THEN m * 32 ELSE 0 END)), '') AS sized,
        array_to_string(list_transform(range(0, 8), lambda i: printf('%02X', ((x >> (8 * (7 - i))) & 255) + CASE WHEN i = 0 THEN 128 ELSE 0 END)), '') AS headed, CAST(m + 1 AS INTEGER) AS n_sized FROM n""",
    "integer_codecs_roundtrip": f"WITH {_X} SELECT node_key, x AS varint, x AS varint_big, x AS fixed, x AS fixed_little, x AS sized, x AS headed, 1 AS header FROM x",
    "short_iris": f"""WITH {_G}, u AS (SELECT DISTINCT unnest([s, p, o]) AS term FROM g), b AS (SELECT term, CASE WHEN starts_with(term, '<') THEN regexp_replace(regexp_replace(term, '^<', ''), '>$', '') ELSE term END AS bare FROM u)
        SELECT term, CASE WHEN starts_with(bare, 'http://www.w3.org/2002/07/owl#') THEN 'owl_' || substr(bare, 31) WHEN starts_with(bare, 'http://www.lehigh.edu/~zhp2/2004/0401/univ-bench.owl#') THEN 'lubm_' || substr(bare, 54)
        WHEN starts_with(bare, 'http://www.w3.org/2000/01/rdf-schema#') THEN 'rdfs_' || substr(bare, 38) WHEN starts_with(bare, '_:') THEN 'blanknode_' || substr(bare, 3) ELSE bare END AS short FROM b""",
    "schema_roots": f"WITH {_G} SELECT DISTINCT sup AS class FROM stated WHERE sup NOT IN (SELECT sub FROM stated)",
    "taxonomy_check": f"""WITH RECURSIVE {_TAX} SELECT count(*) AS n_classes, count(assigned_id) AS n_numbered, count(*) - count(assigned_id) AS n_outside,
        (SELECT count(DISTINCT sup) FROM edges WHERE sup NOT IN (SELECT sub FROM edges)) AS n_roots FROM tax""",
    "class_instances": f"WITH {_G} SELECT DISTINCT o AS class, s AS term FROM g WHERE p = '{sch.TYPE}'",
    "term_neighbour_class": f"""WITH RECURSIVE {_TAX}, ends AS (SELECT s AS term, o AS other FROM g WHERE p <> '{sch.TYPE}' UNION SELECT o, s FROM g WHERE p <> '{sch.TYPE}')
        SELECT e.term, min(b.class_id) AS class_id2 FROM ends e JOIN best b ON b.term = e.other GROUP BY 1""",
    "range_spread": f"""WITH {_DICT}, z AS (SELECT count(*) AS n FROM dict), b AS (SELECT term AS bound FROM range(3) k(i), z, dict WHERE id = z.n * (k.i + 1) // 4 - 1),
        x AS (SELECT term, (SELECT count(*) FROM b WHERE bound < term) AS part FROM terms) SELECT CAST(part AS INTEGER) AS part, count(*) AS n, min(term) AS first_term FROM x GROUP BY 1""",
    "pipeline_dictionary": f"WITH RECURSIVE {_RUN} SELECT * FROM clustered",
    "pipeline_triples": f"""WITH RECURSIVE {_RUN} SELECT DISTINCT a.id AS s, b.id AS p, c.id AS o FROM g JOIN clustered a ON g.s = a.term JOIN clustered b ON g.p = b.term JOIN clustered c ON g.o = c.term""",
    "sibling_order_by_patterns": f"""WITH RECURSIVE {_TAX},
        pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS freq FROM items a JOIN items b ON a.term = b.term AND a.item < b.item GROUP BY 1, 2 HAVING count(*) > 5),
        both_ways AS (SELECT item_a AS class, item_b AS other, freq FROM pairs UNION ALL SELECT item_b, item_a, freq FROM pairs),
        bonds AS (SELECT x.parent, b.class, b.other, b.freq FROM both_ways b JOIN tree x ON x.class = b.class JOIN tree y ON y.class = b.other WHERE x.parent = y.parent),
        sib AS (SELECT DISTINCT parent, class FROM bonds),
        chain(parent, done, last) AS (
          SELECT parent, [min(class)], min(class) FROM sib GROUP BY 1
          UNION ALL SELECT parent, list_append(done, pick), pick FROM (
            SELECT c.parent, c.done, coalesce((SELECT arg_min(b.other, lpad(CAST(1000000000 - b.freq AS VARCHAR), 12, '0') || b.other) FROM bonds b WHERE b.class = c.last AND NOT list_contains(c.done, b.other)),
              (SELECT min(s.class) FROM sib s WHERE s.parent = c.parent AND NOT list_contains(c.done, s.class))) AS pick FROM chain c) WHERE pick IS NOT NULL),
        whole AS (SELECT parent, arg_max(done, len(done)) AS done FROM chain GROUP BY 1)
        SELECT parent, unnest(done) AS class, CAST(generate_subscripts(done, 1) - 1 AS INTEGER) AS position FROM whole""",
}
