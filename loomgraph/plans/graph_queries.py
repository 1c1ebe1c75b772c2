"""Queries over the graph (GR, NV, CD) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, inventory, nav
from .surrogate import Relations, sql

QUERIES, SQL = {}, {}


def query(text: str | None = None):
    """Register a function of relations under its name, with its DuckDB query."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return put


def nodes_of(r: Relations):
    return graph.nodes(r.functions, r.kept)


def flat(df, *columns):
    """Array columns as comma-joined text, for comparison."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


#: DuckDB: the node table
NODES = """
deg AS (SELECT id, sum(o) AS n_callees, sum(i) AS n_callers FROM (SELECT caller_id AS id, 1 AS o, 0 AS i FROM {kept} UNION ALL SELECT callee_id, 0, 1 FROM {kept}) GROUP BY id),
miss AS (SELECT DISTINCT id FROM deg WHERE id NOT IN (SELECT id FROM {functions})),
nodes0 AS (
  SELECT id, name, qualname, file, line_start, line_end, class_name, kind, synthetic, ord, '' AS module, signature FROM {functions}
  UNION ALL SELECT id, '__init__', concat(regexp_extract(regexp_replace(id, '\\.__init__$', ''), '([^.]*)$', 1), '.__init__'), concat(regexp_replace(regexp_replace(id, '\\.__init__$', ''), '\\.[^.]*$', ''), '.py'),
    0, 0, regexp_extract(regexp_replace(id, '\\.__init__$', ''), '([^.]*)$', 1), 'internal', true, NULL, '', NULL FROM miss WHERE id LIKE '%.__init__' AND id NOT LIKE 'boundary:%'
  UNION ALL SELECT id, regexp_extract(id, '([^.]*)$', 1), substr(id, 10), NULL, NULL, NULL, CASE WHEN id LIKE '%.Cls%' THEN regexp_extract(id, '\\.(Cls[^.]*)', 1) ELSE '' END, 'boundary', NULL, NULL,
    CASE WHEN id LIKE '%.Cls%' THEN regexp_extract(id, '^boundary:([^.]*)', 1) ELSE concat(regexp_extract(id, '^boundary:([^.]*)', 1), '.sub') END, NULL FROM miss WHERE id LIKE 'boundary:%'),
nodes AS (SELECT n.*, coalesce(n_callees, 0) AS n_callees, coalesce(n_callers, 0) AS n_callers FROM nodes0 n LEFT JOIN deg USING (id)),
own AS (SELECT * FROM nodes WHERE kind = 'internal' AND NOT coalesce(synthetic, false))
""".replace("\\\\", "\\")
DIR = "CASE WHEN file LIKE '%/%' THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END"


@query("SELECT call_type <> 'unresolved' AS kept, count(*) AS n FROM {calls} GROUP BY 1")
def gr_partition_edges(r):
    return graph.kept_calls(r.calls).select(F.lit(True).alias("kept")).unionByName(graph.dropped_calls(r.calls).select(F.lit(False).alias("kept"))).groupBy("kept").agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN t LIKE 'self.logger%' OR t LIKE 'self._logger%' THEN 'inherited_method' WHEN t LIKE 'self.%' THEN 'self_attr_unknown' WHEN t[1] IN ('''', '"') THEN 'string_literal_method'
  WHEN trim(split_part(split_part(t, '.', 1), '(', 1)) IN ('len', 'isinstance', 'range', 'enumerate', 'zip', 'list', 'dict', 'tuple', 'set', 'str', 'int', 'float', 'bool', 'type', 'id', 'print', 'repr', 'min', 'max', 'sum', 'abs', 'any', 'all', 'sorted', 'reversed', 'getattr', 'setattr', 'hasattr', 'callable', 'open', 'iter', 'next', 'map', 'filter', 'RuntimeError', 'ValueError', 'TypeError', 'TimeoutError', 'Exception', 'KeyError', 'IndexError', 'StopIteration', 'NotImplementedError') THEN 'builtin' WHEN t LIKE '%.%' THEN 'local_var_method' ELSE 'bare_name' END AS category, count(*) AS n
FROM (SELECT substr(callee_id, 12) AS t FROM {calls} WHERE call_type = 'unresolved') GROUP BY 1""")
def gr_dropped_categories(r):
    return graph.dropped_calls(r.calls).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT id, CAST(sum(o) AS BIGINT) AS n_callees, CAST(sum(i) AS BIGINT) AS n_callers FROM (SELECT caller_id AS id, 1 AS o, 0 AS i FROM {kept} UNION ALL SELECT callee_id, 0, 1 FROM {kept}) GROUP BY id")
def gr_degrees(r):
    return graph.degrees(r.kept)


@query("SELECT DISTINCT id FROM (SELECT caller_id AS id FROM {kept} UNION ALL SELECT callee_id FROM {kept}) WHERE id NOT IN (SELECT id FROM {functions})")
def gr_missing_endpoints(r):
    return graph.missing_endpoints(r.functions, r.kept)


@query(f"WITH {NODES} SELECT id, qualname, module, class_name, name FROM nodes WHERE kind = 'boundary'")
def gr_boundary_split(r):
    return graph.boundary_nodes(graph.missing_endpoints(r.functions, r.kept)).select("id", "qualname", "module", "class_name", "name")


@query(f"WITH {NODES} SELECT id, name, qualname, file, class_name FROM nodes WHERE name = '__init__' AND kind = 'internal'")
def gr_constructors(r):
    return graph.constructor_nodes(graph.missing_endpoints(r.functions, r.kept)).select("id", "name", "qualname", "file", "class_name")


@query(f"WITH {NODES} SELECT id, kind, qualname, CAST(n_callees AS BIGINT) AS n_callees, CAST(n_callers AS BIGINT) AS n_callers FROM nodes")
def gr_nodes(r):
    return nodes_of(r).select("id", "kind", "qualname", "n_callees", "n_callers")


@query("""
WITH u AS (SELECT class_name, unnest(used_self_attrs_read) AS attr, 'r' AS k, ord, id FROM {functions} WHERE class_name IS NOT NULL
  UNION ALL SELECT class_name, unnest(used_self_attrs_written), 'w', ord, id FROM {functions} WHERE class_name IS NOT NULL)
SELECT class_name, attr, coalesce(string_agg(id, ',' ORDER BY ord, id) FILTER (k = 'r'), '') AS read_in, coalesce(string_agg(id, ',' ORDER BY ord, id) FILTER (k = 'w'), '') AS written_in FROM u GROUP BY 1, 2""")
def gr_state_xref(r):
    return flat(graph.state_xref(r.functions), "read_in", "written_in")


@query("SELECT call_type, count(*) AS n FROM {calls} GROUP BY 1")
def gr_calltype_histogram(r):
    return graph.call_types(r.calls)


@query(f"WITH {NODES} SELECT (SELECT count(*) FROM {{functions}}) AS n_functions, (SELECT count(*) FROM {{kept}}) AS n_kept, (SELECT count(*) FROM {{calls}} WHERE call_type = 'unresolved') AS n_dropped, count(*) FILTER (kind = 'internal') AS n_internal, count(*) FILTER (kind = 'boundary') AS n_boundary FROM nodes")
def gr_stats(r):
    return graph.stats(r.functions, r.calls, nodes_of(r))


@query(f"""WITH {NODES}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, ord) AS rk FROM own)
SELECT file, count(*) AS n_functions, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT class_name AS c FROM own o WHERE o.file = k.file AND class_name IS NOT NULL)), '') AS classes,
  string_agg(concat(qualname, ' ', substr(signature, 1, 120)), ',' ORDER BY rk) FILTER (rk <= 8) AS sample FROM k GROUP BY file""")
def nv_file_profile(r):
    return flat(nav.file_profile(nodes_of(r)), "classes", "sample")


@query(f"WITH {NODES} SELECT {DIR} AS dir, count(DISTINCT file) AS n_files, count(*) AS n_functions FROM own GROUP BY 1")
def nv_dir_map(r):
    return nav.dir_map(nav.file_profile(nodes_of(r)))


@query(f"""WITH {NODES}, p AS (SELECT *, CASE WHEN n_callers = 0 AND line_start > 0 THEN 'root' ELSE 'name' END AS why FROM own
  WHERE (n_callers = 0 AND line_start > 0) OR regexp_matches(lower(name), '^(main|run|serve|start|execute|exec|dispatch|handle|handler|cmd|command|app|loop|bootstrap)(_.*)?$'))
SELECT qualname, file, CAST(n_callees AS BIGINT) AS n_callees, why FROM p QUALIFY row_number() OVER (PARTITION BY qualname ORDER BY n_callees DESC, CASE why WHEN 'root' THEN 0 ELSE 1 END, ord) = 1""")
def nv_entry_points(r):
    return nav.entry_points(nodes_of(r))


@query(f"WITH {NODES} SELECT file, CAST(sum(n_callees) AS BIGINT) AS n_callees FROM own GROUP BY file ORDER BY sum(n_callees) DESC, min(ord) LIMIT 40")
def nv_fan_out_topk(r):
    return nav.fan_out(nodes_of(r))


@query(f"WITH {NODES} SELECT module, count(*) AS n_calls_into, array_to_string(list_sort(list(DISTINCT name))[1:5], ',') AS sample FROM nodes WHERE kind = 'boundary' GROUP BY 1")
def nv_external_subsystems(r):
    return flat(nav.external_subsystems(nodes_of(r)), "sample")


@query(f"WITH {NODES} SELECT count(*) AS n_functions, count(DISTINCT file) AS n_files, count(DISTINCT {DIR}) AS n_dirs, (SELECT count(*) FROM nodes WHERE kind = 'boundary') AS n_boundary, (SELECT count(*) FROM {{kept}}) AS n_calls FROM own")
def nv_totals(r):
    return nav.totals(nodes_of(r), r.kept)


@query(f"""WITH {NODES}, p AS (SELECT file, count(*) AS n FROM own GROUP BY 1)
SELECT coalesce(s.file, p.file) AS file, coalesce(n, 0) AS n_functions, CAST(row_number() OVER (ORDER BY n IS NULL, CASE WHEN n IS NOT NULL THEN coalesce(s.file, p.file) END, s.ord) AS INT) AS position FROM {{scanned}} s FULL JOIN p ON s.file = p.file""")
def nv_all_files(r):
    return nav.all_files(nav.file_profile(nodes_of(r)), r.scanned)


@query(f"WITH {NODES} SELECT DISTINCT a.file AS file_a, b.file AS file_b FROM {{kept}} k JOIN own a ON a.id = k.caller_id JOIN own b ON b.id = k.callee_id WHERE a.file <> b.file")
def nv_file_adjacency(r):
    return nav.file_adjacency(nodes_of(r), r.kept)


@query(f"""WITH {NODES}, e AS (SELECT a.qualname AS q1, b.qualname AS q2, b.kind = 'boundary' AS boundary FROM {{kept}} k JOIN nodes a ON a.id = k.caller_id JOIN nodes b ON b.id = k.callee_id),
u AS (SELECT q1 AS qualname, 'calls' AS direction, q2 AS other, boundary FROM e UNION ALL SELECT q2, 'called_by', q1, false FROM e WHERE NOT boundary),
g AS (SELECT qualname, direction, other, bool_or(boundary) AS boundary FROM u GROUP BY 1, 2, 3),
s AS (SELECT qualname AS other, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM {{members}} GROUP BY 1)
SELECT g.qualname, direction, g.other, boundary, coalesce(stages, '') AS stages FROM g LEFT JOIN s USING (other)""")
def nv_context(r):
    return flat(nav.context(nodes_of(r), r.kept, r.members), "stages")


@query(f"""WITH {NODES}, c AS (SELECT DISTINCT a.qualname AS q1, b.qualname AS q2 FROM {{kept}} k JOIN nodes a ON a.id = k.caller_id JOIN nodes b ON b.id = k.callee_id)
SELECT DISTINCT m.stage, m.ord AS i, n.ord AS j FROM {{members}} m JOIN c ON c.q1 = m.qualname JOIN {{members}} n ON n.stage = m.stage AND n.qualname = c.q2 WHERE m.ord <> n.ord""")
def nv_stage_pairs(r):
    return nav.stage_calls(r.members, nodes_of(r), r.kept)


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY CASE type WHEN 'function' THEN 0 ELSE 1 END, ord) AS rk FROM {members})
SELECT stage, string_agg(concat(qualname, ': ', substr(split_part(purpose, '. ', 1), 1, 90)), ',' ORDER BY rk) FILTER (rk <= 4) AS lines, greatest(count(*) - 4, 0) AS more FROM k GROUP BY 1""")
def nv_stage_sample(r):
    return flat(nav.stage_sample(r.members), "lines")


@query(f"WITH {NODES} SELECT qualname, file, line_start, line_end FROM own WHERE line_start > 0")
def nv_candidates(r):
    return nav.candidates(nodes_of(r))


@query(f"""WITH {NODES}, c AS (SELECT DISTINCT k.caller_id, k.callee_id, coalesce(n.qualname, regexp_replace(k.callee_id, '^boundary:', '')) AS callee, o.id IS NOT NULL AS inside
  FROM {{kept}} k LEFT JOIN nodes n ON n.id = k.callee_id LEFT JOIN own o ON o.id = k.callee_id WHERE k.caller_id <> k.callee_id),
a AS (SELECT caller_id AS id, list_sort(list(DISTINCT callee) FILTER (inside)) AS calls, list_sort(list(DISTINCT callee) FILTER (NOT inside)) AS ext_calls FROM c GROUP BY 1),
b AS (SELECT c.callee_id AS id, list_sort(list(DISTINCT o.qualname)) AS called_by FROM c JOIN own o ON o.id = c.caller_id WHERE inside GROUP BY 1)
SELECT o.file, o.id, o.qualname, line_start, substr(signature, 1, 200) AS signature, CAST(coalesce(len(calls), 0) AS INT) AS n_calls, CAST(coalesce(len(called_by), 0) AS INT) AS n_called_by, CAST(coalesce(len(ext_calls), 0) AS INT) AS n_ext_calls,
  coalesce(array_to_string(calls[1:25], ','), '') AS calls, coalesce(array_to_string(called_by[1:25], ','), '') AS called_by, coalesce(array_to_string(ext_calls[1:25], ','), '') AS ext_calls
FROM own o LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def cd_inventory(r):
    return flat(inventory.inventory(nodes_of(r), r.kept), "calls", "called_by", "ext_calls")


@query("""WITH q AS (SELECT qualname, arg_max(purpose, ord) AS p FROM {members} WHERE ord % 2 = 0 GROUP BY 1), n AS (SELECT name, arg_min(p, ord) AS p FROM (SELECT f.name, m.purpose AS p, m.ord FROM {members} m JOIN {functions} f ON f.qualname = m.qualname WHERE m.ord % 2 = 1) GROUP BY 1)
SELECT f.id, f.qualname, f.name, coalesce(q.p, n.p, '') AS purpose FROM {functions} f LEFT JOIN q USING (qualname) LEFT JOIN n ON n.name = f.name""")
def cd_annotation_merge(r):
    m = r.members.join(r.functions.select("qualname", "name").distinct(), "qualname")  # not once for each function of that name
    odd = F.col("ord") % 2 == 1
    notes = m.select("ord", F.when(odd, "").otherwise(F.col("qualname")).alias("qualname"), F.when(odd, F.col("name")).otherwise("").alias("name"), "purpose", F.lit("").alias("note"))
    return inventory.merge_notes(r.functions, notes)


@query("SELECT file, role, CAST((row_number() OVER (PARTITION BY role ORDER BY file) - 1) // 8 AS INT) AS batch FROM {cards}")
def cd_batches(r):
    return inventory.batches(r.cards, "role", ["file"], 8).select("file", "role", "batch")


@query("""WITH RECURSIVE x AS (SELECT file, ord, length(signature) AS s, row_number() OVER (PARTITION BY file ORDER BY ord) AS k FROM {functions}),
t AS (SELECT file, ord, k, s AS held, 0 AS chunk FROM x WHERE k = 1
  UNION ALL SELECT x.file, x.ord, x.k, CASE WHEN t.held + x.s > 400 THEN x.s ELSE t.held + x.s END, CASE WHEN t.held + x.s > 400 THEN t.chunk + 1 ELSE t.chunk END FROM t JOIN x ON x.file = t.file AND x.k = t.k + 1)
SELECT file, ord, CAST(chunk AS INT) AS chunk FROM t""")
def cd_chunk_greedy(r):
    return inventory.greedy_chunks(r.functions.withColumn("size", F.length("signature")), "file", "ord", "size", 400)


@query("SELECT file FROM {contents} WHERE file NOT IN (SELECT file FROM {cards} WHERE purpose <> '')")
def cd_resume(r):
    return inventory.to_read(r.contents.select("file"), r.cards)


@query("SELECT count(*) AS n_files, count(*) FILTER (coalesce(c.purpose, '') <> '') AS n_described, count(*) FILTER (coalesce(c.purpose, '') = '') AS n_missing FROM {contents} f LEFT JOIN (SELECT * FROM {cards} WHERE ord % 3 > 0) c ON c.file = f.file")
def cd_coverage(r):
    return inventory.coverage(inventory.backfill(r.contents, r.cards.where("ord % 3 > 0").select("file", "purpose", "role", "lifecycle")))


@query("""SELECT file, coalesce(arg_min(purpose, ord) FILTER (purpose <> ''), '') AS purpose, coalesce(arg_min(role, ord), 'other') AS role, coalesce(arg_min(lifecycle, ord) FILTER (lifecycle <> ''), '') AS lifecycle,
  coalesce(string_agg(description, chr(10) || chr(10) ORDER BY ord) FILTER (description <> ''), '') AS description FROM (SELECT concat('f', ord // 4) AS file, ord, purpose, role, lifecycle, description FROM {cards}) GROUP BY 1""")
def cd_chunk_merge(r):
    return inventory.merge_chunks(r.cards.withColumn("file", F.concat(F.lit("f"), F.floor(F.col("ord") / 4))).select("file", "ord", "purpose", "role", "lifecycle", "description"))


@query("SELECT c.file, c.purpose, coalesce(n, 0) AS n_functions FROM {cards} c LEFT JOIN (SELECT concat('src0/en/', line_start, '.py') AS file, count(*) AS n FROM {functions} GROUP BY 1) p ON p.file = c.file")
def cd_file_info(r):
    profile = r.functions.groupBy(F.concat(F.lit("src0/en/"), "line_start", F.lit(".py")).alias("file")).agg(F.count("*").alias("n_functions"))
    return inventory.file_info(profile, r.cards.select("file", "purpose"))


@query("""SELECT qualname FROM (SELECT qualname, sha1(text) AS sha1 FROM {functions}) f WHERE NOT EXISTS (SELECT 1 FROM {functions} c WHERE c.ord % 3 > 0 AND c.ord % 5 > 0 AND c.qualname = f.qualname AND sha1(c.text) = f.sha1)""")
def cd_sha_gate(r):
    f = r.functions.select("qualname", F.sha1("text").alias("sha1"), "ord")
    cache = f.withColumns({"output": F.when(F.col("ord") % 3 > 0, "x"), "error": F.when(F.col("ord") % 5 == 0, "e")})
    return inventory.to_analyse(f.select("qualname", "sha1"), cache).select("qualname")


@query("SELECT qualname, CASE WHEN regexp_matches(lower(name), 'log|trace|metric') THEN 'crosscut-observability' WHEN regexp_matches(lower(name), 'error|exception|fail') THEN 'crosscut-errors' WHEN regexp_matches(lower(name), 'config|setting|option') THEN 'crosscut-config' ELSE '' END AS crosscut, CAST(line_end - line_start + 1 > 60 AS INT) AS n_regions FROM {functions}")
def cd_dry_run(r):
    return inventory.dry_run_record(r.functions)
