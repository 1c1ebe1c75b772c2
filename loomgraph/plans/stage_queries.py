"""Queries over stages, order, mapping, regions and the tree (AS, DR, OR, MP, RG, TR), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping, nav, ordering, regions, stages, tree
from .graph_queries import DIR, NODES, flat, nodes_of
from .surrogate import Relations, sql

QUERIES, SQL = {}, {}


def query(text: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return put


#: DuckDB: (id, depth, path, ords) of the stage tree, parents that do not exist being none
TREE = """s AS (SELECT x.*, p.id AS up FROM {stages} x LEFT JOIN {stages} p ON p.id = x.parent),
t AS (SELECT id, 0 AS depth, [id] AS path, [ord] AS ords FROM s WHERE up IS NULL UNION ALL SELECT s.id, t.depth + 1, list_append(t.path, s.id), list_append(t.ords, s.ord) FROM s JOIN t ON s.up = t.id),
clo AS (SELECT path[i] AS ancestor, id, depth + 1 - i AS distance FROM t, unnest(range(1, len(path) + 1)) u(i))"""


@query(f"""WITH c AS (SELECT *, {DIR} AS dir FROM {{cards}}),
rh AS (SELECT dir, string_agg(concat(role, ':', n), ',' ORDER BY n DESC, seen, role) AS roles FROM (SELECT dir, role, count(*) AS n, min(ord) AS seen FROM c GROUP BY 1, 2) GROUP BY 1),
lh AS (SELECT dir, string_agg(concat(lifecycle, ':', n), ',' ORDER BY n DESC, seen, lifecycle) AS lifecycles FROM (SELECT dir, lifecycle, count(*) AS n, min(ord) AS seen FROM c WHERE lifecycle <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, seen, lifecycle) <= 3) GROUP BY 1),
ph AS (SELECT dir, string_agg(purpose, ',' ORDER BY length(purpose) DESC, ord) AS purposes FROM (SELECT * FROM c WHERE purpose <> '' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(purpose) DESC, ord) <= 4) GROUP BY 1)
SELECT dir, n_files, roles, lifecycles, purposes FROM (SELECT dir, count(*) AS n_files FROM c GROUP BY 1) LEFT JOIN rh USING (dir) LEFT JOIN lh USING (dir) LEFT JOIN ph USING (dir)""")
def as_dir_rollup(r):
    return flat(stages.dir_rollup(r.cards), "roles", "lifecycles", "purposes")


@query("SELECT ord, id, concat(title, ': ', rtrim(split_part(coalesce(description, ''), '. ', 1), '.'), '.') AS line FROM {stages}")
def as_stage_menu(r):
    return stages.stage_menu(r.stages)


@query("""SELECT f.file, CASE WHEN s.id IS NULL THEN 'unassigned' ELSE f.stage END AS stage, CASE WHEN f.ord % 2 = 0 THEN 'stage-1' ELSE 'stage-2' END AS also
FROM {file_stage} f LEFT JOIN {stages} s ON s.id = f.stage WHERE f.ord % 4 > 0""")
def as_coerce(r):
    also = F.array(F.lit("nope"), F.when(F.col("ord") % 2 == 0, "stage-1").otherwise("stage-2"))
    return flat(stages.coerce_assignment(r.file_stage.withColumn("also", also), r.file_stage.where("ord % 4 > 0"), r.stages), "also")


@query("SELECT stage, count(*) AS n_files, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT s.file, coalesce(f.stage, 'unassigned') AS stage FROM {scanned} s LEFT JOIN {file_stage} f ON f.file = s.file) WHERE stage <> 'unassigned' GROUP BY 1")
def as_buckets(r):
    return flat(stages.buckets(stages.assign_all(r.scanned, r.file_stage)), "files")


@query("SELECT f.file, CASE WHEN s.id IS NULL THEN 'unassigned' ELSE f.stage END AS stage FROM {file_stage} f LEFT JOIN {stages} s ON s.id = f.stage")
def as_rebuild(r):
    return stages.rebuild(r.file_stage, r.stages)


@query("SELECT f.file, CASE WHEN s.id IS NULL THEN 'unassigned' ELSE s.id END AS stage FROM {file_stage} f LEFT JOIN {stages} s ON s.id = CASE WHEN f.ord % 3 = 0 THEN 'stage-2' ELSE f.stage END")
def as_delta_merge(r):
    delta = r.file_stage.where("ord % 3 = 0").select("file", F.lit("stage-2").alias("stage"))
    return stages.delta_merge(r.file_stage, delta, r.stages)


@query(f"""WITH d AS (SELECT stage, {DIR} AS dir, count(*) AS n, min(ord) AS seen FROM {{file_stage}} WHERE stage <> 'unassigned' GROUP BY 1, 2),
b AS (SELECT stage, sum(n) AS size, count(*) AS n_dirs, max(n) AS top FROM d GROUP BY 1), w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY stage ORDER BY n DESC, seen) = 1)
SELECT s.id AS stage, CAST(coalesce(size, 0) AS BIGINT) AS size, coalesce(n_dirs, 0) AS n_dirs, w.dir AS dominant_dir, round(w.n / size, 6) AS share, coalesce(size > greatest(20, 2.5 * (SELECT avg(size) FROM b)), false) AS overloaded
FROM {{stages}} s LEFT JOIN b ON b.stage = s.id LEFT JOIN w ON w.stage = s.id""")
def dr_stage_stats(r):
    return stages.stage_stats(r.stages, r.file_stage)


@query("""WITH f AS (SELECT stage, file, count(*) AS n, count(*) FILTER (type = 'function') AS f, count(*) FILTER (type = 'region') AS r, min(ord) AS seen FROM {members} GROUP BY 1, 2)
SELECT stage, CAST(sum(n) AS BIGINT) AS n_members, CAST(sum(f) AS BIGINT) AS n_functions, CAST(sum(r) AS BIGINT) AS n_regions, count(*) AS n_files, arg_max(file, n * 100000 - seen) AS dominant_file, round(max(n) / sum(n), 6) AS share FROM f GROUP BY 1""")
def dr_mapping_stats(r):
    return stages.mapping_stats(r.members)


CHANGES = """SELECT o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN 'add_stage' WHEN 1 THEN 'remove_stage' WHEN 2 THEN 'merge_stages' WHEN 3 THEN 'split_stage' ELSE 'rename' END AS action,
  CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 7 = 1 THEN 'crosscut-1' ELSE concat('stage-', o_orderkey % 5 + 1) END AS stage, CASE WHEN o_orderkey % 3 = 0 THEN 'stage-1' WHEN o_orderkey % 3 = 1 THEN 'nope' ELSE 'stage-3' END AS target,
  split(CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'x,x' WHEN 2 THEN 'x,stage-1' ELSE 'x,y' END, ',') AS new_ids FROM {orders}"""


@query(f"""WITH c AS ({CHANGES})
SELECT c.ord, action, c.stage, CASE WHEN action NOT IN ('add_stage', 'remove_stage', 'merge_stages', 'split_stage') THEN 'unknown action' WHEN action = 'add_stage' AND s.id IS NOT NULL THEN 'id in use' WHEN action <> 'add_stage' AND s.id IS NULL THEN 'unknown stage'
  WHEN action IN ('remove_stage', 'merge_stages') AND s.crosscut THEN 'protected stage' WHEN action = 'merge_stages' AND t.id IS NULL THEN 'unknown target' WHEN action = 'merge_stages' AND c.stage = target THEN 'target is the stage'
  WHEN action = 'split_stage' AND len(new_ids) < 2 THEN 'split into fewer than two' WHEN action = 'split_stage' AND len(list_distinct(new_ids)) < len(new_ids) THEN 'repeated new id'
  WHEN action = 'split_stage' AND list_contains(new_ids, 'stage-1') THEN 'new id in use' END AS error
FROM c LEFT JOIN {{stages}} s ON s.id = c.stage LEFT JOIN {{stages}} t ON t.id = c.target""")
def dr_validate(r):
    return stages.validate_changes(r.spark.sql(CHANGES, orders=r.orders), r.stages)


GROUPS = """SELECT stage, ord % 3 AS g_ord, CASE WHEN ord % 3 = 1 THEN ' ' ELSE concat('Group ', ord % 3) END AS title, ord AS f_ord, file FROM {file_stage} WHERE ord % 5 > 0
UNION ALL SELECT stage, 2 AS g_ord, 'Group 2' AS title, ord + 1000 AS f_ord, file FROM {file_stage} WHERE ord % 2 = 0 AND ord % 5 > 0 UNION ALL SELECT stage, 0 AS g_ord, 'Group 0' AS title, 0 AS f_ord, concat(file, 'x') AS file FROM {file_stage}"""


@query(f"""WITH g AS ({GROUPS}), k AS (SELECT g.* FROM g JOIN {{file_stage}} f ON f.stage = g.stage AND f.file = g.file QUALIFY row_number() OVER (PARTITION BY g.stage, g.file ORDER BY g_ord, f_ord) = 1)
SELECT stage, g_ord, CASE WHEN trim(title) = '' THEN 'Group' ELSE trim(title) END AS title, f_ord, file FROM k
UNION ALL SELECT stage, 1073741824, 'Other', ord, file FROM {{file_stage}} f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.stage = f.stage AND k.file = f.file)""")
def or_group_validate(r):
    files = r.file_stage.withColumn("position", F.col("ord"))
    return ordering.validate_groups(r.spark.sql(GROUPS, file_stage=r.file_stage), files)


@query("SELECT stage, list_sort(list(CASE WHEN ord % 11 = 0 THEN 0 ELSE k END)) = range(0, count(*)) AS valid FROM (SELECT stage, ord, row_number() OVER (PARTITION BY stage ORDER BY ord) - 1 AS k FROM {file_stage}) GROUP BY 1")
def or_permutation_check(r):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("stage").orderBy("ord")) - 1
    rows = r.file_stage.withColumn("k", k).groupBy("stage").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("ord") % 11 == 0, 0).otherwise(F.col("k"))).alias("order"))
    return ordering.permutation_check(rows).select("stage", "valid")


@query("SELECT stage, ord, CAST(row_number() OVER (PARTITION BY stage ORDER BY file, line_start, CASE type WHEN 'function' THEN 0 ELSE 1 END, line_end, ord) - 1 AS INT) AS position FROM {members}")
def or_fallback_order(r):
    return ordering.fallback_order(r.members).select("stage", "ord", "position")


@query("SELECT stage, ord, CAST(row_number() OVER (PARTITION BY stage ORDER BY CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN ord % 3 = 0 THEN -ord END, ord) - 1 AS INT) AS position FROM {members}")
def or_apply_order(r):
    given = r.members.where("ord % 3 = 0").select("stage", "ord", (-F.col("ord")).alias("position"), F.lit("s").alias("section"))
    return ordering.apply_order(r.members, given).select("stage", "ord", "position")


@query("SELECT stage, sha1(string_agg(concat_ws('|', qualname, type, line_start, line_end), chr(10) ORDER BY concat_ws('|', qualname, type, line_start, line_end))) AS fingerprint FROM {members} GROUP BY 1")
def or_fingerprint(r):
    return ordering.fingerprint(r.members)


@query("SELECT count(*) AS n_files, count(*) FILTER (ord % 5 > 0) AS n_organised FROM {file_stage}")
def or_coverage(r):
    return ordering.organised(r.file_stage.where("ord % 5 > 0"), r.file_stage)


@query()
def or_kahn(r):
    nodes = nodes_of(r)
    return ordering.suggest_order(r.file_stage, nav.file_adjacency(nodes, r.kept))


@query("""SELECT stage, ord, qualname FROM (SELECT CASE WHEN stage = 'crosscut-0' THEN 'crosscut-2' ELSE stage END AS stage, ord, qualname, type, line_start, line_end FROM {members})
QUALIFY row_number() OVER (PARTITION BY stage, qualname, type, line_start, line_end ORDER BY ord) = 1""")
def mp_reassign(r):
    moves = r.members.where("stage = 'crosscut-0'").select("qualname", F.col("stage").alias("source"), F.lit("crosscut-2").alias("target")).distinct()
    return mapping.reassign(r.members, moves).select("stage", "ord", "qualname")


@query("SELECT stage, ord FROM {members} m WHERE NOT (type = 'function' AND EXISTS (SELECT 1 FROM {members} x WHERE x.type = 'region' AND x.stage = m.stage AND x.qualname = m.qualname))")
def mp_dedup(r):
    return mapping.dedup(r.members).select("stage", "ord")


@query("""WITH p AS (SELECT CASE WHEN ord % 4 = 0 THEN 'zzz' ELSE 'stage-1' END AS stage, ord, qualname, type, CASE WHEN ord % 6 = 1 THEN 900 ELSE line_start END AS line_start, line_end FROM {members} WHERE ord % 3 = 0),
g AS (SELECT p.* FROM p JOIN {stages} s ON s.id = p.stage WHERE line_end >= line_start QUALIFY row_number() OVER (PARTITION BY stage, qualname, type, line_start, line_end ORDER BY p.ord) = 1)
SELECT stage, ord, qualname FROM {members} WHERE qualname NOT IN (SELECT qualname FROM g) UNION ALL SELECT stage, ord, qualname FROM g""")
def mp_apply(r):
    p = r.members.where("ord % 3 = 0").withColumns({"stage": F.when(F.col("ord") % 4 == 0, "zzz").otherwise("stage-1"), "line_start": F.when(F.col("ord") % 6 == 1, 900).otherwise(F.col("line_start"))})
    return mapping.apply_classification(r.members, p, r.stages).select("stage", "ord", "qualname")


@query(f"""WITH {NODES}, c AS (SELECT DISTINCT a.qualname AS q1, b.qualname AS q2 FROM {{kept}} k JOIN nodes a ON a.id = k.caller_id JOIN nodes b ON b.id = k.callee_id),
u AS (SELECT m.stage, string_agg(DISTINCT x.stage, ',' ORDER BY x.stage) AS uses FROM {{members}} m JOIN c ON c.q1 = m.qualname JOIN {{members}} x ON x.qualname = c.q2 AND x.stage LIKE 'crosscut-%' WHERE m.stage NOT LIKE 'crosscut-%' GROUP BY 1)
SELECT s.id AS stage, coalesce(uses, '') AS uses FROM {{stages}} s LEFT JOIN u ON u.stage = s.id""")
def mp_crosscuts(r):
    return flat(mapping.derive_crosscuts(r.stages, r.members, nodes_of(r), r.kept), "uses")


@query(f"""WITH {NODES}, m AS (SELECT DISTINCT qualname FROM {{members}})
SELECT n.qualname, file, id, CASE WHEN coalesce(synthetic, false) THEN 'synthetic_dataclass' WHEN name NOT LIKE '\\_%' ESCAPE '\\' AND line_end - line_start <= 5 THEN 'api_surface' WHEN n_callers = 0 THEN 'dead' ELSE 'missing_llm_output' END AS reason
FROM nodes n LEFT JOIN m ON m.qualname = n.qualname WHERE kind = 'internal' AND (coalesce(synthetic, false) OR m.qualname IS NULL)""")
def mp_unmapped(r):
    return mapping.unmapped(nodes_of(r), r.members)


@query("""WITH a AS (SELECT sha1(k) AS h FROM (SELECT concat_ws('|', 's', id) AS k FROM {stages} UNION ALL SELECT concat_ws('|', 'm', stage, qualname, type, line_start, line_end) FROM {members}))
SELECT sha1(concat_ws('|', count(*), sum(CAST(concat('0x', h[1:12]) AS HUGEINT)), sum(CAST(concat('0x', h[13:24]) AS HUGEINT)))) AS state FROM a""")
def mp_state_hash(r):
    return mapping.state_hash(r.stages, r.members)


@query(f"""WITH {NODES}, m AS (SELECT DISTINCT qualname FROM {{members}}), q AS (SELECT qualname, min(ord) AS ord FROM {{members}} WHERE ord % 3 = 0 AND qualname IN (SELECT qualname FROM own) GROUP BY 1),
x AS (SELECT DISTINCT n.qualname FROM nodes n LEFT JOIN m ON m.qualname = n.qualname WHERE kind = 'internal' AND NOT coalesce(synthetic, false) AND m.qualname IS NULL AND line_end - line_start > 5 AND n_callers > 0),
u AS (SELECT qualname, 0 AS again, ord FROM q UNION ALL SELECT qualname, 1, NULL FROM x WHERE qualname NOT IN (SELECT qualname FROM q))
SELECT qualname, again, CAST(row_number() OVER (ORDER BY again, ord, qualname) AS INT) AS position FROM u""")
def mp_queue_hygiene(r):
    nodes = nodes_of(r)
    return mapping.clean_queue(r.members.where("ord % 3 = 0").select("ord", "qualname"), nodes, mapping.unmapped(nodes, r.members))


@query("SELECT DISTINCT qualname FROM (SELECT qualname FROM {members} WHERE ord % 2 = 0 AND qualname NOT IN (SELECT qualname FROM {members} WHERE ord % 3 = 0) UNION ALL SELECT qualname FROM {members} WHERE ord % 50 = 0)")
def mp_carry_over(r):
    return mapping.carry_over(r.members.where("ord % 2 = 0"), r.members.where("ord % 3 = 0"), r.members.where("ord % 50 = 0"))


@query("SELECT stage, ord, qualname FROM {members} m JOIN (SELECT id FROM {stages} WHERE NOT crosscut) s ON s.id = m.stage WHERE type = 'function' AND qualname NOT IN (SELECT qualname FROM {members} WHERE type = 'region') QUALIFY count(*) OVER (PARTITION BY stage) >= 2")
def mp_pure_members(r):
    return mapping.auditable(r.members, r.stages).select("stage", "ord", "qualname")


@query("""WITH c AS (SELECT stage AS audited, ord, qualname, CASE WHEN ord % 13 = 0 THEN 'stage-9' ELSE stage END AS source, CASE ord % 5 WHEN 0 THEN 'crosscut-1' WHEN 1 THEN stage WHEN 2 THEN 'nope' ELSE 'stage-2' END AS target FROM {members}),
e AS (SELECT c.*, CASE WHEN source <> audited THEN 'source is not the audited stage' WHEN target = source THEN 'target is the source' WHEN s.id IS NULL THEN 'unknown target' WHEN NOT EXISTS (SELECT 1 FROM {members} m WHERE m.stage = c.source AND m.qualname = c.qualname) THEN 'not a member'
  WHEN s.crosscut THEN 'target is cross-cutting' WHEN EXISTS (SELECT 1 FROM {members} m WHERE m.type = 'region' AND m.qualname = c.qualname) THEN 'function has regions' END AS e0 FROM c LEFT JOIN {stages} s ON s.id = c.target)
SELECT audited, ord, qualname, source, target, CASE WHEN e0 IS NULL AND row_number() OVER (PARTITION BY audited, e0 IS NULL ORDER BY ord) > 3 THEN 'over the limit' ELSE e0 END AS error FROM e""")
def mp_validate_moves(r):
    t = F.col("ord") % 5
    target = F.when(t == 0, "crosscut-1").when(t == 1, F.col("stage")).when(t == 2, "nope").otherwise("stage-2")
    moves = r.members.select(F.col("stage").alias("audited"), "ord", "qualname", F.when(F.col("ord") % 13 == 0, "stage-9").otherwise(F.col("stage")).alias("source"), target.alias("target"))
    return mapping.validate_moves(moves, r.members, r.stages)


@query("SELECT s.ord, s.id AS stage, s.title, count(m.stage) AS n_members FROM {stages} s LEFT JOIN {members} m ON m.stage = s.id GROUP BY ALL")
def mp_stage_sizes(r):
    return mapping.stage_sizes(r.stages, r.members)


@query("SELECT stage, ord FROM {members} m WHERE NOT (type = 'region' AND qualname IN (SELECT qualname FROM {members} WHERE ord % 4 = 0))")
def mp_remove(r):
    gone = r.members.where("ord % 4 = 0").select("qualname", F.lit("region").alias("type"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end")).distinct()
    return mapping.remove_members(r.members, gone).select("stage", "ord")


@query(f"""WITH {NODES}, mk AS (SELECT * FROM (VALUES ('pkg1', 'one'), ('Cls2', 'two'), ('.f10', 'ten')) v(marker, subsystem)), c AS (SELECT DISTINCT n.qualname, k.callee_id FROM {{kept}} k JOIN nodes n ON n.id = k.caller_id AND n.kind = 'internal' WHERE k.callee_id LIKE 'boundary:%')
SELECT m.stage, string_agg(DISTINCT subsystem, ',' ORDER BY subsystem) AS subsystems FROM {{members}} m JOIN c ON c.qualname = m.qualname JOIN mk ON contains(c.callee_id, mk.marker) GROUP BY 1""")
def mp_subsystems(r):
    markers = r.spark.createDataFrame([("pkg1", "one"), ("Cls2", "two"), (".f10", "ten")], "marker string, subsystem string")
    return flat(mapping.derive_subsystems(r.members, nodes_of(r), r.kept, markers), "subsystems")


SNAP = """g AS (SELECT q.req, q.a, q.b, min(s.s) FILTER (s.s >= q.a) AS up, max(s.s) AS lasts, max(s.e) FILTER (s.e <= q.b) AS down, arg_min(s.e, s.s * 10000 + s.e) AS firste, count(s.s) AS n
  FROM {requests} q LEFT JOIN {spans} s ON s.fn = q.fn GROUP BY ALL), h AS (SELECT req, a, b, coalesce(up, lasts) AS x, coalesce(down, firste) AS y, n FROM g),
sn AS (SELECT req, CASE WHEN n = 0 OR y < x THEN a ELSE x END AS "start", CASE WHEN n = 0 OR y < x THEN b ELSE y END AS "end",
  CASE WHEN n = 0 OR y < x THEN 'needs_review' WHEN greatest(abs(a - x), abs(b - y)) > 3 THEN 'needs_review' WHEN greatest(abs(a - x), abs(b - y)) = 0 THEN 'ok' ELSE 'snapped' END AS status,
  CASE WHEN n = 0 OR y < x THEN 0 ELSE greatest(abs(a - x), abs(b - y)) END AS distance FROM h)"""


def snapped(r):
    return regions.snap(r.requests, r.spans, ["fn"])


@query(f"WITH {SNAP} SELECT * FROM sn")
def rg_snap(r):
    return snapped(r).select("req", "start", "end", "status", "distance")


@query(f"WITH {SNAP} SELECT status, count(*) AS n FROM sn GROUP BY 1")
def rg_snap_report(r):
    return regions.snap_report(snapped(r))


@query("SELECT qualname, count(*) AS n_regions FROM {members} WHERE type = 'region' GROUP BY 1 HAVING count(*) >= 2")
def rg_multi_region(r):
    return regions.multi_region(r.members)


@query("SELECT qualname, string_agg(concat(line_start, '-', line_end), ',' ORDER BY line_start, line_end, stage, ord) AS regions FROM {members} WHERE type = 'region' GROUP BY 1")
def rg_gather(r):
    return regions.gather(r.members).select("qualname", F.array_join(F.transform("regions", lambda x: F.concat(x["line_start"].cast("string"), F.lit("-"), x["line_end"].cast("string"))), ",").alias("regions"))


@query("SELECT stage, qualname, min(line_start) AS line_start, max(line_end) AS line_end, arg_min(file, ord) AS file FROM {members} GROUP BY 1, 2")
def rg_envelopes(r):
    return regions.envelopes(r.members)


@query("""WITH f AS (SELECT qualname, min(line_start) AS ls, min(line_end) AS le FROM {functions} WHERE ord % 4 > 0 GROUP BY 1)
SELECT stage, ord, CAST(CASE WHEN ls IS NULL THEN line_start WHEN type = 'function' THEN ls + 10 ELSE line_start + 10 END AS INT) AS line_start, CAST(CASE WHEN ls IS NULL THEN line_end WHEN type = 'function' THEN le + 12 ELSE line_end + 10 END AS INT) AS line_end FROM {members} m LEFT JOIN f ON f.qualname = m.qualname""")
def rg_coordinate_roll(r):
    old = r.functions.where("ord % 4 > 0").groupBy("qualname").agg(F.min("line_start").alias("line_start"), F.min("line_end").alias("line_end"))
    new = old.select("qualname", (F.col("line_start") + 10).alias("line_start"), (F.col("line_end") + 12).alias("line_end"))
    return regions.coordinate_roll(r.members, old, new).select("stage", "ord", "line_start", "line_end")


@query("""WITH RECURSIVE a AS (SELECT concat('q', l_orderkey) AS qualname, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS ord, CASE l_suppkey % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'split' ELSE 'reassign' END AS action,
  CASE WHEN l_suppkey % 3 = 0 THEN [CAST(l_partkey % 4 AS INT), CAST(l_partkey % 4 + 1 AS INT)] ELSE [CAST(l_partkey % 4 AS INT)] END AS refs FROM {lineitem}),
t AS (SELECT qualname, ord, true AS accepted, CASE action WHEN 'merge' THEN [refs[2]] WHEN 'split' THEN refs ELSE [] END AS dead FROM a WHERE ord = 1
  UNION ALL SELECT a.qualname, a.ord, NOT list_has_any(t.dead, a.refs), CASE WHEN list_has_any(t.dead, a.refs) THEN t.dead ELSE list_concat(t.dead, CASE a.action WHEN 'merge' THEN [a.refs[2]] WHEN 'split' THEN a.refs ELSE [] END) END FROM t JOIN a ON a.qualname = t.qualname AND a.ord = t.ord + 1)
SELECT qualname, ord, accepted FROM t""")
def rg_conflicts(r):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    k = (F.col("l_partkey") % 4).cast("int")
    action = F.when(F.col("l_suppkey") % 3 == 0, "merge").when(F.col("l_suppkey") % 3 == 1, "split").otherwise("reassign")
    rows = r.lineitem.select(F.concat(F.lit("q"), "l_orderkey").alias("qualname"), n.alias("ord"), action.alias("action"), F.when(F.col("l_suppkey") % 3 == 0, F.array(k, k + 1)).otherwise(F.array(k)).alias("refs"))
    return regions.conflicts(rows)


@query(f"WITH RECURSIVE {TREE} SELECT id, depth FROM t")
def tr_depth(r):
    return tree.depths(r.stages).select("id", "depth")


@query(f"WITH RECURSIVE {TREE} SELECT ancestor, id, CAST(distance AS INT) AS distance FROM clo")
def tr_closure(r):
    return tree.closure(r.stages)


@query(f"WITH RECURSIVE {TREE} SELECT ancestor AS id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_files FROM clo LEFT JOIN (SELECT stage, count(*) AS n FROM {{file_stage}} GROUP BY 1) f ON f.stage = clo.id GROUP BY 1")
def tr_subtree_counts(r):
    return tree.subtree_counts(r.stages, r.file_stage)


@query(f"""WITH RECURSIVE {TREE}, g AS (SELECT DISTINCT split_part(title, ' ', -1) AS key, id FROM {{stages}}), z AS (SELECT key, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT key, max(m) AS m FROM (SELECT g.key, c.ancestor, count(*) AS m FROM g JOIN clo c ON c.ancestor = g.id AND c.distance > 0 JOIN g h ON h.key = g.key AND h.id = c.id GROUP BY 1, 2) GROUP BY 1) SELECT z.key, n, coalesce(m, 0) = n - 1 AS chain FROM z LEFT JOIN p USING (key)""")
def tr_chain_test(r):
    return tree.chain_test(r.stages.select(F.element_at(F.split("title", " "), -1).alias("key"), "id"), r.stages)


@query(f"WITH RECURSIVE {TREE} SELECT id, depth, CAST(least(depth + 2, 6) AS INT) AS heading, CAST(row_number() OVER (ORDER BY ords, id) AS INT) AS position FROM t")
def tr_pre_order(r):
    return tree.pre_order(r.stages)


@query(f"WITH RECURSIVE {TREE} SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN path[1] LIKE 'stage-%' THEN 0 WHEN path[1] LIKE 'side-%' THEN 1 ELSE 2 END, ords, id) AS INT) AS position FROM t")
def tr_render_order(r):
    return tree.render_order(r.stages)


@query(f"""WITH RECURSIVE {TREE}, own AS (SELECT id, row_number() OVER (PARTITION BY up, up IS NULL AND id LIKE 'stage-%' ORDER BY ord, id) AS k FROM s)
SELECT u.id, string_agg(CAST(own.k AS VARCHAR), '.' ORDER BY u.i) AS chapter FROM (SELECT id, i, path[i] AS step FROM t, unnest(range(1, len(path) + 1)) q(i) WHERE path[1] LIKE 'stage-%') u JOIN own ON own.id = u.step GROUP BY 1""")
def tr_chapters(r):
    return tree.chapter_numbers(r.stages)


@query(f"WITH RECURSIVE {TREE}, o AS (SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN path[1] LIKE 'stage-%' THEN 0 WHEN path[1] LIKE 'side-%' THEN 1 ELSE 2 END, ords, id) AS INT) AS position FROM t) SELECT id, position, lag(id) OVER (ORDER BY position) AS before, lead(id) OVER (ORDER BY position) AS after FROM o")
def tr_prev_next(r):
    return tree.neighbours(r.stages)


@query(f"WITH RECURSIVE {TREE} SELECT u.id, string_agg(x.title, ' / ' ORDER BY u.i) AS trail FROM (SELECT id, i, path[i] AS step FROM t, unnest(range(1, len(path) + 1)) q(i)) u JOIN {{stages}} x ON x.id = u.step GROUP BY 1")
def tr_breadcrumbs(r):
    return tree.breadcrumbs(r.stages)


@query(f"WITH RECURSIVE {TREE} SELECT (SELECT count(*) FROM {{stages}}) AS n_stages, (SELECT count(*) FROM clo JOIN s ON s.id = clo.ancestor AND s.up IS NULL JOIN {{file_stage}} f ON f.stage = clo.id) AS n_files")
def tr_totals(r):
    return tree.landing_totals(r.stages, r.file_stage)


@query("SELECT s.id FROM {stages} s WHERE s.id IN (SELECT parent FROM {stages}) OR s.id IN (SELECT stage FROM {file_stage})")
def tr_with_content(r):
    return tree.with_content(r.stages, r.file_stage).select("id")


@query("""WITH o AS (SELECT stage, file, ord AS position FROM {file_stage} WHERE length(stage) = 9) SELECT * FROM o UNION ALL SELECT stage, file, row_number() OVER (PARTITION BY stage ORDER BY file) - 1 FROM {file_stage} f WHERE stage NOT IN (SELECT stage FROM o)""")
def tr_direct_files(r):
    return tree.direct_files(r.file_stage, r.file_stage.where("length(stage) = 9").select("stage", "file", F.col("ord").alias("position")))


