"""Queries over registers, locators, changes, gates and scores (RE, LO, CH, LM, QS, SC), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_block
from ..operators import changes, gates, locate, regions, registers
from ..sources import markdown
from .graph_queries import flat
from .stage_queries import TREE
from .surrogate import Relations, sql

QUERIES, SQL = {}, {}


def query(text: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return put


@query("""WITH r AS (SELECT ord, trim(id) AS id, trim(semantics) AS semantics, stages FROM {registers} QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY ord) = 1)
SELECT r.ord, r.id, r.semantics, coalesce(string_agg(u.s, ',' ORDER BY u.k) FILTER (u.s IN (SELECT id FROM {stages})), '') AS stages FROM r, LATERAL (SELECT unnest(r.stages) AS s, generate_subscripts(r.stages, 1) AS k) u GROUP BY ALL""")
def re_normalise(r):
    return flat(registers.normalise(r.registers, r.stages), "stages")


@query("SELECT ord, id, unnest(stages) AS stage FROM {registers}")
def re_stage_hits(r):
    return registers.stage_hits(r.registers)


@query(f"""WITH RECURSIVE {TREE}, h AS (SELECT id AS rid, unnest(stages) AS stage FROM {{registers}}), leaf AS (SELECT id FROM {{stages}} WHERE id NOT IN (SELECT up FROM s WHERE up IS NOT NULL)),
cw AS (SELECT id AS leaf, unnest(string_split_regex(lower(title), '[^a-z0-9]+')) AS word FROM {{stages}}), rw AS (SELECT rid, stage, unnest(string_split(replace(lower(rid), 'reg-', ''), '-')) AS word FROM h),
sunk AS (SELECT clo.id AS stage, rw.rid, min(rw.word) AS via FROM rw JOIN clo ON clo.ancestor = rw.stage AND distance > 0 JOIN leaf ON leaf.id = clo.id JOIN cw ON cw.leaf = clo.id AND cw.word = rw.word WHERE length(rw.word) > 2 AND rw.word NOT IN ('reg', 'state', 'catalog', 'store', 'context', 'policy', 'registry', 'config', 'runtime', 'data', 'id', 'identity', 'set', 'cache', 'buffer', 'profile', 'info', 'metadata', 'snapshot', 'window', 'queue') GROUP BY 1, 2)
SELECT stage, rid AS id, '' AS via FROM h UNION ALL SELECT stage, rid, via FROM sunk WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.stage = sunk.stage AND h.rid = sunk.rid)""")
def re_sunk(r):
    concepts = r.stages.select(F.col("id").alias("stage"), F.explode(registers.words_of(F.col("title"))).alias("word"))
    return registers.sunk(r.registers, r.stages, concepts)


@query("SELECT r.id AS register, s.id AS stage FROM {registers} r JOIN {stages} s ON contains(r.semantics, s.id)")
def re_mentions(r):
    return registers.mentions(r.registers, r.stages)


@query("SELECT file, purpose FROM {cards} WHERE role = 'data_model' ORDER BY file LIMIT 120")
def re_evidence(r):
    return registers.evidence(r.cards)


CODE = """SELECT concat('f', o_custkey % 40) AS file, o_orderkey AS line, CASE o_orderkey % 16 WHEN 0 THEN '    def __init__(self):' WHEN 1 THEN '    async def _reset_per_run_state(self):' WHEN 2 THEN 'def work(x):' WHEN 3 THEN '        self.jobs = []' WHEN 4 THEN 'self.jobs.append(1)' WHEN 5 THEN 'if self.jobs == 3:'
  WHEN 6 THEN 'y = cache.get(1)' WHEN 7 THEN 'cache[1] += 2' WHEN 8 THEN 'cache[1][k] //= 2' WHEN 9 THEN 'class Other:' WHEN 10 THEN 'cache.sort (key=f)' WHEN 11 THEN 'cache.push(1)' WHEN 12 THEN '  def inner(self):' WHEN 13 THEN 'cache @= m; self.jobs' WHEN 14 THEN 'cache <= 3' ELSE 'pass' END AS text FROM {orders}"""


SITES = (("reg-jobs", r"self\.jobs\b"), ("reg-cache", "cache"), ("reg-any", "jobs|cache"))


@query(f"""WITH l AS ({CODE}), d AS (SELECT *, CASE WHEN text LIKE 'class %' THEN '?' WHEN text IN ('    def __init__(self):', '    async def _reset_per_run_state(self):', 'def work(x):') THEN regexp_extract(text, 'def (\\w+)', 1) END AS opened FROM l),
m AS (SELECT file, line, text, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING), '?') AS method FROM d),
p AS (SELECT * FROM (VALUES ('reg-jobs', 'self\\.jobs\\b'), ('reg-cache', 'cache'), ('reg-any', 'jobs|cache')) v(id, pattern)),
h AS (SELECT p.id, m.*, substr(text, instr(text, regexp_extract(text, p.pattern)) + length(regexp_extract(text, p.pattern))) AS rest FROM m JOIN p ON regexp_matches(m.text, p.pattern)),
w AS (SELECT *, rest IN (' = []', '.append(1)', '[1] += 2', '[1][k] //= 2', '.sort (key=f)', ' @= m; self.jobs') AS writes FROM h)
SELECT id, file, line, method, CASE WHEN NOT writes THEN 'read' WHEN method = '__init__' THEN 'init' WHEN method = '_reset_per_run_state' THEN 'reset' ELSE 'write' END AS kind FROM w""")
def re_code_sites(r):
    return registers.code_sites(r.spark.sql(CODE, orders=r.orders), r.spark.createDataFrame(SITES, "id string, pattern string"))


@query("SELECT file, arg_max(stage, concat(lpad(CAST(k AS VARCHAR), 9, '0'), stage)) AS stage FROM (SELECT file, stage, ord % 7 AS k FROM {file_stage} UNION ALL SELECT file, concat(stage, 'b'), 3 FROM {file_stage}) GROUP BY 1")
def lo_file_stages(r):
    two = r.file_stage.select("file", "stage", (F.col("ord") % 7).alias("stage_ord")).unionByName(r.file_stage.select("file", F.concat("stage", F.lit("b")).alias("stage"), F.lit(3).alias("stage_ord")))
    return locate.file_stages(two)


RS = "SELECT concat('d', p_partkey % 9, '/', CASE p_partkey % 4 WHEN 0 THEN concat('m', p_partkey // 4, '.rs') WHEN 1 THEN concat('m', p_partkey // 4, '_tests.rs') WHEN 2 THEN concat('m', p_partkey // 5, '_test.rs') ELSE concat('n', p_partkey, '.rs') END) AS file FROM {part}"


@query(f"WITH f AS ({RS}) SELECT a.file, b.file AS twin FROM f a JOIN f b ON b.file IN (concat(regexp_replace(a.file, '\\.rs$', ''), '_tests.rs'), concat(regexp_replace(a.file, '\\.rs$', ''), '_test.rs')) GROUP BY ALL")
def lo_twins(r):
    return locate.twins(r.spark.sql(RS.replace("//", "DIV"), part=r.part).distinct())


TOKENS = "tok AS (SELECT DISTINCT ord, id, w AS word FROM {stages}, unnest(string_split_regex(lower(title), '[^a-z0-9]+')) q(w) WHERE length(w) > 2 AND w NOT IN ('mod', 'lib', 'main', 'src', 'rs', 'errors', 'error', 'tests', 'test', 'common', 'types', 'type', 'util', 'utils', 'helpers', 'helper', 'win', 'unix', 'core', 'the', 'and', 'for', 'of', 'to', 'a', 'an', 'with', 'support', 'services', 'service', 'startup', 'runtime', 'shared', 'cross', 'cutting', 'local', 'data', 'user', 'system', 'management', 'handling', 'primitives', 'miscellaneous', 'small', 'libraries', 'library'))"


@query(f"WITH {TOKENS} SELECT word, count(DISTINCT id) AS df FROM tok GROUP BY 1")
def lo_token_df(r):
    return locate.token_df(r.stages)


COLLIDE = f"""{TOKENS}, few AS (SELECT word, count(*) AS df, string_agg(id, ',' ORDER BY ord, id) AS stages FROM tok GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6),
ch AS (SELECT a.word FROM tok a JOIN few USING (word) JOIN clo ON clo.ancestor = a.id AND distance > 0 JOIN tok b ON b.word = a.word AND b.id = clo.id GROUP BY a.word, a.id, few.df HAVING count(*) = few.df - 1)"""


@query(f"WITH RECURSIVE {TREE}, {COLLIDE} SELECT word, df, stages FROM few WHERE word NOT IN (SELECT word FROM ch)")
def lo_collisions(r):
    return flat(locate.collisions(r.stages), "stages").select("word", "df", "stages")


@query(f"WITH RECURSIVE {TREE}, {COLLIDE} SELECT tok.id AS stage, string_agg(word, ',' ORDER BY word) AS words FROM tok WHERE word IN (SELECT word FROM few) AND word NOT IN (SELECT word FROM ch) GROUP BY 1")
def lo_stage_collisions(r):
    return flat(locate.stage_collisions(locate.collisions(r.stages)), "words")


GROUPED = "SELECT concat('s', ord % 9) AS stage, ord % 3 AS g_ord, ord AS f_ord, file, n_functions, role FROM {cards}"


@query(f"WITH g AS ({GROUPED}) SELECT stage, g_ord, arg_max(file, n_functions * 1000000 - f_ord) AS file FROM g WHERE n_functions > 0 GROUP BY 1, 2")
def lo_exemplar(r):
    return locate.exemplars(r.spark.sql(GROUPED, cards=r.cards))


@query(f"WITH g AS ({GROUPED}) SELECT stage, CAST(k AS INT) AS rank, file, role, n_functions FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY coalesce(nullif(list_position(['entrypoint', 'orchestration', 'domain_logic', 'data_model', 'io', 'adapter', 'config', 'util', 'test'], role), 0), 99), n_functions DESC, file) AS k FROM g) WHERE k <= 6")
def lo_core_files(r):
    return locate.core_files(r.spark.sql(GROUPED, cards=r.cards))


@query("""WITH x AS (SELECT stage, stem, min(ord) AS position FROM (SELECT stage, ord, regexp_extract(regexp_extract(file, '([^/]*)$', 1), '^(.*?)(\\.[^.]*)?$', 1) AS stem FROM {file_stage}) GROUP BY 1, 2)
SELECT stage, string_agg(stem, ',' ORDER BY k) AS concepts FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY position, stem) AS k FROM x WHERE stem NOT IN ('mod', 'lib', 'main', 'src', 'rs', 'errors', 'error', 'tests', 'test', 'common', 'types', 'type', 'util', 'utils', 'helpers', 'helper', 'win', 'unix', 'core', 'the', 'and', 'for', 'of', 'to', 'a', 'an', 'with', 'support', 'services', 'service', 'startup', 'runtime', 'shared', 'cross', 'cutting', 'local', 'data', 'user', 'system', 'management', 'handling', 'primitives', 'miscellaneous', 'small', 'libraries', 'library')) WHERE k <= 8 GROUP BY 1""")
def lo_entry_concepts(r):
    return flat(locate.entry_concepts(r.file_stage.withColumn("position", F.col("ord"))), "concepts")


@query("SELECT doc_id, trim(replace(split_part(text, chr(10) || chr(10), 1), chr(10), ' ')) AS duty FROM {documents}")
def lo_duty(r):
    return r.documents.select("doc_id", locate.duty_line(F.col("text")).alias("duty"))


@query("""WITH m AS (SELECT DISTINCT CASE WHEN ord % 2 = 0 THEN qualname ELSE concat('fn', ord % 700) END AS token FROM {members}), a AS (SELECT qualname AS token, count(DISTINCT id) AS n FROM {functions} GROUP BY 1), b AS (SELECT name AS token, count(DISTINCT id) AS n FROM {functions} GROUP BY 1)
SELECT token, coalesce(a.n, 0) AS n_full, coalesce(b.n, 0) AS n_short FROM m LEFT JOIN a USING (token) LEFT JOIN b USING (token) WHERE coalesce(a.n, 0) > 1 OR (coalesce(a.n, 0) = 0 AND coalesce(b.n, 0) > 1)""")
def lo_ambiguous(r):
    token = F.when(F.col("ord") % 2 == 0, F.col("qualname")).otherwise(F.concat(F.lit("fn"), F.col("ord") % 700))
    return locate.ambiguous_names(r.members.select(token.alias("token")), r.functions)


@query("SELECT file, name, min(id) AS id FROM {functions} GROUP BY 1, 2 HAVING count(*) = 1")
def lo_short_anchors(r):
    return locate.unique_short_names(r.functions)


@query("SELECT DISTINCT file FROM {scanned} WHERE file IN (SELECT file FROM {file_stage} WHERE ord % 3 = 0)")
def lo_documented(r):
    return locate.documented(r.scanned, r.file_stage.where("ord % 3 = 0"))


@query("""WITH n AS (SELECT DISTINCT token, file, id FROM (SELECT qualname AS token, file, id FROM {functions} UNION ALL SELECT name, file, id FROM {functions})), s AS (SELECT token, file, count(*) AS c, min(id) AS i FROM n GROUP BY 1, 2), a AS (SELECT token, count(*) AS c, min(id) AS i FROM n GROUP BY 1),
m AS (SELECT ord AS page, file, qualname AS self, CASE ord % 5 WHEN 0 THEN qualname WHEN 1 THEN 'mac!' WHEN 2 THEN 'ext!' WHEN 3 THEN concat('fn', ord % 1600) ELSE 'print' END AS token FROM {members}),
k AS (SELECT m.*, CASE WHEN m.token = self THEN 'self' WHEN m.token = 'ext!' THEN 'external' WHEN m.token = 'mac!' THEN 'macro' WHEN s.c = 1 THEN 'file' WHEN a.c = 1 THEN 'global' WHEN a.c > 1 THEN 'ambiguous' WHEN m.token = 'print' THEN 'external' ELSE 'plain' END AS kind, s.i AS si, a.i AS ai FROM m LEFT JOIN s ON s.token = m.token AND s.file = m.file LEFT JOIN a ON a.token = m.token)
SELECT page, token, kind, CASE kind WHEN 'file' THEN si WHEN 'global' THEN ai WHEN 'external' THEN concat('url:', token) END AS target FROM k""")
def lo_links(r):
    k = F.col("ord") % 5
    token = F.when(k == 0, F.col("qualname")).when(k == 1, "mac!").when(k == 2, "ext!").when(k == 3, F.concat(F.lit("fn"), F.col("ord") % 1600)).otherwise("print")
    m = r.members.select(F.col("ord").alias("page"), "file", F.col("qualname").alias("self"), token.alias("token"))
    macros = r.spark.createDataFrame([("mac!",)], "name string")
    return locate.resolve_links(m, r.functions, macros, r.spark.createDataFrame([("ext!", "url:ext!"), ("print", "url:print")], "name string, url string"))


@query("""WITH k AS (SELECT file, CASE WHEN ord % 17 > 0 THEN content END AS a FROM {contents} WHERE ord % 10 > 0), e AS (SELECT file, CASE WHEN ord % 5 = 0 THEN concat(content, '!') ELSE content END AS b FROM {contents} WHERE ord % 7 > 0)
SELECT coalesce(k.file, e.file) AS file, CASE WHEN e.file IS NULL THEN 'removed' WHEN k.file IS NULL THEN 'new' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS verdict FROM k FULL JOIN e ON e.file = k.file""")
def ch_file_verdicts(r):
    return verdicts(r)


def verdicts(r):
    c = r.contents
    edited = c.where("ord % 7 > 0").select("file", F.when(F.col("ord") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return changes.file_verdicts(c.where("ord % 10 > 0").select("file", F.when(F.col("ord") % 17 > 0, F.col("content")).alias("content")), edited)


VERDICT = """v AS (SELECT coalesce(k.file, e.file) AS file, CASE WHEN e.file IS NULL THEN 'removed' WHEN k.file IS NULL THEN 'new' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS verdict FROM
  (SELECT file, CASE WHEN ord % 17 > 0 THEN content END AS a FROM {contents} WHERE ord % 10 > 0) k FULL JOIN (SELECT file, CASE WHEN ord % 5 = 0 THEN concat(content, '!') ELSE content END AS b FROM {contents} WHERE ord % 7 > 0) e ON e.file = k.file),
fs AS (SELECT file, concat('stage-', ord % 20) AS stage, ord FROM {contents} WHERE ord % 10 > 0), nw AS (SELECT file, concat('stage-', ord % 23) AS stage FROM {contents} WHERE ord % 4 > 0),
syn AS (SELECT file, stage FROM fs WHERE file NOT IN (SELECT file FROM v WHERE verdict = 'removed') UNION ALL SELECT v.file, coalesce(nw.stage, 'unassigned') FROM v LEFT JOIN nw ON nw.file = v.file WHERE verdict = 'new')"""


def synced(r):
    fs = r.contents.where("ord % 10 > 0").select("file", F.concat(F.lit("stage-"), F.col("ord") % 20).alias("stage"))
    return fs, changes.sync_buckets(fs, verdicts(r), r.contents.where("ord % 4 > 0").select("file", F.concat(F.lit("stage-"), F.col("ord") % 23).alias("stage")))


@query(f"WITH {VERDICT} SELECT file FROM {{cards}} WHERE file NOT IN (SELECT file FROM v WHERE verdict IN ('changed', 'removed'))")
def ch_stale_cards(r):
    return changes.stale_cards(r.cards.select("file"), verdicts(r))


@query("SELECT CASE WHEN count(*) = 0 OR bool_or(description <> '') THEN 'deep' ELSE 'brief' END AS detail FROM {cards}")
def ch_detail(r):
    return changes.detail(r.cards)


@query(f"WITH {VERDICT} SELECT file, stage FROM syn")
def ch_sync_buckets(r):
    return synced(r)[1]


@query(f"""WITH {VERDICT} SELECT coalesce(f.stage, s.stage) AS stage, CASE WHEN count(s.file) = 0 THEN 'drop' WHEN count(*) FILTER (f.file IS NULL) > 0 THEN 'reorganise' WHEN count(*) FILTER (s.file IS NULL) > 0 THEN 'prune' ELSE 'keep' END AS plan
FROM fs f FULL JOIN (SELECT * FROM syn WHERE stage <> 'unassigned') s ON s.file = f.file AND s.stage = f.stage GROUP BY 1""")
def ch_sync_plan(r):
    return changes.sync_plan(*synced(r))


OLDNEW = """o AS (SELECT id AS qualname, file, name, ord, text FROM {functions} WHERE ord % 6 > 0), n AS (SELECT CASE WHEN ord % 8 = 0 THEN concat(id, '_new') ELSE id END AS qualname, file, name, ord, CASE WHEN ord % 5 = 0 THEN concat(text, 'x') ELSE text END AS text FROM {functions} WHERE ord % 9 > 0), l AS (SELECT id AS qualname FROM {functions} WHERE ord % 4 > 0)"""


def two_trees(r):
    f = r.functions
    old = f.where("ord % 6 > 0").select(F.col("id").alias("qualname"), "file", "name", "ord", "text")
    new = f.where("ord % 9 > 0").select(
        F.when(F.col("ord") % 8 == 0, F.concat("id", F.lit("_new"))).otherwise(F.col("id")).alias("qualname"), "file", "name", "ord", F.when(F.col("ord") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text")
    )
    return old, new, f.where("ord % 4 > 0").select(F.col("id").alias("qualname"))


@query(f"WITH {OLDNEW} SELECT l.qualname, CASE WHEN o.text IS NULL THEN 'unparsable' WHEN n.text IS NULL THEN 'gone' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS verdict FROM l LEFT JOIN o USING (qualname) LEFT JOIN n USING (qualname)")
def ch_function_verdicts(r):
    old, new, ledger = two_trees(r)
    return changes.function_verdicts(ledger, old, new)


@query(f"WITH {OLDNEW} SELECT qualname FROM n WHERE qualname NOT IN (SELECT qualname FROM l) AND qualname NOT IN (SELECT qualname FROM o)")
def ch_new_defs(r):
    old, new, ledger = two_trees(r)
    return changes.new_definitions(ledger, old, new).select("qualname")


@query(f"""WITH {OLDNEW}, g AS (SELECT o.*, regexp_replace(text, '^[^\\n]*\\n?', '') AS b FROM o WHERE qualname NOT IN (SELECT qualname FROM n)), w AS (SELECT n.*, regexp_replace(text, '^[^\\n]*\\n?', '') AS b FROM n WHERE qualname NOT IN (SELECT qualname FROM o)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY file, b ORDER BY ord, qualname) AS k FROM g), w2 AS (SELECT *, row_number() OVER (PARTITION BY file, b ORDER BY ord, qualname) AS k FROM w) SELECT g2.file, g2.qualname AS old_name, w2.qualname AS new_name FROM g2 JOIN w2 USING (file, b, k)""")
def ch_renames(r):
    old, new, _ = two_trees(r)
    return changes.renames(old.join(new.select("qualname"), "qualname", "left_anti"), new.join(old.select("qualname"), "qualname", "left_anti"))


@query("SELECT qualname, 'missed' AS kind FROM (SELECT DISTINCT qualname FROM {members} WHERE ord % 3 = 0 AND qualname NOT IN (SELECT qualname FROM {members} WHERE ord % 2 = 0)) UNION ALL SELECT qualname, 'unplanned' FROM (SELECT DISTINCT qualname FROM {members} WHERE ord % 2 = 0 AND qualname NOT IN (SELECT qualname FROM {members} WHERE ord % 3 = 0))")
def ch_reconcile(r):
    return changes.reconcile(r.members.where("ord % 2 = 0"), r.members.where("ord % 3 = 0"))


@query("SELECT kind, d.qualname FROM (SELECT CASE ord % 3 WHEN 0 THEN 'will_modify' WHEN 1 THEN 'will_add' ELSE 'will_remove' END AS kind, qualname FROM {members}) d WHERE (kind = 'will_add') = (qualname IN (SELECT qualname FROM {functions} WHERE ord % 2 = 0))")
def ch_declarations(r):
    k = F.col("ord") % 3
    d = r.members.select(F.when(k == 0, "will_modify").when(k == 1, "will_add").otherwise("will_remove").alias("kind"), "qualname")
    return changes.check_declarations(d, r.functions.where("ord % 2 = 0"))


@query("""WITH f AS (SELECT ord, id AS caller, concat('x = fn', ord % 300, ' (1) + g', ord % 7, '(2)') AS text FROM {functions}), n AS (SELECT concat('new', ord) AS qualname, concat('fn', ord) AS name FROM {functions} WHERE ord % 5 = 0), m AS (SELECT concat('f', ord) AS caller, arg_min(stage, ord) AS stage FROM {members} GROUP BY 1)
SELECT n.qualname, coalesce(arg_min(m.stage, f.ord), 'unmapped') AS stage FROM n LEFT JOIN f ON regexp_matches(f.text, concat('\\b', n.name, '\\s*\\(')) AND f.caller <> n.qualname LEFT JOIN m ON m.caller = f.caller GROUP BY 1""")
def ch_placement(r):
    f = r.functions.select("ord", F.col("id").alias("qualname"), F.concat(F.lit("x = fn"), F.col("ord") % 300, F.lit(" (1) + g"), F.col("ord") % 7, F.lit("(2)")).alias("text"))
    new = r.functions.where("ord % 5 = 0").select(F.concat(F.lit("new"), "ord").alias("qualname"), F.concat(F.lit("fn"), "ord").alias("name"))
    return changes.fallback_placement(new, f, r.members.withColumn("qualname", F.concat(F.lit("f"), "ord")))


@query("""WITH a AS (SELECT DISTINCT stage, qualname, 5 AS line_start, 9 AS line_end FROM {members} WHERE ord % 4 = 0), e AS (SELECT stage, qualname, min(line_start) AS s, max(line_end) AS t FROM {members} WHERE ord % 3 > 0 GROUP BY 1, 2), u AS (SELECT qualname, min(s) AS s, min(t) AS t FROM e GROUP BY 1 HAVING count(*) = 1)
SELECT a.*, coalesce(e.s, u.s) AS to_start, coalesce(e.t, u.t) AS to_end FROM a LEFT JOIN e USING (stage, qualname) LEFT JOIN u USING (qualname) WHERE coalesce(e.s, u.s) <> 5 OR coalesce(e.t, u.t) <> 9""")
def ch_anchor_plan(r):
    anchors = r.members.where("ord % 4 = 0").select("stage", "qualname", F.lit(5).alias("line_start"), F.lit(9).alias("line_end")).distinct()
    return changes.anchor_plan(anchors, regions.envelopes(r.members.where("ord % 3 > 0")))


@query("""WITH m AS (SELECT DISTINCT id AS qualname, CASE WHEN ord % 7 = 0 THEN 'x' ELSE sha1(text) END AS h, text, ord FROM {functions} WHERE ord % 3 > 0), c AS (SELECT id AS qualname FROM {functions} WHERE ord % 5 > 0), fz AS (SELECT id AS qualname FROM {functions} WHERE ord % 11 = 0),
p AS (SELECT 'hash' AS problem, qualname FROM m WHERE h <> sha1(text) UNION ALL SELECT 'entry without card', qualname FROM m WHERE qualname NOT IN (FROM c) UNION ALL SELECT 'card without entry', qualname FROM c WHERE qualname NOT IN (SELECT qualname FROM m)) SELECT * FROM p WHERE qualname NOT IN (FROM fz)""")
def ch_integrity(r):
    f = r.functions.select(F.col("id").alias("qualname"), "text", "ord")
    m = f.where("ord % 3 > 0").withColumn("sha1", F.when(F.col("ord") % 7 == 0, "x").otherwise(F.sha1("text")))
    return changes.integrity(m, f.select("qualname", "text"), f.where("ord % 5 > 0"), f.where("ord % 11 = 0"))


GATE = """g AS (SELECT proposal, round, bool_and(decision = 'APPROVE') AS al, bool_or(decision = 'REJECT') AS rj FROM {verdicts} GROUP BY 1, 2), z AS (SELECT p.proposal, coalesce(a.al, false) AS a1, coalesce(a.rj, false) AS r1, b.proposal IS NOT NULL AS two, coalesce(b.rj, false) AS r2 FROM (SELECT DISTINCT proposal FROM {verdicts}) p LEFT JOIN g a ON a.proposal = p.proposal AND a.round = 1 LEFT JOIN g b ON b.proposal = p.proposal AND b.round = 2)"""


@query(f"WITH {GATE} SELECT proposal, CASE WHEN a1 THEN 'accept 1' WHEN r1 THEN 'discard' WHEN two AND NOT r2 THEN 'accept 2' ELSE 'discard' END AS outcome FROM z")
def lm_gate_single(r):
    return gates.gate_single(r.verdicts)


@query(f"WITH {GATE} SELECT proposal, CASE WHEN a1 THEN 'accept 1' WHEN two AND NOT r2 THEN 'accept 2' ELSE 'discard' END AS outcome FROM z")
def lm_gate_multi(r):
    return gates.gate_multi(r.verdicts)


@query("SELECT proposal, round, string_agg(concat('[', role, '] ', c), chr(10) ORDER BY role_ord, c) AS concerns FROM (SELECT *, unnest(concerns) AS c FROM {verdicts}) GROUP BY 1, 2")
def lm_concerns(r):
    return gates.concerns(r.verdicts)


@query(f"WITH {GATE} SELECT proposal, CASE WHEN a1 OR (NOT r1 AND two AND NOT r2) THEN 'ACCEPTED' ELSE 'DISCARDED' END AS label FROM z")
def lm_label(r):
    return gates.label(gates.gate_single(r.verdicts)).select("proposal", "label")


@query("SELECT event_type AS phase, concat('m', user_id % 3) AS model, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out FROM {events} GROUP BY 1, 2")
def lm_usage(r):
    k = F.get_json_object("props", "$.k").cast("long")
    return gates.usage(r.events.select(F.col("event_type").alias("phase"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), k.alias("tokens_in"), F.col("user_id").alias("tokens_out")))


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REVISE' WHEN 2 THEN 'maybe' ELSE 'reject' END AS d, event_id % 3 = 0 AS c FROM {events}) SELECT event_id, CASE WHEN d = 'maybe' THEN NULL WHEN d = 'REVISE' AND NOT c THEN 'APPROVE' ELSE upper(d) END AS decision FROM v""")
def lm_parse_verdict(r):
    k = F.col("event_id") % 4
    decision = F.when(k == 0, "APPROVE").when(k == 1, "REVISE").when(k == 2, "maybe").otherwise("reject")
    concerns = F.when(F.col("event_id") % 3 == 0, '["x"]').otherwise('[" "]')
    reply = F.concat(F.lit('{"decision": "'), decision, F.lit('", "concerns": '), concerns, F.lit("}"))
    return gates.parse_verdict(r.events.select("event_id", reply.alias("reply"))).select("event_id", "decision")


@query("""WITH g AS (SELECT u.unit, b.*, greatest(1, least(5, coalesce((SELECT max(TRY_CAST(s.score AS INT)) FROM {scores} s WHERE s.unit = u.unit AND s.criterion = b.criterion), 1))) AS s FROM (SELECT DISTINCT unit FROM {scores}) u, {rubric} b)
SELECT unit, round(CAST(sum(CAST(weight AS DECIMAL(18,6)) * s) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE), 3) AS overall, count(*) FILTER (kind = 'gate' AND s < floor) AS gate_failures,
  sum(CAST(weight AS DECIMAL(18,6)) * s) >= 4 * sum(CAST(weight AS DECIMAL(18,6))) AND count(*) FILTER (kind = 'gate' AND s < floor) = 0 AS passed FROM g GROUP BY 1""")
def qs_verdict(r):
    return gates.weighted_verdict(r.rubric, r.scores)


@query("""WITH x AS (SELECT *, passed OR coalesce(overall - max(overall) OVER (PARTITION BY unit ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.05, false) AS stop FROM {rounds}), y AS (SELECT *, min(round) FILTER (stop) OVER (PARTITION BY unit) AS stop_at FROM x)
SELECT unit, max(round) AS rounds, arg_max(round, overall * 1000 - round) AS best FROM y WHERE stop_at IS NULL OR round <= stop_at GROUP BY 1""")
def qs_best_of_n(r):
    return gates.best_of_n(r.rounds)


@query("SELECT stage, qualname, min(ord) AS ord, count(*) AS n_entries, CASE WHEN count(*) > 1 THEN 'multi_region' ELSE 'single' END AS kind FROM {members} GROUP BY 1, 2")
def qs_units(r):
    return gates.units(r.members)


@query("SELECT stage, qualname, coalesce(string_agg(qualname, ',') OVER (PARTITION BY stage ORDER BY ord, qualname ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM (SELECT stage, qualname, min(ord) AS ord FROM {members} GROUP BY 1, 2)")
def qs_siblings(r):
    return flat(gates.siblings(gates.units(r.members)), "before").select("stage", "qualname", "before")


@query("""WITH u AS (SELECT ord, CASE ord % 4 WHEN 0 THEN 'single' WHEN 3 THEN 'odd' ELSE 'multi_region' END AS kind, CASE WHEN ord % 7 = 0 THEN ' ' ELSE 'p' END AS purpose, CASE WHEN ord % 11 = 0 THEN '' ELSE 'd' END AS data_flow, ord % 3 AS n_regions, ord % 2 AS n_told FROM {members})
SELECT ord, CASE WHEN kind = 'odd' THEN 'unknown kind' WHEN trim(purpose) = '' THEN 'no purpose' WHEN data_flow = '' THEN 'no data flow' WHEN kind = 'single' AND n_told <> 1 THEN 'one text expected' WHEN kind = 'multi_region' AND n_told <> n_regions THEN 'a text a region expected' END AS error FROM u""")
def qs_validate(r):
    o = F.col("ord")
    u = r.members.select(
        "ord", F.when(o % 4 == 0, "single").when(o % 4 == 3, "odd").otherwise("multi_region").alias("kind"), F.when(o % 7 == 0, " ").otherwise("p").alias("purpose"), F.when(o % 11 == 0, "").otherwise("d").alias("data_flow"), (o % 3).alias("n_regions"), (o % 2).alias("n_told")
    )
    return gates.validate_translation(u).select("ord", "error")


MARKDOWN = "SELECT s.ord AS doc, concat('## Stage ', s.title, ' — `', s.id, '`', chr(10), chr(10), coalesce(s.description, ''), chr(10), 'second line', chr(10), chr(10), 'other') AS text FROM {stages} s"


@query("SELECT doc, id, title, description FROM (SELECT s.ord AS doc, s.id, s.title, trim(concat(coalesce(s.description, ''), ' second line')) AS description FROM {stages} s)")
def sc_headings(r):
    return markdown.skeleton(r.spark.sql(MARKDOWN, stages=r.stages)).select("doc", "id", "title", "description")


@query("SELECT p_partkey AS doc, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['will_modify', 'will_add'] ELSE ['will_remove'] END) AS kind, unnest(CASE WHEN p_partkey % 3 = 0 THEN [concat('f', p_partkey), 'g'] ELSE ['h'] END) AS qualname FROM {part}")
def sc_declarations(r):
    three = F.concat(F.lit('text\n```json\n{"will_add": ["old"]}\n```\nmore\n```json\n{"will_modify": ["f'), "p_partkey", F.lit('", 3], "will_add": ["g"]}\n```\n'))
    one = F.lit('```json\n{broken\n```\n```json\n{"will_remove": ["h"]}\n```')
    return markdown.declarations(r.part.select(F.col("p_partkey").alias("doc"), F.when(F.col("p_partkey") % 3 == 0, three).otherwise(one).alias("text")))


@query("SELECT event_id, props AS json FROM {events}")
def lm_json_block(r):
    text = F.concat(F.lit("Answer {no} "), F.col("props"), F.lit(" done"))
    return r.events.select("event_id", json_block.extract_json(text).alias("json"))


@query("""WITH x AS (SELECT qualname, stage, line_start, line_end, purpose, ord, row_number() OVER (PARTITION BY qualname ORDER BY line_start, line_end, stage, purpose) AS k FROM {members} WHERE type = 'region'),
g AS (SELECT qualname, count(*) AS n, min(ord) % 3 AS a FROM x GROUP BY 1), y AS (SELECT x.*, n, CASE WHEN n > 1 THEN a ELSE -1 END AS a FROM x JOIN g USING (qualname))
SELECT qualname, stage, line_start, line_end, purpose FROM y WHERE a = -1 OR k > 2 OR (a > 0 AND k > 1) OR (a = 1 AND line_start >= line_end)
UNION ALL SELECT qualname, max(CASE WHEN k = 1 THEN stage END), min(line_start), max(line_end), 'both' FROM y WHERE a = 0 AND k <= 2 GROUP BY 1
UNION ALL SELECT qualname, stage, line_start, CASE WHEN h = 0 THEN line_start ELSE line_end END, purpose FROM (SELECT y.*, h, CASE WHEN h = 0 THEN y.line_start ELSE y.line_start + 1 END AS from_line FROM y, (VALUES (0), (1)) v(h) WHERE a = 1 AND k = 1 AND y.line_start < y.line_end) z WHERE h = 0
UNION ALL SELECT qualname, stage, line_start + 1, line_end, purpose FROM y WHERE a = 1 AND k = 1 AND line_start < line_end
UNION ALL SELECT qualname, 'stage-1', line_start, line_end, purpose FROM y WHERE a = 2 AND k = 1""")
def rg_revise(r):
    """Merges, splits and reassignments, one a function by its first region's order."""
    row = r.members.where("type = 'region'")
    first = F.min(F.struct("line_start", "line_end", "stage", "purpose"))["line_start"]
    g = row.groupBy("qualname").agg(F.count("*").alias("n"), (F.min("ord") % 3).alias("k"), first.alias("at")).where("n > 1")
    action = F.when(F.col("k") == 0, "merge").when(F.col("k") == 1, "split").otherwise("reassign")
    refs = F.when(F.col("k") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    actions = g.select("qualname", F.lit(0).alias("ord"), action.alias("action"), refs.alias("refs"), "at", F.lit("stage-1").alias("target"), F.lit("both").alias("purpose"))
    return regions.revise(row, actions)
