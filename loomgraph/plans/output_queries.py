"""Queries over renderers, requests and drivers (SK, LO, PL, AS, DR, OR, MP, RG, QS, CH, LM), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, mapping, nav, render, stages
from ..sources import artifacts, markdown
from . import dialogue, drivers, requests
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


NL = "chr(10)"
KIDS = "kids AS (SELECT c.parent AS id, string_agg(c.id, ',' ORDER BY c.ord, c.id) AS children FROM {stages} c JOIN {stages} p ON p.id = c.parent WHERE c.parent <> c.id GROUP BY 1)"


@query(f"WITH {KIDS} SELECT s.id AS doc, s.id, s.title, CASE WHEN s.ord % 2 = 0 THEN concat(s.description, {NL}, 'more: \"x\"') ELSE s.description END AS description, s.parent, s.crosscut, coalesce(children, '') AS children FROM {{stages}} s LEFT JOIN kids ON kids.id = s.id")
def sc_skeleton_yaml(r):
    """Skeleton YAML written and read back."""
    s = r.stages.withColumn("description", F.when(F.col("ord") % 2 == 0, F.concat("description", F.lit('\nmore: "x"'))).otherwise(F.col("description")))
    text = artifacts.skeleton_yaml(s).join(s.select("ord", F.col("id").alias("doc")), "ord")
    return flat(artifacts.load_skeleton(text), "children").select("doc", "id", "title", "description", "parent", "crosscut", "children")


UNITS = "SELECT stage, ord, qualname, purpose AS text FROM {members}"


@query(f"SELECT s.id AS stage, count(u.ord) AS n, coalesce(string_agg(concat(u.qualname, ':', u.text), '|' ORDER BY u.ord, u.qualname, u.text) FILTER (u.ord IS NOT NULL), '') AS functions FROM {{stages}} s LEFT JOIN ({UNITS}) u ON u.stage = s.id GROUP BY 1")
def sk_document_json(r):
    """Handbook JSON written and read back."""
    st, units = artifacts.document_rows(artifacts.document_json(r.stages, r.spark.sql(UNITS, members=r.members)))
    rows = F.array_sort(F.collect_list(F.struct("ord", "qualname", "text")))
    u = units.groupBy(F.col("stage").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda s: F.concat(s["qualname"], F.lit(":"), s["text"])), "|").alias("functions"))
    return st.select("id").join(u, "id", "left").select(F.col("id").alias("stage"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("functions", F.lit("")).alias("functions"))


CARD = "SELECT file, ord, id, qualname, CASE WHEN ord % 5 = 0 THEN ' ' ELSE concat('Does ', ord % 40) END AS purpose, CASE WHEN ord % 3 = 0 THEN CAST(NULL AS VARCHAR(9)) ELSE concat('in ', ord % 7) END AS data_flow, CASE WHEN ord % 2 = 0 THEN concat('calls ', ord % 9) ELSE '' END AS relations FROM {functions}"
CARD_TEXT = f"concat_ws({NL} || {NL}, concat('### `', qualname, '`'), nullif(trim(purpose), ''), '**Data flow.** ' || nullif(trim(data_flow), ''), '**Relations.** ' || nullif(trim(relations), ''))"


@query(f"SELECT file, ord, id, {CARD_TEXT} AS text FROM ({CARD}) c")
def sk_function_cards(r):
    return render.function_cards(r.spark.sql(CARD.replace("VARCHAR(9)", "STRING"), functions=r.functions))


@query(f"WITH c AS ({CARD}), f AS (SELECT DISTINCT file FROM {{functions}}), t AS (SELECT file, string_agg({CARD_TEXT}, {NL} || {NL} ORDER BY ord, id) AS cards FROM c GROUP BY 1) SELECT f.file, concat_ws({NL} || {NL}, concat('## `', f.file, '`'), 'About it', '**Role.** util', cards) AS text FROM f LEFT JOIN t USING (file)")
def sk_file_cards(r):
    cards = r.functions.select("file").distinct().select("file", F.lit("About it ").alias("purpose"), F.lit("util").alias("role"), F.lit("").alias("lifecycle"), F.lit(None).cast("string").alias("description"))
    return render.file_cards(cards, r.spark.sql(CARD.replace("VARCHAR(9)", "STRING"), functions=r.functions))


@query(f"""WITH RECURSIVE {TREE}, l AS (SELECT stage AS id, string_agg(concat('- `', file, '`', CASE WHEN ord % 4 = 0 THEN '' ELSE concat(': P', ord) END), {NL} ORDER BY ord, file) AS files FROM {{file_stage}} GROUP BY 1)
SELECT s.id, concat_ws({NL} || {NL}, concat(repeat('#', CAST(least(t.depth + 2, 6) AS INT)), ' ', s.title, ' — `', s.id, '`'), nullif(trim(s.description), ''), l.files) AS text FROM {{stages}} s JOIN t ON t.id = s.id LEFT JOIN l ON l.id = s.id""")
def sk_stage_pages(r):
    files = r.file_stage.select("stage", F.col("ord").alias("position"), "file", F.when(F.col("ord") % 4 == 0, " ").otherwise(F.concat(F.lit("P"), "ord")).alias("purpose"))
    return render.stage_pages(r.stages, files).select("id", "text")


@query(f"WITH RECURSIVE {TREE} SELECT s.id, concat(repeat('  ', CAST(t.depth AS INT)), '- ', s.title, ' (`', s.id, '`)') AS text FROM {{stages}} s JOIN t ON t.id = s.id")
def sk_index_lines(r):
    return render.index_lines(r.stages).select(F.regexp_extract("text", r"\(`([^`]*)`\)$", 1).alias("id"), "text")


@query("""SELECT s.id, concat_ws(chr(10), concat('Stage `', s.id, '`'), CASE WHEN ord % 3 > 0 THEN concat('Entry: e', ord) END, CASE WHEN ord % 2 = 0 THEN concat('Core files: a', ord, ', b') END, CASE WHEN ord % 5 = 0 THEN 'Registers: reg-x' END) AS text FROM {stages} s""")
def lo_locator_blocks(r):
    none = F.array().cast("array<string>")
    o = F.col("ord")
    signals = r.stages.select(
        "id", F.when(o % 3 > 0, F.concat(F.lit("e"), o)).otherwise(" ").alias("entry"), F.when(o % 2 == 0, F.array(F.concat(F.lit("a"), o), F.lit("b"))).otherwise(none).alias("core"), none.alias("concepts"),
        F.when(o % 5 == 0, F.array(F.lit("reg-x"))).alias("registers"), none.alias("confused"),
    )
    return render.locator_blocks(r.stages, signals)


@query(f"WITH c AS ({CARD}) SELECT id, concat_ws({NL} || {NL}, concat('### `', qualname, '`'), nullif(trim(purpose), ''), '**Relations.** ' || nullif(trim(relations), '')) AS text FROM c")
def pl_locator_only(r):
    return render.function_cards(r.spark.sql(CARD.replace("VARCHAR(9)", "STRING"), functions=r.functions)).select("id", render.locator_only(F.col("text")).alias("text"))


@query(f"SELECT ord, concat('### ', id, {NL}, '<!-- enriched -->', {NL}, 'see $1 and \\', ord, {NL}, '<!-- /enriched -->', {NL}, semantics) AS text FROM {{registers}}")
def re_enriched(r):
    """Enrichment put twice, with characters that mean something to replacements."""
    add = F.concat(F.lit("see $1 and \\"), "ord")
    t = r.registers.select("ord", F.concat(F.lit("### "), "id", F.lit("\n"), "semantics").alias("text"), add.alias("a"))
    t = t.withColumn("text", render.enriched(F.col("text"), F.lit("old")))
    return t.select("ord", render.enriched(render.enriched(F.col("text"), F.col("a")), F.col("a")).alias("text"))


@query("SELECT ord, id AS name, semantics AS purpose FROM {registers}")
def re_register_index(r):
    docs = r.registers.select(F.col("ord").alias("doc"), F.concat(F.lit("# All\n\n### `"), "id", F.lit("` x\n\n"), "semantics", F.lit("\nmore\n")).alias("text"))
    return render.register_index(docs).select(F.col("doc").alias("ord"), "name", "purpose")


@query(f"SELECT ord, concat(CASE WHEN ord % 2 = 0 THEN '### ' ELSE '###### ' END, title, {NL}, 'text # not', {NL}, '##### x') AS text FROM {{stages}}")
def qs_demoted(r):
    text = F.concat(F.when(F.col("ord") % 2 == 0, "# ").otherwise("##### "), "title", F.lit("\ntext # not\n### x"))
    return r.stages.select("ord", render.demoted(text).alias("text"))


@query("""SELECT ord * 10 + k AS line, CASE k WHEN 0 THEN concat('<h2>', title, ' <code>a&lt;b</code></h2>') WHEN 1 THEN '' WHEN 2 THEN '<li>one <b>two</b></li>' ELSE concat('<p>x &amp; ', id, '</p>') END AS html FROM {stages}, (VALUES (0), (1), (2), (3)) v(k)""")
def sk_html_lines(r):
    text = F.element_at(F.array(F.concat(F.lit("## "), "title", F.lit(" `a<b`")), F.lit(" "), F.lit("- one **two**"), F.concat(F.lit("x & "), "id")), F.col("k") + 1)
    lines = r.stages.withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).select(F.lit("d").alias("doc"), (F.col("ord") * 10 + F.col("k")).alias("line"), text.alias("text"))
    return render.html_lines(lines).select("line", "html")


DESCRIBED = "SELECT CAST(ord % 7 AS INT) AS batch, file, purpose, role, n_functions FROM {cards}"


@query(f"""WITH m AS (SELECT string_agg(concat(title, ': ', rtrim(split_part(coalesce(description, ''), '. ', 1), '.'), '.'), {NL} ORDER BY ord, title) AS menu FROM {{stages}}),
d AS (SELECT batch, string_agg(concat('- ', file, ' [', role, ', ', n_functions, ' functions]: ', purpose), {NL} ORDER BY file) AS files FROM ({DESCRIBED}) GROUP BY 1)
SELECT batch, concat('Stages:', {NL}, menu, {NL}, {NL}, 'Files:', {NL}, files) AS text FROM d, m""")
def as_assignment_requests(r):
    return requests.assignment_requests(r.spark.sql(DESCRIBED, cards=r.cards), stages.stage_menu(r.stages)).select("batch", "text")


@query(f"SELECT stage, string_agg(concat('- ', qualname, ' [', line_start, '-', line_end, ']: ', substr(purpose, 1, 12)), {NL} ORDER BY ord, qualname) AS text FROM {{members}} GROUP BY 1")
def mp_member_blocks(r):
    return requests.member_blocks(r.members, 12)


@query(f"""WITH x AS (SELECT m.*, s.title FROM {{members}} m LEFT JOIN {{stages}} s ON s.id = m.stage WHERE type = 'region')
SELECT qualname, concat('Regions of ', qualname, ':', {NL}, string_agg(concat(line_start, '-', line_end, ' ', stage, ' (', coalesce(title, '?'), '): ', purpose), {NL} ORDER BY line_start, line_end, stage, ord)) AS text FROM x GROUP BY 1 HAVING count(*) >= 2""")
def rg_requests(r):
    return requests.region_requests(r.members, r.stages).select("qualname", "text")


PAIRS = "SELECT DISTINCT a.stage, a.ord AS i, b.ord AS j FROM {members} a JOIN {members} b ON a.stage = b.stage AND b.ord = a.ord + 25"


@query(f"""WITH n AS (SELECT stage, ord, concat(row_number() OVER w - 1, '. ', qualname, ' (', type, ')') AS line, row_number() OVER w - 1 AS k FROM {{members}} WINDOW w AS (PARTITION BY stage ORDER BY ord)),
m AS (SELECT stage, string_agg(line, {NL} ORDER BY k) AS members FROM n GROUP BY 1), c AS (SELECT p.stage, string_agg(concat(a.k, ' -> ', b.k), ', ' ORDER BY a.k, b.k) AS calls FROM ({PAIRS}) p JOIN n a ON a.stage = p.stage AND a.ord = i JOIN n b ON b.stage = p.stage AND b.ord = j GROUP BY 1)
SELECT stage, concat_ws({NL} || {NL}, concat('Members:', {NL}, members), 'Calls: ' || calls) AS text FROM m LEFT JOIN c USING (stage)""")
def or_requests(r):
    return requests.ordering_requests(r.members, r.spark.sql(PAIRS, members=r.members)).select("stage", "text")


STATS = "SELECT id AS stage, ord % 30 AS size, ord % 4 AS n_dirs, concat('d', ord % 3) AS dominant_dir, CAST(ord % 4 AS DOUBLE) / 4 AS share, ord % 30 > 25 AS overloaded FROM {stages}"


@query(f"SELECT stage, concat(stage, ': ', size, ' files in ', n_dirs, ' directories', CASE WHEN size > 0 THEN concat(', ', CAST(round(share * 100) AS INT), '% in ', dominant_dir) ELSE '' END, CASE WHEN overloaded THEN ' (overloaded)' ELSE '' END) AS line FROM ({STATS}) s")
def dr_stage_evidence(r):
    return requests.stage_evidence(r.spark.sql(STATS, stages=r.stages))


@query(f"WITH e AS (SELECT * FROM ({STATS}) WHERE overloaded) SELECT stage AS scope FROM e UNION ALL SELECT 'global'")
def dr_requests(r):
    return requests.doctor_requests(r.stages, r.spark.sql(STATS, stages=r.stages), r.file_stage).select("scope")


@query("""WITH m AS (SELECT stage, file, count(*) AS n, count(*) FILTER (type = 'function') AS f, count(*) FILTER (type = 'region') AS g, min(ord) AS seen FROM {members} GROUP BY 1, 2),
x AS (SELECT stage, sum(n) AS n, sum(f) AS f, sum(g) AS g, arg_max(file, n * 1000000000 - seen) AS best FROM m GROUP BY 1) SELECT stage, concat(stage, ': ', n, ' members (', f, ' functions, ', g, ' regions), mostly ', best) AS line, CAST((SELECT sum(n) FROM x) AS BIGINT) AS total FROM x""")
def dr_distribution(r):
    return requests.distribution_lines(stages.mapping_stats(r.members))


@query("""WITH o AS (SELECT qualname, stage AS source, min(CASE WHEN ord % 3 = 0 THEN 'stage-1' WHEN ord % 3 = 1 THEN 'stage-77' ELSE stage END) FILTER (ord % 3 = 0 AND stage <> 'stage-1') AS target FROM {members} WHERE ord % 5 = 0 GROUP BY 1, 2),
m AS (SELECT coalesce(o.target, m.stage) AS stage, m.ord, m.qualname, m.type, m.line_start, m.line_end FROM {members} m LEFT JOIN o ON o.qualname = m.qualname AND o.source = m.stage AND o.target IS NOT NULL)
SELECT stage, ord, qualname FROM m QUALIFY row_number() OVER (PARTITION BY stage, qualname, type, line_start, line_end ORDER BY ord) = 1""")
def mp_outliers(r):
    k = F.col("ord") % 3
    moves = r.members.where("ord % 5 = 0").select("qualname", F.col("stage").alias("source"), F.when(k == 0, "stage-1").when(k == 1, "stage-77").otherwise(F.col("stage")).alias("target"))
    return mapping.outlier_moves(moves, r.members, r.stages).select("stage", "ord", "qualname")


@query("""WITH p AS (SELECT stage, sha1(concat_ws('|', qualname, type, line_start, line_end, purpose)) AS h FROM {members}) SELECT stage, sha1(concat_ws('|', count(*), sum(CAST(concat('0x', substr(h, 1, 12)) AS BIGINT)), sum(CAST(concat('0x', substr(h, 13, 12)) AS BIGINT)))) AS fingerprint FROM p GROUP BY 1 HAVING length(stage) % 2 = 1 OR count(*) % 2 = 0""")
def mp_audit_due(r):
    """Stages that are due where the cache has those of even names and odd sizes as they are, and others otherwise."""
    none = r.spark.createDataFrame([], "stage string, fingerprint string")
    full = mapping.audit_due(r.members, none)
    size = r.members.groupBy("stage").agg(F.count("*").alias("n"))
    cache = full.join(size, "stage").where("length(stage) % 2 = 0 AND n % 2 = 1").select("stage", "fingerprint").unionByName(full.select("stage", F.lit("old").alias("fingerprint")))
    return mapping.audit_due(r.members, cache)


@query("SELECT concat('k', ord % 3) AS kind, count(*) AS n, string_agg(file, ',' ORDER BY file) FILTER (k <= 5) AS items FROM (SELECT *, row_number() OVER (PARTITION BY ord % 3 ORDER BY file) AS k FROM {cards}) c GROUP BY 1")
def ch_report(r):
    return flat(changes.report(r.cards.select(F.concat(F.lit("k"), F.col("ord") % 3).alias("kind"), F.col("file").alias("item")), 5), "items")


@query("""SELECT CASE WHEN ord % 7 = 1 THEN concat(id, '_new') ELSE id END AS qualname, CASE WHEN ord % 5 = 0 AND ord % 7 <> 1 AND ord % 2 = 0 THEN concat('# `', id, '` new') ELSE concat('### `', CASE WHEN ord % 7 = 1 THEN concat(id, '_new') ELSE id END, '`', chr(10), 'x') END AS text FROM {functions} WHERE ord % 7 <> 0""")
def ch_card_surgery(r):
    f = r.functions.select("ord", F.col("id").alias("qualname"))
    cards = f.select("qualname", F.lit("s").alias("stage"), F.concat(F.lit("### `"), "qualname", F.lit("`\nx")).alias("text"))
    renamed = f.where("ord % 7 = 1").select(F.col("qualname").alias("old_name"), F.concat("qualname", F.lit("_new")).alias("new_name"))
    patched = f.where("ord % 5 = 0").select("qualname", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("# `"), "qualname", F.lit("` new"))).otherwise("# other").alias("text"))
    return changes.card_surgery(cards, renamed, f.where("ord % 7 = 0"), patched).select("qualname", "text")


@query("""SELECT file, CASE WHEN ord % 10 = 0 THEN 'added' WHEN ord % 7 = 0 THEN 'deleted' ELSE 'modified' END AS state FROM {contents} WHERE (ord % 10 = 0) <> (ord % 7 = 0) OR (ord % 10 > 0 AND ord % 7 > 0 AND ord % 5 = 1)""")
def ch_snapshot_diff(r):
    c = r.contents
    after = c.where("ord % 7 > 0").select("file", F.when(F.col("ord") % 5 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return changes.snapshot_diff(c.where("ord % 10 > 0").select("file", "content"), after).select("file", "state")


RESYNC = """o AS (SELECT id AS qualname, file, name, ord, text, line_start, line_end FROM {functions} WHERE ord % 6 > 0), n AS (SELECT CASE WHEN ord % 8 = 0 THEN concat(id, '_new') ELSE id END AS qualname, file, name, ord, CASE WHEN ord % 5 = 0 THEN concat(text, 'x') ELSE text END AS text, line_start + 1 AS line_start, line_end + 1 AS line_end FROM {functions} WHERE ord % 9 > 0),
l AS (SELECT DISTINCT id AS qualname FROM {functions} WHERE ord % 4 > 0), gone AS (SELECT l.qualname FROM l JOIN o USING (qualname) WHERE l.qualname NOT IN (SELECT qualname FROM n)), fresh AS (SELECT * FROM n WHERE qualname NOT IN (FROM l) AND qualname NOT IN (SELECT qualname FROM o)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY file, regexp_replace(text, '^[^\\n]*\\n?', '') ORDER BY ord, qualname) AS k, regexp_replace(text, '^[^\\n]*\\n?', '') AS b FROM o WHERE qualname IN (FROM gone)), w2 AS (SELECT *, row_number() OVER (PARTITION BY file, regexp_replace(text, '^[^\\n]*\\n?', '') ORDER BY ord, qualname) AS k, regexp_replace(text, '^[^\\n]*\\n?', '') AS b FROM fresh),
mv AS (SELECT g2.qualname AS a, w2.qualname AS z FROM g2 JOIN w2 USING (file, b, k))"""


@query(f"""WITH {RESYNC} SELECT 'removed' AS kind, qualname AS item FROM gone WHERE qualname NOT IN (SELECT a FROM mv) UNION ALL SELECT 'new', qualname FROM fresh WHERE qualname NOT IN (SELECT z FROM mv) UNION ALL SELECT 'renamed', z FROM mv
UNION ALL SELECT 'changed', l.qualname FROM l JOIN o USING (qualname) JOIN n USING (qualname) WHERE o.text <> n.text""")
def ch_resync_members(r):
    return _resync(r)["ledger"]


@query(f"""WITH {RESYNC}, m AS (SELECT 's' AS stage, coalesce(mv.z, l.qualname) AS qualname FROM l LEFT JOIN mv ON mv.a = l.qualname WHERE l.qualname NOT IN (SELECT qualname FROM gone WHERE qualname NOT IN (SELECT a FROM mv)))
SELECT m.stage, m.qualname, coalesce(sha1(n.text), 'old') AS sha1, coalesce(n.line_start, 0) AS line_start FROM m LEFT JOIN n USING (qualname) UNION ALL SELECT CASE WHEN ord % 2 = 0 THEN 'placed' ELSE 'unmapped' END, qualname, sha1(text), line_start FROM fresh WHERE qualname NOT IN (SELECT z FROM mv)""")
def ch_resynced(r):
    return _resync(r)["members"].select("stage", "qualname", "sha1", "line_start")


def _resync(r):
    f = r.functions
    old = f.where("ord % 6 > 0").select("ord", F.col("id").alias("qualname"), "file", "name", "text", "line_start", "line_end")
    new = f.where("ord % 9 > 0").select(
        "ord", F.when(F.col("ord") % 8 == 0, F.concat("id", F.lit("_new"))).otherwise(F.col("id")).alias("qualname"), "file", "name",
        F.when(F.col("ord") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), (F.col("line_start") + 1).alias("line_start"), (F.col("line_end") + 1).alias("line_end"),
    )
    members = f.where("ord % 4 > 0").select(F.lit("s").alias("stage"), "ord", F.col("id").alias("qualname"), F.lit("function").alias("type"), "file", F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("old").alias("sha1"), F.lit("p").alias("purpose"))
    return changes.resync_members(members, old, new, new.where("ord % 2 = 0").select("qualname", F.lit("placed").alias("stage")))


@query("""WITH d AS (SELECT concat('d', user_id) AS dir, user_id AS u, count(*) AS n FROM {events} GROUP BY 1, 2)
SELECT dir AS session, CASE WHEN u % 6 = 5 THEN concat('["once ', dir, '"]') ELSE concat('["', n, ' files"]') END AS stages, CASE WHEN u % 6 = 5 THEN 'oneshot' ELSE 'agent' END AS how,
  CASE u % 6 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 3 ELSE 9 END AS n_turns FROM d""")
def as_dialogue(r):
    """Users as directories, their events as files.  The scripted writer orients itself, then proposes; some first propose nothing, call an unknown tool or say no JSON, and some never come to a draft."""
    dirs = r.events.groupBy("user_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("d"), "user_id").alias("dir"), F.concat("n", F.lit(" files")).alias("line"))

    def write(asked):
        u = F.regexp_extract("text", r"directory d(\d+)\.", 1).cast("long") % 6
        files = F.regexp_extract("text", r"result: (\d+ files)", 1)
        look = F.lit('I look: {"tool": "get_orientation", "argument": ""}')
        propose = F.concat(F.lit('```json\n{"tool": "propose_skeleton", "argument": ["'), files, F.lit('"]}\n```'))
        wrong = F.when(u == 1, '{"tool": "propose_skeleton", "argument": []}').when(u == 2, '{"tool": "read_file", "argument": "x"}').when(u == 3, "no call at all")
        once = F.concat(F.lit('{"stages": ["once '), F.regexp_extract("text", r"directory (d\d+)\.", 1), F.lit('"]}'))
        reply = F.when(F.startswith("text", F.lit("One request")), once).when((u == 5) | (files == ""), look).when(wrong.isNotNull() & ~F.contains("text", F.lit("error:")), wrong).otherwise(propose)
        return asked.select("request_key", reply.alias("reply"))

    sessions = dirs.select(F.col("dir").alias("session"), F.concat(F.lit("Draft stages of directory "), "dir", F.lit(".")).alias("task"))
    once = lambda left: left.select("session", F.concat(F.lit("One request for directory "), "session", F.lit(".")).alias("text"))
    none = r.spark.createDataFrame([], "request_key string, reply string")
    drafts, turns = dialogue.converse(sessions, {"get_orientation": dialogue.orientation(dirs)}, none, write, once, most=4)
    return drafts.join(turns.groupBy("session").agg(F.max("n").alias("n")), "session").select("session", "stages", "how", F.when(F.col("how") == "agent", F.col("n")).otherwise(F.col("n") + 1).cast("int").alias("n_turns"))


@query("""WITH RECURSIVE u AS (SELECT conv_id AS stage, turn AS ord, concat('c', conv_id, '.t', turn) AS qualname, coalesce(min(text), '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM {conversations} GROUP BY 1, 2, 3),
w AS (SELECT stage, ord, k, qualname, sha1(concat('Describe ', qualname, ' (single).', chr(10), 'Told before: ', chr(10), chr(10), body)) AS h, CAST([] AS VARCHAR[]) AS told FROM u WHERE k = 0
  UNION ALL SELECT u.stage, u.ord, u.k, u.qualname, sha1(concat('Describe ', u.qualname, ' (single).', chr(10), 'Told before: ', array_to_string(list_append(w.told, concat(w.qualname, ': ', substr(w.h, 1, 8)))[-8:], ', '), chr(10), chr(10), u.body)),
    list_append(w.told, concat(w.qualname, ': ', substr(w.h, 1, 8))) FROM w JOIN u ON u.stage = w.stage AND u.k = w.k + 1 WHERE w.h NOT LIKE '0%')
SELECT stage, ord, qualname, substr(h, 1, 8) AS text FROM w WHERE stage NOT IN (SELECT stage FROM w WHERE h LIKE '0%')""")
def qs_document(r):
    """Conversations as stages, turns as units; the writer answers with a hash of the request, and leaves some without an answer."""
    turns = r.conversations.groupBy(F.col("conv_id").alias("stage"), F.col("turn").alias("ord")).agg(F.min("text").alias("text"))
    units = turns.withColumn("qualname", F.concat(F.lit("c"), "stage", F.lit(".t"), "ord")).withColumn("kind", F.lit("single"))
    write = lambda asked: asked.select("request_key", F.sha1("text").alias("h")).where("h NOT LIKE '0%'").select("request_key", F.substr("h", F.lit(1), F.lit(8)).alias("reply"))
    none = r.spark.createDataFrame([], "request_key string, reply string")
    return drivers.build_document(units, units, none, write)[0].select("stage", "ord", "qualname", "text")


@query("SELECT file, CASE WHEN ord % 3 = 0 THEN 'a' WHEN ord % 3 = 1 AND ord % 2 = 0 THEN 'b' ELSE 'c' END AS reply, CASE WHEN ord % 3 = 0 THEN 0 WHEN ord % 3 = 1 AND ord % 2 = 0 THEN 1 ELSE 2 END AS tier FROM {cards} WHERE ord % 11 > 0 OR ord % 3 = 0 OR (ord % 3 = 1 AND ord % 2 = 0)")
def cd_degrade(r):
    """Three tiers, of which the last leaves some files without an answer."""
    tier = lambda cond, text: lambda missing: missing.select("file", F.when(F.expr(cond), text).alias("reply"))
    return drivers.degrade(r.cards.select("file", "ord"), "file", [tier("ord % 3 = 0", "a"), tier("ord % 3 = 1 AND ord % 2 = 0", "b"), tier("ord % 11 > 0", "c")])


@query("SELECT count(*) AS n_requests, count(*) FILTER (doc_id % 4 = 0) AS n_answered FROM {documents}")
def lm_progress(r):
    asked = r.documents.select(F.sha1(F.col("doc_id").cast("string")).alias("request_key"), "doc_id")
    return drivers.progress(asked, asked.where("doc_id % 4 = 0").unionByName(asked.where("doc_id % 8 = 0")))


@query("""WITH t(tier, criterion, kind, weight, floor) AS (VALUES (1, 'purpose_clarity', 'gate', '0.25', 3), (1, 'what_it_does', 'gate', '0.20', 3), (1, 'novice_accessibility', 'gate', '0.20', 3), (1, 'shape_fidelity', 'soft', '0.20', 3), (1, 'scannability_style', 'soft', '0.15', 3), (2, 'stage_role', 'gate', '0.18', 3), (2, 'control_flow', 'gate', '0.22', 3), (2, 'data_flow_validity', 'gate', '0.25', 3), (2, 'explains_why', 'soft', '0.15', 3), (2, 'adjacency', 'soft', '0.10', 3), (2, 'right_altitude_style', 'soft', '0.10', 3), (3, 'accuracy', 'gate', '0.25', 3), (3, 'io_params_precision', 'gate', '0.25', 3), (3, 'register_accuracy', 'gate', '0.15', 3), (3, 'code_detail_fidelity', 'soft', '0.15', 3), (3, 'non_obvious_surfaced', 'soft', '0.12', 3), (3, 'section_purity_style', 'soft', '0.08', 3)),
x AS (SELECT tier, string_agg(concat('- ', criterion, ' (', kind, ', weight ', weight, CASE WHEN kind = 'gate' THEN concat(', at least ', floor) ELSE '' END, ')'), chr(10) ORDER BY kind, criterion) AS text FROM t GROUP BY 1)
SELECT c.conv_id, tier, text FROM (SELECT DISTINCT conv_id FROM {conversations}) c JOIN x ON x.tier = c.conv_id % 3 + 1""")
def qs_rubric_lines(r):
    """The criteria that each conversation's judge is given, by its tier."""
    judged = r.conversations.select("conv_id", (F.col("conv_id") % 3 + 1).cast("int").alias("tier")).distinct()
    return judged.join(F.broadcast(requests.rubric_lines(requests.rubrics(r.spark))), "tier").select("conv_id", "tier", "text")  # three rows


@query("""WITH s AS (SELECT l_orderkey AS unit, criterion, l_partkey % 6 AS score, CASE WHEN l_suppkey % 3 = 0 THEN concat('f', l_linenumber) ELSE ' ' END AS finding FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 'accuracy' WHEN 2 THEN 'io_params_precision' WHEN 3 THEN 'register_accuracy' WHEN 4 THEN 'code_detail_fidelity' WHEN 5 THEN 'non_obvious_surfaced' WHEN 6 THEN 'none' ELSE 'section_purity_style' END AS criterion FROM {lineitem}) x)
SELECT unit, string_agg(concat('- ', criterion, ' ', score, CASE WHEN trim(finding) = '' THEN '' ELSE concat(': ', finding) END), chr(10) ORDER BY kind, criterion, concat('- ', criterion, ' ', score, CASE WHEN trim(finding) = '' THEN '' ELSE concat(': ', finding) END)) AS text FROM s JOIN {rubric} USING (criterion) WHERE score < floor OR trim(finding) <> '' GROUP BY 1""")
def qs_findings(r):
    names = "accuracy io_params_precision register_accuracy code_detail_fidelity non_obvious_surfaced none section_purity_style".split()
    criterion = F.element_at(F.array(*map(F.lit, names)), F.least("l_linenumber", F.lit(7)))
    s = r.lineitem.select(F.col("l_orderkey").alias("unit"), criterion.alias("criterion"), (F.col("l_partkey") % 6).alias("score"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("f"), "l_linenumber")).otherwise(" ").alias("finding"))
    return requests.findings_lines(s, r.rubric)


@query(f"WITH RECURSIVE {TREE} SELECT s.ord, s.title FROM {{stages}} s JOIN t ON t.id = s.id WHERE t.depth = 0")
def tr_top_level(r):
    return render.top_level(r.stages).select("ord", F.get_json_object("json", "$.title").alias("title"))


@query("""WITH x AS (SELECT stage, ord, row_number() OVER (PARTITION BY stage ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY stage) AS n, row_number() OVER (PARTITION BY stage ORDER BY file, line_start, CASE WHEN type = 'function' THEN 0 ELSE 1 END, line_end, ord) - 1 AS f FROM {members})
SELECT stage, ord, CASE WHEN length(stage) % 2 = 0 THEN n - 1 - k ELSE f END AS position FROM x""")
def or_order_stages(r):
    """Replies that turn the order round for stages of even names, and that are no permutation for the others."""
    n = r.members.groupBy("stage").agg(F.count("*").cast("int").alias("n"))
    order = F.when(F.length("stage") % 2 == 0, F.sequence(F.col("n") - 1, F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(0)))
    replies = n.select("stage", F.when(F.col("n") > 1, order).otherwise(F.array(F.lit(0))).alias("order"))
    cache = r.spark.createDataFrame([], "stage string, fingerprint string, ord long, position int")
    return drivers.order_stages(r.members, replies, cache)[0].select("stage", "ord", "position")


@query(f"SELECT dir, concat(dir, ': ', n_files, ' files', CASE WHEN n_files % 2 = 0 THEN '; roles util, test' ELSE '' END) AS line FROM (SELECT CASE WHEN file LIKE '%/%' THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS dir, count(*) AS n_files FROM {{cards}} GROUP BY 1)")
def as_rollup_lines(r):
    d = r.cards.groupBy(nav.dirname(F.col("file")).alias("dir")).agg(F.count("*").alias("n_files"))
    none = F.array().cast("array<string>")
    return requests.rollup_lines(d.select("dir", "n_files", F.when(F.col("n_files") % 2 == 0, F.array(F.lit("util"), F.lit("test"))).otherwise(none).alias("roles"), none.alias("lifecycles"), F.lit(None).cast("array<string>").alias("purposes")))


@query("SELECT ord AS doc, concat('Sub ', k) AS title, concat('text ', k, chr(10), '## not', chr(10), '```') AS body FROM {stages}, (VALUES (1), (2)) v(k)")
def sk_sections(r):
    """Level-3 sections; the fenced heading is none."""
    part = lambda k: f"### Sub {k}\n```\ntext {k}\n## not\n```\n"
    docs = r.stages.select(F.col("ord").alias("doc"), F.lit("# Top\n" + part(1) + "## Other\n" + part(2).rstrip("\n")).alias("text"))
    return markdown.sections(docs, 3).select("doc", "title", F.regexp_replace(F.rtrim(F.col("text"), F.lit("\n")), "^```\n", "").alias("body"))


@query("""SELECT ord, concat('{"schema_version":"', CASE WHEN ord % 2 = 0 THEN '1' ELSE '7' END, '","purpose":"p', ord, '","relations":["', CASE WHEN ord % 3 = 0 THEN '(none)' ELSE 'a' END, '"]}') AS card FROM {stages}""")
def ch_repaired_cards(r):
    card = F.concat(F.lit('{"purpose": "p'), "ord", F.lit('", "relations": '), F.when(F.col("ord") % 3 == 0, "[]").otherwise('["a"]'), F.when(F.col("ord") % 2 == 0, "}").otherwise(', "schema_version": "7"}'))
    return r.stages.select("ord", render.repaired_card(card).alias("card"))
