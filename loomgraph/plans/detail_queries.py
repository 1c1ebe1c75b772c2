"""Queries over discovery, text access, Markdown, records, exports and small checks (SC, CD, OR, MP, RG, CH, LM, TR, SK, PL, EX), and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import markdown_html, scan, static_source
from ..operators import changes, gates, inventory, mapping, ordering, regions, render, resolve, tree
from ..operators.numbering import shared_folder, stored
from ..sources import artifacts, discover, exports, markdown
from .graph_queries import flat
from .stage_queries import TREE
from .source_queries import filled, made_files
from .surrogate import Relations, sql

NL = "chr(10)"
QUERIES, SQL = {}, {}


def query(text: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return put


def _again(r: Relations, df, name: str):
    """A new place in the shared folder to write to and read from again."""
    return f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"


# --- discovery and text access -------------------------------------------------------

PATHS = """SELECT p_partkey AS ord, concat(CASE p_partkey % 13 WHEN 0 THEN 'src/' WHEN 1 THEN 'vendor/x/' WHEN 2 THEN 'a/target/' WHEN 3 THEN '.env/' WHEN 4 THEN 'lib/site-packages/' WHEN 5 THEN 'third_party/' WHEN 6 THEN 'dist/' WHEN 7 THEN '.eggs/b/'
  WHEN 8 THEN 'build/' WHEN 9 THEN 'node_modules/' WHEN 10 THEN '.git/' ELSE '' END, 'm', p_partkey, CASE p_partkey % 11 WHEN 0 THEN '.go' WHEN 1 THEN '_test.go' WHEN 2 THEN '.py' WHEN 3 THEN '.rs' WHEN 4 THEN '.ts' WHEN 5 THEN '.d.ts' WHEN 6 THEN '.tsx' WHEN 7 THEN '.sh' WHEN 8 THEN '.bzl' WHEN 9 THEN '.psm1' ELSE '.txt' END) AS file FROM {part}"""


@query(f"""WITH f AS ({PATHS}), x AS (SELECT *, CASE WHEN file LIKE '%.go' THEN 'go' WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.rs' THEN 'rust' WHEN file LIKE '%.ts' OR file LIKE '%.tsx' THEN 'typescript' WHEN file LIKE '%.sh' THEN 'shell' WHEN file LIKE '%.bzl' THEN 'starlark' WHEN file LIKE '%.psm1' THEN 'powershell' END AS lang, string_split(file, '/') AS d FROM f)
SELECT lang, file FROM x WHERE lang IS NOT NULL AND NOT ends_with(file, '.d.ts') AND NOT ends_with(file, '_test.go') AND CASE lang WHEN 'go' THEN NOT list_has_any(d, ['.git', 'vendor']) WHEN 'rust' THEN NOT list_has_any(d, ['target', '.git', 'node_modules']) WHEN 'typescript' THEN NOT list_has_any(d, ['node_modules', '.git', 'dist', 'build'])
  ELSE NOT list_has_any(d, ['.git', '.hg', '.svn', 'node_modules', 'vendor', 'target', 'build', 'dist', 'out', '__pycache__', '.mypy_cache', '.pytest_cache', '.ruff_cache', '.tox', 'venv', '.venv', 'env', '.env', 'site-packages', '.idea', '.vscode']) END""")
def sc_wanted(r):
    """SC-1 to SC-7: which paths are sources of which language."""
    f = r.spark.sql(PATHS, part=r.part).withColumn("ext", F.concat(F.lit("."), F.lower(F.substring_index("file", ".", -1))))
    found = f.join(F.broadcast(discover.language_table(r.spark)), "ext")  # a dozen rows
    return found.where(discover.wanted(F.col("lang"), F.col("file"))).select("lang", "file")


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(text[1:100], chr(10), '… (truncated)') ELSE text END AS head, text AS whole FROM {documents}")
def sc_excerpt(r):
    return r.documents.select("doc_id", discover.excerpt(F.col("text"), 100).alias("head"), discover.excerpt(F.col("text"), 0).alias("whole"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(doc_id % 4 AS INT) AS a, CAST(doc_id % 4 + doc_id % 3 - 1 AS INT) AS b, text FROM {documents}),
x AS (SELECT *, array_to_string(l[greatest(a, 1):greatest(a, 1) + greatest(b - a + 1, 0) - 1], chr(10)) AS part, CASE WHEN text IS NULL THEN 'no such file' WHEN a < 1 THEN 'start below 1' WHEN b < a THEN 'end before start' WHEN b > len(l) THEN 'end past the file' WHEN doc_id % 5 = 0 THEN 'hash differs' END AS error FROM d)
SELECT doc_id, CASE WHEN error IS NULL THEN part END AS text, error FROM x""")
def sc_verified_range(r):
    a = (F.col("doc_id") % 4).cast("int")
    d = r.documents.select("doc_id", discover.verified_range(F.col("text"), a, (a + F.col("doc_id") % 3 - 1).cast("int"), F.when(F.col("doc_id") % 5 == 0, "x")).alias("v"))
    return d.select("doc_id", "v.text", "v.error")


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents}), x AS (SELECT doc_id, l, unnest(range(1, least(len(l), 3) + 1)) AS k FROM d)
SELECT doc_id, string_agg(concat(lpad(CAST(k AS VARCHAR), 5, ' '), ': ', l[k]), chr(10) ORDER BY k) AS text FROM x GROUP BY 1""")
def sc_numbered(r):
    return r.documents.where("text IS NOT NULL").select("doc_id", discover.numbered(F.col("text"), F.lit(1), F.lit(3)).alias("text"))


# --- Markdown ------------------------------------------------------------------------

TABLES = "SELECT s_suppkey AS doc, concat('## T', chr(10), '| `reg-', s_suppkey, '.a` | Holds ', s_nationkey, ' | stage-', s_nationkey, '.1, side-2, other |', chr(10), '|---|---|', chr(10), '  | reg-b-', s_suppkey, ' | |', chr(10), '| x-1 | no |') AS text FROM {supplier}"


@query("SELECT s_suppkey AS doc, CAST(2 AS BIGINT) AS ord, concat('reg-', s_suppkey, '.a') AS id, concat('Holds ', s_nationkey) AS semantics, concat('stage-', s_nationkey, '.1,side-2') AS stages FROM {supplier} UNION ALL SELECT s_suppkey, 4, concat('reg-b-', s_suppkey), '', '' FROM {supplier}")
def sc_registers_back(r):
    """SC-13, SC-21: registers out of rendered tables."""
    return flat(artifacts.recover_registers(r.spark.sql(TABLES, supplier=r.supplier)), "stages")


@query("""WITH i AS (SELECT s_suppkey AS doc, unnest([concat('stage-', s_suppkey), concat('stage-', s_suppkey, '.1'), concat('stage-', s_suppkey, '.1.2'), 'stage-9.9']) AS id, unnest(['a', '', 'c', 'd']) AS t FROM {supplier})
SELECT i.doc, i.id, CASE WHEN i.t = '' THEN '(no description)' ELSE i.t END AS description, p.id AS parent FROM i LEFT JOIN i p ON p.doc = i.doc AND p.id <> i.id AND p.id = regexp_replace(i.id, '\\.\\d+$', '')""")
def sc_with_parents(r):
    rows = F.explode(F.array(*(F.struct(i.alias("id"), F.lit(t).alias("description")) for i, t in zip((F.concat(F.lit("stage-"), "s_suppkey"), F.concat(F.lit("stage-"), "s_suppkey", F.lit(".1")), F.concat(F.lit("stage-"), "s_suppkey", F.lit(".1.2")), F.lit("stage-9.9")), ("a", "", "c", "d"), strict=True))))
    return markdown.with_parents(r.supplier.select(F.col("s_suppkey").alias("doc"), rows.alias("s")).select("doc", "s.*")).select("doc", "id", "description", "parent")


HEADS = "SELECT s_suppkey AS doc, concat('# A', s_suppkey, chr(10), 'text', chr(10), '### B', chr(10), '## C', chr(10), '### D d', chr(10), chr(10), '#### E', chr(10), '### F', chr(10), '# G') AS text FROM {supplier}"


@query("SELECT s_suppkey AS doc, unnest([1, 3, 4, 5, 7, 8, 9]) AS line, unnest([1, 3, 2, 3, 4, 3, 1]) AS level, unnest([concat('A', s_suppkey), 'B', 'C', 'D d', 'E', 'F', 'G']) AS title, unnest([NULL, 1, 1, 4, 5, 4, NULL]) AS parent_line FROM {supplier}")
def sc_heading_tree(r):
    return markdown.heading_tree(r.spark.sql(HEADS, supplier=r.supplier))


INDEX = "SELECT s_suppkey AS doc, concat('## One — `stage-', s_nationkey, '`', chr(10), '- `f', s_suppkey, '` (a.py:3-9)', chr(10), '- `f', s_suppkey, '` (a.py:4-5)', chr(10), '## Two — `side-1`', chr(10), '- `g` (b.py:1-2)', chr(10), 'none') AS text FROM {supplier}"


@query("SELECT s_suppkey AS doc, unnest([concat('stage-', s_nationkey), concat('stage-', s_nationkey), 'side-1']) AS stage, unnest([2, 3, 5]) AS ord, unnest([concat('f', s_suppkey), concat('f', s_suppkey), 'g']) AS qualname, unnest(['function', 'region', 'function']) AS type, unnest(['a.py', 'a.py', 'b.py']) AS file, unnest([3, 4, 1]) AS line_start, unnest([9, 5, 2]) AS line_end FROM {supplier}")
def sc_index_members(r):
    spans = r.supplier.select(F.concat(F.lit("f"), "s_suppkey").alias("qualname"), F.lit("a.py").alias("file"), F.lit(3).alias("line_start"), F.lit(9).alias("line_end"))
    return markdown.index_members(r.spark.sql(INDEX, supplier=r.supplier), spans)


@query("SELECT p_partkey AS line, concat('mac', p_partkey) AS name FROM {part} WHERE p_partkey % 3 > 0")
def ex_macros(r):
    text = F.when(F.col("p_partkey") % 3 == 0, "let x = 1;").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  macro_rules! mac"), "p_partkey", F.lit(" {"))).otherwise(F.concat(F.lit("macro_rules!mac"), "p_partkey"))
    return markdown.macros(r.part.select(F.lit("a.rs").alias("file"), F.col("p_partkey").alias("line"), text.alias("text"))).select("line", "name")


@query("SELECT s_suppkey AS doc, unnest([1, 3]) AS line, unnest([concat('a::b', s_suppkey), concat('C.d', s_suppkey)]) AS name, unnest([concat('b', s_suppkey), concat('d', s_suppkey)]) AS short FROM {supplier}")
def ex_headings(r):
    text = F.concat(F.lit("### fn `a::b"), "s_suppkey", F.lit("` (x)\n## `no`\n#### `C.d"), "s_suppkey", F.lit("`\n##### `e`"))
    return markdown.function_headings(r.supplier.select(F.col("s_suppkey").alias("doc"), text.alias("text")))


@query("SELECT s_suppkey AS doc, concat('It is ', s_suppkey, '. Second line.') AS blurb, concat('It is ', s_suppkey, '.') AS short FROM {supplier}")
def pl_blurb(r):
    text = F.concat(F.lit("# X\n## Opening explanation of it\n\nIt is "), "s_suppkey", F.lit(".\nSecond   line.\n\nmore"))
    return r.supplier.select(F.col("s_suppkey").alias("doc"), markdown.blurb(text).alias("blurb"), markdown.blurb(text, 18).alias("short"))


@query("""WITH o AS (SELECT p_partkey AS id, CAST(p_partkey * 2 AS DOUBLE) AS spot, 0 AS k FROM {part} WHERE p_partkey % 3 > 0), m AS (SELECT max(spot) + 1 AS last FROM o),
n AS (SELECT p.p_partkey AS id, coalesce(o.spot, m.last) AS spot, 1 AS k FROM {part} p LEFT JOIN o ON o.id = p.p_partkey - 1 AND p.p_partkey % 2 = 0 CROSS JOIN m WHERE p.p_partkey % 3 = 0)
SELECT concat('i', lpad(CAST(id AS VARCHAR), 9, '0')) AS id, CAST(row_number() OVER (ORDER BY spot, k, id) AS INT) AS position FROM (FROM o UNION ALL FROM n)""")
def pl_index(r):
    """PL-3: new entries behind the one they name, the others at the end."""
    name = lambda c: F.concat(F.lit("i"), F.lpad(c.cast("string"), 9, "0"))
    p = F.col("p_partkey")
    old = r.part.where("p_partkey % 3 > 0").select((p * 2).alias("ord"), name(p).alias("id"))
    new = r.part.where("p_partkey % 3 = 0").select(name(p).alias("id"), F.when(p % 2 == 0, name(p - 1)).alias("after"))
    back = markdown.rebuilt_index(old, new.where("after IS NOT NULL").unionByName(new.where("after IS NULL")))
    return back.select("id", "position")


# --- records of the static languages ---------------------------------------------------

#: per language: kind, owner, name, target of the symbols of a made file
SYMBOLS = {
    "rust": [("import", None, "helper«q»", "crate::pkg«j»::mod«q»::helper«q»"), ("type", None, "Box«p»", ""), ("field", "Box«p»", "peer", "Box«q»"), ("method", "Box«p»", "new", ""), ("method", "Box«p»", "get", ""), ("method", "Box«p»", "put", ""), ("free", None, "helper«p»", "")],
    "go": [("import", None, "fmt", "fmt"), ("type", None, "Box«p»", ""), ("field", "Box«p»", "peer", "Box«q»"), ("method", "Box«p»", "Get", ""), ("method", "Box«p»", "Put", ""), ("free", None, "helper«p»", "")],
    "typescript": [("import", None, "load", "./util::load"), ("type", None, "Box«p»", ""), ("field", "Box«p»", "peer", "Box«q»"), ("method", "Box«p»", "get", ""), ("method", "Box«p»", "put", ""), ("free", None, "helper«p»", ""), ("free", None, "clean«p»", ""), ("free", None, "last«p»", "")],
}


def _symbols(lang: str) -> None:
    def symbols(spark, sf_dir):
        records = static_source.extract(made_files(Relations(spark, sf_dir), lang), ("import", "type", "field", "method", "free"))
        return records.select("kind", "owner", "name", "target")

    rows = [f"SELECT '{kind}' AS kind, {filled(owner) if owner else 'CAST(NULL AS VARCHAR)'} AS owner, {filled(name)} AS name, {filled(target) if target else repr('')} AS target FROM part" for kind, owner, name, target in SYMBOLS[lang]]
    QUERIES[f"ex_{lang}_symbols"], SQL[f"ex_{lang}_symbols"] = symbols, " UNION ALL ".join(rows)


for _lang in SYMBOLS:
    _symbols(_lang)


# --- cards, groups, members, actions ---------------------------------------------------


@query("SELECT file, concat('P', ord) AS purpose, CASE ord % 3 WHEN 0 THEN 'util' WHEN 1 THEN 'other' ELSE 'config' END AS role, '' AS lifecycle, CASE WHEN ord % 2 = 0 THEN 'd' ELSE '' END AS description FROM {cards} WHERE ord % 4 > 0")
def cd_coerce_cards(r):
    role = F.when(F.col("ord") % 3 == 0, " util ").when(F.col("ord") % 3 == 1, "hero").otherwise("config")
    card = F.to_json(F.array(F.struct("file", F.concat(F.lit(" P"), "ord").alias("purpose"), role.alias("role"), F.when(F.col("ord") % 2 == 0, " d").alias("description")), F.struct(F.lit("unknown").alias("file"), F.lit("x").alias("purpose"), F.lit("util").alias("role"), F.lit("y").alias("description"))))
    return inventory.coerce_cards(r.cards.select(card.alias("reply")), r.cards.where("ord % 4 > 0"))


@query("SELECT count(*) AS n_entries, count(*) FILTER (ord % 5 = 0) AS n_errors FROM {cards}")
def cd_cache_index(r):
    return inventory.cache_index(r.cards.select(F.when(F.col("ord") % 5 == 0, "x").alias("error")))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS text FROM {documents}")
def cd_source_slice(r):
    return r.documents.select("doc_id", inventory.source_slice(F.split("text", "\n"), F.lit(2), F.lit(3)).alias("text"))


GROUPS = "SELECT concat('s', ord % 20) AS stage, ord % 3 AS g_ord, ord AS f_ord, CASE WHEN ord % 7 = 0 THEN concat('x', ord) ELSE file END AS file FROM {cards}"


@query(f"WITH g AS ({GROUPS}) SELECT g.*, CAST(row_number() OVER (PARTITION BY stage ORDER BY g_ord, f_ord, g.file) - 1 AS INT) AS position, coalesce(c.purpose, '') AS purpose, coalesce(c.role, '') AS role FROM g LEFT JOIN {{cards}} c ON c.file = g.file")
def or_finalise(r):
    return ordering.finalise(r.spark.sql(GROUPS, cards=r.cards), r.cards)


@query("SELECT id AS stage, 0 AS n_members FROM {stages}")
def mp_initial(r):
    return mapping.initial_mapping(r.stages)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS a, l_partkey % 3 AS b, CASE l_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'snapped' ELSE 'needs_review' END AS s FROM {lineitem})
SELECT l_orderkey, l_linenumber, CASE WHEN a = 0 AND b = 0 THEN 'needs_review' WHEN (a = 0 OR b = 0) AND s = 'ok' THEN 'snapped' ELSE s END AS status FROM x""")
def rg_check_lines(r):
    """A told line is the real one cut or indented, or another."""
    real = lambda n: F.concat(F.lit("    call_number("), n, F.lit(", with_some_longer_argument)"))
    told = lambda n, k: F.when(k == 0, "return other").when(k == 1, F.trim(real(n))).otherwise(F.substr(real(n), F.lit(1), F.lit(60)))
    a, b = F.col("l_linenumber") % 3, F.col("l_partkey") % 3
    status = F.element_at(F.array(F.lit("ok"), F.lit("snapped"), F.lit("needs_review")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return r.lineitem.select("l_orderkey", "l_linenumber", regions.check_lines(status, told(F.col("l_orderkey"), a), told(F.col("l_partkey"), b), real(F.col("l_orderkey")), real(F.col("l_partkey"))).alias("status"))


@query("""WITH x AS (SELECT ord, CASE ord % 7 WHEN 0 THEN 'drop' WHEN 1 THEN 'turn' WHEN 2 THEN 'merge' WHEN 3 THEN 'merge' WHEN 4 THEN 'split' WHEN 5 THEN 'reassign' ELSE 'merge' END AS action, CAST(ord % 5 AS INT) AS k, ord % 2 AS h FROM {members})
SELECT ord, CASE WHEN k >= 3 THEN 'over the limit' WHEN action = 'drop' THEN 'drop is not allowed' WHEN action = 'turn' THEN 'unknown action' WHEN ord % 7 = 2 AND h = 0 THEN 'merge needs two regions' WHEN ord % 7 = 2 THEN 'index out of range' WHEN ord % 7 = 3 AND h = 0 THEN 'regions are not consecutive' WHEN ord % 7 = 6 AND h = 0 THEN 'merge needs a purpose'
  WHEN action = 'split' AND h = 0 THEN 'split is not inside' WHEN action = 'reassign' AND h = 0 THEN 'target is the stage' END AS error FROM x""")
def rg_validate_actions(r):
    """Three regions each; indices, places and targets that are wrong for even orders, and some for odd ones."""
    k, even = F.col("ord") % 7, F.col("ord") % 2 == 0
    action = F.when(k == 0, "drop").when(k == 1, "turn").when(k == 4, "split").when(k == 5, "reassign").otherwise("merge")
    refs = F.when(k == 2, F.when(even, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(3)))).when((k == 3) & even, F.array(F.lit(0), F.lit(2))).when(k.isin(3, 6), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    own = F.array(*(F.struct(F.lit(10 * n + 1).alias("line_start"), F.lit(10 * n + 8).alias("line_end")) for n in range(3)))
    rows = r.members.select(
        "ord", action.alias("action"), refs.alias("refs"), F.when(even, 18).otherwise(12).alias("at"), F.when(even, "stage-1").otherwise("stage-2").alias("target"), F.lit("stage-1").alias("current"),
        F.when((k == 6) & even, " ").otherwise("p").alias("purpose"), own.alias("regions"),
    )
    return regions.validate_actions(rows.withColumnRenamed("ord", "at_ord").withColumn("ord", (F.col("at_ord") % 5).cast("int"))).select(F.col("at_ord").alias("ord"), "error")


@query("SELECT CASE WHEN ord % 3 = 0 THEN concat(qualname, '_new') ELSE qualname END AS qualname, stage, ord FROM (SELECT ord, concat(qualname, '_', ord) AS qualname, stage FROM {members}) m WHERE ord % 5 > 0")
def ch_apply_renames(r):
    m = r.members.select(F.concat_ws("_", "qualname", "ord").alias("qualname"), "stage", "ord")
    renamed = m.where("ord % 3 = 0").select(F.col("qualname").alias("old_name"), F.concat("qualname", F.lit("_new")).alias("new_name"))
    return changes.apply_renames(m, renamed, m.where("ord % 5 = 0")).select("qualname", "stage", "ord")


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN concat('plain ', event_id) ELSE concat('said ', event_id) END AS text FROM {events}")
def lm_reply_text(r):
    said = F.concat(F.lit("said "), "event_id")
    k = F.col("event_id") % 5
    quoted = F.concat(F.lit('"'), said, F.lit('"'))
    body = F.when(k == 0, F.concat(F.lit('{"choices": [{"message": {"content": '), quoted, F.lit("}}]}"))).when(k == 1, F.concat(F.lit('{"content": [{"type": "text", "text": '), quoted, F.lit("}]}"))).when(k == 2, F.concat(F.lit('{"output_text": '), quoted, F.lit("}")))
    body = body.when(k == 3, F.concat(F.lit('{"response": '), quoted, F.lit(', "text": "no"}'))).otherwise(F.concat(F.lit("plain "), "event_id"))
    return r.events.select("event_id", gates.reply_text(body).alias("text"))


# --- tree ------------------------------------------------------------------------------


@query("SELECT id, substr(sha1(concat(id, '|', title)), 1, 12) AS k, CASE WHEN ord % 3 = 0 THEN id ELSE title END AS title, CASE WHEN ord % 2 = 0 THEN FALSE ELSE crosscut END AS crosscut FROM {stages}")
def tr_accessors(r):
    """TR-12, TR-17: keys, titles that fall back to ids, flags that fall back to false."""
    s = r.stages.withColumn("k", tree.cache_key("id", F.lit("|"), "title"))
    s = s.withColumns({"title": F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("title")), "crosscut": F.when(F.col("ord") % 2 == 1, F.col("crosscut"))})
    return tree.accessors(s).join(s.select("id", "k"), "id")


# --- sinks: written, read again ---------------------------------------------------------


@query("SELECT id, qualname, file, line_start, array_to_string(used_self_attrs_read, '|') AS used_self_attrs_read, synthetic FROM {functions}")
def sk_functions_csv(r):
    f = r.functions.select("id", "qualname", "file", "line_start", "used_self_attrs_read", "synthetic")
    path = _again(r, f, "functions")
    exports.functions_csv(f, path)
    return r.spark.read.option("header", True).schema("id string, qualname string, file string, line_start int, used_self_attrs_read string, synthetic boolean").csv(path)


@query("SELECT ord, caller_id, callee_id, call_type, line FROM {kept}")
def sk_graph_json(r):
    kept = r.kept.select("ord", "caller_id", "callee_id", "call_type", "line")
    path = _again(r, kept, "graph")
    exports.graph_json(r.functions.select("id"), kept, path)
    return r.spark.read.schema(kept.schema).json(f"{path}/edges")


@query("SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS category, l_orderkey, l_linenumber FROM {lineitem}")
def sk_dropped_json(r):
    rows = r.lineitem.select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("category"), "l_orderkey", "l_linenumber")
    path = _again(r, rows, "dropped")
    exports.dropped_json(rows, path)
    return r.spark.read.schema(rows.schema).json(path)


@query("""SELECT concat('"', id, '" [group="', file, '"];') AS text FROM {functions} UNION ALL SELECT concat('"', caller_id, '" -> "', callee_id, '" [', CASE WHEN is_await AND callee_id LIKE 'boundary:%' THEN 'color=blue,style=dashed' WHEN is_await THEN 'color=blue' WHEN callee_id LIKE 'boundary:%' THEN 'style=dashed' ELSE '' END, '];') FROM {kept}""")
def sk_dot_lines(r):
    return exports.dot_lines(r.functions, r.kept).select("text")


@query("SELECT file, CASE WHEN ord % 3 = 0 THEN concat(purpose, '!') ELSE purpose END AS purpose FROM {cards}")
def sk_card_store(r):
    """SK-5: cards stored, those that changed appended, the latest of each read."""
    cards = r.cards.select("file", "purpose")
    path = _again(r, cards, "cards")
    none = r.spark.createDataFrame([], "file string, content_sha1 string")
    artifacts.append_cards(artifacts.changed_cards(cards, none), path, 1)
    new = r.cards.select("file", F.when(F.col("ord") % 3 == 0, F.concat("purpose", F.lit("!"))).otherwise(F.col("purpose")).alias("purpose"))
    schema = "file string, purpose string, content_sha1 string, version int"
    artifacts.append_cards(artifacts.changed_cards(new, artifacts.latest_cards(r.spark.read.schema(schema).json(path))), path, 2)
    return artifacts.latest_cards(r.spark.read.schema(schema).json(path)).select("file", "purpose")


@query("""SELECT s_suppkey AS doc, unnest([1, 2, 3]) AS line, unnest([concat('A & b ', s_suppkey), concat('a--B ', s_suppkey), '!c']) AS title, unnest([concat('a-b-', s_suppkey), concat('a-b-', s_suppkey, '-1'), 'c']) AS slug FROM {supplier}""")
def sk_slugs(r):
    heads = F.explode(F.array(*(F.struct(F.lit(n).alias("line"), t.alias("title")) for n, t in ((1, F.concat(F.lit("A & b "), "s_suppkey")), (2, F.concat(F.lit("a--B "), "s_suppkey")), (3, F.lit("!c"))))))
    return exports.unique_slugs(r.supplier.select(F.col("s_suppkey").alias("doc"), heads.alias("h")).select("doc", "h.*"))


# --- pages -------------------------------------------------------------------------------

PAGE = f"""SELECT s_suppkey AS k, concat('p', s_suppkey) AS id, s_name AS title, concat('# A <b> `x', s_suppkey, '`', {NL}, 'One *two*', {NL}, 'three & **four**', {NL}, {NL}, '- a', {NL}, '  - b [c](d.html)', {NL}, '    1. deep', {NL}, '- e', {NL}, {NL}, '| h | i |', {NL}, '|---|:-:|', {NL}, '| ', s_nationkey, ' | `z` |', {NL}, {NL},
  '```python', {NL}, 'def f(x):  # no', {NL}, '    return "s" + ', s_nationkey, {NL}, '```', {NL}, '> said', {NL}, '> on', {NL}, '---', {NL}, 'end') AS text FROM {{supplier}}"""


@query(f"""WITH p AS ({PAGE}), n AS (SELECT *, s_nationkey FROM p JOIN {{supplier}} ON s_suppkey = k)
SELECT id, concat('<!doctype html><html><head><meta charset="utf-8"><title>', title, ' — Stages</title></head><body><nav>', CASE WHEN k > 1 THEN concat('<a href="p', k - 1, '.html">previous</a>') ELSE '' END, '</nav><main>',
  '<h1>A &lt;b&gt; <code>x', k, '</code></h1><p>One <em>two</em> three &amp; <strong>four</strong></p><ul><li>a<ul><li>b <a href="d.html">c</a><ol><li>deep</li></ol></li></ul></li><li>e</li></ul><table><tr><th>h</th><th>i</th></tr><tr><td>', s_nationkey, '</td><td><code>z</code></td></tr></table>',
  '<pre><code class="python"><span class="k">def</span> f(x):  <span class="c"># no</span>', {NL}, '    <span class="k">return</span> <span class="s">&quot;s&quot;</span> + ', '<span class="n">', s_nationkey, '</span></code></pre><blockquote><p>said on</p></blockquote><hr><p>end</p></main></body></html>') AS html FROM n""")
def sk_html_pages(r):
    """SK-8: a page a supplier, with a nested list, a table and code."""
    docs = r.spark.sql(PAGE, supplier=r.supplier).withColumns({"before": F.when(F.col("k") > 1, F.concat(F.lit("p"), F.col("k") - 1)), "after": F.lit(None).cast("string")})
    return markdown_html.pages(docs)


@query("SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'delete' ELSE 'write' END AS what, concat('p', s_suppkey) AS id FROM {supplier} WHERE s_suppkey % 4 = 0 OR s_suppkey % 3 = 0")
def sk_changed_pages(r):
    """SK-9: pages written once, some changed and some gone since; a second run has nothing to write."""
    docs = r.spark.sql(PAGE, supplier=r.supplier).withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")})
    first, _ = markdown_html.changed_pages(markdown_html.pages(docs), r.spark.createDataFrame([], "id string, sha1 string"))
    path = _again(r, docs, "pages")
    first.write.parquet(path)
    now = docs.where("k % 4 > 0").withColumn("text", F.when(F.col("k") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    write, gone = markdown_html.changed_pages(markdown_html.pages(now), r.spark.read.parquet(path))
    return write.select(F.lit("write").alias("what"), "id").unionByName(gone.select(F.lit("delete").alias("what"), "id"))


@query(f"""WITH RECURSIVE {TREE}, o AS (SELECT id, depth, CAST(row_number() OVER (ORDER BY ords, id) AS INT) AS page FROM t)
SELECT page, 0 AS part, '' AS file, concat(repeat('#', CAST(least(depth + 2, 6) AS INT)), ' ', title, ' — `', s.id, '`') AS text FROM o JOIN {{stages}} s ON s.id = o.id
UNION ALL SELECT page, 1, '', description FROM o JOIN {{stages}} s ON s.id = o.id WHERE trim(description) <> ''
UNION ALL SELECT page, 2, file, concat('- `', file, '`', CASE WHEN ord % 4 = 0 THEN '' ELSE concat(': P', ord) END) FROM o JOIN {{file_stage}} f ON f.stage = o.id""")
def sk_page_lines(r):
    """SK-6: stage pages as lines, written in order and read again."""
    files = r.file_stage.select("stage", F.col("ord").alias("position"), "file", F.when(F.col("ord") % 4 > 0, F.concat(F.lit("P"), "ord")).alias("purpose"))
    lines = render.page_lines(r.stages, files)
    exports.write_lines(lines, ["page", "part", "position", "file"], _again(r, lines, "lines"))
    return lines.select("page", "part", "file", "text")


# --- scripts ----------------------------------------------------------------------------

#: per language: file, source, and per function name, lines and the names it calls
SCRIPTS = {
    "shell": ("pkg«k»/s«p».sh", "# f«p»() { no; }\nf«p»() {\n  local x=$(find . | sort)\n  cat <<EOF\nnever\nEOF\n  A=1 /bin/g«p» \"a; b\"\n}\nfunction g«p» { f«p» && echo 'c; d'; }\n",
              [("f«p»", 2, 8, [("find", 3), ("sort", 3), ("cat", 4), ("g«p»", 7)]), ("g«p»", 9, 9, [("f«p»", 9), ("echo", 9)])]),
    "powershell": ("pkg«k»/p«p».ps1", "function Get-T«p» {\n  $x = Get-Item \"a; Remove-It\" | Sort-Object\n  if ($x) { return Set-T«p» $x }\n}\nfunction Set-T«p» { Write-Output 1 }\n",
                   [("Get-T«p»", 1, 4, [("Get-Item", 2), ("Sort-Object", 2), ("Set-T«p»", 3)]), ("Set-T«p»", 5, 5, [("Write-Output", 5)])]),
    "starlark": ("pkg«k»/b«p».bzl", "def macro«p»(name):\n    native.rule(\n        name = name,\n        deps = [h«p»(x) for x in select({})],\n    )\ndef h«p»(x): return x.strip()\n",
                 [("macro«p»", 1, 5, [("rule", 2), ("h«p»", 4), ("select", 4)]), ("h«p»", 6, 6, [("strip", 6)])]),
}


def _scripts(lang: str) -> None:
    file, source, functions = SCRIPTS[lang]
    module = file.rsplit(".", 1)[0].replace("/", ".") + "."
    own = {name for name, *_ in functions}

    def made(spark, sf_dir):
        return scan.extract(Relations(spark, sf_dir).part.selectExpr(f"'{lang}' AS lang", f"{filled(file)} AS file", f"{filled(source.replace(chr(10), '«n»'))} AS source"))

    def records(spark, sf_dir):
        return made(spark, sf_dir).where("kind = 'function'").select("id", "name", "line_start", "line_end")

    def edges(spark, sf_dir):
        got = stored(made(spark, sf_dir).select("kind", "ord", "id", "name", "line_start", "raw"))  # calls and functions are made of it
        calls = got.where("kind = 'call'").select("ord", F.col("id").alias("caller_id"), "name", F.col("line_start").alias("line"), "raw")
        done = resolve.resolve_scripts(calls, got.where("kind = 'function'").select("id", "name", "ord"))
        return done.select("caller_id", "callee_id", "call_type", "line")

    QUERIES[f"ex_{lang}_functions"], QUERIES[f"rs_{lang}_resolve"] = records, edges
    SQL[f"ex_{lang}_functions"] = " UNION ALL ".join(f"SELECT {filled(module + name)} AS id, {filled(name)} AS name, {a} AS line_start, {b} AS line_end FROM part" for name, a, b, _ in functions)
    rows = [(name, called, line) for name, _, _, calls in functions for called, line in calls]
    SQL[f"rs_{lang}_resolve"] = " UNION ALL ".join(
        f"SELECT {filled(module + name)} AS caller_id, {filled(module + called if called in own else 'boundary:' + called)} AS callee_id, '{'internal_func' if called in own else 'boundary'}' AS call_type, {line} AS line FROM part" for name, called, line in rows
    )


for _lang in SCRIPTS:
    _scripts(_lang)
