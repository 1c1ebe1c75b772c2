"""Queries over made source files, one a part (EX, RS, GR-10, GR-11), and their SQL.

The standard tables hold no code, so a template a language makes a small file of every
part; what extraction and resolution must find in it is told by templates too, which the
SQL fills in with the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import python_source, static_source
from ..operators import resolve
from ..operators.numbering import stored
from . import drivers
from .surrogate import Relations

QUERIES, SQL = {}, {}

#: what a template's marks stand for: the part, the next one, and the folders of both
MARKS = {"p": "p_partkey", "q": "(p_partkey + 1)", "k": "p_partkey % 20", "j": "(p_partkey + 1) % 20", "t": "chr(9)", "n": "chr(10)"}


def filled(template: str) -> str:
    """SQL that fills a template's `«x»` marks."""
    parts = [MARKS[x[1]] if x[0] == "«" else "'" + x.replace("'", "''") + "'" for x in re.findall(r"«.»|[^«»]+", template)]
    return f"concat({', '.join(parts)}, '')"


FILES = {
    "python": "pkg«k»/mod«p».py", "rust": "pkg«k»/mod«p».rs", "go": "pkg«k»/mod«p».go", "typescript": "pkg«k»/mod«p».ts",
}
SOURCES = {
    "python": """from pkg«j».mod«q» import helper
import json
class Box:
    def __init__(self):
        self.n = «p»
    def get(self):
        return self.put(json.loads("1"))
    def put(self, x):
        self.n += x
        return helper(x)
def helper(x):
    return Box().get() + len(x)
""",
    "rust": """use crate::pkg«j»::mod«q»::helper«q»;
pub struct Box«p» { peer: Box«q», n: u8 }
impl Box«p» {
    pub fn new() -> Self { println!("x"); Self { n: 1 } }
    fn get(&self, other: &Box«q») -> u8 {
        self.put(helper«q»(1));
        self.peer.get();
        other.put(2)
    }
    fn put(&self, x: u8) { std::mem::drop(x); }
}
fn helper«p»(n: u8) -> u8 { Box«q»::new(); missing(n) }
""",
    "go": """package pkg
import "fmt"
type Box«p» struct {
«t»peer *Box«q»
}
func (b *Box«p») Get(other *Box«q») int {
«t»b.Put(helper«p»(1))
«t»b.peer.Get(nil)
«t»fmt.Println(other.Size())
«t»return 1
}
func (b *Box«p») Put(x int) {}
func helper«p»(n int) int { return missing(n) }
""",
    "typescript": """import { load } from "./util";
export class Box«p» {
  peer: Box«q»;
  async get(other: Box«q»): Promise<number> {
    await this.put(helper«p»(1));
    this.peer.get(load(2));
    return other.size();
  }
  put(x: number) {}
}
const helper«p» = (n: number) => missing(n);
export function clean«p»(s: string) { return s.replace(/[{"]/g, "").split(`${helper«p»(2)} {`); }
function last«p»() { return clean«p»(`a${`b${load(1 / 2)}`}`); }
""",
}
#: per function: qualname, first and last line, whether a method, signature
FUNCTIONS = {
    "python": [("Box.__init__", 4, 5, True, "def __init__(self)"), ("Box.get", 6, 7, True, "def get(self)"), ("Box.put", 8, 10, True, "def put(self, x)"), ("helper", 11, 12, False, "def helper(x)")],
    "rust": [("Box«p»::new", 4, 4, False, "fn new() -> Self"), ("Box«p»::get", 5, 9, True, "fn get(&self, other: &Box«q») -> u8"), ("Box«p»::put", 10, 10, True, "fn put(&self, x: u8)"), ("helper«p»", 12, 12, False, "fn helper«p»(n: u8) -> u8")],
    "go": [("Box«p».Get", 6, 11, True, "func (b *Box«p») Get(other *Box«q») int"), ("Box«p».Put", 12, 12, True, "func (b *Box«p») Put(x int)"), ("helper«p»", 13, 13, False, "func helper«p»(n int) int")],
    "typescript": [("Box«p».get", 4, 8, True, "async get(other: Box«q»): Promise<number>"), ("Box«p».put", 9, 9, True, "put(x: number)"), ("helper«p»", 11, 11, False, "helper«p» = (n: number) =>"),
        ("clean«p»", 12, 12, False, "function clean«p»(s: string)"), ("last«p»", 13, 13, False, "function last«p»()")],
}
MODULE = {"python": "pkg«k»/mod«p».", "rust": "pkg«k»::mod«p»::", "go": "pkg«k».mod«p».", "typescript": "pkg«k».mod«p»."}
NEXT = {lang: m.replace("«k»", "«j»").replace("«p»", "«q»") for lang, m in MODULE.items()}
#: per call: caller, line, and callee and type where the next part exists; where it makes a difference, those where it doesn't.  `@` is the own module, `>` the next one
CALLS = {
    "python": [
        ("Box.get", 7, "@Box.put", "self_method"), ("Box.get", 7, "boundary:json.loads", "boundary"), ("Box.put", 10, "@helper", "internal_func"), ("helper", 12, "unresolved:Box().get", "unresolved"),
        ("helper", 12, "@Box.__init__", "internal_constructor"), ("helper", 12, "unresolved:len", "unresolved"),
    ],
    "rust": [
        ("Box«p»::new", 4, "boundary:println!", "boundary"), ("Box«p»::get", 6, "@Box«p»::put", "self_method"), ("Box«p»::get", 6, ">helper«q»", "internal_func", "boundary:crate::pkg«j»::mod«q»::helper«q»", "boundary"),
        ("Box«p»::get", 7, ">Box«q»::get", "self_attr_method", "boundary:Box«q»::get", "boundary"), ("Box«p»::get", 8, ">Box«q»::put", "param_method", "boundary:Box«q»::put", "boundary"),
        ("Box«p»::put", 10, "boundary:std::mem::drop", "boundary"), ("helper«p»", 12, ">Box«q»::new", "internal_constructor", "boundary:Box«q»::new", "boundary_constructor"), ("helper«p»", 12, "unresolved:missing", "unresolved"),
    ],
    "go": [
        ("Box«p».Get", 7, "@Box«p».Put", "self_method"), ("Box«p».Get", 7, "@helper«p»", "internal_func"), ("Box«p».Get", 8, ">Box«q».Get", "self_attr_method", "boundary:Box«q».Get", "boundary"),
        ("Box«p».Get", 9, "boundary:fmt.Println", "boundary"), ("Box«p».Get", 9, ">Box«q».Size", "param_method", "boundary:Box«q».Size", "boundary"), ("helper«p»", 13, "unresolved:missing", "unresolved"),
    ],
    "typescript": [
        ("Box«p».get", 5, "@Box«p».put", "self_method"), ("Box«p».get", 5, "@helper«p»", "internal_func"), ("Box«p».get", 6, ">Box«q».get", "self_attr_method", "boundary:Box«q».get", "boundary"),
        ("Box«p».get", 6, "boundary:./util::load", "boundary"), ("Box«p».get", 7, ">Box«q».size", "param_method", "boundary:Box«q».size", "boundary"), ("helper«p»", 11, "unresolved:missing", "unresolved"),
        ("clean«p»", 12, 'unresolved:s.replace(/[{"]/g, "").split', "unresolved"), ("clean«p»", 12, "unresolved:s.replace", "unresolved"), ("clean«p»", 12, "@helper«p»", "internal_func"),
        ("last«p»", 13, "@clean«p»", "internal_func"), ("last«p»", 13, "boundary:./util::load", "boundary"),
    ],
}
EXTRACTS = {"python": python_source.extract}
RESOLVES = {"python": resolve.resolve_python}


def made_files(r: Relations, lang: str) -> DataFrame:
    """(lang, file, source, ord): a file of a language for every part."""
    text = SOURCES[lang].replace("\n", "«n»")
    return r.part.selectExpr(f"'{lang}' AS lang", f"{filled(FILES[lang])} AS file", f"{filled(text)} AS source", "p_partkey AS ord")


def _full(lang: str, template: str) -> str:
    return filled(template.replace("@", MODULE[lang]).replace(">", NEXT[lang], 1) if template[0] in "@>" else template)


def functions_sql(lang: str) -> str:
    rows = [f"SELECT {filled(MODULE[lang] + q)} AS id, {filled(q)} AS qualname, {a} AS line_start, {b} AS line_end, {m} AS is_method, {filled(s)} AS signature FROM part" for q, a, b, m, s in FUNCTIONS[lang]]
    return " UNION ALL ".join(rows)


def edges_sql(lang: str) -> str:
    """What resolution must give: (caller_id, callee_id, call_type, line)."""
    rows = []
    for caller, line, callee, kind, *other in CALLS[lang]:
        there = lambda a, b: f"CASE WHEN nx IS NOT NULL THEN {a} ELSE {b} END"
        target = _full(lang, callee) if not other else there(_full(lang, callee), _full(lang, other[0]))
        kind = f"'{kind}'" if not other else there(f"'{kind}'", f"'{other[1]}'")
        rows.append(f"SELECT {filled(MODULE[lang] + caller)} AS caller_id, {target} AS callee_id, {kind} AS call_type, {line} AS line FROM (SELECT p.*, n.p_partkey AS nx FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1)")
    return " UNION ALL ".join(rows).replace("FROM (SELECT p.*, n.p_partkey AS nx FROM part p", "FROM (SELECT p.p_partkey, n.p_partkey AS nx FROM part p")


def _register(lang: str) -> None:
    def functions(spark, sf_dir):
        records = EXTRACTS.get(lang, static_source.extract)(made_files(Relations(spark, sf_dir), lang), ("function",))
        return records.select("id", "qualname", "line_start", "line_end", "is_method", "signature")

    def edges(spark, sf_dir):
        # written once, as every symbol table and the calls are made of the records; only Rust's resolution reads functions
        kinds = ("import", "type", "field", "method", "free", "call", *(["function"] if lang == "rust" else []))
        found = EXTRACTS.get(lang, static_source.extract)(made_files(Relations(spark, sf_dir), lang), kinds)
        records = stored(found.select(*resolve.COLUMNS))
        return RESOLVES.get(lang, lambda x: resolve.resolve_forms(x, lang))(records).select("caller_id", "callee_id", "call_type", "line")

    QUERIES[f"ex_{lang}_functions"], QUERIES[f"rs_{lang}_resolve"] = functions, edges
    SQL[f"ex_{lang}_functions"], SQL[f"rs_{lang}_resolve"] = functions_sql(lang), edges_sql(lang)


for _lang in SOURCES:
    _register(_lang)


def ex_python_calls(spark, sf_dir):
    """Calls as forms of the Python files."""
    return python_source.extract(made_files(Relations(spark, sf_dir), "python"), ("call",)).select("id", "form", "head", "name", "line", "is_await", "raw")


_FORMS = [("Box.get", "self", "self", "put", 7, "self.put"), ("Box.get", "member", "json", "loads", 7, "json.loads"), ("Box.put", "bare", None, "helper", 10, "helper"), ("helper", "other", None, "Box().get", 12, "Box().get"), ("helper", "bare", None, "Box", 12, "Box"), ("helper", "bare", None, "len", 12, "len")]
QUERIES["ex_python_calls"] = ex_python_calls
SQL["ex_python_calls"] = " UNION ALL ".join(
    f"SELECT {filled(MODULE['python'] + q)} AS id, '{form}' AS form, {'CAST(NULL AS VARCHAR)' if head is None else repr(head)} AS head, '{name}' AS name, {line} AS line, FALSE AS is_await, '{raw}' AS raw FROM part"
    for q, form, head, name, line, raw in _FORMS
)


def gr_tree_graph(spark, sf_dir):
    """GR-11: nodes with degrees of the graph over the Rust and Go files together."""
    r = Relations(spark, sf_dir)
    g = drivers.graph_of(made_files(r, "rust").unionByName(made_files(r, "go")))
    return g["nodes"].select("id", "kind", "n_callees", "n_callers")


QUERIES["gr_tree_graph"] = gr_tree_graph
SQL["gr_tree_graph"] = f"""
WITH e AS (SELECT * FROM ({edges_sql('rust')} UNION ALL {edges_sql('go')}) WHERE call_type <> 'unresolved'), f AS (SELECT id FROM ({functions_sql('rust')}) UNION SELECT id FROM ({functions_sql('go')})),
d AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT caller_id AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT callee_id, 0, 1 FROM e) GROUP BY 1),
n AS (SELECT id, 'internal' AS kind FROM f UNION ALL SELECT DISTINCT callee_id, 'boundary' FROM e WHERE callee_id LIKE 'boundary:%')
SELECT n.id, n.kind, CAST(coalesce(d.o, 0) AS BIGINT) AS n_callees, CAST(coalesce(d.i, 0) AS BIGINT) AS n_callers FROM n LEFT JOIN d USING (id)"""


def ex_statements(spark, sf_dir):
    """RG-4: how many statement spans the first method of each Rust file has, and where they start and end."""
    files = made_files(Relations(spark, sf_dir), "rust")
    asked = files.select("file", "source", F.lit("get").alias("qualname"))
    return python_source.statements(asked).groupBy("file").agg(F.count("*").alias("n"), F.min("s").alias("first_line"), F.max("e").alias("last_line"))


QUERIES["ex_statements"] = ex_statements
SQL["ex_statements"] = f"SELECT {filled(FILES['rust'])} AS file, 3 AS n, 6 AS first_line, 8 AS last_line FROM part"


def ch_freeze_gate(spark, sf_dir):
    """CH-12: every third Python file with a broken tail, every seventh broken at its head, every eleventh gone."""
    files = made_files(Relations(spark, sf_dir), "python")
    source = F.when(F.col("ord") % 11 == 0, None).when(F.col("ord") % 7 == 0, F.concat(F.lit("def (\n"), "source")).when(F.col("ord") % 3 == 0, F.concat("source", F.lit("    x = (\n"))).otherwise(F.col("source"))
    return python_source.freeze_gate(files.withColumn("source", source)).select("file", "state", F.sha1("source").alias("sha1"))


QUERIES["ch_freeze_gate"] = ch_freeze_gate
_OK = filled(SOURCES["python"].replace("\n", "«n»"))
SQL["ch_freeze_gate"] = f"""SELECT {filled(FILES['python'])} AS file, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN 'frozen' WHEN p_partkey % 3 = 0 THEN 'repaired' ELSE 'ok' END AS state,
  CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE sha1({_OK}) END AS sha1 FROM part"""
