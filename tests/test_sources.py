"""Discovery, Markdown, extraction and resolution on small inputs."""

from loomgraph.functions import json_block, python_source, scan
from loomgraph.operators import resolve
from loomgraph.plans import annotate, loops
from loomgraph.sources import discover, exports, markdown

MAIN = '''
import json
from lib.util import load, Cfg as C

class Runner:
    def __init__(self, cfg: C | None):
        self.cfg = C()
        self.n = 0

    async def run(self, c: "C"):
        self.n += 1
        await self._step()
        self.cfg.get()
        c.get()
        return json.loads("1")

    def _step(self):
        return self.n

def main():
    r = Runner(None)
    r.run(1)
    return load()
'''
UTIL = '''
class Cfg:
    def get(self):
        return 1

def load():
    return Cfg()
'''


def test_python_records_and_resolution(spark):
    files = spark.createDataFrame([("app.py", MAIN, 0), ("lib/util.py", UTIL, 1), ("bad.py", "def (", 2)], "file string, source string, ord long")
    r = python_source.extract(files).cache()
    f = {x["qualname"]: x for x in r.where("kind = 'function'").collect()}
    assert set(f) == {"Runner.__init__", "Runner.run", "Runner._step", "main", "Cfg.get", "load"}
    run = f["Runner.run"]
    assert run["is_async"] and run["is_method"] and run["used_self_attrs_written"] == ["n"] and run["used_self_attrs_read"] == ["_step", "cfg", "n"]
    assert r.where("kind = 'error'").count() == 1
    got = {(x["caller_id"], x["callee_id"]): x["call_type"] for x in resolve.resolve_python(r).collect()}
    assert got[("app.Runner.run", "app.Runner._step")] == "self_method"
    assert got[("app.Runner.run", "lib/util.Cfg.get")] in ("self_attr_method", "param_method")
    assert got[("app.Runner.run", "boundary:json.loads")] == "boundary"
    assert got[("app.main", "app.Runner.__init__")] == "internal_constructor"
    assert got[("app.main", "boundary:lib.util.load")] == "boundary"  # a first segment never equals an id with a slash
    assert got[("app.main", "unresolved:r.run")] == "unresolved"
    assert got[("lib/util.load", "lib/util.Cfg.__init__")] == "internal_constructor"


def test_statement_spans():
    assert python_source.statement_spans("def f():\n  a = 1\n  if a:\n    b = 2\n", "f") == [(2, 2), (3, 4), (4, 4)]
    assert python_source.statement_spans("def (", "f") == []


def test_scans():
    go = list(scan.scan("go", "a/b.go", "func (s *Srv) Run(x int) {\n\ts.step()\n}\nfunc main() {\n\tRun()\n}\n"))
    assert [(r["id"], r["line_start"], r["line_end"]) for r in go if r["kind"] == "function"] == [("a.b.Srv.Run", 1, 3), ("a.b.main", 4, 6)]
    assert [r["raw"] for r in go if r["kind"] == "call"] == ["s.step", "Run"]
    rust = list(scan.scan("rust", "src/lib.rs", "impl Foo {\n    pub async fn go(&self) {\n        bar::baz(1);\n    }\n}\n"))
    assert rust[0]["id"] == "src::Foo::go" and rust[0]["is_async"] and rust[1]["raw"] == "bar::baz"
    assert [r["name"] for r in scan.scan("typescript", "x.ts", "class A {\n  run(x: number): void {\n    go();\n  }\n}\n")] == ["run", "go"]


def test_discovery_and_cards(spark, tmp_path):
    for p, t in {"a/x.py": "x", "node_modules/y.py": "y", "b/z_test.go": "z", "b/m.go": "m", "t/q.d.ts": "q", "t/r.ts": "r"}.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text(t)
    got = sorted((r["lang"], r["file"]) for r in discover.discover(spark, str(tmp_path / "src")).collect())
    assert got == [("go", "b/m.go"), ("python", "a/x.py"), ("typescript", "t/r.ts")]
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards/1.json").write_text('{"file": "a", "purpose": "one"}')
    (tmp_path / "cards/2.json").write_text('{"file": "a", "purpose": "two"}')
    (tmp_path / "cards/3.json").write_text("{broken")
    assert [(r["file"], r["purpose"]) for r in discover.load_cards(spark, str(tmp_path / "cards")).collect()] == [("a", "two")]


def test_markdown(spark):
    text = "# T\n## Stage One — `stage-1`\n\nFirst\npart\n\nmore\n### Sub — `stage-1.1`\n| a |\n```\n## Fake — `stage-9`\n```\n- `f` (x.py:1-9)\n- `g` (x.py:2-3)\n| `reg-a` | S | stage-1 |\n"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    s = markdown.with_parents(markdown.skeleton(docs))
    assert sorted((r["id"], r["title"], r["description"], r["parent"]) for r in s.collect()) == [("stage-1", "One", "First part", None), ("stage-1.1", "Sub", "(no description)", "stage-1")]
    spans = spark.createDataFrame([("f", "x.py", 1, 9), ("g", "x.py", 1, 9)], "qualname string, file string, line_start int, line_end int")
    assert sorted((r["stage"], r["qualname"], r["type"]) for r in markdown.index_members(docs, spans).collect()) == [("stage-1.1", "f", "function"), ("stage-1.1", "g", "region")]
    assert [(r["id"], r["cells"]) for r in markdown.table_rows(docs, "reg").collect()] == [("reg-a", ["S", "stage-1"])]
    assert {r["title"]: r["parent_line"] for r in markdown.heading_tree(docs).collect()}["Sub — `stage-1.1`"] == 2
    slugs = exports.unique_slugs(spark.createDataFrame([("d", 1, "A b"), ("d", 2, "a-B"), ("d", 3, "c")], "doc string, line int, title string"))
    assert sorted(r["slug"] for r in slugs.collect()) == ["a-b", "a-b-1", "c"]


def test_json_block(spark):
    assert json_block.json_block('x ```json\n[1]\n``` {"a": 2}') == "[1]"
    assert json_block.json_block('say {bad} then {"a": "}"} end') == '{"a": "}"}'
    assert json_block.json_block(None) is None and json_block.json_block("none") is None
    df = spark.createDataFrame([('{"a": 1}',), (None,)], "t string")
    assert [r[0] for r in df.select(json_block.extract_json("t")).collect()] == ['{"a": 1}', None]


def test_offline_pipeline(spark):
    files = spark.createDataFrame([("app/main.py",), ("lib/util.py",), ("x.py",)], "file string")
    profile = spark.createDataFrame([("app/main.py", 3)], "file string, n_functions int")
    cards = annotate.heuristic_cards(files, profile)
    stages = annotate.heuristic_stages(cards)
    fs = annotate.heuristic_assignment(cards, stages).select("file", "stage")
    said = loops.rollup(stages, fs, cards, lambda asked: asked.selectExpr("id", "concat('S: ', evidence) AS summary"))
    assert {r["id"]: r["summary"] for r in said.collect()}["stage-1"].startswith("S: app/main.py")
    ranked = fs.selectExpr("row_number() OVER (ORDER BY file) AS ord", "file", "stage")
    lost = ranked.selectExpr("ord", "file", "CASE WHEN ord = 1 THEN 'unassigned' ELSE stage END AS stage")
    _, done, history = loops.converge(stages, lost, lambda s, f: (s, f.selectExpr("ord", "file", "CASE WHEN stage = 'unassigned' THEN 'stage-1' ELSE stage END AS stage")))
    assert history[0][0] == 1 and history[-1][0] == 0 and done.where("stage = 'unassigned'").isEmpty()
    found = loops.until_dry(lambda k, f: spark.createDataFrame([(f"r{min(k, 1)}",)], "id string"), spark.createDataFrame([], "id string"))
    assert sorted(r["id"] for r in found.collect()) == ["r0", "r1"]
