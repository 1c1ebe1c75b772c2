"""Artifacts, renderers, drivers and targets on small inputs."""

import pytest

from pyspark.sql import functions as F

from loomgraph.functions import python_source
from loomgraph.operators import gates, graph, inventory, locate, mapping, nav, numbering, patterns, regions, registers, render, tree
from loomgraph.plans import drivers, requests, targets
from loomgraph.sources import artifacts, discover

STAGES = "ord long, id string, title string, description string, parent string, crosscut boolean"


@pytest.fixture(scope="module")
def stages(spark):
    rows = [(0, "stage-1", "One", "First\nline: \"x\"", None, False), (1, "stage-1.1", "Sub", "null", "stage-1", False), (2, "crosscut-a", "All", None, None, True)]
    return spark.createDataFrame(rows, STAGES)


def test_graph_document(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a", "a", 1, True), (1, "b\"", "b", 2, None), (2, "a", "A", 3, False)], "ord long, id string, name string, line_start int, synthetic boolean")
    kept = spark.createDataFrame([(0, "a", "b\"", False, "internal_func", 3, "b()"), (1, "a", "a", True, "self_method", 4, None)], "ord long, caller_id string, callee_id string, is_await boolean, call_type string, line int, raw string")
    artifacts.save_lines(artifacts.graph_lines(nodes, kept, {"language": "python"}), f"{tmp_path}/graph")
    got, edges = artifacts.load_graph(spark, f"{tmp_path}/graph")
    assert sorted((r["id"], r["name"], r["line_start"]) for r in got.collect()) == [("a", "A", 3), ('b"', "b", 2)]
    assert [(r["ord"], r["caller_id"], r["callee_id"], r["raw"]) for r in edges.orderBy("ord").collect()] == [(0, "a", 'b"', "b()"), (1, "a", "a", None)]
    artifacts.save_lines(artifacts.graph_lines(nodes.limit(0), kept.limit(0), {}), f"{tmp_path}/empty")
    assert artifacts.load_graph(spark, f"{tmp_path}/empty")[0].count() == 0


def test_skeleton_yaml(spark, stages):
    text = "".join(r["text"] for r in artifacts.skeleton_yaml(stages).orderBy("ord").collect())
    back = artifacts.load_skeleton(spark.createDataFrame([("d", text), ("n", None)], "doc string, text string")).orderBy("ord").collect()
    assert [(r["id"], r["title"], r["description"], r["parent"], r["crosscut"], r["children"]) for r in back] == [
        ("stage-1", "One", 'First\nline: "x"', None, False, ["stage-1.1"]), ("stage-1.1", "Sub", "null", "stage-1", False, []), ("crosscut-a", "All", None, None, True, []),
    ]
    other = "stages:\n  - id: stage-2\n    title: 'It''s'\n    children:\n      - a\n      - b\n    description: >-\n      two\n      words\n"
    (item,) = artifacts.yaml_items(other)
    assert item == {"id": "stage-2", "title": "It's", "children": ["a", "b"], "description": "two words"}


def test_bundles_and_records(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/a.parquet")
    assert artifacts.load_bundle(spark, str(tmp_path), ["a"])["a"].count() == 1
    with pytest.raises(FileNotFoundError, match="b, c"):
        artifacts.load_bundle(spark, str(tmp_path), ["a", "b", "c"])
    (tmp_path / "r").mkdir()
    for name, text in {"x.json": '{"v": 1}', "_index.json": '{"v": 2}', "bad.json": "{"}.items():
        (tmp_path / "r" / name).write_text(text)
    assert [(r["record"], r["v"]) for r in artifacts.load_records(spark, f"{tmp_path}/r", "v int").collect()] == [("x", 1)]
    cards = spark.createDataFrame([("a", "one"), ("b", "two")], "file string, purpose string")
    none = spark.createDataFrame([], "file string, content_sha1 string")
    first = artifacts.changed_cards(cards, none)
    artifacts.append_cards(first, f"{tmp_path}/cards", 1)
    stored = spark.read.json(f"{tmp_path}/cards")
    again = artifacts.changed_cards(cards.replace("two", "three"), artifacts.latest_cards(stored))
    assert [r["file"] for r in again.collect()] == ["b"]
    artifacts.append_cards(again, f"{tmp_path}/cards", 2)
    assert {r["file"]: r["purpose"] for r in artifacts.latest_cards(spark.read.json(f"{tmp_path}/cards")).collect()} == {"a": "one", "b": "three"}


def test_recovery(spark):
    docs = spark.createDataFrame([("d", "## One — `stage-1`\n\nSays so.\n\n| `reg-a` | Holds | stage-1, side-2 |\n")], "doc string, text string")
    assert [(r["id"], r["semantics"], r["stages"]) for r in artifacts.recover_registers(docs).collect()] == [("reg-a", "Holds", ["stage-1", "side-2"])]
    assert [(r["id"], r["summary"]) for r in artifacts.recover_summaries(docs).collect()] == [("stage-1", "Says so.")]


def test_render_helpers(spark):
    t = spark.createDataFrame([('{"target": "f", "why": "x"}',), ("plain",)], "t string")
    assert [r[0] for r in t.select(render.relation_text(t.t)).collect()] == ["`f` — x", "plain"]
    ids = spark.createDataFrame([("read",), ("x",)], "i string")
    assert [r[0] for r in ids.select(render.action_mark(ids.i)).collect()] == ["👁 reads", "x"]
    heads = spark.createDataFrame([("d", 1, 2, "A", "a"), ("d", 2, 3, "B", "b")], "doc string, line int, level int, title string, slug string")
    assert [r["text"] for r in render.toc(heads).orderBy("line").collect()] == ["- [A](#a)", "  - [B](#b)"]


def test_python_gates():
    assert python_source.parses("x = 1") and not python_source.parses("x = (")
    assert python_source.tail_repaired("a = 1\nb = (\n") == "a = 1\n" and python_source.tail_repaired("(\n" * 12) is None
    assert python_source.definition_spans("class A:\n  @d\n  def f(self): pass\n") == [("A.f", 2, 3)]


def test_definitions(spark):
    rows = [("a.py", "@d\ndef f():\n  pass\n"), ("b.rs", "fn g() {\n}\n"), ("c.rs", "fn g( {"), ("d.txt", None)]
    got = {(r["file"], r["qualname"], r["line_start"], r["line_end"], r["parses"]) for r in python_source.definitions(spark.createDataFrame(rows, "file string, source string")).collect()}
    assert got == {("a.py", "f", 1, 3, True), ("b.rs", "g", 1, 2, True), ("c.rs", "g", 1, 1, False), ("d.txt", None, None, None, True)}


def test_drivers(spark):
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError("later")
        return "done"

    assert drivers.retried(flaky, sleep=lambda s: None)("x") == "done" and len(calls) == 3

    def refused(text):
        calls.append(text)
        raise type("Refused", (Exception,), {"status": 403})

    calls.clear()
    with pytest.raises(Exception):  # noqa: B017
        drivers.retried(refused, sleep=lambda s: None)("x")
    assert len(calls) == 1
    asked = spark.createDataFrame([("k1", "a"), ("k2", "b")], "request_key string, text string")
    replies = spark.createDataFrame([("k1", "one")], "request_key string, reply string")
    answered, all_replies = drivers.ask(asked, replies, lambda r: r.selectExpr("request_key", "concat('new ', text) AS reply"))
    assert {r["request_key"]: r["reply"] for r in answered.collect()} == {"k1": "one", "k2": "new b"} and all_replies.count() == 2
    tree = [{"id": "a", "title": "A"}, {"id": "b", "title": "B"}]
    after, moved, errors = drivers.doctor_round(tree, {"a": [{"action": "split_stage", "stage": "a", "new_ids": ["a1", "a2"]}, {"action": "remove_stage", "stage": "b"}]}, [{"action": "remove_stage", "stage": "a"}, {"action": "add_stage", "stage": "c", "title": "C"}])
    assert {s["id"] for s in after} == {"a", "b", "a1", "a2", "c"} and moved == {"a"} and sorted(filter(None, errors)) == ["outside its scope", "protected stage"]
    verdicts = spark.createDataFrame([(0, 1, 0, "x", "APPROVE", []), (1, 1, 0, "x", "REJECT", ["no"])], "proposal int, round int, role_ord int, role string, decision string, concerns array<string>")
    after, _, errors = drivers.skeleton_pass([{"action": "remove_stage", "stage": "b"}, {"action": "remove_stage", "stage": "a"}], verdicts, tree, {})
    assert [s["id"] for s in after] == ["a"] and errors == [None, "not accepted"]
    assert drivers.draft("agent", lambda: [{"id": "x"}], lambda: [], lambda t: t)[0]["id"] == "x"
    with pytest.raises(ValueError, match="no stages"):
        drivers.draft("oneshot", lambda: [], lambda: [], lambda t: t)
    with pytest.raises(ValueError):
        drivers.replay("medium", dict, dict)


MEMBERS = "stage string, ord long, qualname string, type string, file string, line_start int, line_end int, purpose string"


def test_function_passes(spark):
    members = spark.createDataFrame([("s1", 0, "f", "function", "x", 1, 9, "p"), ("s1", 1, "g", "region", "x", 20, 25, "a"), ("s2", 2, "g", "region", "x", 26, 30, "b"), ("s1", 3, "h", "function", "x", 40, 44, "q")], MEMBERS)
    table = spark.createDataFrame([("s1", False), ("s2", False)], "id string, crosscut boolean")
    nodes = spark.createDataFrame([(0, "f", "x", 1, 9, "internal"), (1, "h", "x", 40, 44, "internal")], "ord long, qualname string, file string, line_start int, line_end int, kind string")
    asked = spark.createDataFrame([("f", "k"), ("h", "none")], "qualname string, request_key string")
    replies = spark.createDataFrame([("k", '[{"stage": "s2"}, {"stage": "s1", "line_start": 2, "line_end": 4, "purpose": "part"}, {"stage": "zz"}]')], "request_key string, reply string")
    got = {(r["stage"], r["qualname"], r["type"], r["line_start"]) for r in drivers.classify(members, asked, replies, table, nodes).collect()}
    assert got == {("s2", "f", "function", 1), ("s1", "f", "region", 2), ("s1", "g", "region", 20), ("s2", "g", "region", 26), ("s1", "h", "function", 40)}
    actions = spark.createDataFrame([("g", 0, "merge", [0, 1], None, None, "both"), ("g", 1, "reassign", [1], None, "s9", None)], "qualname string, ord int, action string, refs array<int>, at int, target string, purpose string")
    done = drivers.revise_regions(members, actions)
    assert sorted((r["qualname"], r["stage"], r["line_start"], r["line_end"]) for r in done.collect()) == [("f", "s1", 1, 9), ("g", "s1", 20, 30), ("h", "s1", 40, 44)]
    empty = spark.createDataFrame([], "stage string, fingerprint string")
    moves = spark.createDataFrame([("s1", 0, "f", "s1", "s2"), ("s1", 1, "h", "s1", "zz")], "audited string, ord int, qualname string, source string, target string")
    after, checked, cache = drivers.audit(members, moves, table, empty)
    assert {r["error"] for r in checked.collect()} == {None, "unknown target"} and after.where("qualname = 'f'").first()["stage"] == "s2"
    assert mapping.audit_due(members, cache).isEmpty()
    units = spark.createDataFrame([("s1", 0, "f", "single", []), ("s1", 1, "h", "single", ["f"]), ("s2", 0, "g", "single", [])], "stage string, ord int, qualname string, kind string, before array<string>")
    texts = spark.createDataFrame([("f", "def f()")], "qualname string, text string")
    none = spark.createDataFrame([], "request_key string, reply string")
    doc, open_ = drivers.assemble(units, none, texts, none)
    assert doc.isEmpty() and open_.count() == 3
    some = open_.where("stage = 's2' OR qualname = 'f'").selectExpr("request_key", "qualname AS reply")
    doc, open_ = drivers.assemble(units, some, texts, none)
    assert [(r["stage"], r["text"]) for r in doc.collect()] == [("s2", "g")] and open_.count() == 1


def test_describe_files(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    cards = spark.createDataFrame([("a", "done", "util", "", "")], "file string, purpose string, role string, lifecycle string, description string")
    tier = lambda cond: lambda m: m.selectExpr("file", f"CASE WHEN {cond} THEN concat('[{{\"file\": \"', file, '\", \"purpose\": \"P\", \"role\": \"odd\"}}]') END AS reply")
    got = {r["file"]: (r["purpose"], r["role"]) for r in drivers.describe_files(files, cards, [tier("file = 'z'"), tier("file = 'b'")]).collect()}
    assert got == {"a": ("done", "util"), "b": ("P", "other"), "c": ("", "other")}


def test_targets(monkeypatch):
    t = targets.put(targets.Target("my-app", "rust", ("src/**/*.rs",), places={"source": ("/a", "/b")}, facts={"Purpose": "x", "Empty": ""}))
    assert targets.target("my-app") is t and t.extension() == ".rs" and targets.Target("x", "go").extension() == ".go"
    with pytest.raises(KeyError, match="my-app"):
        targets.target("none")
    assert targets.place(t, "source", lambda p: p == "/b") == "/b" and targets.place(t, "source", lambda p: False, [lambda t: "/r"]) == "/r"
    with pytest.raises(FileNotFoundError):
        targets.place(t, "source", lambda p: False)
    monkeypatch.setenv("LOOMGRAPH_MY_APP_SOURCE", "/env")
    assert targets.place(t, "source", lambda p: True) == "/env" and targets.context_block(t) == "Project: my-app\nLanguage: rust\nPurpose: x"
    assert targets.package([{"i": "/x"}, {"i": "/y", "j": "/z"}], lambda p: p != "/x") == {"i": "/y", "j": "/z"}
    with pytest.raises(FileNotFoundError, match="i"):
        targets.package([{"i": "/x"}], lambda p: False)


def test_folds_and_snapping_match_plain_versions(spark):
    """Edges: empty tables, nulls, ties, hot keys, functions without statements."""
    import random

    rng = random.Random(4)
    spans = [(k, rng.randrange(60), 0) for k in range(6) for _ in range(rng.randrange(12))]
    spans = [(k, s, s + rng.randrange(9)) for k, s, _ in spans]
    asked = [(i, rng.randrange(8), rng.randrange(60), rng.randrange(70)) for i in range(300)] + [(999, None, 1, 2)]
    r = spark.createDataFrame(asked, "req int, fn int, a int, b int")
    s = spark.createDataFrame([*spans, (None, 1, 2)], "fn int, s int, e int")
    got = {x["req"]: (x["start"], x["end"], x["status"], x["distance"]) for x in regions.snap(r, s, ["fn"]).collect()}
    for i, fn, a, b in asked:
        own = sorted((x, y) for f, x, y in spans if f == fn and fn is not None)
        want = (a, b, "needs_review", 0)
        if own:
            x = min((q for q, _ in own if q >= a), default=max(q for q, _ in own))
            y = max((q for _, q in own if q <= b), default=own[0][1])
            if y >= x:
                d = max(abs(x - a), abs(y - b))
                want = (x, y, "needs_review" if d > 3 else "snapped" if d else "ok", d)
        assert got[i] == want, (i, fn, a, b, own)
    assert regions.snap(r.limit(0), s, ["fn"]).count() == 0 and regions.snap(r, s.limit(0), ["fn"]).where("status <> 'needs_review'").isEmpty()
    items = spark.createDataFrame([("a", k, 3) for k in range(7)] + [("b", 0, 50), ("b", 1, None), (None, 0, 1)], "k string, o long, n int")
    chunks = {(x["k"], x["o"]): x["chunk"] for x in inventory.greedy_chunks(items, "k", "o", "n", 7).collect()}
    assert [chunks["a", k] for k in range(7)] == [0, 0, 1, 1, 2, 2, 3] and chunks["b", 0] == 0 and chunks[None, 0] == 0
    assert inventory.greedy_chunks(items.limit(0), "k", "o", "n", 7).count() == 0
    acts = spark.createDataFrame([("f", 0, "merge", [0, 1]), ("f", 1, "split", [1]), ("f", 2, "split", [0]), ("f", 3, "reassign", [0]), ("g", 0, "reassign", None)], "qualname string, ord int, action string, refs array<int>")
    assert {(x["qualname"], x["ord"]): x["accepted"] for x in regions.conflicts(acts).collect()} == {("f", 0): True, ("f", 1): False, ("f", 2): True, ("f", 3): False, ("g", 0): True}
    rubric = spark.createDataFrame([("a", "gate", 0.3, 3), ("b", "soft", 0.7, 3)], "criterion string, kind string, weight double, floor int")
    scores = spark.createDataFrame([("u", "a", "9"), ("u", "b", "4"), ("v", "b", "bad"), ("w", "zz", "5")], "unit string, criterion string, score string")
    assert {x["unit"]: (x["overall"], x["gate_failures"], x["passed"]) for x in gates.weighted_verdict(rubric, scores).collect()} == {"u": (4.3, 0, True), "v": (1.0, 1, False), "w": (1.0, 1, False)}


def test_fixed_values():
    """Values that results depend on, spelt out."""
    assert {"ValueError", "KeyError", "StopIteration", "len", "filter"} <= set(graph.BUILTINS) and not {"super", "hash", "input", "object"} & set(graph.BUILTINS) and len(graph.BUILTINS) == 43
    assert nav.HINTS == ["main", "run", "serve", "start", "execute", "exec", "dispatch", "handle", "handler", "cmd", "command", "app", "loop", "bootstrap"]
    assert {"mod", "win", "unix", "shared", "libraries", "startup"} <= set(locate.GENERIC) and not {"stage", "module", "code", "file", "from"} & set(locate.GENERIC) and len(locate.GENERIC) == 46
    assert locate.CORE_ROLES.index("data_model") == 3 and locate.CORE_ROLES[-1] == "test"
    assert {"catalog", "registry", "window", "identity"} <= set(registers.SHAPE_WORDS) and not {"table", "map", "list", "flag", "index"} & set(registers.SHAPE_WORDS) and len(registers.SHAPE_WORDS) == 21
    assert "sort" in registers.MUTATORS and not {"push", "put", "set", "delete"} & set(registers.MUTATORS) and len(registers.MUTATORS) == 11
    assert {".env", "site-packages"} <= set(discover.COMMON_SKIP) and not {".eggs", "third_party"} & set(discover.COMMON_SKIP) and len(discover.COMMON_SKIP) == 21
    assert [sum(round(100 * w) for t, _, _, w, _ in requests.RUBRICS if t == k) for k in (1, 2, 3)] == [100] * 3 and len(requests.RUBRICS) == 17
    assert [c for t, c, kind, _, _ in requests.RUBRICS if t == 1 and kind == "gate"] == ["purpose_clarity", "what_it_does", "novice_accessibility"]


def test_dropped_categories(spark):
    ids = ["unresolved:self.logger.info", "unresolved:self.x.y", "unresolved:'a'.join", "unresolved:len", "unresolved:print (x).flush", "unresolved:KeyError", "unresolved:super", "unresolved:a.b"]
    calls = spark.createDataFrame([(c, "f", "unresolved", False, 1, "", k) for k, c in enumerate(ids)], "callee_id string, caller_id string, call_type string, is_await boolean, line int, raw string, ord long")
    got = [r["category"] for r in graph.dropped_calls(calls).orderBy("ord").collect()]
    assert got == ["inherited_method", "self_attr_unknown", "string_literal_method", "builtin", "builtin", "builtin", "bare_name", "local_var_method"]


def test_code_sites(spark):
    text = "class A:\n    def __init__(self):\n        self.q = []\n        x = self.q\n    async def _reset_per_run_state(self):\n        self.q.clear()\nclass B:\n    z = self.q @ 1\ndef f():\n    self.q[a][b] **= 2\n    self.q.push(1)\n    self.q == 1\n    self.qq = 1\n"
    lines = spark.createDataFrame([("a.py", k, t) for k, t in enumerate(text.split("\n"))] + [("b.py", 0, None)], "file string, line int, text string")
    patterns = spark.createDataFrame([("r", r"self\.q\b"), ("any", "(?i)SELF.Q{2}"), ("or", "zzz|B:")], "id string, pattern string")
    got = sorted((r["id"], r["line"], r["method"], r["kind"]) for r in registers.code_sites(lines, patterns).collect())
    assert got == [
        ("any", 12, "f", "write"), ("or", 6, "?", "read"), ("r", 2, "__init__", "init"), ("r", 3, "__init__", "read"), ("r", 5, "_reset_per_run_state", "reset"),
        ("r", 7, "?", "read"), ("r", 9, "f", "write"), ("r", 10, "f", "read"), ("r", 11, "f", "read"),
    ]


def test_needles(spark, monkeypatch):
    assert [patterns.literal_of(p) for p in (r"self\._x\b", "a|bcd", "ab*cde?f", "(abc)+de", "[abc]x", r"\d{3}foo", "x+yz", "(?i)abc", r"a\Qb", "", "ab{2}cd", "[]a]b", r"lo\.g")] == ["self._x", "", "cd", "de", "x", "foo", "yz", "", "", "", "cd", "b", "lo.g"]
    rows = spark.createDataFrame([(0, "stage-12"), (1, "no"), (2, None), (3, "")], "k int, t string")
    needles = spark.createDataFrame([("stage-1",), ("stage-12",), ("age",), (None,), ("age",)], "n string")
    want = [(0, "age"), (0, "stage-1"), (0, "stage-12")]
    assert sorted((r["k"], r["n"]) for r in patterns.found_in(rows, "t", needles, "n").collect()) == want
    monkeypatch.setattr(patterns, "MOST_NEEDLES", 1)
    assert sorted((r["k"], r["n"]) for r in patterns.found_in(rows, "t", needles, "n").collect()) == want
    assert patterns.found_in(rows, "t", needles.limit(0), "n").count() == 0
    assert patterns.found_in(rows, "t", spark.createDataFrame([("",)], "n string"), "n").count() == 3


def test_deep_tree(spark):
    """A chain of 100,000 stages, a ring, and what hangs below it."""
    chain = lambda n: spark.range(n).selectExpr("concat('s', id) AS id", "IF(id = 0, NULL, concat('s', id - 1)) AS parent", "id AS ord", "'t' AS title")
    more = spark.createDataFrame([("r1", "r2", 1, "x"), ("r2", "r1", 2, "y"), ("under", "r1", 3, "z"), ("self", "self", 4, "w"), ("lost", "nowhere", 5, "v")], "id string, parent string, ord long, title string")
    d = tree.depths(chain(100_000).unionByName(more))
    assert d.where("top = 's0'").agg(F.count("*"), F.max("depth"), F.count_if(F.col("id") != F.concat(F.lit("s"), "depth"))).first() == (100_000, 99_999, 0)
    assert {r["id"]: (r["depth"], r["top"]) for r in d.where("top <> 's0'").collect()} == {x: (0, x) for x in ("r1", "r2", "under", "self", "lost")}
    n = 1000
    stages = chain(n).unionByName(more)
    counts = {r["id"]: r["n_files"] for r in tree.subtree_counts(stages, stages.select(F.col("id").alias("stage"))).collect()}
    assert all(counts[f"s{k}"] == n - k for k in range(n)) and counts["r1"] == counts["under"] == 1
    at = {r["id"]: r["position"] for r in tree.pre_order(stages).collect()}
    assert sorted(at.values()) == list(range(1, n + 6)) and all(at[f"s{k}"] == at["s0"] + k for k in range(n))
    few = chain(40).unionByName(more)
    assert tree.closure(few).count() == 40 * 41 // 2 + 5


def test_running_numbers(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS k", "id % 3 AS w").repartition(7)
    got = {r["k"]: (r["position"], r["s"]) for r in numbering.running(numbering.numbered(df, "k"), [F.col("k")], "s", F.col("w")).collect()}
    weight = {(k * 7919) % 1000: k % 3 for k in range(1000)}
    assert got == {k: (k + 1, sum(weight[j] for j in range(k))) for k in range(1000)}
    assert "SinglePartition" not in numbering.numbered(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert numbering.numbered(df.limit(0), "k").count() == 0
