"""The graph G0: five functions in three files and twelve calls, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import graph, inventory, nav


def fn(ord_, id_, name, qualname, file, a, b, cls=None, reads=(), writes=()):
    return (ord_, id_, name, qualname, file, a, b, f"def {name}()", False, bool(cls), cls, [], "internal", False, list(reads), list(writes), {})


FUNCTIONS = [
    fn(0, "app/main.main", "main", "main", "app/main.py", 1, 10),
    fn(1, "app/main.Runner.run", "run", "Runner.run", "app/main.py", 12, 20, "Runner", ["cfg"], ["state"]),
    fn(2, "app/main.Runner._step", "_step", "Runner._step", "app/main.py", 22, 30, "Runner", ["state"]),
    fn(3, "lib/util.load", "load", "load", "lib/util.py", 1, 8),
    fn(4, "lib/util.Cfg.get", "get", "Cfg.get", "lib/util.py", 10, 14, "Cfg"),
]
CALLS = [
    ("app/main.main", "app/main.Runner.__init__", "internal_constructor", 3), ("app/main.main", "unresolved:r.run", "unresolved", 4), ("app/main.Runner.run", "app/main.Runner._step", "self_method", 14),
    ("app/main.Runner.run", "app/main.Runner._step", "self_method", 15), ("app/main.Runner.run", "lib/util.Cfg.get", "self_attr_method", 16), ("app/main.Runner._step", "boundary:requests.Session.get", "boundary", 24),
    ("app/main.Runner._step", "unresolved:len", "unresolved", 25), ("app/main.main", "lib/util.load", "internal_func", 5), ("lib/util.load", "boundary:json.loads", "boundary", 4),
    ("lib/util.load", "unresolved:self.logger.info", "unresolved", 5), ("lib/util.Cfg.get", "lib/util.Cfg.refresh", "self_attr_method", 12), ("app/main.Runner.run", "unresolved:'x'.join", "unresolved", 17),
]


@pytest.fixture(scope="module")
def g(spark):
    functions = spark.createDataFrame(FUNCTIONS, schemas.FUNCTIONS)
    calls = spark.createDataFrame([(k, a, b, False, t, line, "") for k, (a, b, t, line) in enumerate(CALLS)], schemas.CALLS)
    kept = graph.kept_calls(calls)
    return functions, calls, kept, graph.nodes(functions, kept).cache()


def test_partition_and_categories(g):
    functions, calls, kept, _ = g
    assert kept.count() == 8
    assert {r["callee_raw"]: r["category"] for r in graph.dropped_calls(calls).collect()} == {
        "r.run": "local_var_method", "len": "builtin", "self.logger.info": "inherited_method", "'x'.join": "string_literal_method",
    }


def test_degrees_and_nodes(g):
    _, _, kept, nodes = g
    rows = {r["id"]: r for r in nodes.collect()}
    assert len(rows) == 8 and "lib/util.Cfg.refresh" not in rows
    assert [rows[f"app/main.{n}"]["n_callees"] for n in ("main", "Runner.run", "Runner._step")] == [2, 3, 1]
    assert rows["app/main.Runner._step"]["n_callers"] == 2
    assert sum(r["n_callees"] for r in graph.degrees(kept).collect()) == 8
    init = rows["app/main.Runner.__init__"]
    assert (init["qualname"], init["file"], init["line_start"], init["synthetic"]) == ("Runner.__init__", "app/main.py", 0, True)
    outside = rows["boundary:requests.Session.get"]
    assert (outside["module"], outside["class_name"], outside["name"]) == ("requests", "Session", "get")
    assert (rows["boundary:json.loads"]["module"], rows["boundary:json.loads"]["class_name"]) == ("json", "")


def test_missing_and_state(g):
    functions, _, kept, _ = g
    assert sorted(r["id"] for r in graph.missing_endpoints(functions, kept).collect()) == ["app/main.Runner.__init__", "boundary:json.loads", "boundary:requests.Session.get", "lib/util.Cfg.refresh"]
    x = {(r["class_name"], r["attr"]): (r["read_in"], r["written_in"]) for r in graph.state_xref(functions).collect()}
    assert x == {("Runner", "cfg"): (["app/main.Runner.run"], []), ("Runner", "state"): (["app/main.Runner._step"], ["app/main.Runner.run"])}


def test_navigation(g):
    _, _, kept, nodes = g
    profile = nav.file_profile(nodes)
    assert {r["dir"]: (r["n_files"], r["n_functions"]) for r in nav.dir_map(profile).collect()} == {"app": (1, 3), "lib": (1, 2)}
    entries = nav.entry_points(nodes).orderBy(F.desc("n_callees"), "qualname").collect()
    assert [(r["qualname"], r["n_callees"], r["why"]) for r in entries] == [("Runner.run", 3, "root"), ("main", 2, "root")]
    assert [tuple(r) for r in nav.fan_out(nodes).collect()] == [("app/main.py", 6), ("lib/util.py", 2)]
    assert sorted((r["module"], r["n_calls_into"]) for r in nav.external_subsystems(nodes).collect()) == [("json", 1), ("requests", 1)]
    assert [tuple(r) for r in nav.file_adjacency(nodes, kept).collect()] == [("app/main.py", "lib/util.py")]


def test_inventory(g):
    _, _, kept, nodes = g
    rows = {r["qualname"]: r for r in inventory.inventory(nodes, kept).collect()}
    assert (rows["Runner.run"]["calls"], rows["Runner.run"]["n_calls"]) == (["Cfg.get", "Runner._step"], 2)
    assert (rows["main"]["calls"], rows["main"]["ext_calls"]) == (["load"], ["Runner.__init__"])
    assert rows["Cfg.get"]["ext_calls"] == ["lib/util.Cfg.refresh"]
    assert rows["Cfg.get"]["called_by"] == ["Runner.run"]


def test_empty_graph(spark):
    functions, calls = spark.createDataFrame([], schemas.FUNCTIONS), spark.createDataFrame([], schemas.CALLS)
    nodes = graph.nodes(functions, graph.kept_calls(calls))
    assert nodes.count() == nav.entry_points(nodes).count() == inventory.inventory(nodes, calls).count() == 0
