"""Joins of which no step is larger than it has to be."""

import re
from types import SimpleNamespace

from loomgraph.operators import inventory, nav, registers
from loomgraph.plans import graph_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_of_a_stage_meet_as_lists(spark, monkeypatch):
    monkeypatch.setattr(nav, "PER_LIST", 2)
    rows = [("s", 1, "a"), ("s", 2, "a"), ("s", 3, "a"), ("s", 4, "b"), ("s", 4, "c"), ("s", 5, "c"), ("s", 5, "c"), ("t", 6, "a"), ("t", 7, "b"), ("s", 8, "d")]
    calls = [("1", "2"), ("1", "3"), ("1", "1"), ("3", "2"), ("1", "2")]
    nodes = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "id string, qualname string")
    got = nav.stage_calls(spark.createDataFrame(rows, "stage string, ord long, qualname string"), nodes, spark.createDataFrame(calls, "caller_id string, callee_id string"))
    named = {"1": "a", "2": "b", "3": "c", "4": "d"}
    edges = {(named[x], named[y]) for x, y in calls}
    want = {(s, i, j) for s, i, p in rows for t, j, q in rows if s == t and i != j and (p, q) in edges}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "explode" in plan_of(got)  # members themselves are not joined


def test_a_note_is_taken_once_however_many_functions_share_its_name(spark, monkeypatch):
    functions = spark.createDataFrame([(k, f"f{k}", "q", "n") for k in range(50)], "ord long, id string, qualname string, name string")
    members = spark.createDataFrame([(1, "q", "odd"), (2, "q", "even")], "ord long, qualname string, purpose string")
    seen = []
    whole = inventory.merge_notes
    monkeypatch.setattr(inventory, "merge_notes", lambda f, notes: seen.append(notes.count()) or whole(f, notes))
    got = graph_queries.cd_annotation_merge(SimpleNamespace(members=members, functions=functions)).collect()
    assert seen == [2] and len(got) == 50 and {r["purpose"] for r in got} == {"even"}


def test_registers_meet_leaves_by_stage_and_word(spark):
    stages = spark.createDataFrame([(0, "top", None), (1, "a", "top"), (2, "b", "top")], "ord long, id string, parent string")
    regs = spark.createDataFrame([(0, "reg-desk-queue", ["top"]), (1, "reg-lamp-desk", ["top", "b"])], "ord long, id string, stages array<string>")
    concepts = spark.createDataFrame([("a", "desk"), ("a", "lamp"), ("b", "desk"), ("top", "desk"), ("a", None)], "stage string, word string")
    got = registers.sunk(regs, stages, concepts)
    assert re.search(r"Join \[(stage#\d+, word|word#\d+, stage)", plan_of(got))
    want = {("top", "reg-desk-queue", ""), ("top", "reg-lamp-desk", ""), ("b", "reg-lamp-desk", ""), ("a", "reg-desk-queue", "desk"), ("a", "reg-lamp-desk", "desk"), ("b", "reg-desk-queue", "desk")}
    assert {tuple(r) for r in got.select("stage", "id", "via").collect()} == want and got.count() == len(want)
