"""Operators on small tables whose results were worked out by hand."""

from pyspark.sql import functions as F

from loomgraph.operators import changes, gates, mapping, ordering, regions, stages, tree


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_snap(spark):
    st = spark.createDataFrame([("f", 10, 10), ("f", 12, 18), ("f", 14, 15), ("f", 20, 25)], "fn string, s int, e int")
    asked = [(10, 18), (11, 19), (5, 26), (21, 22), (1, 5)]
    rq = spark.createDataFrame([(k, "f", a, b) for k, (a, b) in enumerate(asked)] + [(9, "none", 3, 4)], "k int, fn string, a int, b int")
    got = {r["k"]: (r["start"], r["end"], r["distance"], r["status"]) for r in regions.snap(rq, st, ["fn"]).collect()}
    assert got == {
        0: (10, 18, 0, "ok"), 1: (12, 18, 1, "snapped"), 2: (10, 25, 5, "needs_review"), 3: (21, 22, 0, "needs_review"), 4: (10, 10, 9, "needs_review"), 9: (3, 4, 0, "needs_review"),
    }


def test_kahn():
    assert ordering.kahn(list("abcde"), [("a", "b"), ("b", "d"), ("b", "e")]) == list("abcde")
    assert ordering.kahn(list("abcde"), [("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("e", "d")]) == list("abcde")
    assert ordering.kahn([], []) == []


def test_suggest_order(spark):
    fs = spark.createDataFrame([("s", f) for f in "abcde"] + [("t", "z")], "stage string, file string")
    adj = spark.createDataFrame([("a", "b"), ("b", "d"), ("b", "e"), ("a", "z")], "file_a string, file_b string")
    got = sorted(rows(ordering.suggest_order(fs, adj)))
    assert got == [("s", f, k) for k, f in enumerate("abcde")] + [("t", "z", 0)]


def test_file_verdicts(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "file string, content string")
    edited = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("e", "7")], "file string, content string")
    assert dict(rows(changes.file_verdicts(known, edited))) == {"a": "unchanged", "b": "changed", "c": "removed", "d": "changed", "e": "new"}


def verdicts(spark, *cases):
    data = [(p, r, k, "critic", d, c) for p, case in enumerate(cases) for r, ds in enumerate(case, 1) for k, (d, c) in enumerate(ds)]
    return spark.createDataFrame(data, "proposal int, round int, role_ord int, role string, decision string, concerns array<string>")


def test_gates(spark):
    ok, no, more, vague, broken = ("APPROVE", []), ("REJECT", ["x"]), ("REVISE", ["x"]), ("REVISE", []), (None, [])
    single = verdicts(spark, [[ok]], [[no]], [[vague]], [[more], [more]], [[more], [no]], [[broken]])
    assert [o for _, o in sorted(rows(gates.gate_single(single)))] == ["accept 1", "discard", "accept 1", "accept 2", "discard", "discard"]
    multi = verdicts(spark, [[ok, ok]], [[ok, no], [ok, more]], [[ok, no], [no, ok]], [[ok, vague]], [[more, ok], [more, ok]], [[broken, ok], [ok, ok]], [[no, ok]])
    assert [o for _, o in sorted(rows(gates.gate_multi(multi)))] == ["accept 1", "accept 2", "discard", "accept 1", "accept 2", "accept 2", "discard"]


def test_rubric(spark):
    names = ["g1", "g2", "g3", "s1", "s2", "s3"]
    rubric = spark.createDataFrame([(n, "gate" if n[0] == "g" else "soft", w, 3) for n, w in zip(names, (0.18, 0.22, 0.25, 0.15, 0.1, 0.1), strict=True)], "criterion string, kind string, weight double, floor int")
    cases = [[4] * 6, [5, 5, 2, 5, 5, 5], [5, 5, None, 5, 5, 5], [9, 5, 5, 5, 5, 5]]
    scores = spark.createDataFrame([(u, n, str(s)) for u, c in enumerate(cases) for n, s in zip(names, c, strict=True) if s is not None], "unit int, criterion string, score string")
    assert sorted((u, o, p) for u, o, _, p in rows(gates.weighted_verdict(rubric, scores))) == [(0, 4.0, True), (1, 4.25, False), (2, 4.0, False), (3, 5.0, True)]


def test_best_of_n(spark):
    r = spark.createDataFrame([("u", 1, 3.0, False), ("u", 2, 3.6, False), ("u", 3, 3.62, False), ("v", 1, 4.2, True), ("v", 2, 5.0, True)], "unit string, round int, overall double, passed boolean")
    assert sorted(rows(gates.best_of_n(r))) == [("u", 3, 3), ("v", 1, 1)]


M = "stage string, ord long, qualname string, type string, file string, line_start int, line_end int, purpose string"


def test_dedup_and_queue(spark):
    m = spark.createDataFrame([("s1", 0, "f", "function", "x", 1, 2, ""), ("s1", 1, "f", "region", "x", 1, 1, ""), ("s1", 2, "g", "function", "x", 1, 2, ""), ("s2", 3, "f", "function", "x", 1, 2, "")], M)
    assert sorted(r["ord"] for r in mapping.dedup(m).collect()) == [1, 2, 3]
    nodes = spark.createDataFrame([(q, "internal", False) for q in "abc"], "qualname string, kind string, synthetic boolean")
    queue = spark.createDataFrame([(k, q) for k, q in enumerate("abaz")], "ord long, qualname string")
    missing = spark.createDataFrame([("c", "missing_llm_output")], "qualname string, reason string")
    assert [q for q, _, _ in sorted(rows(mapping.clean_queue(queue, nodes, missing)), key=lambda r: r[2])] == ["a", "b", "c"]


def test_state_hash_ignores_order(spark):
    s = spark.createDataFrame([("stage-1",), ("stage-2",)], "id string")
    m = spark.createDataFrame([("s", k, f"q{k}", "function", "x", k, k + 1, "") for k in range(20)], M)
    assert rows(mapping.state_hash(s, m)) == rows(mapping.state_hash(s.orderBy(F.desc("id")), m.orderBy(F.rand(1)).repartition(3)))
    assert rows(mapping.state_hash(s, m)) != rows(mapping.state_hash(s, m.where("ord > 0")))


def test_groups(spark):
    files = spark.createDataFrame([("s", f, k) for k, f in enumerate("abc")], "stage string, file string, position int")
    g = spark.createDataFrame([("s", 0, "G1", 0, "a"), ("s", 0, "G1", 1, "a"), ("s", 0, "G1", 2, "x"), ("s", 1, " ", 0, "a"), ("s", 1, " ", 1, "b")], "stage string, g_ord int, title string, f_ord int, file string")
    got = sorted((r["title"], r["file"]) for r in ordering.validate_groups(g, files).collect())
    assert got == [("G1", "a"), ("Group", "b"), ("Other", "c")]


def test_conflicts_and_revision(spark):
    a = [("q", 0, "merge", [0, 1], None, None), ("q", 1, "reassign", [1], None, "s2"), ("q", 2, "split", [0], 12, None), ("q", 3, "reassign", [0], None, "s2")]
    actions = spark.createDataFrame([(*x, "p") for x in a], "qualname string, ord int, action string, refs array<int>, at int, target string, purpose string")
    ok = {o: v for _, o, v in rows(regions.conflicts(actions))}
    assert ok == {0: True, 1: False, 2: True, 3: False}
    r = spark.createDataFrame([("q", "s1", 10, 14, "a"), ("q", "s1", 15, 20, "b"), ("q", "s1", 30, 31, "c")], "qualname string, stage string, line_start int, line_end int, purpose string")
    got = sorted((x["line_start"], x["line_end"], x["stage"]) for x in regions.revise(r, actions.where("ord IN (0, 2)")).collect())
    assert got == [(10, 12, "s1"), (13, 20, "s1"), (30, 31, "s1")]


def test_stage_stats(spark):
    s = spark.createDataFrame([(k, f"s{k}", "", "", None, False) for k in range(4)], "ord long, id string, title string, description string, parent string, crosscut boolean")
    fs = spark.createDataFrame([(k, f"d/{k}", "s0") for k in range(60)] + [(100 + k, f"e/{k}", "s1") for k in range(10)] + [(200 + k, f"f/{k}", "s2") for k in range(5)], "ord long, file string, stage string")
    got = {r["stage"]: (r["size"], r["overloaded"]) for r in stages.stage_stats(s, fs).collect()}
    assert got == {"s0": (60, False), "s1": (10, False), "s2": (5, False), "s3": (0, False)}


def test_normalise_stages():
    got = stages.normalise_stages([{"id": "a", "title": "A"}, "junk", {"title": "B", "parent": "a"}, {"id": "a", "title": "C", "parent": "gone"}])
    assert [(s["id"], s["parent"], s["children"]) for s in got] == [("a", None, ["stage-2"]), ("stage-2", "a", []), ("a-3", None, [])]


def test_tree(spark):
    s = spark.createDataFrame([(0, "stage-1", "A", "", None, False), (1, "stage-1.1", "B", "", "stage-1", False), (2, "stage-2", "C", "", None, False), (3, "crosscut-x", "X", "", None, True), (4, "stage-1.2", "D", "", "stage-1", False)], "ord long, id string, title string, description string, parent string, crosscut boolean")
    assert dict(rows(tree.chapter_numbers(s))) == {"stage-1": "1", "stage-1.1": "1.1", "stage-1.2": "1.2", "stage-2": "2"}
    assert [i for i, _ in sorted(rows(tree.render_order(s)), key=lambda r: r[1])] == ["stage-1", "stage-1.1", "stage-1.2", "stage-2", "crosscut-x"]
    g = spark.createDataFrame([("w", "stage-1"), ("w", "stage-1.1"), ("v", "stage-1.1"), ("v", "stage-2")], "key string, id string")
    assert {r["key"]: r["chain"] for r in tree.chain_test(g, s).collect()} == {"w": True, "v": False}


def test_renames_and_diff(spark):
    old = spark.createDataFrame([(0, "a", "f", "def a():\n  x"), (1, "b", "f", "def b():\n  x"), (2, "c", "f", "def c():\n  y")], "ord long, qualname string, file string, text string")
    new = spark.createDataFrame([(0, "n", "f", "def n():\n  x"), (1, "m", "g", "def m():\n  y")], "ord long, qualname string, file string, text string")
    assert rows(changes.renames(old, new)) == [("f", "a", "n")]
    d = spark.createDataFrame([("a\nb", "a\nc"), (None, None)], "x string, y string").select(changes.unified_diff("x", "y")).collect()
    assert "-b" in d[0][0] and "+c" in d[0][0] and d[1][0] == ""
