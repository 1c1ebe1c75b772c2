"""Static resolution, sequential changes, the file-level resync and Markdown helpers."""

from loomgraph.plans import doctor, stage_queries, surrogate, upkeep_queries
from loomgraph.sources import markdown

def test_sequential_changes():
    tree = [{"id": "a", "title": "A"}, {"id": "b", "title": "B", "parent": "a"}, {"id": "c", "title": "C"}, {"id": "x", "title": "X", "crosscut": True}]
    proposed = [
        {"action": "merge_stages", "stage": "a", "target": "c"}, {"action": "remove_stage", "stage": "a"}, {"action": "remove_stage", "stage": "x"}, {"action": "add_stage", "stage": "a", "title": "again", "parent": "c"},
        {"action": "split_stage", "stage": "c", "new_ids": ["d", "e"]}, {"action": "split_stage", "stage": "b", "new_ids": ["d", "f"]}, {"action": "paint", "stage": "a"},
    ]
    after, affected, errors = doctor.apply_all(proposed, tree)
    assert errors == [None, "unknown stage", "protected stage", None, None, "new id in use", "unknown action"]
    assert {s["id"]: s["parent"] for s in after} == {"b": "c", "c": None, "x": None, "a": "c", "d": "c", "e": "c"} and affected == {"a", "c"}


def test_resync(spark):
    files = lambda d: spark.createDataFrame(list(d.items()), "file string, content string")
    cards = spark.createDataFrame([(f, f"old {f}", "util", "", "") for f in "abc"], "file string, purpose string, role string, lifecycle string, description string")
    fs = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "file string, stage string")
    st = spark.createDataFrame([("s1",), ("s2",)], "id string")
    annotate = lambda asked: asked.selectExpr("file", "concat('new ', file) AS purpose", "'util' AS role", "'' AS lifecycle", "'' AS description")
    place = lambda new: new.selectExpr("file", "'s2' AS stage")
    out = doctor.resync(files({"a": "1", "b": "2", "c": "3"}), files({"a": "1", "b": "9", "d": "4"}), cards, fs, st, annotate, place)
    assert {r["file"]: r["purpose"] for r in out["cards"].collect()} == {"a": "old a", "b": "new b", "d": "new d"}
    assert {r["file"]: r["stage"] for r in out["file_stage"].collect()} == {"a": "s1", "b": "s1", "d": "s2"}
    assert {r["stage"]: r["plan"] for r in out["plan"].collect()} == {"s1": "keep", "s2": "reorganise"}
    same = doctor.resync(files({"a": "1"}), files({"a": "1"}), cards, fs, st, annotate, place)
    assert same["cards"] is cards


def test_markdown_helpers(spark):
    docs = spark.createDataFrame([("d", "## One\ntext\n```\n## no\n```\n### 1 Sub\nmore\n### `A.run`\n")], "doc string, text string")
    assert [(r["title"], r["text"]) for r in markdown.chapters(docs).orderBy("line").collect()][0] == ("One", "text\n```\n## no\n```")
    assert [tuple(r) for r in markdown.function_headings(docs).collect()] == [("d", 8, "A.run", "run")]
    t = spark.createDataFrame([("## Opening Explanation\n\nFirst one. Second two.\n\nno",)], "t string")
    assert [r[0] for r in t.select(markdown.blurb(t.t), markdown.blurb(t.t, 14)).collect()] == ["First one. Second two."]
    assert t.select(markdown.blurb(t.t, 14)).first()[0] == "First one."
    old, new = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, id string"), spark.createDataFrame([("c", "a"), ("z", None), ("b", "a")], "id string, after string")
    assert [r["id"] for r in markdown.rebuilt_index(old, new).orderBy("position").collect()] == ["a", "c", "b", "z"]
    lines = spark.createDataFrame([("f.rs", 3, "macro_rules! my_mac {"), ("f.rs", 4, "fn x()")], "file string, line int, text string")
    assert [tuple(r) for r in markdown.macros(lines).collect()] == [("f.rs", 3, "my_mac")]


def test_views_cover_their_tables(spark):
    """Rows with large keys, late turns and any event id reach the views and the queries over them."""
    r = surrogate.Relations(spark, "")
    ids = spark.range(0, 100_000, 2500).withColumnRenamed("id", "k")
    r.made["nation"] = spark.range(25).selectExpr("id AS n_nationkey", "id % 5 AS n_regionkey", "concat('N', id) AS n_name")
    r.made["region"] = spark.range(5).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name")
    r.made["customer"] = spark.range(10).selectExpr("id AS c_custkey", "id AS c_nationkey", "'A' AS c_mktsegment")
    r.made["functions"] = spark.createDataFrame([(0, "q", "f", 1, 9)], "ord long, qualname string, file string, line_start int, line_end int")
    r.made["orders"] = ids.selectExpr("k AS o_orderkey", "0L AS o_custkey", "'F' AS o_orderstatus")
    r.made["lineitem"] = ids.selectExpr("k AS l_orderkey", "1 AS l_linenumber", "k AS l_partkey", "k AS l_suppkey")
    r.made["events"] = ids.selectExpr("k + k / 2500 AS event_id", "k AS user_id").selectExpr("cast(event_id AS long) AS event_id", "user_id")
    r.made["conversations"] = spark.range(40).selectExpr("1L AS conv_id", "cast(id AS int) AS turn", "'user' AS role", "'x' AS text")
    for view in ("members", "scores", "spans", "requests", "verdicts"):
        assert getattr(r, view).count() == 40, view
    assert stage_queries.dr_validate(r).count() == stage_queries.rg_conflicts(r).count() == 40
    code = spark.sql(upkeep_queries.CODE, orders=r.orders)
    assert code.count() == 40
