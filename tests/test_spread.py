"""Source files are read by many tasks, and only for the records that are asked for."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import python_source, static_source
from loomgraph.operators import resolve
from loomgraph.operators.numbering import stored
from loomgraph.plans import drivers, source_queries


def made(spark, lang, n=400):
    part = spark.range(n).coalesce(1).withColumnRenamed("id", "p_partkey")
    return source_queries.made_files(type("Made", (), {"part": part}), lang)


def reader(lang):
    return python_source.extract if lang == "python" else static_source.extract


def tasks(records):
    return records.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.mark.parametrize("lang", ["python", "typescript"])
def test_files_of_one_partition_are_read_by_many_tasks(spark, lang):
    assert tasks(reader(lang)(made(spark, lang))) >= 8


@pytest.mark.parametrize("lang,kind", [("python", "function"), ("python", "call"), ("typescript", "function"), ("typescript", "free")])
def test_records_of_some_kinds_are_those_of_all(spark, lang, kind):
    extract, files = reader(lang), made(spark, lang, 20)
    all_, own = extract(files).where(F.col("kind") == kind).drop("ord"), extract(files, (kind,)).drop("ord")
    flat = lambda df: sorted(map(repr, df.collect()))
    assert flat(own) == flat(all_) and own.count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lang", ["python", "rust", "go", "typescript"])
def test_symbol_tables_are_not_broadcast(spark, lang):
    records = stored(reader(lang)(made(spark, lang, 60)))
    edges = resolve.resolve_python(records) if lang == "python" else resolve.resolve_forms(records, lang)
    assert "Broadcast" not in plan_of(edges) and edges.count() > 60


def test_names_of_scripts_are_not_broadcast(spark):
    calls = spark.createDataFrame([(0, "a.f", "g", 1, "g"), (1, "a.f", "ls", 2, "ls"), (2, "a.f", None, 3, None)], "ord long, caller_id string, name string, line int, raw string")
    functions = spark.createDataFrame([("a.g", "g", 0), ("b.g", "g", 1)], "id string, name string, ord long")
    edges = resolve.resolve_scripts(calls, functions)
    assert "Broadcast" not in plan_of(edges)
    assert sorted((r["ord"], r["callee_id"]) for r in edges.where("name IS NOT NULL" if "name" in edges.columns else "ord < 2").collect()) == [(0, "a.g"), (1, "boundary:ls")]


def test_the_graph_resolves_calls_once_and_broadcasts_no_code(spark):
    plan = plan_of(drivers.graph_of(made(spark, "go", 60), ["go"])["nodes"])
    assert "Broadcast" not in plan and plan.count("call_type") > 0 and "MapInArrow" not in plan and "field_type" not in plan
