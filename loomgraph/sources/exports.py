"""Sinks (SK): JSON, CSV, DOT and Markdown of the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, kept: DataFrame, path: str) -> None:
    """SK-1: nodes and edges as JSON lines in two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    kept.write.mode("overwrite").json(f"{path}/edges")


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Lines (text) as text files whose names ascend in the order: ranges are sorted apart, and no task sees all."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)


def functions_csv(functions: DataFrame, path: str) -> None:
    """SK-2: functions as CSV with a header; lists are joined by a pipe, truth values written as words."""
    flat = [F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in functions.schema]
    functions.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def dropped_json(dropped: DataFrame, path: str) -> None:
    """SK-4: dropped calls by category."""
    dropped.write.mode("overwrite").partitionBy("category").json(path)


def dot_lines(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """SK-3: lines (part, k, text) of a DOT file: functions clustered by file, awaited calls coloured, calls outside dashed."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    own = nodes.where("kind = 'internal'").select(F.lit(1).alias("part"), F.concat_ws("\t", "file", "id").alias("k"), F.concat(quote(F.col("id")), F.lit(" [group="), quote(F.coalesce("file", F.lit(""))), F.lit("];")).alias("text"))
    style = F.concat_ws(",", F.when(F.col("is_await"), "color=blue"), F.when(F.col("callee_id").startswith("boundary:"), "style=dashed"))
    edges = kept.select(F.lit(2).alias("part"), F.concat_ws("\t", "caller_id", "callee_id", "line").alias("k"), F.concat(quote(F.col("caller_id")), F.lit(" -> "), quote(F.col("callee_id")), F.lit(" ["), style, F.lit("];")).alias("text"))
    return own.unionByName(edges)


def skeleton_markdown(stages: DataFrame) -> DataFrame:
    """SK-12: a block of text a stage (ord, text): heading by depth with the id in back ticks, then the description."""
    from ..operators import tree

    p = tree.pre_order(stages).select("id", "heading", "position")
    return stages.join(p, "id").select(
        F.col("position").alias("ord"), F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "), "title", F.lit(" — `"), "id", F.lit("`\n\n"), F.coalesce("description", F.lit("")), F.lit("\n")).alias("text")
    )


def unique_slugs(headings: DataFrame) -> DataFrame:
    """SK-10: anchors of headings (doc, line, title): lower case, runs of other characters as one dash, repeats numbered."""
    from pyspark.sql import Window

    slug = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit("-"))
    k = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("line"))
    return headings.withColumn("slug", slug).withColumn("k", k).select("doc", "line", "title", F.when(F.col("k") > 1, F.concat_ws("-", "slug", F.col("k") - 1)).otherwise(F.col("slug")).alias("slug"))
