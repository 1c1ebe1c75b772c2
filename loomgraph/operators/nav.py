"""Navigation queries over the graph (NV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import numbering

#: fixed values: names that hint at an entry point
HINTS = "main run serve start execute exec dispatch handle handler cmd command app loop bootstrap".split()

#: members of one list in which they are joined
PER_LIST = 1000


def first_sentence(text: Column, most: int) -> Column:
    """Up to the first full stop followed by a space, cut to `most` characters."""
    return F.substr(F.split_part(text, F.lit(". "), F.lit(1)), F.lit(1), F.lit(most))


def internal(nodes: DataFrame) -> DataFrame:
    """NV-1: written functions."""
    return nodes.where("kind = 'internal' AND NOT coalesce(synthetic, false)")


def dirname(file: Column) -> Column:
    return F.when(file.contains("/"), F.regexp_replace(file, "/[^/]*$", "")).otherwise(F.lit("."))


def file_profile(nodes: DataFrame, sample: int = 8, cut: int = 120) -> DataFrame:
    """NV-2: per file its functions, classes, and the first `sample` functions by line."""
    f = internal(nodes)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line_start", "ord"))
    first = F.when(F.col("rank") <= sample, F.struct("rank", F.concat_ws(" ", "qualname", F.substr("signature", F.lit(1), F.lit(cut))).alias("s")))
    return (
        f.withColumn("rank", rank).groupBy("file").agg(
            F.count("*").alias("n_functions"), F.sort_array(F.collect_set("class_name")).alias("classes"),
            F.transform(F.array_sort(F.collect_list(first)), lambda s: s["s"]).alias("sample"),
        )
    )


def dir_map(profile: DataFrame) -> DataFrame:
    """NV-3: files and functions per directory."""
    return profile.groupBy(dirname(F.col("file")).alias("dir")).agg(F.count("*").alias("n_files"), F.sum("n_functions").alias("n_functions"))


def entry_points(nodes: DataFrame) -> DataFrame:
    """NV-4: functions nobody calls, then those with telling names; one a qualname, most calls first.

    (qualname, file, n_callees, why, rank); why: root or name.
    """
    f = internal(nodes)
    name = F.lower("name")
    hint = F.coalesce(F.exists(F.array(*map(F.lit, HINTS)), lambda h: (name == h) | name.startswith(F.concat(h, F.lit("_")))), F.lit(False))
    root = (F.col("n_callers") == 0) & (F.col("line_start") > 0)
    picked = f.where(root | hint).withColumn("why", F.when(root, "root").otherwise("name"))
    # of one qualname the row that comes first in the order of the result stays
    best = picked.groupBy("qualname").agg(F.min_by(F.struct("file", "n_callees", "why"), F.struct(-F.col("n_callees"), F.when(F.col("why") == "root", 0).otherwise(1), "ord")).alias("b"))
    return best.select("qualname", "b.*")


def fan_out(nodes: DataFrame, k: int = 40) -> DataFrame:
    """NV-5: the k files that call most; of equals the one seen first."""
    f = internal(nodes).groupBy("file").agg(F.sum("n_callees").alias("n_callees"), F.min("ord").alias("seen"))
    return f.orderBy(F.desc("n_callees"), "seen").limit(k).select("file", "n_callees")


def external_subsystems(nodes: DataFrame, sample: int = 5) -> DataFrame:
    """NV-6: boundary nodes per module, and the least distinct names.  n_calls_into counts nodes, not calls."""
    module = F.when(F.col("module") != "", F.col("module")).otherwise(F.regexp_replace("qualname", r"\.?[^.]*$", ""))
    return (
        nodes.where("kind = 'boundary'").groupBy(module.alias("module"))
        .agg(F.count("*").alias("n_calls_into"), F.slice(F.sort_array(F.collect_set("name")), 1, sample).alias("sample"))
    )


def totals(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """NV-7: one row: functions, files, directories, boundary nodes, kept calls."""
    f = internal(nodes)
    return (
        f.agg(F.count("*").alias("n_functions"), F.countDistinct("file").alias("n_files"), F.countDistinct(dirname(F.col("file"))).alias("n_dirs"))
        .crossJoin(nodes.agg(F.count_if(F.col("kind") == "boundary").alias("n_boundary"))).crossJoin(kept.agg(F.count("*").alias("n_calls")))
    )


def all_files(profile: DataFrame, scanned: DataFrame) -> DataFrame:
    """NV-8: scanned files with their function counts; files with functions first, by name, then the rest in scan order."""
    both = scanned.join(profile.select("file", "n_functions"), "file", "full")
    placed = numbering.numbered(both, F.col("n_functions").isNull(), F.when(F.col("n_functions").isNotNull(), F.col("file")), "ord", "file")
    return placed.select("file", F.coalesce("n_functions", F.lit(0)).alias("n_functions"), "position")


def file_adjacency(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """NV-10: pairs of different files of which one calls the other."""
    f = nodes.where("kind = 'internal' AND NOT coalesce(synthetic, false)").select("id", "file")
    a, b = f.toDF("caller_id", "file_a"), f.toDF("callee_id", "file_b")
    return kept.join(a, "caller_id").join(b, "callee_id").where("file_a <> file_b").select("file_a", "file_b").distinct()


def context(nodes: DataFrame, kept: DataFrame, members: DataFrame) -> DataFrame:
    """NV-11: per function its distinct callees and callers by qualname, with the stages they are in.

    (qualname, direction, other, stages, boundary), for all functions at once.
    """
    n = nodes.select("id", "qualname", (F.col("kind") == "boundary").alias("boundary"))
    ends = kept.join(n.select(F.col("id").alias("caller_id"), F.col("qualname").alias("caller")), "caller_id").join(
        n.select(F.col("id").alias("callee_id"), F.col("qualname").alias("callee"), "boundary"), "callee_id"
    )
    out = ends.select(F.col("caller").alias("qualname"), F.lit("calls").alias("direction"), F.col("callee").alias("other"), "boundary")
    into = ends.where("NOT boundary").select(F.col("callee").alias("qualname"), F.lit("called_by").alias("direction"), F.col("caller").alias("other"), F.lit(False).alias("boundary"))
    stages = members.groupBy(F.col("qualname").alias("other")).agg(F.sort_array(F.collect_set("stage")).alias("stages"))
    pairs = out.unionByName(into).groupBy("qualname", "direction", "other").agg(F.max("boundary").alias("boundary"))
    return pairs.join(stages, "other", "left").withColumn("stages", F.coalesce("stages", F.array().cast("array<string>")))


def stage_calls(members: DataFrame, nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """NV-12: pairs of a stage's members (by ord) of which the first's function calls the second's."""
    n = nodes.select("id", "qualname")
    calls = (
        kept.join(n.toDF("caller_id", "q1"), "caller_id").join(n.toDF("callee_id", "q2"), "callee_id").select("q1", "q2").distinct()
    )
    # a function's members go together in lists of bounded length, so the joins are of functions and only their results are of members
    m = members.select("stage", "ord", "qualname").distinct()
    size = m.groupBy("stage", "qualname").agg(F.count("*").alias("n"))
    several = m.groupBy("stage", "ord").agg((F.count("*") > 1).alias("several"))  # one ord of several functions may meet another more than once
    block = F.pmod(F.xxhash64("ord"), F.floor(F.col("n") / PER_LIST) + 1)
    lists = m.join(size, ["stage", "qualname"]).join(several, ["stage", "ord"]).groupBy("stage", "qualname", "several", block.alias("block")).agg(F.collect_list("ord").alias("ords"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select("stage", F.col("qualname").alias("q1"), F.col("ords").alias("a")).join(calls, "q1")
        both = left.join(b.select("stage", F.col("qualname").alias("q2"), F.col("ords").alias("b")), ["stage", "q2"])
        return both.select("stage", "b", F.explode("a").alias("i")).select("stage", "i", F.explode("b").alias("j")).where("i <> j")

    one, more = lists.where("NOT several"), lists.where("several")
    return met(one, one).unionByName(met(more, lists).unionByName(met(one, more)).distinct())


def stage_sample(members: DataFrame, most: int = 4, cut: int = 90) -> DataFrame:
    """NV-13: up to `most` members of each stage, functions before regions, and how many more there are."""
    w = Window.partitionBy("stage").orderBy(F.when(F.col("type") == "function", 0).otherwise(1), "ord")
    m = members.withColumns({"rank": F.row_number().over(w), "line": F.concat_ws(": ", "qualname", first_sentence(F.col("purpose"), cut))})
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "line")))), lambda s: s["line"])
    return m.groupBy("stage").agg(lines.alias("lines"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def candidates(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """NV-14: functions to classify, by file and line."""
    f = internal(nodes).where("line_start > 0").orderBy("file", "line_start", "ord")
    return (f.limit(limit) if limit else f).select("qualname", "file", "line_start", "line_end")


def orientation(dirs: list, entries: list, files: list, subsystems: list) -> str:
    """NV-9: a short text of the four tables' first rows (120, 25, 25 and 30), with a line on what is left out."""
    out = []
    for title, rows, most, form in (
        ("Directories", dirs, 120, lambda r: f"{r['dir']}: {r['n_files']} files, {r['n_functions']} functions"),
        ("Entry points", entries, 25, lambda r: f"{r['qualname']} ({r['file']})"),
        ("Files that call most", files, 25, lambda r: f"{r['file']}: {r['n_callees']}"),
        ("External", subsystems, 30, lambda r: f"{r['module']}: {r['n_calls_into']}"),
    ):
        out += [f"## {title}", *(f"- {form(r)}" for r in rows[:most])]
        if len(rows) > most:
            out.append(f"- … {len(rows) - most} more")
    return "\n".join(out)
