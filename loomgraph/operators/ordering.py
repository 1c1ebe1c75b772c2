"""Ordering and grouping (OR)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kahn(files: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Topological order of files; of those ready the one with most edges out, then the least name; what is left by cycles follows in that order."""
    inside = set(files)
    out: dict[str, set[str]] = {f: set() for f in inside}
    for a, b in edges:
        if a in inside and b in inside and a != b:
            out[a].add(b)
    waits = dict.fromkeys(inside, 0)
    for targets in out.values():
        for b in targets:
            waits[b] += 1
    key = lambda f: (-len(out[f]), f)
    ready = [key(f) for f in inside if not waits[f]]
    heapq.heapify(ready)
    order = []
    while ready:
        f = heapq.heappop(ready)[1]
        order.append(f)
        for b in out[f]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, key(b))
    placed = set(order)
    return order + sorted((f for f in inside if f not in placed), key=key)


def suggest_order(file_stage: DataFrame, adjacency: DataFrame) -> DataFrame:
    """OR-1: (stage, file, position).  One stage's induced subgraph a group: a priority queue has no relational form."""
    a = file_stage.select("stage", F.col("file").alias("file_a"))
    b = file_stage.select("stage", F.col("file").alias("file_b"))
    inner = adjacency.join(a, "file_a").join(b, ["stage", "file_b"]).select("stage", F.col("file_a").alias("file"), F.col("file_b").alias("to"))
    rows = file_stage.select("stage", "file", F.lit(None).cast("string").alias("to")).unionByName(inner)

    def order(stage: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        edges = rows[rows["to"].notna()]
        found = kahn(rows["file"].unique().tolist(), list(zip(edges["file"], edges["to"], strict=True)))
        return pd.DataFrame({"stage": stage[0], "file": found, "position": range(len(found))})

    return rows.groupBy("stage").applyInPandas(order, "stage string, file string, position int")


def validate_groups(groups: DataFrame, files: DataFrame) -> DataFrame:
    """OR-2: groups (stage, g_ord, title, f_ord, file) made sound against a stage's files (stage, file, position).

    Unknown files go, a file stays where it is first, empty groups go, blank titles become
    Group, and files in no group follow in a last one, Other, in suggested order.
    """
    first = Window.partitionBy("stage", "file").orderBy("g_ord", "f_ord")
    good = groups.join(files.select("stage", "file"), ["stage", "file"], "left_semi").withColumn("r", F.row_number().over(first)).where("r = 1")
    good = good.select("stage", "g_ord", F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "Group").otherwise(F.trim("title")).alias("title"), "f_ord", "file")
    rest = files.join(good.select("stage", "file"), ["stage", "file"], "left_anti")
    return good.unionByName(rest.select("stage", F.lit(1 << 30).alias("g_ord"), F.lit("Other").alias("title"), F.col("position").alias("f_ord"), "file"))


def finalise(groups: DataFrame, cards: DataFrame) -> DataFrame:
    """OR-3: group files with purpose and role, and their place in the flat order of the stage."""
    place = F.row_number().over(Window.partitionBy("stage").orderBy("g_ord", "f_ord", "file")) - 1
    return groups.withColumn("position", place).join(cards.select("file", "purpose", "role"), "file", "left").fillna("", ["purpose", "role"])


def organised(groups: DataFrame, file_stage: DataFrame) -> DataFrame:
    """OR-4: files, and files that some group holds."""
    held = groups.select("file").distinct().withColumn("held", F.lit(1))
    return file_stage.select("file").distinct().join(held, "file", "left").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("held"), F.lit(0)).alias("n_organised"))


def permutation_check(orders: DataFrame) -> DataFrame:
    """OR-5: (key, n, order) with valid: every index 0..n-1 exactly once."""
    full = F.when(F.col("n") > 0, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return orders.withColumn("valid", F.sort_array("order") == full)


def fallback_order(members: DataFrame) -> DataFrame:
    """OR-6: place of each member: file, start, functions before regions, end."""
    w = Window.partitionBy("stage").orderBy("file", "line_start", F.when(F.col("type") == "function", 0).otherwise(1), "line_end", "ord")
    return members.withColumn("position", F.row_number().over(w) - 1)


def apply_order(members: DataFrame, order: DataFrame) -> DataFrame:
    """OR-7: members in the given places (stage, ord, position, section); those not named keep their order after them."""
    w = Window.partitionBy("stage").orderBy(F.col("given").isNull(), "given", "ord")
    o = order.select("stage", "ord", F.col("position").alias("given"), "section")
    return members.join(o, ["stage", "ord"], "left").withColumn("position", F.row_number().over(w) - 1).drop("given")


def fingerprint(members: DataFrame) -> DataFrame:
    """OR-8: per stage a hash of its members' identities, whatever their order."""
    identity = F.concat_ws("|", "qualname", "type", "line_start", "line_end")
    return members.groupBy("stage").agg(F.sha1(F.array_join(F.sort_array(F.collect_list(identity)), "\n")).alias("fingerprint"))
