"""Interval and region operators (RG)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import first_error

THRESHOLD = 3


def _settled(start: Column, end: Column, a: Column, b: Column, none: Column, threshold: int) -> Column:
    """(start, end, status, distance) of a range whose borders would move to a and b; inverted results keep the range."""
    inverted = none | (b < a)
    distance = F.when(inverted, F.lit(0)).otherwise(F.greatest(F.abs(a - start), F.abs(b - end)))
    status = F.when(inverted | (distance > threshold), "needs_review").when(distance == 0, "ok").otherwise("snapped")
    return F.struct(
        F.when(inverted, start).otherwise(a).alias("start"), F.when(inverted, end).otherwise(b).alias("end"), status.alias("status"), distance.alias("distance")
    )


def snapped(start: Column, end: Column, spans: Column, threshold: int = THRESHOLD) -> Column:
    """RG-1 for one range and its function's statements: (start, end, status, distance).

    spans: array of (s, e).  The start goes to the least statement start at or after it
    (else the last one), the end to the greatest statement end at or before it (else the
    first statement's).  Inverted results keep the range and need review.
    """
    starts, ends = F.transform(spans, lambda x: x["s"]), F.transform(spans, lambda x: x["e"])
    a = F.coalesce(F.array_min(F.filter(starts, lambda x: x >= start)), F.array_max(starts))
    # of no end at or before the requested one, the end of the statement that comes first
    b = F.coalesce(F.array_max(F.filter(ends, lambda x: x <= end)), F.array_min(spans)["e"])
    return _settled(start, end, a, b, F.coalesce(F.size(spans), F.lit(0)) <= 0, threshold)


def snap(requests: DataFrame, statements: DataFrame, keys: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """RG-1: requests (keys, a, b, ...) snapped to the statements (keys, s, e) of the same function.

    Borders are found by running over requests and statements together in order, one sort
    for starts and one for ends, so a function's statements are not gathered for every request.
    """
    st = statements.dropna(subset=keys)
    row = F.struct(*(F.col(c) for c in requests.columns))
    kind = requests.select(row.alias("row")).schema["row"].dataType
    found = requests.select(*keys, row.alias("row"), F.lit(None).cast("int").alias("up"))
    for column, asked, border in (("s", "a", F.desc("at")), ("e", "b", F.asc("at"))):
        marks = st.select(*keys, F.col(column).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("row"), F.lit(None).cast("int").alias("up"), F.col(column).cast("int").alias("v"))
        rows = found.select(*keys, F.col(f"row.{asked}").alias("at"), F.lit(1).alias("kind"), "row", "up", F.lit(None).cast("int").alias("v"))
        w = Window.partitionBy(*keys).orderBy(border, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = marks.unionByName(rows).withColumn("near", F.last("v", ignorenulls=True).over(w)).where("kind = 1")
        found = near.select(*keys, "row", (F.col("near") if column == "s" else F.col("up")).alias("up"), F.col("near").alias("down"))
    ends = st.groupBy(*keys).agg(F.max("s").alias("last_start"), F.min(F.struct("s", "e")).alias("first"))
    r = found.join(ends, keys, "left")
    x = _settled(F.col("row.a"), F.col("row.b"), F.coalesce("up", "last_start"), F.coalesce("down", F.col("first.e")), F.col("last_start").isNull(), threshold)
    return r.select("row.*", x.alias("x")).select(*requests.columns, "x.*")


def check_lines(status: Column, first: Column, last: Column, real_first: Column, real_last: Column) -> Column:
    """RG-2: status after comparing told first and last lines with the real ones by 30 characters: both wrong needs review, one is at least snapped."""
    cut = lambda c: F.substr(F.trim(c), F.lit(1), F.lit(30))
    same = lambda a, b: F.contains(b, cut(a)) | F.contains(a, cut(b))
    bad = F.when(same(first, real_first), 0).otherwise(1) + F.when(same(last, real_last), 0).otherwise(1)
    return F.when(bad == 2, "needs_review").when((bad == 1) & (status == "ok"), "snapped").otherwise(status)


def snap_report(snapped_rows: DataFrame) -> DataFrame:
    """RG-3: counts by status."""
    return snapped_rows.groupBy("status").agg(F.count("*").alias("n"))


def multi_region(members: DataFrame) -> DataFrame:
    """RG-5: functions with at least two regions."""
    return members.where("type = 'region'").groupBy("qualname").agg(F.count("*").alias("n_regions")).where("n_regions >= 2")


def gather(members: DataFrame) -> DataFrame:
    """RG-6: regions of each function in order of their start."""
    row = F.struct("line_start", "line_end", "stage", "ord")
    return members.where("type = 'region'").groupBy("qualname").agg(F.array_sort(F.collect_list(row)).alias("regions"))


def validate_actions(actions: DataFrame, most: int = 3) -> DataFrame:
    """RG-7: actions (qualname, ord, action, refs, at, target, current, purpose, regions) with the first rule broken, or null.

    regions: the function's ranges as an array of (line_start, line_end); refs: indices, from 0.
    """
    n, a = F.size("regions"), F.col("action")
    refs = F.array_distinct("refs")
    one = F.get("regions", F.get("refs", 0))
    inside = (F.size(refs) > 0) & (F.array_min(refs) >= 0) & (F.array_max(refs) < n)
    rules = [
        (F.col("ord") >= most, "over the limit"), (a == "drop", "drop is not allowed"), (~a.isin("merge", "split", "reassign"), "unknown action"),
        (~inside, "index out of range"), ((a == "merge") & (F.size(refs) < 2), "merge needs two regions"),
        ((a == "merge") & (F.array_max(refs) - F.array_min(refs) + 1 != F.size(refs)), "regions are not consecutive"),
        ((a == "merge") & (F.trim(F.coalesce("purpose", F.lit(""))) == ""), "merge needs a purpose"),
        ((a == "split") & ~((F.col("at") >= one["line_start"]) & (F.col("at") < one["line_end"])), "split is not inside"),
        ((a == "reassign") & F.col("target").isNull(), "unknown target"), ((a == "reassign") & (F.col("target") == F.col("current")), "target is the stage"),
    ]
    return actions.withColumn("error", first_error(rules))


def conflicts(actions: DataFrame) -> DataFrame:
    """RG-8: (qualname, ord, accepted): an action that names a region killed before is rejected and kills nothing.

    A merge kills all its regions but the least, a split its own.  actions: qualname, ord,
    action, refs.  A function's actions stream through one task in order, which holds the
    regions killed so far.
    """
    rows = actions.select("qualname", F.col("ord").cast("int").alias("ord"), "action", "refs").repartition("qualname").sortWithinPartitions("qualname", "ord", "action")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dead = object(), set()
        for batch in batches:
            out = []
            for name, action, refs in zip(*(batch.column(c).to_pylist() for c in ("qualname", "action", "refs")), strict=True):
                if name != now:
                    now, dead = name, set()
                refs = set(refs or ())
                out.append(not refs & dead)
                if out[-1] and action in ("merge", "split"):
                    dead |= refs - ({min(refs)} if action == "merge" and refs else set())
            yield pa.RecordBatch.from_arrays([batch.column("qualname"), batch.column("ord"), pa.array(out, pa.bool_())], names=["qualname", "ord", "accepted"])

    return rows.mapInArrow(fold, "qualname string, ord int, accepted boolean")


def revise(regions: DataFrame, actions: DataFrame) -> DataFrame:
    """RG-9: regions (qualname, stage, line_start, line_end, purpose) after accepted actions (qualname, ord, action, refs, at, target, purpose).

    Indices are those before any action.  One function's few rows a group: each action rests on those before it.
    """
    import json

    told = actions.select("qualname", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.col("ord").cast("int").alias("ord"),
                          F.to_json(F.struct("action", "refs", "at", "target", "purpose")).alias("purpose"))
    rows = regions.select("qualname", "stage", "line_start", "line_end", F.lit(None).cast("int").alias("ord"), "purpose").unionByName(told)

    def apply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["ord"].isna()].sort_values(["line_start", "line_end", "stage", "purpose"])
        state: list[list[dict]] = [[{"stage": r.stage, "line_start": int(r.line_start), "line_end": int(r.line_end), "purpose": r.purpose}] for r in own.itertuples()]
        for r in rows[rows["ord"].notna()].sort_values("ord").itertuples():
            a = json.loads(r.purpose)
            refs = sorted(k for k in set(a["refs"]) if 0 <= k < len(state))
            held = [p for k in refs for p in state[k]]
            if not held:
                continue
            if a["action"] == "merge":
                state[refs[0]] = [{"stage": held[0]["stage"], "line_start": min(p["line_start"] for p in held), "line_end": max(p["line_end"] for p in held), "purpose": a.get("purpose") or held[0]["purpose"]}]
                for k in refs[1:]:
                    state[k] = []
            elif a["action"] == "split" and held[0]["line_start"] <= a["at"] < held[0]["line_end"]:
                p = held[0]
                state[refs[0]] = [p | {"line_end": a["at"]}, p | {"line_start": a["at"] + 1}]
            elif a["action"] == "reassign":
                state[refs[0]] = [p | {"stage": a["target"]} for p in held]
        flat = [{"qualname": key[0], **p} for s in state for p in s]
        return pd.DataFrame(flat, columns=["qualname", "stage", "line_start", "line_end", "purpose"])

    return rows.groupBy("qualname").applyInPandas(apply, "qualname string, stage string, line_start int, line_end int, purpose string")


def envelopes(members: DataFrame) -> DataFrame:
    """RG-11: from the first to the last line of each function in each stage."""
    return members.groupBy("stage", "qualname").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min_by("file", "ord").alias("file"))


def coordinate_roll(members: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """RG-12: members after their functions moved: function rows take the new span, region rows shift with its start."""
    o = old.select("qualname", F.col("line_start").alias("o_start"))
    n = new.select("qualname", F.col("line_start").alias("n_start"), F.col("line_end").alias("n_end"))
    m = members.join(o, "qualname", "left").join(n, "qualname", "left")
    moved, shift = F.col("n_start").isNotNull() & F.col("o_start").isNotNull(), F.col("n_start") - F.col("o_start")
    whole = F.col("type") == "function"
    return m.withColumns(
        {
            "line_start": F.when(moved & whole, F.col("n_start")).when(moved, F.col("line_start") + shift).otherwise(F.col("line_start")),
            "line_end": F.when(moved & whole, F.col("n_end")).when(moved, F.col("line_end") + shift).otherwise(F.col("line_end")),
        }
    ).drop("o_start", "n_start", "n_end")
