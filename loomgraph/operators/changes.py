"""Change detection and incremental upkeep (CH)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import UNASSIGNED

#: parts a report's kind is ranked in before it is ranked whole
REPORT_PARTS = 64


def file_verdicts(known: DataFrame, edited: DataFrame) -> DataFrame:
    """CH-1: (file, verdict): removed, new, unchanged or changed.

    known, edited: file, content (null in known where no pristine copy is left: changed).
    Contents are hashed before the join, so only hashes are shuffled.
    """
    k = known.select("file", F.sha1("content").alias("before"), F.lit(True).alias("k"))
    e = edited.select("file", F.sha1("content").alias("after"), F.lit(True).alias("e"))
    verdict = F.when(F.col("e").isNull(), "removed").when(F.col("k").isNull(), "new").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return k.join(e, "file", "full").select("file", verdict.alias("verdict"))


def detail(cards: DataFrame) -> DataFrame:
    """CH-2: deep if any card has a description or there is none, else brief."""
    deep = (F.count("*") == 0) | F.coalesce(F.bool_or(F.coalesce(F.col("description") != "", F.lit(False))), F.lit(False))
    return cards.agg(F.when(deep, "deep").otherwise("brief").alias("detail"))


def stale_cards(cards: DataFrame, verdicts: DataFrame) -> DataFrame:
    """CH-3: cards that stay."""
    return cards.join(verdicts.where("verdict IN ('changed', 'removed')").select("file"), "file", "left_anti")


def sync_buckets(file_stage: DataFrame, verdicts: DataFrame, placed: DataFrame) -> DataFrame:
    """CH-4: the map without removed files, with new ones where they were placed (file, stage), else unassigned."""
    kept = file_stage.select("file", "stage").join(verdicts.where("verdict = 'removed'").select("file"), "file", "left_anti")
    new = verdicts.where("verdict = 'new'").select("file").join(placed.select("file", "stage"), "file", "left").fillna(UNASSIGNED, ["stage"])
    return kept.unionByName(new)


def sync_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """CH-5: per stage whether to organise again (it gained files), prune (it only lost some), drop (it has none left) or keep."""
    b = before.where(F.col("stage") != UNASSIGNED).select("stage", "file", F.lit(1).alias("b"))
    a = after.where(F.col("stage") != UNASSIGNED).select("stage", "file", F.lit(1).alias("a"))
    n = b.join(a, ["stage", "file"], "full").groupBy("stage").agg(F.count("a").alias("left"), F.count_if(F.col("b").isNull()).alias("gained"), F.count_if(F.col("a").isNull()).alias("lost"))
    plan = F.when(F.col("left") == 0, "drop").when(F.col("gained") > 0, "reorganise").when(F.col("lost") > 0, "prune").otherwise("keep")
    return n.select("stage", plan.alias("plan"))


def function_verdicts(ledger: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """CH-7: ledger functions (qualname) as unparsable (not in the pristine text), gone, unchanged or changed, by the hash of their text."""
    o = old.select("qualname", F.sha1("text").alias("before"))
    n = new.select("qualname", F.sha1("text").alias("after"))
    verdict = F.when(F.col("before").isNull(), "unparsable").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return ledger.join(o, "qualname", "left").join(n, "qualname", "left").select("qualname", verdict.alias("verdict"))


def new_definitions(ledger: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """CH-8: functions of the edited text that neither the ledger nor the pristine text has."""
    return new.join(ledger.select("qualname"), "qualname", "left_anti").join(old.select("qualname"), "qualname", "left_anti")


def body_fingerprint(text: Column) -> Column:
    """CH-9: a hash of all below the signature line."""
    return F.sha1(F.regexp_replace(text, r"^[^\n]*\n?", ""))


def renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """CH-9: gone functions (ord, qualname, file, text) paired with new ones of the same file and body, the k-th with the k-th."""
    w = Window.partitionBy("file", "fp").orderBy("ord", "qualname")
    side = lambda df, name: df.withColumn("fp", body_fingerprint(F.col("text"))).select("file", "fp", F.col("qualname").alias(name), F.row_number().over(w).alias("k"))
    return side(gone, "old_name").join(side(new, "new_name"), ["file", "fp", "k"]).select("file", "old_name", "new_name")


def reconcile(declared: DataFrame, changed: DataFrame) -> DataFrame:
    """CH-10: (qualname, kind): missed (changed and not declared) and unplanned (declared and not changed)."""
    d, c = declared.select("qualname").distinct(), changed.select("qualname").distinct()
    return c.join(d, "qualname", "left_anti").withColumn("kind", F.lit("missed")).unionByName(d.join(c, "qualname", "left_anti").withColumn("kind", F.lit("unplanned")))


def check_declarations(declarations: DataFrame, ledger: DataFrame) -> DataFrame:
    """CH-11: declarations (kind, qualname) that can't hold: to modify or remove what is not there, to add what is."""
    has = ledger.select("qualname").distinct().withColumn("has", F.lit(True))
    d = declarations.join(has, "qualname", "left")
    return d.where("(kind IN ('will_modify', 'will_remove') AND has IS NULL) OR (kind = 'will_add' AND has)").select("kind", "qualname")


def fallback_placement(new: DataFrame, functions: DataFrame, members: DataFrame) -> DataFrame:
    """CH-13: stages for new functions (qualname, name): that of the first function whose text calls the name, else unmapped.

    The called names of every text are taken out once and joined, rather than every name searched for in every text.
    """
    called = functions.select("ord", F.col("qualname").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), 1))).alias("name"))
    stage = members.groupBy(F.col("qualname").alias("caller")).agg(F.min_by("stage", "ord").alias("stage"))
    hit = new.join(called, "name").where("caller <> qualname").join(stage, "caller").groupBy("qualname").agg(F.min_by("stage", "ord").alias("stage"))
    return new.select("qualname").join(hit, "qualname", "left").fillna("unmapped", ["stage"])


def apply_renames(members: DataFrame, renamed: DataFrame, gone: DataFrame) -> DataFrame:
    """CH-14: members under their functions' new names, without those of functions that are gone."""
    m = members.join(gone.select("qualname"), "qualname", "left_anti") if gone is not None else members
    return m.join(renamed.select(F.col("old_name").alias("qualname"), "new_name"), "qualname", "left").withColumn("qualname", F.coalesce("new_name", "qualname")).drop("new_name")


def anchor_plan(anchors: DataFrame, envelopes: DataFrame) -> DataFrame:
    """CH-15: anchors (stage, qualname, line_start, line_end) with the lines they should have: the envelope of the same stage, else the function's only one."""
    e = envelopes.select("stage", "qualname", F.col("line_start").alias("s"), F.col("line_end").alias("t"))
    only = e.groupBy("qualname").agg(F.count("*").alias("n"), F.min("s").alias("s1"), F.min("t").alias("t1")).where("n = 1").drop("n")
    a = anchors.join(e, ["stage", "qualname"], "left").join(only, "qualname", "left").withColumns({"to_start": F.coalesce("s", "s1"), "to_end": F.coalesce("t", "t1")})
    return a.where("to_start <> line_start OR to_end <> line_end").select("stage", "qualname", "line_start", "line_end", "to_start", "to_end")


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """CH-17: unified diff of two texts, a null one as empty; there is no built-in for it, so whole Arrow batches go to Python."""
    import difflib

    lines = lambda t: (t or "").split("\n")
    return pd.Series(["\n".join(difflib.unified_diff(lines(a), lines(b), "before", "after", lineterm="")) for a, b in zip(before, after, strict=True)])


def integrity(members: DataFrame, texts: DataFrame, cards: DataFrame, frozen: DataFrame) -> DataFrame:
    """CH-18: (problem, qualname): hashes that differ from the text's, entries without a card and cards without an entry, but frozen ones."""
    m = members.select("qualname", "sha1").distinct()
    bad = m.join(texts, "qualname").where(F.col("sha1") != F.sha1("text")).select(F.lit("hash").alias("problem"), "qualname")
    no_card = m.select("qualname").distinct().join(cards.select("qualname"), "qualname", "left_anti").select(F.lit("entry without card").alias("problem"), "qualname")
    no_entry = cards.select("qualname").distinct().join(m.select("qualname"), "qualname", "left_anti").select(F.lit("card without entry").alias("problem"), "qualname")
    return bad.unionByName(no_card).unionByName(no_entry).join(frozen.select("qualname"), "qualname", "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """CH-22: (file, state, diff) of files (file, content) that two snapshots of a tree have otherwise: added, deleted or modified."""
    b = before.select("file", F.col("content").alias("b"), F.lit(True).alias("in_b"))
    a = after.select("file", F.col("content").alias("a"), F.lit(True).alias("in_a"))
    d = b.join(a, "file", "full").where("in_a IS NULL OR in_b IS NULL OR NOT (a <=> b)")
    state = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "deleted").otherwise("modified")
    return d.select("file", state.alias("state"), unified_diff("b", "a").alias("diff"))


def report(ledger: DataFrame, most: int = 200) -> DataFrame:
    """CH-6: (kind, n, items): per kind of a resync ledger (kind, item) the count and the first items by name, cut as a report's list."""
    part = F.pmod(F.xxhash64("item"), F.lit(REPORT_PARTS))
    few = ledger.withColumn("rank", F.row_number().over(Window.partitionBy("kind", part).orderBy("item"))).where(F.col("rank") <= most)  # first in parts: a kind may hold the whole ledger
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("item"))).where(F.col("rank") <= most)
    items = first.groupBy("kind").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return ledger.groupBy("kind").agg(F.count("*").alias("n")).join(items, "kind", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def card_surgery(cards: DataFrame, renamed: DataFrame, gone: DataFrame, patched: DataFrame) -> DataFrame:
    """CH-16: function cards (qualname, stage, text): those of functions that are gone go, renamed ones take the new name in heading and key, patches (qualname, text) replace a text.

    A patch is taken only if it still starts with a heading that names the function.
    """
    c = cards.join(gone.select("qualname"), "qualname", "left_anti").join(renamed.select(F.col("old_name").alias("qualname"), "new_name"), "qualname", "left")
    head = lambda name: F.concat(F.lit("`"), name, F.lit("`"))
    c = c.withColumn("text", F.when(F.col("new_name").isNotNull(), F.replace("text", head(F.col("qualname")), head(F.col("new_name")))).otherwise(F.col("text")))
    c = c.withColumn("qualname", F.coalesce("new_name", "qualname")).drop("new_name")
    p = patched.where(F.col("text").startswith("#") & F.contains(F.split_part("text", F.lit("\n"), F.lit(1)), head(F.col("qualname")))).select("qualname", F.col("text").alias("patch"))
    return c.join(p, "qualname", "left").select("qualname", "stage", F.coalesce("patch", "text").alias("text"))


def resync_members(members: DataFrame, old: DataFrame, new: DataFrame, placed: DataFrame) -> dict[str, DataFrame]:
    """CH-19: members, ledger (kind, item) and rows to describe again, after a code change.

    members: stage, ord, qualname, type, file, line_start, line_end, sha1, purpose; old, new:
    functions (ord, qualname, file, name, text, line_start, line_end); placed: qualname, stage for
    functions that are new, unmapped without one.
    """
    ledger = members.select("qualname").distinct()
    verdicts = function_verdicts(ledger, old, new)
    gone = verdicts.where("verdict = 'gone'").select("qualname")
    fresh = new_definitions(ledger, old, new)
    moved = renames(old.join(gone, "qualname", "left_semi"), fresh)
    gone = gone.join(moved.select(F.col("old_name").alias("qualname")), "qualname", "left_anti")
    fresh = fresh.join(moved.select(F.col("new_name").alias("qualname")), "qualname", "left_anti")
    kept = apply_renames(members, moved, gone)
    text = new.select("qualname", F.sha1("text").alias("now"), F.col("line_start").alias("s"), F.col("line_end").alias("e"))
    whole = (F.col("type") == "function") & F.col("now").isNotNull()
    kept = kept.join(text, "qualname", "left").withColumns({"sha1": F.when(whole, F.col("now")).otherwise(F.col("sha1")), "line_start": F.when(whole, F.col("s")).otherwise(F.col("line_start")), "line_end": F.when(whole, F.col("e")).otherwise(F.col("line_end"))}).drop("now", "s", "e")
    added = (
        fresh.join(placed.select("qualname", "stage"), "qualname", "left")
        .select(F.coalesce("stage", F.lit("unmapped")).alias("stage"), F.col("ord").cast("long").alias("ord"), "qualname", F.lit("function").alias("type"), "file", "line_start", "line_end", F.sha1("text").alias("sha1"), F.lit("").alias("purpose"))
    )
    told = lambda df, kind, c="qualname": df.select(F.lit(kind).alias("kind"), F.col(c).alias("item"))
    log = told(gone, "removed").unionByName(told(fresh, "new")).unionByName(told(moved, "renamed", "new_name")).unionByName(told(verdicts.where("verdict = 'changed'"), "changed"))
    again = log.where("kind IN ('new', 'changed')").select(F.col("item").alias("qualname"))
    return {"members": kept.select(*added.columns).unionByName(added), "ledger": log, "again": again}
