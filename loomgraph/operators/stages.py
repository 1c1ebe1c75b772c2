"""Stage hierarchy upkeep: assignment (AS) and doctor (DR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nav import dirname

UNASSIGNED = "unassigned"
#: a stage is overloaded when it has more than both
OVERLOAD_LEAST, OVERLOAD_TIMES = 20, 2.5


def dir_rollup(cards: DataFrame, top: int = 3, samples: int = 4) -> DataFrame:
    """AS-1: per directory its files, roles by falling count (of equals the first seen), commonest lifecycles, longest purposes.

    cards: ord, file, purpose, role, lifecycle.
    """
    c = cards.withColumns({"dir": dirname(F.col("file")), "role": F.coalesce(F.nullif("role", F.lit("")), F.lit("other"))})

    def histogram(column: str, most: int | None) -> DataFrame:
        n = c.where(F.col(column) != "").groupBy("dir", column).agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "seen", F.col(column).alias("v"), "n")))
        pairs = F.transform(ranked if most is None else F.slice(ranked, 1, most), lambda s: F.concat_ws(":", s["v"], s["n"]))
        return n.groupBy("dir").agg(pairs.alias(f"{column}s"))

    w = Window.partitionBy("dir").orderBy(F.desc(F.length("purpose")), "ord")
    said = c.where("purpose <> ''").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= samples)
    longest = said.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "purpose"))), lambda s: s["purpose"]).alias("purposes"))
    files = c.groupBy("dir").agg(F.count("*").alias("n_files"))
    return files.join(histogram("role", None), "dir", "left").join(histogram("lifecycle", top), "dir", "left").join(longest, "dir", "left")


def normalise_stages(raw: list) -> list[dict]:
    """AS-3: stages of a reply made sound, in order: entries that are no objects go, missing ids are numbered, repeated
    ids get a number, descriptions fall back to titles, unknown parents to none, children follow the parents.

    A reply holds a few hundred stages at most; ids depend on those before, so this is a plain loop.
    """
    out: list[dict] = []
    used: set[str] = set()
    for k, s in enumerate((s for s in raw if isinstance(s, dict)), 1):
        crosscut = bool(s.get("crosscut"))
        ident = str(s.get("id") or "").strip() or f"{'crosscut' if crosscut else 'stage'}-{k}"
        base, n = ident, k
        while ident in used:
            ident, n = f"{base}-{n}", n + 1
        used.add(ident)
        title = str(s.get("title") or ident).strip()
        out.append({"ord": k - 1, "id": ident, "title": title, "description": str(s.get("description") or "").strip() or title, "parent": s.get("parent"), "crosscut": crosscut})
    for s in out:
        if s["parent"] not in used or s["parent"] == s["id"]:
            s["parent"] = None
        s["children"] = [c["id"] for c in out if c["parent"] == s["id"]]
    return out


def stage_menu(stages: DataFrame) -> DataFrame:
    """AS-6: one line a stage: title and the first sentence of its description without the full stop."""
    said = F.rtrim(F.split_part(F.coalesce("description", F.lit("")), F.lit(". "), F.lit(1)), F.lit("."))
    return stages.select("ord", "id", F.concat("title", F.lit(": "), said, F.lit(".")).alias("line"))


def coerce_assignment(replies: DataFrame, batch: DataFrame, stages: DataFrame) -> DataFrame:
    """AS-7: assignments (file, stage, also) of files in the batch; unknown stages become unassigned, unknown others go."""
    ids = stages.select(F.col("id").alias("stage"), F.lit(True).alias("known"))
    r = replies.join(batch.select("file"), "file", "left_semi").join(F.broadcast(ids), "stage", "left") if _small(stages) else replies.join(batch.select("file"), "file", "left_semi").join(ids, "stage", "left")
    also = (
        r.select("file", F.posexplode("also").alias("k", "stage")).join(ids, "stage")
        .groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "stage"))), lambda s: s["stage"]).alias("also"))
    )
    return (
        r.drop("also").join(also, "file", "left")
        .select("file", F.when(F.col("known"), F.col("stage")).otherwise(UNASSIGNED).alias("stage"), F.coalesce("also", F.array().cast("array<string>")).alias("also"))
    )


def _small(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a table has at most `most` rows; reads no more than that."""
    return len(df.select(F.lit(1)).limit(most + 1).take(most + 1)) <= most


def assign_all(files: DataFrame, assignments: DataFrame) -> DataFrame:
    """AS-8: a stage for every file, unassigned where there is none."""
    return files.select("file").join(assignments.select("file", "stage"), "file", "left").fillna(UNASSIGNED, ["stage"])


def buckets(file_stage: DataFrame) -> DataFrame:
    """AS-8: files per stage, in file order."""
    return file_stage.where(F.col("stage") != UNASSIGNED).groupBy("stage").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("file")).alias("files"))


def rebuild(file_stage: DataFrame, stages: DataFrame) -> DataFrame:
    """AS-9: the map with stages that are gone, null or unassigned as unassigned."""
    ids = stages.select(F.col("id").alias("stage"), F.lit(True).alias("known"))
    return file_stage.join(ids, "stage", "left").select("file", F.when(F.col("known"), F.col("stage")).otherwise(UNASSIGNED).alias("stage"))


def delta_merge(before: DataFrame, delta: DataFrame, stages: DataFrame) -> DataFrame:
    """AS-10: the new assignment where a file was scored again, else the old one; then made sound (AS-9)."""
    d = delta.select("file", F.col("stage").alias("new"))
    return rebuild(before.join(d, "file", "left").select("file", F.coalesce("new", "stage").alias("stage")), stages)


def stage_stats(stages: DataFrame, file_stage: DataFrame) -> DataFrame:
    """DR-1: per stage its size, directory that has most of it (of equals the first seen) with its share, and whether it is overloaded.

    file_stage: ord, file, stage.
    """
    f = file_stage.where(F.col("stage") != UNASSIGNED).withColumn("dir", dirname(F.col("file")))
    by_dir = f.groupBy("stage", "dir").agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    best = by_dir.groupBy("stage").agg(F.sum("n").alias("size"), F.count("*").alias("n_dirs"), F.max_by(F.struct("dir", "n"), F.struct("n", -F.col("seen"))).alias("b"))
    mean = best.agg(F.avg("size").alias("mean"))
    return (
        stages.select(F.col("id").alias("stage")).join(best, "stage", "left").crossJoin(F.broadcast(mean))  # one row
        .select(
            "stage", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_dirs", F.lit(0)).alias("n_dirs"), F.col("b.dir").alias("dominant_dir"),
            F.round(F.col("b.n") / F.col("size"), 6).alias("share"),
            F.coalesce(F.col("size") > F.greatest(F.lit(float(OVERLOAD_LEAST)), F.col("mean") * OVERLOAD_TIMES), F.lit(False)).alias("overloaded"),
        )
    )


def mapping_stats(members: DataFrame) -> DataFrame:
    """DR-10: per stage its members, functions, regions, and the file that has most of them (of equals the first seen)."""
    by_file = members.groupBy("stage", "file").agg(
        F.count("*").alias("n"), F.count_if(F.col("type") == "function").alias("f"), F.count_if(F.col("type") == "region").alias("r"), F.min("ord").alias("seen")
    )
    return by_file.groupBy("stage").agg(
        F.sum("n").alias("n_members"), F.sum("f").alias("n_functions"), F.sum("r").alias("n_regions"), F.count("*").alias("n_files"),
        F.max_by("file", F.struct("n", -F.col("seen"))).alias("dominant_file"), F.round(F.max("n") / F.sum("n"), 6).alias("share"),
    )


def first_error(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that a row breaks; null if it breaks none.  A null condition is not broken."""
    return F.coalesce(*(F.when(broken, F.lit(message)) for broken, message in rules), F.lit(None).cast("string"))


def validate_changes(changes: DataFrame, stages: DataFrame) -> DataFrame:
    """DR-3: changes (ord, action, stage, target, new_ids) with the first rule each breaks, or null.

    Every action needs its stage, but add, whose id must be new; merge needs another known
    target; remove and merge may not touch cross-cutting stages; split needs at least two
    new ids, each once and none in use.
    """
    s = stages.select("id", "crosscut")
    c = (
        changes.join(s.select(F.col("id").alias("stage"), F.lit(True).alias("has_stage"), F.col("crosscut").alias("protected")), "stage", "left")
        .join(s.select(F.col("id").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    )
    used = (
        changes.select("ord", F.explode("new_ids").alias("id")).join(s.select("id"), "id").groupBy("ord").agg(F.count("*").alias("n_used"))
    )
    a = F.col("action")
    missing = F.col("has_stage").isNull()
    rules = [
        (~a.isin("add_stage", "remove_stage", "merge_stages", "split_stage"), "unknown action"),
        ((a == "add_stage") & ~missing, "id in use"),
        ((a != "add_stage") & missing, "unknown stage"),
        (a.isin("remove_stage", "merge_stages") & F.col("protected"), "protected stage"),
        ((a == "merge_stages") & F.col("has_target").isNull(), "unknown target"),
        ((a == "merge_stages") & (F.col("stage") == F.col("target")), "target is the stage"),
        ((a == "split_stage") & (F.size("new_ids") < 2), "split into fewer than two"),
        ((a == "split_stage") & (F.size(F.array_distinct("new_ids")) < F.size("new_ids")), "repeated new id"),
        ((a == "split_stage") & (F.coalesce("n_used", F.lit(0)) > 0), "new id in use"),
    ]
    return c.join(used, "ord", "left").select("ord", "action", "stage", first_error(rules).alias("error"))


def normalise_shape(changes: DataFrame) -> DataFrame:
    """DR-5: JSON changes (ord, body) as columns; nested or flat, top, none, null and empty parents mean none."""
    get = lambda *paths: F.coalesce(*(F.get_json_object("body", f"$.{p}") for p in paths))
    parent = get("stage.parent", "new_stage.parent", "parent")
    return changes.select(
        "ord", get("action", "type").alias("action"), get("stage.id", "new_stage.id", "stage_id", "id").alias("stage"), get("target", "into").alias("target"),
        F.when(F.lower(F.trim(parent)).isin("", "top", "none", "null"), None).otherwise(parent).alias("parent"),
    )
