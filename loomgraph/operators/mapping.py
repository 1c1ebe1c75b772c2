"""Function-level mapping (MP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import numbering
from .nav import internal

IDENTITY = ["qualname", "type", "line_start", "line_end"]


def apply_classification(members: DataFrame, proposals: DataFrame, stages: DataFrame) -> DataFrame:
    """MP-1: old members of a classified function give way to its proposed rows (ord, stage, qualname, type, file, lines, purpose).

    Unknown stages and inverted ranges are dropped, a stage counts once a function, and a
    proposal that yields nothing changes nothing.
    """
    good = proposals.join(stages.select(F.col("id").alias("stage")), "stage", "left_semi").where("line_end >= line_start")
    once = Window.partitionBy("stage", *IDENTITY).orderBy("ord")
    good = good.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    return members.join(good.select("qualname").distinct(), "qualname", "left_anti").unionByName(good, True)


def reassign(members: DataFrame, moves: DataFrame) -> DataFrame:
    """MP-2: members of (qualname, source) go to target; where the target has the member already, one stays."""
    m = members.join(moves.select("qualname", F.col("source").alias("stage"), "target"), ["qualname", "stage"], "left")
    m = m.withColumn("stage", F.coalesce("target", "stage")).drop("target")
    first = Window.partitionBy("stage", *IDENTITY).orderBy("ord")
    return m.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def dedup(members: DataFrame) -> DataFrame:
    """MP-5: without function rows whose stage has a region of the same function."""
    regions = members.where("type = 'region'").select("stage", "qualname").distinct().withColumn("has", F.lit(True))
    return members.join(regions, ["stage", "qualname"], "left").where("type <> 'function' OR has IS NULL").drop("has")


def derive_crosscuts(stages: DataFrame, members: DataFrame, nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """MP-6: per stage the cross-cutting stages whose functions its members call; none for those themselves."""
    q = nodes.select("id", "qualname")
    calls = kept.join(q.toDF("caller_id", "q1"), "caller_id").join(q.toDF("callee_id", "q2"), "callee_id").select("q1", "q2").distinct()
    cross = stages.where("id LIKE 'crosscut-%'").select(F.col("id").alias("stage"))
    m = members.select("stage", "qualname").distinct()
    owner = m.join(cross, "stage", "left_semi").toDF("crosscut", "q2")
    uses = m.join(cross, "stage", "left_anti").toDF("stage", "q1").join(calls, "q1").join(owner, "q2").groupBy("stage").agg(F.sort_array(F.collect_set("crosscut")).alias("uses"))
    return stages.select(F.col("id").alias("stage")).join(uses, "stage", "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<string>")))


def derive_subsystems(members: DataFrame, nodes: DataFrame, kept: DataFrame, markers: DataFrame) -> DataFrame:
    """MP-6: per stage the subsystems (marker, subsystem) whose marker is in the id of a boundary node its members call.

    Ids and markers meet on the markers' first characters, as many as the shortest one has,
    and are then compared whole.  A blank marker stands for nothing.
    """
    q = nodes.where("kind = 'internal'").select(F.col("id").alias("caller_id"), "qualname")
    targets = kept.where("callee_id LIKE 'boundary:%'").select("callee_id").distinct()
    marks = markers.where("length(marker) > 0")
    n = marks.agg(F.coalesce(F.min(F.length("marker")), F.lit(1))).first()[0]
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("callee_id") - (n - 1), F.lit(1))), lambda k: F.substr("callee_id", k, F.lit(n)))
    parts = targets.select("callee_id", F.explode(F.array_distinct(starts)).alias("head"))
    named = parts.join(marks.withColumn("head", F.substr("marker", F.lit(1), F.lit(n))), "head").where(F.instr(F.col("callee_id"), F.col("marker")) > 0).select("callee_id", "subsystem").distinct()
    calls = kept.join(q, "caller_id").select("qualname", "callee_id").distinct()
    return (
        members.select("stage", "qualname").distinct().join(calls, "qualname").join(named, "callee_id")
        .groupBy("stage").agg(F.sort_array(F.collect_set("subsystem")).alias("subsystems"))
    )


def unmapped(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """MP-7: functions without a member, and why; those without text always count."""
    have = members.select("qualname").distinct().withColumn("mapped", F.lit(True))
    n = nodes.where("kind = 'internal'").join(have, "qualname", "left")
    made = F.coalesce("synthetic", F.lit(False))
    reason = (
        F.when(made, "synthetic_dataclass")
        .when(~F.col("name").startswith("_") & (F.col("line_end") - F.col("line_start") <= 5), "api_surface")
        .when(F.col("n_callers") == 0, "dead").otherwise("missing_llm_output")
    )
    return n.where(made | F.col("mapped").isNull()).select("qualname", "file", "id", reason.alias("reason"))


def state_hash(stages: DataFrame, members: DataFrame) -> DataFrame:
    """MP-8: one hash of all stage ids and member identities, whatever their order.

    Rows are hashed first and combined by sums, so nothing is collected.
    """
    ids = stages.select(F.concat_ws("|", F.lit("s"), "id").alias("k"))
    rows = members.select(F.concat_ws("|", F.lit("m"), "stage", *IDENTITY).alias("k"))
    all_rows = ids.unionByName(rows)
    half = lambda a: F.sum(F.conv(F.substr(F.sha1("k"), F.lit(a), F.lit(12)), 16, 10).cast("decimal(38,0)"))
    return all_rows.agg(F.sha1(F.concat_ws("|", F.count("*"), half(1), half(13))).alias("state"))


def clean_queue(queue: DataFrame, nodes: DataFrame, missing: DataFrame) -> DataFrame:
    """MP-9: the work queue (ord, qualname) once each and known, then unmapped functions without output."""
    known = internal(nodes).select("qualname").distinct()
    asked = queue.groupBy("qualname").agg(F.min("ord").alias("ord")).join(known, "qualname", "left_semi").withColumn("again", F.lit(0))
    more = missing.where("reason = 'missing_llm_output'").select("qualname").distinct().join(asked.select("qualname"), "qualname", "left_anti")
    both = asked.unionByName(more.select("qualname", F.lit(None).cast("long").alias("ord"), F.lit(1).alias("again")), True)
    return numbering.numbered(both, "again", "ord", "qualname").select("qualname", "again", "position")


def carry_over(invalidated: DataFrame, processed: DataFrame, failed: DataFrame) -> DataFrame:
    """MP-10: what stays to be done: invalidated and not processed, and what failed."""
    return invalidated.select("qualname").join(processed.select("qualname"), "qualname", "left_anti").unionByName(failed.select("qualname")).distinct()


def auditable(members: DataFrame, stages: DataFrame) -> DataFrame:
    """MP-13: function rows whose function has no region, in plain stages that keep at least two."""
    regions = members.where("type = 'region'").select("qualname").distinct()
    plain = stages.where("NOT crosscut").select(F.col("id").alias("stage"))
    m = members.where("type = 'function'").join(regions, "qualname", "left_anti").join(plain, "stage", "left_semi")
    return m.withColumn("n", F.count("*").over(Window.partitionBy("stage"))).where("n >= 2").drop("n")


def validate_moves(moves: DataFrame, members: DataFrame, stages: DataFrame, most: int = 3) -> DataFrame:
    """MP-14: proposed moves (audited, ord, qualname, source, target) with the first rule broken, or null; at most `most` good ones a stage."""
    from .stages import first_error

    s = stages.select(F.col("id").alias("target"), F.col("crosscut").alias("to_crosscut"), F.lit(True).alias("has_target"))
    m = members.select(F.col("stage").alias("source"), "qualname", F.lit(True).alias("is_member")).distinct()
    regions = members.where("type = 'region'").select("qualname", F.lit(True).alias("has_region")).distinct()
    c = moves.join(s, "target", "left").join(m, ["source", "qualname"], "left").join(regions, "qualname", "left")
    error = first_error(
        [
            (F.col("source") != F.col("audited"), "source is not the audited stage"), (F.col("target") == F.col("source"), "target is the source"),
            (F.col("has_target").isNull(), "unknown target"), (F.col("is_member").isNull(), "not a member"),
            (F.col("to_crosscut"), "target is cross-cutting"), (F.col("has_region"), "function has regions"),
        ]
    )
    c = c.withColumn("error", error)
    rank = F.row_number().over(Window.partitionBy("audited", F.col("error").isNull()).orderBy("ord"))
    c = c.withColumn("error", F.when(F.col("error").isNull() & (rank > most), "over the limit").otherwise(F.col("error")))
    return c.select("audited", "ord", "qualname", "source", "target", "error")


def initial_mapping(stages: DataFrame) -> DataFrame:
    """MP-16: every stage with no member."""
    return stages.select(F.col("id").alias("stage"), F.lit(0).alias("n_members"))


def stage_sizes(stages: DataFrame, members: DataFrame) -> DataFrame:
    """MP-17: every stage with the number of its members."""
    n = members.groupBy("stage").agg(F.count("*").alias("n_members"))
    return stages.select("ord", F.col("id").alias("stage"), "title").join(n, "stage", "left").fillna(0, ["n_members"])


def remove_members(members: DataFrame, removed: DataFrame) -> DataFrame:
    """MP-18: without members that match (qualname, type or null, line_start or null, line_end or null)."""
    r = removed.toDF(*(f"x_{c}" for c in removed.columns))
    same = F.col("qualname") == F.col("x_qualname")
    for c in ("type", "line_start", "line_end"):
        same = same & (F.col(f"x_{c}").isNull() | (F.col(c) == F.col(f"x_{c}")))
    return members.join(r, same, "left_anti")


def outlier_moves(outliers: DataFrame, members: DataFrame, stages: DataFrame) -> DataFrame:
    """MP-4: members after moves of outliers (qualname, source, target) to known stages other than their own; of several moves of one member the least target counts."""
    good = outliers.where("source <> target").join(stages.select(F.col("id").alias("target")), "target", "left_semi")
    return reassign(members, good.groupBy("qualname", "source").agg(F.min("target").alias("target")))


def audit_due(members: DataFrame, cache: DataFrame) -> DataFrame:
    """MP-15: (stage, fingerprint) of stages whose members or purposes are not as the cache (stage, fingerprint) has them."""
    identity = F.concat_ws("|", "qualname", "type", "line_start", "line_end", F.coalesce("purpose", F.lit("")))
    # rows are hashed and summed, so no stage is collected
    half = lambda a: F.sum(F.conv(F.substr(F.sha1(identity), F.lit(a), F.lit(12)), 16, 10).cast("decimal(38,0)"))
    now = members.groupBy("stage").agg(F.sha1(F.concat_ws("|", F.count("*"), half(1), half(13))).alias("fingerprint"))
    return now.join(cache.select("stage", "fingerprint"), ["stage", "fingerprint"], "left_anti")
