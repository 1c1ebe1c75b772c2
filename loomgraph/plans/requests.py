"""Requests to an external writer (LM-11 and the evidence of AS, DR, MP, OR, QS, RG): one row a request, its text and its key.

Texts are expressions over relations, so all requests of a step are made at once; the
key hashes all that an answer depends on, and replies are joined on it (`annotate`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import nav, stages, tree
from .annotate import request_key

#: fixed values: criteria of the three tiers (tier, criterion, kind, weight, floor), of which only gates heed the floor: QS-2
RUBRICS = (
    (1, "purpose_clarity", "gate", 0.25, 3), (1, "what_it_does", "gate", 0.20, 3), (1, "novice_accessibility", "gate", 0.20, 3), (1, "shape_fidelity", "soft", 0.20, 3), (1, "scannability_style", "soft", 0.15, 3),
    (2, "stage_role", "gate", 0.18, 3), (2, "control_flow", "gate", 0.22, 3), (2, "data_flow_validity", "gate", 0.25, 3), (2, "explains_why", "soft", 0.15, 3), (2, "adjacency", "soft", 0.10, 3), (2, "right_altitude_style", "soft", 0.10, 3),
    (3, "accuracy", "gate", 0.25, 3), (3, "io_params_precision", "gate", 0.25, 3), (3, "register_accuracy", "gate", 0.15, 3), (3, "code_detail_fidelity", "soft", 0.15, 3), (3, "non_obvious_surfaced", "soft", 0.12, 3), (3, "section_purity_style", "soft", 0.08, 3),
)


def rubrics(spark) -> DataFrame:
    """QS-2: the rubric table."""
    return spark.createDataFrame(RUBRICS, "tier int, criterion string, kind string, weight double, floor int")


def rubric_lines(rubric: DataFrame) -> DataFrame:
    """QS-10: (tier, text): the criteria of a tier, gates first, with weight and floor."""
    line = F.concat(F.lit("- "), "criterion", F.lit(" ("), "kind", F.lit(", weight "), F.format_number("weight", 2), F.when(F.col("kind") == "gate", F.concat(F.lit(", at least "), "floor")).otherwise(""), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "gate", 0).otherwise(1).alias("k"), "criterion", line.alias("line"))))
    return rubric.groupBy("tier").agg(F.array_join(F.transform(rows, lambda s: s["line"]), "\n").alias("text"))


def _request(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    return df.withColumn("text", text).select(*keys, request_key("text").alias("request_key"), "text")


def _listed(order: str, line: Column, most: int | None = None) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return F.array_join(F.transform(rows if most is None else F.slice(rows, 1, most), lambda s: s["line"]), "\n")


def file_descriptors(files: DataFrame) -> DataFrame:
    """AS-12: (file, line) of files (file, purpose, role, n_functions)."""
    line = F.concat(F.lit("- "), "file", F.lit(" ["), F.coalesce("role", F.lit("other")), F.lit(", "), F.coalesce("n_functions", F.lit(0)), F.lit(" functions]: "), F.coalesce("purpose", F.lit("")))
    return files.select("file", line.alias("line"))


def assignment_requests(batches: DataFrame, menu: DataFrame) -> DataFrame:
    """AS-12: (batch, request_key, text): the stage menu (ord, line) and a batch's files (batch, file, purpose, role, n_functions)."""
    told = menu.agg(_listed("ord", F.col("line")).alias("menu"))  # a line a stage, one row
    lines = batches.select("batch", "file").join(file_descriptors(batches), "file").groupBy("batch").agg(_listed("file", F.col("line")).alias("files"))
    return _request(lines.crossJoin(F.broadcast(told)), ["batch"], F.concat(F.lit("Stages:\n"), "menu", F.lit("\n\nFiles:\n"), "files"))


def rollup_lines(rollup: DataFrame) -> DataFrame:
    """AS-2: (dir, line) of a directory rollup (dir, n_files, roles, lifecycles, purposes)."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label} "), F.array_join(c, ", ")))
    line = F.concat_ws("; ", F.concat("dir", F.lit(": "), "n_files", F.lit(" files")), part("roles", "roles"), part("lifecycles", "lifecycles"), part("e.g.", "purposes"))
    return rollup.select("dir", line.alias("line"))


def draft_request(rollup: DataFrame) -> DataFrame:
    """AS-5, AS-11: one request for a first set of stages from all directories' rollups."""
    return _request(rollup_lines(rollup).agg(_listed("dir", F.col("line")).alias("lines")), [], F.concat(F.lit("Propose stages for these directories:\n"), "lines"))


def stage_evidence(stats: DataFrame) -> DataFrame:
    """DR-2: (stage, line) of stage statistics, shares as whole per cent."""
    share = F.when(F.col("size") > 0, F.concat(F.lit(", "), F.round(F.col("share") * 100).cast("int"), F.lit("% in "), "dominant_dir"))
    line = F.concat("stage", F.lit(": "), "size", F.lit(" files in "), "n_dirs", F.lit(" directories"), F.coalesce(share, F.lit("")), F.when(F.col("overloaded"), " (overloaded)").otherwise(""))
    return stats.select("stage", line.alias("line"))


def unassigned_lines(file_stage: DataFrame, most: int = 40) -> DataFrame:
    """DR-2: one row: the first unassigned files by name, and how many there are."""
    u = file_stage.where(F.col("stage") == stages.UNASSIGNED).select("file")
    first = u.orderBy("file").limit(most)  # the report's limit
    return u.agg(F.count("*").alias("n")).crossJoin(first.agg(F.array_join(F.sort_array(F.collect_list("file")), "\n").alias("files")))  # one row each


def doctor_requests(stage_table: DataFrame, stats: DataFrame, file_stage: DataFrame) -> DataFrame:
    """DR-7, DR-13: (scope, request_key, text): one request for each overloaded stage, and a global one."""
    told = stage_evidence(stats).select(F.col("stage").alias("id"), "line")
    split = stats.where("overloaded").join(stage_evidence(stats), "stage").select(F.col("stage").alias("scope"), F.concat(F.lit("Split this stage:\n"), "line").alias("body"))
    lines = stage_table.join(told, "id").agg(_listed("ord", F.concat("title", F.lit(" — "), "line")).alias("lines"))
    whole = lines.crossJoin(unassigned_lines(file_stage)).select(F.lit("global").alias("scope"), F.concat(F.lit("Stages:\n"), "lines", F.lit("\n\nUnassigned ("), "n", F.lit("):\n"), "files").alias("body"))
    return _request(split.unionByName(whole), ["scope"], F.col("body"))


def distribution_lines(mapping: DataFrame) -> DataFrame:
    """DR-14: (stage, line) of mapping statistics, and the total in each, so that one row tells the whole."""
    line = F.concat("stage", F.lit(": "), "n_members", F.lit(" members ("), "n_functions", F.lit(" functions, "), "n_regions", F.lit(" regions), mostly "), "dominant_file")
    return mapping.crossJoin(F.broadcast(mapping.agg(F.sum("n_members").alias("total")))).select("stage", line.alias("line"), "total")  # one row


def ordering_requests(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """OR-9, OR-10: (stage, request_key, text): a stage's members numbered in order, and the pairs (stage, i, j) that call one another."""
    place = members.withColumn("n", F.expr("row_number() OVER (PARTITION BY stage ORDER BY ord) - 1"))
    line = F.concat("n", F.lit(". "), "qualname", F.lit(" ("), "type", F.lit(")"))
    own = place.groupBy("stage").agg(_listed("n", line).alias("members"))
    at = place.select("stage", "ord", "n")
    named = pairs.join(at.toDF("stage", "i", "a"), ["stage", "i"]).join(at.toDF("stage", "j", "b"), ["stage", "j"])
    calls = named.groupBy("stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda s: F.concat(s["a"], F.lit(" -> "), s["b"])), ", ").alias("calls"))
    text = F.concat_ws("\n\n", F.concat(F.lit("Members:\n"), "members"), F.concat(F.lit("Calls: "), "calls"))
    return _request(own.join(calls, "stage", "left"), ["stage"], text)


def grouping_requests(file_stage: DataFrame, adjacency: DataFrame, most: int = 4) -> DataFrame:
    """OR-10: (stage, request_key, text): a stage's files, each with up to four files of the stage that it calls."""
    b = file_stage.select("stage", F.col("file").alias("file_b"))
    inner = adjacency.join(file_stage.select("stage", F.col("file").alias("file_a")), "file_a").join(b, ["stage", "file_b"])
    called = inner.groupBy("stage", F.col("file_a").alias("file")).agg(F.array_join(F.slice(F.sort_array(F.collect_set("file_b")), 1, most), ", ").alias("calls"))
    line = F.concat(F.lit("- "), "file", F.coalesce(F.concat(F.lit(" -> "), "calls"), F.lit("")))
    return _request(file_stage.join(called, ["stage", "file"], "left").groupBy("stage").agg(_listed("file", line).alias("files")), ["stage"], F.concat(F.lit("Group these files:\n"), "files"))


def member_blocks(members: DataFrame, cut: int = 400) -> DataFrame:
    """MP-17: (stage, text): members with their purposes, cut."""
    line = F.concat(F.lit("- "), "qualname", F.lit(" ["), "line_start", F.lit("-"), "line_end", F.lit("]: "), F.substr(F.coalesce("purpose", F.lit("")), F.lit(1), F.lit(cut)))
    return members.groupBy("stage").agg(_listed("ord", line).alias("text"))


def classify_requests(nodes: DataFrame, context: DataFrame, menu: DataFrame) -> DataFrame:
    """MP-12, LM-11: (qualname, request_key, text): a function with what it calls and who calls it, and the stage menu."""
    told = menu.agg(_listed("ord", F.col("line")).alias("menu"))  # one row
    side = lambda d: F.array_join(F.sort_array(F.collect_set(F.when(F.col("direction") == d, F.col("other")))), ", ")
    around = context.groupBy("qualname").agg(side("calls").alias("calls"), side("called_by").alias("called_by"))
    one = nav.internal(nodes).groupBy("qualname").agg(F.min_by(F.struct("file", "line_start", "line_end"), "ord").alias("n"))  # RG-11b: the first node of a name
    text = F.concat(
        F.lit("Function "), "qualname", F.lit(" in "), "n.file", F.lit("\nCalls: "), F.coalesce("calls", F.lit("")), F.lit("\nCalled by: "), F.coalesce("called_by", F.lit("")), F.lit("\n\nStages:\n"), "menu"
    )
    return _request(one.join(around, "qualname", "left").crossJoin(F.broadcast(told)), ["qualname"], text)


def region_requests(members: DataFrame, stage_table: DataFrame) -> DataFrame:
    """RG-10, RG-11b: (qualname, request_key, text): the regions of a function in order, with their stages' titles, where there are several."""
    titles = stage_table.select(F.col("id").alias("stage"), "title")
    rows = members.where("type = 'region'").join(titles, "stage", "left")
    line = F.concat("line_start", F.lit("-"), "line_end", F.lit(" "), "stage", F.lit(" ("), F.coalesce("title", F.lit("?")), F.lit("): "), F.coalesce("purpose", F.lit("")))
    own = rows.groupBy("qualname").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "line_end", "stage", "ord", line.alias("line")))), lambda s: s["line"]), "\n").alias("regions"))
    return _request(own.where("n >= 2"), ["qualname"], F.concat(F.lit("Regions of "), "qualname", F.lit(":\n"), "regions"))


def unit_requests(units: DataFrame, texts: DataFrame) -> DataFrame:
    """QS-7, QS-9: (stage, qualname, request_key, text): a unit's source with the units before it in its stage (units with `before`)."""
    text = F.concat(F.lit("Describe "), "qualname", F.lit(" ("), "kind", F.lit(").\nTold before: "), F.array_join("before", ", "), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return _request(units.join(texts.select("qualname", "text"), "qualname", "left"), ["stage", "qualname"], text)


def findings_lines(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """QS-4: (unit, text): criteria of a unit (unit, criterion, score, finding) below their floor or with a finding, gates first: what a revision is asked to mend."""
    rows = scores.join(rubric.select("criterion", "kind", "floor"), "criterion").where((F.col("score") < F.col("floor")) | (F.trim(F.coalesce("finding", F.lit(""))) != ""))
    line = F.concat(F.lit("- "), "criterion", F.lit(" "), "score", F.coalesce(F.concat(F.lit(": "), F.nullif(F.trim("finding"), F.lit(""))), F.lit("")))
    order = F.struct(F.when(F.col("kind") == "gate", 0).otherwise(1).alias("k"), "criterion", line.alias("line"))
    return rows.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["line"]), "\n").alias("text"))


def system_request(stage_table: DataFrame, summaries: DataFrame) -> DataFrame:
    """TR-11: one request for the whole from the top-level stages' summaries."""
    tops = tree.linked(stage_table).where("parent IS NULL").join(summaries, "id", "left")
    return _request(tops.agg(_listed("ord", F.concat("title", F.lit(": "), F.coalesce("summary", F.lit("")))).alias("lines")), [], F.concat(F.lit("Summarise the system:\n"), "lines"))


def appendix_requests(registers: DataFrame, sites: DataFrame) -> DataFrame:
    """RE-7, RE-11: (id, request_key, text): a register with the number of its uses by kind (id, kind, n)."""
    uses = sites.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda s: F.concat(s["kind"], F.lit(" "), s["n"])), ", ").alias("uses"))
    return _request(registers.join(uses, "id", "left"), ["id"], F.concat(F.lit("Register "), "id", F.lit(": "), "semantics", F.lit("\nUses: "), F.coalesce("uses", F.lit("none"))))
