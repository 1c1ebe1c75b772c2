"""Proposal gates (LM) and quality scoring (QS)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: HTTP answers that another try does not change
PERMANENT = (400, 401, 403, 404, 405, 410, 422)
PASS_MARK, LEAST_GAIN = 4.0, 0.05


def parse_verdict(replies: DataFrame) -> DataFrame:
    """LM-4, LM-5: (keys, decision, concerns): JSON verdicts; unknown decisions are null, a REVISE without concerns is an APPROVE."""
    v = F.from_json("reply", "decision string, concerns array<string>, rationale string")
    r = replies.withColumn("v", v).withColumns({"decision": F.upper(F.trim("v.decision")), "concerns": F.filter(F.coalesce("v.concerns", F.array().cast("array<string>")), lambda c: F.trim(c) != "")})
    decision = F.when(~F.col("decision").isin("APPROVE", "REVISE", "REJECT"), None).when((F.col("decision") == "REVISE") & (F.size("concerns") == 0), "APPROVE").otherwise(F.col("decision"))
    return r.withColumn("decision", decision).drop("v", "reply")


def _rounds(verdicts: DataFrame) -> DataFrame:
    """Per proposal and round: whether all approve, and whether any rejects; a null decision counts as unusable."""
    vacuous = (F.col("decision") == "REVISE") & (F.size("concerns") == 0)
    d = F.when(vacuous, "APPROVE").otherwise(F.coalesce("decision", F.lit("unusable")))
    n = verdicts.withColumn("d", d).groupBy("proposal").pivot("round", [1, 2])
    return n.agg(
        F.coalesce(F.bool_and(F.col("d") == "APPROVE"), F.lit(False)).alias("all"),
        F.coalesce(F.bool_or(F.col("d").isin("REJECT", "unusable")), F.lit(False)).alias("rejected"), F.count("d").alias("n"),
    )


def gate_single(verdicts: DataFrame) -> DataFrame:
    """LM-6: (proposal, outcome): accept 1, accept 2 or discard, with one critic: a reject or unusable verdict discards at once; a revised proposal passes unless rejected.

    verdicts: proposal, round, role_ord, decision, concerns.
    """
    r = _rounds(verdicts)
    outcome = (
        F.when(F.col("1_all"), "accept 1").when(F.col("1_rejected"), "discard")
        .when((F.col("2_n") > 0) & ~F.col("2_rejected"), "accept 2").otherwise("discard")
    )
    return r.select("proposal", outcome.alias("outcome"))


def gate_multi(verdicts: DataFrame) -> DataFrame:
    """LM-7: as `gate_single` with several critics, but a first reject still gets a revision; an unusable verdict is a reject."""
    r = _rounds(verdicts)
    outcome = F.when(F.col("1_all"), "accept 1").when((F.col("2_n") > 0) & ~F.col("2_rejected"), "accept 2").otherwise("discard")
    return r.select("proposal", outcome.alias("outcome"))


def concerns(verdicts: DataFrame) -> DataFrame:
    """LM-8: per proposal and round all concerns as `[role] text`, in role order."""
    rows = verdicts.select("proposal", "round", "role_ord", "role", F.posexplode("concerns").alias("k", "c"))
    line = F.struct("role_ord", "k", F.concat(F.lit("["), "role", F.lit("] "), "c").alias("line"))
    return rows.groupBy("proposal", "round").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "\n").alias("concerns"))


def label(outcomes: DataFrame) -> DataFrame:
    """LM-9: ACCEPTED, actor_failed (no proposal) or DISCARDED."""
    return outcomes.withColumn("label", F.when(F.col("outcome").isNull(), "actor_failed").when(F.col("outcome").startswith("accept"), "ACCEPTED").otherwise("DISCARDED"))


def usage(log: DataFrame) -> DataFrame:
    """LM-10: calls and tokens by phase and model."""
    return log.groupBy("phase", "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def reply_text(body) -> F.Column:
    """LM-2: the answer's text, wherever the service puts it, else the whole body."""
    places = ("$.choices[0].message.content", "$.choices[0].text", "$.content[0].text", "$.output_text", "$.message.content", "$.response", "$.text")
    return F.coalesce(*(F.get_json_object(body, p) for p in places), body)


def weighted_verdict(rubric: DataFrame, scores: DataFrame) -> DataFrame:
    """QS-1: per unit the weighted mean of its scores, failed gates, and whether it passes.

    rubric: criterion, kind, weight, floor; scores: unit, criterion, score (text).  Missing
    and bad scores are 1, others are clamped to 1..5.  As a missing score is the least one,
    told scores only add to the rubric's totals, and no unit is paired with every criterion.
    Weights are summed as decimals, so that the mark is met or not whatever the order.
    """
    w, gate = F.col("weight").cast("decimal(18,6)"), (F.col("kind") == "gate") & (F.col("floor") > 1)
    total = rubric.agg(F.sum(w).alias("total"), F.count_if(gate).alias("gates"))  # one row
    s = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("score", F.lit(1))))
    told = scores.groupBy("unit", "criterion").agg(F.max(F.expr("try_cast(score AS int)")).alias("score")).join(rubric, "criterion")
    own = told.groupBy("unit").agg(F.sum(w * (s - 1)).alias("more"), F.count_if(gate & (s >= F.col("floor"))).alias("held"))
    u = scores.select("unit").distinct().join(own, "unit", "left").crossJoin(F.broadcast(total))
    points, failed = F.col("total") + F.coalesce("more", F.lit(0)), F.col("gates") - F.coalesce("held", F.lit(0))
    mean = points.cast("double") / F.col("total").cast("double")
    return u.select("unit", F.round(mean, 3).alias("overall"), failed.alias("gate_failures"), ((points >= F.col("total") * int(PASS_MARK)) & (failed == 0)).alias("passed"))


def best_of_n(rounds: DataFrame) -> DataFrame:
    """QS-3: per unit the round where the loop stops (a pass, or from the second round a gain under 0.05) and the best round up to it, of equals the first."""
    w = Window.partitionBy("unit").orderBy("round")
    best_before = F.max("overall").over(w.rowsBetween(Window.unboundedPreceding, -1))
    stop = F.col("passed") | (F.round(F.col("overall") - best_before, 9) < LEAST_GAIN)
    r = rounds.withColumn("stop", F.coalesce(stop, F.lit(False)))
    last = r.withColumn("end", F.min(F.when(F.col("stop"), F.col("round"))).over(Window.partitionBy("unit")))
    kept = last.where("end IS NULL OR round <= end")
    return kept.groupBy("unit").agg(F.max("round").alias("rounds"), F.max_by("round", F.struct("overall", -F.col("round"))).alias("best"))


def validate_translation(units: DataFrame) -> DataFrame:
    """QS-5: translations (unit, kind, purpose, data_flow, n_regions, n_told) with the first rule broken, or null."""
    from .stages import first_error

    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [
        (~F.col("kind").isin("single", "multi_region"), "unknown kind"), (blank("purpose"), "no purpose"), (blank("data_flow"), "no data flow"),
        ((F.col("kind") == "single") & (F.col("n_told") != 1), "one text expected"), ((F.col("kind") == "multi_region") & (F.col("n_told") != F.col("n_regions")), "a text a region expected"),
    ]
    return units.withColumn("error", first_error(rules))


def units(members: DataFrame) -> DataFrame:
    """QS-6: functions of each stage in order of first appearance; of several rows: multi_region."""
    return members.groupBy("stage", "qualname").agg(
        F.min("ord").alias("ord"), F.count("*").alias("n_entries"), F.when(F.count("*") > 1, "multi_region").otherwise("single").alias("kind")
    )


def siblings(units_: DataFrame) -> DataFrame:
    """QS-8: per unit the names before it in its stage."""
    w = Window.partitionBy("stage").orderBy("ord", "qualname").rowsBetween(Window.unboundedPreceding, -1)
    return units_.withColumn("before", F.collect_list("qualname").over(w))
