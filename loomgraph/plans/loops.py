"""Driver fixpoints (DR-8, RE-2, TR-10, MP-11): few rounds over small tables, each cut by a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stages as stage_ops
from ..operators import tree
from ..operators.numbering import settle


def converge(stages: DataFrame, file_stage: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], most: int = 6, patience: int = 2) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """DR-8: rounds of `step` until no file is unassigned and the stages stay as they are, at most `most`; it gives up
    after `patience` rounds in which neither unassigned files nor overloaded stages became fewer."""
    history: list[tuple[int, int]] = []
    idle, before = 0, None
    for _ in range(most):
        unassigned = file_stage.where(F.col("stage") == stage_ops.UNASSIGNED).count()
        overloaded = stage_ops.stage_stats(stages, file_stage).where("overloaded").count()
        shape = stages.agg(F.bit_xor(F.xxhash64(*stages.columns)), F.count("*")).first()
        if history and (unassigned >= history[-1][0] and overloaded >= history[-1][1]):
            idle += 1
        elif history:
            idle = 0
        history.append((unassigned, overloaded))
        if (unassigned == 0 and shape == before) or idle >= patience:
            break
        before = shape
        stages, file_stage = step(stages, file_stage)
        stages, file_stage = settle(stages), settle(file_stage)
    return stages, file_stage, history


def until_dry(propose: Callable[[int, DataFrame], DataFrame], found: DataFrame, most: int = 5, dry: int = 2) -> DataFrame:
    """RE-2: registers of rounds of `propose`, ids not seen before only, until `dry` rounds bring nothing new."""
    idle = 0
    for k in range(most):
        new = settle(propose(k, found).join(found.select("id"), "id", "left_anti").dropDuplicates(["id"]))
        idle = idle + 1 if new.isEmpty() else 0
        if idle >= dry:
            break
        found = settle(found.unionByName(new, True))
    return found


def rollup(stages: DataFrame, file_stage: DataFrame, cards: DataFrame, summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """TR-10: summaries from the deepest stages up.

    summarise: (id, title, description, evidence) to (id, summary); evidence holds the
    children's summaries and a line a direct file.  Stages without a summary fall back to
    description or title.
    """
    spark = stages.sparkSession
    linked = tree.linked(stages).join(tree.depths(stages).select("id", "depth"), "id")
    own = file_stage.join(cards.select("file", "purpose"), "file", "left").groupBy(F.col("stage").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "purpose"))), lambda s: F.concat_ws(": ", s["file"], s["purpose"])), "\n").alias("files"))
    done = spark.createDataFrame([], "id string, parent string, ord long, summary string")
    for depth in range(linked.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], -1, -1):
        below = done.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda s: s["summary"]), "\n").alias("children"))
        level = linked.where(F.col("depth") == depth).join(below, "id", "left").join(own, "id", "left")
        asked = level.select("id", "title", "description", F.concat_ws("\n", "children", "files").alias("evidence"))
        said = summarise(asked).select("id", F.col("summary").alias("said"))
        text = F.coalesce(F.nullif("said", F.lit("")), F.nullif("description", F.lit("")), "title", "id")
        done = settle(done.unionByName(level.join(said, "id", "left").select("id", "parent", "ord", text.alias("summary"))))
    return done.select("id", "summary")


def iterate(state: dict[str, DataFrame], step: Callable[[dict[str, DataFrame], int], tuple[dict[str, DataFrame], bool]], state_hash: Callable[[dict[str, DataFrame]], str], most: int = 10) -> tuple[dict[str, DataFrame], int]:
    """MP-11: rounds of `step`, which also tells whether its queue is empty, until the state repeats with an empty queue."""
    seen = state_hash(state)
    for k in range(most):
        state, empty = step(state, k)
        state = {name: settle(df) for name, df in state.items()}
        now = state_hash(state)
        if empty and now == seen:
            return state, k + 1
        seen = now
    return state, most
