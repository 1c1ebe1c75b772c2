"""Sequential changes of the stage hierarchy (DR-4, DR-6, MP-3) and the file-level resync (CH-6).

A hierarchy has some hundred stages and every change is checked against what those before
it left, so changes are applied to plain lists; files and members stay in DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as change_ops
from ..operators import inventory, stages

ACTIONS = ("add_stage", "remove_stage", "merge_stages", "split_stage")


def error_of(change: dict, tree: list[dict], protected: frozenset[str] = frozenset()) -> str | None:
    """Why a change can't be applied to the stages as they are, or None."""
    ids = {s["id"] for s in tree}
    crosscuts = {s["id"] for s in tree if s.get("crosscut")} | protected
    action, stage = change.get("action"), change.get("stage")
    if action not in ACTIONS:
        return "unknown action"
    if action == "add_stage":
        return "id in use" if stage in ids else None if stage else "no id"
    if stage not in ids:
        return "unknown stage"
    if action in ("remove_stage", "merge_stages") and stage in crosscuts:
        return "protected stage"
    if action == "merge_stages" and change.get("target") not in ids:
        return "unknown target"
    if action == "merge_stages" and change["target"] == stage:
        return "target is the stage"
    if action == "split_stage":
        new = change.get("new_ids") or []
        if len(new) < 2:
            return "split into fewer than two"
        if len(set(new)) < len(new):
            return "repeated new id"
        if ids & set(new):
            return "new id in use"
    return None


def apply_change(change: dict, tree: list[dict]) -> tuple[list[dict], set[str]]:
    """The stages after a valid change, and those whose files are to be placed again."""
    action, stage = change["action"], change["stage"]
    if action == "add_stage":
        return stages.normalise_stages([*tree, {"id": stage, "title": change.get("title"), "description": change.get("description"), "parent": change.get("parent")}]), set()
    if action == "split_stage":
        new = [{"id": i, "title": i, "parent": stage} for i in change["new_ids"]]
        return stages.normalise_stages([*tree, *new]), {stage}
    parent = change["target"] if action == "merge_stages" else None
    rest = [dict(s, parent=parent if s.get("parent") == stage and s["id"] != parent else s.get("parent")) for s in tree if s["id"] != stage]
    return stages.normalise_stages(rest), {stage}


def apply_all(proposed: list[dict], tree: list[dict], protected: frozenset[str] = frozenset()) -> tuple[list[dict], set[str], list[str | None]]:
    """DR-6: changes in order, each checked against the stages as they are by then."""
    affected: set[str] = set()
    errors: list[str | None] = []
    for c in proposed:
        error = error_of(c, tree, protected)
        errors.append(error)
        if error is None:
            tree, moved = apply_change(c, tree)
            affected |= moved
    return tree, affected, errors


def resync(known: DataFrame, edited: DataFrame, cards: DataFrame, file_stage: DataFrame, stage_table: DataFrame, annotate, place) -> dict[str, DataFrame]:
    """CH-6: cards and file map after a code change.

    known, edited: file, content.  annotate: files to cards; place: files to (file, stage).
    Without any change the tables come back as they are.
    """
    verdicts = change_ops.file_verdicts(known, edited)
    if verdicts.where("verdict <> 'unchanged'").isEmpty():
        return {"verdicts": verdicts, "cards": cards, "file_stage": file_stage}
    kept = change_ops.stale_cards(cards, verdicts)
    asked = inventory.to_read(edited.select("file"), kept)
    new = verdicts.where("verdict = 'new'").select("file")
    synced = change_ops.sync_buckets(file_stage, verdicts, place(new))
    return {
        "verdicts": verdicts, "cards": kept.join(edited.select("file"), "file", "left_semi").unionByName(annotate(asked), True),
        "file_stage": stages.rebuild(synced, stage_table), "plan": change_ops.sync_plan(file_stage.where(F.col("stage").isNotNull()), synced),
    }
