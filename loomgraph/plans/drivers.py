"""Drivers (SC-6, SC-8, GR-10, GR-11, CD, OR, DR, MP, RG, CH, LM): steps joined to whole passes, with an external writer's replies as a relation.

A pass never calls out: it makes requests, joins the replies that are there, and tells
what is still to be asked.  A writer is any function of requests (request_key, text) to
replies (request_key, reply); `retried` wraps one that may fail.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import python_source, scan, static_source
from ..operators import graph, mapping, ordering, regions, resolve, stages
from ..operators.numbering import settle, stored
from . import annotate, doctor, requests

Writer = Callable[[DataFrame], DataFrame]
FUNCTION_COLUMNS = (
    "id", "name", "qualname", "file", "line_start", "line_end", "signature", "is_async", "is_method", "class_name", "decorators", "used_self_attrs_read", "used_self_attrs_written", "params_types",
)
PER_FILE = 1 << 20  # records of a file, in the order numbers of a tree


def _script_records(files: DataFrame) -> DataFrame:
    return scan.extract(files.select("lang", "file", "source"))


def _script_edges(records: DataFrame) -> DataFrame:
    calls = records.where("kind = 'call'").select(F.col("ord").alias("ord"), F.col("id").alias("caller_id"), "name", F.col("line_start").alias("line"), "raw")
    done = resolve.resolve_scripts(calls, records.where("kind = 'function'").select("id", "name", "ord"))
    return done.select(F.struct(F.lit(0).cast("long").alias("file_ord"), F.col("ord").cast("long").alias("ord")).alias("at"), "caller_id", "callee_id", F.lit(False).alias("is_await"), "call_type", "line", F.lit(None).cast("string").alias("raw"))


#: SC-6: per language what makes records of files, and edges of records
LANGUAGES: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = {}


def register(lang: str, extract: Callable[[DataFrame], DataFrame], edges: Callable[[DataFrame], DataFrame]) -> None:
    """SC-6: add or replace a language."""
    LANGUAGES[lang] = (extract, edges)


def language(lang: str) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """SC-6: what handles a language; an unknown one is a KeyError that names those there are."""
    if lang not in LANGUAGES:
        raise KeyError(f"{lang}: not one of {', '.join(sorted(LANGUAGES))}")
    return LANGUAGES[lang]


register("python", python_source.extract, resolve.resolve_python)
for _lang in ("go", "rust", "typescript"):
    register(_lang, static_source.extract, lambda records, lang=_lang: resolve.resolve_forms(records, lang))
for _lang in ("powershell", "shell", "starlark"):
    register(_lang, _script_records, _script_edges)


def analyse(files: DataFrame, langs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SC-8: (functions, calls) of source files (lang, file, source, ord), of the named languages or all registered ones.

    Records are written once a language, as functions and edges are both made of them.
    Files that can't be read yield none and stop nothing.
    """
    functions = calls = None
    for lang in langs or sorted(LANGUAGES):
        extract, edges = language(lang)
        own = files.where(F.col("lang") == lang)
        if langs is None and own.isEmpty():
            continue
        records = stored(extract(own))
        f = records.where("kind = 'function'")
        place = (F.col("file_ord") * PER_FILE if "file_ord" in f.columns else F.lit(0)) + F.col("ord")
        f = f.select(place.cast("long").alias("ord"), *(F.col(c) if c in f.columns else F.lit(None).alias(c) for c in FUNCTION_COLUMNS), F.lit("internal").alias("kind"), F.lit(False).alias("synthetic"))
        e = edges(records).select((F.col("at.file_ord") * PER_FILE + F.col("at.ord")).cast("long").alias("ord"), "caller_id", "callee_id", "is_await", "call_type", "line", "raw")
        functions = f if functions is None else functions.unionByName(f, True)
        calls = e if calls is None else calls.unionByName(e)
    if functions is None:
        spark = files.sparkSession
        types = "ord long, id string, name string, qualname string, file string, line_start int, line_end int, signature string, is_async boolean, is_method boolean, class_name string, decorators array<string>, used_self_attrs_read array<string>, used_self_attrs_written array<string>, params_types map<string,string>, kind string, synthetic boolean"
        return spark.createDataFrame([], types), spark.createDataFrame([], "ord long, caller_id string, callee_id string, is_await boolean, call_type string, line int, raw string")
    return functions, calls


def graph_of(files: DataFrame, langs: list[str] | None = None, default_ext: str = ".py") -> dict[str, DataFrame]:
    """GR-10, GR-11: nodes, kept and dropped calls and functions of a tree of files, edited or not; a tree without readable files has an empty graph."""
    functions, calls = analyse(files, langs)
    # written once: the graph reads calls several times, and each time would resolve them again; nothing of the code's size is broadcast
    calls, functions = stored(calls).hint("merge"), functions.hint("merge")
    kept = graph.kept_calls(calls)
    return {"functions": functions, "calls": calls, "kept": kept, "dropped": graph.dropped_calls(calls), "nodes": graph.nodes(functions, kept, default_ext)}


# --- replies -----------------------------------------------------------------------

#: fixed values: HTTP answers that another try does not change
PERMANENT = frozenset((400, 401, 403, 404, 405, 410, 422))


def retried(call: Callable[[str], str], tries: int = 6, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """LM-3: a call with linear backoff and jitter; an error with a permanent `status` is raised at once, the last one after all tries."""

    def run(text: str) -> str:
        for k in range(1, tries + 1):
            try:
                return call(text)
            except Exception as e:
                if k == tries or getattr(e, "status", None) in PERMANENT:
                    raise
                sleep(pause * k * (0.5 + random.random()))
        raise AssertionError

    return run


def capped(asked: DataFrame, most: int) -> DataFrame:
    """DR-9: requests in at most `most` partitions, so that a writer called inside tasks is called by so many at once."""
    return asked.coalesce(most)


def ask(asked: DataFrame, replies: DataFrame, write: Writer | None = None) -> tuple[DataFrame, DataFrame]:
    """LM-13: (answered, replies): requests with their reply, those without one written first where there is a writer; new replies join the relation."""
    if write is not None:
        open_ = asked.join(replies.select("request_key"), "request_key", "left_anti")
        replies = settle(replies.unionByName(write(open_.select("request_key", "text").distinct()).select("request_key", "reply")))
    return annotate.annotate(asked, replies), replies


def progress(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """LM-12: one row: requests, and how many are answered."""
    done = asked.select("request_key").distinct().join(replies.select("request_key").distinct().withColumn("done", F.lit(1)), "request_key", "left")
    return done.agg(F.count("*").alias("n_requests"), F.count("done").alias("n_answered"))


def degrade(items: DataFrame, key: str, tiers: list[Writer]) -> DataFrame:
    """CD-6: answers (key, reply, tier) of items by the first tier that answers each: a later tier is asked only for what is still missing, and null replies are none."""
    done = None
    for k, write in enumerate(tiers):
        missing = items if done is None else items.join(done.select(key), key, "left_anti")
        said = settle(write(missing).where("reply IS NOT NULL").select(key, "reply", F.lit(k).alias("tier")))
        done = said if done is None else done.unionByName(said)
    return done


def describe_files(files: DataFrame, cards: DataFrame, tiers: list[Writer], detail: str = "brief") -> DataFrame:
    """CD-10: cards of all files: finished ones stay, others are described by the tiers (replies are JSON lists of cards), the rest gets empty ones."""
    from ..operators import inventory

    kept = inventory.done_cards(cards, detail)
    asked = inventory.to_read(files, cards, detail)
    new = inventory.coerce_cards(degrade(asked, "file", tiers).select("reply"), asked)
    both = kept.select("file", "purpose", "role", "lifecycle").unionByName(new.select("file", "purpose", "role", "lifecycle"))
    return inventory.backfill(files, both.dropDuplicates(["file"]))


# --- stages ------------------------------------------------------------------------


def draft(mode: str, oneshot: Callable[[], list[dict]], agent: Callable[[], list[dict]], refine: Callable[[list[dict]], list[dict]]) -> list[dict]:
    """AS-11: stages by the named way: oneshot; agent, with oneshot where it gives none; doctor, which refines either.  No stages at all are an error."""
    if mode not in ("oneshot", "agent", "doctor"):
        raise ValueError(f"{mode}: not one of oneshot, agent, doctor")
    found = stages.normalise_stages(agent() if mode != "oneshot" else [])
    found = found or stages.normalise_stages(oneshot())
    if not found:
        raise ValueError("no stages")
    return stages.normalise_stages(refine(found)) if mode == "doctor" else found


def doctor_round(tree: list[dict], split_changes: dict[str, list[dict]], global_changes: list[dict]) -> tuple[list[dict], set[str], list[str | None]]:
    """DR-7: one round over disjoint scopes: the splits of overloaded stages first, each only within its stage, then the global changes, which may not touch those."""
    affected: set[str] = set()
    errors: list[str | None] = []
    for stage, proposed in sorted(split_changes.items()):
        own = [c for c in proposed if c.get("stage") == stage]
        tree, moved, found = doctor.apply_all(own, tree)
        affected |= moved
        errors += found + ["outside its scope"] * (len(proposed) - len(own))
    tree, moved, found = doctor.apply_all([c for c in global_changes if c.get("stage") not in split_changes], tree, frozenset(split_changes))
    errors += found + ["protected stage"] * sum(c.get("stage") in split_changes for c in global_changes)
    return tree, affected | moved, errors


def function_change_error(change: dict, tree: list[dict], sizes: dict[str, int]) -> str | None:
    """DR-11: why a change of the function-level hierarchy can't be made: the rules of stages, and no removal or split of a stage without members to place."""
    error = doctor.error_of(change, tree)
    if error is None and change["action"] == "split_stage" and sizes.get(change["stage"], 0) < len(change["new_ids"]):
        return "fewer members than parts"
    if error is None and change["action"] == "merge_stages" and change["target"].startswith("crosscut-") != change["stage"].startswith("crosscut-"):
        return "plain and cross-cutting stages don't merge"
    return error


def skeleton_pass(proposed: list[dict], verdicts: DataFrame, tree: list[dict], sizes: dict[str, int]) -> tuple[list[dict], set[str], list[str | None]]:
    """DR-12: changes that the critics accept (proposal is the change's place), each checked against the stages as they are by then."""
    from ..operators import gates

    outcome = {r["proposal"]: r["outcome"] for r in gates.gate_multi(verdicts).collect()}  # one row a proposal of a round
    affected: set[str] = set()
    errors: list[str | None] = []
    for k, c in enumerate(proposed):
        error = "not accepted" if not outcome.get(k, "").startswith("accept") else function_change_error(c, tree, sizes)
        errors.append(error)
        if error is None:
            tree, moved = doctor.apply_change(c, tree)
            affected |= moved
    return tree, affected, errors


def order_stages(members: DataFrame, replies: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OR-9: (ordered members, cache): a reply (stage, order: array of places) is taken where it is a permutation; stages whose fingerprint the cache has keep their places; others fall back to file order.

    cache: stage, fingerprint, ord, position.
    """
    prints = ordering.fingerprint(members)
    place = members.select("stage", "ord", F.expr("row_number() OVER (PARTITION BY stage ORDER BY ord) - 1").cast("int").alias("n"))
    size = place.groupBy("stage").agg(F.count("*").alias("n"))
    good = ordering.permutation_check(replies.select("stage", "order").join(size, "stage")).where("valid").select("stage", F.posexplode("order").alias("position", "n"))
    told = good.join(place, ["stage", "n"]).select("stage", "ord", "position")
    kept = cache.join(prints, ["stage", "fingerprint"]).select("stage", "ord", "position").join(told.select("stage").distinct(), "stage", "left_anti")
    rest = members.join(told.unionByName(kept).select("stage").distinct(), "stage", "left_anti")
    whole = settle(told.unionByName(kept).unionByName(ordering.fallback_order(rest).select("stage", "ord", F.col("position").cast("int").alias("position"))))
    return members.join(whole, ["stage", "ord"]), whole.join(prints, "stage").select("stage", "fingerprint", "ord", "position")


# --- function-level passes ---------------------------------------------------------


def classify(members: DataFrame, asked: DataFrame, replies: DataFrame, stage_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """MP-12: members after all proposals of a batch, made against one view of the mapping and applied together.

    asked: qualname, request_key; replies: JSON lists of (stage, line_start, line_end, purpose);
    the name is that which was asked, whatever the reply says; a row over the whole
    function is a function, any other a region.
    """
    answer = F.from_json("reply", "array<struct<stage: string, line_start: int, line_end: int, purpose: string>>")
    rows = annotate.annotate(asked, replies).select("qualname", F.posexplode(answer).alias("ord", "p")).select("qualname", F.col("ord").cast("long").alias("ord"), "p.*")
    span = nodes.where("kind = 'internal'").groupBy("qualname").agg(F.min_by(F.struct("file", F.col("line_start").alias("s"), F.col("line_end").alias("e")), "ord").alias("n"))
    r = rows.join(span, "qualname").withColumns({"line_start": F.coalesce("line_start", "n.s"), "line_end": F.coalesce("line_end", "n.e")})
    kind = F.when((F.col("line_start") == F.col("n.s")) & (F.col("line_end") == F.col("n.e")), "function").otherwise("region")
    proposals = r.select("stage", "ord", "qualname", kind.alias("type"), "n.file", "line_start", "line_end", "purpose")
    return mapping.apply_classification(members, proposals, stage_table)


def audit(members: DataFrame, moves: DataFrame, stage_table: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MP-15: (members, checked moves, cache): moves proposed for stages that are due, the good ones applied; audited stages enter the cache as they were judged."""
    due = settle(mapping.audit_due(members, cache))
    m = moves.join(due.select(F.col("stage").alias("audited")), "audited", "left_semi")
    checked = settle(mapping.validate_moves(m, members, stage_table))
    good = checked.where("error IS NULL").groupBy("qualname", "source").agg(F.min("target").alias("target"))
    kept = cache.join(due.select("stage"), "stage", "left_anti").select("stage", "fingerprint").unionByName(due)
    return mapping.reassign(members, good), checked, kept


def revise_regions(members: DataFrame, actions: DataFrame) -> DataFrame:
    """RG-10: region rows of members after actions that break no rule (RG-7) and meet no killed region (RG-8); function rows stay.

    actions: qualname, ord, action, refs, at, target, purpose.
    """
    rows = members.where("type = 'region'")
    own = rows.groupBy("qualname").agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end", "stage"))).alias("regions"))
    told = actions.join(own, "qualname").withColumn("current", F.get("regions", F.get("refs", 0))["stage"])
    good = regions.validate_actions(told).where("error IS NULL")
    accepted = regions.conflicts(good).where("accepted").select("qualname", "ord")
    done = regions.revise(rows, good.join(accepted, ["qualname", "ord"]).select("qualname", "ord", "action", "refs", "at", "target", "purpose"))
    file = rows.groupBy("qualname").agg(F.min("file").alias("file"))
    return members.where("type <> 'region'").select("stage", "qualname", "type", "file", "line_start", "line_end", "purpose").unionByName(
        done.join(file, "qualname").select("stage", "qualname", F.lit("region").alias("type"), "file", "line_start", "line_end", "purpose")
    )


def assemble(units: DataFrame, cache: DataFrame, texts: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """QS-7, QS-8: (document, open requests): units in their places with the text of the cache or the replies; stages with an unanswered unit are left out until it is answered.

    units: stage, ord, qualname, kind, before; cache: request_key, reply.
    """
    asked = requests.unit_requests(units, texts)
    known = replies.select("request_key", "reply").unionByName(cache.select("request_key", "reply"))
    done = annotate.annotate(units.join(asked, ["stage", "qualname"]), known)
    open_ = done.where("reply IS NULL")
    whole = done.join(open_.select("stage").distinct(), "stage", "left_anti")
    return whole.select("stage", "ord", "qualname", "kind", F.col("reply").alias("text")), open_.select("stage", "qualname", "request_key", "text")


#: fixed value: how many units before a unit its request tells
TOLD_BEFORE = 8


def build_document(units: DataFrame, texts: DataFrame, replies: DataFrame, write: Writer | None = None, synopsis: Callable[[Column], Column] = lambda reply: reply) -> tuple[DataFrame, DataFrame]:
    """QS-8: (document, open requests): a wavefront over all stages, in which a unit is asked once the units before it in its stage are answered.

    Round k asks the k-th unit of every stage, with the synopses of the last TOLD_BEFORE
    replies of the stage in its request; all stages advance together, each round is written,
    and a run that stops goes on from the replies it has.  A stage with a unit that stays without a
    reply is left out, its request stays open.  units: stage, ord, qualname, kind; one of a stage and name.
    """
    place = F.row_number().over(Window.partitionBy("stage").orderBy("ord", "qualname")) - 1
    placed = settle(units.select("stage", "ord", "qualname", "kind", place.alias("k")))
    rounds = placed.agg(F.max("k")).first()[0]
    told = placed.select("stage", "k", "qualname", F.lit("").alias("reply")).limit(0)
    open_ = None
    for k in range(-1 if rounds is None else rounds + 1):
        last = told.where(F.col("k") >= k - TOLD_BEFORE)
        line = F.concat("qualname", F.lit(": "), F.coalesce(synopsis(F.col("reply")), F.lit("")))
        before = last.groupBy("stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda s: s["line"]).alias("before"))  # TOLD_BEFORE at most
        ready = placed.where(F.col("k") == k)
        if k:  # a stage that misses a reply goes no further
            ready = ready.join(told.where(F.col("k") == k - 1).select("stage"), "stage", "left_semi")
        ready = ready.join(before, "stage", "left").withColumn("before", F.coalesce("before", F.array().cast("array<string>")))
        asked = ready.join(requests.unit_requests(ready, texts), ["stage", "qualname"])
        answered, replies = ask(settle(asked), replies, write)
        answered = settle(answered)
        told = settle(told.unionByName(answered.where("reply IS NOT NULL").select("stage", "k", "qualname", "reply")).repartition("stage", "k"))
        missed = answered.where("reply IS NULL").select("stage", "qualname", "request_key", "text")
        open_ = missed if open_ is None else open_.unionByName(missed)
        if told.where(F.col("k") == k).isEmpty():
            break
    if open_ is None:
        open_ = placed.select("stage", "qualname", F.lit("").alias("request_key"), F.lit("").alias("text")).limit(0)
    whole = placed.join(told, ["stage", "k", "qualname"]).join(open_.select("stage").distinct(), "stage", "left_anti")
    return whole.select("stage", "ord", "qualname", "kind", F.col("reply").alias("text")), open_


def replay(scale: str, by_file: Callable[[], dict[str, DataFrame]], by_function: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """CH-20, CH-21: a resync at the named scale; run again with the same replies it gives the same tables, as nothing else goes in."""
    if scale not in ("large", "small"):
        raise ValueError(f"{scale}: not one of large, small")
    return by_file() if scale == "large" else by_function()
