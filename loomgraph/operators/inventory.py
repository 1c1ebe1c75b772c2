"""Per-file inventory, cards, batching (CD)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import BOUNDARY
from .nav import internal

#: fixed values: roles a card may have
ROLES = "entrypoint orchestration domain_logic io_transport data_model config util test generated other".split()


def inventory(nodes: DataFrame, kept: DataFrame, cap: int = 25) -> DataFrame:
    """CD-1: per function its distinct calls, callers and calls outside, cut to `cap` with the true totals.

    Self-calls are left out; calls to constructors without text and to ids without a node count as outside.
    """
    own = internal(nodes).select("id", "qualname", "file", "line_start", F.substr("signature", F.lit(1), F.lit(200)).alias("signature"))
    name = nodes.select(F.col("id").alias("callee_id"), F.col("qualname").alias("callee"))
    inside = own.select(F.col("id").alias("callee_id"), F.lit(True).alias("inside"))
    calls = (
        kept.where("caller_id <> callee_id").select("caller_id", "callee_id").distinct()
        .join(name, "callee_id", "left").join(inside, "callee_id", "left")
        .withColumn("callee", F.coalesce("callee", F.regexp_replace("callee_id", f"^{BOUNDARY}", "")))
    )
    targets = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("callee"))))
    out = calls.groupBy(F.col("caller_id").alias("id")).agg(targets(F.col("inside")).alias("calls"), targets(F.col("inside").isNull()).alias("ext_calls"))
    caller = own.select(F.col("id").alias("caller_id"), F.col("qualname").alias("caller"))
    into = calls.where("inside").join(caller, "caller_id").groupBy(F.col("callee_id").alias("id")).agg(F.sort_array(F.collect_set("caller")).alias("called_by"))
    none = F.array().cast("array<string>")
    full = own.join(out, "id", "left").join(into, "id", "left")
    lists = ("calls", "called_by", "ext_calls")
    full = full.withColumns({c: F.coalesce(c, none) for c in lists})
    return full.select(
        "file", "id", "qualname", "line_start", "signature", *(F.size(c).alias(f"n_{c}") for c in lists), *(F.slice(c, 1, cap).alias(c) for c in lists)
    )


def merge_notes(functions: DataFrame, notes: DataFrame) -> DataFrame:
    """CD-2: functions (id, qualname, name, ord) with notes (ord, qualname, name, purpose, note): by qualname (the last), else by name (the first), else blank."""
    text = F.coalesce(F.nullif("purpose", F.lit("")), "note", F.lit(""))
    n = notes.withColumn("text", text)
    by_q = n.where("qualname <> ''").groupBy("qualname").agg(F.max_by("text", "ord").alias("by_q"))
    by_n = n.where("name <> ''").groupBy("name").agg(F.min_by("text", "ord").alias("by_n"))
    return functions.join(by_q, "qualname", "left").join(by_n, "name", "left").select("id", "qualname", "name", F.coalesce("by_q", "by_n", F.lit("")).alias("purpose"))


def batches(items: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """CD-3: batches of `size` in order within each key."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return items.withColumn("batch", F.floor((row - 1) / size).cast("int"))


def greedy_chunks(items: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """CD-4: chunks of consecutive items, closed when the next would go over the limit; never empty.

    A fold in order, as each chunk's start depends on the one before: a key's rows stream
    through one task, which holds its running size only.
    """
    rows = items.select(key, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias("__size")).repartition(key).sortWithinPartitions(key, order, "__size")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held = object(), 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = n or 0
                if k != now:
                    now, chunk, held = k, 0, 0
                elif held > 0 and held + n > limit:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=[key, order, "chunk"])

    return rows.mapInArrow(fold, f"`{key}` {items.schema[key].dataType.simpleString()}, `{order}` long, chunk int")


def coerce_cards(replies: DataFrame, batch: DataFrame) -> DataFrame:
    """CD-5: cards from JSON replies (reply): objects whose file is in the batch; unknown roles become other; texts are trimmed."""
    card = F.from_json("reply", "array<struct<file: string, purpose: string, role: string, lifecycle: string, description: string>>")
    rows = replies.select(F.explode(card).alias("c")).select("c.*")
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    role = F.when(F.trim("role").isin(ROLES), F.trim("role")).otherwise("other").alias("role")
    return rows.join(batch.select("file"), "file", "left_semi").select("file", text("purpose"), role, text("lifecycle"), text("description"))


def merge_chunks(parts: DataFrame) -> DataFrame:
    """CD-7: one card a file from its parts (file, ord, purpose, role, lifecycle, description): the first text of each, descriptions joined."""
    first = lambda cond, c: F.coalesce(F.min_by(c, F.when(cond, F.col("ord"))), F.lit(""))
    said = F.when(F.col("description") != "", F.struct("ord", "description"))
    return parts.groupBy("file").agg(
        first(F.col("purpose") != "", "purpose").alias("purpose"),
        F.coalesce(F.min_by("role", F.when(F.col("role").isin(ROLES), F.col("ord"))), F.lit("other")).alias("role"),
        first(F.col("lifecycle") != "", "lifecycle").alias("lifecycle"),
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["description"]), "\n\n").alias("description"),
    )


def done_cards(cards: DataFrame, detail: str = "brief") -> DataFrame:
    """CD-8: cards that need no new reading: a purpose, and where detail is deep a description."""
    done = F.coalesce(F.col("purpose") != "", F.lit(False))
    if detail == "deep":
        done = done & F.coalesce(F.col("description") != "", F.lit(False))
    return cards.where(done)


def to_read(files: DataFrame, cards: DataFrame, detail: str = "brief") -> DataFrame:
    """CD-8: files without a finished card."""
    return files.join(done_cards(cards, detail).select("file"), "file", "left_anti")


def backfill(files: DataFrame, cards: DataFrame) -> DataFrame:
    """CD-9: a card for every file, empty ones where none was read."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return files.select("file").join(cards, "file", "left").select("file", text("purpose"), F.coalesce("role", F.lit("other")).alias("role"), text("lifecycle"))


def coverage(cards: DataFrame) -> DataFrame:
    """CD-9: files, described files, and how many lack a purpose."""
    return cards.agg(F.count("*").alias("n_files"), F.count_if(F.col("purpose") != "").alias("n_described"), F.count_if(F.col("purpose") == "").alias("n_missing"))


def file_info(profile: DataFrame, cards: DataFrame) -> DataFrame:
    """CD-11: cards with their files' function counts."""
    return cards.join(profile.select("file", "n_functions"), "file", "left").fillna(0, ["n_functions"])


def to_analyse(functions: DataFrame, cache: DataFrame) -> DataFrame:
    """CD-12: functions (qualname, sha1) that the cache (qualname, sha1, output, error) does not answer."""
    good = cache.where("output IS NOT NULL AND error IS NULL").select("qualname", "sha1")
    return functions.join(good, ["qualname", "sha1"], "left_anti")


def cache_index(cache: DataFrame) -> DataFrame:
    """CD-13: entries, and how many have errors."""
    return cache.agg(F.count("*").alias("n_entries"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def dry_run_record(functions: DataFrame) -> DataFrame:
    """CD-14: the record an offline annotator gives a function: a cross-cutting kind by name, and one region if it is over 60 lines long."""
    kind = (
        F.when(F.lower("name").rlike("log|trace|metric"), "crosscut-observability").when(F.lower("name").rlike("error|exception|fail"), "crosscut-errors")
        .when(F.lower("name").rlike("config|setting|option"), "crosscut-config").otherwise("")
    )
    long = F.col("line_end") - F.col("line_start") + 1 > 60
    return functions.select("qualname", kind.alias("crosscut"), F.when(long, 1).otherwise(0).alias("n_regions"))


def source_slice(lines, first, last):
    """CD-15: lines first..last of an array of lines, joined."""
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")
