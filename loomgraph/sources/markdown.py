"""Relations out of Markdown (SC): stage headings, tables, plan declarations, chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import numbering

#: fixed values: prefixes of stage ids, and of plan entries
STAGE_ID = r"`((?:stage|side|crosscut)-[^`]*)`"
PLAN_KINDS = ("will_modify", "will_add", "will_remove")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, line, text) of documents (doc, text), lines from 1."""
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def with_heading(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines with the number of the last heading line at or before them that matches; heading marks inside fences don't count."""
    w = Window.partitionBy("doc").orderBy("line")
    fence = F.when(F.col("text").rlike(r"^\s*```"), 1).otherwise(0)
    f = lines.withColumn("inside", F.sum(fence).over(w) % 2 == 1)
    is_head = F.when(~F.col("inside") & F.col("text").rlike(pattern), F.col("line"))
    return f.withColumn("head", F.last(is_head, ignorenulls=True).over(w))


def skeleton(docs: DataFrame) -> DataFrame:
    """SC-12: stages of Markdown: headings of levels 2 to 4 with an id in back ticks; the title is the heading without id
    and dash and the word for its kind; the description is the first paragraph below."""
    lines = with_heading(lines_of(docs), r"^#{2,4} .*" + STAGE_ID).where("head IS NOT NULL")
    heads = lines.where("line = head").select(
        "doc", "head", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.regexp_extract("text", STAGE_ID, 1).alias("id"),
        F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"^#+\s*", ""), r"\s*[—-]?\s*" + STAGE_ID, ""), r"(?i)^(?:stage|side|crosscut)\b[\s\d.:]*", "")).alias("title"),
    )
    w = Window.partitionBy("doc", "head").orderBy("line")
    body = lines.where("line > head").withColumn("stop", F.col("text").rlike(r"^\s*(?:\||---|#)"))
    body = body.withColumn("blank", F.trim("text") == "")
    # the first paragraph: from the first line with text to the next that ends it
    body = body.withColumn("begun", F.coalesce(F.max(~F.col("blank")).over(w), F.lit(False)))
    body = body.withColumn("over", F.max(F.col("begun") & (F.col("blank") | F.col("stop"))).over(w)).where("begun AND NOT over")
    text = body.groupBy("doc", "head").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: F.trim(s["text"])), " ")).alias("description"))
    return heads.join(text, ["doc", "head"], "left").withColumn("description", F.coalesce("description", F.lit("")))


def with_parents(stages: DataFrame) -> DataFrame:
    """SC-14: parents from ids: the id without its last number, where that exists; empty descriptions are named so."""
    ids = stages.select("doc", F.col("id").alias("parent"), F.lit(True).alias("known"))
    s = stages.withColumn("parent", F.regexp_replace("id", r"\.\d+$", "")).join(ids, ["doc", "parent"], "left")
    return s.withColumns({"parent": F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent")), "description": F.coalesce(F.nullif("description", F.lit("")), F.lit("(no description)"))}).drop("known")


def table_rows(docs: DataFrame, prefix: str) -> DataFrame:
    """SC-13, RE-10: rows of tables whose first cell holds an id with the prefix in back ticks: (doc, line, id, cells)."""
    cells = F.filter(F.transform(F.split(F.col("text"), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = lines_of(docs).where(F.col("text").rlike(rf"^\s*\|\s*`?{prefix}-"))
    return rows.select("doc", "line", F.regexp_extract("text", rf"({prefix}-[\w.-]+)", 1).alias("id"), F.slice(cells, 2, 99).alias("cells"))


def heading_tree(docs: DataFrame) -> DataFrame:
    """SC-19: headings (doc, line, level, title) with the line of the last one of a lesser level before them."""
    h = lines_of(docs).where(F.col("text").rlike(r"^#+ ")).select("doc", "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.regexp_extract("text", r"^#+\s*(.*)$", 1).alias("title"))
    p = h.select("doc", F.col("line").alias("p_line"), F.col("level").alias("p_level"))
    up = h.join(p, "doc").where("p_line < line AND p_level < level").groupBy("doc", "line").agg(F.max("p_line").alias("parent_line"))
    return h.join(up, ["doc", "line"], "left")


def index_members(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """SC-20: members of an index: `qualname` (file:a-b) under stage headings; a function where the range is its whole span, else a region; unknown ones are functions."""
    lines = with_heading(lines_of(docs), r"^#+ .*" + STAGE_ID).where("head IS NOT NULL")
    stage = lines.where("line = head").select("doc", "head", F.regexp_extract("text", STAGE_ID, 1).alias("stage"))
    found = lines.select("doc", "head", "line", F.regexp_extract("text", r"`([^`]+)` \(([^:()]+):(\d+)-(\d+)\)", 1).alias("qualname"), *(F.regexp_extract("text", r"`([^`]+)` \(([^:()]+):(\d+)-(\d+)\)", k).alias(n) for k, n in ((2, "file"), (3, "a"), (4, "b")))).where("qualname <> ''")
    m = found.join(stage, ["doc", "head"]).withColumns({"line_start": F.col("a").cast("int"), "line_end": F.col("b").cast("int")})
    s = spans.select("qualname", "file", F.col("line_start").alias("s"), F.col("line_end").alias("e"))
    kind = F.when(F.col("s").isNull() | ((F.col("s") == F.col("line_start")) & (F.col("e") == F.col("line_end"))), "function").otherwise("region")
    return m.join(s, ["qualname", "file"], "left").select("doc", "stage", F.col("line").alias("ord"), "qualname", kind.alias("type"), "file", "line_start", "line_end")


def declarations(docs: DataFrame) -> DataFrame:
    """SC-22: (doc, kind, qualname) of the last fenced JSON block of a plan that names any; broken blocks and entries that are no texts are left out."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)```json\s*\n(.*?)```"), 1)
    good = F.filter(blocks, lambda b: F.coalesce(F.array_size(F.coalesce(*(F.array(F.get_json_object(b, f"$.{k}")) for k in PLAN_KINDS))), F.lit(0)) > 0)
    has = F.filter(good, lambda b: F.coalesce(*(F.get_json_object(b, f"$.{k}") for k in PLAN_KINDS)).isNotNull())
    d = docs.select("doc", F.try_element_at(has, F.lit(-1)).alias("block"))
    # raw JSON texts are told from other values by their quotes
    entry = lambda k: F.transform(F.from_json(F.get_json_object("block", f"$.{k}"), "array<variant>"), lambda v: F.when(F.expr("1 = 1"), v))
    rows = d.select("doc", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), entry(k).alias("names")) for k in PLAN_KINDS))).alias("e"))
    rows = rows.select("doc", "e.kind", F.explode("e.names").alias("v"))
    return rows.where(F.schema_of_variant("v") == "STRING").select("doc", "kind", F.variant_get("v", "$", "string").alias("qualname"))


def chapters(docs: DataFrame) -> DataFrame:
    """PL-1: chapters: level-2 or numbered level-3 headings outside fences, and the lines up to the next: (doc, line, title, text)."""
    lines = with_heading(lines_of(docs), r"^(?:## |### \d)").where("head IS NOT NULL")
    title = lines.where("line = head").select("doc", "head", F.regexp_replace("text", r"^#+\s*", "").alias("title"))
    text = lines.where("line > head").groupBy("doc", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return title.join(text, ["doc", "head"], "left").select("doc", F.col("head").alias("line"), "title", F.coalesce("text", F.lit("")).alias("text"))


def sections(docs: DataFrame, level: int) -> DataFrame:
    """SK-14: (doc, line, title, text): headings of one level outside fences, each with the lines up to the next of that or a higher level."""
    lines = with_heading(lines_of(docs), rf"^#{{1,{level}}} ").where("head IS NOT NULL")
    title = lines.where("line = head").where(F.col("text").rlike(rf"^#{{{level}}} ")).select("doc", "head", F.regexp_replace("text", r"^#+\s*", "").alias("title"))
    text = lines.where("line > head").groupBy("doc", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return title.join(text, ["doc", "head"], "left").select("doc", F.col("head").alias("line"), "title", F.coalesce("text", F.lit("")).alias("text"))


def blurb(text, most: int = 900):
    """PL-2: the paragraph after an Opening Explanation heading, cut to `most` characters at a sentence's end."""
    part = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?si)opening explanation[^\n]*\n+(.*?)(?:\n\s*\n|\z)", 1), r"\s+", " "))
    cut = F.substr(part, F.lit(1), F.lit(most))
    return F.when(F.length(part) <= most, part).otherwise(F.regexp_replace(cut, r"(?s)^(.*[.!?])\s.*$", "$1"))


def rebuilt_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """PL-3: entries of an index (ord, id) with new ones (id, after) put behind the entry they name, else at the end."""
    place = old.select(F.col("id").alias("after"), F.col("ord").cast("double").alias("at"))
    last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).cast("double").alias("last"))
    fresh = new.join(old.select("id"), "id", "left_anti").join(place, "after", "left").crossJoin(F.broadcast(last))  # one row
    rank = F.row_number().over(Window.partitionBy("after").orderBy("id"))
    fresh = fresh.select("id", F.coalesce(F.col("at"), F.col("last") + 1).alias("at"), rank.alias("k"))
    both = old.select("id", F.col("ord").cast("double").alias("at"), F.lit(0).alias("k")).unionByName(fresh)
    return numbering.numbered(both, "at", "k", "id").select("id", "position")


def macros(lines: DataFrame) -> DataFrame:
    """EX-M1: Rust macro definitions of lines (file, line, text)."""
    name = F.regexp_extract("text", r"^\s*macro_rules!\s*(\w+)", 1)
    return lines.select("file", "line", name.alias("name")).where("name <> ''")


def function_headings(docs: DataFrame) -> DataFrame:
    """EX-M2: function headings of stage pages: level-3 or 4 headings of a back-ticked name: (doc, line, name, short)."""
    name = F.regexp_extract("text", r"^#{3,4} .*`([^`]+)`", 1)
    return lines_of(docs).select("doc", "line", name.alias("name"), F.regexp_extract(name, r"([^.:]*)$", 1).alias("short")).where("name <> ''")
