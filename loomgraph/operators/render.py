"""Renderers (SK, LO, PL, RE): Markdown and HTML text as expressions over ordered relations, a row a page or block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree

#: fixed values: marks of what is done to a register
ICONS = {"write": "✏️ writes", "read": "👁 reads", "clear": "🧹 clears", "reset": "♻️ resets"}
#: what stands around a block that is put into a page, and is replaced when it is put there again
OPENED, CLOSED = "<!-- enriched -->", "<!-- /enriched -->"


def _said(c: str) -> Column:
    """A column's text, null where it is blank, so that `concat_ws` skips it."""
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def _labelled(label: str, c: str) -> Column:
    return F.concat(F.lit(f"**{label}.** "), _said(c))


def relation_text(item: Column) -> Column:
    """SK-13: a relation given as plain text or as an object with `target` and `why`."""
    target, why = F.get_json_object(item, "$.target"), F.get_json_object(item, "$.why")
    return F.when(target.isNotNull(), F.concat_ws(" — ", F.concat(F.lit("`"), target, F.lit("`")), why)).otherwise(item)


def action_mark(action: Column) -> Column:
    """SK-13: the mark of an action; one without a mark stands for itself, none is a question mark."""
    out = F.coalesce(F.nullif(action, F.lit("")), F.lit("?"))
    for name, mark in ICONS.items():
        out = F.when(action == name, mark).otherwise(out)
    return out


def interactions_text(items: Column) -> Column:
    """SK-13: interactions (array of action, register, note) on one line."""
    note = lambda i: F.when(F.coalesce(i["note"], F.lit("")) != "", F.concat(F.lit(" — "), i["note"])).otherwise("")
    return F.array_join(F.transform(F.coalesce(items, F.array().cast("array<struct<action:string,register:string,note:string>>")), lambda i: F.concat(action_mark(i["action"]), F.lit(" `"), F.coalesce(i["register"], F.lit("")), F.lit("`"), note(i))), "; ")


def function_cards(functions: DataFrame) -> DataFrame:
    """SK-7: (file, ord, id, text): a Markdown card a function; blank fields have no line.

    functions: file, ord, id, qualname, purpose, data_flow, relations.
    """
    text = F.concat_ws("\n\n", F.concat(F.lit("### `"), "qualname", F.lit("`")), _said("purpose"), _labelled("Data flow", "data_flow"), _labelled("Relations", "relations"))
    return functions.select("file", "ord", "id", text.alias("text"))


def file_cards(cards: DataFrame, functions: DataFrame) -> DataFrame:
    """SK-7: (file, text): a file's heading, purpose, role, lifecycle and description, then its functions' cards in order."""
    own = function_cards(functions).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "text"))), lambda s: s["text"]), "\n\n").alias("cards"))
    head = F.concat(F.lit("## `"), "file", F.lit("`"))
    text = F.concat_ws("\n\n", head, _said("purpose"), _labelled("Role", "role"), _labelled("Lifecycle", "lifecycle"), _said("description"), _said("cards"))
    return cards.join(own, "file", "left").select("file", text.alias("text"))


def stage_pages(stages: DataFrame, files: DataFrame) -> DataFrame:
    """SK-6: (id, position, text): a page a stage in walking order: heading by depth, description, a line a file (stage, position, file, purpose)."""
    line = F.concat(F.lit("- `"), "file", F.lit("`"), F.coalesce(F.concat(F.lit(": "), _said("purpose")), F.lit("")))
    own = files.select(F.col("stage").alias("id"), "position", line.alias("line")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n").alias("files"))
    walk = tree.pre_order(stages).select("id", "heading", F.col("position").alias("at"))
    head = F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "), F.coalesce(_said("title"), F.col("id")), F.lit(" — `"), "id", F.lit("`"))
    return stages.join(walk, "id").join(own, "id", "left").select("id", F.col("at").alias("position"), F.concat_ws("\n\n", head, _said("description"), _said("files")).alias("text"))


def page_lines(stages: DataFrame, files: DataFrame) -> DataFrame:
    """SK-6, as lines: (page, part, position, file, text): the lines of all stage pages, in order of page, part, position and file.

    No page is one value, so a stage may have any number of files; `exports.write_lines` writes them.
    """
    walk = tree.pre_order(stages).select("id", "heading", F.col("position").alias("page"))
    s = stages.join(walk, "id")
    head = F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "), F.coalesce(_said("title"), F.col("id")), F.lit(" — `"), "id", F.lit("`"))
    none = (F.lit(0).cast("long").alias("position"), F.lit("").alias("file"))
    line = F.concat(F.lit("- `"), "file", F.lit("`"), F.coalesce(F.concat(F.lit(": "), _said("purpose")), F.lit("")))
    return (
        s.select("page", F.lit(0).alias("part"), *none, head.alias("text"))
        .unionByName(s.where(_said("description").isNotNull()).select("page", F.lit(1).alias("part"), *none, _said("description").alias("text")))
        .unionByName(files.join(s.select(F.col("id").alias("stage"), "page"), "stage").select("page", F.lit(2).alias("part"), F.col("position").cast("long").alias("position"), "file", line.alias("text")))
    )


def index_lines(stages: DataFrame) -> DataFrame:
    """SK-6: (position, text): an indented line a stage, in walking order."""
    walk = tree.pre_order(stages).select("id", "depth", "position")
    return stages.join(walk, "id").select("position", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.coalesce(_said("title"), F.col("id")), F.lit(" (`"), "id", F.lit("`)")).alias("text"))


def toc(headings: DataFrame) -> DataFrame:
    """SK-10: (doc, line, text): contents lines of headings (doc, line, level, title, slug), indented from level 2."""
    return headings.select("doc", "line", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 2, F.lit(0))), F.lit("- ["), "title", F.lit("](#"), "slug", F.lit(")")).alias("text"))


def locator_blocks(stages: DataFrame, signals: DataFrame) -> DataFrame:
    """LO-11: (id, text): what helps to find a stage's code; a field is there only where its signal is.

    signals: id, entry (text), core, concepts, registers, confused (arrays of text).
    """
    field = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Stage `"), "id", F.lit("`")), F.concat(F.lit("Entry: "), _said("entry")), field("Core files", "core"), field("Concepts", "concepts"), field("Registers", "registers"), field("Not to be confused with", "confused"),
    )
    return stages.select("id").join(signals, "id", "left").select("id", text.alias("text"))


def how_to_use(n_stages: int, n_files: int) -> str:
    """LO-16: a short guide before the locator pages."""
    return f"Start from the stage whose title fits the task ({n_stages} stages, {n_files} files). Read its locator block, open its core files, then follow the relations of the functions you change."


def locator_only(text: Column) -> Column:
    """PL-4: a card cut to its heading, first paragraph and Relations line."""
    head = F.regexp_extract(text, r"^(#+ [^\n]*)", 1)
    first = F.regexp_extract(text, r"(?s)^#+ [^\n]*\n\n(?!\*\*)(.*?)(?:\n\n|\z)", 1)
    relations = F.regexp_extract(text, r"(?m)^(\*\*Relations\.\*\*.*)$", 1)
    return F.concat_ws("\n\n", *(F.nullif(x, F.lit("")) for x in (head, first, relations)))


def enriched(text: Column, addition: Column) -> Column:
    """RE-9: a register's block with the addition below its heading, in place of one put there before; putting it twice changes nothing."""
    bare = F.regexp_replace(text, rf"(?s)\n{OPENED}.*?{CLOSED}", "")
    # a replacement text is taken as it stands
    literal = F.replace(F.replace(addition, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    block = F.concat(F.lit(f"$1\n{OPENED}\n"), literal, F.lit(f"\n{CLOSED}"))
    return F.when(addition.isNull(), bare).otherwise(F.regexp_replace(bare, F.lit(r"^(### reg-[^\n]*)"), block))


def register_index(docs: DataFrame) -> DataFrame:
    """RE-10: (doc, name, purpose): `### reg-...` headings with the first line below."""
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^### `?(reg-[\w.-]+)`?[^\n]*\n+([^\n]*)"), 0)
    pattern = r"(?s)^### `?(reg-[\w.-]+)`?[^\n]*\n+([^\n]*)"
    return docs.select("doc", F.explode(lines).alias("l")).select("doc", F.regexp_extract("l", pattern, 1).alias("name"), F.regexp_extract("l", pattern, 2).alias("purpose"))


def top_level(stages: DataFrame) -> DataFrame:
    """TR-19: stages at the top, as JSON texts in order (ord, json)."""
    return tree.linked(stages).where("parent IS NULL").select("ord", F.to_json(F.struct("id", "title", "description")).alias("json"))


def demoted(text: Column, by: int = 2) -> Column:
    """QS-10: headings `by` levels lower, six at most."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x: F.when(x.rlike("^#+ "), F.concat(F.repeat(F.lit("#"), F.least(F.length(F.regexp_extract(x, "^(#+)", 1)) + by, F.lit(6))), F.regexp_replace(x, "^#+", ""))).otherwise(x),
    )
    return F.array_join(lines, "\n")


def repaired_card(card: Column, version: int = 1) -> Column:
    """CH-23: a JSON card made complete without asking again: `schema_version` where it lacks, and `(none)` for an empty list of relations; null where it is no object."""
    fields = F.from_json(card, "map<string, string>")
    none = F.lit('["(none)"]')
    relations = F.when(F.coalesce(fields["relations"], F.lit("[]")).isin("[]", ""), none).otherwise(fields["relations"])
    told = F.struct(F.coalesce(fields["schema_version"], F.lit(str(version))).alias("schema_version"), fields["purpose"].alias("purpose"), fields["data_flow"].alias("data_flow"), F.from_json(relations, "array<string>").alias("relations"))
    return F.when(fields.isNotNull() & (F.size(fields) > 0), F.to_json(told))


def card_path(file: Column) -> Column:
    """CH-24: where a file's card lies, mirroring the tree."""
    return F.concat(F.lit("cards/"), file, F.lit(".json"))


def html_lines(lines: DataFrame) -> DataFrame:
    """SK-8: (doc, line, html) of Markdown lines (doc, line, text): headings, list items, rules and paragraphs, with code and bold inside."""
    t = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = F.regexp_replace(F.regexp_replace(t, "`([^`]+)`", "<code>$1</code>"), r"\*\*(.+?)\*\*", "<b>$1</b>")
    level = F.length(F.regexp_extract("text", "^(#{1,6}) ", 1)).cast("string")
    html = (
        F.when(F.col("text").rlike("^#{1,6} "), F.concat(F.lit("<h"), level, F.lit(">"), F.regexp_replace(t, "^#+ ", ""), F.lit("</h"), level, F.lit(">")))
        .when(F.col("text").rlike(r"^\s*- "), F.concat(F.lit("<li>"), F.regexp_replace(t, r"^\s*- ", ""), F.lit("</li>"))).when(F.col("text").rlike("^---+$"), "<hr>")
        .when(F.trim("text") == "", "").otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    )
    return lines.select("doc", "line", html.alias("html"))
