"""State registers (RE)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import patterns as needles
from . import tree

#: fixed values: words that say what shape a register has, not what it is about
SHAPE_WORDS = "reg state catalog store context policy registry config runtime data id identity set cache buffer profile info metadata snapshot window queue".split()
#: fixed values: names of methods that change their object
MUTATORS = "append pop clear extend insert remove sort update add setdefault discard".split()
#: fixed values: what assigns after a match, subscripts before it; the method that resets
ASSIGNS, RESETS = r"^\s*(?:\[[^\]\[]*\])*\s*(?:[+\-*/%&|^@]|//|\*\*|>>|<<)?=(?!=)", "_reset_per_run_state"


def words_of(column) -> F.Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")


def id_words(ident: F.Column) -> F.Column:
    """The words of a register's id that tell what it is about: over two characters, no shape words."""
    parts = F.split(F.replace(F.lower(ident), F.lit("reg-"), F.lit("")), "-")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(SHAPE_WORDS)))


def normalise(replies: DataFrame, stages: DataFrame) -> DataFrame:
    """RE-1: registers (ord, id, semantics, stages) with trimmed texts; empty ones go, the first of an id stays, unknown stages go."""
    r = replies.select("ord", F.trim("id").alias("id"), F.trim("semantics").alias("semantics"), "stages").where("id <> '' AND semantics <> ''")
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("r = 1").drop("r")
    known = stages.select(F.col("id").alias("stage"))
    kept = (
        r.select("id", F.posexplode("stages").alias("k", "stage")).join(known, "stage")
        .groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "stage"))), lambda s: s["stage"]).alias("stages"))
    )
    return r.drop("stages").join(kept, "id", "left").select("ord", "id", "semantics", F.coalesce("stages", F.array().cast("array<string>")).alias("stages"))


def evidence(cards: DataFrame, most: int = 120) -> DataFrame:
    """RE-3: the first files that hold data models."""
    return cards.where("role = 'data_model'").orderBy("file").limit(most).select("file", "purpose")


def stage_hits(registers: DataFrame) -> DataFrame:
    """RE-4: registers listed on each stage."""
    return registers.select("ord", "id", F.explode("stages").alias("stage"))


def sunk(registers: DataFrame, stages: DataFrame, concepts: DataFrame) -> DataFrame:
    """RE-5: (stage, id, via): registers listed on a stage (via empty), and for leaves those of a stage above whose id
    words, but shape words, meet the leaf's concept words (stage, word); via is the least common word."""
    hits = stage_hits(registers)
    direct = hits.select("stage", "id", F.lit("").alias("via"))
    parents = tree.linked(stages).where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    leaves = stages.select("id").join(parents, "id", "left_anti").withColumnRenamed("id", "leaf")
    named = hits.select("stage", "id", F.explode(id_words(F.col("id"))).alias("word")).distinct()
    # words meet before stages do: a stage's registers are never put beside all leaves below it
    words = concepts.select(F.col("stage").alias("leaf"), "word").distinct().join(leaves, "leaf", "left_semi").join(named.select("word").distinct(), "word", "left_semi")
    above = tree.closure(stages).where("distance > 0").select(F.col("ancestor").alias("stage"), F.col("id").alias("leaf")).join(named.select("stage").distinct(), "stage", "left_semi")
    met = above.join(words, "leaf").join(named, ["stage", "word"])
    sunken = met.groupBy(F.col("leaf").alias("stage"), "id").agg(F.min("word").alias("via"))
    return direct.unionByName(sunken.join(direct.select("stage", "id"), ["stage", "id"], "left_anti"))


def mentions(registers: DataFrame, stages: DataFrame) -> DataFrame:
    """RE-6: registers whose semantics hold a stage's id as a part of the text; the id of another stage may start with it."""
    return needles.found_in(registers.select(F.col("id").alias("register"), "semantics"), "semantics", stages.select(F.col("id").alias("stage")), "stage").select("register", "stage")


def code_sites(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """RE-8: lines (file, line, text) that match a register's pattern (id, pattern), with the method around and the kind of use.

    init or reset where an assignment or a mutating call follows the match inside the
    initialiser or the resetting method, write where it follows elsewhere, else read.
    Methods are those of modules and of classes (four spaces in); a class ends the one
    before it, and `?` stands for none.

    Every text is read once for the literals that the patterns require; only where one is
    found is the pattern itself tried.  A pattern without a literal is tried everywhere.
    """
    named = F.coalesce(*(F.nullif(F.regexp_extract("text", rf"^{indent}(?:async\s+)?def\s+(\w+)", 1), F.lit("")) for indent in ("    ", "")))
    opened = F.coalesce(named, F.when(F.col("text").rlike(r"^class\s+\w+"), "?"))
    w = Window.partitionBy("file").orderBy("line")
    inside = lines.withColumn("method", F.coalesce(F.last(opened, ignorenulls=True).over(w), F.lit("?")))
    wanted = patterns.select("id", "pattern", F.udf(needles.literal_of, "string", useArrow=True)("pattern").alias("literal"))
    hit = needles.found_in(inside, "text", wanted, "literal").join(wanted, "literal").where(F.expr("text RLIKE pattern"))
    after = F.expr("substring(text, regexp_instr(text, pattern) + length(regexp_substr(text, pattern)))")
    write = after.rlike(ASSIGNS) | after.rlike(r"^\.(?:" + "|".join(MUTATORS) + r")\s*\(")
    kind = F.when(~write, "read").when(F.col("method") == "__init__", "init").when(F.col("method") == RESETS, "reset").otherwise("write")
    return hit.select("id", "file", "line", "method", kind.alias("kind"))
