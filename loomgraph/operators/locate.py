"""Locator queries (LO): which stage or file to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tree
from .nav import dirname

#: fixed values: words of titles that tell nothing
GENERIC = (
    "mod lib main src rs errors error tests test common types type util utils helpers helper win unix core the and for of to a an with "
    "support services service startup runtime shared cross cutting local data user system management handling primitives miscellaneous small libraries library"
).split()
#: fixed values: roles in the order in which core files are named; roles not listed come last
CORE_ROLES = "entrypoint orchestration domain_logic data_model io adapter config util test".split()
LEAST_DF, MOST_DF, MOST_CORE, MOST_ENTRIES = 2, 6, 6, 8


def file_stages(buckets: DataFrame) -> DataFrame:
    """LO-1: the stage of each file (stage_ord, stage, file); of several the last."""
    return buckets.groupBy("file").agg(F.max_by("stage", F.struct("stage_ord", "stage")).alias("stage"))


def twins(files: DataFrame) -> DataFrame:
    """LO-2: test files beside their source: the same directory, and the stem with _tests.rs or _test.rs."""
    stem = F.regexp_replace("file", r"\.rs$", "")
    pairs = files.select("file", F.explode(F.array(F.concat(stem, F.lit("_tests.rs")), F.concat(stem, F.lit("_test.rs")))).alias("twin"))
    return pairs.join(files.select(F.col("file").alias("twin")), "twin", "left_semi")


def title_tokens(title: Column) -> Column:
    """LO-3: distinct words of a title of over two characters, but generic ones."""
    return F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(GENERIC)))


def token_df(stages: DataFrame) -> DataFrame:
    """LO-4: in how many stages' titles each word is."""
    return stages.select("id", F.explode(title_tokens(F.col("title"))).alias("word")).groupBy("word").agg(F.countDistinct("id").alias("df"))


def collisions(stages: DataFrame) -> DataFrame:
    """LO-5: words of 2 to 6 stages that are not all one above the other: (word, df, stages in order)."""
    tokens = stages.select("ord", "id", F.explode(title_tokens(F.col("title"))).alias("word")).distinct()
    few = tokens.groupBy("word").agg(F.count("*").alias("df"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("stages"))
    few = few.where(F.col("df").between(LEAST_DF, MOST_DF))
    chains = tree.chain_test(few.select(F.col("word").alias("key"), F.explode("stages").alias("id")), stages).where("chain").select(F.col("key").alias("word"))
    return few.join(chains, "word", "left_anti")


def stage_collisions(found: DataFrame) -> DataFrame:
    """LO-6: per stage its colliding words."""
    return found.select("word", "df", F.explode("stages").alias("stage")).groupBy("stage").agg(F.sort_array(F.collect_list("word")).alias("words"))


def exemplars(groups: DataFrame) -> DataFrame:
    """LO-7: of each group (stage, g_ord) the file with most functions, of equals the first; none where all have 0."""
    return groups.where("n_functions > 0").groupBy("stage", "g_ord").agg(F.max_by("file", F.struct("n_functions", -F.col("f_ord"))).alias("file"))


def entry_concepts(files: DataFrame) -> DataFrame:
    """LO-8: the first eight distinct telling stems of a stage's files (stage, position, file)."""
    stem = F.lower(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    seen = files.withColumn("stem", stem).where(~F.col("stem").isin(GENERIC) & (F.col("stem") != "")).groupBy("stage", "stem").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("stage").orderBy("position", "stem"))
    top = seen.withColumn("rank", rank).where(F.col("rank") <= MOST_ENTRIES)
    return top.groupBy("stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stem"))), lambda s: s["stem"]).alias("concepts"))


def core_files(files: DataFrame) -> DataFrame:
    """LO-9: six files a stage, by role, functions (most first) and path.  io and adapter are no roles of the vocabulary; io_transport, generated and other rank last."""
    priority = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CORE_ROLES)), F.col("role")), F.lit(0)), F.lit(99))
    w = Window.partitionBy("stage").orderBy(priority, F.desc("n_functions"), "file")
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_CORE).select("stage", "rank", "file", "role", "n_functions")


def duty_line(text: Column) -> Column:
    """LO-10: the first paragraph on one line."""
    return F.trim(F.replace(F.split_part(text, F.lit("\n\n"), F.lit(1)), F.lit("\n"), F.lit(" ")))


def ambiguous_names(mentions: DataFrame, functions: DataFrame) -> DataFrame:
    """LO-12: mentioned names (token) with several functions of that full name, or none and several of that short name."""
    full = functions.groupBy(F.col("qualname").alias("token")).agg(F.countDistinct("id").alias("n_full"))
    short = functions.groupBy(F.col("name").alias("token")).agg(F.countDistinct("id").alias("n_short"))
    m = mentions.select("token").distinct().join(full, "token", "left").join(short, "token", "left").fillna(0, ["n_full", "n_short"])
    return m.where("n_full > 1 OR (n_full = 0 AND n_short > 1)")


def resolve_links(mentions: DataFrame, functions: DataFrame, macros: DataFrame, external: DataFrame) -> DataFrame:
    """LO-13: where a mentioned name (page, file, self, token) leads: itself, a macro, the same file, the only function of that name, the page on ambiguous names, a page outside, or nowhere."""
    f = functions.select("qualname", "name", "file", "id")
    names = f.select(F.explode(F.array_distinct(F.array("qualname", "name"))).alias("token"), "file", "id").distinct()
    same = names.groupBy("token", "file").agg(F.count("*").alias("n_same"), F.min("id").alias("same_id"))
    anywhere = names.groupBy("token").agg(F.count("*").alias("n_all"), F.min("id").alias("only_id"))
    macro = macros.groupBy(F.col("name").alias("token")).agg(F.count("*").alias("n_macro"))
    outside = external.select(F.col("name").alias("token"), "url")
    m = mentions.join(macro, "token", "left").join(same, ["token", "file"], "left").join(anywhere, "token", "left").join(outside, "token", "left")
    kind = (
        F.when(F.col("token") == F.col("self"), "self").when(F.col("token").endswith("!") & F.col("url").isNotNull(), "external").when(F.col("n_macro") == 1, "macro")
        .when(F.col("n_same") == 1, "file").when(F.col("n_all") == 1, "global").when(F.col("n_all") > 1, "ambiguous").when(F.col("url").isNotNull(), "external").otherwise("plain")
    )
    return m.select("page", "token", kind.alias("kind"), F.when(kind == "file", F.col("same_id")).when(kind == "global", F.col("only_id")).when(kind == "external", F.col("url")).alias("target"))


def unique_short_names(functions: DataFrame) -> DataFrame:
    """LO-14: short names that only one function of a file has."""
    return functions.groupBy("file", "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def documented(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """LO-15: mentioned files that exist."""
    return mentions.select("file").distinct().join(files.select("file"), "file", "left_semi")


def same_dir(a: Column, b: Column) -> Column:
    return dirname(a) == dirname(b)
