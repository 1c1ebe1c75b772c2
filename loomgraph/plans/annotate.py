"""External text generation as a relation (LM-3): requests joined with replies, or answered by an offline annotator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_key(*parts):
    """Key of a request: a hash of all that its answer depends on."""
    return F.sha1(F.concat_ws("\x1f", *parts))


def annotate(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """requests (request_key, ...) with their reply, null where there is none."""
    return requests.join(replies.groupBy("request_key").agg(F.max("reply").alias("reply")), "request_key", "left")


def heuristic_cards(files: DataFrame, profile: DataFrame) -> DataFrame:
    """Cards (file, purpose, role, lifecycle, description) of an offline annotator: the role from the path, the purpose from names and counts."""
    f = files.select("file").join(profile.select("file", "n_functions"), "file", "left").fillna(0, ["n_functions"])
    stem = F.lower(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    role = (
        F.when(F.lower("file").rlike("(^|/)tests?/|_test|test_"), "test").when(stem.rlike("^(main|cli|__main__|app)$"), "entrypoint").when(stem.rlike("config|setting"), "config")
        .when(stem.rlike("model|schema|types"), "data_model").when(stem.rlike("client|http|io|socket|transport"), "io_transport").when(stem.rlike("util|helper"), "util")
        .when(F.col("n_functions") == 0, "other").otherwise("domain_logic")
    )
    purpose = F.concat(F.lit("Defines "), "n_functions", F.lit(" functions of "), stem, F.lit("."))
    return f.select("file", purpose.alias("purpose"), role.alias("role"), F.lit("runtime").alias("lifecycle"), F.lit("").alias("description"))


def heuristic_stages(cards: DataFrame) -> DataFrame:
    """One stage a top-level directory, in order of name."""
    from pyspark.sql import Window

    top = F.when(F.contains("file", F.lit("/")), F.split_part("file", F.lit("/"), F.lit(1))).otherwise("root")
    d = cards.select(top.alias("dir")).distinct().withColumn("ord", F.row_number().over(Window.orderBy("dir")) - 1)
    return d.select(F.col("ord").cast("long").alias("ord"), F.concat(F.lit("stage-"), F.col("ord") + 1).alias("id"), F.col("dir").alias("title"), F.concat(F.lit("Files of "), "dir").alias("description"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("crosscut"))


def heuristic_assignment(cards: DataFrame, stages: DataFrame) -> DataFrame:
    """Files to the stage whose title is their top-level directory."""
    top = F.when(F.contains("file", F.lit("/")), F.split_part("file", F.lit("/"), F.lit(1))).otherwise("root")
    return cards.select("file", top.alias("title")).join(stages.select("title", F.col("id").alias("stage")), "title").select("file", "stage", F.array().cast("array<string>").alias("also"))
