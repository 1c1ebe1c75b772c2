"""Drafts by dialogue (AS-5): a table of turns, whose open tool calls are answered by joins, until a draft comes.

All sessions go on together: a round asks the writer for the next turn of every open
session, with what has been said so far as the request; calls in the replies are answered
by the tools, which are functions of relations; a draft closes its session.  Requests
have keys, so a run that stopped goes on from the replies it has.  Sessions without a
draft after the last round get one by a single request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_block import extract_json
from ..operators.numbering import settle
from .annotate import request_key
from .drivers import Writer, ask

#: a tool answers calls (session, argument) with results (session, result)
Tool = Callable[[DataFrame], DataFrame]
#: fixed values: the call that hands in a draft; most rounds
PROPOSE, MOST = "propose_skeleton", 12
_TURNS = "session string, n int, role string, text string"


def converse(sessions: DataFrame, tools: dict[str, Tool], replies: DataFrame, write: Writer | None = None, once: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(drafts, turns) of sessions (session, task).

    drafts: session, stages (a JSON list), how (`agent` or `oneshot`).  A reply is a JSON
    object with `tool` and `argument`, alone or in a text; a proposal's argument is a list
    of stages, and an empty one, an unknown tool or a reply that is none is answered with
    an error, after which the session goes on.  `once` makes requests (session, text) for sessions
    that end without a draft; a session without any reply has no row.
    """
    spark = sessions.sparkSession
    turns = settle(sessions.select("session", F.lit(0).alias("n"), F.lit("task").alias("role"), F.col("task").alias("text")))
    drafts = spark.createDataFrame([], "session string, stages string, how string")
    for k in range(most):
        open_ = turns.join(drafts.select("session"), "session", "left_anti")
        said = F.array_sort(F.collect_list(F.struct("n", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))))  # two a round at most
        asked = open_.groupBy("session").agg(F.array_join(F.transform(said, lambda s: s["line"]), "\n\n").alias("text"), F.max("n").alias("last")).where(F.col("last") == 2 * k)
        asked = settle(asked.withColumn("request_key", request_key("text")))
        answered, replies = ask(asked, replies, write)
        told = settle(answered.where("reply IS NOT NULL").withColumn("json", extract_json(F.col("reply"))).select(
            "session", "reply", F.get_json_object("json", "$.tool").alias("tool"), F.get_json_object("json", "$.argument").alias("argument")))
        if told.isEmpty():
            break
        stages = F.from_json("argument", "array<string>")
        proposed = told.where((F.col("tool") == PROPOSE) & (F.coalesce(F.size(stages), F.lit(0)) > 0))
        drafts = settle(drafts.unionByName(proposed.select("session", F.col("argument").alias("stages"), F.lit("agent").alias("how"))))
        rest = told.join(proposed.select("session"), "session", "left_anti")
        results = [rest.where(F.col("tool").isNull() | ~F.col("tool").isin(PROPOSE, *tools)).select("session", F.concat(F.lit("error: no such tool: "), F.coalesce("tool", F.lit("none"))).alias("text"))]
        results.append(rest.where(F.col("tool") == PROPOSE).select("session", F.lit("error: stages must be a non-empty array").alias("text")))
        for name, tool in tools.items():
            calls = rest.where(F.col("tool") == name).select("session", "argument")
            result = tool(calls).select("session", F.col("result").alias("text"))
            results.append(calls.select("session").join(result, "session", "left").withColumn("text", F.coalesce("text", F.lit("error: nothing found"))))
        answers = results[0]
        for r in results[1:]:
            answers = answers.unionByName(r)
        new = told.select("session", F.lit(2 * k + 1).alias("n"), F.lit("writer").alias("role"), F.col("reply").alias("text")).unionByName(answers.select("session", F.lit(2 * k + 2).alias("n"), F.lit("result").alias("role"), "text"))
        turns = settle(turns.unionByName(new).repartition("session"))
    left = sessions.select("session").join(drafts.select("session"), "session", "left_anti")
    if once is not None and not left.isEmpty():
        asked = settle(once(left).select("session", "text").withColumn("request_key", request_key("text")))
        answered, replies = ask(asked, replies, write)
        argument = F.get_json_object(extract_json(F.col("reply")), "$.stages")
        drafts = drafts.unionByName(answered.where(F.size(F.from_json(argument, "array<string>")) > 0).select("session", argument.alias("stages"), F.lit("oneshot").alias("how")))
    return drafts, turns


def orientation(rollup: DataFrame) -> Tool:
    """The tool that tells a session (a directory's name) its directory's line, of (dir, line)."""
    return lambda calls: calls.join(rollup.select(F.col("dir").alias("session"), F.col("line").alias("result")), "session")
