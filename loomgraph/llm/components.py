"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, keep


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge, to its root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    state = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return state.agg(F.max(F.expr("out > 1 OR (out = 1 AND into = 1)"))).first()[0] is not True


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    links: pairs of integers in columns `a` and `b`, in either order; repeats and
    self-links change nothing; an empty table gives an empty result.  Every round is
    a written table, so no lineage grows and a lost executor costs one round at most.
    `forget` deletes the table under the result.
    """
    edges = keep(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    while not _is_stars(edges):
        now = keep(_small(_large(edges)).distinct(), "round")
        forget(edges)
        edges = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out.kept_at = edges.kept_at  # type: ignore[attr-defined]
    return out
