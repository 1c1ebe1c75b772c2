"""Hierarchy operators (TR): closure, depth, counts, numbering, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import numbering

def linked(stages: DataFrame) -> DataFrame:
    """TR-1: stages with parents that exist; the rest are at the top.  Children keep the stages' order."""
    ids = stages.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return stages.join(ids, "parent", "left").withColumn("parent", F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent"))).drop("known")


def _links(stages: DataFrame) -> DataFrame:
    return linked(stages).select("id", F.col("parent").alias("up"), "ord")


def depths(stages: DataFrame) -> DataFrame:
    """TR-4: (id, depth, top): steps from the top-level stage above each; stages in a ring, and below one, count as top-level."""
    found = numbering.along(_links(stages).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)), {"depth": "int"})
    return found.select("id", F.when(F.col("top").isNull(), 0).otherwise(F.col("depth")).alias("depth"), F.coalesce("top", "id").alias("top"))


def _rooted(stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, up, ord) without rings, and `depths`."""
    d = numbering.settle(depths(stages))
    links = _links(stages).join(d, "id")
    return links.select("id", F.when(F.col("depth") > 0, F.col("up")).alias("up"), "ord"), d


def closure(stages: DataFrame) -> DataFrame:
    """TR-5: (ancestor, id, distance), every stage its own ancestor at distance 0."""
    return numbering.pairs(_links(stages))


def subtree_counts(stages: DataFrame, file_stage: DataFrame) -> DataFrame:
    """TR-2: files of each stage and all below it."""
    n = file_stage.groupBy(F.col("stage").alias("id")).agg(F.count("*").alias("n"))
    own = _links(stages).join(n, "id", "left").select("id", "up", F.coalesce("n", F.lit(0)).alias("n"))
    return numbering.below(own).select("id", F.col("total").alias("n_files"))


def direct_files(file_stage: DataFrame, organised: DataFrame) -> DataFrame:
    """TR-3: files of a stage: in organised order (stage, file, position) where there is one, else by name."""
    has = organised.select("stage").distinct().withColumn("has", F.lit(True))
    plain = file_stage.join(has, "stage", "left").where("has IS NULL").select("stage", "file", (F.row_number().over(Window.partitionBy("stage").orderBy("file")) - 1).alias("position"))
    return organised.select("stage", "file", "position").unionByName(plain)


def chain_test(groups: DataFrame, stages: DataFrame) -> DataFrame:
    """TR-6: groups (key, id) whose members are one stage and stages below it: (key, n, chain)."""
    g = groups.select("key", "id").distinct()
    size = g.groupBy("key").agg(F.count("*").alias("n"))
    above = closure(stages).where("distance > 0")
    pairs = g.select("key", F.col("id").alias("ancestor")).join(above, "ancestor").join(g, ["key", "id"]).groupBy("key", "ancestor").agg(F.count("*").alias("m"))
    most = pairs.groupBy("key").agg(F.max("m").alias("m"))
    return size.join(most, "key", "left").select("key", "n", (F.coalesce("m", F.lit(0)) == F.col("n") - 1).alias("chain"))


def _walk(stages: DataFrame, rank) -> DataFrame:
    """(id, depth, top, position): each stage before those below it, which are in their order; stages at the top by `rank` of them first.

    A stage's place is its parent's, and what stands before it among its siblings with all that is below them.
    """
    links, d = _rooted(stages)
    size = numbering.below(links.withColumn("n", F.lit(1)))
    first = F.when(F.col("up").isNull(), rank).otherwise(0)
    before = numbering.running(links.join(size, "id"), [F.coalesce("up", F.lit("")), F.col("up").isNotNull(), first, F.col("ord"), F.col("id")], "before", F.col("total"))
    least = before.groupBy(F.col("up").alias("of")).agg(F.min("before").alias("least"))
    own = before.join(least, F.equal_null("up", "of")).select("id", "up", (F.col("before") - F.col("least") + 1).alias("position"))
    return numbering.along(own, {"position": "long"}).select("id", F.col("position").cast("int").alias("position")).join(d, "id")


def pre_order(stages: DataFrame) -> DataFrame:
    """TR-7: walk with heading levels (two more than the depth, six at most)."""
    return _walk(stages, F.lit(0)).select("id", "depth", F.least(F.col("depth") + 2, F.lit(6)).alias("heading"), "position")


def render_order(stages: DataFrame) -> DataFrame:
    """TR-8: top-level stages with all below them, then side stages, then cross-cutting ones and subsystems."""
    rank = F.when(F.col("id").startswith("stage-"), 0).when(F.col("id").startswith("side-"), 1).otherwise(2)
    return _walk(stages, rank).select("id", "position")


def chapter_numbers(stages: DataFrame) -> DataFrame:
    """TR-9: numbers without gaps by place in the tree, for top-level stages (id stage-...) and all below them."""
    links, d = _rooted(stages)
    group = F.struct(F.col("up"), (F.col("up").isNull() & F.col("id").startswith("stage-")).alias("top"))
    ranked = numbering.running(links.withColumn("group", group), [F.col("group"), F.col("ord"), F.col("id")], "k")
    least = ranked.groupBy(F.col("group").alias("of")).agg(F.min("k").alias("least"))
    number = (F.col("k") - F.col("least") + 1).cast("string")
    own = ranked.join(least, F.equal_null("group", "of")).select("id", "up", F.when(F.col("up").isNull(), number).otherwise(F.concat(F.lit("."), number)).alias("chapter"))
    found = numbering.along(own, {"chapter": "string"}, joined=("chapter",))
    return found.where(F.col("top").startswith("stage-")).select("id", "chapter")


def cache_key(*parts) -> F.Column:
    """TR-12: 12 hexadecimal digits over the parts."""
    return F.substr(F.sha1(F.concat(*parts)), F.lit(1), F.lit(12))


def with_content(stages: DataFrame, file_stage: DataFrame) -> DataFrame:
    """TR-13: stages that have children or files."""
    parents = linked(stages).where("parent IS NOT NULL").select(F.col("parent").alias("id"))
    return stages.join(parents.unionByName(file_stage.select(F.col("stage").alias("id"))).distinct(), "id", "left_semi")


def neighbours(stages: DataFrame) -> DataFrame:
    """TR-14: the stages before and after each in render order."""
    o = numbering.settle(render_order(stages))
    side = lambda by, name: o.select((F.col("position") + by).alias("position"), F.col("id").alias(name))
    return o.join(side(1, "before"), "position", "left").join(side(-1, "after"), "position", "left").select("id", "position", "before", "after")


def breadcrumbs(stages: DataFrame) -> DataFrame:
    """TR-15: titles from the top down to each stage."""
    links, _ = _rooted(stages)
    title = F.when(F.col("up").isNull(), F.col("title")).otherwise(F.concat(F.lit(" / "), "title"))
    return numbering.along(links.join(stages.select("id", "title"), "id").select("id", "up", title.alias("trail")), {"trail": "string"}, joined=("trail",)).select("id", "trail")


def landing_totals(stages: DataFrame, file_stage: DataFrame) -> DataFrame:
    """TR-16: stages, and files over all top-level stages."""
    tops = linked(stages).where("parent IS NULL").select("id")
    return stages.agg(F.count("*").alias("n_stages")).crossJoin(subtree_counts(stages, file_stage).join(tops, "id", "left_semi").agg(F.sum("n_files").alias("n_files")))  # one row each


def accessors(stages: DataFrame) -> DataFrame:
    """TR-17: titles that fall back to ids, flags that fall back to false."""
    return stages.select("id", F.coalesce(F.nullif("title", F.lit("")), "id").alias("title"), F.coalesce("crosscut", F.lit(False)).alias("crosscut"))


def briefs(stages: DataFrame, cut: int = 200) -> DataFrame:
    """TR-18: top-level stages with their chapter and a cut description."""
    return linked(stages).where("parent IS NULL").join(chapter_numbers(stages), "id", "left").select("id", "chapter", F.substr("description", F.lit(1), F.lit(cut)).alias("brief"))
