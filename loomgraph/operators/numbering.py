"""Running numbers and sums over a whole table, and sums along pointers, without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> str:
    """The folder that the context or spark.checkpoint.dir names, made the context's.

    Where none is set one is made, on a local master only: on a cluster it has to be shared.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; its lineage is cut."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """df as a table in the shared folder; the one of the round before, which nothing reads any more, goes.

    Rounds don't use checkpoints: what the optimiser knows of a checkpoint's rows is taken
    over into the next, and doubles each round.
    """
    spark, path = df.sparkSession, f"{shared_folder(df)}/numbering-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path  # type: ignore[attr-defined]
    if old is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(old.stored_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


def running(df: DataFrame, order: list[Column], name: str, weight: Column | None = None) -> DataFrame:
    """df with the sum of `weight` over all rows before each in the order; without a weight, their number.

    Rows are dealt out by ranges of the order; sums inside a range start from those of the
    ranges before it, of which the driver holds one number each.  The order should tell all
    rows apart: rows that it doesn't are in one range.
    """
    keys = {f"__by{k}": c for k, c in enumerate(order)}
    weight = F.lit(1) if weight is None else weight
    own = df.withColumns({**keys, "__weight": weight.cast("long")})
    ranged = own.repartitionByRange(*_sorted(order)).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged)  # ranges are sampled, and would not be the same again
    total, before = {}, 0
    for r in sorted(ranged.groupBy("__part").agg(F.sum("__weight").alias("n")).collect(), key=lambda r: r["__part"]):
        total[r["__part"]] = before
        before += r["n"]
    at = F.create_map(*(F.lit(x) for pair in total.items() for x in pair))[F.col("__part")] if total else F.lit(0)
    inside = Window.partitionBy("__part").orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, (at + F.coalesce(F.sum("__weight").over(inside), F.lit(0))).cast("long")).drop(*keys, "__weight", "__part")


def _sorted(order: list[Column]) -> list[Column]:
    return [F.col(f"__by{k}").asc() for k in range(len(order))]


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """df with each row's place in the order, from 1."""
    return running(df, [F.col(c) if isinstance(c, str) else c for c in order], name).withColumn(name, (F.col(name) + 1).cast("int"))


def along(links: DataFrame, sums: dict[str, str], joined: tuple[str, ...] = ()) -> DataFrame:
    """links (id, up and values) with every value summed from the end of the way up to each row, and `top`, where the way ends.

    sums: the SQL type of each value; those in `joined` are texts, put one after another
    instead.  Pointers are doubled: each round a row takes over what the row at its pointer
    has, so a way of n steps is done after log2(n) rounds.  Rows whose way has no end (a
    ring) have a null top.
    """
    state = stored(links.select("id", "up", F.col("id").alias("top"), *sums))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        open_ = state.where("up IS NOT NULL")
        if open_.isEmpty():
            break
        far = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("top").alias("__top"), *(F.col(c).alias(f"__{c}") for c in sums))
        met = open_.join(far, "up")
        step = met.select("id", F.col("__up").alias("up"), F.col("__top").alias("top"), *((F.concat(f"__{c}", c) if c in joined else F.col(f"__{c}") + F.col(c)).alias(c) for c in sums))
        state = stored(state.where("up IS NULL").unionByName(step).repartition("id"), state)  # a union adds up partitions
    return state.withColumn("top", F.when(F.col("up").isNull(), F.col("top"))).drop("up")


def below(links: DataFrame) -> DataFrame:
    """(id, total): the sum of n over each row of links (id, up, n) and all rows whose way up passes it; of a ring's rows their own n.

    Round k adds what the rows 2^k steps below have gathered from their own 2^k levels.
    """
    state = stored(links.select("id", "up", F.col("n").cast("long").alias("total"), F.col("n").cast("long").alias("n")))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        open_ = state.where("up IS NOT NULL")
        if open_.isEmpty():
            break
        gained = open_.groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("more"))
        far = state.select(F.col("id").alias("up"), F.col("up").alias("__up"))
        moved = open_.join(far, "up").select("id", F.col("__up").alias("up"), "total", "n").unionByName(state.where("up IS NULL"))
        state = stored(moved.join(gained, "id", "left").select("id", "up", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), "n").repartition("id"), state)
    return state.select("id", F.when(F.col("up").isNull(), F.col("total")).otherwise(F.col("n")).alias("total"))


def pairs(links: DataFrame) -> DataFrame:
    """(ancestor, id, distance) of links (id, up): every row its own ancestor at distance 0; a ring's rows have no others."""
    ended = along(links.withColumn("n", F.lit(0)), {"n": "int"}).where("top IS NULL").select("id")
    up = stored(links.select("id", "up").join(ended.withColumn("ring", F.lit(True)), "id", "left").select("id", F.when(F.col("ring").isNull(), F.col("up")).alias("up")))
    found, step = stored(up.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("distance"))), 1
    while not (open_ := up.where("up IS NOT NULL")).isEmpty():
        # an ancestor of the row `step` above a row is one of the row, `step` further away
        more = found.select("ancestor", F.col("id").alias("up"), "distance").join(open_, "up").select("ancestor", "id", (F.col("distance") + step).alias("distance"))
        found = stored(found.unionByName(more).repartition("id", "ancestor"), found)
        up = stored(open_.join(up.select(F.col("id").alias("up"), F.col("up").alias("__up")), "up").select("id", F.col("__up").alias("up")), up)
        step *= 2
    return found
