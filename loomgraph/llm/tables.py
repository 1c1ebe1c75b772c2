"""Tables that outlive an executor: intermediate results in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests on one machine), a new temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


#: most bytes of a batch that goes to a Python worker; Spark's own limit is 64 MB, and several copies exist at once
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Lower the session's limit of Arrow batches to BATCH_BYTES, so that executors hold little outside their heaps."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/loomgraph/{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder, or to `path`, and read it from there; its lineage is cut."""
    spark = df.sparkSession
    bounded(spark)
    path = path or new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path  # type: ignore[attr-defined]
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are done; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete tables of `keep` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "kept_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
