"""What the operators of this subpackage share: tables, staged tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers that share this machine import the package; a cluster gets it by --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system: workers stay, and the next stage's run beside them."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it names the folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagemill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and no lost executor takes it away."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    # Lets Spark delete the shuffle files of what is now written.
    spark.sparkContext._jvm.System.gc()
    return staged


def drop(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in staged:
        if path := vars(df).pop("_staged_at", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for undirected edges (a, b) of longs: the smallest node that links reach.

    Alternates large-star and small-star steps; each is one aggregation to the smallest
    neighbour and one join, so a hot node's neighbours are never gathered.
    Empty edges give an empty table.
    """
    current = stage(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    for _ in range(rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stage(small, "edges")
        # The star graph is a fixed point: every node then has one edge, to a node that is nobody's larger end.
        same = after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty()
        drop(current)
        current = after
        if same:
            break
    else:
        raise RuntimeError("components: no fixed point")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = stage(current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
    drop(current)
    return out
