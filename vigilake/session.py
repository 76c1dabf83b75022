"""Session settings the library relies on, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options the library relies on; sizing is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a record may hold one key twice once keys are cleaned: the later one counts
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # wide event projections compile to methods the JVM would not optimise (its limit is
    # 8000 bytes of bytecode); past it Spark falls back to many small methods
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # keys that a task combines in a hash table of objects before it sorts; a key holds a count, a
    # number and at most one record text per rule
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "10000")
    # folders are listed by so many tasks; by default each of thousands is a task of its own
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    # a task takes this much of a file for the time to open one: a hundred files are not a task each for
    # three, as with the default
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 * 1024))
    return spark


_OWN_FOLDER = "vigilake.shared.dir"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared folder (``spark.checkpoint.dir``).

    Only where that setting is absent and the master is local, as in tests, a temporary
    folder is made and remembered in the session; elsewhere executors could not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(_OWN_FOLDER, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a small per-file or per-key table to the shared folder and read it back.

    The work behind it runs once, its size becomes known to Spark (which then decides by
    size whether a join may broadcast it), and a lost executor cannot take it along.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
