"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode, where none is set, a new temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="amendry-")
    sc.setCheckpointDir(folder)
    return shared_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends here and lost executors cost nothing.

    The shuffle files behind it go as soon as it is written; Spark keeps them until the driver collects garbage otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def beside(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of one's own that none of `columns` has."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        names.append(name)
    return names


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for the places where a number has to be given."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
