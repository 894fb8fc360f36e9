"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the execution that wrote them ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder; a cluster without it
    gets a folder in the warehouse, which is shared as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="terrafold-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and frees its shuffle files.

    In zstd, which takes two thirds of the default's space for texts: tables stay beside the shuffles of later steps.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in written:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
