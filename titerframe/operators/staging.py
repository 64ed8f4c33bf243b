"""Intermediate tables in the cluster's shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether an execution's shuffle files are removed at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session keeps its tables in its own warehouse folder; a cluster's executors do not share
    a folder that we could choose, so there it has to be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written and read back: later passes neither plan nor compute its rows again, nor lose them with an executor.

    The shuffle files of the write go as soon as it is done: nothing reads them again, and else they stay until the driver
    happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstaged(*tables: DataFrame) -> None:
    """Delete tables made by :func:`staged` that nothing reads any more."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove_folder(df.sparkSession, parent)
