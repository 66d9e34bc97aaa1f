"""Intermediate tables that are read more than once, and inputs of few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("name a shared folder in spark.checkpoint.dir: executors cannot read a folder of the driver's machine")
            import tempfile  # one process, as in tests

            folder = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there; losing an executor loses none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as tasks run at once; only a scan of fewer splits than that is moved, hence never a large one."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
