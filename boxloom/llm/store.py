"""Written intermediate tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where a local session names no spark.checkpoint.dir (tests, notebooks).
LOCAL_DIR = "/tmp/checkpoints/boxloom"
#: Rows and bytes of one Arrow batch handed to Python, at most (a longer row is a batch of its own); they bound a worker's memory.
ARROW_ROWS = 500
ARROW_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application's intermediate tables; only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = LOCAL_DIR
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts lineage in a way that outlives executors, fixes values that a
    re-run could change (generated ids), and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators, for the session: plans read these settings when they run, not when they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
