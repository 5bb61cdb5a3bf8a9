"""Writers. Existing output is skipped by an anti join, completion is Spark's _SUCCESS."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.rng import uniform

from boxloom.operators.assemble import not_done

from .keyed import ArrowSink


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (spark.checkpoint.dir); only a local session may be without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "/tmp/checkpoints/boxloom"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; this cuts lineage in a way that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def pending(work: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Work without output under the path; take it before the expensive step."""
    spark = work.sparkSession
    if not exists(spark, path):
        return work
    done = spark.read.json(path, schema=work.select(*keys).schema)
    return not_done(work, done, list(keys))


def append_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).json(path)


def overwrite_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_samples(df: DataFrame, path: str) -> None:
    """Resampled records by replica."""
    overwrite_json(df, path, ["sub_sample"])


def write_verdicts(df: DataFrame, path: str) -> None:
    overwrite_json(df, f"{path}/vlm_check_update")


def first_images(df: DataFrame, path: str, n: int = 1000, key: str = "image_key") -> None:
    """The first n images by key, for looking at."""
    df.orderBy(key).limit(n).write.mode("overwrite").parquet(path)


def transcripts(df: DataFrame, path: str, n: int = 501, key: str = "new_key") -> None:
    """The first n dialogs with their answers as text."""
    lines = F.concat_ws("\n", F.concat(F.lit("# "), F.col(key)), F.array_join(F.transform("dialog", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n"), F.concat(F.lit("answer: "), F.coalesce("answer", F.lit(""))))
    df.orderBy(key).limit(n).select(lines.alias("value")).write.mode("overwrite").text(path)


def run_metadata(spark: SparkSession, path: str, **values: str) -> None:
    """Prompts and configuration of a run, with its time."""
    row = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("at"), *[F.lit(v).alias(k) for k, v in values.items()])
    row.write.mode("append").json(path)


def seeds(spark: SparkSession, n: int, seed: int = 0, most: int = 2**31 - 1) -> DataFrame:
    return spark.range(n).select(F.floor(uniform(seed, F.lit("seed"), "id") * most).cast("string").alias("value"))


def ratios(spark: SparkSession, n: int, low: float = 0.3, high: float = 0.5, seed: int = 0) -> DataFrame:
    return spark.range(n).select((F.lit(low) + (high - low) * uniform(seed, F.lit("ratio"), "id")).cast("string").alias("value"))


def write_map(df: DataFrame, path: str, key: str, value: str) -> None:
    """JSON objects of key and value, one object a partition of df; values are strings or JSON of maps and structs."""
    text = df.schema[value].dataType.typeName() == "string"
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    name = quoted(F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit("null key")).cast("string")))
    body = F.coalesce(quoted(F.col(value)) if text else F.to_json(value), F.lit("null"))
    rows = df.select(F.concat(name, F.lit(": "), body).alias("value"))

    def braced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            lines = [("{" if first and not i else ",") + x for i, x in enumerate(b.column(0).to_pylist())]
            first = first and not lines
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if first else "}"])], names=["value"])

    rows.mapInArrow(braced, "value string").write.mode("overwrite").text(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """An Arrow IPC file for each partition of df, a record batch for each Arrow batch, through the writer of keyed files' protocol."""
    df.sparkSession.dataSource.register(ArrowSink)
    df.write.format("arrow_sink").option("path", path).mode("append").save()


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)
