"""Readers: JSON folders, keyed search paths, maps, images, arrow files and text lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from boxloom import schemas

from . import jsonmap
from .stores import files_below, store_of

SEP = "[SEP]"


def folders(argument: str) -> list[str]:
    """Paths of a list argument; empty parts are dropped."""
    return [p for p in argument.split(SEP) if p.strip()]


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.", 1)


def json_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, key: str = "new_key") -> DataFrame:
    """One JSON object a file; a missing key is the file's stem."""
    paths = folders(paths) if isinstance(paths, str) else [p for p in paths if p]
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(list(paths))
    return df.withColumn(key, F.coalesce(key, _stem()))


def first_folder_wins(spark: SparkSession, paths: Sequence[str], schema: T.StructType, key: str = "new_key") -> DataFrame:
    """Records of a search path: of several with one key the earliest folder's."""
    ranked = None
    for rank, path in enumerate(p for p in paths if p):
        part = json_records(spark, [path], schema, key).withColumn("_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_r = 1").drop("_r", "_rank")


def files(spark: SparkSession, paths: str | Sequence[str], suffix: str | None = None) -> DataFrame:
    """Any files as (path, content) with the stem as key; content is read only if it is used."""
    paths = folders(paths) if isinstance(paths, str) else list(paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(list(paths)).withColumn("image_key", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))


def work_list(spark: SparkSession, map_path: str, dirs_path: str | None = None, split: int = jsonmap.SPLIT) -> DataFrame:
    """(new_key, replica, path[, folder]) from a map of maps in JSON, with the folder of each key's image; read by byte ranges."""
    one = lambda path: jsonmap.last_wins(jsonmap.json_map(spark, path, split))
    out = one(map_path).select(F.col("key").alias("new_key"), F.explode(F.from_json("value", schemas.WORK_MAP.valueType)).alias("replica", "path"))
    if dirs_path is None:
        return out
    return out.join(one(dirs_path).select(F.col("key").alias("new_key"), F.col("value").alias("folder")), "new_key")


def numbers(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """Seeds or ratios, one a line."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").cast(kind).alias("value"))


def key_range(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows with start <= key < end; bounds that make no sense are errors."""
    if start < 0 or end < start:
        raise ValueError(f"range {start}..{end}")
    return df.where((F.col(key) >= start) & (F.col(key) < end))


def up_to(df: DataFrame, key: str, last) -> DataFrame:
    """Rows up to a key, for cut-down runs."""
    return df.where(F.col(key) <= last)


def detector_rows(records: DataFrame, detector: str) -> DataFrame:
    """A detector's records as one row a box; parallel arrays of unequal length are an error."""
    same = (F.size("bboxes") == F.size("scores")) & (F.size("scores") == F.size("labels"))
    zipped = F.when(same, F.arrays_zip("bboxes", "scores", "labels")).otherwise(F.raise_error(F.concat(F.lit("arrays differ in length: "), "new_key")))
    rows = records.select("new_key", "OV_to_detect", F.posexplode(zipped).alias("pos", "z"))
    return rows.select("new_key", F.lit(detector).alias("detector"), "pos", F.get("OV_to_detect", F.col("z.labels")).alias("label"), F.col("z.scores").alias("score"), *[F.col("z.bboxes")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def merged_inputs(images: DataFrame, captions: DataFrame, detections: Sequence[DataFrame], key: str = "new_key", complete: bool = True) -> DataFrame:
    """Detections of all detectors, tagged, with their image and caption.

    A detection without image or caption is an error when it is reached; with
    complete=False it is dropped, and found by `missing`.
    """
    boxes = detections[0]
    for d in detections[1:]:
        boxes = boxes.unionByName(d)
    if not complete:
        return boxes.join(images, key).join(captions, key)
    sides = [(images.withColumn("_image", F.lit(True)), "_image"), (captions.withColumn("_caption", F.lit(True)), "_caption")]
    for side, mark in sides:
        boxes = boxes.join(side, key, "left")
        found = F.when(F.col(mark), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {mark[1:]} for "), F.col(key).cast("string"))))
        boxes = boxes.withColumn(key, found).drop(mark)
    return boxes


def missing(left: DataFrame, right: DataFrame, key: str = "new_key") -> DataFrame:
    """Keys of left without a partner; empty if the inputs are complete."""
    return left.select(key).join(right.select(key), key, "left_anti")


class ArrowFiles(DataSource):
    """Arrow IPC files below a folder: file format by record batches, stream format by files; options path and batches (of a partition).

    Only the columns of the schema asked for are decoded. Comparisons of whole
    numbers, strings, dates and truth values are taken over from the plan and
    applied to a batch before it is handed on.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        return schemas.IMAGES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArrowReader(self.options, schema)


#: Comparisons that readers of Arrow files apply themselves, and the types on which Arrow compares as Spark does.
_COMPARED = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}
_ALIKE = (T.IntegralType, T.StringType, T.DateType, T.BooleanType)


class _ArrowReader(DataSourceReader):
    """Partitions are (file, first batch, batch behind the last); (file, 0, None) is a stream."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.asked, self.step = options["path"], schema, int(options.get("batches", 16))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1 and isinstance(self.asked[f.attribute[0]].dataType, _ALIKE):
                self.filters.append((f.attribute[0], _COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, out = store_of(self.path), []
        for name, _ in files_below(self.path, ".arrow"):
            with store.open_input_file(name) as f:
                try:
                    n = pa.ipc.open_file(f).num_record_batches  # from the footer
                except pa.ArrowInvalid:
                    out.append((name, 0, None))
                    continue
            out += [(name, i, min(i + self.step, n)) for i in range(0, n, self.step)]
        return [InputPartition(x) for x in out]

    def read(self, partition: InputPartition):
        name, first, stop = partition.value
        opened = pa.ipc.open_stream if stop is None else pa.ipc.open_file
        with store_of(self.path).open_input_file(name) as f:
            own = opened(f).schema
            f.seek(0)
            reader = opened(f, options=pa.ipc.IpcReadOptions(included_fields=[own.get_field_index(c) for c in self.asked.names]))
            for b in reader if stop is None else map(reader.get_batch, range(first, stop)):
                for c, compare, value in self.filters:
                    b = b.filter(getattr(pc, compare)(b.column(c), pa.scalar(value, b.column(c).type)))
                if b.num_rows:
                    yield b.select(self.asked.names)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image table in Parquet."""
    return spark.read.schema(schemas.IMAGES).parquet(path)


def arrow_table(spark: SparkSession, path: str, schema: T.StructType = schemas.IMAGES, batches: int = 16) -> DataFrame:
    """Arrow files as a table of the schema's columns; others are not decoded. Turns on filters for Python sources in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").option("path", path).option("batches", batches).schema(schema).load()


def arrow_images(spark: SparkSession, path: str) -> DataFrame:
    return arrow_table(spark, path)
