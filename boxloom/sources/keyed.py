"""One file for each key, written so that killed and repeated tasks leave no half file and no file twice.

A task writes a key's content under a hidden name of its own attempt and renames
it, complete, to the key's name: readers see a file whole or not at all, and a
second attempt replaces what the first one finished by the same content. Files
of finished tasks stay if the job fails, which is what a resumed run builds on
(`pending_keys` leaves finished keys out). Commit removes what attempts left
behind and sets the _SUCCESS mark; abort removes only the former.

Names are keys in percent encoding with `~` for `%`, which file names in URIs
would take for their own; letters, digits, `_`, `.` and `-` stay, but not a first
`_` or `.`, which would hide a file. A null key is an error, and a key
that a task meets twice (equal keys of a write come to one task) too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from .stores import inner, store_of

ATTEMPTS = "_attempts"


def file_name(key: str, suffix: str) -> str:
    name = quote(key, safe="").replace("~", "%7E").replace("%", "~")
    return (f"~{ord(name[0]):02X}{name[1:]}" if name[:1] in ("_", ".") else name) + suffix


class KeyedFiles(DataSource):
    """Options path and suffix; rows of a key (string) and content (string or binary)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "key string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("suffix", ".json"))


class _Attempts(DataSourceWriter):
    """Writes under hidden names of an attempt; commit and abort clear what attempts leave behind."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def attempt(self) -> tuple[fs.FileSystem, str, str]:
        """Store, root and the attempt's own folder."""
        store, root = store_of(self.path), inner(self.path)
        own = f"{root}/{ATTEMPTS}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        return store, root, own

    def _clear(self) -> fs.FileSystem:
        store = store_of(self.path)
        if store.get_file_info(f"{inner(self.path)}/{ATTEMPTS}").type != fs.FileType.NotFound:
            store.delete_dir(f"{inner(self.path)}/{ATTEMPTS}")
        return store

    def commit(self, messages) -> None:
        store = self._clear()
        store.create_dir(inner(self.path), recursive=True)
        store.open_output_stream(f"{inner(self.path)}/_SUCCESS").close()

    def abort(self, messages) -> None:
        self._clear()


class _Writer(_Attempts):
    def write(self, rows: Iterator) -> WriterCommitMessage:
        (store, root, own), seen = self.attempt(), set()
        for key, content in rows:
            if key is None or key in seen:
                raise ValueError("null key" if key is None else f"two rows with key {key}")
            seen.add(key)
            name = file_name(key, self.suffix)
            with store.open_output_stream(f"{own}/{name}", compression=None) as f:  # else .gz would be packed again
                f.write((content or "").encode() if isinstance(content, str | None) else bytes(content))
            store.move(f"{own}/{name}", f"{root}/{name}")
        return WriterCommitMessage()


class ArrowSink(DataSource):
    """Arrow IPC files; option path. A task's file takes its final name at the commit of the job, so failed jobs leave none."""

    @classmethod
    def name(cls) -> str:
        return "arrow_sink"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ArrowWriter(self.options["path"], ".arrow")


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _ArrowWriter(_Attempts, DataSourceArrowWriter):
    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _, own = self.attempt()
        out = None
        name = f"{own}/part.arrow"
        for b in batches:
            out = out or pa.ipc.new_file(store.open_output_stream(name), b.schema)
            out.write_batch(b)
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def commit(self, messages) -> None:
        store = store_of(self.path)
        for m in messages:  # one file a task
            if m is not None and m.name:
                store.move(m.name, f"{inner(self.path)}/part-{m.name.split('/')[-2]}.arrow")
        super().commit(messages)


def write_keyed(df: DataFrame, path: str, key: str, content: Column | None = None, suffix: str = ".json", distinct: bool = False) -> None:
    """A file for each row under its key; by default the row as JSON. Equal keys come to one task, where they are an error; distinct says that there are none, and rows stay where they are."""
    df.sparkSession.dataSource.register(KeyedFiles)
    body = F.to_json(F.struct("*")) if content is None else content
    rows = df.select(F.col(key).cast("string").alias("key"), body.alias("content"))
    (rows if distinct else rows.repartition("key")).write.format("keyed_files").option("path", path).option("suffix", suffix).mode("append").save()


def keys_written(spark, path: str, suffix: str = ".json") -> DataFrame:
    """(key) of every file; contents are not read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select(F.regexp_extract("_metadata.file_name", r"^(.*)" + suffix.replace(".", r"\.") + "$", 1).alias("name"))
    return names.select(F.call_function("url_decode", F.replace("name", F.lit("~"), F.lit("%"))).alias("key"))


def pending_keys(work: DataFrame, path: str, key: str, suffix: str = ".json") -> DataFrame:
    """Work whose key has no file yet."""
    from .sinks import exists

    spark = work.sparkSession
    if not exists(spark, path):
        return work
    done = keys_written(spark, path, suffix).withColumnRenamed("key", "_done")
    return work.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
