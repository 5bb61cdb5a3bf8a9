"""Where intermediate tables go, and the size of Arrow batches."""

from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxloom.llm import store


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get("root", d)), sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_only_local_sessions_have_a_default_folder():
    assert store.scratch_root(session("local[8]")) == f"{store.LOCAL_DIR}/app"
    assert store.scratch_root(session("spark://x:7077", root="hdfs://n/tmp/")) == "hdfs://n/tmp/app"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            store.scratch_root(session(master))


def test_batches_are_bounded(spark):
    store.small_batches(spark)
    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = [r["n"] for r in long.mapInArrow(sizes, "n bigint").collect()]
    assert len(got) > 1 and max(got) <= 2 * store.ARROW_BYTES
