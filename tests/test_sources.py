"""Byte ranges of JSON maps, one file a key, Arrow files by record batch."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.sources import jsonmap, keyed, readers, sinks

MARKS = ["a", '"', "\\", "{", "}", ",", ":", "[", "]", "é", "\n", '\\\\"', " "]


def odd(rng, n=12):
    return "".join(rng.choice(MARKS) for _ in range(rng.randint(0, n)))


def odd_value(rng, depth=0):
    r = rng.random()
    if r < 0.5 or depth > 2:
        return odd(rng)
    if r < 0.7:
        return {odd(rng, 3): odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))] if r < 0.8 else rng.choice([1, None, True, 2.5])


def as_row(key, value):
    return key, value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_ranges_of_any_length(monkeypatch, block):
    monkeypatch.setattr(jsonmap, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        value = {odd(rng, 6): odd_value(rng) for _ in range(rng.randint(0, 8))}
        data = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode().join(rng.choice([(b"", b""), (b" ", b"\n")]))
        split = rng.choice([1, 2, 5, 13, 100])
        ranges = [(low, min(low + split, len(data))) for low in range(0, len(data), split)]
        blocks = lambda low, high: (np.frombuffer(data[a : min(a + block, high)], np.uint8) for a in range(low, high, block))  # noqa: B023, E731
        begun = jsonmap.beginnings([jsonmap.summary(blocks(*r)) for r in ranges])
        assert begun[-1] == (jsonmap.OUTSIDE, 0)
        read = lambda at, n: data[at : at + n]  # noqa: B023, E731
        got = [jsonmap.parsed(e) for r, s in zip(ranges, begun, strict=False) for _, e in jsonmap.entries(read, *r, len(data), *s)]
        assert [g for g in got if g] == [as_row(*x) for x in value.items()]


def test_a_map_of_a_million_keys(spark, tmp_path):
    value = {f'k{i}"}}{{': {"0": f'/p\\"/{{{i}', "1": ",["} for i in range(1_000_000)}
    (tmp_path / "m.json").write_text(json.dumps(value))
    got = jsonmap.json_map(spark, f"{tmp_path}/m.json", split=4 << 20)
    assert got.rdd.getNumPartitions() > 8
    assert got.agg(F.count("*"), F.count_distinct("key")).first() == (1_000_000, 1_000_000)
    some = {r["key"]: r["value"] for r in got.where("key like 'k9999%'").collect()}
    assert some == {k: json.dumps(v) for k, v in value.items() if k.startswith("k9999")}


def test_maps_written_and_read(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"{i}{odd(rng)}", {odd(rng): odd(rng)}) for i in range(300)]
    sinks.write_map(spark.createDataFrame(rows, "k string, v map<string,string>").repartition(5), f"{tmp_path}/m", "k", "v")
    got = jsonmap.json_map(spark, f"{tmp_path}/m", split=50)
    assert sorted((r["key"], json.loads(r["value"])) for r in got.collect()) == sorted(rows)
    empty = spark.createDataFrame([], "k string, v string")
    sinks.write_map(empty, f"{tmp_path}/none", "k", "v")
    assert not jsonmap.json_map(spark, f"{tmp_path}/none").collect()
    (tmp_path / "two.json").write_text('{"a": "x", "b": {"0": "p", "0": "q"}, "a": "y"}')
    assert dict(jsonmap.last_wins(jsonmap.json_map(spark, f"{tmp_path}/two.json", split=3)).collect()) == {"a": "y", "b": '{"0": "q"}'}
    (tmp_path / "bad.json").write_text('{"a": "x"')
    with pytest.raises(ValueError, match="not a JSON object"):
        jsonmap.json_map(spark, f"{tmp_path}/bad.json")


def names(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith(".")) if path.exists() else []


def test_killed_attempts_leave_whole_files_only(tmp_path):
    def broken(n):
        yield from ((f"k{i}", "x" * 100) for i in range(n))
        raise RuntimeError("killed")

    writer = keyed._Writer(str(tmp_path), ".txt")
    with pytest.raises(RuntimeError):
        writer.write(broken(3))
    assert names(tmp_path) == ["_attempts", "k0.txt", "k1.txt", "k2.txt"]
    writer.write((f"k{i}", "x" * 100) for i in range(5))  # the repeated task
    writer.write((f"k{i}", "x" * 100) for i in range(2))  # a speculative twin that lags behind
    writer.commit([])
    assert names(tmp_path) == ["_SUCCESS", *(f"k{i}.txt" for i in range(5))]
    assert all((tmp_path / f"k{i}.txt").read_text() == "x" * 100 for i in range(5))


def test_failed_jobs_are_resumed(spark, tmp_path):
    out = tmp_path / "out"
    work = spark.createDataFrame([(f"{c}/é {i}+", i) for i, c in enumerate("abcdefgh_.")], "key string, n long")
    assert keyed.pending_keys(work, str(out), "key").count() == 10
    with pytest.raises(Exception, match="null key"):
        keyed.write_keyed(work.union(spark.createDataFrame([(None, 99)], work.schema)), str(out), "key")
    assert "_attempts" not in names(out) and "_SUCCESS" not in names(out)
    left = keyed.pending_keys(work, str(out), "key")
    done = {r["key"] for r in keyed.keys_written(spark, str(out)).collect()} if names(out) else set()
    assert {r["key"] for r in left.collect()} == {r["key"] for r in work.collect()} - done
    keyed.write_keyed(left, str(out), "key")
    assert keyed.pending_keys(work, str(out), "key").count() == 0
    got = readers.json_records(spark, [str(out)], T.StructType.fromDDL("key string, n long"), "key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, work.collect()))
    for rows, match in (([("k", 1), ("k", 2)], "two rows"), ([(None, 1)], "null key")):
        with pytest.raises(Exception, match=match):
            keyed.write_keyed(spark.createDataFrame(rows, "key string, n long"), f"{tmp_path}/bad", "key")
    keyed.write_keyed(work, f"{tmp_path}/raw", "key", F.encode("key", "utf-8"), ".gz", distinct=True)
    assert sorted(p.read_bytes().decode() for p in (tmp_path / "raw").glob("*.gz")) == sorted(r["key"] for r in work.collect())


def test_arrow_by_record_batch(spark, tmp_path, monkeypatch):
    table = pa.table({"n": pa.array(range(1000)), "s": [str(i % 7) for i in range(1000)], "x": [float("nan") if i % 9 == 0 else i / 2 for i in range(1000)], "big": [b"z" * 50] * 1000})
    with pa.ipc.new_file(f"{tmp_path}/f.arrow", table.schema) as w:
        w.write_table(table, max_chunksize=100)
    with pa.ipc.new_stream(f"{tmp_path}/s.arrow", table.schema) as w:
        w.write_table(table, max_chunksize=100)
    kind = T.StructType.fromDDL("n long, s string, x double")
    got = readers.arrow_table(spark, str(tmp_path), kind, batches=3)
    assert got.rdd.getNumPartitions() == 5 and got.columns == ["n", "s", "x"]
    want = lambda f: sorted(i for i in range(1000) if f(i) for _ in range(2))
    assert sorted(r["n"] for r in got.where("n >= 500 and s = '3' and n % 2 = 0").collect()) == want(lambda i: i >= 500 and i % 7 == 3 and i % 2 == 0)
    assert sorted(r["n"] for r in got.where("x > 400").collect()) == want(lambda i: i % 9 == 0 or i / 2 > 400)  # NaN is the greatest here
    reader = readers._ArrowReader({"path": str(tmp_path), "batches": "4"}, T.StructType.fromDDL("n long, s string"))
    from pyspark.sql.datasource import GreaterThan, IsNull

    assert list(reader.pushFilters([GreaterThan(("n",), 950), IsNull(("s",))])) == [IsNull(("s",))]
    parts = [p.value[1:] for p in reader.partitions()]
    assert parts == [(0, 4), (4, 8), (8, 10), (0, None)]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 98 and all(b.schema.names == ["n", "s"] for b in batches)
    sinks.write_arrow(got.repartition(3), f"{tmp_path}/again")
    again = readers.arrow_table(spark, f"{tmp_path}/again", kind)
    assert again.exceptAll(got).isEmpty() and again.count() == 2000
    assert len([f for f in names(tmp_path / "again") if f.startswith("part-")]) == 3


def test_a_reader_does_not_take_all_ranges_to_every_task():
    import json
    import pickle

    from boxloom.sources import jsonmap

    begun = [["file:/a/part", 1 << 30, i << 18, (i + 1) << 18, 0, 1] for i in range(4000)]
    reader = jsonmap._Ranges({"path": "/a", "begun": json.dumps(begun)})
    assert [list(p.value) for p in reader.partitions()] == begun and len(pickle.dumps(reader)) < 1000
