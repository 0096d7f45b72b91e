"""Sources S1-S7, sinks K1-K7, streaming day batches."""

import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalframe.sources import readers, sinks
from vitalframe.streaming import day_batches


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="vf-test-")


def test_csv_index_col_and_nan(spark, tmp):
    p = os.path.join(tmp, "a.csv")
    with open(p, "w") as f:
        f.write(",x,y\n0,1.5,NaN\n1,2.5,3\n")
    df = readers.read_csv(spark, p, index_col=True)
    assert df.columns == ["x", "y"]
    assert [r.y for r in df.orderBy("x").collect()] == [None, 3]


def test_json_lines_and_text_json(spark, tmp):
    p = os.path.join(tmp, "r.json")
    with open(p, "w") as f:
        f.write(json.dumps({"stars": 4, "categories": ["a", "b"]}) + "\n")
        f.write(json.dumps({"stars": 2, "categories": []}) + "\n")
        f.write(json.dumps({"stars": 5, "categories": None}) + "\n")
    df = readers.read_json_lines(spark, p)
    from vitalframe.operators import aggs
    freq = {r.item: r.n for r in aggs.element_frequency(df, "categories").collect()}
    assert freq == {"a": 1, "b": 1}
    q = os.path.join(tmp, "t.txt")
    with open(q, "w") as f:
        f.write('{"k": 1}\nnot json\n{"k": 3}\n')
    t = readers.read_text_json(spark, q, T.StructType([T.StructField("k", T.IntegerType())]))
    assert sorted((r.k for r in t.collect()), key=lambda v: (v is None, v)) == [1, 3, None]


def test_keyed_files(spark, tmp):
    for code in (101, 202):
        spark.createDataFrame([(1.0,)], "v double").write.parquet(
            os.path.join(tmp, f"vital_events_{code}.parquet"))
    spark.createDataFrame([(9.0,)], "v double").write.parquet(os.path.join(tmp, "other.parquet"))
    df = readers.read_keyed_files(spark, os.path.join(tmp, "*.parquet"), "vital_events_",
                                  key_col="country_code")
    assert sorted(r.country_code for r in df.collect()) == [101, 202]


def test_keyed_save_read_incremental(spark, tmp):
    out = os.path.join(tmp, "paf")
    df = spark.createDataFrame([("past", "c1", 1, 0.1), ("past", "c2", 1, 0.2)],
                               "version string, acause string, k int, paf double")
    sinks.save_keyed(df, out, ["version", "acause"], ["k"])
    got = readers.read_partitioned(spark, out, version="past", acause="c2").collect()
    assert [r.paf for r in got] == [0.2]
    new = spark.createDataFrame([("past", "c2", 1, 0.9), ("forecast", "c1", 1, 0.3)],
                                "version string, acause string, k int, paf double")
    sinks.write_incremental(new, out, ["version", "acause"], overwrite=False)  # only new keys
    d = {(r.version, r.acause): r.paf for r in spark.read.parquet(out).collect()}
    assert d == {("past", "c1"): 0.1, ("past", "c2"): 0.2, ("forecast", "c1"): 0.3}
    sinks.write_incremental(new, out, ["version", "acause"], overwrite=True)   # replace
    d = {(r.version, r.acause): r.paf for r in spark.read.parquet(out).collect()}
    assert d[("past", "c2")] == 0.9 and d[("past", "c1")] == 0.1


def test_delete_is_null_safe(spark):
    df = spark.createDataFrame([("a", "x", "20240101"), ("a", "x", "20240105"),
                                ("a", "y", "20240102"), (None, "x", "20240102")],
                               "city string, district string, time string")
    p = (F.col("city") == "a") & (F.col("district") == "x") & \
        F.col("time").between("20240101", "20240103")
    kept = sinks.delete_where(df, p).collect()
    assert len(kept) == 3 and all(r.time != "20240101" for r in kept)


def test_streaming_day_batches(spark, tmp):
    src, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    schema = T.StructType([T.StructField("day", T.StringType()),
                           T.StructField("city", T.StringType()),
                           T.StructField("v", T.DoubleType())])
    spark.createDataFrame([("20240101", "a", 1.0), ("20240102", "b", 2.0)], schema) \
        .write.parquet(os.path.join(src, "f1"))
    stream = day_batches.day_stream(spark, os.path.join(src, "*"), schema)
    q = day_batches.write_days(stream, out, "day", f"t1-{uuid.uuid4().hex}",
                               delete_predicate=F.col("city") == "b")
    q.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert [(str(r.day), r.city) for r in got] == [("20240101", "a")]  # day read back as int


def test_to_driver_is_bounded(spark):
    pdf = sinks.to_driver(spark.range(1000), 5)
    assert len(pdf) == 5


def test_streaming_replaces_a_day(spark, tmp):
    name = f"t2-{uuid.uuid4().hex}"
    src, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    schema = T.StructType([T.StructField("day", T.StringType()),
                           T.StructField("city", T.StringType()),
                           T.StructField("v", T.DoubleType())])
    spark.createDataFrame([("20240101", "a", 1.0), ("20240102", "a", 2.0)], schema) \
        .write.parquet(os.path.join(src, "f1"))
    day_batches.write_days(day_batches.day_stream(spark, os.path.join(src, "*"), schema),
                           out, "day", name, mode="replace").awaitTermination(120)
    # a corrected file for one day arrives: that day is replaced, the other kept
    spark.createDataFrame([("20240102", "a", 9.0)], schema).write.parquet(os.path.join(src, "f2"))
    day_batches.write_days(day_batches.day_stream(spark, os.path.join(src, "*"), schema),
                           out, "day", name, mode="replace").awaitTermination(120)
    got = {str(r.day): r.v for r in spark.read.parquet(out).collect()}
    assert got == {"20240101": 1.0, "20240102": 9.0}


def test_replace_mode_reads_notes_not_the_store(spark, tmp, monkeypatch):
    """The store's files are never read by a batch; an output from before the notes is read for them once."""
    src, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    schema = "day string, v int"
    read = []
    real = sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda s, path, sch: (read.append(path), real(s, path, sch))[1])

    def arrive(k, rows):
        f = os.path.join(src, f"f{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f)
        for name in os.listdir(f):
            os.utime(os.path.join(f, name), (1_700_000_000 + k, 1_700_000_000 + k))

    def run(name):
        stream = day_batches.day_stream(spark, os.path.join(src, "*"), schema, max_files_per_trigger=1)
        day_batches.write_days(stream, out, "day", name, mode="replace").awaitTermination(300)

    name = f"t5-{uuid.uuid4().hex}"
    for k in range(4):
        arrive(k, [(f"d{k % 2}", k), (f"e{k}", k)])
    run(name)
    assert read.count(out) == 1  # the first batch, when there are neither notes nor days
    read.clear()
    arrive(4, [("d0", 40)])
    arrive(5, [("d1", 50), ("e0", 51)])
    run(name)
    assert out not in read and read
    got = sorted((r.day, r.v) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == [("d0", 40), ("d1", 50), ("e0", 51), ("e1", 1), ("e2", 2), ("e3", 3)]
    # an older version of a day that arrives late is left out
    arrive(1_000_000 - 1_700_000_000, [("d0", -1)])
    run(name)
    assert {r.v for r in spark.read.schema(schema).parquet(out).where("day = 'd0'").collect()} == {40}


def test_save_csv_and_split_by_day(spark, tmp):
    df = spark.createDataFrame([("20240101", 1), ("20240102", 2), ("20240102", 3)],
                               "day string, v int")
    sinks.save_csv(df, os.path.join(tmp, "csv"))
    back = readers.read_csv(spark, os.path.join(tmp, "csv"))
    assert back.count() == 3
    sinks.split_by_day(df, os.path.join(tmp, "days"))
    assert sorted(d for d in os.listdir(os.path.join(tmp, "days")) if d.startswith("day=")) == \
        ["day=20240101", "day=20240102"]
    sinks.save(df, os.path.join(tmp, "pq"))
    assert spark.read.parquet(os.path.join(tmp, "pq")).count() == 3


@pytest.mark.parametrize("trigger", [None, 1, 2])
@pytest.mark.parametrize("mode", ["add", "replace"])
def test_stream_result_does_not_depend_on_the_trigger(spark, tmp, trigger, mode):
    src, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    schema = "day string, v int"
    for k in range(4):  # four files of one day, two of another
        rows = [("01", k)] + ([("1", 10 + k)] if k < 2 else [])
        f = os.path.join(src, f"f{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f)
        for name in os.listdir(f):
            os.utime(os.path.join(f, name), (1_700_000_000 + k, 1_700_000_000 + k))
    stream = day_batches.day_stream(spark, os.path.join(src, "*"), schema, max_files_per_trigger=trigger)
    day_batches.write_days(stream, out, "day", f"t3-{uuid.uuid4().hex}", mode=mode).awaitTermination(300)
    got = sorted((r.day, r.v) for r in spark.read.schema(schema).parquet(out).collect())
    if mode == "add":
        assert got == [("01", 0), ("01", 1), ("01", 2), ("01", 3), ("1", 10), ("1", 11)]
    else:
        assert got == [("01", 3), ("1", 11)]


def test_incremental_keys_keep_their_type(spark, tmp):
    out = os.path.join(tmp, "keys")
    df = lambda *rows: spark.createDataFrame(list(rows), "acause string, v int")
    sinks.write_incremental(df(("1", 1)), out, ["acause"])
    sinks.write_incremental(df(("01", 2), ("copd", 3), ("1", 9)), out, ["acause"])
    got = {(r.acause, r.v) for r in spark.read.schema("acause string, v int").parquet(out).collect()}
    assert got == {("1", 1), ("01", 2), ("copd", 3)}


def test_incremental_errors_rise(spark, tmp):
    out = os.path.join(tmp, "bad")
    os.makedirs(out)
    with open(os.path.join(out, "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_incremental(spark.createDataFrame([("a", 1)], "k string, v int"), out, ["k"])


def test_drop_tables(spark):
    from vitalframe.session import cut_lineage, drop_tables
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    path = df.inputFiles()[0]
    drop_tables(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()
