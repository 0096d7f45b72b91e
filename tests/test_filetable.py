"""Tables of files under a manifest: clustering, lookups, deletes by file, failed runs."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vitalframe.sources import filetable

SCHEMA = "id long, place int, day date, name string"


@pytest.fixture
def rows(spark):
    return spark.range(20_000).select(
        "id", (F.xxhash64("id") % 400).cast("int").alias("place"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)).cast("int")).alias("day"),
        F.concat(F.lit("n"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(500)).cast("string")).alias("name"))


def local(f):
    return f.replace("file://", "")


def holders(files, column, value):
    """Row groups that a reader must look into for column = value, by min and max."""
    n = of = 0
    for f in files:
        meta = pq.ParquetFile(local(f)).metadata
        at = meta.schema.to_arrow_schema().get_field_index(column)
        for g in range(meta.num_row_groups):
            st = meta.row_group(g).column(at).statistics
            of += 1
            n += st.min <= value <= st.max
    return n, of


def test_lookup_by_any_key_skips_files(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    files = filetable.save_clustered(rows, path, ["place", "day"], 36)
    assert len(files) >= 30
    some = rows.orderBy("id").limit(20).collect()
    day = some[0]["day"]
    for column, value in (("place", 17), ("day", day)):
        # where files end follows from a sample, and a value at a cut lies in more of them: many values count
        shares = [n / of for n, of in (holders(files, column, r[column]) for r in some)]
        # measured: 0.31 on average (ranges of the interleaved order aren't aligned to its cells)
        assert sum(shares) / len(shares) < 0.4 and max(shares) <= 0.6
        want = sorted(r["id"] for r in rows.where(F.col(column) == F.lit(value)).collect())
        got = filetable.lookup(spark, path, rows.schema, **{column: value})
        assert sorted(r["id"] for r in got.collect()) == want
    assert any(pq.ParquetFile(local(f)).metadata.row_group(0).num_rows for f in files)
    assert filetable.lookup(spark, path, rows.schema, place=None).collect() == []


def test_delete_rewrites_only_files_with_a_match(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    rows = rows.withColumn("place", F.when(F.col("id") % 50 != 0, F.col("place")))
    first = filetable.save_clustered(rows, path, ["day"], 12)
    pred = (F.col("day") < "2020-02-01") & (F.col("place") > 0)
    done = filetable.delete(spark, path, rows.schema, pred)
    now, version = filetable.files_of(spark, path)
    assert version == 2 and done["rewritten"] >= 1 and done["kept"] + done["rewritten"] == len(first)
    assert len(set(now) & set(first)) == done["kept"] >= 9  # untouched files keep their names
    want = {r["id"] for r in rows.where(~F.coalesce(pred, F.lit(False))).collect()}
    got = [r["id"] for r in filetable.read(spark, path, rows.schema).collect()]
    assert len(got) == len(want) and set(got) == want and done["deleted"] == 20_000 - len(want)
    again = filetable.delete(spark, path, rows.schema, pred)
    assert again["rewritten"] == 0 and filetable.files_of(spark, path)[1] == 2


def test_failed_change_leaves_the_last_version(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    files = filetable.save_clustered(rows, path, ["place"], 4)
    # a run that ended while it announced its version: fewer names than it said
    (spark.createDataFrame([(files[0], 2, 3)], filetable._MANIFEST).write.mode("append").parquet(f"{path}/manifest"))
    assert filetable.files_of(spark, path) == (sorted(files), 1)
    assert filetable.read(spark, path, rows.schema).count() == 20_000
    # a run that ended before it announced anything
    rows.limit(5).write.parquet(f"{path}/data/left-behind")
    assert filetable.read(spark, path, rows.schema).count() == 20_000


def test_delete_all_and_nothing_there(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    assert filetable.read(spark, path, rows.schema).collect() == []
    assert filetable.delete(spark, path, rows.schema, F.lit(True))["deleted"] == 0
    filetable.save_clustered(rows.limit(100), path, ["name", "place"], 3)
    assert filetable.delete(spark, path, rows.schema, F.lit(True))["deleted"] == 100
    assert filetable.read(spark, path, rows.schema).collect() == []
    assert os.path.isdir(path)


def test_interleaving_keeps_each_keys_order(spark):
    df = spark.createDataFrame([(i, f"{chr(97 + i % 26)}x", None if i == 3 else i * 1.0) for i in range(64)],
                               "i int, s string, d double")
    z = df.select("i", filetable.interleaved(df, ["i"]).alias("z"), filetable.interleaved(df, ["s"]).alias("y"), "s",
                  filetable.interleaved(df, ["d", "i"]).alias("x")).collect()
    by_i = [r["z"] for r in sorted(z, key=lambda r: r["i"])]
    assert by_i == sorted(by_i) and len(set(by_i)) > 30
    by_s = [r["y"] for r in sorted(z, key=lambda r: r["s"])]
    assert by_s == sorted(by_s) and len(set(by_s)) > 10
    assert all(r["x"] is not None for r in z)
