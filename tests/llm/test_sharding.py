"""Operator 13: sizes, slots, quotas and cuts against plain Python."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vitalframe.llm import queries, sharding

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def check(rows, docs, shards):
    """Whole rows, exact sizes and checksums, even shards, gapless slots; returns the groups' shards."""
    want = Counter()
    for d, t in docs:
        b = (t or "").encode()
        want[d, len(b) + 8, zlib.crc32(b)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by_shard = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by_shard[r["shard"]].append(r["slot"])
    counts = [len(by_shard[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in by_shard.values():
        assert sorted(s) == list(range(len(s)))
    groups = defaultdict(Counter)
    for r in rows:
        groups[r["size"], r["text_crc32"]][r["shard"]] += 1
    return groups


def test_whole_query(spark):
    rows = queries.op13_label_shards(spark, SF).collect()
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    groups = check(rows, docs, 24)
    quota = len(docs) // 24
    whole = [g for g in groups.values() if sum(g.values()) <= quota]
    assert sum(len(g) == 1 for g in whole) >= 0.98 * len(whole)
    again = queries.op13_label_shards(spark, SF).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_hot_group_fills_few_shards(spark):
    docs = [(i, "same text") for i in range(400)] + [(1000 + i, f"t{i % 90}") for i in range(180)] \
        + [(5000 + i, f"alone {i}") for i in range(620)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    groups = check(sharding.balanced_shards(df, block=64).collect(), docs, 24)
    hot = groups[len("same text") + 8, zlib.crc32(b"same text")]
    assert len(hot) <= 10  # 400 of 1,200 rows: 8 of 24 shards
    assert sum(len(g) > 1 for g in groups.values()) <= 8


def test_every_document_linked(spark):
    # no lone document gives room: groups meet by exchange only
    docs = [(i, f"t{i // 4}") for i in range(480)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    groups = check(sharding.balanced_shards(df).collect(), docs, 24)
    assert sum(len(g) for g in groups.values()) < 480 * 0.6  # 480 cells to begin with


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_odd_rows(spark, docs, shards):
    got = sharding.balanced_shards(docs, shards=shards)
    assert got.columns == COLS
    check(got.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], shards)


def test_empty(spark, no_docs):
    got = sharding.balanced_shards(no_docs)
    assert got.columns == COLS and got.collect() == []


def test_own_groups(spark, docs):
    got = sharding.balanced_shards(docs, shards=3, group=F.col("lang")).collect()
    check(got, [(r["doc_id"], r["text"]) for r in docs.collect()], 3)


def test_allowed():
    assert sharding._allowed({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert sharding._allowed({(0, 1): 5, (2, 1): 5}, [0, 3, 0]) in ({(0, 1): 1, (2, 1): 2}, {(0, 1): 2, (2, 1): 1})
    assert sharding._allowed({(0, 1): 5}, [9, -2]) == {}


def test_native_plan(spark, docs):
    plan = sharding.balanced_shards(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "SinglePartition", "ExistingRDD"))
