"""Operators 6 and 8: exact round trip and brute force."""

import base64
import hashlib
import io
import math

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vitalframe.llm import ann, queries, warc
from vitalframe.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, payload string"


def brute_pages(rows, least=0):
    groups = {}
    for p, _, h, _ in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    out = []
    for p, _, h, _ in rows:
        body = (h or "").encode()
        known = [x for x in groups[body] if x is not None]
        first = max(known) if known and len(groups[body]) > 1 and len(body) >= least else None
        ref = first if first is not None and p != first else None
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((p, len(body), sha, "response" if ref is None else "revisit", ref))
    return out


def odd_pages():
    return [(1, "http://a", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (9, "http://b\r\nX: y", "<p>x</p>", None),
            (3, "http://c", None, "c"), (4, "http://d", "", "c"), (5, "http://é", "Ünï 日本 🙂", "c"),
            (None, "http://e", "<p>x</p>", "c"), (9, "http://b", "<p>x</p>", "c"), (6, "http://f", "z" * 3_000_000, "c"),
            (None, "http://g", "only\r\n\r\nthis", "c")]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame(odd_pages(), PAGES).repartition(3)
    got = warc.round_trip(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert key(map(tuple, got.collect())) == key(brute_pages(odd_pages(), least))


def test_payloads_come_back(spark):
    folder = ensure_checkpoint_dir(spark).rstrip("/") + "/warc-test-payload"
    folder = folder if folder.startswith("file:") else f"file://{folder}"
    df = spark.createDataFrame(odd_pages(), PAGES)
    paths = spark.createDataFrame(warc.write_archives(df, folder).collect())
    got = {(r["page_id"], r["record_type"]): r["payload"] for r in warc.read_archives(paths, folder).collect()}
    assert got[6, "response"] == b"z" * 3_000_000 and got[5, "response"].decode() == "Ünï 日本 🙂"
    assert got[9, "response"] == b"<p>x</p>" and got[1, "revisit"] is None


def test_query(spark):
    rows = [(r["page_id"], r["url"], r["html"], None) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert key(map(tuple, queries.op6_warc_zstd(spark, SF).collect())) == key(brute_pages(rows))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive(records):
    out = io.BytesIO()
    a = warc.Archive(out)
    for r in records:
        a.add(r)
    a.start()
    return out.getvalue()


def test_format():
    records = [warc.record(i, f"http://h/{i}", f"<html>{i} {'word ' * 50}</html>".encode()) for i in range(600)]
    data = archive(records)
    assert list(warc.frames(io.BytesIO(data))) == records
    assert data[:4] == b"\x5d\x2a\x4d\x18"  # skippable frame 0x184D2A5D first
    size = int.from_bytes(data[4:8], "little")
    frame = zstandard.get_frame_parameters(data[8 + size:])
    assert frame.dict_id == warc.load_dictionary(data[8:8 + size]).dict_id() != 0
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])  # a dictionary that is compressed itself
    again = b"\x5d\x2a\x4d\x18" + len(packed).to_bytes(4, "little") + packed + data[8 + size:]
    assert list(warc.frames(io.BytesIO(again))) == records


@pytest.mark.parametrize("spoil", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"WARC-Date", b"WARC-Dat"),
    lambda r: r[:-1], lambda r: r.replace(b"hello", b"hellO"), lambda r: r.replace(b"hello", b"hello!"),
    lambda r: r.replace(b"sha1:", b"md5:")])
def test_bad_records(spoil):
    good = warc.record(1, "http://a", b"hello")
    assert warc.parse(good)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse(spoil(good))


def test_bad_archives():
    data = archive([warc.record(i, "u", b"x" * 100) for i in range(20)])
    for bad in (data[:-3], data[8:], data[:20], b"abc"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(bad)))


# ---- 8

def brute_near(rows, k, is_query):
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i in {i for i, _ in ok if is_query(i)}:
        q = min((len(v), v.tolist()) for j, v in ok if j == i)[1]
        near = sorted((-float((np.array(q) * v).sum()), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        if near:
            out[i] = [(j, -s) for s, j in near]
    return out


def check_near(df, k, **kw):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_near(rows, k, lambda i: i % 20 == 0)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k, **kw).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, near in want.items():
        have = sorted(got[q])
        assert [h[0] for h in have] == list(range(1, len(near) + 1))
        assert [h[1] for h in have] == [j for j, _ in near]
        assert np.allclose([h[2] for h in have], [s for _, s in near], rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("rows", [(4096, 1024), (64, 8)])
def test_search_is_exact(spark, rows):
    check_near(spark.read.parquet(f"{SF}/embeddings.parquet"), 20, block_rows=rows[0], query_rows=rows[1])


def test_search_edges(spark):
    rng = np.random.default_rng(5)
    v = [(i, rng.normal(size=8).round(1).tolist(), 0) for i in range(90)]
    v += [(i, v[20][1], 0) for i in range(100, 160)]              # ties with a query
    v += [(i, [1e-30] * 8, 0) for i in (160, 161)] + [(i, [1e18] + [0.0] * 7, 0) for i in (180, 181)]
    v += [(200, None, 0), (201, [], 0), (202, [0.0] * 8, 0), (203, [None] + [1.0] * 7, 0), (220, [float("nan")] * 8, 0),
          (240, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (20, v[20][1], 0), (260, [1.0, 2.0], 0), (261, [3.0, 4.0], None),
          (280, [1.0, 2.0, 3.0], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, score int").repartition(3)
    for k in (1, 20, 500):
        check_near(df, k, block_rows=32, query_rows=4)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("repeats", [3, 30])
def test_repeated_query_ids_take_no_place(spark, repeats):
    rng = np.random.default_rng(repeats)
    v = [(i, rng.normal(size=8).tolist()) for i in range(1, 120)]
    v += [(20, (10 * np.array(v[19][1])).tolist())] * (repeats - 1)  # the query's own rows score highest
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    for rows in (4096, 40):
        check_near(df, 20, block_rows=rows, query_rows=4)


def test_an_id_repeated_over_more_than_a_block(spark):
    rng = np.random.default_rng(8)
    v = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(21, rng.normal(size=8).tolist()) for _ in range(400)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    check_near(df, 20, block_rows=32, query_rows=2)
    stored = ann.usable(df).withColumn("_row", F.monotonically_increasing_id())
    sizes = [len(r["ids"]) // 8 for r in ann.blocks(stored, 32, 460).collect()]
    assert max(sizes) < 64 and sum(sizes) == 460  # the hot id is spread


def test_queries_in_several_bands(spark, monkeypatch):
    monkeypatch.setattr(ann, "BAND", 1)
    check_near(spark.read.parquet(f"{SF}/embeddings.parquet"), 20, block_rows=50, query_rows=4)
