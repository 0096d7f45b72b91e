"""Operators 3 and 5: exact round trip, brute force and edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitalframe.llm import mixing, packing

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pack(df):
    tok = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for r in df.collect():
        ids[r["doc_id"]].append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    rows = packing.pack(df, PATH).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for doc, texts in ids.items():
        assert sum(p["length"] for p in pieces[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces[doc], key=lambda p: p["start"]):
                part = texts[0][at:at + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == len(texts[0])
                assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
                at += p["length"]
            assert at == len(texts[0])
    steps = defaultdict(set)
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all
        assert {p["tier"] for p in ps} == {at} and len({p["step_group"] for p in ps}) == 1
        steps[ps[0]["step_group"]].add(at)
    assert all(len(s) == 1 for s in steps.values())  # a step has one size of sequence


def test_pack_documents(spark):
    check_pack(spark.read.parquet(f"{SF}/documents.parquet"))


def test_pack_edges(spark, docs, no_docs):
    check_pack(docs)
    odd = ["<|endoftext|> x<|startoftext|>Y", "DON'T 'S 1.5 a.b.", "É É İ ß ſ K Σς ǅ", "日本語　x\x85y\x1cz", "...,,, a.,"]
    check_pack(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    assert packing.pack(no_docs, PATH).count() == 0


def test_tokens_survive_a_small_table(spark):
    texts = [r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert packing.Tokens(PATH, memo=5).ids(texts) == packing.Tokens(PATH).ids(texts)


def test_steps_are_balanced():
    rng = np.random.default_rng(3)
    p = packing.Packer(packing.TIERS, packing.STEP_TOKENS, 0)
    for d in range(3000):
        p.add(d, np.zeros(int(rng.integers(1, 9000)), "<u4").tobytes())
    p.pack(last=True)
    cost, tier = defaultdict(int), {}
    for r in p.flush():
        cost[r[8]] += r[2] ** 2
        tier[r[8]] = r[7]
    big = [c for g, c in cost.items() if tier[g] == 4096]
    assert len(big) > 5 and max(big) / min(big) < 1.3


def test_long_windows_are_filled_from_shorter_tiers():
    p = packing.Packer((4, 8, 16), 64, 0)
    for d, n in enumerate([13, 3, 9, 4, 3]):
        p.add(d, np.zeros(n, "<u4").tobytes())
    p.pack(last=True)
    rows = p.flush()
    first = [r for r in rows if r[5] == next(x[5] for x in rows if x[0] == 0)]
    assert sorted((r[0], r[2]) for r in first)[0] == (0, 13) and sum(r[2] for r in first) == 16 and len(first) == 2


def brute_mix(rows):
    size = defaultdict(int)
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    for _, n, s in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] >= 3 * size[s]}
        if not over:
            target |= {s: share * w[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        free -= over
    return docs, size, target


def test_mix_against_brute_force(spark, docs):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), docs):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        want, size, target = brute_mix(rows)
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        taken, most = defaultdict(int), defaultdict(int)
        src = {i: s for i, _, s in want}
        for r in got:
            s = src[r["doc_id"]]
            assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
            assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
            taken[s] += r["taken"]
            most[s] = max(most[s], r["size"] * (2 if r["doc_id"] == 5 else 1))
        for s, t in target.items():
            assert abs(taken[s] - t) <= most[s] / 2 + 1
        # nested: who is taken once more has a smaller hash than who isn't
        place = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        for s in size:
            here = [(place(r["doc_id"]), r["copies"]) for r in got if src[r["doc_id"]] == s and r["size"]]
            lo = min((c for _, c in here), default=0)
            in_, out = [h for h, c in here if c > lo], [h for h, c in here if c == lo]
            assert not in_ or not out or max(in_) < min(out)


def test_mix_edges(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    one = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(one).collect()] == [(0, 0.0, 0)] * 2
    ties = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(2, "d", "t")], "doc_id long, text string, source string")
    assert len({r["taken"] for r in mixing.mix(ties).where("doc_id = 1").collect()}) == 1


def test_texts_are_sliced_by_bytes():
    import pyarrow as pa
    texts = pa.array([None, "", "x" * 10, "é" * 3_000_000, "y" * 5_000_000, "z"] + ["w" * 100] * 200)
    parts = list(packing._slices(texts))
    assert sum(n for _, n in parts) == len(texts) and [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
    sizes = [sum(len((t or "").encode()) for t in texts.slice(a, n).to_pylist()) for a, n in parts]
    assert all(n <= 64 and (s <= packing.TEXT_BYTES or n == 1) for s, (_, n) in zip(sizes, parts, strict=True))
    assert list(packing._slices(pa.array([], pa.string()))) == []


def test_long_documents_are_handed_on_before_the_buffer_is_full():
    packer = packing.Packer(packing.TIERS, packing.STEP_TOKENS, 0)
    ids = np.arange(1_000_003, dtype="<u4").tobytes()
    rows, most = [], 0
    for doc in range(25):
        packer.add(doc, ids)
        most = max(most, packer.full)
        if packer.full >= packing.HELD_TOKENS:
            rows += packer.flush()
    assert most < packing.HELD_TOKENS + 1_000_003 and len(packer.wait) == 25 < packing.BUFFER
    packer.pack(last=True)
    rows += packer.flush()
    by = defaultdict(list)
    for doc, start, n, crc, *_ in rows:
        assert crc == zlib.crc32(ids[4 * start:4 * (start + n)])
        by[doc].append((start, n))
    for doc in range(25):
        at = 0
        for start, n in sorted(by[doc]):
            assert start == at
            at += n
        assert at == 1_000_003
    assert len({(r[5], r[6]) for r in rows}) == len(rows)
