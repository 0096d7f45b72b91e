"""Operator 12 against brute force: counts, near words, forms and roots."""

import random
import re
import zlib
from collections import Counter

import pytest

from vitalframe.llm import queries, spelling

SF = "/root/testdata/sf0.01"


def brute_words(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_near(words):
    """Every pair with one edit, by all strings one deletion away."""
    def cut(w):
        return {(i, w[:i] + w[i + 1:]) for i in range(len(w))}

    by = {}
    for w in words:
        for i, c in cut(w):
            by.setdefault((i, c), []).append(w)
    near = {w: set() for w in words}
    for ws in by.values():  # the same place deleted: one replaced
        for a in ws:
            near[a].update(b for b in ws if b != a)
    for w in words:
        for _, c in cut(w):
            if c in near:
                near[w].add(c)
                near[c].add(w)
    return near


def brute(n):
    near, form = brute_near(n), {}
    for w, ws in near.items():
        if ws:
            best = min(ws, key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def test_whole_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(brute_words(docs))
    assert any(r[1] for r in rows)


@pytest.mark.parametrize("block", [spelling.BLOCK, 40])
def test_dense_vocabulary(spark, block, monkeypatch):
    # few letters, so that most words have many near ones; a group of one prefix above the block size
    rng = random.Random(4)
    words = {"".join(rng.choice("abà") for _ in range(rng.choice([6, 6, 7, 8, 9]))) for _ in range(500)}
    words |= {"prefix" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(150)}
    n = {w: rng.choice([5, 6, 30, 200, 1000, 6000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    got = {r["word"]: (r["n_near"], r["near_n"], r["near_word"]) for r in
           spelling.near_words(df, block=block).collect()}
    want = {}
    for w, ws in brute_near(n).items():
        if ws:
            best = min(ws, key=lambda x: (-n[x], x))
            want[w] = (len(ws), n[best], best)
    assert got == want


def test_odd_documents(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {tuple(r) for r in spelling.variants(docs).collect()}
    assert got == brute(brute_words(rows))


def test_chain_of_forms(spark):
    # five-fold steps along near words: roots are several forms away
    text = " ".join(w for k, w in enumerate(["abcdefgh", "abcdefgi", "abcdefji", "abcdefi", "abcdlfi"])
                    for _ in range(5 ** (5 - k)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text.split())] + [(None, None), (0, "")],
                               "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in spelling.variants(df, divisor=0).collect()}
    n = Counter(text.split())
    assert got == brute({w: c for w, c in n.items() if c >= 5})
    assert {r[2] for r in got if r[0] == "abcdlfi"} == {"abcdefgh"}


def test_long_text_and_empty(spark, no_docs):
    rng = random.Random(9)
    text = " ".join("Wörter" + rng.choice("abc") + rng.choice("xyz") * rng.choice([1, 2]) for _ in range(200_000))
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    assert {tuple(r) for r in spelling.variants(df).collect()} == brute(brute_words([(7, text)]))
    assert spelling.variants(no_docs).collect() == []
