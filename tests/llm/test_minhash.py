"""Operator 2 against all pairs on full sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from vitalframe.llm import minhash
from vitalframe.llm.components import components

SF = "/root/testdata/sf0.01"


def brute(rows):
    sets, prints = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
        print_ = minhash.fingerprint(minhash.shingles((t or "").encode())) or b""
        if i is not None and (i not in sets or (len(s), print_) > prints[i]):
            sets[i], prints[i] = s, (len(s), print_)
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = defaultdict(int)
    for ids in holders.values():
        for x in range(len(ids)):
            for y in range(x):
                common[ids[x], ids[y]] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, **kw):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, **kw).collect() if r["doc_id"] is not None}
    assert set(got) == set(want)
    for i, (n, c) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (n, c), i
        assert got[i]["kept"] == (i == c)


def test_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edges(docs, no_docs):
    check(docs)
    alone = [r for r in minhash.near_duplicates(docs).collect() if r["doc_id"] is None]
    assert len(alone) == 1 and alone[0]["kept"]
    assert minhash.near_duplicates(no_docs).count() == 0


def groups(seed, n, edits, words=90):
    """A hot group: n copies of one text with some words replaced, and texts around one passage."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        out.append((i, " ".join(t)))
    passage = " ".join(f"p{j}" for j in range(60))
    for i in range(n, 2 * n):
        out.append((i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 120)))))
    return out


@pytest.mark.parametrize("edits", [2, 6])
def test_hot_groups_in_small_blocks(spark, edits):
    df = spark.createDataFrame(groups(edits, 120, edits), "doc_id long, text string")
    check(df, block=16, block_hashes=600)


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(groups(3, 60, 4), "doc_id long, text string")
    a = {tuple(r) for r in minhash.near_duplicates(df.repartition(1)).collect()}
    b = {tuple(r) for r in minhash.near_duplicates(df.repartition(7)).collect()}
    assert a == b


def test_need_is_safe():
    rng = np.random.default_rng(4)
    for _ in range(300):  # pairs at the threshold share at least need(s) sketch values
        u = int(rng.integers(8, 400))
        inter = -(-75 * u // 100)
        h = np.sort(rng.integers(0, 2**62, u))
        owner = rng.permutation(np.r_[np.zeros(inter), rng.integers(1, 3, u - inter)])
        a, b = h[owner != 2], h[owner != 1]
        sa, sb = a[:64], b[:64]
        assert len(np.intersect1d(sa, sb)) >= max(minhash.need(len(sa)), minhash.need(len(sb)))


@pytest.mark.parametrize("least, most", [(50, 70), (40, 64)])
def test_links_just_above_the_threshold(least, most):
    rng = np.random.default_rng(least)
    lost = pairs = 0
    while pairs < 3000:  # linked pairs: whole sets, one or both of them cut to 64
        a, b = (int(x) for x in rng.integers(least, most + 1, 2))
        common = -(-75 * (a + b) // 175) + int(rng.integers(0, 3))
        union = a + b - common
        if common > min(a, b) or not 75 * union <= 100 * common <= 80 * union:
            continue
        pairs += 1
        h = rng.choice(2**62, union, replace=False).astype(np.uint64)
        x, y = np.sort(h[:a]), np.sort(h[a - common:])
        lost += not minhash._estimated([x[:64], y[:64]], np.array([a, b]), 64, 75)
    assert lost == 0


def test_estimate_is_that_of_the_union_sketch():
    """All others at once against the union formed pair by pair."""
    rng = np.random.default_rng(12)
    sets = []
    for _ in range(120):
        base = rng.choice(400, int(rng.integers(3, 200)), replace=False).astype(np.uint64) * np.uint64(2**50 + 7)
        sets.append(np.sort(base))
    sets += [np.sort(np.r_[s[rng.random(len(s)) < 0.95], np.uint64(i)]) for i, s in enumerate(sets)]
    sizes, k, p = np.array([len(s) for s in sets]), 64, 0.75
    sketches = [s[:k] for s in sets]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def linked(i, j):
        small, big = sorted((sizes[i], sizes[j]))
        if small * 100 < big * 75:
            return False
        common = len(np.intersect1d(sketches[i], sketches[j]))
        if common < minhash.need(min(k, int(sizes[i]))) or common < minhash.need(min(k, int(sizes[j]))):
            return False
        if big <= k:
            return 100 * common >= 75 * (small + big - common)
        top = min(s[-1] if n > k else np.uint64(2**64 - 1) for s, n in ((sketches[i], sizes[i]), (sketches[j], sizes[j])))
        union = np.union1d(sketches[i], sketches[j])
        union = union[union <= top][:k]
        both = np.isin(union, sketches[i]) & np.isin(union, sketches[j])
        u = len(union)
        return both.sum() >= u * p - minhash.SIGMAS * np.sqrt(u * p * (1 - p)) - 1e-9

    for i in range(len(sets)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    mine = list(range(len(sets)))
    for a, b in minhash._estimated(sketches, sizes, k, 75):
        mine = [mine[a] if m == mine[b] else m for m in mine]
    groups = lambda names: {frozenset(i for i in range(len(sets)) if names[i] == n) for n in names}
    fine, want = groups(mine), groups([find(i) for i in range(len(sets))])
    # need() is asked of one side of a pair only, so a link may be handed on that both sides' need would drop
    assert all(any(w <= f for f in fine) for w in want) and max(map(len, want)) > 1


def test_two_edited_words_are_found(spark):
    rows = []
    for g in range(40):  # 63 shingles each, 54 of 72 in common: the threshold itself
        words = [f"g{g}w{j}" for j in range(67)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:30] + ["e"] + words[31:34] + ["f"] + words[35:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == 80
    check(df)


@pytest.mark.parametrize("near", ["a", "b"])
def test_repeated_ids_of_equal_size(spark, near):
    # ids with two texts of equal set size, one of them beside a near copy: the text that stands for the id is
    # the same in every step, so the link is found whenever that text has it
    rows = []
    for g in range(30):
        texts = {k: [f"{k}{g}w{j}" for j in range(60)] for k in "ab"}
        rows += [(3 * g, " ".join(texts["a"])), (3 * g, " ".join(texts["b"])), (3 * g + 1, " ".join(texts[near][:-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert sum(got[3 * g + 1] == 3 * g for g in range(30)) >= 5  # about half of the ids stand for each text
    check(df.unionByName(df))  # every row twice


def test_lists_are_cut_as_sets_are_reached():
    import time
    rng = np.random.default_rng(3)
    base = rng.choice(2**62, 100, replace=False).astype(np.uint64)

    def run(n):
        sets = [np.sort(np.r_[base[:95], rng.choice(2**62, 5).astype(np.uint64)]) for _ in range(n)]
        start = time.perf_counter()
        edges = minhash._linked(sets, lambda x, others, common: common >= 80)
        assert len(edges) == n - 1
        return time.perf_counter() - start

    run(200)
    assert run(4000) < 2.0  # 10.8 s when every member met all the others


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    edges += [(500, 500), (7, 5), (5, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
