"""Near-duplicates by bottom-k sketches, confirmed on full shingle sets.

A document's shingles are hashed once (64 bits); its sketch are the ``K`` smallest
hashes, the first part of its sorted set.

1.  Equal sets are one class (by a 128-bit fingerprint); one text of each goes on.
2.  Inverted lists of retained values: a value that only one class retains cannot
    link; a class needs at least ``need(s)`` shared values, of the s that it
    retains, to reach the similarity.  Ordered by how many classes retain them,
    rarest first, two linked classes share one of the first s - need(s) + 1, so
    only these make lists.  Very common values (of a shared passage) come last and
    make lists only where little else is retained.
3.  In each list, overlaps of the whole sketches are counted.  Of two sets that their
    sketches hold whole, that is the exact similarity; else it is estimated from the
    sketch of the union, with slack.  A list hands on the connections among
    its classes as a spanning forest, never all its pairs.  Lists over ``BLOCK``
    classes are dealt to pairs of blocks.
4.  Classes that such estimates connect are grouped; within a group, full sets are
    intersected, in blocks by set size (sizes that differ too much can't link),
    and exact links are handed on as spanning forests.
5.  The exact links' components are the result.

Two sets of up to ``K`` shingles are never missed.  Else ``need`` and the estimate
allow five standard deviations, so a link at the very threshold is missed with a
probability below 1.4 in a million (binomial, 30 or fewer of 64), a closer one with
less.

Defined cases: null or empty texts, or texts without a word, have an empty set and
stand alone; a text with fewer words than a shingle is one shingle; rows that
repeat a doc_id are one document (the union isn't formed: the row with the largest
set counts, of equally large ones that with the largest fingerprint, in every step);
a null doc_id stands alone and is kept; very long texts are hashed whole, a word and
a shingle at a time in arrays; columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import with_text_columns
from .components import components

SHINGLE = 5
PERCENT = 75            # 100 * intersection >= PERCENT * union
K = 64                  # retained values
SIGMAS = 5.0
BLOCK = 1024            # classes of a list that one task compares
BLOCK_HASHES = 1 << 19  # hashes of a group's block that one task holds
BROADCAST_IDS = 1 << 22  # ids of grouped classes that are broadcast (tens of MB); more are joined by a shuffle
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's word shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D separate
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = max(1, len(w) - size + 1)
    h = np.full(m, min(len(w), size), np.uint64)
    for j in range(min(size, len(w))):
        h = (h ^ w[j:j + m]) * _MIX
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def need(s: int, k: int = K, percent: int = PERCENT) -> int:
    """Values that a sketch of s values must share with that of a class it is linked to."""
    p = percent / 100
    some = max(1, math.floor(k * p - SIGMAS * math.sqrt(k * p * (1 - p))))
    whole = -(-s * percent // 100)
    return max(1, whole if s * 100 <= k * percent else min(some, whole))


def fingerprint(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketch_table(documents: DataFrame, k: int = K, size: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(_id, _n, _fp, _sk): set size, fingerprint and sketch of every whole text."""
    fields = [T.StructField("_n", T.LongType()), T.StructField("_fp", T.BinaryType()),
              T.StructField("_sk", T.ArrayType(T.LongType()))]

    def work(texts):
        n, fp, sk = [], [], []
        for t in texts:
            h = shingles(t, size)
            n.append(len(h))
            fp.append(fingerprint(h))
            sk.append(h[:k].view(np.int64))
        return [n, fp, sk]

    plain = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    return with_text_columns(plain, "_t", fields, lambda: work, keep=["_id"])


def _forest(n: int, edges) -> list:
    """Edges of a spanning forest, from pairs of numbers below n."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _linked(sets: list, test) -> list:
    """Spanning forest of the sets that ``test`` links.

    ``test(x, others, common)`` says which of ``others`` are linked to x, given the
    sizes of their intersections.  Every set is compared, through inverted lists,
    with all that its component has not reached yet; whenever half of those on the
    lists are reached, the lists are cut to the rest.
    """
    if len(sets) < 2:
        return []
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, listed = owner[order], code[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    fresh = np.ones(len(sets), bool)
    left = on_lists = len(sets)  # sets not reached yet, and those when the lists were last cut
    out = []
    for start in range(len(sets)):
        if not fresh[start]:
            continue
        fresh[start] = False
        left -= 1
        todo = [start]
        while todo and left:
            x = todo.pop()
            if 2 * left <= on_lists:
                keep = fresh[holders]
                holders, listed = holders[keep], listed[keep]
                at = np.concatenate([[0], np.cumsum(np.bincount(listed, minlength=len(values)))])
                on_lists = left
            mine = code[ends[x]:ends[x + 1]]
            mine = mine[at[mine + 1] > at[mine]]
            if not len(mine):
                continue
            met = np.concatenate([holders[at[c]:at[c + 1]] for c in mine])
            common = np.bincount(met, minlength=len(sets))
            others = np.flatnonzero(fresh & (common > 0))
            if len(others):
                hit = others[test(x, others, common[others])]
                fresh[hit] = False
                left -= len(hit)
                out += [(x, int(y)) for y in hit]
                todo += hit.tolist()
    return out


def _estimated(sketches: list, sizes: np.ndarray, k: int, percent: int) -> list:
    """Spanning forest of the classes whose similarity, exact for two whole sets and else estimated from the
    union's sketch, may reach the threshold."""
    p = percent / 100
    whole = sizes <= k  # the sketch holds the set
    none = np.uint64(2**64 - 1)
    tops = np.array([none if w else s[-1] for s, w in zip(sketches, whole, strict=True)], np.uint64)
    length = np.array([len(s) for s in sketches])
    every = np.full((len(sketches), max(k, length.max(initial=0))), none)
    for i, s in enumerate(sketches):
        every[i, :len(s)] = s
    place = np.arange(every.shape[1])

    def estimate(x, others):
        """Whether the sketch of each union with x, k values at most and none beyond what both sketches
        cover, holds enough values of both: all others at once."""
        mine, theirs = sketches[x], every[others]
        real = place < length[others, None]
        below = np.searchsorted(mine, theirs)
        shared = real & (mine[np.minimum(below, len(mine) - 1)] == theirs) & (below < len(mine))
        top = np.minimum(tops[x], tops[others])
        covered = real & (theirs <= top[:, None])
        u = np.searchsorted(mine, top, side="right") + covered.sum(axis=1) - (shared & covered).sum(axis=1)
        u = np.minimum(u, k)
        # a value's place in the union: values of either below it, those of both counted once
        rank = below + place - (shared.cumsum(axis=1) - shared)
        both = (shared & covered & (rank < u[:, None])).sum(axis=1)
        return both >= u * p - SIGMAS * np.sqrt(u * p * (1 - p)) - 1e-9

    def test(x, others, common):
        small, big = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        near = (small * 100 >= big * percent) & (common >= need(min(k, int(sizes[x])), k, percent))
        exact = whole[others] & whole[x]
        near &= ~exact | (100 * common >= percent * (sizes[x] + sizes[others] - common))
        at = np.flatnonzero(near & ~exact)
        if len(at):
            near[at] = estimate(x, others[at])
        return near

    return _linked(sketches, test)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _grouped(work):
    """A function for mapInArrow over rows sorted by their first column: one call per key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[0] != key:
                    if len(rows) > 1:
                        yield from _edges(work(rows))
                    key, rows = row[0], []
                rows.append(row[1:])
        if len(rows) > 1:
            yield from _edges(work(rows))
    return run


def _edges(pairs: list):
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)


def _by_key(df: DataFrame, work) -> DataFrame:
    """Apply ``work`` to the rows of each key (first column), all of a key in one task, keys bounded in size."""
    key = df.columns[0]
    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(_grouped(work), "a long, b long")


def _block_pairs(rows: DataFrame, keys: list, blocks) -> DataFrame:
    """Deal rows to pairs of their key's blocks: column ``_task`` names key and pair.

    ``blocks`` is the number of blocks of the row's key, ``_own`` the row's block.
    """
    pair = F.when(blocks <= 1, F.array(F.lit("0"))).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1), lambda j: j != F.col("_own")),
        lambda j: F.concat_ws("-", F.least(j, F.col("_own")).cast("string"), F.greatest(j, F.col("_own")).cast("string"))))
    return rows.withColumn("_pair", F.explode(pair)).withColumn(
        "_task", F.xxhash64(*keys, F.col("_pair")))


def candidate_edges(sk: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Spanning-forest edges among classes whose estimated similarity may reach the threshold."""
    values = sk.select("_id", F.explode("_sk").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    held = values.join(shared, "v")
    # need(s) as a lookup over s = 0..k
    needs = F.array(*[F.lit(need(s, k, percent)) for s in range(k + 1)])
    own = (held.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("_fv"))
           .join(sk.select("_id", "_n", "_sk"), "_id")
           .withColumn("_need", needs[F.size("_sk")])
           .where(F.size("_fv") >= F.col("_need")))
    # rarest first: values of one class alone stand before the shared ones in the prefix
    first = F.size("_sk") - F.col("_need") + 1 - (F.size("_sk") - F.size("_fv"))
    own = cut_lineage(own.select("_id", "_n", F.expr("transform(_sk, x -> x)").alias("_sk"),
                                 F.slice("_fv", 1, F.greatest(first, F.lit(1))).alias("_fv"))
                      .select("_id", "_n", "_sk", F.transform("_fv", lambda x: x["v"]).alias("_keys")), "near-prefix")
    lists = own.select("_id", "_n", "_sk", F.explode("_keys").alias("v"))
    length = (own.select(F.explode("_keys").alias("v")).groupBy("v").agg(F.count("*").alias("_len"))
              .where(F.col("_len") > 1))
    blocks = F.ceil(F.col("_len") / block)
    dealt = lists.join(length, "v").withColumn("_own", F.pmod(F.xxhash64(F.lit(7), "_id"), blocks))
    dealt = _block_pairs(dealt, ["v"], blocks).select("_task", "_id", "_n", "_sk")

    def work(rows):
        ids = [r[0] for r in rows]
        sets = [np.array(r[2], np.int64).view(np.uint64) for r in rows]
        found = _estimated(sets, np.array([r[1] for r in rows], np.int64), k, percent)
        return [(ids[a], ids[b]) for a, b in found]

    return _by_key(dealt, work).distinct()


def exact_edges(documents: DataFrame, groups: DataFrame, percent: int, size: int, block_hashes: int,
                id_col: str, text_col: str) -> DataFrame:
    """Spanning-forest edges among classes whose full sets reach the threshold.

    ``groups`` (_id, _n, _g, _fp, _many): the classes to compare, each with the
    fingerprint of the row that stands for it and whether rows repeat its id.  Sets are
    formed anew from those rows' texts, dealt to blocks by set size, so neither tables
    nor tasks hold all.
    """
    band = F.floor(F.log(F.col("_n")) / F.lit(-math.log(percent / 100))).cast("long")
    rows = groups.withColumn("_band", band)
    weight = rows.groupBy("_g", "_band").agg(
        F.ceil(F.sum("_n") / block_hashes).cast("long").alias("_blocks"))
    rows = rows.join(weight, ["_g", "_band"])
    beside = weight.select("_g", (F.col("_band") - 1).alias("_band"), F.col("_blocks").alias("_above"))
    below = weight.select("_g", (F.col("_band") + 1).alias("_band"), F.col("_blocks").alias("_below"))
    rows = rows.join(beside, ["_g", "_band"], "left").join(below, ["_g", "_band"], "left")
    me = F.pmod(F.xxhash64(F.lit(11), "_id"), F.col("_blocks"))
    name = lambda b, j: F.concat_ws(":", b.cast("string"), j.cast("string"))
    mine = name(F.col("_band"), me)

    def others(count, b):
        return F.when(F.coalesce(count, F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(count, F.lit(1)) - 1), lambda j: name(b, j)))

    # With the blocks of the next band up and down, and the other blocks of its own band.
    same = F.filter(others(F.col("_blocks"), F.col("_band")), lambda x: x != mine)
    up, down = others(F.col("_above"), F.col("_band") + 1), others(F.col("_below"), F.col("_band") - 1)
    partners = F.concat(same, up, down)
    partners = F.when(F.size(partners) == 0, F.array(mine)).otherwise(partners)
    dealt = rows.withColumn("_pair", F.explode(F.transform(
        partners, lambda x: F.concat_ws("-", F.least(x, mine), F.greatest(x, mine)))))
    dealt = dealt.select("_id", F.xxhash64("_g", "_pair").alias("_task"))
    texts = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    fields = [T.StructField("_set", T.BinaryType()), T.StructField("_own", T.BinaryType())]

    def work(texts):
        found = [shingles(t, size) for t in texts]
        return [[h.tobytes() for h in found], [fingerprint(h) for h in found]]

    def formed(part: DataFrame, n: int) -> DataFrame:
        """(_id, _set, _own) of every row whose id is in ``part``, ids of ``n`` classes."""
        ids = part.select("_id")
        some = texts.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "_id", "left_semi")
        return with_text_columns(some, "_t", fields, lambda: work, keep=["_id"])

    prints = groups.select("_id", "_fp")
    count = groups.agg(F.count("*").alias("n"), F.count_if("_many").alias("many")).first()
    sets = formed(groups.where("not _many"), count["n"] - count["many"]).select("_id", "_set")
    if count["many"]:  # of rows that repeat an id: one that holds the set that counts
        again = formed(groups.where("_many"), count["many"]).groupBy("_id", F.col("_own").alias("_fp")).agg(
            F.first("_set").alias("_set"))
        sets = sets.unionByName(again.join(prints, ["_id", "_fp"], "left_semi").select("_id", "_set"))
    full = dealt.join(sets, "_id").select("_task", "_id", "_set")

    def compare(rows):
        found = [np.frombuffer(r[1], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in found], np.int64)

        def test(x, others, common):
            return 100 * common >= percent * (sizes[x] + sizes[others] - common)

        return [(rows[a][0], rows[b][0]) for a, b in _linked(found, test)]

    return _by_key(full, compare)


def near_duplicates(documents: DataFrame, percent: int = PERCENT, k: int = K, size: int = SHINGLE,
                    block: int = BLOCK, block_hashes: int = BLOCK_HASHES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return judged(documents, percent, k, size, block, block_hashes, id_col, text_col).drop("fingerprint", "repeated")


def judged(documents: DataFrame, percent: int = PERCENT, k: int = K, size: int = SHINGLE, block: int = BLOCK,
           block_hashes: int = BLOCK_HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`near_duplicates` with the ``fingerprint`` of the row that was compared (null for an empty set) and
    whether the id is ``repeated``."""
    every = cut_lineage(sketch_table(documents, k, size, id_col, text_col), "near-sketches")
    # One row per document: of rows that repeat an id, the one with the largest set and fingerprint.
    docs = every.where(F.col("_id").isNotNull()).groupBy("_id").agg(
        F.max(F.struct("_n", "_fp")).alias("x"), (F.count("*") > 1).alias("_many")).select("_id", "x._n", "x._fp", "_many")
    docs = cut_lineage(docs, "near-documents")
    reps = docs.where(F.col("_n") > 0).groupBy("_fp").agg(F.min(F.struct("_id", "_many")).alias("x")).select(
        "_fp", F.col("x._id").alias("_rep"), F.col("x._many").alias("_many"))
    sk = (every.join(reps.select(F.col("_fp"), F.col("_rep").alias("_id"), "_many"), ["_id", "_fp"])
          .dropDuplicates(["_id"]).select("_id", "_n", "_sk", "_fp", "_many"))
    sk = cut_lineage(sk, "near-classes")
    group = components(candidate_edges(sk.select("_id", "_n", "_sk"), k, percent, block), name="near-groups")
    member = group.select(F.col("node").alias("_id"), F.col("root").alias("_g"))
    member = member.unionByName(member.select(F.col("_g").alias("_id"), "_g").distinct())
    groups = cut_lineage(member.join(sk.select("_id", "_n", "_fp", "_many"), "_id"), "near-members")
    links = exact_edges(documents, groups, percent, size, block_hashes, id_col, text_col)
    found = components(links, name="near-links").select(F.col("node").alias("_rep"), "root")
    named = reps.join(found, "_rep", "left").select("_fp", F.coalesce("root", "_rep").alias("_root"))
    out = docs.join(named, "_fp", "left").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"),
        F.coalesce("_root", "_id").alias("component_id"), F.col("_fp").alias("fingerprint"), F.col("_many").alias("repeated"))
    alone = every.where(F.col("_id").isNull()).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"),
        F.col("_fp").alias("fingerprint"), F.lit(False).alias("repeated"))
    return out.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "fingerprint", "repeated")
