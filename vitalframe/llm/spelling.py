"""Spelling variants: words one edit apart, found by a bit-sliced position index.

1.  Words are counted in one pass over the whole texts (partial counts per task).
2.  Near words differ by one inserted, deleted or replaced code point.  For the
    shorter one's length l, a pair shares its first l // 2 code points, or, if the
    edit lies in them, its last l - l // 2.  Every word stands under both keys of
    class l (its length) and of class l - 1 (as the longer word).
3.  Groups of a class and kind of key are packed into blocks of words.  A block's
    index holds, per (position, letter), the set of its words with that letter there,
    as bits.  For many query words of length l at once, the recurrences over j

        E0 <- E0 & at[j][q_j]                     words equal so far
        E1 <- (E1 & at[j][q_j]) | (E0 & ~at[j][q_j])   one replaced
        I  <- (I & at[j + 1][q_j]) | E0           one inserted: positions shifted by one

    run over whole machine words of 64 vocabulary words.  First-half blocks keep hits
    whose first half is equal, last-half blocks the others, so a pair is found once.
4.  A group above ``BLOCK`` words is dealt to pairs of blocks, each its own task.
5.  Per word the near words are counted and the best one kept, before any shuffle;
    forms are followed to their roots by pointer doubling over written tables.

Defined cases: a null text has no words; a null id counts as an empty one in the
checksum; repeated rows count each; a run that loses its only code point is no word;
very long texts are read run by run; empty tables give no rows; other columns are
ignored; ties of the form go to the word that is smallest in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bound_batches, texts_of

LEAST_LENGTH = 6
LEAST_COUNT = 5
DOMINANCE = 5        # a form is at least so many times as frequent
MISSPELL = 199       # a run whose checksum this number divides loses a code point
PACK = 4096          # words of small groups that share an index
BLOCK = 32768        # words of one group that share an index
HELD = 200_000       # distinct words a counting task holds before it hands them on
_CELLS = 1 << 17     # query words x machine words that one step of the recurrences touches
_PIECE = 1 << 20


def _runs(text: bytes, least: int) -> Counter:
    """Distinct lower-cased runs of at least ``least`` code points and their counts."""
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % least)  # bytes.lower() changes A-Z only
    body = text.lower().decode("utf-8", "replace")
    if len(body) <= _PIECE:
        return Counter(pattern.findall(body))
    return Counter(m.group() for m in pattern.finditer(body))


def _spelt(doc_id, text: bytes, least: int, divisor: int, into: dict) -> None:
    """Add a text's words of at least ``least`` code points to ``into``."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in _runs(text, least).items():
        h = zlib.crc32(run.encode(), start)
        if divisor and h % divisor == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        into[run] = into.get(run, 0) + n


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, divisor: int = MISSPELL,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): every word of at least ``least_length`` code points, over all documents."""
    bound_batches(documents.sparkSession)
    body = documents.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))

    def batch(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                if t:
                    _spelt(i, t, least_length, divisor, held)
                    if len(held) > HELD:
                        yield batch(held)
                        held = {}
        if held:
            yield batch(held)

    return body.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Bit-sliced position index of a block of words of lengths l and l + 1."""

    def __init__(self, words: list, length: int):
        self.words, self.length = words, length
        wide = length + 1
        codes = np.array(words, dtype=f"<U{wide}").view(np.uint32).reshape(len(words), wide)
        self.codes = codes
        sizes = np.array([len(w) for w in words])
        pad = -len(words) % 64

        def bits(mask):
            return np.packbits(np.pad(mask, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)

        self.letters, self.at = [], []
        for j in range(wide):
            letters = np.unique(codes[:, j])
            self.letters.append(letters)
            # one row per letter, and a last, empty one for letters that no word has here
            mask = np.vstack([letters[:, None] == codes[None, :, j], np.zeros((1, len(words)), bool)])
            self.at.append(bits(mask))
        self.same = bits((sizes == length)[None, :])[0]
        self.longer = bits((sizes == length + 1)[None, :])[0]

    def _row(self, j: int, letters: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.letters[j], letters)
        k = np.where((k < len(self.letters[j])) & (self.letters[j][np.minimum(k, len(self.letters[j]) - 1)] == letters),
                     k, len(self.letters[j]))
        return self.at[j][k]

    def near(self, queries: np.ndarray, half: int, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, word number) of words one replaced or inserted code point away from queries of
        length l, given as their code points: those that share the first ``half`` of them, or the others."""
        wide = len(self.same)
        step = max(1, _CELLS // wide)
        for lo in range(0, len(queries), step):
            q = queries[lo:lo + step]
            e0 = np.full((len(q), wide), np.uint64(2**64 - 1))
            e1 = np.zeros_like(e0)
            ins = e0.copy()
            for j in range(self.length):
                m = self._row(j, q[:, j])
                e1 = (e1 & m) | (e0 & ~m)
                e0 &= m
                ins &= self._row(j + 1, q[:, j])
                ins |= e0
                if j == half - 1:
                    part = e0.copy() if first else ~e0
            hit = ((e1 & self.same) | (ins & self.longer)) & part
            row, col = np.nonzero(hit)
            if len(row):
                k, bit = np.nonzero(np.unpackbits(hit[row, col].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield lo + row[k], col[k] * 64 + bit


def _pairs(rows: list, others: list | None, length: int, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Directed near pairs as numbers into rows + others.  With others, only pairs across the two lists."""
    half = length // 2
    sides = [(rows, 0, rows, 0)] if others is None else [(rows, 0, others, len(rows)), (others, len(rows), rows, 0)]
    for asked, a0, held, h0 in sides:
        at = np.array([i for i, r in enumerate(asked) if len(r[0]) == length], np.int64)
        if not len(at) or not held:
            continue
        index = Index([r[0] for r in held], length)
        codes = np.array([asked[i][0] for i in at], dtype=f"<U{length}").view(np.uint32).reshape(len(at), length)
        longer = np.array([len(r[0]) > length for r in held])
        for q, w in index.near(codes, half, first):
            yield at[q] + a0, w + h0
            back = longer[w]  # a longer word is never a query here: its link is told to it as well
            yield w[back] + h0, at[q[back]] + a0


_FOUND = "word string, n_near long, near_n long, near_word string"


def _found(rows: list, others: list | None, length: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Per word of a block that has near words here: how many, and the best of them."""
    parts = list(_pairs(rows, others, length, first))
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(a):
        return
    every = rows + (others or [])
    words = np.array([r[0] for r in every])
    n = np.array([r[1] for r in every], np.int64)
    place = np.empty(len(words), np.int64)
    place[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    count = np.diff(np.r_[start, len(a)])
    best = b[start]
    yield pa.RecordBatch.from_arrays(
        [pa.array(words[a[start]].tolist(), pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()),
         pa.array(words[best].tolist(), pa.string())], names=["word", "n_near", "near_n", "near_word"])


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, first, key, pair, own, word, n), a task's groups one after the other."""
    pack, of = [], None
    group, name = [], None

    def close():
        nonlocal pack, of
        if name is None or len(group) < 2:
            return
        length, first, _, pair = name
        if pair:  # a large group's pair of blocks: an index of its own
            a, b = pair.split("-")
            if a == b:
                yield from _found([r[1:] for r in group], None, length, first)
            else:
                yield from _found([r[1:] for r in group if str(r[0]) == a], [r[1:] for r in group if str(r[0]) == b],
                                  length, first)
            return
        if not any(len(r[1]) == length for r in group):
            return
        if of != (length, first) or len(pack) >= PACK:
            if pack:
                yield from _found(pack, None, *of)
            pack, of = [], (length, first)
        pack += [r[1:] for r in group]

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:4] != name:
                yield from close()
                group, name = [], row[:4]
            group.append(row[4:])
    yield from close()
    if pack:
        yield from _found(pack, None, *of)


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near_word) for every word of (word, n) that has near words: their number, and the
    most frequent one (ties: the smallest in code-point order)."""
    size = F.length("word")

    def keyed(length):
        half = F.floor(length / 2).cast("int")
        return [F.struct(length.alias("l"), F.lit(True).alias("first"), F.substring("word", F.lit(1), half).alias("key")),
                F.struct(length.alias("l"), F.lit(False).alias("first"),
                         F.expr("word").substr(size - (length - half) + 1, length - half).alias("key"))]

    keys = F.when(size > least_length, F.array(*keyed(size), *keyed(size - 1))).otherwise(F.array(*keyed(size)))
    rows = vocabulary.select("word", "n", F.explode(keys).alias("k")).select("k.*", "word", "n")
    large = cut_lineage(rows.groupBy("l", "first", "key").agg(F.count("*").alias("c")).where(F.col("c") > block)
                        .withColumn("_blocks", F.ceil(F.col("c") / block).cast("long")).drop("c"), "spelling-large")
    rows = rows.join(large, ["l", "first", "key"], "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("_blocks", F.lit(1))))
    pair = F.when(F.col("_blocks").isNull(), F.array(F.lit(""))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1),
        lambda j: F.concat_ws("-", F.least(j, F.col("own")).cast("string"), F.greatest(j, F.col("own")).cast("string"))))
    dealt = rows.withColumn("pair", F.explode(pair)).select("l", "first", "key", "pair", "own", "word", "n")
    order = ["l", "first", "key", "pair"]
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_work, _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("w")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.w").alias("near_word")))


def follow(forms: DataFrame, name: str = "spelling-roots") -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last, in a logarithmic number of rounds."""
    far = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(None).cast("string").alias("_next")), name)
    while True:
        now = far.select("word", F.coalesce("_next", "root").alias("root"))
        step = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        far = cut_lineage(now.join(step, F.col("root") == F.col("_at"), "left").select("word", "root", "_next"), name, replaces=far)
        if not far.where(F.col("_next").isNotNull()).limit(1).count():
            return far.select("word", "root")


def variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             dominance: int = DOMINANCE, divisor: int = MISSPELL, block: int = BLOCK, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counts = word_counts(documents, least_length, divisor, id_col, text_col)
    vocabulary = cut_lineage(counts.where(F.col("n") >= least_count), "spelling-words")
    near = vocabulary.join(near_words(vocabulary, least_length, block), "word", "left")
    better = F.col("near_n") >= dominance * F.col("n")
    near = cut_lineage(near.select(
        "word", F.when(better, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(better, F.col("near_n")).alias("form_n")), "spelling-near")
    roots = follow(near.where(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
