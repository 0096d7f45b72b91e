"""Hierarchical multi-length packing of tokenised documents.

Every task tokenises its documents and packs them as they stream by, so nothing
but the input is read and nothing is shuffled.  A document's ids first fill whole
windows of the largest size; its rest is routed to the smallest window size
(``TIERS``) that holds it.  From the largest size down, each window takes the
longest waiting piece, then its gap takes the longest pieces of the shorter tiers
that fit whole; only when none fits is a waiting piece cut to close the gap
exactly.  The windows of one size are dealt to step groups of ``STEP_TOKENS``
tokens, in order of attention cost (sum of squared piece lengths), back and forth,
so that steps cost about the same.  A task's last, unfilled window is cut into
powers of two, so no sequence is padded.

Tokens of a white-space-free chunk do not depend on its neighbours with the given
tokenizer (its pre-tokenizer never joins across white space), so chunks are
tokenised once and kept in a bounded table per worker.

Defined cases: a null or empty text has the end id only; repeated rows are packed
as often as they occur; texts of any length are cut, never truncated; an empty
table gives no sequences; columns beside id and text are ignored.  Sequence and
step numbers contain the partition number, so they are unique without coordination.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import bound_batches, texts_of

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
END_ID = 2
BUFFER = 2048        # waiting pieces per task between packings
HELD_TOKENS = 1 << 22   # ids in finished windows at which they are handed on
TEXT_BYTES = 1 << 22    # texts tokenised at once
MEMO = 700_000       # chunks kept per Python worker
MEMO_BYTES = 64      # longest of them
_MARKS = b".,;:!?#*$%&)("  # none of these starts a contraction or a special string


class Tokens:
    """Texts to little-endian unsigned 32-bit ids, by chunks kept in a bounded table."""

    def __init__(self, tokenizer_path: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.no_truncation()
        self.tok.no_padding()
        # The same merges behind a plain split at blanks, for words of lower-case ASCII letters.
        plan = json.loads(self.tok.to_str())
        plan |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(plan))
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for name, i in self.tok.get_vocab().items() if name.endswith("</w>")]] = True
        self.memo: dict = {}
        self.most = memo

    def _one_text(self, tok, chunks: list) -> list:
        """Ids of chunks that are one pre-token each: tokenised as one text, told apart by word ends."""
        ids = np.array(tok.encode_batch_fast([b" ".join(chunks).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(chunks):
            return self._each(chunks)  # a letter that the tokenizer's normaliser splits
        raw, at, out = ids.tobytes(), 0, []
        for stop in (4 * stops).tolist():
            out.append(raw[at:stop])
            at = stop
        return out

    def _each(self, chunks: list) -> list:
        enc = self.tok.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in enc]

    def _raw(self, chunks: list) -> dict:
        """Chunk -> ids.  Lower-case ASCII words need neither normaliser nor pre-tokenizer."""
        lower, letters, rest = [], [], []
        for c in chunks:
            if c.isalpha() and c.islower():  # bytes: ASCII only
                lower.append(c)
            elif not c.isascii() and _lower_letters(c.decode("utf-8")):
                letters.append(c)
            else:
                rest.append(c)
        out: dict = {}
        if lower:
            out.update(zip(lower, self._one_text(self.bare, lower), strict=True))
        if letters:
            out.update(zip(letters, self._one_text(self.tok, letters), strict=True))
        if rest:
            out.update(zip(rest, self._each(rest), strict=True))
        return out

    def _learn(self, missing: set) -> dict:
        """Chunk -> ids of the missing chunks; the short ones are kept."""
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        bare, parts = set(), {}
        for c in missing:
            head = c if c.isalpha() else c.rstrip(_MARKS)
            if head and len(head) < len(c) and _closed(head):
                tail = c[len(head):]
                parts[c] = head, tail
                bare.add(head)
                bare.add(tail)
            else:
                bare.add(c)
        got = self._raw([c for c in bare if c not in memo])
        for c, (a, b) in parts.items():
            got[c] = (got[a] if a in got else memo[a]) + (got[b] if b in got else memo[b])
        memo.update([x for x in got.items() if len(x[0]) <= MEMO_BYTES])
        return got

    def ids(self, texts: list) -> list:
        """Ids of each whole text, as bytes."""
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif b"<|" in t:  # special strings are matched before lower-casing
                split.append(t.split())
            else:
                split.append(t.lower().split())
        get = self.memo.get
        found, holes, missing = [], [], set()
        for words in split:
            got = list(map(get, words))
            if None in got:
                hole = [k for k, x in enumerate(got) if x is None]
                missing.update([words[k] for k in hole])
                holes.append((words, got, hole))
            found.append(got)
        if missing:
            learnt = self._learn(missing)
            for words, got, hole in holes:
                for k in hole:
                    got[k] = learnt[words[k]]
        return [b"".join(x) for x in found]


def _lower_letters(c: str) -> bool:
    return c.isalpha() and c.lower() == c


def _closed(head: bytes) -> bool:
    """Whether a letter or digit ends ``head``, so that following marks are tokens of their own."""
    last = head[-1]
    if last < 128:
        return 48 <= last <= 57 or 97 <= last <= 122 or 65 <= last <= 90
    return _lower_letters(head.decode("utf-8")[-1])


@lru_cache(maxsize=1)
def _worker_tokens(tokenizer_path: str) -> Tokens:
    """One table per Python worker, so that its later tasks find the chunks of earlier ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
    return Tokens(tokenizer_path)


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens) into windows of the tiers' sizes."""

    def __init__(self, tiers: tuple, step_tokens: int, base: int):
        self.tiers, self.step = tuple(sorted(tiers)), step_tokens
        self.next_sequence = self.next_step = base
        self.wait: list = []      # (length, number) ascending
        self.piece: dict = {}     # number -> (doc, start, ids, doc_tokens)
        self.serial = 0
        self.done: dict = {t: [] for t in self.tiers}
        self.full = 0             # ids in whole windows of long documents since the last flush

    def _add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.serial += 1
        self.piece[self.serial] = (doc, start, ids, total)
        insort(self.wait, (len(ids) // 4, self.serial))

    def add(self, doc, ids: bytes) -> None:
        top, total = self.tiers[-1], len(ids) // 4
        whole = total // top
        self.full += whole * top
        for k in range(whole):
            self.done[top].append([(doc, k * top, ids[4 * k * top:4 * (k + 1) * top], total)])
        if total > whole * top:
            self._add(doc, whole * top, ids[4 * whole * top:], total)

    def _take(self, at: int) -> tuple:
        return self.piece.pop(self.wait.pop(at)[1])

    def _cut(self, at: int, length: int) -> tuple:
        doc, start, ids, total = self._take(at)
        self._add(doc, start + length, ids[4 * length:], total)
        return doc, start, ids[:4 * length], total

    def pack(self, last: bool = False) -> None:
        """Fill windows from the waiting pieces; an unfilled window's pieces wait on, unless last."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.wait and self.wait[-1][0] > below:
                window = [self._take(len(self.wait) - 1)]
                gap = size - len(window[0][2]) // 4
                while gap and self.wait:
                    at = bisect_right(self.wait, (gap, 1 << 62)) - 1
                    window.append(self._take(at) if at >= 0 else self._cut(0, gap))
                    gap -= len(window[-1][2]) // 4
                if gap == 0:
                    self.done[size].append(window)
                    continue
                if not last:
                    for p in window:
                        self._add(*p)
                    return
                self._powers(window, size - gap)

    def _powers(self, window: list, left: int) -> None:
        """The last window, cut into sequences whose lengths are powers of two."""
        while left:
            size = 1 << (left.bit_length() - 1)
            part, room = [], size
            while room:
                doc, start, ids, total = window.pop(0)
                n = min(room, len(ids) // 4)
                part.append((doc, start, ids[:4 * n], total))
                if n < len(ids) // 4:
                    window.insert(0, (doc, start + n, ids[4 * n:], total))
                room -= n
            self.done.setdefault(size, []).append(part)
            left -= size

    def flush(self) -> list:
        """Rows of the finished windows, dealt to step groups."""
        rows = []
        for size, windows in self.done.items():
            if not windows:
                continue
            groups = -(-len(windows) * size // self.step)
            windows.sort(key=lambda w: -sum((len(p[2]) // 4) ** 2 for p in w))
            for k, window in enumerate(windows):
                turn, at = divmod(k, groups)
                group = self.next_step + (groups - 1 - at if turn % 2 else at)
                offset = 0
                for doc, start, ids, total in window:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), total, self.next_sequence, offset, size, group))
                    offset += n
                self.next_sequence += 1
            self.next_step += groups
        self.done = {t: [] for t in self.tiers}
        self.full = 0
        return rows


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, rows) of slices of at most 64 texts and, but for a single longer one, ``TEXT_BYTES``."""
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    first = held = 0
    for at, size in enumerate(sizes):
        if at > first and (at - first == 64 or held + size > TEXT_BYTES):
            yield first, at - first
            first, held = at, 0
        held += size
    if sizes:
        yield first, len(sizes) - first


def pack(documents: DataFrame, tokenizer_path: str, tiers: tuple = TIERS, end_id: int = END_ID,
         step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where its ids come from and where they lie in which sequence.

    ``tokenizer_path`` must be readable on every executor.  ``tier`` is the
    sequence's size, ``step_group`` the training step that it belongs to.
    """
    bound_batches(documents.sparkSession)
    body = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    schema = pa.schema([(c, pa.int64()) for c in (
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(tokenizer_path)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 33)

        def out():
            rows = packer.flush()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for b in batches:
            docs = b.column(0).to_pylist()
            for k, n in _slices(b.column(1)):
                texts = texts_of(b.column(1).slice(k, n))
                for doc, ids in zip(docs[k:k + n], tokens.ids(texts), strict=True):
                    packer.add(doc, ids + end)
                if len(packer.wait) >= BUFFER:
                    packer.pack()
                    yield from out()
                elif packer.full >= HELD_TOKENS:
                    yield from out()
        packer.pack(last=True)
        yield from out()

    return body.mapInArrow(run, from_arrow_schema(schema))
