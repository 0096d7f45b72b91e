"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

The merge ranks come from a public sentencepiece BPE model (path is a parameter).
A text's symbols are its characters, blanks written as U+2581 and one put before a
non-empty text; a character outside the vocabulary counts its UTF-8 bytes (byte
fallback).  The lowest-rank adjacent pair (leftmost on ties) is popped from a heap
and merged in a doubly linked list until none is left: count = initial symbols -
merges.  A merge can only cross two neighbouring characters that stand side by side
in some vocabulary piece, so a text is cut, exactly, before every run of blanks and
wherever no piece has the two neighbours; counts of parts are kept in a bounded
table per worker.

Defined cases: null and empty texts have 0 tokens; texts of any length are counted
whole; repeated rows get equal counts; extra columns are kept, except that
``n_bytes``, ``n_tokens`` and ``over_limit`` replace columns of those names.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_text_columns

LIMIT = 4096
MEMO = 400_000          # chunks, and parts, kept per Python worker; a full table is emptied
_BLANK = "▁"


class Counter:
    """Counts tokens of texts by the ranks of one model file."""

    def __init__(self, model_path: str, memo: int = MEMO):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        self.rank = {p: -s for p, s in normal if len(p) > 1}
        self.single = {p for p, _ in normal if len(p) == 1}
        self.beside = {p[i:i + 2] for p, _ in normal for i in range(len(p) - 1)}
        self.memo: dict = {}
        self.most = memo
        self.parts: dict = {}

    def merge(self, part: str) -> int:
        """Tokens of one part: the heap and the linked list."""
        n = len(part)
        single = self.single
        count = sum(1 if c in single else len(c.encode()) for c in part)
        if n < 2:
            return count
        get = self.rank.get
        sym = list(part)
        heap = []
        for i in range(n - 1):
            r = get(part[i:i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, size = pop(heap)
            left = sym[i]
            if left is None:
                continue
            j = nxt[i]
            if j >= n or len(left) + len(sym[j]) != size:
                continue  # one side has been merged since
            both = left + sym[j]
            sym[i], sym[j] = both, None
            count -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                r = get(both + sym[k])
                if r is not None:
                    push(heap, (r, i, size + len(sym[k])))
            h = prv[i]
            if h >= 0:
                r = get(sym[h] + both)
                if r is not None:
                    push(heap, (r, h, size + len(sym[h])))
        return count

    def chunk(self, chunk: str) -> int:
        """Tokens of a run of blanks and what follows it, cut where no merge can cross."""
        beside, parts = self.beside, self.parts
        total = start = 0
        for i in range(1, len(chunk)):
            if chunk[i - 1:i + 1] not in beside:
                total += self._part(parts, chunk[start:i])
                start = i
        return total + self._part(parts, chunk[start:])

    def _part(self, parts: dict, part: str) -> int:
        if len(part) > 64:
            return self.merge(part)
        n = parts.get(part)
        if n is None:
            if len(parts) >= self.most:
                parts.clear()
            n = parts[part] = self.merge(part)
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _BLANK in text:
            text = text.replace(_BLANK, " ")  # both are written as the same symbol
        if "  " in text or text[0] == " " or text[-1] == " ":
            chunks = _RUN.findall(" " + text)
        else:
            chunks = text.split(" ")
            memo = self.memo
            total = 0
            for c in chunks:
                n = memo.get(c)
                if n is None:
                    n = self.chunk(_BLANK + c)
                    if len(c) <= 64:
                        if len(memo) >= self.most:
                            memo.clear()
                        memo[c] = n
                total += n
            return total
        return sum(self.chunk(c.replace(" ", _BLANK)) for c in chunks)


@lru_cache(maxsize=1)
def _worker_counter(model_path: str) -> Counter:
    """One table per Python worker, so that its later tasks find the parts of earlier ones."""
    return Counter(model_path)


_RUN = re.compile(" +[^ ]*")


def count_tokens(documents: DataFrame, model_path: str, text_col: str = "text",
                 keep: list | None = None, limit: int = LIMIT) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` to every document; no shuffle.

    ``model_path`` must be readable on every executor (it is part of its installation).
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("over_limit", T.BooleanType())]

    def make():
        counter = _worker_counter(model_path)

        def work(texts):
            n = [counter.count(t.decode("utf-8")) if t else 0 for t in texts]
            return [[len(t) if t else 0 for t in texts], n, [x > limit for x in n]]
        return work

    return with_text_columns(documents, text_col, fields, make, keep)
