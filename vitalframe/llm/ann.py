"""Nearest neighbours by a block matrix join with int8 tiles and exact verification.

Vectors are packed into blocks of ``BLOCK_ROWS``: int8 values with one scale per
vector, and the originals.  A stated query set, packed alike, meets every block
of data in one tile.  A tile's int8 products, times the scales, differ from the
true inner products by at most a bound that follows from each vector's rounding
error and norm; only pairs whose upper bound reaches the query's current k-th
best lower bound are recomputed from the originals in double precision.

The tiles are a grid of cells: bands of ``BAND`` query blocks by strips of data blocks.
Blocks cross the shuffle singly, a query block once per strip and a data block once
per band; a cell's task keeps its band's blocks and streams the data blocks past
them, with one running heap per query.  The strips' heaps are merged.  So what is
shuffled grows with the data times the number of bands, not of query blocks.
Rows are dealt to blocks by their place in the stored table, so an id that is
repeated often is spread like any other rows.

Nearness is the largest inner product; ties go to the smaller id.  Defined cases:
vectors that are null, empty, zero or hold null or non-finite components, and null
ids, take no part; only vectors of one length are compared; a query's candidates
are all rows with another id; repeated rows are candidates each; a query with no
candidate has no row; columns beside id and vector are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
BAND = 32            # query blocks that a task holds, with their heaps
STRIPS = 16          # at most; each carries its own heaps, so a merge sees at most STRIPS x k rows a query
K = 20
BLOCK_BATCH = 8      # blocks per Arrow batch


def _kind(embeddings: DataFrame, vector_col: str) -> str:
    return "array<float>" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "array<double>"


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, _v, _dim) of the vectors that take part."""
    v = F.col("_v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (embeddings.select(F.col(id_col).cast("long").alias("vec_id"),
                              F.col(vector_col).cast(_kind(embeddings, vector_col)).alias("_v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
            .withColumn("_dim", F.size(v)))


def quantise(v: np.ndarray) -> tuple:
    """int8 rows, scale per row, norm of the quantised row, norm of the rounding error."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(v / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    err = np.linalg.norm(v - back, axis=1) * (1 + 1e-9) + 1e-300
    return q, scale, np.linalg.norm(back, axis=1), err


_BLOCK = ("_dim int, _block long, ids binary, original binary, q binary, scale binary, norm binary, err binary")


def blocks(vectors: DataFrame, rows: int, total: int) -> DataFrame:
    """Packed blocks of about ``rows`` of the ``total`` vectors, all of one length, by a hash of their ``_row``."""
    placed = vectors.withColumn(
        "_block", F.pmod(F.xxhash64("_row"), F.lit(max(1, -(-total // rows)))).cast("long"))
    kind = np.float32 if dict(vectors.dtypes)["_v"] == "array<float>" else np.float64

    def pack(key, pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        v = np.stack([np.asarray(x, kind) for x in pdf["_v"]])
        q, scale, norm, err = quantise(v.astype(np.float64))
        import pandas as pd
        return pd.DataFrame({"_dim": [key[0]], "_block": [key[1]],
                             "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "original": [v.tobytes()],
                             "q": [q.tobytes()], "scale": [scale.tobytes()], "norm": [norm.tobytes()],
                             "err": [err.tobytes()]})

    return placed.select("_dim", "_block", "vec_id", "_v").groupBy("_dim", "_block").applyInPandas(pack, _BLOCK)


class _Block:
    def __init__(self, dim: int, ids, original, q, scale, norm, err):
        self.ids = np.frombuffer(ids, np.int64)
        shape = (len(self.ids), dim)
        kind = np.float64 if len(original) == 8 * len(self.ids) * dim else np.float32
        self.original = np.frombuffer(original, kind).reshape(shape).astype(np.float64)
        # int8 values held as float32: products and sums stay below 2^24, so BLAS gives them exactly
        self.q = np.frombuffer(q, np.int8).reshape(shape).astype(np.float32)
        self.scale, self.norm, self.err = (np.frombuffer(x, np.float64) for x in (scale, norm, err))


class _Heaps:
    """The k nearest so far of each query of one block: heap entries (score, -id)."""

    def __init__(self, query: _Block, k: int):
        self.query, self.k = query, k
        self.heaps: list = [[] for _ in query.ids]
        self.floor = np.full(len(query.ids), -np.inf)  # k-th best score so far

    def tile(self, data: _Block) -> None:
        dim = self.query.q.shape[1]
        step = max(1, min(dim, (1 << 24) // (128 * 128) - 1))
        for at in range(0, len(self.query.ids), 128):
            rows = slice(at, at + 128)
            approx = np.zeros((len(self.query.ids[rows]), len(data.ids)))
            for d in range(0, dim, step):
                approx += self.query.q[rows, d:d + step] @ data.q[:, d:d + step].T
            approx *= self.query.scale[rows, None]
            approx *= data.scale
            # |x.y - x'.y'| <= |x'| |e_y| + |e_x| |y'| + |e_x| |e_y|, and a little for rounding
            bound = (np.outer(self.query.norm[rows] + self.query.err[rows], data.err)
                     + np.outer(self.query.err[rows], data.norm))
            bound += 1e-12 * np.outer(self.query.norm[rows] + self.query.err[rows], data.norm + data.err)
            lower, upper = approx - bound, approx + bound
            # rows with the query's own id, however many, are no candidates
            own = self.query.ids[rows, None] == data.ids
            lower[own] = upper[own] = -np.inf
            if lower.shape[1] > self.k:
                cut = np.partition(lower, lower.shape[1] - self.k, axis=1)[:, lower.shape[1] - self.k]
            else:
                cut = np.full(lower.shape[0], -np.inf)
            keep = upper >= np.maximum(cut, self.floor[rows])[:, None]
            for j in range(keep.shape[0]):
                self._merge(at + j, data, np.flatnonzero(keep[j]))

    def _merge(self, j: int, data: _Block, near: np.ndarray) -> None:
        near = near[data.ids[near] != self.query.ids[j]]
        if not len(near):
            return
        scores = (data.original[near] * self.query.original[j]).sum(axis=1)
        if len(near) > self.k:  # best score first, ties to the smaller id
            best = np.lexsort((data.ids[near], -scores))[:self.k]
            near, scores = near[best], scores[best]
        heap = self.heaps[j]
        for s, i in zip(scores.tolist(), data.ids[near].tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
        if len(heap) == self.k:
            self.floor[j] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        q, i, s = [], [], []
        for query, heap in zip(self.query.ids.tolist(), self.heaps, strict=True):
            for score, neg in heap:
                q.append(query)
                i.append(-neg)
                s.append(score)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()),
                                           pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def search(embeddings: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of every query: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the id column (named ``vec_id``).  A query id
    that occurs more than once is one query for its first vector.
    """
    vectors = cut_lineage(usable(embeddings, id_col, vector_col).withColumn("_row", F.monotonically_increasing_id()),
                          "ann-vectors")
    first = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("_dim", "_v")).alias("x"))
    queries = first.select("vec_id", "x._v", "x._dim", F.col("vec_id").alias("_row"))
    n_rows, n_queries = vectors.count(), queries.count()
    data = cut_lineage(blocks(vectors, block_rows, n_rows), "ann-blocks")
    asked = cut_lineage(blocks(queries, query_rows, n_queries), "ann-queries")
    strips = max(1, min(STRIPS, -(-n_rows // block_rows)))
    bands = max(1, -(-n_queries // (query_rows * BAND)))
    names = ["ids", "original", "q", "scale", "norm", "err"]

    def dealt(side: DataFrame, number: int, band, strip) -> DataFrame:
        return side.select("_dim", band.alias("_band"), strip.alias("_strip"),
                           F.lit(number).alias("_side"), "_block", *names)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cell = ["_dim", "_band", "_strip"]
    cells = dealt(asked, 0, F.pmod("_block", F.lit(bands)).cast("int"), every(strips)).unionByName(
        dealt(data, 1, every(bands), F.pmod("_block", F.lit(strips)).cast("int")))
    cells = cells.repartition(*cell).sortWithinPartitions(*cell, "_side", "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in range(b.num_rows):
                row = [c[r].as_py() for c in b.columns]
                if now != row[:3]:
                    for h in held:
                        yield h.rows()
                    now, held = row[:3], []
                block = _Block(row[0], *row[5:])
                if row[3] == 0:  # a cell's queries come first
                    held.append(_Heaps(block, k))
                else:
                    for h in held:
                        h.tile(block)
        for h in held:
            yield h.rows()

    # A row is a block of some MB, so few go in a batch; the result is k rows a query and strip.
    spark, key = embeddings.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(BLOCK_BATCH))
    try:
        near = cut_lineage(cells.mapInArrow(run, "query_id long, vec_id long, score double"), "ann-near")
    finally:
        spark.conf.set(key, usual)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return (near.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
