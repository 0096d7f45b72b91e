"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics (``STATS``) are computed from whole texts inside the tasks.  The
trees are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, chosen by
a hash of the id) and flattened into three arrays, which every task uses to score
its documents: all rows and all trees step down one level at a time in numpy.

Defined cases: a null or empty text has all statistics 0 and gets the score of
that leaf; null labels, or labels other than 0 and 1, are ignored; a document
labelled more than once takes its smallest label; with no labels at all every
score is 0.5, with one class only it is that class's smoothed share; repeated
rows are scored alike; extra columns are kept, except that ``score`` and
``predicted`` replace columns of those names.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_fraction, held_out, with_text_columns

TRAIN_ROWS = 20_000      # expected size of the labelled sample that trees are fitted on
SEED = 71
BINS, TREES, DEPTH, RATE, L2, MIN_HESSIAN = 64, 60, 4, 0.15, 1.0, 4.0
CUT = 0.3                # predicted = 1 from this score

# Byte classes whose shares are statistics.
_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
    "space": b" \t", "newline": b"\n\r", "stop": b".,;:", "mark": b"!?", "symbol": b"#*$%&|<>=+~^_\\",
    "bracket": b"()[]{}\"'`", "high": bytes(range(128, 256)),
}
STATS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word",
    "repeat_next", "upper_words", "title_words", "compressed", "log_lines", "distinct_lines",
    "words_per_line", "longest_line", *_CLASSES,
)
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v), _k] = 1.0


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one whole text, in the order of ``STATS``."""
    out = np.zeros(len(STATS))
    if not text:
        return out
    size = len(text)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x]
    out[0], out[1] = np.log1p(size), np.log1p(n)
    if n:
        seen = Counter(words)
        out[2] = sum(map(len, words)) / n
        out[3] = np.log1p(max(map(len, words)))
        out[4] = len(seen) / n
        out[5] = max(seen.values()) / n
        out[6] = sum(map(operator.eq, words, words[1:])) / n
        out[7] = sum(map(bytes.isupper, words)) / n
        out[8] = sum(map(bytes.istitle, words)) / n
    out[9] = len(zlib.compress(text, 1)) / size
    out[10] = np.log1p(len(lines))
    if lines:
        out[11] = len(set(lines)) / len(lines)
        out[12] = n / len(lines)
        out[13] = np.log1p(max(map(len, lines)))
    out[14:] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / size
    return out


def statistics_matrix(texts: list) -> np.ndarray:
    if not texts:
        return np.zeros((0, len(STATS)), np.float32)
    return np.stack([statistics(t) for t in texts]).astype(np.float32)


class Trees:
    """Flattened complete trees: ``feature`` and ``cut`` [tree, inner node], ``leaf`` [tree, leaf]."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of ``x``."""
        z = np.full(len(x), self.base)
        if len(x) and len(self.feature):
            trees = np.arange(len(self.feature))
            rows = np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(trees)), np.int64)  # node of each row in each tree
            depth = int(np.log2(self.leaf.shape[1]))
            for level in range(depth):
                node = at + (2**level - 1)
                at = 2 * at + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            z += self.leaf[trees, at].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH,
              rate: float = RATE) -> Trees:
    """Fit logistic boosted trees by second-order gain on quantile histograms."""
    empty = Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    if len(y) == 0:
        return empty
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        empty.base = base
        return empty
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    z = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            best = np.full(width, 1e-6)
            pick = np.full((width, 2), -1)
            for j in range(k):
                key = at * BINS + binned[:, j]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(hs < MIN_HESSIAN) | (ht - hs < MIN_HESSIAN)] = -1
                gain[:, len(edges[j]):] = -1
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                won = top > best
                best[won], pick[won, 0], pick[won, 1] = top[won], j, b[won]
            goes = np.zeros(n, np.int64)
            for node in np.flatnonzero(pick[:, 0] >= 0):
                j, b = pick[node]
                feature[t, width - 1 + node], cut[t, width - 1 + node] = j, edges[j][b]
                mine = at == node
                goes[mine] = binned[mine, j] > b
            at = 2 * at + goes
        gl, hl = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf[t] = -rate * gl / (hl + L2)
        z += leaf[t][at]
    return Trees(base, feature, cut.astype(np.float32), leaf)


_X = T.StructField("_vf_x", T.ArrayType(T.FloatType()))


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on labelled rows that aren't held out; ``train_rows`` bounds the expected sample.

    The sampled ids are bounded by that parameter, so they are broadcast; the texts
    of the sample are read where they lie, and only their statistics reach the driver.
    """
    marked = (labels.select(F.col(id_col).alias("_vf_id"), F.col(label_col).cast("int").alias("_vf_y"))
              .where(F.col("_vf_y").isin(0, 1) & ~held_out(F.col("_vf_id"))))
    total = marked.count()
    picked = (marked.where(hash_fraction(train_rows / max(total, 1), SEED, F.col("_vf_id")))
              .groupBy("_vf_id").agg(F.min("_vf_y").alias("_vf_y")))
    rows = (documents.select(F.col(id_col).alias("_vf_id"), F.col(text_col).alias("_vf_t"))
            .join(F.broadcast(picked), "_vf_id"))
    got = with_text_columns(rows, "_vf_t", [_X], lambda: lambda ts: [list(statistics_matrix(ts))],
                            keep=["_vf_id", "_vf_y"])
    got = got.distinct().collect()  # rows that repeat an id and its text teach once: a hot id can't fill the sample
    got.sort(key=lambda r: (r["_vf_id"], r["_vf_x"]))  # the same trees however rows arrive
    x = np.array([r["_vf_x"] for r in got], np.float32).reshape(-1, len(STATS))
    return fit_trees(x, np.array([r["_vf_y"] for r in got], np.float64))


def score(documents: DataFrame, model: Trees, text_col: str = "text", keep: list | None = None,
          cut: float = CUT, names: tuple = ("score", "predicted")) -> DataFrame:
    """Append score and predicted, under ``names``, to every document; no shuffle."""
    fields = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]

    def make():
        def work(texts):
            s = model.score(statistics_matrix(texts))
            return [s, (s >= cut).astype(np.int32)]
        return work

    return with_text_columns(documents, text_col, fields, make, keep)
