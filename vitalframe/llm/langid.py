"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its byte n-grams (``ORDERS``) after ASCII lower-casing, with
every other ASCII byte than a letter turned into a space; each is hashed into
``BUCKETS`` rows of an embedding.  The text's vector is their average, a linear
softmax turns it into language probabilities.  Embedding and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample of documents
(``TRAIN_ROWS``, chosen by a hash of the id; whole texts).  As average and softmax
input are both linear, scoring uses the product of the two matrices, one row per
subword.  A second, disjoint sample (``CALIBRATION_ROWS``, only its language scores
leave the tasks) calibrates the probabilities (temperature) and the confidence below
which a text is rejected: of all cuts, the one that rejects the most wrong answers
beyond the right ones it costs, at most ``REJECT_SHARE`` of which may go.  Both
samples are shares of all rows that may be learned from, at any size of the table.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; rows with a null language teach nothing; rows that repeat an id and a text
teach once; without any training row all texts are ``und``; repeated rows get the same
answer; very long texts are read whole, in slices of ``SLICE`` bytes; an empty table
gives an empty result; extra columns are kept, except that the new ones replace
columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_fraction, held_out, with_text_columns

TRAIN_ROWS = 2_500       # expected size of the training sample (about 7 kB a row on the driver)
CALIBRATION_ROWS = 20_000  # expected size of the calibration sample (a number per language and row)
TRAIN_SHARE = 0.8        # of a table that both samples take whole
SEED = 92
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
WIDTH, EPOCHS, RATE = 16, 6, 0.5
REJECT_SHARE = 0.002     # of the right calibration answers, that may be rejected at most
SLICE = 1 << 16          # bytes of a text whose subwords are held at once

_SPACED = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
                for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if _ASCII_LETTER.search(text):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the whole text, a slice at a time."""
    body = b" " + text.translate(_SPACED) + b" "
    for at in range(0, len(body), SLICE):
        a = np.frombuffer(body[at:at + SLICE + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        out = []
        for n in ORDERS:
            m = min(SLICE, len(a) - n + 1)  # the grams that start in this slice
            if m <= 0:
                continue
            h = np.full(m, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h += a[j:j + m] * _MULT[j]
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append(h >> np.uint32(17))  # the top 15 bits: BUCKETS rows
        if out:
            yield np.concatenate(out)


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and each one's share of its subwords."""
    n = np.zeros(BUCKETS, np.int64)
    for part in subwords(text):
        n += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at] / n.sum()


class Model:
    """``table`` [bucket, language] is embedding x softmax; ``reject`` the calibrated cut."""

    def __init__(self, langs: list, table: np.ndarray, bias: np.ndarray, temperature: float, reject: float):
        self.langs, self.table, self.bias = langs, table, bias
        self.temperature, self.reject = temperature, reject

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for part in subwords(text):
            total += self.table[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return total / n + self.bias

    def predict(self, text: bytes | None) -> tuple:
        """(language, calibrated probability, rejected) of one whole text."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.reject)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_rows(rows: list) -> Model:
    """``rows``: (language, buckets, shares) of each text, in a fixed order; not calibrated yet."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    code = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out = np.zeros((WIDTH, len(langs)))
    bias = np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            lang, idx, w = rows[i]
            e = emb[idx]
            hidden = w @ e
            g = _softmax(hidden @ out + bias)
            g[code[lang]] -= 1.0
            back = out @ g
            out -= rate * np.outer(hidden, g)
            bias -= 0.1 * rate * g
            emb[idx] = e - (rate * 50.0) * w[:, None] * back  # shares are small: a larger step
    return Model(langs, (emb @ out).astype(np.float32), bias, 1.0, 0.0)


def calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> Model:
    """The model with temperature and cut from logits ``z`` and right answers ``y`` (numbers of languages)."""
    if not len(y):
        return model
    grid = np.geomspace(0.25, 8.0, 41)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    return Model(model.langs, model.table, model.bias, temperature, best_cut(p.max(axis=1), p.argmax(axis=1) == y))


def best_cut(p: np.ndarray, right: np.ndarray, share: float = REJECT_SHARE) -> float:
    """The confidence below which to reject: most wrong answers beyond the right ones lost, of which at most
    ``share``; the lowest of equal cuts, 0 if no cut gains."""
    order = np.argsort(p, kind="stable")
    wrong, lost = np.cumsum(~right[order]), np.cumsum(right[order])
    gain = np.where(lost <= share * right.sum(), wrong - lost, -1)
    # a cut lies between two different confidences
    gain[:-1][p[order][1:] == p[order][:-1]] = -1
    at = int(np.argmax(gain))
    if gain[at] <= 0:
        return 0.0
    above = p[order][at + 1:at + 2]
    return float((p[order][at] + above[0]) / 2) if len(above) else float(np.nextafter(p[order][at], 2))


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Train on documents that aren't held out; the two parameters bound the expected samples.

    Only bucket shares of the training texts and language scores of the others reach the driver.
    """
    known = documents.select(F.col(id_col).alias("_vf_id"), F.col(text_col).alias("_vf_t"),
                             F.col(lang_col).alias("_vf_l")).where(
        F.col("_vf_l").isNotNull() & F.col("_vf_t").isNotNull() & ~held_out(F.col("_vf_id")))
    total = max(known.count(), 1)
    train = min(TRAIN_SHARE, train_rows / total)
    # the text's hash as well, so that a much repeated id isn't taken or left with all its rows; equal rows once
    key = [F.col("_vf_id"), F.xxhash64("_vf_t")]
    first = hash_fraction(train, SEED, *key)
    some = known.where(first)
    rest = known.where(~first & hash_fraction(min(1.0, train + calibration_rows / total), SEED, *key))
    fields = [T.StructField("_vf_b", T.BinaryType()), T.StructField("_vf_w", T.BinaryType())]

    def make():
        def work(texts):
            b, w = [], []
            for t in texts:
                idx, share = shares(t) if has_letter(t) else (np.zeros(0), np.zeros(0))
                b.append(idx.astype(np.uint16).tobytes())
                w.append(share.astype(np.float32).tobytes())
            return [b, w]
        return work

    got = with_text_columns(some, "_vf_t", fields, make, keep=["_vf_id", "_vf_l"]).distinct().collect()
    got = sorted((r for r in got if r["_vf_b"]), key=lambda r: (r["_vf_id"], r["_vf_l"], bytes(r["_vf_b"])))
    model = fit_rows([(r["_vf_l"], np.frombuffer(r["_vf_b"], np.uint16), np.frombuffer(r["_vf_w"], np.float32))
                      for r in got])
    if not model.langs:
        return model
    told = with_text_columns(
        rest.where(F.col("_vf_l").isin(model.langs)), "_vf_t", [T.StructField("_vf_z", T.BinaryType())],
        lambda: lambda ts: [[model.logits(t).tobytes() if has_letter(t) else None for t in ts]], keep=["_vf_l"])
    # equal scores once: copies say no more than one of them, and a hot one reaches the driver as one row
    told = sorted((bytes(r["_vf_z"]), r["_vf_l"]) for r in told.where("_vf_z is not null").distinct().collect())
    z = np.array([np.frombuffer(v, np.float64) for v, _ in told]).reshape(-1, len(model.langs))
    return calibrate(model, z, np.array([model.langs.index(v) for _, v in told], np.int64))


def identify(documents: DataFrame, model: Model, text_col: str = "text",
             keep: list | None = None, names: tuple = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Append language, score and rejection, under ``names``, to every document; no shuffle."""
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()),
              T.StructField(names[2], T.BooleanType())]
    return with_text_columns(documents, text_col, fields,
                             lambda: lambda texts: list(zip(*map(model.predict, texts), strict=True)), keep)
