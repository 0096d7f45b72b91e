"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Counts per whole text come from one pass (``measure``).  Each rate's distribution
per language and source is a sketch of counts in buckets of relative width
``GAMMA``: buckets of equal index add up, so partial sketches merge in any order
and grouping, and a language's or the corpus's sketch is the sum of its sources'.
A rate's fence is its upper quartile plus ``SPREAD`` times the interquartile range
(at least the rate's ``least`` spread), read from a sketch.  The fence of a language
and source is blended with its language's, and that with the corpus's: n rows weigh
n / (n + ``PRIOR``), so a group's own fence gains weight with every row and no number
of rows is a switch.  Fences are joined back to the documents as a small table.

Defined cases: null or empty texts have all counts 0 and fail the base rule; null
languages and sources are groups of their own; repeated rows get the same verdict;
very long texts are counted whole; an empty table gives an empty result; columns
beside the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import with_text_columns

GAMMA = 1.02
SPREAD = 3.0
PRIOR = 200.0   # rows at which a group's own fence weighs as much as the one above it
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Rate -> (expression over the counts, least spread).
RATES = {
    "symbol_rate": ("n_symbols / greatest(word_chars, 1)", 0.02),
    "dup_line_rate": ("n_dup_lines / greatest(n_lines, 1)", 0.15),
    "repeat_rate": ("n_repeat_words / greatest(n_words, 1)", 0.10),
    "word_length": ("word_chars / greatest(n_words, 1)", 1.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACE = b" \t\n\x0b\x0c\r"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur at least twice in the text."""
    m = len(words) - window + 1
    if m < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(m, np.uint64)
    for j in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + m]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(m, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    edge[at + window] -= 1
    return int((edge.cumsum() > 0).sum())


def counts(text: bytes | None) -> tuple:
    """``COUNTS`` of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    points = int((np.frombuffer(text, np.uint8) & 0xC0 != 0x80).sum())
    seen, n_lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            n_lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), points - (len(text) - len(text.translate(None, _SPACE))),
            len(text) - len(text.translate(None, SYMBOLS)), dup, repeated_words(words), n_lines)


def measure(documents: DataFrame, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """Append the counts of every whole text; no shuffle."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    return with_text_columns(documents, text_col, fields,
                             lambda: lambda ts: list(zip(*map(counts, ts), strict=True)),
                             None if keep is None else list(keep))


def _bucket(x):
    """Index of the bucket of relative width GAMMA that holds x; 0 has one of its own."""
    return F.when(x <= 0, F.lit(-1_000_000)).otherwise(
        F.ceil(F.log(x) / F.lit(math.log(GAMMA)))).cast("int")


def _quantile(q: float):
    """Mid value of the first bucket whose cumulative count reaches the share q."""
    b = F.min(F.when(F.col("_run") >= F.lit(q) * F.col("_all"), F.col("_b")))
    return F.when(b == -1_000_000, F.lit(0.0)).otherwise(
        F.pow(F.lit(GAMMA), b.cast("double")) * F.lit(2.0 / (1.0 + GAMMA)))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language, source, rate and bucket, with its count: the mergeable sketch."""
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), _bucket(F.expr(e)).alias("_b"))
                      for k, (e, _) in RATES.items()])
    return (measured.select(F.col(lang).alias("_l"), F.col(source).alias("_s"), F.explode(rates).alias("r"))
            .groupBy("_l", "_s", F.col("r.rate").alias("rate"), F.col("r._b").alias("_b"))
            .agg(F.count("*").alias("_n")))


def fences(sketch: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """(_l, _s, one upper fence per rate) from the sketches, each blended with those of the levels above."""
    least = F.create_map(*[F.lit(x) for k, (_, s) in RATES.items() for x in (k, s)])

    def level(keys: list, name: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "rate", "_b").agg(F.sum("_n").alias("_n"))
        part = Window.partitionBy(*keys, "rate")
        run = merged.withColumns({"_run": F.sum("_n").over(part.orderBy("_b")), "_all": F.sum("_n").over(part)})
        q = run.groupBy(*keys, "rate").agg(_quantile(0.25).alias("_lo"), _quantile(0.75).alias("_hi"),
                                           F.max("_all").alias(f"_rows_{name}"))
        top = F.col("_hi") + F.lit(spread) * F.greatest(F.col("_hi") - F.col("_lo"), least[F.col("rate")])
        return q.select(*keys, "rate", f"_rows_{name}", top.alias(f"_top_{name}"))

    fine, lang, all_ = level(["_l", "_s"], "s"), level(["_l"], "l"), level([], "a")
    lang = lang.withColumnsRenamed({"_l": "_l2", "rate": "_rate2"})
    both = (fine.join(lang, F.col("_l").eqNullSafe(F.col("_l2")) & (F.col("rate") == F.col("_rate2")))
            .drop("_l2", "_rate2").join(all_, "rate"))
    def blended(rows, own, above):
        return (F.col(rows) * F.col(own) + F.lit(prior) * above) / (F.col(rows) + F.lit(prior))

    top = blended("_rows_s", "_top_s", blended("_rows_l", "_top_l", F.col("_top_a")))
    return both.groupBy("_l", "_s").agg(
        *[F.max(F.when(F.col("rate") == k, top)).alias(f"_max_{k}") for k in RATES])


def apply_rules(documents: DataFrame, spread: float = SPREAD, prior: float = PRIOR,
                id_col: str = "doc_id", text_col: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """Per document: id, counts, ``base_failed``, ``failed`` (names of rates over their fence), ``kept``."""
    plain = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"),
                             F.col(lang).alias("_l"), F.col(source).alias("_s"))
    # The texts are read once; what follows works on a few numbers per document.
    measured = cut_lineage(measure(plain, "_t", ["doc_id", "_l", "_s"]), "rule-counts")
    limit = fences(sketches(measured, "_l", "_s"), spread, prior).withColumnsRenamed({"_l": "_l3", "_s": "_s3"})
    held = measured.join(limit, F.col("_l").eqNullSafe(F.col("_l3")) & F.col("_s").eqNullSafe(F.col("_s3")), "left")
    over = F.array_compact(F.array(*[F.when(F.expr(e) > F.col(f"_max_{k}"), F.lit(k)) for k, (e, _) in RATES.items()]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return held.select("doc_id", *COUNTS, base.alias("base_failed"), over.alias("failed"),
                       (~base & (F.size(over) == 0)).alias("kept"))
