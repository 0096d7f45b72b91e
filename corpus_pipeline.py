"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs; all but the last return the
columns of documents.  Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalframe.llm import langid, minhash, mixing, packing, quality_gbt
from vitalframe.llm.common import fresh_name, table, with_text_columns
from vitalframe.operators import windows
from vitalframe.session import cut_lineage, ensure_checkpoint_dir, ship_package


def _free(docs: DataFrame, *names: str) -> tuple:
    """Names for a stage's own columns that no column of ``docs`` has."""
    return tuple(fresh_name(docs.columns, f"_vf_{n}") for n in names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; rows that repeat are scored alike; no labelled row: all are
    scored the same; long texts are scored whole; a null id is never learned from; other columns stay untouched.
    """
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    model = quality_gbt.fit(docs, table(spark, sf_dir, "labels"))
    names = _free(docs, "score", "predicted")
    return quality_gbt.score(docs, model, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a recognised language go.

    Null texts and those without a letter go; without any row to learn from all go; rows that repeat meet the
    same fate; long texts are read whole, in slices; other columns stay untouched.
    """
    ship_package(spark)
    names = _free(docs, "lang_pred", "lang_score", "rejected")
    return langid.identify(docs, langid.fit(docs), names=names).where(~F.col(names[2])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates stays.

    Of rows that repeat a kept id the one stays whose text was compared (the largest set of shingles); if several
    rows hold that set, the first in order of their other columns.  Texts without a word are linked with nothing
    and stay; rows without an id all stay; other columns stay untouched.
    """
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    id_, print_, many, own = _free(docs, "id", "fingerprint", "repeated", "own")
    kept = minhash.judged(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias(id_), F.col("fingerprint").alias(print_), F.col("repeated").alias(many))
    named = docs.join(kept, F.col("doc_id") == F.col(id_))
    again = with_fingerprint(named.where(F.col(many)), own).where(F.col(own).eqNullSafe(F.col(print_)))
    other = [c for c in docs.columns if c != "doc_id"]
    again = windows.dedupe_first(again.select(*docs.columns), ["doc_id"], other)
    return (named.where(~F.col(many)).select(*docs.columns).unionByName(again.select(*docs.columns))
            .unionByName(docs.where(F.col("doc_id").isNull())))


def with_fingerprint(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the fingerprint of their text's shingles."""
    return with_text_columns(rows, "text", [T.StructField(name, T.BinaryType())],
                             lambda: lambda ts: [[minhash.fingerprint(minhash.shingles(t)) for t in ts]])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document stays as often as the mix takes it.

    Null and empty texts have no size and stay as often as their source is taken whole; a null source is one of
    its own; ties of a source's boundary go by the hash of the id; rows that repeat an id are taken alike; other
    columns stay untouched.
    """
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    source, whole, below, copy = _free(docs, "source", "whole", "below", "copy")
    sizes = cut_lineage(mixing.sized(docs), "mix-sizes")
    plan = mixing.thresholds(sizes, mixing.targets(sizes)).select(
        F.col("_s").alias(source), F.col("_whole").alias(whole), F.col("_below").alias(below))
    place = mixing.place(F.col("doc_id"))
    copies = F.col(whole) + F.when(place < F.col(below), 1).otherwise(0)
    return (docs.join(plan, F.col("source").eqNullSafe(F.col(source)))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
            .select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: what is left, packed into sequences.

    Null and empty texts are their end id alone; rows that repeat are packed each; a null id stays; long texts are
    cut across sequences; other columns are not handed on.
    """
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: SQL cannot express the classifiers and the tokeniser; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as a table in the shared folder, in place of the one
    before, and read again."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}", replaces=docs)
    return docs
