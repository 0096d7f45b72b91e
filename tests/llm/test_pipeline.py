"""The pipeline against its stages applied by hand, and on the edge cases."""

import os
from collections import Counter

import corpus_pipeline
from vitalframe.llm import langid, minhash, mixing, packing, quality_gbt
from vitalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    import public_tokenizers
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    kept = ids(quality_gbt.score(docs, quality_gbt.fit(docs, labels)).where("predicted = 1"))
    one = docs.where(docs.doc_id.isin(list(kept))).cache()
    kept = ids(langid.identify(one, langid.fit(one)).where("not rejected"))
    two = one.where(one.doc_id.isin(list(kept))).cache()
    kept = ids(minhash.near_duplicates(two).where("kept"))
    three = two.where(two.doc_id.isin(list(kept))).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(three, public_tokenizers.path("word_bpe_49k.json")).collect()}

    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == {d: c * tokens[d] for d, c in copies.items() if c}

    # clean documents stay in the filters
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(clean & ids(two)) / len(clean) > 0.97


def test_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_edges(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    for name, df in (("odd", docs), ("none", no_docs)):
        folder = os.path.join(tmp_path, name)
        df.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "odd")


def test_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_dedup_keeps_one_row_of_a_repeated_id(spark):
    rows = [(1, "a b c d e f g", "en", "x", 1), (1, "a b c d e f", "en", "x", 1), (2, "q r s", "en", "y", 1),
            (None, "z", None, None, None), (None, "z", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 3):
        got = corpus_pipeline.near_dedup(spark, df.repartition(n), SF).collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "z"), (0, "z"), (1, "a b c d e f g"), (2, "q r s")]


def test_dedup_keeps_the_text_that_was_compared(spark):
    a, b = (" ".join(f"{k}{j}" for j in range(60)) for k in "ab")
    rows = [(1, a, "x"), (1, b, "a"), (1, b, "b"), (2, a + " more", "y"), (3, b + " more", "z"), (4, "", "e"), (4, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, df.repartition(3), SF).collect()
    judged = {r["doc_id"]: r for r in minhash.judged(df).collect()}
    kept = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(kept) and set(kept) == {i for i, r in judged.items() if r["kept"]}
    assert minhash.fingerprint(minhash.shingles(kept[1].encode())) == judged[1]["fingerprint"]
    # whichever text stands for id 1, its near copy goes and the other one's stays
    assert set(kept) == ({1, 3, 4} if kept[1] == a else {1, 2, 4})


def test_clashing_columns_stay_as_they_are(spark):
    from pyspark.sql import functions as F
    extra = ["score", "predicted", "rejected", "lang_pred", "_whole", "_below", "_s", "_vf_s", "_vf_copy", "_vf_text",
             "_vf_score", "_vf_rejected", "_vf_id", "kept", "fingerprint", "_t", "_id", "_n"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra}).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra)
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0
