import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("_n", T.StringType()),
])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def rows(n=60):
    """Documents with nulls, empty and very long texts, copies, near copies and repeated rows."""
    import random
    rng = random.Random(11)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "", ".", "s"]) for _ in range(rng.choice([3, 30, 80, 200]))]
        out.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])))
    long = " ".join(rng.choice(WORDS) for _ in range(40_000))
    base = out[1][1].split() + [f"w{j}" for j in range(60)]
    extra = [
        (1000, None, "en", "a"), (1001, "", "en", "b"), (1002, " \t\n ", None, None), (1003, long, "de", "a"),
        (1004, " ".join(base), "en", "b"), (1005, " ".join(base[:-2] + ["q", "r"]), "en", "b"),
        (1006, " ".join(base), "en", None), (1007, "12 34 !!", "en", "a"), (1008, "Ünïcode ßtraße 日本語 🙂", "de", "c"),
        (None, "text without an id " * 6, "en", "a"), (5, out[5][1], out[5][2], out[5][3]),
        (1009, "one two", "en", "a"), (1010, "One  TWO", "en", "a"),
    ]
    return [(*r, len(r[1] or ""), "x", "y", "z", "u") for r in out + extra]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
