"""Sources S1-S7: CSV, JSON lines, JSON-in-text, keyed file sets, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables (vectorised reader, pushdown on)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, so null rules apply.

    pandas has only NaN and its comparisons with NaN are false; Spark orders
    NaN above every number, so a NaN left in place would pass ``x > c``.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")  # names may hold dots (R-style 'whole.2')
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             index_col: bool = False, sep: str = ",", **opts) -> DataFrame:
    """CSV with a header.

    With ``schema`` the types are fixed (no inference pass over the data,
    which at scale is a full extra read); without it they are inferred.
    ``index_col=True`` drops a leading row-index column (pandas ``index_col=0``).
    Text ``NaN`` becomes null through :func:`nan_to_null`.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    for k, v in opts.items():
        reader = reader.option(k, v)
    reader = reader.schema(schema) if schema is not None else reader.option(
        "inferSchema", True)
    df = reader.csv(path)
    if index_col:
        df = df.drop(df.columns[0])
    return nan_to_null(df)


def read_json_lines(spark: SparkSession, path: str,
                    schema: T.StructType | None = None) -> DataFrame:
    """S3: JSON lines with nested fields (select fields by name, not position:
    inferred struct fields come sorted by name)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def parse_json_column(df: DataFrame, column: str, schema,
                      prefix: str | None = None) -> DataFrame:
    """Text column of JSON documents -> typed fields (bad text -> null)."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    st = schema if isinstance(schema, T.StructType) else None
    if st is None:
        return df.withColumn(prefix or f"{column}_json", parsed)
    tmp = "__parsed"
    out = df.withColumn(tmp, parsed)
    for f in st.fields:
        out = out.withColumn(f"{prefix or ''}{f.name}", F.col(f"{tmp}.{f.name}"))
    return out.drop(tmp)


def read_text_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """A text file whose lines are JSON strings."""
    return parse_json_column(spark.read.text(path), "value", schema)


def read_keyed_files(spark: SparkSession, glob: str, name_pattern: str,
                     reader: str = "parquet", key_col: str = "file_key",
                     **opts) -> DataFrame:
    """Many files whose names carry a key.

    Keeps files whose path contains ``name_pattern`` and sets ``key_col`` to
    the digits that follow it (``_metadata.file_path`` is the file-source
    hidden column, so nothing is listed on the driver beyond the glob and
    the key is attached on the executors).
    """
    import re
    df = getattr(spark.read.options(**opts), reader)(glob)
    path = F.col("_metadata.file_path")
    df = df.select("*", path.alias("__path")).where(F.col("__path").contains(name_pattern))
    digits = F.regexp_extract(F.col("__path"), re.escape(name_pattern) + r"([0-9]+)", 1)
    return df.withColumn(key_col, digits.try_cast("long")).drop("__path")


def read_partitioned(spark: SparkSession, root: str, schema: T.StructType | None = None,
                     **equals) -> DataFrame:
    """One partitioned dataset (``root/version=.../acause=.../risk=...``);
    the equality filters prune directories; a missing item is absent rows.
    Give ``schema`` to keep partition values typed as written (otherwise a
    cause named '123' would be read back as a number)."""
    reader = spark.read.option("basePath", root)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(root)
    for k, v in equals.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def read_jdbc_query(spark: SparkSession, url: str, table: str, columns,
                    predicate: str | None = None, partition_column: str | None = None,
                    lower: int | None = None, upper: int | None = None,
                    num_partitions: int | None = None, **props) -> DataFrame:
    """Relational source with projection and predicate run by the
    database.

    The projection and predicate are sent as a subquery, so only the wanted
    rows and columns leave the database.  With ``partition_column`` (a
    numeric key) and its bounds, Spark opens ``num_partitions`` parallel
    connections, each reading one key range, instead of one connection for
    the whole table.  Not exercised in this repository: it needs a
    database, and an embedded one would be visible only to this process.
    """
    cols = ", ".join(columns)
    sub = f"(SELECT {cols} FROM {table}" + (f" WHERE {predicate}" if predicate else "") + ") t"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", sub)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                        .option("lowerBound", lower).option("upperBound", upper)
                        .option("numPartitions", num_partitions or 8))
    for k, v in props.items():
        reader = reader.option(k, v)
    return reader.load()
