"""Side-by-side compare of a Spark result with DuckDB SQL (used by the
local checker and the tests)."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, round(v, 5))
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    return (4, str(v))


def _rows(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
          "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "ShortType()": "SMALLINT",
          "FloatType()": "FLOAT"}


def compare(df, con, sql, check_types=True, exact=False):
    """Return None when equal, else a short description of the difference."""
    srows = [r.asDict() for r in df.collect()]
    scols = df.columns
    rel = con.sql(sql)
    dcols = list(rel.columns)
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    if sorted(scols) != sorted(dcols):
        return f"columns {sorted(scols)} vs {sorted(dcols)}"
    if check_types:
        for f in df.schema.fields:
            st = _TYPES.get(repr(f.dataType), repr(f.dataType))
            if st != dtypes[f.name]:
                return f"type of {f.name}: {st} vs {dtypes[f.name]}"
    cols = sorted(scols)
    if exact:  # values exactly as returned (no tolerance): count differing rows
        ka = sorted(repr(tuple(r[c] for c in cols)) for r in srows)
        kb = sorted(repr(tuple(r[c] for c in cols)) for r in drows)
        if len(ka) != len(kb):
            return f"rows {len(ka)} vs {len(kb)}"
        diff = len(set(ka) ^ set(kb))
        return f"{diff} rows differ exactly" if diff else None
    a, b = _rows(srows, cols), _rows(drows, cols)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if x[0] == 2 and y[0] == 2:
                if not math.isclose(x[1], y[1], rel_tol=1e-6, abs_tol=2e-5):
                    return f"value {ra} vs {rb}"
            elif x != y:
                return f"value {ra} vs {rb}"
    return None


def physical_plan(df) -> str:
    """The physical plan text from the public ``explain()`` output."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()
