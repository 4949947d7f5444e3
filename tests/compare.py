"""Row-by-row comparison of a Spark result with the same query in DuckDB."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


_SPARK_KIND = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "double": "double", "float": "float", "string": "varchar", "boolean": "bool",
    "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "date": "date",
}
_DUCK_KIND = {
    "tinyint": "int8", "smallint": "int16", "integer": "int32", "bigint": "int64",
    "double": "double", "float": "float", "varchar": "varchar", "boolean": "bool",
    "timestamp": "timestamp", "timestamp with time zone": "timestamptz", "date": "date",
}


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(df, con, sql):
    """None if equal, else a short description of the difference."""
    names = sorted(df.columns)
    got_types = {f.name: f.dataType.simpleString() for f in df.schema}
    rel = con.execute(f"DESCRIBE {sql}").fetchall()
    want_types = {r[0]: r[1].lower() for r in rel}
    if names != sorted(want_types):
        return f"columns {names} != {sorted(want_types)}"
    for n in names:
        a = _SPARK_KIND.get(got_types[n], got_types[n])
        b = _DUCK_KIND.get(want_types[n], want_types[n])
        if a != b:
            return f"type of {n}: {a} != {b}"
    got = sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())
    cols = ", ".join(f'"{n}"' for n in names)
    want = sorted(
        tuple(_cell(v) for v in r)
        for r in con.execute(f"SELECT {cols} FROM ({sql})").fetchall()
    )
    if not want:
        return "the SQL returns no rows"
    if got == want:
        return None
    only_got = sorted(set(got) - set(want))[:2]
    only_want = sorted(set(want) - set(got))[:2]
    clip = lambda rows: [tuple(c[:60] for c in r) for r in rows]
    return f"{len(got)} vs {len(want)} rows {names}\n spark only {clip(only_got)}\n sql only   {clip(only_want)}"
