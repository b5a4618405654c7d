"""Comparison of a Spark result with DuckDB's over the same Parquet files."""

import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f).split(".")[0]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def _value(x):
    if x is None or x != x:
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6)
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_value(v) for v in r) for r in frame.itertuples(index=False)), key=repr)
