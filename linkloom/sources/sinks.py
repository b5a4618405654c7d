"""Sinks: Parquet tables of a build, and documents of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_build(build: dict[str, DataFrame], out: str) -> None:
    """Nodes, edges, metadata, statistics and, where there are some, vectors as Parquet tables below ``out``."""
    for name in ("nodes", "edges", "metadata", "statistics", "vectors"):
        if name in build:
            build[name].write.mode("overwrite").parquet(f"{out}/{name}")


def write_json_array(df: DataFrame, path: str) -> None:
    """One local document with an array of objects. Rows are streamed partition by partition, never gathered."""
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(text.toLocalIterator()):
            out.write((",\n" if i else "\n") + row["j"])
        out.write("\n]\n")
