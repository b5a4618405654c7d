"""Retrieval of functions for requirement chunks, and their aggregation to candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scoring

HITS, CANDIDATES = 5, 5
BLOCK = 4096  # query vectors held at once
PRODUCTS = 2_000_000  # products of a query and a function that a task holds at once


def top_products(queries: DataFrame, functions: DataFrame, k: int = HITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, chunk_index, fn, product, vector_similarity): the k functions with the greatest inner product of each query.

    queries: (doc_id, chunk_index, vector), functions: (clean, vector). The table of functions is read once per block of
    queries and multiplied with it batch by batch, k rows a query leave each partition. Equal products are ordered by id;
    functions without vector take no part.
    """
    spark = functions.sparkSession
    rows = functions.where("vector is not null").select("clean", "vector")
    asked = queries.where("vector is not null").orderBy("doc_id", "chunk_index")
    parts, last = None, None
    while True:
        rest = asked if last is None else asked.where((F.col("doc_id") > last[0]) | ((F.col("doc_id") == last[0]) & (F.col("chunk_index") > last[1])))
        got = rest.limit(block).collect()
        if got:
            last = (got[-1]["doc_id"], got[-1]["chunk_index"])
            points = spark.sparkContext.broadcast(np.array([r["vector"] for r in got], dtype=np.float64))

            def run(batches: Iterator[pa.RecordBatch], points=points) -> Iterator[pa.RecordBatch]:
                q = points.value
                step, top = max(k, PRODUCTS // len(q)), np.full((len(q), k), -np.inf)
                for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
                    x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                    ids = batch.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(ids.astype(str), kind="stable")
                    product = q @ x[order].T
                    best = np.argsort(-product, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(product, best, 1)
                    who, place = np.nonzero(value >= top[:, :1])  # what is below the k greatest so far can't be among them
                    top = np.sort(np.concatenate([top, value], axis=1), axis=1)[:, -k:]
                    at, value = best[who, place], value[who, place]
                    norm = np.linalg.norm(q, axis=1)[who] * np.linalg.norm(x, axis=1)[order][at]
                    cosine = np.divide(value, norm, out=np.zeros_like(value), where=norm > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int64)), pa.array(ids[order][at].tolist(), pa.string()), pa.array(value), pa.array(cosine)], names=["q", "fn", "product", "vector_similarity"])

            found = rows.mapInArrow(run, "q long, fn string, product double, vector_similarity double")
            names = spark.createDataFrame([(i, r["doc_id"], r["chunk_index"]) for i, r in enumerate(got)], "q long, doc_id string, chunk_index int")
            found = found.join(names, "q").drop("q")
            parts = found if parts is None else parts.unionByName(found)
        if len(got) < block:
            break
    if parts is None:
        return spark.createDataFrame([], "fn string, product double, vector_similarity double, doc_id string, chunk_index int, place int")
    order = W.partitionBy("doc_id", "chunk_index").orderBy(F.desc("product"), "fn")
    return parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def gated(hits: DataFrame, gate: float = scoring.GATE) -> DataFrame:
    """Hits whose similarity, of vector and summary, exceeds the gate; a missing summary similarity counts as 0."""
    s = F.coalesce(F.col("summary_similarity"), F.lit(0.0))
    return hits.withColumn("similarity", scoring.blend(F.col("vector_similarity"), s)).withColumn("detail", scoring.blend_detail(F.col("vector_similarity"), s)).where(F.col("similarity") > gate)


def candidates(hits: DataFrame) -> DataFrame:
    """(doc_id, fn, total_score, chunk_count, best_similarity, best_chunk_index, best_detail, first_seen) of each function."""
    first = F.struct(-F.col("similarity"), F.col("chunk_index"), F.col("place"))
    return hits.groupBy("doc_id", "fn").agg(
        F.sum("similarity").alias("total_score"), F.count(F.lit(1)).alias("chunk_count"), F.max("similarity").alias("best_similarity"),
        F.min_by("chunk_index", first).alias("best_chunk_index"), F.min_by("detail", first).alias("best_detail"), F.min(F.struct("chunk_index", "place")).alias("first_seen"),
    )


def leading(found: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k candidates with the greatest total score of each document, with rank and analysis mode."""
    order = W.partitionBy("doc_id").orderBy(F.desc(F.round("total_score", 9)), "first_seen")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    highest = F.max("best_similarity").over(W.partitionBy("doc_id"))
    return top.withColumn("mode", scoring.analysis_mode(F.col("best_similarity"), highest, F.col("rank")))
