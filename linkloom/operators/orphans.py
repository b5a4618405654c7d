"""References to records that do not exist: composite keys with partial nulls, removals and late arrivals."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..runtime import clean_id, fresh

MATCHES = ("simple", "partial", "full")


def orphans(refs: DataFrame, parents: DataFrame, on: dict[str, str], match: str = "simple") -> DataFrame:
    """Rows of ``refs`` whose key has no row in ``parents``, with ``null_mask`` added; ``on`` maps reference to parent columns.

    References are grouped by null mask (one letter a column, ``N`` null or ``V`` value) and each mask is anti-joined on its
    non-null columns only, all masks in one join: both tables are read once. As in SQL's declared match semantics, *simple* lets any null satisfy the reference, *partial*
    asks for a parent that agrees on the non-null columns, *full* takes a mixture of null and value as an orphan; a key
    that is null throughout satisfies all three. Repeated rows stay; columns of equal names on both sides do not clash;
    empty parents make every non-null reference an orphan.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    keys = list(on)
    mask, word = F.concat(*[F.when(F.col(k).isNull(), "N").otherwise("V") for k in keys]), fresh([*refs.columns, *parents.columns], "null_mask__")
    marked = refs.withColumn("null_mask", mask)
    whole = "V" * len(keys)
    asked = [whole] if match != "partial" else ["".join(x) for x in product("NV", repeat=len(keys)) if "V" in x]
    # parents by mask: the columns that the mask leaves out are null, so that one equi-join serves every mask
    held = [fresh(marked.columns, f"__parent_{i}") for i in range(len(keys))]
    kept = lambda m: F.struct(F.lit(m).alias(word), *[(F.col(on[k]) if x == "V" else F.lit(None).cast(dict(parents.dtypes)[on[k]])).alias(h) for k, x, h in zip(keys, m, held)])
    full = lambda m: reduce(lambda a, b: a & b, [F.col(on[k]).isNotNull() for k, x in zip(keys, m) if x == "V"])
    rows = marked.where(F.col("null_mask").isin(asked))
    if len(asked) == 1:
        there = parents.select(*[F.col(on[k]).alias(h) for k, h in zip(keys, held)]).dropna().distinct()
        same = [rows[k] == there[h] for k, h in zip(keys, held)]
    else:
        there = parents.select(F.explode(F.array_compact(F.array(*[F.when(full(m), kept(m)) for m in asked]))).alias("__x")).select("__x.*").distinct()
        same = [rows["null_mask"] == there[word], *[rows[k].eqNullSafe(there[h]) for k, h in zip(keys, held)]]
    found = rows.join(there, reduce(lambda a, b: a & b, same), "left_anti")
    mixed = marked.where(F.contains("null_mask", F.lit("N")) & F.contains("null_mask", F.lit("V")))
    return found.unionByName(mixed) if match == "full" else found


def lifetimes(nodes: DataFrame) -> DataFrame:
    """(id, recorded_at, removed_at): distinct rows of usable ids. A null recorded_at counts as recorded from the start."""
    start = F.coalesce("recorded_at", F.lit("0001-01-01").cast(dict(nodes.dtypes)["recorded_at"]))
    return nodes.select(clean_id("id").alias("id"), start.alias("recorded_at"), "removed_at").where("id is not null").distinct()


def dangling(edges: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(edge_id, state, type, recorded_at) of edges whose target did not exist when they were recorded.

    ``missing``: no row has the id; ``late``: all rows were recorded after the edge; ``deleted``: some row was recorded at or
    before the edge and each such row was removed at or before it. Targets that are null, blank or in ``known.id`` are left
    out. Edges without recorded_at can only be missing. Repeated deliveries give one row per (edge_id, state).

    The outside symbols leave first, since one of them can be the target of a tenth or more of all rows. What is missing is
    found by ``orphans``; what exists meets its first recording and its lifetimes on the same key, so that the references are
    exchanged once for all three joins.
    """
    refs = edges.select("edge_id", clean_id("target_id").alias("target"), F.upper(F.btrim("type", F.lit(" \t\r\n"))).alias("type"), "recorded_at")
    outside = known.select(clean_id("id").alias("outside"))
    refs = orphans(refs, outside, {"target": "outside"}).drop("null_mask")
    spans = lifetimes(nodes)
    first = spans.groupBy("id").agg(F.min("recorded_at").alias("first_at"))
    missing = orphans(refs, first, {"target": "id"}).drop("null_mask").withColumn("state", F.lit("missing"))
    met = refs.where("recorded_at is not null").join(first, refs.target == first.id).drop("id")
    late = met.where("first_at > recorded_at").withColumn("state", F.lit("late"))
    live = spans.select("id", F.col("recorded_at").alias("from_at"), "removed_at")
    alive = (F.col("target") == F.col("id")) & (F.col("from_at") <= F.col("recorded_at")) & (F.col("removed_at").isNull() | (F.col("removed_at") > F.col("recorded_at")))
    deleted = met.where("first_at <= recorded_at").join(live, alive, "left_anti").withColumn("state", F.lit("deleted"))
    columns = ["edge_id", "state", "type", "recorded_at"]
    return missing.select(columns).unionByName(late.select(columns)).unionByName(deleted.select(columns)).dropDuplicates(["edge_id", "state"])


def dangling_report(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, month, edges, missing, late, deleted): distinct edges and orphans per edge type and month of recording."""
    month = F.date_format("recorded_at", "yyyy-MM").alias("month")
    kind = F.upper(F.btrim("type", F.lit(" \t\r\n"))).alias("type")
    every = edges.select("edge_id", kind, month).distinct().groupBy("type", "month").agg(F.count(F.lit(1)).alias("edges"))
    counts = found.select("type", month, "state").groupBy("type", "month").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("missing", "late", "deleted")])
    joined = every.alias("e").join(counts.alias("c"), F.col("e.type").eqNullSafe(F.col("c.type")) & F.col("e.month").eqNullSafe(F.col("c.month")), "left")
    return joined.select("e.type", "e.month", "edges", *[F.coalesce(f"c.{s}", F.lit(0)).alias(s) for s in ("missing", "late", "deleted")])
