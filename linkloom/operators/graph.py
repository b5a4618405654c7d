"""The code graph as two tables: loading, adjacency, degrees, containment of flow facts, cross-function data flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import clean_func_id
from ..runtime import clean_id

FUNCTIONS = ("Function", "Method")
FLOW_TYPES = ("DATAFLOW", "PARAMETER", "RETURN")


def edge_type(c: str = "type") -> Column:
    return F.upper(F.btrim(c, F.lit(" \t\r\n")))


def edge_rows(edges: DataFrame) -> DataFrame:
    """(edge_id, src, dst, type): edges with both ends, trimmed, types in upper case."""
    return edges.select("edge_id", clean_id("source_id").alias("src"), clean_id("target_id").alias("dst"), edge_type().alias("type")).where("src is not null and dst is not null")


def calls(edges: DataFrame) -> DataFrame:
    """(src, dst, ord): each call once between cleaned ids, in the order of first delivery."""
    rows = edge_rows(edges).where("type = 'CALLS'").select(clean_func_id(F.col("src")).alias("src"), clean_func_id(F.col("dst")).alias("dst"), "edge_id")
    return rows.groupBy("src", "dst").agg(F.min("edge_id").alias("ord"))


def flows(edges: DataFrame) -> DataFrame:
    """(src, dst, type) of flow edges between cleaned ids, with repetitions."""
    return edge_rows(edges).where(F.col("type").isin(*FLOW_TYPES)).select(clean_func_id(F.col("src")).alias("src"), clean_func_id(F.col("dst")).alias("dst"), "type")


def usable_vector(v: Column, width: int) -> Column:
    """Whether an array has ``width`` finite numbers that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(v) == width) & finite & F.exists(v, lambda x: x != 0)


def functions(nodes: DataFrame, width: int = 64) -> DataFrame:
    """(id, clean, name, language, signature, file_path, summary, vector): one row a function id.

    Where rows of an id differ, the greatest non-null value of each column stands; a vector that is not ``width`` finite
    numbers, not all zero, is null.
    """
    v = F.col("embedding")
    good = usable_vector(v, width)
    rows = nodes.where(F.col("type").isin(*FUNCTIONS)).withColumn("id", clean_id("id")).where("id is not null")
    text = lambda c: F.max(F.nullif(F.btrim(c, F.lit(" \t\r\n")), F.lit(""))).alias(c)
    one = rows.groupBy("id").agg(text("name"), F.max(F.lower(F.btrim("language", F.lit(" \t\r\n")))).alias("language"), text("signature"), text("file_path"), text("summary"), F.max(F.when(good, v)).alias("vector"))
    return one.withColumn("clean", clean_func_id(F.col("id")))


def adjacency(call: DataFrame) -> DataFrame:
    """(src, callees): distinct callees in first-seen order. A list per caller: what its body calls."""
    return call.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("callees"))


def reverse(call: DataFrame) -> DataFrame:
    """(src, dst, ord) with callee and caller changed over. Rows, no lists: one callee may have a tenth of all callers."""
    return call.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ord")


def degrees(call: DataFrame) -> DataFrame:
    """(fn, out_degree, in_degree, centrality). Centrality is the degree over twice min(10, callers - 1), at most 1; with
    one caller, where that is 0, it is 0.5."""
    ends = call.select(F.explode(F.array(F.struct(F.col("src").alias("fn"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("fn"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    sums = ends.groupBy("fn").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    most = call.agg(F.least(F.lit(10), F.countDistinct("src") - 1).alias("most")).scalar()
    value = F.when(most > 0, F.least(F.lit(1.0), F.try_divide(F.col("out_degree") + F.col("in_degree"), 2 * most))).otherwise(0.5)
    return sums.select("fn", "out_degree", "in_degree", value.alias("centrality"))


def flow_flags(flow: DataFrame) -> DataFrame:
    return flow.groupBy("src").agg(F.bool_or(F.col("type") == "PARAMETER").alias("has_params"), F.bool_or(F.col("type") == "RETURN").alias("has_returns"), F.count(F.lit(1)).alias("flows"))


def node_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select(clean_id("id").alias("id")).dropna().distinct()


def closed_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, ord): calls, by full ids, both of whose ends have a node."""
    ids = node_ids(nodes)
    rows = edge_rows(edges).where("type = 'CALLS'").groupBy("src", "dst").agg(F.min("edge_id").alias("ord"))
    return rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def parameters(nodes: DataFrame) -> DataFrame:
    """(scope, param, place): parameters of a function by position, then id; place counts from 0."""
    rows = nodes.where("type = 'Parameter'").select(F.btrim("scope", F.lit(" \t\r\n")).alias("scope"), clean_id("id").alias("param"), F.try_element_at("raw_attributes", F.lit("position")).cast("int").alias("position"))
    rows = rows.dropna(subset=["scope", "param"]).groupBy("scope", "param").agg(F.min("position").alias("position"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("scope").orderBy(F.asc_nulls_first("position"), "param")) - 1).drop("position")


def parameter_flow(call: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, place, call_edge_id): caller parameters zipped with callee parameters, by place."""
    p = parameters(nodes)
    left = p.select(F.col("scope").alias("src"), F.col("param").alias("source_id"), "place")
    right = p.select(F.col("scope").alias("dst"), F.col("param").alias("target_id"), "place")
    return call.join(left, "src").join(right, ["dst", "place"]).select("source_id", "target_id", "place", F.concat("src", F.lit("->"), "dst").alias("call_edge_id"))


def return_flow(call: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, call_edge_id): the callee's first return node to the caller's return variable."""
    first = nodes.where("type = 'ReturnValue'").select(F.btrim("scope", F.lit(" \t\r\n")).alias("dst"), clean_id("id").alias("source_id")).dropna().groupBy("dst").agg(F.min("source_id").alias("source_id"))
    return call.join(first, "dst").select("source_id", F.concat(F.lit("Var:"), "src", F.lit(".return_value")).alias("target_id"), F.concat("src", F.lit("->"), "dst").alias("call_edge_id"))


def return_variables(call: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, scope, data_type): one variable a caller, with the type that its first call returns."""
    kinds = nodes.where("type = 'ReturnValue'").select(F.btrim("scope", F.lit(" \t\r\n")).alias("dst"), clean_id("id").alias("rid"), "data_type").dropna(subset=["dst", "rid"])
    kinds = kinds.groupBy("dst").agg(F.min(F.struct("rid", "data_type")).alias("r"))
    return call.join(kinds, "dst").groupBy("src").agg(F.min_by("r.data_type", F.struct("ord", "dst")).alias("data_type")).select(F.concat(F.lit("Var:"), "src", F.lit(".return_value")).alias("id"), F.col("src").alias("scope"), "data_type")
