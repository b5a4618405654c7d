"""The code graph from source files: facts per file, then resolution, data flow, accesses and statistics as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import graph, resolve
from ..parse.facts import facts
from ..providers import summarize
from ..runtime import keep, table

_NODE = ["id", "type", "name", "language", "signature", "path", "start_line", "end_line", "data_type", "scope", "position", "detail"]


def _first_of(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key by path and place in the file."""
    w = W.partitionBy(key).orderBy("path", "ord")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def symbols(rows: DataFrame) -> DataFrame:
    """(language, key, key_ord, node_id): first place in the order of sorted paths, last value."""
    defined = rows.where("kind = 'symbol'").select("language", "key", F.col("id").alias("node_id"), F.struct("path", "ord").alias("ord"))
    return defined.groupBy("language", "key").agg(F.min("ord").alias("key_ord"), F.max_by("node_id", "ord").alias("node_id"))


def call_edges(rows: DataFrame) -> DataFrame:
    """(source_id, target_id, type, language): resolved calls of all three languages."""
    symbol, out = symbols(rows), None
    for language in resolve.SEPARATORS:
        own = symbol.where(F.col("language") == language)
        asked = rows.where((F.col("kind") == "call") & (F.col("language") == language)).select(F.col("key").alias("caller_key"), "callee")
        edges = resolve.call_edges(resolve.resolve(asked, own, language), own).withColumn("language", F.lit(language))
        out = edges if out is None else out.unionByName(edges)
    return out.select("source_id", "target_id", F.lit("CALLS").alias("type"), "language")


def global_access(rows: DataFrame) -> DataFrame:
    """(source_id, target_id, type): C++ functions and the globals of their file that they name; WRITES where they assign one."""
    return rows.where("kind = 'edge' and type in ('READS', 'WRITES')").select("source_id", "target_id", "type").distinct()


def vectors_of(metadata: DataFrame, embedder) -> DataFrame:
    """``metadata`` with ``embedding`` of the first text among summary, signature and name; rows without any text, or whose
    vector is all zero, are left out. The id stays beside its vector, so that the two can't fall out of step.

    This is the index of a build, and rebuilds one from metadata alone.
    """
    said = F.coalesce(*[F.nullif(F.btrim(c), F.lit("")) for c in ("summary", "signature", "name") if c in metadata.columns])
    rows = embedder(metadata.withColumn("__text", said).where("__text is not null"), "__text").drop("__text")
    return rows.where(F.exists("embedding", lambda x: x != 0))


def build(files: DataFrame, dataflow: bool = True, embedder=None) -> dict[str, DataFrame]:
    """nodes, edges, metadata, statistics and errors of source files (path, content); with an ``embedder`` also vectors."""
    rows = keep(facts(files, dataflow))
    nodes = _first_of(rows.where("kind = 'node'").select(*_NODE, "ord", "comment", "code"), "id")
    own = rows.where("kind = 'edge'").groupBy("source_id", "target_id", "type", "language").agg(F.min("position").alias("position"), F.max("detail").alias("detail"))
    called = call_edges(rows)
    edges = own.unionByName(called, allowMissingColumns=True)
    if dataflow:
        ids = nodes.select("id").withColumnRenamed("id", "src")
        closed = called.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "language", F.lit(0).alias("ord"))
        closed = closed.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
        shaped = nodes.withColumn("raw_attributes", F.create_map(F.lit("position"), F.col("position").cast("string")))
        passes = graph.parameter_flow(closed, shaped).select("source_id", "target_id", F.lit("PASSES_TO").alias("type"), F.col("place").alias("position"), F.col("call_edge_id").alias("detail"))
        gives = graph.return_flow(closed, shaped).select("source_id", "target_id", F.lit("RETURNS_TO").alias("type"), F.col("call_edge_id").alias("detail"))
        edges = edges.unionByName(passes, allowMissingColumns=True).unionByName(gives, allowMissingColumns=True)
        variables = graph.return_variables(closed, shaped).withColumn("type", F.lit("Variable")).withColumn("name", F.lit("return_value"))
        nodes = nodes.unionByName(variables, allowMissingColumns=True)
    functions = nodes.where(F.col("type").isin(*graph.FUNCTIONS))
    metadata = summarize(functions.withColumn("code", F.coalesce("code", "signature"))).select(
        F.col("id").alias("node_id"), "id", "name", F.col("name").alias("function_name"), F.col("path").alias("file_path"), "signature", "summary", "language", "type", "start_line", "end_line"
    )
    counts = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.countDistinct(F.when(F.col("type").isin(*graph.FUNCTIONS) & F.col("code").isNotNull(), F.col("id"))).alias("function_count"), F.countDistinct(F.when(F.col("type") == "GlobalVariable", F.col("name"))).alias("global_variables"))
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    callers = rows.where("kind = 'call'").agg(F.countDistinct("key")).scalar()
    langs = {k: rows.where((F.col("type") == "File") & (F.col("language") == k)).agg(F.countDistinct("path")).scalar() for k in resolve.SEPARATORS}
    statistics = counts.select("*", n_edges.alias("total_edges"), callers.alias("call_relations_count"), *[v.alias(f"files_{k}") for k, v in langs.items()], F.lit(dataflow).alias("enable_dataflow"))
    index = {"vectors": vectors_of(metadata, embedder)} if embedder else {}
    return index | {"nodes": nodes, "edges": edges, "metadata": metadata, "statistics": statistics, "errors": rows.where("kind = 'error'").select("path", "detail"), "facts": rows}


def enhanced(rows: DataFrame, language: str) -> DataFrame:
    """(source_id, target_id, type, language) of a second look at all callers, whatever their language, by the rules of one.

    A callee that the rules don't resolve goes to the first key that contains it. Edges are labelled with the language.
    """
    known = symbols(rows).drop("language").groupBy("key").agg(F.min("key_ord").alias("key_ord"), F.min_by("node_id", "key_ord").alias("node_id"))
    asked = rows.where("kind = 'call'").select(F.col("key").alias("caller_key"), "callee").distinct()
    found = resolve.resolve(asked, known, language).select("caller_key", "callee", "node_id")
    rest = asked.join(found, ["caller_key", "callee"], "left_anti")
    loose = rest.join(resolve.contains_match(rest, known), "callee").select("caller_key", "callee", "node_id")
    edges = resolve.call_edges(found.unionByName(loose), known)
    return edges.select("source_id", "target_id", F.lit("CALLS").alias("type"), F.lit(language).alias("language"))


# ---------------------------------------------------------------- queries; SQL can't parse source text, tests hold them


def _built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return build(table(spark, d, "source_file"))


def source_nodes(spark, d):
    return _built(spark, d)["nodes"].select(*_NODE, "comment")


def source_edges(spark, d):
    return _built(spark, d)["edges"]


def source_metadata(spark, d):
    return _built(spark, d)["metadata"]


def source_statistics(spark, d):
    return _built(spark, d)["statistics"]


def source_imports(spark, d):
    rows = facts(table(spark, d, "source_file"))
    return rows.where("type in ('IMPORT', 'EXPORTS')").select("source_id", "target_id", "type", "language").distinct()


def source_global_access(spark, d):
    return global_access(keep(facts(table(spark, d, "source_file"))))


QUERIES = {f.__name__: f for f in (source_nodes, source_edges, source_metadata, source_statistics, source_imports, source_global_access)}
