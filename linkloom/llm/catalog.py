"""Queries of the problems on texts and vectors, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import retrieve
from ..runtime import clean_id, table
from . import handwritten, mixing, neighbours, packing, reading, scan, syntax
from .tokens import with_tokens


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(table(spark, d, "source_file"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.fault_rates(table(spark, d, "source_file"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_file"), table(spark, d, "library_symbol"))


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    judged = handwritten.judged(table(spark, d, "source_file"), table(spark, d, "library_symbol"))
    return judged.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), *[F.count_if(k).alias(k) for k in ("generated", "minified", "vendored", "data", "by_names", "by_style", "by_notice", "by_copy", "by_place")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, d, "graph_node"))
    probes = table(spark, d, "knn_probe").select("probe_no", clean_id("node_id").alias("id")).where("id is not null")
    queries = vectors.join(probes.select("id").distinct(), "id", "left_semi")
    found = neighbours.nearest(queries, vectors)
    return probes.join(found, "id").select("probe_no", F.col("neighbour").alias("neighbor_id")).distinct()


def p3_all(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other functions of every function."""
    vectors = neighbours.usable(table(spark, d, "graph_node").where(F.col("type").isin("Function", "Method")))
    found = neighbours.nearest(vectors, vectors)
    return found.select("id", "neighbour", F.round("cosine", 6).alias("cosine"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the search finds nine in ten of the true neighbours of every function whose id has a hash divisible by 50, among
    all functions: the search as it runs for all of them, by leaf, against the exact one."""
    vectors = neighbours.usable(table(spark, d, "graph_node").where(F.col("type").isin("Function", "Method")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    known = vectors.groupBy(F.col("id").alias("clean")).agg(F.first("vector").alias("vector")).withColumn("vector", F.transform("vector", lambda x: x.cast("double") / norm))
    asked = known.where(F.conv(F.substring(F.md5("clean"), 1, 8), 16, 10).cast("long") % 50 == 0).select(F.col("clean").alias("doc_id"), F.lit(0).alias("chunk_index"), "vector")
    true = retrieve.top_products(asked, known, neighbours.NEAREST + 1).where("fn <> doc_id")
    order = Window.partitionBy("doc_id").orderBy("place")
    true = true.select(F.col("doc_id").alias("id"), F.col("fn").alias("neighbour"), F.row_number().over(order).alias("n")).where(F.col("n") <= neighbours.NEAREST)
    found = neighbours.nearest(vectors, vectors, block=0).select("id", "neighbour", F.lit(True).alias("hit"))
    met = true.join(found, ["id", "neighbour"], "left")
    return met.agg(F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("nine_in_ten"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.documented(table(spark, d, "source_file"), table(spark, d, "library_symbol")).select("path", "func_name", "name_line")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scan.documented(table(spark, d, "source_file"), table(spark, d, "library_symbol"), with_code=True)


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    capacities = table(spark, d, "pack_capacity")
    return packing.fill_report(packing.pack(table(spark, d, "documents"), capacities), capacities)


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers of each capacity: none over it, no text split that fits, every token kept once, and no
    more containers than a hundredth and one beyond what the tokens fill."""
    capacities = table(spark, d, "pack_capacity")
    rows = packing.cut(packing.pack(table(spark, d, "documents"), capacities)).join(capacities.select("capacity_name", F.col("tokens").alias("capacity")), "capacity_name")
    alone = F.col("container") < 0
    loads = rows.groupBy("capacity_name", "capacity", "container", F.when(alone, F.col("doc_id")).alias("doc"), F.when(alone, F.col("piece")).alias("part")).agg(F.sum("tokens").alias("load"))
    over = loads.groupBy("capacity_name").agg((F.max(F.col("load") - F.col("capacity")) <= 0).alias("none_over"), (F.count(F.lit(1)) <= F.ceil(1.01 * F.sum("load") / F.max("capacity")) + 1).alias("full"))
    split = rows.groupBy("capacity_name", "capacity", "doc_id").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("parts"), F.countDistinct("piece").alias("pieces"))
    whole = split.groupBy("capacity_name").agg(F.bool_and(F.col("parts") == F.ceil(F.col("size") / F.col("capacity"))).alias("none_split"), F.bool_and(F.col("parts") == F.col("pieces")).alias("once"), F.sum("size").alias("kept"))
    total = with_tokens(table(spark, d, "documents").select("text")).agg(F.sum("tokens")).scalar()
    joined = over.join(whole, "capacity_name")
    return joined.select("capacity_name", "none_over", "none_split", "once", (F.col("kept") == total).alias("all_kept"), "full")


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each target source: its tokens meet the demand of its weight to within one text, the demands have the
    ratios of the weights, no text is used more often than allowed. A source without any text has nothing to meet."""
    targets = table(spark, d, "mix_target")
    uses = mixing.uses(table(spark, d, "documents"), targets)
    each = uses.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.count(F.lit(1)).alias("uses"), F.max("demand").alias("demand"), F.max("weight").alias("weight"))
    sums = each.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("longest").alias("longest"), F.max("uses").alias("uses"), F.max("demand").alias("demand"), F.max("weight").alias("weight"))
    total = sums.agg(F.sum("demand")).scalar()
    rows = targets.where("target_weight > 0 AND max_repeats > 0").select(mixing.canonical("source").alias("source"), "max_repeats").join(sums, "source", "left")
    yes = lambda c: F.coalesce(c, F.lit(True))
    return rows.select("source", yes(F.abs(F.col("tokens") - F.col("demand")) <= F.col("longest")).alias("demand_met"), yes(F.abs(F.col("demand") / total - F.col("weight")) < 1e-9).alias("in_ratio"), yes(F.col("uses") <= F.col("max_repeats")).alias("cap_kept"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_anchor")).select("doc_id", "band")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and mean sentence length per component and band."""
    found = reading.levels(table(spark, d, "documents"), table(spark, d, "reading_anchor"))
    named = found.join(table(spark, d, "documents").select("doc_id", "component"), "doc_id")
    return named.groupBy("component", "band").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.round(F.avg("words_per_sentence"), 4).alias("mean_sentence"), F.count_if("checked").alias("checked"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p3_found, p3_all, p3_recall, p5_found, p5_pairs, p6_found, p6_kinds, p7_pack, p7_fill, p7_valid, p8_mix, p8_shares, p8_valid, p9_found, p9_profile)}
_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
SQL: dict[str, str] = {
    # exact search: the forest may miss what this finds, at these sizes it looks into nearly every leaf
    "p3_found": f"""WITH v AS (SELECT trim(id, {_SPACE}) AS id, any_value(embedding::DOUBLE[]) AS x FROM graph_node WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0 GROUP BY ALL),
p AS (SELECT DISTINCT probe_no, trim(node_id, {_SPACE}) AS id FROM knn_probe),
s AS (SELECT p.probe_no, n.id, row_number() OVER (PARTITION BY probe_no ORDER BY list_cosine_similarity(q.x, n.x) DESC, n.id) AS k
  FROM p JOIN v q ON q.id = p.id JOIN v n ON n.id <> p.id)
SELECT probe_no, id AS neighbor_id FROM s WHERE k <= 10""",
    "p7_valid": "SELECT capacity_name, true AS none_over, true AS none_split, true AS once, true AS all_kept, true AS full FROM pack_capacity",
    "p8_valid": f"SELECT DISTINCT regexp_replace(lower(trim(source, {_SPACE})), '[\\s-]+', '_', 'g') AS source, true AS demand_met, true AS in_ratio, true AS cap_kept FROM mix_target WHERE target_weight > 0 AND max_repeats > 0",
    "p3_recall": f"""WITH v AS (SELECT DISTINCT trim(id, {_SPACE}) AS id FROM graph_node WHERE type IN ('Function', 'Method') AND trim(id, {_SPACE}) <> '' AND len(embedding) = 64
  AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0), n AS (SELECT count(*) AS k FROM v)
SELECT count(*) AS queries, CAST(sum(least(10, k - 1)) AS BIGINT) AS wanted, true AS nine_in_ten FROM v, n WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 50 = 0""",
}
