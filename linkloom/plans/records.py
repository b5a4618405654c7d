"""Queries of the two general data problems: containment hierarchies (p1) and dangling references (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import hierarchy as H, orphans as O
from ..runtime import clean_id, table

SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return H.contained(table(spark, d, "graph_edge"))


def _tree(spark: SparkSession, d: str, with_path: bool = False) -> DataFrame:
    return H.hierarchy(H.parent_links(table(spark, d, "graph_edge")), with_path)


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, True).where("parent_id is not null").select("node_id", "parent_id", "root_id", "depth", F.coalesce("size", F.lit(0)).alias("size"), "path")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number and greatest distance of the descendants of every id, counted from its listed descendants."""
    tree = _tree(spark, d)
    return H.descendants(tree, tree).groupBy("node_id").agg(F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("farthest"))


def p1_circles(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where("depth = -1").groupBy("root_id").agg(F.count_if("on_circle").alias("on_circle"), F.count_if(~F.col("on_circle")).alias("below"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return O.dangling(t("graph_edge"), t("graph_node"), t("library_symbol")).select("edge_id", "state")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return O.dangling_report(O.dangling(t("graph_edge"), t("graph_node"), t("library_symbol")), t("graph_edge"))


def p4_partial_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite key (target_id, language): a null language asks only for the id, *partial* match."""
    clean = lambda c: F.lower(clean_id(c))
    edges = table(spark, d, "graph_edge").select("edge_id", clean_id("target_id").alias("target"), clean("language").alias("language"))
    nodes = table(spark, d, "graph_node").select(clean_id("id").alias("id"), clean("language").alias("language"))
    return O.orphans(edges, nodes, {"target": "id", "language": "language"}, "partial").groupBy("null_mask").agg(F.countDistinct("edge_id").alias("edges"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_circles, p4_found, p4_report, p4_partial_keys)}

_LINKS = f"""links AS (SELECT DISTINCT trim(target_id, {SPACE}) AS child, trim(source_id, {SPACE}) AS parent FROM graph_edge
  WHERE upper(trim(type, {SPACE})) = 'CONTAINS' AND trim(target_id, {SPACE}) <> '' AND trim(source_id, {SPACE}) <> '')"""
#: Walks up from every id until an ancestor repeats.
_UP = f"""WITH RECURSIVE {_LINKS},
up AS (SELECT child AS node_id, parent AS top, 1 AS depth, [child] AS seen FROM links
  UNION ALL SELECT node_id, parent, depth + 1, list_append(seen, child) FROM up JOIN links ON up.top = links.child WHERE NOT list_contains(seen, child)),
last AS (SELECT node_id, max(depth) AS depth, arg_max(top, depth) AS top, arg_max(seen, depth) AS seen FROM up GROUP BY node_id),
ends AS (SELECT l.*, EXISTS (SELECT 1 FROM links k WHERE k.child = l.top) AS turning FROM last l)"""
_FOUND = f"""{_UP} SELECT node_id, CASE WHEN turning THEN list_min(list_slice(seen, list_position(seen, top), len(seen))) ELSE top END AS root_id,
  CAST(CASE WHEN turning THEN -1 ELSE depth END AS INTEGER) AS depth FROM ends"""
_STATES = f"""n AS (SELECT trim(id, {SPACE}) AS id, recorded_at, removed_at FROM graph_node WHERE trim(id, {SPACE}) <> ''),
e AS (SELECT DISTINCT edge_id, trim(target_id, {SPACE}) AS target, upper(trim(type, {SPACE})) AS type, recorded_at FROM graph_edge
  WHERE trim(target_id, {SPACE}) <> '' AND trim(target_id, {SPACE}) NOT IN (SELECT id FROM library_symbol)),
s AS (SELECT e.edge_id, e.target, e.type, e.recorded_at, CASE WHEN count(n.id) = 0 THEN 'missing' WHEN count_if(n.recorded_at <= e.recorded_at) = 0 THEN 'late'
  WHEN count_if(n.recorded_at <= e.recorded_at AND (n.removed_at IS NULL OR n.removed_at > e.recorded_at)) = 0 THEN 'deleted' END AS state
  FROM e LEFT JOIN n ON n.id = e.target GROUP BY ALL)"""
SQL = {
    "p1_found": _FOUND,
    "p4_found": f"WITH {_STATES} SELECT DISTINCT edge_id, state FROM s WHERE state IS NOT NULL",
    "p4_report": f"""WITH {_STATES}, a AS (SELECT type, month, count(*) AS edges FROM (SELECT DISTINCT edge_id, upper(trim(type, {SPACE})) AS type, strftime(recorded_at, '%Y-%m') AS month FROM graph_edge) GROUP BY ALL),
b AS (SELECT type, strftime(recorded_at, '%Y-%m') AS month, state, count(DISTINCT edge_id) AS k FROM s WHERE state IS NOT NULL GROUP BY ALL)
SELECT a.type, a.month, a.edges, CAST(coalesce(sum(k) FILTER (state = 'missing'), 0) AS BIGINT) AS missing, CAST(coalesce(sum(k) FILTER (state = 'late'), 0) AS BIGINT) AS late,
CAST(coalesce(sum(k) FILTER (state = 'deleted'), 0) AS BIGINT) AS deleted FROM a LEFT JOIN b ON a.type IS NOT DISTINCT FROM b.type AND a.month IS NOT DISTINCT FROM b.month GROUP BY ALL""",
    "p4_partial_keys": f"""WITH e AS (SELECT edge_id, nullif(trim(target_id, {SPACE}), '') AS t, lower(nullif(trim(language, {SPACE}), '')) AS l FROM graph_edge),
n AS (SELECT DISTINCT nullif(trim(id, {SPACE}), '') AS i, lower(nullif(trim(language, {SPACE}), '')) AS l FROM graph_node)
SELECT (CASE WHEN t IS NULL THEN 'N' ELSE 'V' END) || (CASE WHEN l IS NULL THEN 'N' ELSE 'V' END) AS null_mask, count(DISTINCT edge_id) AS edges FROM e
WHERE (t IS NOT NULL OR l IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM n WHERE (e.t IS NULL OR n.i = e.t) AND (e.l IS NULL OR n.l = e.l)
AND (e.t IS NULL OR n.i IS NOT NULL)) GROUP BY ALL""",
    "p1_paths": f"""{_UP}, f AS ({_FOUND[len(_UP):]}),
sz AS (SELECT top AS id, count(*) AS k FROM up GROUP BY ALL)
SELECT f.node_id, l.parent AS parent_id, root_id, f.depth, CAST(CASE WHEN turning THEN 0 ELSE 1 + coalesce(k, 0) END AS BIGINT) AS size,
CASE WHEN turning THEN NULL ELSE root_id || ' > ' || array_to_string(list_reverse(seen), ' > ') END AS path
FROM f JOIN ends USING (node_id) JOIN links l ON l.child = f.node_id LEFT JOIN sz ON sz.id = f.node_id""",
    "p1_descendants": f"""{_UP}, f AS ({_FOUND[len(_UP):]}) SELECT up.top AS node_id, count(*) AS descendants, CAST(max(up.depth) AS INTEGER) AS farthest
FROM up JOIN f USING (node_id) WHERE f.depth > 0 GROUP BY ALL""",
    "p1_circles": f"""{_UP}, c AS (SELECT node_id, list_slice(seen, list_position(seen, top), len(seen)) AS ring FROM ends WHERE turning)
SELECT list_min(ring) AS root_id, CAST(count_if(list_contains(ring, node_id)) AS BIGINT) AS on_circle, CAST(count_if(NOT list_contains(ring, node_id)) AS BIGINT) AS below FROM c GROUP BY ALL""",
}
