"""Queries of the tracing operators over the code graph, requirement texts and judge replies, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scoring, text
from ..operators import chains, graph, resolve, retrieve
from ..runtime import clean_id, cut, table
from .. import providers
from . import reason as plan

# ---------------------------------------------------------------- shared inputs


def _functions(spark, d):
    return graph.functions(table(spark, d, "graph_node"))


def _calls(spark, d):
    return graph.calls(table(spark, d, "graph_edge"))


def _flow(spark, d):
    """Flow edges between functions: one PARAMETER edge for each pair of parameters that a call joins, one RETURN edge a call."""
    nodes = table(spark, d, "graph_node")
    call = graph.closed_calls(table(spark, d, "graph_edge"), nodes)
    ends = lambda df: df.select(F.split("call_edge_id", "->").alias("e"))
    typed = ends(graph.parameter_flow(call, nodes)).withColumn("type", F.lit("PARAMETER")).unionByName(ends(graph.return_flow(call, nodes)).withColumn("type", F.lit("RETURN")))
    return typed.select(text.clean_func_id(F.col("e")[0]).alias("src"), text.clean_func_id(F.col("e")[1]).alias("dst"), "type")


def _vectors(spark, d):
    """A vector for each chunk in place of an embedder's: that of the probe with number (7 x document number + chunk) mod probes + 1."""
    parts = plan.requirement_chunks(table(spark, d, "requirement_text")).select("doc_id", "chunk_index")
    probes = table(spark, d, "knn_probe")
    n = probes.agg(F.count(F.lit(1))).scalar()
    number = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long")
    asked = parts.withColumn("probe_no", (number * 7 + F.col("chunk_index")) % n + 1)
    vector = _functions(spark, d).select("id", "vector")
    known = probes.select("probe_no", clean_id("node_id").alias("id")).join(vector, "id")
    return asked.join(known, "probe_no").select("doc_id", "chunk_index", "vector")


def _embedder(spark, d):
    """In place of an embedder's: the vector of the probe with number (length of the text) mod probes + 1."""
    probes = table(spark, d, "knn_probe")
    n = probes.agg(F.count(F.lit(1))).scalar()
    known = probes.select(F.col("probe_no").alias("__probe"), clean_id("node_id").alias("id")).join(_functions(spark, d).select("id", F.col("vector").alias("embedding")), "id").drop("id")
    return lambda rows, column: rows.withColumn("__probe", F.length(column) % n + 1).join(known, "__probe", "left").drop("__probe")


def _judge(spark, d):
    """Replies of a document in order of their ids judge its chains in order of rank and discovery."""
    turn = lambda *order: F.row_number().over(W.partitionBy("doc_id").orderBy(*order)).alias("turn")
    replies = table(spark, d, "llm_reply").select("doc_id", turn("reply_id"), text.parse_reply(F.col("reply")).alias("scores"))
    return lambda rows: rows.select("doc_id", "rank", "ord", turn("rank", "ord")).join(replies, ["doc_id", "turn"]).drop("turn")


def _hits(spark, d):
    vectors, known = _vectors(spark, d), _functions(spark, d)
    found = retrieve.top_products(vectors, known)
    return cut(retrieve.gated(plan.with_summary_similarity(found, vectors, known, _embedder(spark, d))))


def _leaders(spark, d):
    return retrieve.leading(retrieve.candidates(_hits(spark, d)))


def _evidence(spark, d):
    hits = _hits(spark, d)
    leaders = retrieve.leading(retrieve.candidates(hits))
    chunks = plan.requirement_chunks(table(spark, d, "requirement_text"))
    return plan.evidence(leaders, _functions(spark, d), _calls(spark, d), _flow(spark, d), _vectors(spark, d), chunks, _judge(spark, d), _embedder(spark, d))


def _joined(c):
    return F.array_join(c, "->")


# ---------------------------------------------------------------- queries


def tree_filter_counts(spark, d):
    files = table(spark, d, "source_file").select("path").distinct()
    return files.groupBy(text.detect_language(F.col("path")).alias("language"), text.in_ignored_dir(F.col("path")).alias("ignored")).agg(F.count(F.lit(1)).alias("files"))


def clean_func_ids(spark, d):
    return table(spark, d, "graph_node").where(F.col("type").isin(*graph.FUNCTIONS)).select(clean_id("id").alias("id")).distinct().withColumn("clean", text.clean_func_id(F.col("id")))


def summary_keywords(spark, d):
    return _functions(spark, d).where("summary is not null").select("id", F.array_join(text.keywords(F.col("summary")), " ").alias("keywords"))


def keyword_union(spark, d):
    c = text.keyword_union(F.col("summary"), F.col("signature"))
    return _functions(spark, d).select("id", F.array_join(c, " ").alias("keywords"))


def concise_info(spark, d):
    c = text.concise(F.col("summary"))
    return _functions(spark, d).where("summary is not null").select("id", c.alias("concise"), text.is_utility(c).alias("utility"))


def paragraph_split(spark, d):
    p = text.paragraphs(F.col("text"))
    return table(spark, d, "requirement_text").select("doc_id", F.size(p).cast("long").alias("paragraphs"), F.array_join(p, "|").alias("joined"))


def greedy_pack(spark, d):
    return plan.requirement_chunks(table(spark, d, "requirement_text")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def word_windows(spark, d):
    rows = table(spark, d, "requirement_text").select("doc_id", F.posexplode(text.word_windows(F.col("text"))).alias("n", "window"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "window")


def template_summary(spark, d):
    c = text.template_summary(F.col("name"), F.col("language"), F.col("signature"), F.col("signature"))
    return _functions(spark, d).select("id", c.alias("made"))


def parse_scores(spark, d):
    rows = table(spark, d, "llm_reply").select("reply_id", text.parse_reply(F.col("reply")).alias("s"))
    numbers = [F.round(f"s.{k}", 6).alias(k) for k in ("overall", "semantic", "completeness", "dataflow", "rationality")]
    return rows.select("reply_id", *numbers, F.col("s.reason").alias("reason"))


def _resolve(language, sep):
    def query(spark, d):
        f = _functions(spark, d).where(F.col("language") == language)
        symbol = resolve.symbols(f.select(F.col("clean").alias("key"), F.col("id").alias("node_id"), F.col("id").alias("ord")))
        rows = _calls(spark, d).join(f.select(F.col("clean").alias("src")), "src")
        facts = rows.select(F.col("src").alias("caller_key"), F.element_at(F.split("dst", sep), -1).alias("callee"))
        return resolve.resolve(facts, symbol, language)

    query.__name__ = f"resolve_{language}"
    return query


def resolve_contains(spark, d):
    f = _functions(spark, d)
    symbol = resolve.symbols(f.select(F.col("clean").alias("key"), F.col("id").alias("node_id"), F.col("id").alias("ord")))
    facts = _calls(spark, d).select(F.element_at(F.split("dst", r"::|\."), -1).alias("callee"))
    return resolve.contains_match(facts, symbol)


def call_edge_dedup(spark, d):
    return _calls(spark, d)


def edge_node_inner(spark, d):
    return graph.closed_calls(table(spark, d, "graph_edge"), table(spark, d, "graph_node"))


def param_positional_join(spark, d):
    nodes = table(spark, d, "graph_node")
    return graph.parameter_flow(graph.closed_calls(table(spark, d, "graph_edge"), nodes), nodes).withColumn("place", F.col("place").cast("long"))


def return_first(spark, d):
    nodes = table(spark, d, "graph_node")
    return graph.return_flow(graph.closed_calls(table(spark, d, "graph_edge"), nodes), nodes)


def var_node_dedup(spark, d):
    nodes = table(spark, d, "graph_node")
    return graph.return_variables(graph.closed_calls(table(spark, d, "graph_edge"), nodes), nodes)


def flow_records(spark, d):
    return _flow(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("records"))


def graph_load_route(spark, d):
    rows = graph.edge_rows(table(spark, d, "graph_edge"))
    route = F.when(F.col("type") == "CALLS", "calls").when(F.col("type").isin(*graph.FLOW_TYPES), "flow").otherwise("other")
    return rows.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src", "dst").alias("pairs"))


def adjacency(spark, d):
    return graph.adjacency(_calls(spark, d)).select("src", F.array_join("callees", " ").alias("callees"), F.size("callees").cast("long").alias("n"))


def reverse_adjacency(spark, d):
    """Callers of each callee: how many, and the first and last in order of delivery."""
    order = F.struct("ord", "dst")
    return graph.reverse(_calls(spark, d)).groupBy("src").agg(F.count(F.lit(1)).alias("callers"), F.min_by("dst", order).alias("first_caller"), F.max_by("dst", order).alias("last_caller"))


def degree_centrality(spark, d):
    return graph.degrees(_calls(spark, d)).withColumn("centrality", F.round("centrality", 6))


def dataflow_flags(spark, d):
    return graph.flow_flags(_flow(spark, d))


def cosine_topk(spark, d):
    found = retrieve.top_products(_vectors(spark, d), _functions(spark, d))
    return found.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "fn", F.col("place").cast("long").alias("place"), F.round("vector_similarity", 6).alias("vector_similarity"))


def similarity_gate(spark, d):
    return _hits(spark, d).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "fn", F.round("similarity", 6).alias("similarity"), "detail")


def semantic_blend(spark, d):
    """Blend of two judged dimensions in place of two similarities."""
    rows = table(spark, d, "llm_reply").select("reply_id", text.parse_reply(F.col("reply")).alias("s")).where("s is not null")
    v, s = F.col("s.semantic") - 0.5, F.col("s.dataflow") - 0.5
    return rows.select("reply_id", F.round(scoring.blend(v, s), 6).alias("similarity"), F.expr("s.semantic > 0.5 and s.dataflow > 0.5").alias("both"))


def candidate_agg(spark, d):
    found = retrieve.candidates(_hits(spark, d))
    return found.select("doc_id", "fn", F.round("total_score", 6).alias("total_score"), "chunk_count", F.round("best_similarity", 6).alias("best_similarity"), F.col("best_chunk_index").cast("long").alias("best_chunk_index"), "best_detail")


def candidate_top5(spark, d):
    return _leaders(spark, d).select("doc_id", F.col("rank").cast("long").alias("rank"), "fn", "mode")


def walks_2_3(spark, d):
    return chains.walks(_leaders(spark, d).select("doc_id", "rank", "fn"), _calls(spark, d)).select("doc_id", F.col("rank").cast("long").alias("rank"), _joined("chain").alias("chain"), _joined(F.col("ord").cast("array<string>")).alias("ord"))


def walks_2_4(spark, d):
    found = chains.walks(_leaders(spark, d).select("doc_id", "rank", "fn"), _calls(spark, d), 4)
    return found.groupBy("doc_id", F.size("chain").cast("long").alias("nodes")).agg(F.count(F.lit(1)).alias("walks"))


def _told(spark, d, *more):
    found = chains.walks(_leaders(spark, d).select("doc_id", "rank", "fn", "mode", *more), _calls(spark, d))
    return chains.summarized(found, _functions(spark, d), ["doc_id", "rank", "ord"])


def chain_summary(spark, d):
    return _told(spark, d).select("doc_id", F.col("rank").cast("long").alias("rank"), _joined("chain").alias("chain"), "semantic_summary", F.array_join("key_nodes", " ").alias("key_nodes"))


def semantic_dedup(spark, d):
    return chains.distinct_summaries(_told(spark, d), ["doc_id", "rank"], ["ord"]).select("doc_id", F.col("rank").cast("long").alias("rank"), _joined("chain").alias("chain"))


def chain_cap(spark, d):
    kept = chains.capped(chains.distinct_summaries(_told(spark, d), ["doc_id", "rank"], ["ord"]), ["doc_id", "rank"])
    return kept.select("doc_id", F.col("rank").cast("long").alias("rank"), _joined("chain").alias("chain"), "mode")


def judge_prompt(spark, d):
    """What a judge is asked about each chain that it sees."""
    kept = chains.capped(chains.distinct_summaries(_told(spark, d, "best_chunk_index"), ["doc_id", "rank"], ["ord"]), ["doc_id", "rank"])
    rows = plan.judge_inputs(kept, plan.requirement_chunks(table(spark, d, "requirement_text")), _functions(spark, d))
    asked = providers.prompt(F.col("requirement"), F.col("semantic_summary"), F.col("node_details"))
    return rows.select("doc_id", F.col("rank").cast("long").alias("rank"), _joined(F.col("ord").cast("array<string>")).alias("ord"), asked.alias("prompt"))


_NUMBERS = ("similarity", "structure", "prior", "posterior", "judged")


def chain_evidence(spark, d):
    """Similarity, structure, prior and posterior of every judged chain."""
    rows = _evidence(spark, d)
    return rows.select("doc_id", F.col("rank").cast("long").alias("rank"), _joined("chain").alias("chain"), *[F.round(c, 6).alias(c) for c in _NUMBERS], "central")


def ranked_chains(spark, d):
    """Chosen chain and alternatives of each document with the reason of the choice."""
    rows = chains.choose(plan.merged(_evidence(spark, d))).where("place <= 4")
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), _joined("chain").alias("chain"), F.round("choice", 6).alias("choice"), "reason", scoring.confidence(F.col("posterior")).alias("confidence"))


def run_statistics(spark, d):
    """Chains found, distinct by summary and judged, summed over the candidates of a document."""
    told = _told(spark, d)
    unique = chains.distinct_summaries(told, ["doc_id", "rank"], ["ord"])
    judged = chains.capped(unique, ["doc_id", "rank"])
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    joined = count(told, "total_chains_found").join(count(unique, "unique_chains_analyzed"), "doc_id", "left").join(count(judged, "total_llm_judgments"), "doc_id", "left")
    return joined.fillna(0)


def trace_result(spark, d):
    return plan.reason(table(spark, d, "requirement_text"), _vectors(spark, d), _functions(spark, d), _calls(spark, d), _flow(spark, d), judge=_judge(spark, d), embedder=_embedder(spark, d))


def beta_likelihoods(spark, d):
    rows = table(spark, d, "llm_reply").select("reply_id", text.parse_reply(F.col("reply")).alias("s")).where("s is not null")
    x = F.col("s.overall")
    return rows.select("reply_id", F.round(scoring.beta33(x), 6).alias("b33"), F.round(scoring.beta62(x), 6).alias("b62"), F.round(scoring.beta51(x), 6).alias("b51"), F.round(scoring.sigmoid(x), 6).alias("sig"))


def chain_posterior(spark, d):
    """Prior and posterior of chains of 2 to 4 nodes, one a reply, its semantic dimension in place of the similarity."""
    rows = table(spark, d, "llm_reply").select("reply_id", text.parse_reply(F.col("reply")).alias("s")).where("s is not null")
    n = 2 + F.col("reply_id") % 3
    p = scoring.prior(n, F.col("s.semantic"), F.col("s.overall"), F.col("reply_id") % 5)
    post = scoring.posterior(p, F.col("s.semantic"), scoring.initial_structure(n), F.col("s"))
    return rows.select("reply_id", F.round(p, 6).alias("prior"), F.round(post, 6).alias("posterior"), scoring.confidence(post).alias("confidence"), F.round(scoring.selection_score(n, post, F.col("s.overall"), F.col("s.semantic")), 6).alias("choice"))


def statistics_row(spark, d):
    nodes, edges, files = (table(spark, d, t) for t in ("graph_node", "graph_edge", "source_file"))
    ids = graph.node_ids(nodes).agg(F.count(F.lit(1))).scalar()
    f = graph.node_ids(nodes.where(F.col("type").isin(*graph.FUNCTIONS))).agg(F.count(F.lit(1))).scalar()
    callers = _calls(spark, d).agg(F.countDistinct("src")).scalar()
    scanned = files.agg(F.countDistinct("path")).scalar()
    return edges.agg(F.countDistinct("edge_id").alias("total_edges")).select("total_edges", ids.alias("total_nodes"), f.alias("function_count"), callers.alias("call_relations_count"), scanned.alias("files"))


def nodes_by_type(spark, d):
    return table(spark, d, "graph_node").groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(clean_id("id")).alias("ids"))


def edges_by_type(spark, d):
    return table(spark, d, "graph_edge").groupBy(graph.edge_type().alias("type")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("edge_id").alias("edges"))


def metadata_rows(spark, d):
    """Function rows as metadata: what an index of summaries would hold, its text the first of summary, signature and name."""
    f = _functions(spark, d)
    return f.select("id", "clean", F.coalesce("summary", "signature", "name", F.lit("")).alias("text"), F.coalesce("file_path", F.lit("Unknown")).alias("file_path"), F.coalesce("language", F.lit("unknown")).alias("language"), F.col("vector").isNotNull().alias("embedded"))


_resolvers = {f"resolve_{k}": _resolve(k, s) for k, s in (("java", r"\."), ("javascript", r"\."), ("cpp", "::"))}
QUERIES = {
    f.__name__: f
    for f in (
        tree_filter_counts, clean_func_ids, summary_keywords, keyword_union, concise_info, paragraph_split, greedy_pack, word_windows, template_summary, parse_scores, resolve_contains,
        call_edge_dedup, edge_node_inner, param_positional_join, return_first, var_node_dedup, flow_records, graph_load_route, adjacency, reverse_adjacency, degree_centrality, dataflow_flags, cosine_topk,
        similarity_gate, semantic_blend, candidate_agg, candidate_top5, walks_2_3, walks_2_4, chain_summary, semantic_dedup, chain_cap, judge_prompt, chain_evidence, ranked_chains, run_statistics,
        trace_result, beta_likelihoods, chain_posterior, statistics_row, nodes_by_type, edges_by_type, metadata_rows,
    )
} | _resolvers

# ---------------------------------------------------------------- SQL twins

SP = "' ' || chr(9) || chr(10) || chr(13)"
#: Unicode white space for RE2.
WS = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(x: str) -> str:
    return f"(CASE WHEN starts_with({x}, 'Function:') THEN replace({x}, 'Function:', '') WHEN starts_with({x}, 'Method:') THEN replace({x}, 'Method:', '') ELSE coalesce({x}, '') END)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_T = lambda c: f"max(nullif(trim({c}, {SP}), '')) AS {c}"
FN = f"""fn0 AS (SELECT trim(id, {SP}) AS id, {_T('name')}, max(lower(trim(language, {SP}))) AS language, {_T('signature')}, {_T('file_path')}, {_T('summary')},
  max(CAST(embedding AS DOUBLE[])) FILTER (WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0) AS vector
  FROM graph_node WHERE type IN ('Function', 'Method') AND trim(id, {SP}) <> '' GROUP BY 1), fn AS (SELECT *, {_clean('id')} AS clean FROM fn0)"""
ER = f"""er AS (SELECT edge_id, trim(source_id, {SP}) AS src, trim(target_id, {SP}) AS dst, upper(trim(type, {SP})) AS type FROM graph_edge WHERE trim(source_id, {SP}) <> '' AND trim(target_id, {SP}) <> '')"""
CL = f"{ER}, cl AS (SELECT {_clean('src')} AS src, {_clean('dst')} AS dst, min(edge_id) AS ord FROM er WHERE type = 'CALLS' GROUP BY ALL)"
ND = f"nd AS (SELECT DISTINCT trim(id, {SP}) AS id FROM graph_node WHERE trim(id, {SP}) <> '')"
CC = "cc AS (SELECT src, dst, min(edge_id) AS ord FROM er WHERE type = 'CALLS' AND src IN (SELECT id FROM nd) AND dst IN (SELECT id FROM nd) GROUP BY ALL)"
PA = f"""pa AS (SELECT scope, param, row_number() OVER (PARTITION BY scope ORDER BY position NULLS FIRST, param) - 1 AS place FROM (SELECT trim(scope, {SP}) AS scope, trim(id, {SP}) AS param,
  min(CAST(raw_attributes['position'] AS INTEGER)) AS position FROM graph_node WHERE type = 'Parameter' AND scope IS NOT NULL AND trim(id, {SP}) <> '' GROUP BY ALL))"""
PF = "pf AS (SELECT a.param AS source_id, b.param AS target_id, a.place, cc.src, cc.dst FROM cc JOIN pa a ON a.scope = cc.src JOIN pa b ON b.scope = cc.dst AND b.place = a.place)"
RV = f"rv AS (SELECT trim(scope, {SP}) AS dst, trim(id, {SP}) AS rid, min(data_type) AS data_type FROM graph_node WHERE type = 'ReturnValue' AND scope IS NOT NULL AND trim(id, {SP}) <> '' GROUP BY ALL)"
RF = "rf AS (SELECT r.rid AS source_id, cc.src, cc.dst FROM cc JOIN (SELECT dst, min(rid) AS rid FROM rv GROUP BY ALL) r USING (dst))"
FL = f"{ND}, {CC}, {PA}, {PF}, {RV}, {RF}, fl AS (SELECT {_clean('src')} AS src, {_clean('dst')} AS dst, 'PARAMETER' AS type FROM pf UNION ALL SELECT {_clean('src')}, {_clean('dst')}, 'RETURN' FROM rf)"
PR = f"""pr AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{WS}*\\n'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM requirement_text)"""
_WORDS = f"list_filter(regexp_split_to_array(p, '{WS}+'), lambda w: w <> '')"
_WIN = f"list_transform(range(0, len({_WORDS}), 110), lambda s: array_to_string(list_slice({_WORDS}, s + 1, s + 120), ' '))"
CH = f"""{PR}, pk AS (SELECT doc_id, ps, 0 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM pr
 UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(cur) + length(p) > 600 THEN CASE WHEN length(p) > 600 THEN '' ELSE p END WHEN cur = '' THEN p ELSE cur || ' ' || p END,
 CASE WHEN length(cur) + length(p) > 600 THEN list_concat(CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END, CASE WHEN length(p) > 600 THEN {_WIN} ELSE CAST([] AS VARCHAR[]) END) ELSE done END
 FROM (SELECT *, ps[i + 1] AS p FROM pk WHERE i < len(ps))),
 ck AS (SELECT doc_id, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS cs FROM pk WHERE i = len(ps)),
 ch AS (SELECT doc_id, unnest(range(0, len(cs))) AS chunk_index, unnest(cs) AS text FROM ck WHERE len(cs) > 0)"""


def _score(label: str) -> str:
    found = f"nullif(regexp_extract(reply, '{label}{WS}*[:：]{WS}*([0-9]\\.[0-9]{{1,2}})', 1), '')"
    return f"CASE WHEN {found} IS NOT NULL THEN least(1.0, CAST({found} AS DOUBLE)) END"


def _reason(label: str) -> str:
    found = f"regexp_extract(reply, '(?s){label}{WS}*[:：]{WS}*(.+?)(?:\\n\\n|\\n[A-Z]|\\n?\\z)', 1)"
    return f"WHEN {found} <> '' THEN {_strip(f'regexp_replace({found}, {chr(39)}{WS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}"


SC = f"""s0 AS (SELECT reply_id, doc_id, reply, coalesce({_score('Overall Score')}, 0.5) AS o, coalesce({_score('Extensibility')}, {_score('Semantic Relevance')}, 0.5) AS semantic,
 coalesce({_score('Logical Coherence')}, {_score('Functional Completeness')}, {_score('Logical Completeness')}, 0.5) AS completeness, coalesce({_score('Dataflow Continuity')}, 0.5) AS dataflow,
 coalesce({_score('Implementation Efficiency')}, {_score('Call Rationality')}, 0.5) AS rationality, CASE {_reason('Judgment Reason')} {_reason('Reason')} {_reason('Analysis Conclusion')} ELSE 'No detailed reasoning' END AS reason
 FROM llm_reply WHERE reply IS NOT NULL AND reply <> ''),
 sc AS (SELECT *, CASE WHEN o = 0.5 AND (semantic <> 0.5 OR completeness <> 0.5 OR dataflow <> 0.5 OR rationality <> 0.5) THEN (semantic + completeness + dataflow + rationality) / 4 ELSE o END AS overall FROM s0)"""
QV = f"""qv AS (SELECT ch.doc_id, ch.chunk_index, fn.vector FROM ch JOIN (SELECT *, trim(node_id, {SP}) AS nid FROM knn_probe) p ON p.probe_no = (CAST(regexp_extract(ch.doc_id, '(\\d+)$', 1) AS BIGINT) * 7 + ch.chunk_index) % (SELECT count(*) FROM knn_probe) + 1
 JOIN fn ON fn.id = p.nid WHERE fn.vector IS NOT NULL)"""
TK = f"""{QV}, tk AS (SELECT * FROM (SELECT q.doc_id, q.chunk_index, f.clean AS fn, list_cosine_similarity(q.vector, f.vector) AS sim,
 row_number() OVER (PARTITION BY q.doc_id, q.chunk_index ORDER BY list_inner_product(q.vector, f.vector) DESC, f.clean) AS place FROM qv q, fn f WHERE f.vector IS NOT NULL) WHERE place <= 5)"""
#: Vectors of summaries (sv) and what a function's vector and summary have in common with a chunk.
SV = f"""sm AS (SELECT clean, max(summary) AS summary FROM fn WHERE summary IS NOT NULL GROUP BY clean), sv AS (SELECT sm.clean, f.vector FROM sm JOIN (SELECT *, trim(node_id, {SP}) AS nid FROM knn_probe) p
 ON p.probe_no = length(sm.summary) % (SELECT count(*) FROM knn_probe) + 1 JOIN fn f ON f.id = p.nid WHERE f.vector IS NOT NULL)"""
_BLEND = "least(1.0, greatest(0.0, CASE WHEN v > 0 AND s > 0 THEN 0.6 * v + 0.4 * s WHEN v > 0 THEN v WHEN s > 0 THEN s ELSE 0.0 END))"
HT = f"""{SV}, h0 AS (SELECT tk.*, tk.sim AS v, coalesce(list_cosine_similarity(qv.vector, sv.vector), 0.0) AS s FROM tk JOIN qv USING (doc_id, chunk_index) LEFT JOIN sv ON sv.clean = tk.fn),
 ht AS (SELECT doc_id, chunk_index, fn, place, {_BLEND} AS similarity, concat_ws(', ', CASE WHEN v > 0 THEN printf('vector %.3f', round(v + 1e-9, 3)) END, CASE WHEN s > 0 THEN printf('summary %.3f', round(s + 1e-9, 3)) END) AS detail FROM h0 WHERE {_BLEND} > 0.5)"""
CA = """ca AS (SELECT doc_id, fn, sum(similarity) AS total_score, count(*) AS chunk_count, max(similarity) AS best_similarity, arg_min(chunk_index, {'a': -similarity, 'b': chunk_index, 'c': place}) AS best_chunk_index,
 arg_min(detail, {'a': -similarity, 'b': chunk_index, 'c': place}) AS best_detail, min({'a': chunk_index, 'b': place}) AS first_seen FROM ht GROUP BY ALL)"""
LE = """l0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(total_score, 9) DESC, first_seen) AS rank FROM ca),
 l1 AS (SELECT *, max(best_similarity) OVER (PARTITION BY doc_id) AS hi FROM l0 WHERE rank <= 5),
 le AS (SELECT *, CASE WHEN hi >= 0.7 THEN CASE WHEN best_similarity >= 0.7 THEN 'full' WHEN best_similarity >= 0.6 THEN 'longest_only' ELSE 'simplified' END WHEN rank = 1 THEN 'full' WHEN rank = 2 THEN 'longest_only' ELSE 'simplified' END AS mode FROM l1)"""
_STEP = lambda a, b: f"{b} AS (SELECT {a}.doc_id, {a}.rank, {a}.mode, {a}.best_chunk_index, list_append({a}.chain, cl.dst) AS chain, list_append({a}.ord, cl.ord) AS ord FROM {a} JOIN cl ON cl.src = {_clean(f'{a}.chain[-1]')})"
WK = f"w1 AS (SELECT doc_id, rank, mode, best_chunk_index, [fn] AS chain, CAST([] AS BIGINT[]) AS ord FROM le), {_STEP('w1', 'w2')}, {_STEP('w2', 'w3')}, wk AS (SELECT * FROM w2 UNION ALL SELECT * FROM w3)"
_PREFIX = "|".join(text.SUMMARY_PREFIXES)
_CONCISE_WORDS = f"list_filter(regexp_split_to_array(c0, '{WS}+'), lambda w: w <> '')"
CO = f"""co0 AS (SELECT id, clean, regexp_replace({_strip('summary')}, '^(?i:{_PREFIX}){WS}*', '') AS c0 FROM fn WHERE summary IS NOT NULL),
 co AS (SELECT id, clean, trim(CASE WHEN contains(c0, ' ') AND len({_CONCISE_WORDS}) > 8 THEN array_to_string(list_slice({_CONCISE_WORDS}, 1, 8), ' ') || '...' ELSE c0 END, ' .,') AS part FROM co0)"""
_UTIL = "^(" + "|".join(text.UTILITY_VERBS) + ") "
TD = f"""{CO}, un AS (SELECT doc_id, rank, ord, unnest(chain) AS node, unnest(range(0, len(chain))) AS i FROM wk),
 pt AS (SELECT doc_id, rank, ord, list(part ORDER BY i) AS parts, list(node ORDER BY i) FILTER (NOT regexp_matches(lower(part), '{_UTIL}')) AS keys FROM un JOIN co ON co.clean = {_clean('un.node')} WHERE length(part) > 3 GROUP BY ALL),
 td0 AS (SELECT wk.*, coalesce(array_to_string(parts, ' → '), array_to_string(list_transform(chain, lambda x: {_clean('x')}), ' → ')) AS whole, coalesce(keys, CAST([] AS VARCHAR[])) AS key_nodes FROM wk LEFT JOIN pt USING (doc_id, rank, ord)),
 td AS (SELECT *, CASE WHEN length(whole) > 300 THEN left(whole, 297) || '...' ELSE whole END AS semantic_summary FROM td0)"""
DD = "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rank, md5(semantic_summary) ORDER BY ord) AS k FROM td WHERE length(semantic_summary) >= 10) WHERE k = 1)"
CP = "cp AS (SELECT * EXCLUDE (k2) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rank ORDER BY ord) AS k2 FROM dd) WHERE k2 <= CASE mode WHEN 'full' THEN 20 WHEN 'longest_only' THEN 10 ELSE 1 END)"
DG = """dg AS (SELECT fn, sum(o) AS out_degree, sum(i) AS in_degree, CASE WHEN (SELECT count(DISTINCT src) FROM cl) > 1 THEN least(1.0, (sum(o) + sum(i)) / (2 * least(10, (SELECT count(DISTINCT src) FROM cl) - 1))) ELSE 0.5 END AS centrality
 FROM (SELECT src AS fn, 1 AS o, 0 AS i FROM cl UNION ALL SELECT dst, 0, 1 FROM cl) GROUP BY fn)"""


def _beta(x: str, coefficient: int, formula: str) -> str:
    return f"greatest(1e-10, CASE WHEN {x} <= 0 OR {x} >= 1 THEN 1e-10 ELSE {coefficient} * {formula} END)"


B33 = lambda x: _beta(f"({x})", 30, f"({x}) * ({x}) * (1 - ({x})) * (1 - ({x}))")
B62 = lambda x: _beta(f"({x})", 42, f"pow(({x}), 5) * (1 - ({x}))")
B51 = lambda x: _beta(f"({x})", 5, f"pow(({x}), 4)")


def _prior(n: str, sim: str, judged: str, central: str) -> str:
    return f"""least(0.5, greatest(0.05, 0.05 + CASE WHEN {sim} >= 0.8 THEN {sim} * 0.6 WHEN {sim} >= 0.6 THEN {sim} * 0.4 WHEN {sim} >= 0.4 THEN {sim} * 0.2 ELSE 0 END
 + CASE WHEN {n} BETWEEN 3 AND 7 THEN 0.2 WHEN {n} > 7 THEN 0.1 ELSE 0 END + least({central} * 0.05, 0.15) + CASE WHEN {judged} >= 0.8 THEN {judged} * 0.5 WHEN {judged} >= 0.6 THEN {judged} * 0.3 ELSE 0 END))"""


def _posterior(prior: str, sim: str, structure: str, p: str = "") -> str:
    dims = f"pow({B51(p + 'semantic')}, 0.4) * pow({B51(p + 'completeness')}, 0.3) * pow({B51(p + 'dataflow')}, 0.2) * pow({B51(p + 'rationality')}, 0.1)"
    return f"""least(1.0, greatest(0.0, {prior} * ({B62(p + 'overall')} * {B33(sim)} * {B33(structure)} * 0.6 + {dims} * 0.4) * CASE WHEN {p}uncertainty > 0.1 THEN 1 - {p}uncertainty * 0.3 ELSE 1 END))"""


EV = f"""jd AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY reply_id) AS turn, overall, semantic, completeness, dataflow, rationality, reason FROM (SELECT r.reply_id, r.doc_id, overall, semantic, completeness, dataflow, rationality, reason FROM llm_reply r LEFT JOIN sc USING (reply_id))),
 tn AS (SELECT doc_id, rank, ord, row_number() OVER (PARTITION BY doc_id ORDER BY rank, ord) AS turn FROM cp),
 nn AS (SELECT doc_id, rank, ord, best_chunk_index, len(chain) AS n, unnest(chain) AS node, unnest(range(0, len(chain))) AS i FROM cp),
 n0 AS (SELECT d.*, coalesce(list_cosine_similarity(qv.vector, f.vector), 0.0) AS v, coalesce(list_cosine_similarity(qv.vector, sv.vector), 0.0) AS s
  FROM (SELECT DISTINCT doc_id, best_chunk_index AS chunk_index, {_clean('node')} AS fn FROM nn) d JOIN qv USING (doc_id, chunk_index) JOIN fn f ON f.clean = d.fn LEFT JOIN sv ON sv.clean = d.fn),
 nv AS (SELECT doc_id, chunk_index, fn, max({_BLEND}) AS sim FROM n0 GROUP BY ALL),
 ms AS (SELECT nn.doc_id, rank, ord, avg(coalesce(sim, 0.0)) AS similarity FROM nn LEFT JOIN nv h ON h.doc_id = nn.doc_id AND h.chunk_index = nn.best_chunk_index AND h.fn = {_clean('nn.node')} GROUP BY ALL),
 tp AS (SELECT doc_id, rank, ord, max(coalesce(centrality, 0.0)) AS hi, avg(coalesce(centrality, 0.0)) AS av, count_if(i > 0 AND i < n - 1 AND coalesce(in_degree, 0) > 0 AND coalesce(out_degree, 0) > 0) AS inner_n, count_if(coalesce(centrality, 0.0) >= 0.7) AS central FROM nn LEFT JOIN dg ON dg.fn = {_clean('nn.node')} GROUP BY ALL),
 pp AS (SELECT doc_id, rank, ord, len(chain) AS n, unnest(list_transform(range(1, len(chain)), lambda i: {_clean('chain[i]')})) AS src, unnest(list_transform(range(1, len(chain)), lambda i: {_clean('chain[i + 1]')})) AS dst FROM cp),
 mt AS (SELECT doc_id, rank, ord, max(n) AS n, sum(coalesce(f, 0)) AS f, sum(coalesce(pr, 0)) AS pr, sum(coalesce(c, 0)) AS c FROM pp LEFT JOIN (SELECT src, dst, count(*) AS f, 2 * count(*) AS pr FROM fl GROUP BY ALL) USING (src, dst) LEFT JOIN (SELECT src, dst, 1 AS c FROM cl) USING (src, dst) GROUP BY ALL),
 st AS (SELECT mt.doc_id, mt.rank, mt.ord, inner_n, central, least(1.0, (f / (n - 1) * 0.6 + pr / (n - 1) * 0.4) * 0.4 + (c / (n - 1) * 0.7 + CASE WHEN n >= 3 THEN least((n - 2) * 0.1, 0.2) ELSE 0 END * 0.3) * 0.3 + least((hi * 0.4 + av * 0.3 + least(inner_n * 0.1, 0.3) / 0.3 * 0.3) * 0.3, 0.3)) AS s0 FROM mt JOIN tp USING (doc_id, rank, ord)),
 e0 AS (SELECT cp.*, similarity, CAST(central AS BIGINT) AS central, CASE WHEN (SELECT count(*) FROM fl) > 0 THEN s0 END AS structure, coalesce(jd.overall, 0.5) AS overall, coalesce(jd.semantic, 0.5) AS semantic, coalesce(jd.completeness, 0.5) AS completeness,
  coalesce(jd.dataflow, 0.5) AS dataflow, coalesce(jd.rationality, 0.5) AS rationality, CASE WHEN jd.overall IS NULL THEN 0.3 ELSE 0.1 END AS uncertainty, coalesce(jd.reason, 'No judgment available') AS llm_reason, len(chain) AS n FROM cp JOIN ms USING (doc_id, rank, ord) JOIN st USING (doc_id, rank, ord) JOIN tn USING (doc_id, rank, ord) LEFT JOIN jd ON jd.doc_id = cp.doc_id AND jd.turn = tn.turn),
 e1 AS (SELECT *, {_prior('n', 'similarity', 'overall', 'central')} AS prior FROM (SELECT * FROM e0)),
 ev AS (SELECT *, {_posterior('prior', 'similarity', 'coalesce(structure, least(1.0, n / 8))')} AS posterior, overall AS judged FROM e1)"""
CS = """mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, md5(semantic_summary) ORDER BY rank, ord) AS k3 FROM ev) WHERE k3 = 1),
 q0 AS (SELECT *, posterior >= 0.4 AND judged >= 0.6 AND n >= 2 AS ok FROM mg), q1 AS (SELECT *, max(ok) OVER (PARTITION BY doc_id) AS any_ok FROM q0),
 q2 AS (SELECT *, round(least(n, 4) / 4 * 0.4 + posterior * 0.3 + judged * 0.2 + similarity * 0.1, 12) AS choice FROM q1 WHERE ok OR NOT any_ok),
 q3 AS (SELECT *, row_number() OVER w AS place, lead(posterior) OVER w AS np, lead(n) OVER w AS nl FROM q2 WINDOW w AS (PARTITION BY doc_id ORDER BY choice DESC, round(posterior, 12) DESC, rank, ord)),
 cs AS (SELECT *, concat_ws('; ', printf('length %d is ', n) || CASE WHEN n >= 4 THEN 'full' WHEN n >= 3 THEN 'medium' ELSE 'short' END,
  printf('posterior %.3f is ', round(posterior + 1e-9, 3)) || CASE WHEN posterior >= 0.7 THEN 'strong' WHEN posterior >= 0.5 THEN 'fair' END, printf('judged %.3f is ', round(judged + 1e-9, 3)) || CASE WHEN judged >= 0.8 THEN 'strong' WHEN judged >= 0.6 THEN 'fair' END,
  CASE WHEN posterior - np > 0.1 THEN printf('posterior leads by %.3f', round(posterior - np + 1e-9, 3)) END, CASE WHEN n > nl THEN printf('nodes more than the next: %d', n - nl) END) AS reason,
  CASE WHEN posterior >= 0.8 THEN 'High Confidence' WHEN posterior >= 0.6 THEN 'Medium Confidence' WHEN posterior >= 0.4 THEN 'Low Confidence' ELSE 'Very Low Confidence' END AS confidence FROM q3)"""
_RETRIEVE = f"WITH RECURSIVE {FN}, {CH}, {TK}, {HT}"
_LEAD = f"{_RETRIEVE}, {CA}, {LE}"
_WALK = f"{_LEAD}, {CL}, {WK}"
_TOLD = f"{_WALK}, {TD}"
_EVID = f"{_TOLD}, {DD}, {CP}, {FL}, {DG}, {SC}, {EV}"
_CHOSEN = f"{_EVID}, {CS}"
_J = "array_to_string(chain, '->') AS chain"


def _rate(x: str, a: float, b: float) -> str:
    return f"CASE WHEN {x} >= {a} THEN 'Excellent' WHEN {x} >= {b} THEN 'Good' ELSE 'Average' END"


def _line(name: str, value: str, word: str) -> str:
    return f"rpad('{name}', 20, ' ') || rpad({value}, 10, ' ') || rpad({word}, 10, ' ')"


_REPORT = " || chr(10) || ".join(
    (
        "repeat('=', 80)", "'Requirement tracing report'", "repeat('=', 80)", "'1. Requirement'", "left(f.text, 200) || '...'", "'2. Chosen chain'", "semantic_summary", "printf('%d functions: ', cs.n) || array_to_string(chain, ' → ')", "'3. Scores'",
        _line("Dimension", "'Score'", "'Rating'"), _line("Posterior", "printf('%.4f', round(posterior + 1e-9, 4))", _rate("posterior", 0.7, 0.5)), _line("Judged", "printf('%.3f', round(judged + 1e-9, 3))", _rate("judged", 0.8, 0.6)), _line("Similarity", "printf('%.3f', round(similarity + 1e-9, 3))", _rate("similarity", 0.7, 0.5)),
        _line("Length", "CAST(cs.n AS VARCHAR)", "CASE WHEN cs.n >= 4 THEN 'Complete' WHEN cs.n >= 3 THEN 'Moderate' ELSE 'Short' END"), "'4. Judgment'", "llm_reason", "'5. Confidence'", "confidence", "'6. Why'", "cs.reason", "repeat('=', 80)",
    )
)


def _resolve_sql(language: str, sep: str) -> str:
    parts = f"string_split(caller_key, '{sep}')"
    simple = f"CASE WHEN len({parts}) > 1 THEN {parts}[-2] END"
    head = f"CASE WHEN len({parts}) > 1 THEN array_to_string({parts}[:-2], '{sep}') END"
    outer = f"CASE WHEN len({parts}) > 2 THEN array_to_string({parts}[:-3], '{sep}') END"
    last = f"string_split(key, '{sep}')[-1]"
    fuzzy = f"length(callee) >= 4 AND ({last} = callee OR ends_with({last}, '_' || callee)" + (f" OR ends_with({last}, '$' || callee))" if language == "java" else ")")
    three = f"ends_with(key, '{sep}' || callee)" + (" OR key = callee" if language == "javascript" else "")
    if language == "java":
        exact = f"WHEN contains(head, '.') AND key = head || '.' || callee THEN 1 WHEN key = simple || '.' || callee THEN 2"
    elif language == "cpp":
        exact = f"WHEN key = simple || '::' || callee THEN 1 WHEN key = outr || '::' || callee THEN 2"
    else:
        exact = f"WHEN contains(callee, '.') AND simple <> '' AND key = callee THEN 0 WHEN key = simple || '.' || callee THEN 1 WHEN key = outr || '.' || callee THEN 2"
    return f"""WITH {FN}, {CL}, f AS (SELECT * FROM fn WHERE language = '{language}'), sym AS (SELECT clean AS key, min(id) AS key_ord, max(id) AS node_id FROM f GROUP BY ALL),
 fa AS (SELECT DISTINCT src AS caller_key, string_split(dst, '{sep}')[-1] AS callee FROM cl WHERE src IN (SELECT clean FROM f)), fb AS (SELECT *, {simple} AS simple, {head} AS head, {outer} AS outr FROM fa),
 m AS (SELECT caller_key, callee, node_id, key_ord, CASE {exact} WHEN {three} THEN 3 WHEN {fuzzy} THEN 4 END AS rule FROM fb, sym WHERE contains(key, callee))
 SELECT caller_key, callee, arg_min(node_id, {{'a': rule, 'b': key_ord}}) AS node_id, CAST(min(rule) AS INTEGER) AS rule FROM m WHERE rule IS NOT NULL GROUP BY ALL"""


_IGNORED = "[" + ", ".join(f"'{x}'" for x in text.IGNORED_DIRS) + "]"
_LANG = "CASE " + " ".join(f"WHEN regexp_extract(lower(path), '(\\.[^./]+)$', 1) IN ({', '.join(repr(s) for s in ss)}) THEN '{k}'" for k, ss in text.LANGUAGES.items()) + " END"
_LABELS = "'Overall Score: 0.00', 'Semantic Relevance: 0.00', 'Logical Completeness: 0.00', 'Dataflow Continuity: 0.00', 'Call Rationality: 0.00', 'Judgment Reason: ...'"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
SQL = {
    "tree_filter_counts": f"SELECT {_LANG} AS language, list_has_any(list_slice(string_split(path, '/'), 2, len(string_split(path, '/')) - 1), {_IGNORED}) AS ignored, count(DISTINCT path) AS files FROM source_file GROUP BY ALL",
    "clean_func_ids": f"SELECT DISTINCT trim(id, {SP}) AS id, {_clean(f'trim(id, {SP})')} AS clean FROM graph_node WHERE type IN ('Function', 'Method') AND trim(id, {SP}) <> ''",
    "summary_keywords": f"WITH {FN} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)))), ' ') AS keywords FROM fn WHERE summary IS NOT NULL",
    "keyword_union": f"""WITH {FN}, w AS (SELECT id, regexp_extract_all(lower(coalesce(summary, '') || ' ' || coalesce(signature, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM fn)
 SELECT id, array_to_string(list_sort(list_distinct(list_filter(ws, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)))), ' ') AS keywords FROM w""",
    "concise_info": f"WITH {FN}, {CO} SELECT id, part AS concise, regexp_matches(lower(part), '{_UTIL}') AS utility FROM co",
    "paragraph_split": f"WITH {PR} SELECT doc_id, len(ps) AS paragraphs, array_to_string(ps, '|') AS joined FROM pr",
    "greedy_pack": f"WITH RECURSIVE {CH} SELECT doc_id, chunk_index, text FROM ch",
    "word_windows": f"WITH w AS (SELECT doc_id, {_WIN.replace('(p,', '(text,')} AS ws FROM requirement_text) SELECT doc_id, unnest(range(0, len(ws))) AS n, unnest(ws) AS window FROM w WHERE len(ws) > 0",
    "template_summary": f"""WITH {FN} SELECT id, CASE WHEN coalesce({_strip('signature')}, '') = '' THEN 'No code to describe.' ELSE concat_ws(chr(10), 'Name: ' || name, 'Language: ' || language,
 'First line: ' || left(string_split({_strip('signature')}, chr(10))[1], 120), 'Signature: ' || signature, 'Written without a model.') END AS made FROM fn""",
    "parse_scores": f"WITH {SC} SELECT r.reply_id, round(overall, 6) AS overall, round(semantic, 6) AS semantic, round(completeness, 6) AS completeness, round(dataflow, 6) AS dataflow, round(rationality, 6) AS rationality, reason FROM llm_reply r LEFT JOIN sc USING (reply_id)",
    "resolve_java": _resolve_sql("java", "."),
    "resolve_javascript": _resolve_sql("javascript", "."),
    "resolve_cpp": _resolve_sql("cpp", "::"),
    "resolve_contains": f"""WITH {FN}, {CL}, sym AS (SELECT clean AS key, min(id) AS key_ord, max(id) AS node_id FROM fn GROUP BY ALL), fa AS (SELECT DISTINCT regexp_split_to_array(dst, '::|\\.')[-1] AS callee FROM cl)
 SELECT callee, arg_min(node_id, key_ord) AS node_id FROM fa, sym WHERE callee <> '' AND contains(key, callee) GROUP BY ALL""",
    "call_edge_dedup": f"WITH {CL} SELECT * FROM cl",
    "edge_node_inner": f"WITH {ER}, {ND}, {CC} SELECT * FROM cc",
    "param_positional_join": f"WITH {ER}, {ND}, {CC}, {PA}, {PF} SELECT source_id, target_id, place, src || '->' || dst AS call_edge_id FROM pf",
    "return_first": f"WITH {ER}, {ND}, {CC}, {RV}, {RF} SELECT source_id, 'Var:' || src || '.return_value' AS target_id, src || '->' || dst AS call_edge_id FROM rf",
    "var_node_dedup": f"""WITH {ER}, {ND}, {CC}, {RV}, k AS (SELECT dst, arg_min(data_type, rid) AS data_type FROM rv GROUP BY ALL)
 SELECT 'Var:' || src || '.return_value' AS id, src AS scope, arg_min(data_type, {{'a': ord, 'b': cc.dst}}) AS data_type FROM cc JOIN k USING (dst) GROUP BY src""",
    "flow_records": f"WITH {ER}, {FL} SELECT type, count(*) AS records FROM fl GROUP BY ALL",
    "graph_load_route": f"WITH {ER} SELECT CASE WHEN type = 'CALLS' THEN 'calls' WHEN type IN ('DATAFLOW', 'PARAMETER', 'RETURN') THEN 'flow' ELSE 'other' END AS route, count(*) AS edges, count(DISTINCT (src, dst)) AS pairs FROM er GROUP BY ALL",
    "adjacency": f"WITH {CL} SELECT src, string_agg(dst, ' ' ORDER BY ord, dst) AS callees, count(*) AS n FROM cl GROUP BY ALL",
    "reverse_adjacency": f"WITH {CL} SELECT dst AS src, count(*) AS callers, arg_min(src, {{'a': ord, 'b': src}}) AS first_caller, arg_max(src, {{'a': ord, 'b': src}}) AS last_caller FROM cl GROUP BY dst",
    "degree_centrality": f"WITH {CL}, {DG} SELECT fn, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree AS BIGINT) AS in_degree, round(centrality, 6) AS centrality FROM dg",
    "dataflow_flags": f"WITH {ER}, {FL} SELECT src, bool_or(type = 'PARAMETER') AS has_params, bool_or(type = 'RETURN') AS has_returns, count(*) AS flows FROM fl GROUP BY ALL",
    "cosine_topk": f"{_RETRIEVE} SELECT doc_id, chunk_index, fn, place, round(sim, 6) AS vector_similarity FROM tk",
    "similarity_gate": f"{_RETRIEVE} SELECT doc_id, chunk_index, fn, round(similarity, 6) AS similarity, detail FROM ht",
    "semantic_blend": f"""WITH {SC} SELECT reply_id, round(least(1.0, greatest(0.0, CASE WHEN semantic > 0.5 AND dataflow > 0.5 THEN 0.6 * (semantic - 0.5) + 0.4 * (dataflow - 0.5) WHEN semantic > 0.5 THEN semantic - 0.5
 WHEN dataflow > 0.5 THEN dataflow - 0.5 ELSE 0 END)), 6) AS similarity, semantic > 0.5 AND dataflow > 0.5 AS both FROM sc""",
    "candidate_agg": f"{_RETRIEVE}, {CA} SELECT doc_id, fn, round(total_score, 6) AS total_score, chunk_count, round(best_similarity, 6) AS best_similarity, best_chunk_index, best_detail FROM ca",
    "candidate_top5": f"{_LEAD} SELECT doc_id, rank, fn, mode FROM le",
    "walks_2_3": f"{_WALK} SELECT doc_id, rank, {_J}, array_to_string(ord, '->') AS ord FROM wk",
    "walks_2_4": f"{_WALK}, {_STEP('w3', 'w4')} SELECT doc_id, len(chain) AS nodes, count(*) AS walks FROM (SELECT * FROM wk UNION ALL SELECT * FROM w4) GROUP BY ALL",
    "chain_summary": f"{_TOLD} SELECT doc_id, rank, {_J}, semantic_summary, array_to_string(key_nodes, ' ') AS key_nodes FROM td",
    "semantic_dedup": f"{_TOLD}, {DD} SELECT doc_id, rank, {_J} FROM dd",
    "chain_cap": f"{_TOLD}, {DD}, {CP} SELECT doc_id, rank, {_J}, mode FROM cp",
    "judge_prompt": f"""{_TOLD}, {DD}, {CP}, kn AS (SELECT doc_id, rank, ord, unnest(list_slice(key_nodes, 1, 5)) AS node, unnest(range(0, len(list_slice(key_nodes, 1, 5)))) AS i FROM cp),
 dt AS (SELECT doc_id, rank, ord, list(node || ': ' || summary ORDER BY i) AS ds FROM kn JOIN sm ON sm.clean = {_clean('kn.node')} GROUP BY ALL)
 SELECT cp.doc_id, cp.rank, array_to_string(cp.ord, '->') AS ord, concat_ws(chr(10) || chr(10), 'Does this chain of calls carry out the requirement?' || chr(10) || 'Requirement: ' || left(ch.text, 500), 'Chain: ' || semantic_summary,
 'Its main functions:' || chr(10) || array_to_string(list_transform(list_slice(ds, 1, 4), lambda x: '* ' || left(x, 100)), chr(10)), 'Answer with numbers from 0 to 1, one a line:' || chr(10) || array_to_string([{_LABELS}], chr(10))) AS prompt
 FROM cp JOIN ch ON ch.doc_id = cp.doc_id AND ch.chunk_index = cp.best_chunk_index LEFT JOIN dt ON dt.doc_id = cp.doc_id AND dt.rank = cp.rank AND dt.ord = cp.ord""",
    "chain_evidence": f"{_EVID} SELECT doc_id, rank, {_J}, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUMBERS) + ", central FROM ev",
    "ranked_chains": f"{_CHOSEN} SELECT doc_id, place, {_J}, round(choice, 6) AS choice, reason, confidence FROM cs WHERE place <= 4",
    "run_statistics": f"""{_TOLD}, {DD}, {CP} SELECT doc_id, count(*) AS total_chains_found, (SELECT count(*) FROM dd WHERE dd.doc_id = td.doc_id) AS unique_chains_analyzed, (SELECT count(*) FROM cp WHERE cp.doc_id = td.doc_id) AS total_llm_judgments FROM td GROUP BY doc_id""",
    "trace_result": f"""{_CHOSEN}, al AS (SELECT doc_id, string_agg(array_to_string(chain, '->'), '; ' ORDER BY place) AS alternatives FROM cs WHERE place BETWEEN 2 AND 4 GROUP BY ALL)
 SELECT f.doc_id, (SELECT count(*) FROM ch WHERE ch.doc_id = f.doc_id) AS total_chunks, coalesce(k.n, 0) AS total_candidates, least(coalesce(k.n, 0), 5) AS analyzed_candidates, array_to_string(chain, '->') AS chain, semantic_summary, round(posterior, 6) AS posterior, round(judged, 6) AS summary_score,
 coalesce(cs.reason, CASE WHEN k.n IS NULL THEN 'No candidate functions' ELSE 'No available call chains' END) AS selection_reason, coalesce({_REPORT}, 'No relevant call chain found') AS report, coalesce(alternatives, '') AS alternatives
 FROM ch f LEFT JOIN (SELECT doc_id, count(*) AS n FROM ca GROUP BY ALL) k ON k.doc_id = f.doc_id LEFT JOIN cs ON cs.doc_id = f.doc_id AND cs.place = 1 LEFT JOIN al ON al.doc_id = f.doc_id WHERE f.chunk_index = 0""",
    "beta_likelihoods": f"WITH {SC} SELECT reply_id, round({B33('overall')}, 6) AS b33, round({B62('overall')}, 6) AS b62, round({B51('overall')}, 6) AS b51, round(1 / (1 + exp(-overall)), 6) AS sig FROM sc",
    "chain_posterior": f"""WITH {SC}, a AS (SELECT *, 2 + reply_id % 3 AS n, 0.1 AS uncertainty, {_prior('(2 + reply_id % 3)', 'semantic', 'overall', '(reply_id % 5)')} AS prior FROM sc), b AS (SELECT *, {_posterior('prior', 'semantic', 'least(1.0, n / 8)')} AS posterior FROM a)
 SELECT reply_id, round(prior, 6) AS prior, round(posterior, 6) AS posterior, CASE WHEN posterior >= 0.8 THEN 'High Confidence' WHEN posterior >= 0.6 THEN 'Medium Confidence' WHEN posterior >= 0.4 THEN 'Low Confidence' ELSE 'Very Low Confidence' END AS confidence,
 round(least(n, 4) / 4 * 0.4 + posterior * 0.3 + overall * 0.2 + semantic * 0.1, 6) AS choice FROM b""",
    "statistics_row": f"""WITH {CL} SELECT count(DISTINCT edge_id) AS total_edges, (SELECT count(DISTINCT trim(id, {SP})) FROM graph_node WHERE trim(id, {SP}) <> '') AS total_nodes,
 (SELECT count(DISTINCT trim(id, {SP})) FROM graph_node WHERE type IN ('Function', 'Method') AND trim(id, {SP}) <> '') AS function_count, (SELECT count(DISTINCT src) FROM cl) AS call_relations_count, (SELECT count(DISTINCT path) FROM source_file) AS files FROM graph_edge""",
    "nodes_by_type": f"SELECT type, count(*) AS rows, count(DISTINCT nullif(trim(id, {SP}), '')) AS ids FROM graph_node GROUP BY ALL",
    "edges_by_type": f"SELECT upper(trim(type, {SP})) AS type, count(*) AS rows, count(DISTINCT edge_id) AS edges FROM graph_edge GROUP BY ALL",
    "metadata_rows": f"WITH {FN} SELECT id, clean, coalesce(summary, signature, name, '') AS text, coalesce(file_path, 'Unknown') AS file_path, coalesce(language, 'unknown') AS language, vector IS NOT NULL AS embedded FROM fn",
}
