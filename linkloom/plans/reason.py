"""Requirement tracing from chunks to the chosen call chain of each document, one lazy plan for a batch of requirements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scoring, text
from ..operators import chains, graph, retrieve
from ..runtime import cut

KEY_NODES, REQUIREMENT = 5, 500  # what a judge sees: key nodes with their summaries, characters of the requirement
Embedder = Callable[[DataFrame, str], DataFrame]
Judge = Callable[[DataFrame], DataFrame]


def requirement_chunks(requirements: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text)."""
    return requirements.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_index", "text"))


def with_summary_similarity(rows: DataFrame, vectors: DataFrame, functions: DataFrame, embedder: Embedder | None) -> DataFrame:
    """``rows`` (doc_id, chunk_index, fn, ..) with summary_similarity: the cosine of the chunk's vector and that of the
    function's summary; 0 without summary or embedder."""
    if embedder is None:
        return rows.withColumn("summary_similarity", F.lit(0.0))
    told = functions.where("summary is not null").groupBy(F.col("clean").alias("fn")).agg(F.max("summary").alias("__summary"))
    spoken = embedder(rows.select("fn").distinct().join(told, "fn"), "__summary").select("fn", F.col("embedding").alias("__told"))
    asked = vectors.select("doc_id", "chunk_index", F.col("vector").alias("__chunk"))
    met = rows.join(spoken, "fn", "left").join(asked, ["doc_id", "chunk_index"], "left")
    return met.withColumn("summary_similarity", scoring.cosine(F.col("__told"), F.col("__chunk"))).drop("__told", "__chunk")


def node_similarities(asked: DataFrame, vectors: DataFrame, functions: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(doc_id, chunk_index, fn, similarity) of each distinct (doc_id, chunk_index, fn), ungated; functions that are not known are left out."""
    rows = asked.select("doc_id", "chunk_index", "fn").distinct()
    known = functions.select(F.col("clean").alias("fn"), F.col("vector").alias("__vector"))
    met = rows.join(known, "fn").join(vectors.select("doc_id", "chunk_index", F.col("vector").alias("__chunk")), ["doc_id", "chunk_index"])
    met = with_summary_similarity(met.withColumn("vector_similarity", scoring.cosine(F.col("__vector"), F.col("__chunk"))).drop("__vector", "__chunk"), vectors, functions, embedder)
    value = scoring.blend(F.col("vector_similarity"), F.col("summary_similarity"))
    return met.groupBy("doc_id", "chunk_index", "fn").agg(F.max(value).alias("similarity"))


def judge_inputs(kept: DataFrame, chunks: DataFrame, functions: DataFrame) -> DataFrame:
    """What a judge is told of each chain: (doc_id, rank, ord, requirement, semantic_summary, key_nodes, node_details).

    The requirement is the candidate's best chunk, cut at 500 characters; node_details are the summaries of the first five
    key nodes that have one, each after its node.
    """
    key = ["doc_id", "rank", "ord"]
    told = functions.where("summary is not null").groupBy(F.col("clean").alias("__fn")).agg(F.max("summary").alias("__summary"))
    nodes = kept.select(*key, F.posexplode(F.slice("key_nodes", 1, KEY_NODES)).alias("__pos", "__node")).withColumn("__fn", text.clean_func_id(F.col("__node")))
    line = F.struct("__pos", F.concat_ws(": ", "__node", "__summary").alias("line"))
    details = nodes.join(told, "__fn").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("node_details"))
    asked = chunks.select("doc_id", F.col("chunk_index").alias("best_chunk_index"), F.left("text", F.lit(REQUIREMENT)).alias("requirement"))
    rows = kept.join(asked, ["doc_id", "best_chunk_index"], "left").join(details, key, "left")
    return rows.select(*key, "requirement", "semantic_summary", "key_nodes", F.coalesce("node_details", F.array().cast("array<string>")).alias("node_details"))


def evidence(leaders: DataFrame, functions: DataFrame, call: DataFrame, flow: DataFrame, vectors: DataFrame, chunks: DataFrame | None = None, judge: Judge | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Scored chains of the leading candidates: chain, semantic_summary, similarity, judged, prior, posterior and what led there.

    The similarity of a chain is the mean over all of its nodes of their similarity to the candidate's best chunk, whose
    vector is in ``vectors``; a node that is not in ``functions`` counts as 0. With an ``embedder`` it blends in that of the
    summary. judge: gives ``scores``, the struct of ``text.parse_reply``, to rows of ``judge_inputs``, such as
    ``providers.judge`` with a model; it sees a chain only after equal summaries are gone and the cap of its mode is applied,
    and its requirements come from ``chunks`` (doc_id, chunk_index, text). What has no scores gets the neutral ones.
    """
    key = ["doc_id", "rank", "ord"]
    found = chains.walks(leaders.select("doc_id", "rank", "fn", "mode", "best_chunk_index"), call)
    told = chains.summarized(found, functions, key)
    # judged chains are read by several joins and by the judge: they are written once, so that no model is asked twice
    kept = cut(chains.capped(chains.distinct_summaries(told, ["doc_id", "rank"], ["ord"]), ["doc_id", "rank"]))
    nodes = kept.select(*key, "best_chunk_index", F.explode("chain").alias("__node")).withColumn("__fn", text.clean_func_id(F.col("__node")))
    met = node_similarities(nodes.select("doc_id", F.col("best_chunk_index").alias("chunk_index"), F.col("__fn").alias("fn")), vectors, functions, embedder)
    near = met.select("doc_id", F.col("chunk_index").alias("best_chunk_index"), F.col("fn").alias("__fn"), F.col("similarity").alias("__sim"))
    means = nodes.join(near, ["doc_id", "best_chunk_index", "__fn"], "left").groupBy(*key).agg(F.avg(F.coalesce("__sim", F.lit(0.0))).alias("similarity"))
    shape = chains.structure(kept, call, flow, graph.degrees(call), key)
    rows = kept.join(means, key).join(shape, key)
    if judge is None:
        rows = rows.withColumn("scores", text.neutral_scores())
    else:
        judgments = cut(judge(judge_inputs(kept, chunks, functions)).select(*key, "scores"))
        rows = rows.join(judgments, key, "left").withColumn("scores", F.coalesce("scores", text.neutral_scores()))
    length = F.size("chain")
    rows = rows.withColumn("judged", F.col("scores.overall"))
    rows = rows.withColumn("prior", scoring.prior(length, F.col("similarity"), F.col("judged"), F.col("central")))
    shape_score = F.coalesce("structure", scoring.initial_structure(length))
    return rows.withColumn("posterior", scoring.posterior(F.col("prior"), F.col("similarity"), shape_score, F.col("scores")))


def merged(rows: DataFrame) -> DataFrame:
    """Evidence of a document without equal summaries, the earliest candidate's first."""
    w = W.partitionBy("doc_id", F.substring(F.md5("semantic_summary"), 1, 16)).orderBy("rank", "ord")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def report(chosen: DataFrame, first_chunks: DataFrame) -> DataFrame:
    """(doc_id, report): a readable account of the chosen chain; the requirement is shown by its first chunk, cut at 200."""
    rows = chosen.where("place = 1").join(first_chunks, "doc_id")
    p, j, s, n = F.col("posterior"), F.col("judged"), F.col("similarity"), F.size("chain")
    line = lambda name, value, word: F.format_string("%-20s%-10s%-10s", F.lit(name), value, word)
    rule = F.lit("=" * 80)
    body = F.concat_ws(
        "\n", rule, F.lit("Requirement tracing report"), rule, F.lit("1. Requirement"), F.concat(F.left("text", F.lit(200)), F.lit("...")), F.lit("2. Chosen chain"), F.col("semantic_summary"),
        F.format_string("%d functions: %s", n, F.array_join("chain", text.ARROW)), F.lit("3. Scores"), line("Dimension", F.lit("Score"), F.lit("Rating")),
        line("Posterior", scoring.shown(p, 4), scoring.rating(p, 0.7, 0.5)), line("Judged", scoring.shown(j, 3), scoring.rating(j, 0.8, 0.6)),
        line("Similarity", scoring.shown(s, 3), scoring.rating(s, 0.7, 0.5)), line("Length", n.cast("string"), F.when(n >= 4, "Complete").when(n >= 3, "Moderate").otherwise("Short")),
        F.lit("4. Judgment"), F.col("scores.reason"), F.lit("5. Confidence"), scoring.confidence(p), F.lit("6. Why"), F.col("reason"), rule,
    )
    return rows.select("doc_id", body.alias("report"))


def reason(requirements: DataFrame, vectors: DataFrame, functions: DataFrame, call: DataFrame, flow: DataFrame, gate: float = scoring.GATE, judge: Judge | None = None, embedder: Embedder | None = None) -> DataFrame:
    """The result of each requirement: counts, the chosen chain with its scores and report, and up to three alternatives.

    vectors: (doc_id, chunk_index, vector) of an embedder. Documents without candidate or chain come out with empty fields.
    judge: asked for each chain, see ``evidence``. embedder: gives ``embedding`` to rows by a column of texts, as
    ``providers.embed`` with the model of ``vectors``; without one summaries have no similarity.
    """
    parts = requirement_chunks(requirements)
    hits = retrieve.top_products(vectors, functions)
    hits = cut(retrieve.gated(with_summary_similarity(hits, vectors, functions, embedder), gate))
    found = retrieve.candidates(hits)
    leaders = retrieve.leading(found)
    rows = evidence(leaders, functions, call, flow, vectors, parts, judge, embedder)
    chosen = cut(chains.choose(merged(rows)))
    best = chosen.where("place = 1").select("doc_id", F.array_join("chain", "->").alias("chain"), "semantic_summary", "posterior", F.col("judged").alias("summary_score"), F.col("reason").alias("selection_reason"))
    others = chosen.where("place between 2 and 4").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.array_join("chain", "->").alias("chain")))), lambda x: x["chain"]).alias("alternatives"))
    totals = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_candidates"))
    text_of = report(chosen, parts.where("chunk_index = 0").select("doc_id", "text"))
    joined = totals.join(counts, "doc_id", "left").join(best, "doc_id", "left").join(others, "doc_id", "left").join(text_of, "doc_id", "left")
    return joined.select(
        "doc_id", "total_chunks", F.coalesce("total_candidates", F.lit(0)).alias("total_candidates"), F.least(F.coalesce("total_candidates", F.lit(0)), F.lit(retrieve.CANDIDATES)).alias("analyzed_candidates"),
        "chain", "semantic_summary", F.round("posterior", 6).alias("posterior"), F.round("summary_score", 6).alias("summary_score"),
        F.coalesce("selection_reason", F.when(F.col("total_candidates").isNull(), "No candidate functions").otherwise("No available call chains")).alias("selection_reason"),
        F.coalesce("report", F.lit("No relevant call chain found")).alias("report"), F.array_join(F.coalesce("alternatives", F.array().cast("array<string>")), "; ").alias("alternatives"),
    )
