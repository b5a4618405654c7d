import math
from functools import partial

import pytest
from pyspark.sql import functions as F

from linkloom import providers
from linkloom.functions import text
from linkloom.operators import chains, graph, retrieve
from linkloom.plans import reason as R


def unit(cosine):
    return [cosine, math.sqrt(1 - cosine * cosine)]


@pytest.fixture(scope="module")
def world(spark):
    """Chunk r/0 points to (1, 0). a calls b and c, b calls c, c calls an unknown function; only a is similar enough to be a hit."""
    told = {"a": (unit(0.9), "reads the page slowly"), "b": (unit(0.4), "turns the rusty crank"), "c": (unit(0.3), "winds the long rope")}
    functions = spark.createDataFrame([(f"Function:{k}", k, v, s) for k, (v, s) in told.items()], "id string, clean string, vector array<float>, summary string")
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "gone")]
    call = graph.calls(spark.createDataFrame([(i, f"Function:{x}", f"Function:{y}", "CALLS") for i, (x, y) in enumerate(pairs)], "edge_id long, source_id string, target_id string, type string"))
    flow = spark.createDataFrame([], "src string, dst string, type string")
    requirements = spark.createDataFrame([("r", "Read the page.")], "doc_id string, text string")
    vectors = spark.createDataFrame([("r", 0, [1.0, 0.0])], "doc_id string, chunk_index int, vector array<float>")
    return {"requirements": requirements, "vectors": vectors, "functions": functions, "call": call, "flow": flow}


def leaders_and(world, hits):
    return retrieve.leading(retrieve.candidates(hits)), world["functions"], world["call"], world["flow"], world["vectors"]


def chains_of(world, hits):
    found = chains.walks(leaders_and(world, hits)[0].select("doc_id", "rank", "fn", "mode", "best_chunk_index"), world["call"])
    return chains.distinct_summaries(chains.summarized(found, world["functions"], ["doc_id", "rank", "ord"]), ["doc_id", "rank"], ["ord"])


def rows_of(world, hits, **more):
    rows = R.evidence(*leaders_and(world, hits), **more).collect()
    return {"".join(r["chain"]): r for r in rows}


def hits_of(world):
    return retrieve.gated(retrieve.top_products(world["vectors"], world["functions"]).withColumn("summary_similarity", F.lit(0.0)))


def test_every_known_node_of_a_chain_is_compared_with_the_chunk(world):
    hits = hits_of(world)
    assert [r["fn"] for r in hits.collect()] == ["a"]
    got = {k: round(r["similarity"], 5) for k, r in rows_of(world, hits).items()}
    assert got == {"ab": 0.65, "abc": 0.53333, "ac": 0.6}
    best = R.reason(**world).first()
    assert best["chain"] == "a->b->c" and "Similarity          0.533" in best["report"]


def test_each_chain_has_a_judgment_of_its_own(world):
    hits = hits_of(world)
    reply = lambda p: p["semantic_summary"].map(lambda x: "Overall Score: 0.9" if "rope" in x and "crank" in x else "Overall Score: 0.2")
    seen = providers.judge(R.judge_inputs(R.cut(chains_of(world, hits)), R.requirement_chunks(world["requirements"]), world["functions"]), reply).collect()
    assert {r["requirement"] for r in seen} == {"Read the page."} and all(r["node_details"] for r in seen)
    got = {k: r["judged"] for k, r in rows_of(world, hits, chunks=R.requirement_chunks(world["requirements"]), judge=partial(providers.judge, model=reply)).items()}
    assert got == {"ab": 0.2, "abc": 0.9, "ac": 0.2}
    given = lambda rows: rows.select("doc_id", "rank", "ord", text.neutral_scores().withField("overall", F.when(F.size("ord") == 2, 0.8).otherwise(0.1)).alias("scores"))
    assert {k: r["judged"] for k, r in rows_of(world, hits, chunks=R.requirement_chunks(world["requirements"]), judge=given).items()} == {"ab": 0.1, "abc": 0.8, "ac": 0.1}
    assert R.reason(**world, judge=partial(providers.judge, model=reply)).first()["summary_score"] == 0.9


def test_summaries_are_embedded_and_blended(spark, world):
    near = {"turns the rusty crank": unit(0.8), "winds the long rope": unit(0.2)}
    embedder = partial(providers.embed, width=2, model=lambda t: [near.get(x, [0.0, 0.0]) for x in t])
    asked = retrieve.top_products(world["vectors"], world["functions"])
    hits = retrieve.gated(R.with_summary_similarity(asked, world["vectors"], world["functions"], embedder))
    assert {r["fn"]: (round(r["similarity"], 5), r["detail"]) for r in hits.collect()} == {"a": (0.9, "vector 0.900"), "b": (0.56, "vector 0.400, summary 0.800")}
    nodes = spark.createDataFrame([("r", 0, k) for k in ("a", "b", "c", "gone")], "doc_id string, chunk_index int, fn string")
    got = R.node_similarities(nodes, world["vectors"], world["functions"], embedder).collect()
    assert {r["fn"]: round(r["similarity"], 5) for r in got} == {"a": 0.9, "b": 0.56, "c": 0.26}
    assert R.reason(**world, embedder=embedder).first()["total_candidates"] == 2
