"""Call chains: bounded walks, their summaries, structure scores, and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scoring, text

MAX_NODES = 3


def walks(starts: DataFrame, call: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """``starts`` (with column fn) x chain, ord: all walks of 2 to ``max_nodes`` nodes along calls, cycles included.

    ``ord`` holds the order of the edges taken; arrays compare element by element, shorter first, which is the preorder
    of a depth-first search. One join per step.
    """
    step = call.select(F.col("src").alias("__at"), F.col("dst").alias("__to"), F.col("ord").alias("__ord"))
    now = starts.withColumn("chain", F.array("fn")).withColumn("ord", F.array().cast("array<bigint>"))
    out = None
    for _ in range(max_nodes - 1):
        now = now.withColumn("__at", text.clean_func_id(F.element_at("chain", -1))).join(step, "__at")
        now = now.withColumn("chain", F.concat("chain", F.array("__to"))).withColumn("ord", F.concat("ord", F.array("__ord"))).drop("__at", "__to", "__ord")
        out = now if out is None else out.unionByName(now)
    return out


def summarized(chain_rows: DataFrame, functions: DataFrame, key: list[str]) -> DataFrame:
    """``chain_rows`` with semantic_summary and key_nodes; ``key`` identifies a row.

    Parts are the concise summaries of the nodes, of more than three characters, joined by an arrow; without any, the node
    names. Key nodes are those whose part is no utility. Summaries are cut at 300 characters.
    """
    told = functions.where("summary is not null").select(F.col("clean").alias("__fn"), text.concise(F.col("summary")).alias("__part")).where(F.length("__part") > text.LEAST_PART)
    nodes = chain_rows.select(*key, F.posexplode("chain").alias("__pos", "__node")).withColumn("__fn", text.clean_func_id(F.col("__node")))
    parts = nodes.join(told, "__fn").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__pos", "__node", "__part"))).alias("__parts"))
    rows = chain_rows.join(parts, key, "left")
    spoken = F.array_join(F.transform("__parts", lambda x: x["__part"]), text.ARROW)
    names = F.array_join(F.transform("chain", text.clean_func_id), text.ARROW)
    whole = F.coalesce(spoken, names)
    cut = F.when(F.length(whole) > text.CHAIN_LIMIT, F.concat(F.left(whole, F.lit(text.CHAIN_LIMIT - 3)), F.lit("..."))).otherwise(whole)
    key_nodes = F.transform(F.filter("__parts", lambda x: ~text.is_utility(x["__part"])), lambda x: x["__node"])
    return rows.withColumn("semantic_summary", cut).withColumn("key_nodes", F.coalesce(key_nodes, F.array().cast("array<string>"))).drop("__parts")


def distinct_summaries(rows: DataFrame, within: list[str], order: list) -> DataFrame:
    """The first row of each summary, by the hash of its text, among rows whose summary has ten characters or more."""
    long = rows.where(F.length("semantic_summary") >= text.LEAST_SUMMARY)
    w = W.partitionBy(*within, F.substring(F.md5("semantic_summary"), 1, 16)).orderBy(*order)
    return long.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def capped(rows: DataFrame, within: list[str]) -> DataFrame:
    """The first walks of each start, as many as its analysis mode allows, in discovery order."""
    w = W.partitionBy(*within).orderBy("ord")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= scoring.chain_cap(F.col("mode"))).drop("__n")


def structure(chain_rows: DataFrame, call: DataFrame, flow: DataFrame, degree: DataFrame, key: list[str]) -> DataFrame:
    """(key, central, structure): nodes with centrality of 0.7 or more, and the structure score where flow edges exist.

    Flow integrity counts every flow edge between neighbours, parameters and returns twice as strongly, rationality the
    neighbours that a call joins plus a bonus for three nodes or more, topology the centralities and the inner nodes with
    calls on both sides. Without any flow edge at all the score is null, and min(length / 8, 1) stands in.
    """
    n = F.size("chain")
    pairs = chain_rows.select(*key, n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(text.clean_func_id(F.element_at("chain", i)).alias("src"), text.clean_func_id(F.element_at("chain", i + 1)).alias("dst")))).alias("p")).select(*key, "n", "p.*")
    flowing = flow.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("f"), (2 * F.count_if(F.col("type").isin("PARAMETER", "RETURN"))).alias("pr"))
    called = call.select("src", "dst", F.lit(1).alias("c"))
    met = pairs.join(flowing, ["src", "dst"], "left").join(called, ["src", "dst"], "left").groupBy(*key).agg(F.sum(F.coalesce("f", F.lit(0))).alias("f"), F.sum(F.coalesce("pr", F.lit(0))).alias("pr"), F.sum(F.coalesce("c", F.lit(0))).alias("c"), F.max("n").alias("n"))
    hops = F.col("n") - 1
    integrity = (F.col("f") / hops * 0.6 + F.col("pr") / hops * 0.4) * 0.4
    bonus = F.when(F.col("n") >= 3, F.least((F.col("n") - 2) * 0.1, F.lit(0.2))).otherwise(0.0)
    rationality = (F.col("c") / hops * 0.7 + bonus * 0.3) * 0.3
    places = chain_rows.select(*key, n.alias("n"), F.posexplode("chain").alias("i", "node")).withColumn("fn", text.clean_func_id(F.col("node")))
    known = places.join(degree, "fn", "left")
    central = F.coalesce("centrality", F.lit(0.0))
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1) & (F.col("in_degree") > 0) & (F.col("out_degree") > 0)
    topo = known.groupBy(*key).agg(F.max(central).alias("hi"), F.avg(central).alias("avg"), F.count_if(inner).alias("both"), F.count_if(central >= 0.7).alias("central"))
    balance = F.least(F.col("both") * 0.1, F.lit(0.3)) / 0.3
    topology = F.least((F.col("hi") * 0.4 + F.col("avg") * 0.3 + balance * 0.3) * 0.3, F.lit(0.3))
    any_flow = flow.limit(1).agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
    score = F.when(any_flow, F.least(integrity + rationality + topology, F.lit(1.0)))
    return met.join(topo, key).select(*key, "central", score.alias("structure"))


def choose(evidence: DataFrame) -> DataFrame:
    """Evidence of each document in the order of choice: place 1 is the chain chosen, 2 to 4 the alternatives.

    Only chains that pass the gates on posterior, judged score and length compete, all of them where none passes.
    """
    length = F.size("chain")
    ok = scoring.qualifies(length, F.col("posterior"), F.col("judged"))
    doc = W.partitionBy("doc_id")
    rows = evidence.withColumn("ok", ok).withColumn("any_ok", F.max("ok").over(doc)).where("ok or not any_ok").drop("ok", "any_ok")
    rows = rows.withColumn("choice", F.round(scoring.selection_score(length, F.col("posterior"), F.col("judged"), F.col("similarity")), 12))
    order = doc.orderBy(F.desc("choice"), F.desc(F.round("posterior", 12)), "rank", "ord")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next_posterior", F.lead("posterior").over(order)).withColumn("next_length", F.lead(length).over(order))
    return rows.withColumn("reason", scoring.selection_reason(length, F.col("posterior"), F.col("judged"), F.col("next_posterior"), F.col("next_length")))
