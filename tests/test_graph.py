import pytest
from pyspark.sql import functions as F

from linkloom.operators import chains, graph, resolve, retrieve


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EDGES = [
    (1, "Function:a", "Function:b", "CALLS"), (2, "Function:a ", "\tFunction:b", "calls"), (3, "Function:b", "Function:a", "CALLS"), (4, "Function:a", "Function:a", "CALLS"), (5, "Function:a", "Method:c", "CALLS"),
    (6, None, "Function:b", "CALLS"), (7, "Function:a", " ", "CALLS"), (8, "Function:a", "Function:b", "PARAMETER"), (9, "Function:a", "Function:b", "RETURN"), (10, "Function:a", "x", None),
]


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES, "edge_id long, source_id string, target_id string, type string")


def test_calls_adjacency_degrees_flags(spark, edges):
    call = graph.calls(edges)
    assert {(r["src"], r["dst"], r["ord"]) for r in call.collect()} == {("a", "b", 1), ("b", "a", 3), ("a", "a", 4), ("a", "c", 5)}
    assert {r["src"]: r["callees"] for r in graph.adjacency(call).collect()} == {"a": ["b", "a", "c"], "b": ["a"]}
    got = {r["fn"]: (r["out_degree"], r["in_degree"], r["centrality"]) for r in graph.degrees(call).collect()}
    assert got == {"a": (3, 2, 1.0), "b": (1, 1, 1.0), "c": (0, 1, 0.5)}
    flags = graph.flow_flags(graph.flows(edges)).first()
    assert (flags["src"], flags["has_params"], flags["has_returns"], flags["flows"]) == ("a", True, True, 2)
    one = graph.degrees(call.where("src = 'b'")).collect()  # one caller: no other to divide by
    assert {r["centrality"] for r in one} == {0.5}
    assert graph.degrees(call.limit(0)).count() == 0


def test_walks_are_preorder_with_cycles(spark, edges):
    starts = table(spark, [("Function:a",)], "fn string")
    got = chains.walks(starts, graph.calls(edges)).orderBy("ord").collect()
    assert [r["chain"] for r in got] == [["Function:a", *t] for t in (["b"], ["b", "a"], ["a"], ["a", "b"], ["a", "a"], ["a", "c"], ["c"])]
    assert all(len(r["chain"]) in (2, 3) for r in got)
    assert chains.walks(starts, graph.calls(edges).limit(0)).count() == 0


def test_flow_by_position(spark):
    nodes = table(
        spark,
        [("Function:a", "Function", None, None, None), ("Function:b", "Function", None, None, None), ("Pa1", "Parameter", "Function:a", {"position": "1"}, "int"), ("Pa0", "Parameter", "Function:a", {"position": "0"}, "int"),
         ("Pb0", "Parameter", "Function:b", {"position": "0"}, "int"), ("Pb0", "Parameter", "Function:b", {"position": "0"}, "int"), ("Pb1", "Parameter", "Function:b", {}, None), ("R1", "ReturnValue", "Function:b", None, "long"), ("R0", "ReturnValue", "Function:b", None, "int")],
        "id string, type string, scope string, raw_attributes map<string,string>, data_type string",
    )
    edges = table(spark, [(1, "Function:a", "Function:b", "CALLS"), (2, "Function:a", "Function:gone", "CALLS")], "edge_id long, source_id string, target_id string, type string")
    call = graph.closed_calls(edges, nodes)
    assert {(r["source_id"], r["target_id"], r["place"]) for r in graph.parameter_flow(call, nodes).collect()} == {("Pa0", "Pb1", 0), ("Pa1", "Pb0", 1)}
    assert [tuple(r) for r in graph.return_flow(call, nodes).collect()] == [("R0", "Var:Function:a.return_value", "Function:a->Function:b")]
    assert [tuple(r) for r in graph.return_variables(call, nodes).collect()] == [("Var:Function:a.return_value", "Function:a", "int")]


def cascade(language, key_list, caller, callee):
    """First match in order of the keys, rule by rule."""
    sep = resolve.SEPARATORS[language]
    parts = caller.split(sep)
    head, simple, outer = sep.join(parts[:-1]), parts[-2] if len(parts) > 1 else "", sep.join(parts[:-2])
    exact = [f"{head}{sep}{callee}" if "." in head else None, f"{simple}{sep}{callee}"] if language == "java" else [f"{simple}{sep}{callee}" if simple else None, f"{outer}{sep}{callee}" if outer else None]
    if language == "javascript" and "." in callee and simple and callee in key_list:
        return callee
    for want in exact:
        if want in key_list:
            return want
    for k in key_list:
        if k.endswith(sep + callee) or (language == "javascript" and k == callee):
            return k
    if len(callee) >= 4:
        for k in key_list:
            last = k.split(sep)[-1]
            if last == callee or last.endswith("_" + callee) or (language == "java" and last.endswith("$" + callee)):
                return k
    return None


@pytest.mark.parametrize("language", ["java", "javascript", "cpp"])
def test_resolution_is_the_first_match_of_the_cascade(spark, language):
    import random

    rng, sep = random.Random(7), resolve.SEPARATORS[language]
    name = lambda: rng.choice(["run", "load", "save_all", "do_load", "x$load", "all", "get", "obj"])
    key_list = list(dict.fromkeys(sep.join(name() for _ in range(rng.randrange(1, 5))) for _ in range(60)))
    facts = {(rng.choice(key_list), name() if rng.random() < 0.7 else sep.join((name(), name()))) for _ in range(80)}
    symbol = resolve.symbols(table(spark, [(k, "N:" + k, i) for i, k in enumerate(key_list)], "key string, node_id string, ord int"))
    got = {(r["caller_key"], r["callee"]): r["node_id"] for r in resolve.resolve(table(spark, list(facts), "caller_key string, callee string"), symbol, language).collect()}
    want = {f: cascade(language, key_list, *f) for f in facts}
    assert got == {f: "N:" + k for f, k in want.items() if k}


def test_symbols_keep_the_first_place_and_the_last_value(spark):
    got = resolve.symbols(table(spark, [("k", "one", 1), ("k", "two", 5), ("j", "x", 2)], "key string, node_id string, ord int")).collect()
    assert {(r["key"], r["key_ord"], r["node_id"]) for r in got} == {("k", 1, "two"), ("j", 2, "x")}
    hit = resolve.contains_match(table(spark, [("load",), ("zzzz",), ("ab",)], "callee string"), resolve.symbols(table(spark, [("my_loader", "A", 2), ("uploads", "B", 1)], "key string, node_id string, ord int"))).collect()
    assert [tuple(r) for r in hit] == [("load", "B")]


def test_retrieval_blocks_agree_and_candidates_add_up(spark):
    queries = table(spark, [("d1", 0, [1.0, 0.0]), ("d1", 1, [0.0, 1.0]), ("d2", 0, [1.0, 1.0]), ("d3", 0, None)], "doc_id string, chunk_index int, vector array<float>")
    functions = table(spark, [("a", [2.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 3.0]), ("e", None), ("f", [1.0, 1.0])], "clean string, vector array<float>")
    key = lambda df: sorted((r["doc_id"], r["chunk_index"], r["place"], r["fn"], round(r["vector_similarity"], 6)) for r in df.collect())
    whole = key(retrieve.top_products(queries, functions, 2))
    assert whole == key(retrieve.top_products(queries, functions, 2, block=1))
    assert whole[:2] == [("d1", 0, 1, "a", 1.0), ("d1", 0, 2, "b", 0.707107)]
    hits = retrieve.gated(retrieve.top_products(queries, functions, 3).withColumn("summary_similarity", F.lit(0.0)))
    top = retrieve.leading(retrieve.candidates(hits)).where("doc_id = 'd1'").orderBy("rank").collect()
    assert [(r["fn"], r["chunk_count"], r["mode"]) for r in top][:2] == [("b", 2, "full"), ("f", 2, "full")]
    assert retrieve.top_products(queries.limit(0), functions).count() == 0 and retrieve.top_products(queries, functions.limit(0)).count() == 0
