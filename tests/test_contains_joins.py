import hashlib

from linkloom.operators import resolve


def test_tables_of_pieces_do_not_pass_through_the_driver(spark, tmp_path):
    """The planner takes a table of pieces for as small as the file of keys; on 0.1 GB with keys of many pieces it broke the driver."""
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(400)]
    spark.createDataFrame([(k, f"N{i:03}", i) for i, k in enumerate(keys)], "key string, node_id string, ord int").write.parquet(f"{tmp_path}/keys")
    callees = [k[i % 40 : i % 40 + 1 + i % 9] for i, k in enumerate(keys)] + ["zz", "zzzzz", ""]
    spark.createDataFrame([(c,) for c in callees], "callee string").write.parquet(f"{tmp_path}/callees")
    found = resolve.contains_match(spark.read.parquet(f"{tmp_path}/callees"), resolve.symbols(spark.read.parquet(f"{tmp_path}/keys")))
    got = dict(map(tuple, found.collect()))
    want = {c: next((f"N{i:03}" for i, k in enumerate(keys) if c in k), None) for c in callees if c}
    assert got == {c: n for c, n in want.items() if n}
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftSemi" in line for line in joins), joins  # the marks, of which there are MARKS at most
