from linkloom.operators import resolve


def test_callees_of_any_length_are_found_by_content(spark):
    keys = [("a.getPage", "A", 1), ("x", "X", 2), ("log_all", "L", 3), ("a.putPage", "P", 4), ("b.log", "M", 5)]
    symbol = resolve.symbols(spark.createDataFrame(keys, "key string, node_id string, key_ord int").withColumnRenamed("key_ord", "ord"))
    callees = ["get", "x", "log", "ag", "Page", "putP", "zz", "", "page"]
    got = dict(map(tuple, resolve.contains_match(spark.createDataFrame([(c,) for c in callees], "callee string"), symbol).collect()))
    want = {c: next((n for k, n, _ in keys if c in k), None) for c in callees if c}
    assert got == {c: n for c, n in want.items() if n}
