import datetime as dt

import pytest

from linkloom.operators import orphans as O

T = lambda d: dt.datetime(2024, 1, d)


def test_match_semantics_by_null_mask(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, kind string")
    refs = spark.createDataFrame([(1, "x", "ok"), (1, "y", "bad"), (None, "y", "half"), (None, "q", "half bad"), (3, None, "other half"), (None, None, "nothing"), (1, "y", "bad")], "a int, b string, note string")
    got = lambda m: sorted(r["note"] for r in O.orphans(refs, parents, {"a": "id", "b": "kind"}, m).collect())
    assert got("simple") == ["bad", "bad"]
    assert got("partial") == ["bad", "bad", "half bad", "other half"]
    assert got("full") == ["bad", "bad", "half", "half bad", "other half"]
    with pytest.raises(ValueError):
        O.orphans(refs, parents, {"a": "id"}, "odd")


def test_clashing_names_and_empty_tables(spark):
    refs = spark.createDataFrame([(1, 9), (2, 9)], "id int, extra int")
    parents = spark.createDataFrame([(1, 7)], "id int, extra int")
    assert [r["id"] for r in O.orphans(refs, parents, {"id": "id"}).collect()] == [2]
    assert O.orphans(refs, parents.limit(0), {"id": "id"}).count() == 2
    assert O.orphans(refs.limit(0), parents, {"id": "id"}).count() == 0


def test_missing_late_deleted(spark):
    nodes = spark.createDataFrame(
        [("a", T(5), None), ("b ", T(1), T(3)), ("b", T(6), T(8)), ("c", T(1), T(4)), ("c", T(1), T(4)), ("n", None, None), (None, T(1), None)], "id string, recorded_at timestamp, removed_at timestamp"
    )
    known = spark.createDataFrame([("lib", "p")], "id string, package_name string")
    rows = [
        (1, "a", T(4)), (2, "a", T(5)), (3, "b", T(2)), (4, "b", T(3)), (5, "b", T(7)), (6, "b", T(8)), (7, "\tc\n", T(9)), (8, "gone", T(1)), (8, "gone", T(1)),
        (9, "lib", T(1)), (10, None, T(1)), (11, "  ", T(1)), (12, "n", T(1)), (13, "a", None), (14, "gone", None), (15, "b", T(5)),
    ]
    edges = spark.createDataFrame([(i, t, "CALLS", r) for i, t, r in rows], "edge_id long, target_id string, type string, recorded_at timestamp")
    found = O.dangling(edges, nodes, known)
    assert {(r["edge_id"], r["state"]) for r in found.collect()} == {(1, "late"), (4, "deleted"), (6, "deleted"), (7, "deleted"), (8, "missing"), (14, "missing"), (15, "deleted")}
    report = {(r["type"], r["month"]): (r["edges"], r["missing"], r["late"], r["deleted"]) for r in O.dangling_report(found, edges).collect()}
    assert report == {("CALLS", "2024-01"): (13, 1, 1, 4), ("CALLS", None): (2, 1, 0, 0)}
    assert O.dangling(edges.limit(0), nodes, known).count() == 0
    assert O.dangling(edges, nodes.limit(0), known.limit(0)).where("state = 'missing'").count() == 13
