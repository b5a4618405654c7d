import random

import pytest

from linkloom.operators import hierarchy as H


def brute(parent):
    """(root, depth) of each child by walking up; circles give their smallest id and -1."""
    out = {}
    for child in parent:
        path, at = [child], parent[child]
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        out[child] = (min(path[path.index(at) :]), -1) if at in path else (at, len(path))
    return out


def forest(seed, n=120):
    rng = random.Random(seed)
    parent = {}
    for i in range(1, n):
        parent[f"n{i}"] = f"n{rng.randrange(max(0, i - rng.choice([1, 2, 30])), i)}"
    for k in range(4):  # circles with tails
        ring = [f"c{k}_{j}" for j in range(rng.randrange(1, 9))]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            parent[a] = b
        for j in range(rng.randrange(0, 12)):
            parent[f"t{k}_{j}"] = f"t{k}_{j - 1}" if j and rng.random() < 0.8 else rng.choice(ring)
    return parent


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_depths_paths_and_circles_against_walks(spark, seed):
    parent = forest(seed)
    links = spark.createDataFrame(list(parent.items()), "child string, parent string")
    tree = H.hierarchy(links, with_path=True).toPandas().set_index("node_id")
    expected = brute(parent)
    for node, (root, depth) in expected.items():
        assert (tree.root_id[node], tree.depth[node]) == (root, depth)
    for node, row in tree.iterrows():
        if row.depth < 0:
            assert row.path is None
            continue
        path = [node]
        while path[0] in parent:
            path.insert(0, parent[path[0]])
        assert row.path == " > ".join(path)
        below = {x for x, (r, d) in expected.items() if d > 0 and node in _up(parent, x)}
        inside = tree[(tree.root_id == row.root_id) & (tree.pre > row.pre) & (tree.pre < row.pre + row["size"])]
        assert set(inside.index) == below and row["size"] == len(below) + 1
    listed = H.descendants(H.hierarchy(links), spark.createDataFrame([(n,) for n in tree.index], "node_id string")).toPandas()
    assert set(zip(listed.node_id, listed.descendant_id)) == {(a, x) for x, (_, d) in expected.items() if d > 0 for a in _up(parent, x)}


def _up(parent, x):
    out = []
    while x in parent:
        x = parent[x]
        out.append(x)
    return out


def test_deep_chain_and_wide_parent(spark):
    links = [(f"d{i:04}", f"d{i - 1:04}") for i in range(1, 300)] + [(f"w{i:04}", "hub") for i in range(500)]
    tree = H.hierarchy(spark.createDataFrame(links, "child string, parent string")).toPandas().set_index("node_id")
    assert tree.depth["d0299"] == 299 and tree.root_id["d0299"] == "d0000"
    assert tree["size"]["hub"] == 501 and sorted(tree[tree.parent_id == "hub"].pre) == list(range(1, 501))


def test_dirty_edges_nulls_repeats_and_clashing_columns(spark):
    rows = [(" a\t", "b\n", "contains ", 1), ("a", "b", "CONTAINS", 2), (None, "c", "CONTAINS", 3), ("a", "  ", "CONTAINS", 4), ("a", "x", "CALLS", 5), ("s", "s", "Contains", 6), ("z", "b", "CONTAINS", 7), ("a", "q", None, 8)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, type string, n int").withColumnRenamed("n", "depth")
    got = {tuple(r) for r in H.contained(edges).collect()}
    assert got == {("b", "a", 1), ("s", "s", -1)}


def test_no_links_no_rows(spark):
    empty = spark.createDataFrame([], "child string, parent string")
    assert H.hierarchy(empty, with_path=True).count() == 0
