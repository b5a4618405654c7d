import numpy as np

from linkloom.llm import neighbours as N


def table(spark, vectors, prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:05}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, vector array<float>")


def brute(x, i, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[i]
    s[i] = -9
    return np.argsort(-s, kind="stable")[:k]


def test_recall_against_brute_force_on_loose_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 64))
    x = (centres[rng.integers(0, 150, 6000)] + 0.6 * rng.normal(size=(6000, 64))).astype(np.float32) * rng.uniform(0.1, 9, (6000, 1)).astype(np.float32)
    v = table(spark, x)
    asked = list(range(0, 6000, 50))  # every id divisible by 50
    got = N.nearest(v.where("cast(substring(id, 2) as int) % 50 = 0"), v).toPandas()
    hit = sum(len({f"v{j:05}" for j in brute(x, i, 10)} & set(got[got.id == f"v{i:05}"].neighbour)) for i in asked)
    assert hit / (10 * len(asked)) >= 0.9
    assert got.groupby("id").size().eq(10).all() and not (got.id == got.neighbour).any()


def test_ties_repeats_small_tables_and_blocks(spark):
    base = np.eye(64)[:3]
    v = table(spark, [base[0], base[0] * 5, base[0], base[1], base[2]])
    v = v.unionByName(v)
    got = N.nearest(v, v, keep=3).toPandas().sort_values(["id", "cosine", "neighbour"], ascending=[True, False, True])
    assert list(got[got.id == "v00000"].neighbour) == ["v00001", "v00002", "v00003"]
    assert got.groupby("id").size().eq(3).all()
    again = N.nearest(v, v, keep=3, block=2).toPandas()
    assert set(map(tuple, again[["id", "neighbour"]].values)) == set(map(tuple, got[["id", "neighbour"]].values))
    for block in (0, 10):
        assert N.nearest(v.limit(0), v, block=block).count() == 0 and N.nearest(v, v.limit(0), block=block).count() == 0


def test_join_by_leaf_with_a_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 64)  # several groups, some of them salted
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 2000)] + 0.5 * rng.normal(size=(2000, 64))).astype(np.float32)
    x[:700] = x[0]  # a third are copies
    v = table(spark, x)
    got = N.nearest(v, v, block=0).toPandas()
    assert got.groupby("id").size().eq(10).all() and got.id.nunique() == 2000 and not (got.id == got.neighbour).any() and not got.duplicated(["id", "neighbour"]).any()
    assert list(got[got.id == "v00003"].sort_values("neighbour").neighbour) == [f"v{i:05}" for i in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10)]
    asked = range(700, 2000, 13)
    hit = sum(len({f"v{j:05}" for j in brute(x, i, 10)} & set(got[got.id == f"v{i:05}"].neighbour)) for i in asked)
    assert hit / (10 * len(asked)) >= 0.9
    few = N.nearest(table(spark, x[700:720], "q"), v, block=0).toPandas()  # queries that are not in the table
    near = few.sort_values("cosine").groupby("id").tail(1)
    assert dict(zip(near.id, near.neighbour)) == {f"q{i:05}": f"v{700 + i:05}" for i in range(20)}


def test_usable_vectors(spark):
    good = [1.0] * 64
    rows = [(" a\n", good), ("b", [0.0] * 64), ("c", good[:63]), ("d", [float("nan")] + good[1:]), ("e", [float("inf")] + good[1:]), ("f", [None] + good[1:]), ("g", None), (None, good), ("  ", good), ("h", [0.0] * 63 + [-2.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").selectExpr("*", "1 as vector")
    assert sorted(r["id"] for r in N.usable(df).collect()) == ["a", "h"]


def test_forest_on_identical_and_no_points():
    f = N.Forest(np.ones((50, 64)) / 8, 5000)
    assert len(next(f.looks(np.ones((1, 64)) / 8, 5))) == 5
    assert N.Forest(np.zeros((0, 64)), 0).depth == 1
