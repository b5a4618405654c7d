import numpy as np
import pytest

from linkloom.llm import packing as P
from linkloom.llm.tokens import default_path, tokenizer


def test_differencing_is_a_partition_with_small_spread():
    rng = np.random.default_rng(1)
    for n, k in ((50, 5), (200, 7), (9, 9), (5, 8), (1, 1)):
        s = rng.integers(1, 100, n)
        part = P.differencing(s, k)
        assert len(part) == n and part.min() >= 0 and part.max() < k
        load = np.bincount(part, weights=s, minlength=k)
        if n >= 10 * k:
            assert load.max() - load.min() <= 5


@pytest.mark.parametrize("capacity", [100, 512, 4096])
def test_fill_keeps_the_capacity_and_wastes_little(capacity):
    rng = np.random.default_rng(2)
    s = np.minimum(rng.gamma(2.0, 130, 3000).astype(int) + 1, capacity)
    part = P.fill(s, capacity)
    load = np.bincount(part, weights=s)
    assert load.max() <= capacity and load.sum() == s.sum()
    free, bins = [], 0  # best fit decreasing for comparison
    for v in sorted(s.tolist(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= v]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= v
        else:
            free.append(capacity - v)
    assert len(load) <= len(free) * 1.01 + 1


def test_fill_edges():
    assert list(P.fill([], 5)) == []
    assert list(P.fill([5], 5)) == [0]
    assert len(set(P.fill([5, 5, 5], 5))) == 3
    assert len(set(P.fill([3] * 10, 5))) == 10  # no two fit together
    assert len(set(P.fill([0, 0, 1], 5))) == 1
    with pytest.raises(ValueError):
        P.fill([6], 5)


def test_tables(spark):
    texts = ["one two three", None, "", "word " * 300, "one two three", "ü 漢字 <|endoftext|>"] + [f"item {'x ' * (i % 23)}" for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "7 as tokens", "'z' as capacity_name")
    capacities = spark.createDataFrame([("s", 16), ("m", 64), ("none", 0)], "capacity_name string, tokens int")
    packed = P.pack(docs, capacities).toPandas()
    t = tokenizer(default_path())
    sizes = {i: len(t.encode_ordinary(x or "")) for i, x in enumerate(texts)}
    for name, cap in (("s", 16), ("m", 64)):
        own = packed[packed.capacity_name == name]
        assert own.groupby("doc_id").tokens.sum().to_dict() == {i: n for i, n in sizes.items() if n}
        assert own.groupby("container").tokens.sum().max() <= cap
        assert (own.groupby("doc_id").size() == [-(-sizes[i] // cap) for i in sorted(i for i in sizes if sizes[i])]).all()
    report = {r["capacity_name"]: r for r in P.fill_report(P.pack(docs, capacities), capacities).collect()}
    assert set(report) == {"s", "m"} and report["m"]["unused_share"] < 0.06 and report["m"]["fullest"] <= 64
    assert P.pack(docs.limit(0), capacities).count() == 0 and P.pack(docs, capacities.limit(0)).count() == 0
