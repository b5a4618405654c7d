from linkloom.llm import mixing as M


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "'q' as same", "2 as block")


def corpus(n=3000):
    rows = [(i, f"text number {i} " + "word " * (i % 17), ("big", "Big ", "mid-size", "small")[min(3, (i % 10) // 3 if i % 10 else 0)]) for i in range(n)]
    return rows + [(n, "text number 1 " + "word " * 1, "big"), (n + 1, None, "big"), (n + 2, "", "small"), (n + 3, "lost", None), (n + 4, "other", "unknown")]


def targets(spark, rows=(("big", 0.4, 2), ("mid_size", 0.35, 3), ("small", 0.25, 4))):
    return spark.createDataFrame(list(rows), "source string, target_weight double, max_repeats int")


def test_shares_caps_and_positions(spark):
    df, t = docs(spark, corpus()), targets(spark)
    uses = M.mix(df, t).toPandas()
    report = {r["source"]: r for r in M.mix_report(df, t).collect()}
    for source, weight, cap in (("big", 0.4, 2), ("mid_size", 0.35, 3), ("small", 0.25, 4)):
        assert abs(report[source]["reached_share"] - weight) < 0.003
        assert uses[uses.source == source].groupby("doc_id").size().max() <= cap
    assert uses.position.between(0, 1).all() and uses.position.is_monotonic_increasing
    text = {i: x for i, x, _ in corpus()}
    by_text = uses.assign(text=uses.doc_id.map(text)).groupby("text").size()
    assert by_text.max() <= 4 and 3000 not in set(uses.doc_id)  # equal texts count as one
    caps = {"big": 2, "mid_size": 3, "small": 4}
    assert any(report[s]["most_uses"] == cap for s, cap in caps.items())  # as large as the scarcest source allows


def test_schedule_follows_its_integral(spark):
    uses = M.uses(docs(spark, corpus()), targets(spark), None).toPandas()
    for _, own in uses.groupby("source"):
        a, demand = own.tilt.iloc[0], own.demand.iloc[0]
        for t in (0.25, 0.5, 0.75):
            assert abs(own[own.position < t].tokens.sum() / demand - (t + a * (t * t - t))) < 0.02


def test_degenerate_inputs(spark):
    t = targets(spark)
    assert M.mix(docs(spark, corpus(30)).limit(0), t).count() == 0
    assert M.mix(docs(spark, corpus(30)), t.limit(0)).count() == 0
    only = docs(spark, [(1, "only big", "big")])  # the other targets have no texts
    assert [r["source"] for r in M.mix(only, t).collect()] == ["big", "big"]
    assert {r["source"]: (r["target_weight"], r["reached_share"]) for r in M.mix_report(only, t).collect()} == {"big": (0.4, 1.0), "mid_size": (0.35, 0.0), "small": (0.25, 0.0)}
    one = M.mix(docs(spark, [(1, "a b c", "big"), (1, "a b c", "big")]), targets(spark, [("BIG", 1.0, 3)])).toPandas()
    assert list(one.use) == [1, 2, 3]
