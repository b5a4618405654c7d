from linkloom.llm import mixing as M


def test_a_copy_outside_the_targets_takes_no_text_away(spark):
    rows = [(1, "held by none", None), (2, "held by none", "big"), (3, "held by other", "unknown"), (4, "held by other", "big"), (5, "held by other", "big")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_weight double, max_repeats int")
    assert sorted(r["doc_id"] for r in M.mix(documents, targets).collect()) == [2, 4]
