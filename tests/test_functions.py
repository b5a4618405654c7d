import pytest
from pyspark.sql import functions as F

from linkloom.functions import scoring as S, text as X


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_identifiers_languages_and_directories(spark):
    assert one(spark, "Function:a.Function:b", X.clean_func_id) == "a.b"
    assert one(spark, "Method:Function:b", X.clean_func_id) == "Function:b"
    assert one(spark, None, X.clean_func_id) == ""
    assert [one(spark, p, X.detect_language) for p in ("r/a.JAVA", "r/a.min.mjs", "r/a.hpp", "r/a.py", "r/java", None)] == ["java", "javascript", "cpp", None, None, None]
    assert [one(spark, p, X.in_ignored_dir) for p in ("lib/a.js", "r/lib/a.js", "r/src/lib", "r/x/vendor/y/a.c")] == [False, True, False, True]


def test_summaries(spark):
    assert one(spark, "This function  reads one two three four five six seven eight nine.", X.concise) == "reads one two three four five six seven"
    assert one(spark, " the METHOD", X.concise) == ""
    assert one(spark, "get it", X.is_utility) and not one(spark, "gets it", X.is_utility)
    assert one(spark, "The Café reads C and a b2", X.keywords) == ["b2", "café", "reads"]


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (110, 1), (111, 2), (120, 2), (121, 2), (220, 2), (221, 3)])
def test_word_windows(spark, n, chunks):
    assert len(one(spark, " ".join(["w"] * n), X.word_windows)) == chunks


def test_greedy_packing(spark):
    assert one(spark, "a\n \nb", X.chunks) == ["a b"]
    assert one(spark, "x" * 300 + "\n\n" + "y" * 300 + "\n\nz", X.chunks) == ["x" * 300 + " " + "y" * 300, "z"]
    long = " ".join(["word"] * 150)
    assert one(spark, "head\n\n" + long + "\n \ntail", X.chunks) == ["head", " ".join(["word"] * 120), " ".join(["word"] * 40), "tail"]
    assert one(spark, None, X.chunks) == [] and one(spark, " \n\n ", X.chunks) == []


def test_replies(spark):
    full = "Overall Score: 0.85\nSemantic Relevance：0.70\nLogical Completeness: 0.1\nFunctional Completeness: 0.8\nDataflow Continuity: 0.5\nCall Rationality: 0.75\nAnalysis Conclusion: first\nsecond line\n\nmore"
    r = one(spark, full, X.parse_reply)
    assert (r.overall, r.semantic, r.completeness, r.dataflow, r.rationality, r.reason) == (0.85, 0.7, 0.8, 0.5, 0.75, "first second line")
    r = one(spark, "Overall Score: 1\nSemantic Relevance: [0.9]\nExtensibility: 9.99", X.parse_reply)
    assert (r.overall, r.semantic, r.reason) == (0.625, 1.0, "No detailed reasoning")
    assert one(spark, "", X.parse_reply) is None and one(spark, None, X.parse_reply) is None


def test_densities(spark):
    v = lambda x, f: one(spark, x, f, "double")
    assert v(0.25, S.beta33) == pytest.approx(1.0546875) and v(0.375, S.beta33) == pytest.approx(1.64794921875)
    assert v(0.5, S.beta62) == pytest.approx(0.65625) and v(0.5, S.beta51) == pytest.approx(0.3125)
    assert v(1.0, S.beta51) == 1e-10 and v(-3.0, S.beta33) == 1e-10


GOLDEN = [
    (2, 0.70, 0.50, (0.5, 0.5, 0.5, 0.5), 0.3, 0.33, 0.2025282292236328),
    (3, 0.70, 0.50, (0.5, 0.5, 0.5, 0.5), 0.3, 0.50, 0.44747805213928227),
    (3, 0.65, 0.85, (0.7, 0.8, 0.5, 0.75), 0.1, 0.50, 1.0),
    (3, 0.65, 1.0, (1.0, 1.0, 0.5, 1.0), 0.1, 0.50, 1.6616556970387496e-09),
    (2, 0.0, 0.50, (0.5, 0.5, 0.5, 0.5), 0.3, 0.05, 0.005687500001889539),
]


@pytest.mark.parametrize("n, s, overall, dims, u, prior, posterior", GOLDEN)
def test_prior_and_posterior(spark, n, s, overall, dims, u, prior, posterior):
    scores = F.struct(*[F.lit(v).alias(k) for k, v in zip(("overall", "semantic", "completeness", "dataflow", "rationality", "uncertainty"), (overall, *dims, u))])
    p = S.prior(F.lit(n), F.lit(s), F.lit(overall), F.lit(0))
    row = spark.range(1).select(p.alias("p"), S.posterior(p, F.lit(s), S.initial_structure(F.lit(n)), scores).alias("q")).first()
    assert row["p"] == pytest.approx(prior, abs=1e-9) and row["q"] == pytest.approx(posterior, rel=1e-9)
