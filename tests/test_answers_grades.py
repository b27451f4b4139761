import math
import re

from pyspark.sql import functions as F

from verbatrix.operators import answer, grading
from verbatrix.sources.records import QUESTION, RUN

TEXTS = ["A is 1 [1]. B is 2 [2][3]. In [2025] C [1, 4].", "none", "[7]", " x [100] y [10 , 2]", ""]


def plain_claims(text):
    """``claims`` for one answer, in Python."""
    out, at, claim = [], 0, ""
    for m in re.finditer(answer.CITATION, text):
        claim = text[at : m.start()].strip() or claim
        out += [(int(n), claim) for n in m[1].split(",")]
        at = m.end()
    return out



def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, answer_text string")


def test_citations_and_claims(spark):
    got = {r.query_id: (r.n, [tuple(c) for c in r.c]) for r in frame(spark).select("query_id", answer.citations(F.col("answer_text")).alias("n"), answer.claims(F.col("answer_text")).alias("c")).collect()}
    assert [got[i][0] for i in range(5)] == [[1, 2, 3, 4], [], [7], [10, 2], []]
    for i, t in enumerate(TEXTS):
        assert got[i][1] == plain_claims(t)


def test_verdicts(spark):
    df = spark.createDataFrame([("YES - it says so",), ("yes",), ("No - other year",), ("",), (None,), ("Maybe - YES",)], "r string")
    s, r = answer.verdict(F.col("r"))
    assert [tuple(x) for x in df.select(s, r).collect()] == [(True, "it says so"), (True, "yes"), (False, "other year"), (False, ""), (False, ""), (False, "YES")]


def test_confidence(spark):
    answers = spark.createDataFrame([(1, "Fact [1]."), (2, "It does not provide it."), (3, "Uncited."), (4, "Gone [9].")], "query_id int, answer_text string")
    cited = spark.createDataFrame([(1, "c1")], "query_id int, id string")
    scores = spark.createDataFrame([(1, "c1", 2.0), (1, "c2", 9.0), (4, "c1", 5.0)], "query_id int, id string, rerank_score double")
    checked = spark.createDataFrame([(1, True), (1, False), (4, False)], "query_id int, supported boolean")
    with_check = {r.query_id: r.confidence for r in answer.confidence(answers, cited, scores, checked).collect()}
    sigmoid = 1 / (1 + math.exp(-2))
    assert with_check == {1: round(0.3 + 0.4 * sigmoid, 3), 2: 0.35, 3: 0.0, 4: 0.0}
    assert {r.query_id: r.confidence for r in answer.confidence(answers, cited, scores, None).collect()}[1] == round(sigmoid, 3)


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, "b", "B", "10-Q", "Q2", "none"), (1, 1, "a", "A", "10-K", "FY", "Item 1")], "query_id int, rank int, id string, text string, form string, period string, section string")
    row = answer.contexts(hits).head()
    assert row.context == "[1] (10-K, FY, Item 1)\nA\n\n[2] (10-Q, Q2)\nB" and row.citation_map == {1: "a", 2: "b"}


def q(spark, *specs):
    import json

    return spark.read.schema(QUESTION).json(spark.sparkContext.parallelize([json.dumps(s) for s in specs]))


def runs(spark, *rows):
    import json

    return spark.read.schema(RUN).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


META = {"company": "acme", "form": "10-K", "period": "FY2025"}


def spec(i, **expected):
    return {"id": i, "category": "tabular", "expected": expected, "evidence": {"document": "acme_10-K_FY2025", "period": "FY2025"}}


def run(i, text, meta=META):
    return {"question_id": i, "question": "?", "answer_text": text, "resolved_citations": [{"number": 1, "metadata": meta}] if meta else []}


def test_grading(spark):
    questions = q(
        spark,
        spec("scale", value=57347, unit="USD millions"), spec("near", value=100, unit="USD millions"), spec("far", value=100, unit="USD millions"), spec("pct", value=14.2, unit="percent"), spec("pctno", value=14.2, unit="percent"),
        spec("two", shares=114.4, cost=5000, cost_unit="USD millions"), spec("scope", value=5), spec("extra", value=5, shares=7, change_pct=3),
        {"id": "none", "category": "no_answer", "expected": {"should_decline": True}, "evidence": {}}, {"id": "n", "category": "narrative", "expected": {"claims": ["a", "b"]}, "evidence": {}},
    )
    given = runs(
        spark,
        run("scale", "It was $57.3 billion [1]."), run("near", "100.9 million [1]"), run("far", "101.1 million [1]"), run("pct", "14.2% [1]"), run("pctno", "$14.2 billion [1]"),
        run("two", "114.4 million shares for $5,000 million [1]"), run("scope", "5 [1]", {**META, "period": "FY2024"}), run("extra", "5, up 3 percent [1]"),
        run("none", "It is missing.", None), run("n", "a [1]"), run("unknown", "x"),
    )
    claims = spark.createDataFrame([("n", 0.5)], "question_id string, claims_score double")
    g = {r.question_id: r for r in grading.grade(given, questions, claims).collect()}
    assert {k: v.correct for k, v in g.items()} == {"scale": True, "near": True, "far": False, "pct": True, "pctno": False, "two": True, "scope": False, "extra": True, "none": True, "n": False}
    assert g["scope"].value_correct and not g["scope"].period_correct and g["two"].unit_correct and g["pctno"].unit_correct is False
    assert (g["extra"].change_pct_correct, g["extra"].supplementary_values_correct, g["scale"].change_pct_correct) == (True, False, None)
    assert g["none"].value_correct is None and g["none"].decline_correct and not g["none"].false_decline and g["n"].document_correct is None
    total = grading.summary(grading.grade(given, questions, claims)).filter("category is null").head()
    assert (total.questions, total.correct, total.right_number_wrong_scope) == (10, 6, 1)


def test_numbers(spark):
    row = spark.createDataFrame([("up -1,234.5 million, or 3 percent; 7 in all 100 percent of x",)], "t string").select(grading.numbers(F.col("t")).alias("n")).head().n
    assert [tuple(x) for x in row] == [(-1234.5, 1e6, True), (3.0, 1.0, True), (7.0, 1.0, False), (100.0, 1.0, True)]


def test_claims_score(spark):
    df = spark.createDataFrame([("[true, false]", 2), ("`[true]`", 1), ("True, then false", 2), ("[true]", 2), (None, 1)], "r string, n int")
    assert [x[0] for x in df.select(grading.claims_score(F.col("r"), F.col("n"))).collect()] == [0.5, 1.0, 0.5, None, None]


def test_comparison(spark):
    a, b = runs(spark, run("1", "x"), run("2", "y")), runs(spark, run("2", "z", {**META, "form": "10-Q"}), run("3", "w"))
    got = {r.question_id: (r.in_a, r.in_b, r.answer_changed, r.sources_changed) for r in grading.compare_runs(a, b).collect()}
    assert got == {"1": (True, False, None, None), "2": (True, True, True, True), "3": (False, True, None, None)}
