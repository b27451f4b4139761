import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.functions import text as T

TEXTS = ["", " a  b\t\n\x1c c ", "Total net revenue 57,347", "Ünï　code x", "a" * 39, "b" * 40, "b" * 100, "one two " * 30, "x\U0001f600y 12 the AND of"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_collapse_is_pythons_split(spark):
    got = {r.i: r.c for r in frame(spark, TEXTS).select("i", T.collapse(F.col("t")).alias("c")).collect()}
    assert got == {i: " ".join(t.split()) for i, t in enumerate(TEXTS)}


def test_tokens(spark):
    got = {r.i: r.c for r in frame(spark, TEXTS).select("i", T.tokens(F.col("t")).alias("c")).collect()}
    assert got == {i: [w for w in re.findall(r"[a-z0-9]+", t.lower()) if w not in T.STOPWORDS] for i, t in enumerate(TEXTS)}


def windows(t, n=40):
    t = " ".join(t.split()).lower()
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def test_overlap_matches_sets(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS] + [("q" * 50 + " tail of it and more words to come", "q" * 50 + " another tail entirely, as it seems")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.o for r in df.select("i", T.overlap_ratio(F.col("a"), F.col("b")).alias("o")).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = windows(a), windows(b)
        assert abs(got[i] - (len(x & y) / min(len(x), len(y)) if x and y else 0.0)) < 1e-12


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1 \U0001f600é", max_size=30), min_size=1, max_size=30))
def test_match_spans(spark, texts):
    got = {r.i: [tuple(m) for m in r.m] for r in frame(spark, texts).select("i", T.match_spans(F.col("t"), "[ab]+1?").alias("m")).collect()}
    assert got == {i: [(m.start(), m.end(), m.group()) for m in re.finditer("[ab]+1?", t)] for i, t in enumerate(texts)}


def test_positions_of_many_matches(spark):
    """Spans, claims and figures agree with Python's on texts with many matches, and take about ten times as long for ten times as many."""
    import re
    import time

    from verbatrix.operators import answer, grading

    def text(n):
        return " ".join(f"é{i} grew {i % 97}.5 {'million ' if i % 3 else ''}{'%' if i % 4 == 0 else 'of it'} [{i % 99 + 1}]{'[2, 3]' if i % 5 == 0 else '.'}" for i in range(n))

    df = spark.createDataFrame([(t,) for t in (text(700), "", None, "no match", "[1]", "5 6% 7,000 thousand")], "t string")
    rows = df.select("t", T.match_spans(F.col("t"), r"\d+").alias("s"), answer.claims(F.col("t")).alias("c"), grading.numbers(F.col("t")).alias("n")).collect()
    for r in rows:
        t = r.t or ""
        assert [tuple(x) for x in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", t)]
        want, at, claim = [], 0, ""
        for m in re.finditer(answer.CITATION_PLAIN, t):
            claim = t[at : m.start()].strip() or claim
            want += [(int(k), claim) for k in re.findall(r"\d+", m[0])]
            at = m.end()
        assert [tuple(x) for x in r.c] == want
        figures = []
        for m in re.finditer(grading.NUMBER, t):
            after = t[m.end() :]
            word = re.match(r"\s*(thousand|million|billion|trillion)", after, re.I)
            tail = after[word.end() :] if word else after.lstrip()
            near = tail[: grading.PERCENT_WITHIN].lower()
            figures.append((float(m[0].replace(",", "")), {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}[word[1].lower()] if word else 1.0, "%" in near or "percent" in near))
        assert [tuple(x) for x in r.n] == figures

    def seconds(n):
        one = spark.createDataFrame([(text(n),)], "t string").cache()
        one.count()
        start = time.perf_counter()
        one.select(F.size(answer.claims(F.col("t"))), F.size(grading.numbers(F.col("t"))), F.size(T.match_spans(F.col("t"), r"\d+"))).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(20_000) < 25 * max(seconds(2_000), 0.1)
