import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verbatrix.functions import text as T
from verbatrix.operators import dense, fusion, grading, render, rerank, sparse
from verbatrix.plans import answers, search
from verbatrix.providers import ExtractiveModel, HashedEmbedder, LexicalScorer
from verbatrix.sources import records, store
from verbatrix.streaming import incremental


def chunk_frame(spark, texts):
    rows = [(i, i, t, "acme", "10-K", "FY2025", "none" if i % 2 else "Item 1", "narrative") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, ord int, text string, company string, form string, period string, section string, kind string")


TEXTS = ["the apple pie and apple tart", "banana split", "apple", "cherry pie pie", "", "nothing of the kind", "banana apple banana"]


def plain_bm25(texts, query):
    import re

    tok = lambda t: [w for w in re.findall(r"[a-z0-9]+", t.lower()) if w not in T.STOPWORDS]
    docs = [Counter(tok(t)) for t in texts]
    avg = sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    score = lambda d: sum(idf.get(w, 0) * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * sum(d.values()) / avg)) for w in tok(query))
    return {i: round(score(d), 6) for i, d in enumerate(docs)}


def test_bm25_and_incremental(spark, tmp_path):
    chunks = chunk_frame(spark, TEXTS)
    queries = spark.createDataFrame([(1, "apple pie apple"), (2, "the of"), (3, "banana")], "query_id int, query string")
    got = {(r.query_id, r.id): r.score for r in sparse.scores(sparse.build(chunks), queries).collect()}
    for q, text in ((1, "apple pie apple"), (3, "banana")):
        want = plain_bm25(TEXTS, text)
        assert all(abs(got.get((q, i), 0) - s) < 2e-6 for i, s in want.items())
    assert sparse.search(sparse.build(chunks), queries, filters={"section": "Item 1"}).filter("id % 2 = 1").isEmpty()
    docs = chunks.select(F.col("id").alias("doc_id"), "text")
    for i in range(2):
        incremental.add_batch(docs.filter(f"doc_id % 2 = {i}"), i, str(tmp_path))
    incremental.add_batch(docs.filter("doc_id % 2 = 1"), 1, str(tmp_path))
    stream = {(r.query_id, int(r.id.split("_")[0])): r.score for r in sparse.scores(incremental.current_index(spark, str(tmp_path)), queries).collect()}
    full = {k: v for k, v in got.items()}
    # Empty texts make no chunk in the stream; so compare with an index without them.
    whole = sparse.build(chunks.filter("text <> ''"))
    assert stream == {(r.query_id, r.id): r.score for r in sparse.scores(whole, queries).collect()} and set(stream) == set(full)


def test_stream_runs(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "apple pie"), ("2", "banana")], "doc_id string, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id string, text string").parquet(source)
    incremental.follow(stream, str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination(60)
    assert incremental.current_index(spark, str(tmp_path / "ix")).totals.head().n == 2


def test_dense(spark):
    v = spark.createDataFrame([(i, i, [float(i), 0.0, 1.0]) for i in range(6)] + [(6, 6, [0.0, 0.0, 0.0])], "id int, ord int, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0, 1.0])], "query_id int, embedding array<float>")
    assert [(r.id, r.score) for r in dense.search(q, v, 3).orderBy("rank").collect()] == [(2, 0.0), (1, 1.0), (3, 1.0)]
    assert 6 not in [r.id for r in dense.most_similar(q, v, 10).collect()]


def greedy(texts):
    kept, dropped = [], []
    grams = [{" ".join(t.split()).lower()[i : i + 40] for i in range(len(" ".join(t.split())) - 39)} for t in texts]
    for i, g in enumerate(grams):
        like = next((k for k in kept if g and grams[k] and len(g & grams[k]) / min(len(g), len(grams[k])) >= 0.85), None)
        kept.append(i) if like is None else dropped.append((i, like))
    return kept, dropped


def test_greedy_dedup(spark):
    base = "It is a long passage about revenue and income in the quarter that ended in June. "
    texts = [base * 2, base * 2 + "x", "short", "short", base, "Another thing entirely, long enough to have shingles of its own here.", (base * 2).upper()]
    hits = spark.createDataFrame([(1, i, i + 1, t) for i, t in enumerate(texts)], "query_id int, id int, rank int, text string")
    kept, dropped = fusion.greedy_dedup(hits)
    want = greedy(texts)
    assert [r.id for r in kept.orderBy("rank").collect()] == want[0] and [r.rank for r in kept.orderBy("rank").collect()] == list(range(1, len(want[0]) + 1))
    assert sorted((r.id, r.kept_id) for r in dropped.collect()) == want[1]


def test_fusion_ties_keep_first_seen(spark):
    make = lambda ids: spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ids)], "query_id int, id string, rank int")
    got = fusion.reciprocal_rank_fusion([make("abc"), make("bda")]).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "d", "c"] and got[0].found_in == {0: 2, 1: 1} and got[0].list_idx == 1 and got[3].list_idx == 0


@pytest.mark.parametrize(
    "line, want",
    [
        ("Capital | Total shares | Year ended 2025 | 114.4 | millions", "Capital, total shares, year ended 2025: 114.4 million"),
        ("T | CET1 ratio | June | 14.2 | percent", "T, CET1 ratio, june: 14.2 percent"),
        ("T | Net | 2025 | 5 | USD millions", "T, net, 2025: $5 million"),
        ("T | Net | 2025 | 5 | USD", "T, net, 2025: $5"),
        ("T | Net | 2025 | 5", "T, net, 2025: 5"),
        ("T (continued) | values in millions unless", "T (continued), values in millions unless"),
        ("only", "only"),
        ("5 | percent", "5 percent"),
        (" |  | ", ""),
    ],
)
def test_rendering(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(render.rendered_record(F.col("l"))).head()[0] == want


def test_rendered_chunk_is_bounded(spark):
    text = "\n".join(f"T | row {i} | 2025 | {i} | millions" for i in range(200))
    out = spark.createDataFrame([(text, "table_records"), (text, "narrative")], "t string, k string").select(render.scoring_text(F.col("t"), F.col("k")).alias("s")).collect()
    assert len(out[0].s) == 1800 and out[0].s.startswith("T, row 0, 2025: 0 million T, row 1") and out[1].s == text


def test_search_and_answer_end_to_end(spark, tmp_path):
    texts = [f"Passage {i} tells of {w} and what became of it over the years in some detail." for i, w in enumerate("apples pears plums cherries grapes lemons".split())]
    path = str(tmp_path / "c2")
    store.write_collection(chunk_frame(spark, texts).withColumn("strategy", F.lit("s")).withColumn("block_id", F.lit("")), HashedEmbedder(), path)
    with pytest.raises(Exception, match="exist"):
        store.write_collection(chunk_frame(spark, texts).withColumn("strategy", F.lit("s")).withColumn("block_id", F.lit("")), HashedEmbedder(), path)
    index = store.read_sparse(spark, path, rebuild=True)
    queries = spark.createDataFrame([("q1", "What became of plums?"), ("q2", "cherries")], "query_id string, query string")
    found = search.search(queries, store.read_collection(spark, path), index, HashedEmbedder(), LexicalScorer())
    first = {r.query_id: r.id for r in found.reranked.filter("rerank_rank = 1").collect()}
    assert first == {"q1": 2, "q2": 3}
    done = answers.answer_questions(queries, found, ExtractiveModel())
    a = {r.query_id: r for r in done.answers.collect()}
    assert "plums" in a["q1"].answer_text and "[1]" in a["q1"].answer_text and a["q1"].answer_text_error is None
    assert all(0 <= r.confidence <= 1 for r in done.confidence.collect()) and done.verified.count() == 4
    # What was done is recorded, stored, read back, verified anew and graded.
    records.write_runs(answers.run_records(queries.withColumn("category", F.lit("narrative")), found, done), str(tmp_path / "runs"))
    runs = records.read_runs(spark, str(tmp_path / "runs"))
    stored = {r.question_id: r for r in runs.collect()}
    assert set(stored) == {"q1", "q2"} and stored["q1"].answer_text == a["q1"].answer_text and stored["q1"].context.startswith("[1] (")
    assert [h.id for h in stored["q1"].reranked][0] == "2" and stored["q1"].fused[0].found_in == {"dense": stored["q1"].fused[0].found_in["dense"], "sparse": 1} and stored["q1"].dense[0].rank == 1
    assert [c.number for c in stored["q1"].resolved_citations] == stored["q1"].parsed_citations == [1, 2] and stored["q1"].resolved_citations[0].chunk_id == "2"
    again, rated = answers.verify_runs(runs, ExtractiveModel())
    assert again.count() == 4 and {r.query_id: r.confidence for r in rated.collect()} == {r.query_id: r.confidence for r in done.confidence.collect()}
    kind = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(records.QUESTION).fields}
    spec = spark.createDataFrame([("q1", '{"claims": ["plums became of it"]}'), ("q2", '{"claims": ["nothing of bananas whatsoever"]}')], "id string, e string")
    expected = spec.select("id", F.lit("narrative").alias("category"), F.from_json("e", kind["expected"]).alias("expected"), F.from_json(F.lit("{}"), kind["evidence"]).alias("evidence"))
    graded = grading.grade(runs, expected, grading.judged(runs, expected, ExtractiveModel()))
    assert {r.question_id: r.correct for r in graded.collect()} == {"q1": True, "q2": False}
    store.write_collection(chunk_frame(spark, texts[:1]).withColumn("strategy", F.lit("s")).withColumn("block_id", F.lit("")), HashedEmbedder(), path, append=True)
    with pytest.raises(store.StaleIndex):
        store.read_sparse(spark, path)


def test_one_failing_question_leaves_the_others(spark):
    class Fails:
        def complete(self, system, user):
            if "bad" in user:
                raise TimeoutError("no reply")
            return "Fine [1]."

    from verbatrix.operators.calls import complete

    df = spark.createDataFrame([(1, "bad"), (2, "good")], "i int, u string")
    got = {r.i: (r.a, r.a_error) for r in complete(df, Fails(), "s", F.col("u"), "a").collect()}
    assert got == {1: (None, "TimeoutError: no reply"), 2: ("Fine [1].", None)}


def test_rerank_ties_keep_fused_order(spark):
    hits = spark.createDataFrame([("q", i, r, "same words", "narrative") for r, i in enumerate((5, 3, 9), 1)], "query_id string, id int, rank int, text string, kind string")
    queries = spark.createDataFrame([("q", "same")], "query_id string, query string")
    assert [r.id for r in rerank.rerank(hits, queries, LexicalScorer(), 2).orderBy("rerank_rank").collect()] == [5, 3]


def test_terms_are_counted_without_a_shuffle_of_their_own(spark):
    """One exchange, of texts; rows that share an id are counted together, as before."""
    rows = [(i, f"alpha beta beta w{i % 7}") for i in range(40)] + [(3, "alpha gamma")]
    made = sparse.token_counts(spark.createDataFrame(rows, "id long, text string"))
    plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, plan
    got = {(r.id, r.term): r.tf for r in made.collect()}
    assert got[3, "alpha"] == 2 and got[3, "gamma"] == 1 and got[5, "beta"] == 2 and len(got) == 40 * 3 + 1


def test_ties_beyond_the_list_go_to_the_earlier_chunk(spark):
    """More chunks than the list holds have one score; ord decides, not id."""
    rows = [(i, 100 - i, "same words here") for i in range(30)] + [(i, i, f"other text {i}") for i in range(100, 140)]
    chunks = spark.createDataFrame(rows, "id long, ord long, text string").repartition(5)
    asked = spark.createDataFrame([("q", "same words")], "query_id string, query string")
    got = [r.id for r in sparse.search(sparse.build(chunks), asked, n=4).orderBy("rank").collect()]
    assert got == [29, 28, 27, 26]


def test_hybrid_search_takes_the_texts_of_hits_in_one_pass(spark, small, monkeypatch):
    from verbatrix import queries
    from verbatrix.plans import search as plan

    kept = {}
    plain = plan.written
    monkeypatch.setattr(plan, "written", lambda df, name: kept.setdefault(name, plain(df, name)) if name == "texts" else plain(df, name))
    found = queries._hybrid(spark, small)
    hits = found.dense.select("id").union(found.sparse.select("id")).union(found.dropped.select("id")).distinct()
    assert sorted(r.id for r in kept["texts"].collect()) == sorted(r.id for r in hits.collect())


def test_letters_are_counted_as_by_count():
    from verbatrix.providers import LetterCounts

    texts = ["Aa zZ é K K", "", None, "İ\U0001f600abc" * 5]
    expected = [[(t or "").count(c) + (t or "").count(c.upper()) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
    assert LetterCounts().embed(texts).tolist() == expected and LetterCounts().embed([]).shape == (0, 26)
