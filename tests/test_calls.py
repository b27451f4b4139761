"""Model calls: one a distinct prompt, kept in the ledger, also after failures."""

import hashlib
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verbatrix.operators.calls import Ledger, complete
from verbatrix.plans import answers, search
from verbatrix.providers import ExtractiveModel


def Counting(folder, refuse=(), break_at=None):
    """A model that leaves a file for every call and fails as it is told to; of a local class, which travels to workers by value."""

    class Counting:
        name = "counting"

        def __init__(self, folder, refuse=(), break_at=None):
            self.folder, self.refuse, self.break_at = str(folder), refuse, break_at
            Path(self.folder).mkdir(exist_ok=True)

        def complete(self, system, user):
            if self.break_at and user.endswith(self.break_at):
                raise SystemExit("the executor is gone")
            (Path(self.folder) / f"{hashlib.sha256(user.encode()).hexdigest()}-{uuid.uuid4().hex}").touch()
            if user in self.refuse:
                raise TimeoutError("no reply")
            return ExtractiveModel().complete(system, user) if "Context:" in user or "Claim:" in user else f"re: {user}"

        def calls(self):
            return Counter(p.name.split("-")[0] for p in Path(self.folder).iterdir())

    return Counting(folder, refuse, break_at)


def prompts(spark, n, copies=3):
    return spark.createDataFrame([(i, f"prompt {i % n}") for i in range(n * copies)], "i int, u string").repartition(5)


def test_a_prompt_is_asked_once(spark, tmp_path):
    model, ledger = Counting(tmp_path / "calls"), Ledger(spark, str(tmp_path / "ledger"), round_size=10, chunk=3)
    df = prompts(spark, 25).unionByName(spark.createDataFrame([(99, None)], "i int, u string"))
    got = complete(df, model, "s", F.col("u"), "a", ledger)
    for _ in range(2):
        assert {r.i: r.a for r in got.collect()} == {i: f"re: prompt {i % 25}" for i in range(75)} | {99: None}
    again = complete(prompts(spark, 30), model, "s", F.col("u"), "a", Ledger(spark, str(tmp_path / "ledger")))
    assert again.filter("a is not null and a_error is null").count() == 90
    assert len(model.calls()) == 30 and set(model.calls().values()) == {1}
    complete(prompts(spark, 2), model, "other rules", F.col("u"), "a", ledger)
    assert sum(model.calls().values()) == 32


def test_failures_are_tried_again_and_do_not_stay(spark, tmp_path):
    model = Counting(tmp_path / "calls", refuse=("prompt 1",))
    ledger = Ledger(spark, str(tmp_path / "ledger"), tries=2)
    got = {r.u: (r.a, r.a_error) for r in complete(prompts(spark, 3), model, "s", F.col("u"), "a", ledger).collect()}
    assert got["prompt 1"] == (None, "TimeoutError: no reply") and got["prompt 2"] == ("re: prompt 2", None)
    assert sorted(model.calls().values()) == [1, 1, 2]
    model.refuse = ()
    got = {r.u: (r.a, r.a_error) for r in complete(prompts(spark, 3), model, "s", F.col("u"), "a", ledger).collect()}
    assert got["prompt 1"] == ("re: prompt 1", None) and sum(model.calls().values()) == 5


def test_a_lost_task_does_not_ask_anew(spark, tmp_path):
    """A task dies on its way; the one that follows reads the receipts of the chunks that were done."""
    broken = Counting(tmp_path / "calls", break_at="prompt 7")
    ledger = Ledger(spark, str(tmp_path / "ledger"), at_once=1, chunk=1)
    with pytest.raises(Exception):
        complete(prompts(spark, 40), broken, "s", F.col("u"), "a", ledger)
    before = sum(broken.calls().values())
    assert before >= 1
    mended = Counting(tmp_path / "calls")
    assert complete(prompts(spark, 40), mended, "s", F.col("u"), "a", ledger).filter("a is null").count() == 0
    assert len(mended.calls()) == 40 and set(mended.calls().values()) == {1}


def test_one_call_a_question(spark, tmp_path):
    """Answers, citations, verdicts, confidence and records all read the same replies."""
    rows = [(q, i, i - 10 * q + 1, f"The harbour of town {i} was built in {1800 + i}. Ships come.", 2.0, i - 10 * q + 1, "narrative") for q in range(20) for i in (10 * q, 10 * q + 1)]
    hits = spark.createDataFrame(rows, "query_id int, id int, rank int, text string, rerank_score double, rerank_rank int, kind string")
    listed = hits.withColumns({"score": F.lit(1.0), "rrf_score": F.lit(0.1), "found_in": F.create_map(F.lit(0), F.lit(1))})
    found = search.SearchResult(listed, listed, listed, listed, spark.createDataFrame([], "query_id int, id int, kept_id int, list string"))
    questions = spark.createDataFrame([(q, f"When was the harbour of {q} built?") for q in range(20)], "query_id int, query string")
    model = Counting(tmp_path / "calls")
    done = answers.answer_questions(questions, found, model)
    assert done.answers.filter("answer_text is not null").count() == 20 and done.citations.count() == 40 and done.confidence.count() == 20
    assert answers.run_records(questions, found, done).count() == 20 and done.verified.filter("supported").count() == 40
    assert sum(model.calls().values()) == 60 and set(model.calls().values()) == {1}
