"""The index under changes: equal to a rebuild after updates, deletes, late and repeated changes, crashes and compaction."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from verbatrix.operators import chunking, sparse
from verbatrix.streaming import incremental as I

FIELDS = "doc_id string, seq bigint, text string"
LONG = " ".join(f"word{i % 37} apple{i % 5}" for i in range(120))
FIRST = [("a", 1, "the apple pie and apple tart"), ("b", 1, "banana split"), ("c", 1, LONG), ("d", 1, "cherry pie"), ("e", 1, ""), ("f", 1, "fig"), ("g", 1, None)]
SECOND = [
    ("a", 2, "banana bread"), ("b", 2, None), ("c", 5, LONG[300:] + " quince"), ("c", 4, "never seen"), ("d", 1, "cherry pie"), ("d", 0, "older"),
    ("e", 2, "elder berry"), ("g", 2, "grape"), ("h", 1, "hazel pie"), (None, 1, "no id"), ("x", None, "no seq"),
]
THIRD = [("b", 3, "banana again"), ("c", 3, "late"), ("h", 2, None), ("h", 1, "late too"), ("f", 2, "fig"), ("a", 2, "another text of that seq")]


def latest(*parts):
    held = {}
    for part in parts:
        best = {}
        for d, s, t in part:
            if d is not None and s is not None:
                best[d] = max(best.get(d, (-1, False, "")), (s, t is not None, t or ""))
        held |= {d: c for d, c in best.items() if d not in held or c[0] > held[d][0]}
    return {d: c[2] for d, c in held.items() if c[1]}


def told(index):
    rows = lambda df: sorted(map(tuple, df.collect()))
    return {
        "postings": rows(index.postings.select("id", "term", "tf", "dl")),
        "terms": rows(index.terms.select("term", "df", F.round("idf", 9))),
        "totals": rows(index.totals.select("n", F.round("avgdl", 9))),
        "chunks": rows(index.chunks.select("id", "text")),
    }


def rebuilt(spark, texts):
    cut = chunking.fixed_chunks(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    return told(sparse.build(cut.select(F.concat_ws("_", "doc_id", "chunk_ord").alias("id"), F.struct("doc_id", "chunk_ord").alias("ord"), "text")))


@pytest.fixture
def stream(spark, tmp_path):
    source = str(tmp_path / "in")
    path, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")

    def send(rows):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(source)
        query = I.follow_changes(spark.readStream.schema(FIELDS).parquet(source), path, checkpoint)
        assert query.awaitTermination(120) and query.exception() is None

    return send, path


def test_updates_deletes_and_late_changes(spark, stream):
    send, path = stream
    setting = spark.conf.get(I.STATE_STORE, None)
    send(FIRST)
    assert told(I.current_index(spark, path)) == rebuilt(spark, latest(FIRST))
    send(SECOND)
    assert told(I.current_index(spark, path)) == rebuilt(spark, latest(FIRST, SECOND))
    assert I.compact(spark, path) == I.compact(spark, path) == 1
    send(THIRD)
    expected = rebuilt(spark, latest(FIRST, SECOND, THIRD))
    assert told(I.current_index(spark, path)) == expected
    assert I.compact(spark, path) == 2 and I.vacuum(spark, path) == ["batches/0", "batches/1", "batches/2", "bases/1"]
    assert told(I.current_index(spark, path)) == expected and spark.conf.get(I.STATE_STORE, None) == setting
    # What is gone is not in the base at all.
    assert spark.read.parquet(f"{path}/bases/2/gone").isEmpty()
    assert not {"b_0", "h_0"} & {r.id for r in spark.read.parquet(f"{path}/bases/2/postings").filter("gen < 3 and doc_id <> 'a'").filter("doc_id in ('b', 'h')").collect()}
    # A replay of all changes in one batch alters nothing.
    send(FIRST + SECOND + THIRD)
    assert told(I.current_index(spark, path)) == expected


def changed(spark, rows):
    return spark.createDataFrame(rows, I.CHANGE)


def test_a_batch_that_failed_is_not_seen_and_is_written_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    I.apply_changes(changed(spark, [("a", 1, "apple", None, None), ("b", 1, "banana", None, None)]), 0, path)
    before = told(I.current_index(spark, path))
    second = changed(spark, [("a", 2, "apple tart", 1, "apple"), ("b", 2, None, 1, "banana")])
    with monkeypatch.context() as m:
        m.setattr(I, "_finish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            I.apply_changes(second, 1, path)
    assert told(I.current_index(spark, path)) == before
    for _ in range(2):
        I.apply_changes(second, 1, path)
        assert told(I.current_index(spark, path)) == rebuilt(spark, {"a": "apple tart"})
    # Once folded and deleted, a batch that comes again is known all the same.
    assert I.compact(spark, path) == 1 and len(I.vacuum(spark, path)) == 2
    I.apply_changes(second, 1, path)
    assert told(I.current_index(spark, path)) == rebuilt(spark, {"a": "apple tart"})


def test_everything_deleted_and_nothing_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.current_index(spark, str(tmp_path))
    I.apply_changes(changed(spark, [("a", 1, "apple", None, None)]), 0, str(tmp_path))
    I.apply_changes(changed(spark, [("a", 2, None, 1, "apple")]), 1, str(tmp_path))
    index = I.current_index(spark, str(tmp_path))
    assert index.postings.isEmpty() and index.terms.isEmpty() and tuple(index.totals.head()) == (0, None)
    assert sparse.search(index, spark.createDataFrame([(1, "apple")], "query_id int, query string")).isEmpty()


class Held:
    """A value state that counts how often it is asked."""

    def __init__(self):
        self.value, self.asked = None, []

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = value


def test_a_document_asks_its_state_once_and_takes_rows():
    operator = I.LastChange()
    operator.held = Held()
    fed = lambda *rows: [tuple(r) for r in operator.handleInputRows(("a",), iter([Row(doc_id="a", seq=s, text=t) for s, t in rows]), None)]
    assert fed((1, "old"), (2, "new"), (2, "a new")) == [("a", 2, "new", None, None)] and operator.held.asked == ["get", "update"]
    assert fed((1, "late"), (2, "z")) == [] and operator.held.asked == ["get", "update", "get"]
    assert fed((3, None)) == [("a", 3, None, 2, "new")] and fed((3, "x"), (4, "")) == [("a", 4, "", 3, None)]


def test_terms_are_counted_in_the_row_of_their_chunk(spark, tmp_path):
    texts = ["pie apple Pie the apple pie", "", "the of", None, LONG]
    frame = spark.createDataFrame([(str(i), "d", 1, t) for i, t in enumerate(texts)], "id string, doc_id string, gen bigint, text string")
    made = I._postings(frame)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.term, r.tf, r.dl) for r in I._listed(made, "id", "dl").filter("id < '4'").orderBy("term").collect()] == [("0", "apple", 2, 5), ("0", "pie", 3, 5)]
    long = {r.term: r.tf for r in I._listed(made, "id").filter("id = '4'").collect()}
    assert long == {w: LONG.split().count(w) for w in set(LONG.split())}
    # On disk a chunk is one row, so what is gone is left out before terms are listed.
    I.apply_changes(changed(spark, [("a", 1, LONG, None, None)]), 0, str(tmp_path))
    stored = {name: spark.read.parquet(f"{tmp_path}/batches/0/{name}").count() for name in ("chunks", "postings")}
    assert stored["chunks"] == stored["postings"] > 1
