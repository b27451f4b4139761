from pyspark.sql import functions as F

from verbatrix.operators import blocks, chunking
from verbatrix.sources import records

SCHEMA = "doc_id string, block_type string, source_order int, section_id string, text string, speaker string, turn_index int, raw_html string, flat_text string, records array<string>, table_title string, unit string, block_id string"


def rows(spark, *data):
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(d.get(f) for f in fields) for d in data], SCHEMA)


def text(order, t, section=None, doc="d"):
    return {"doc_id": doc, "block_type": "text", "source_order": order, "text": t, "section_id": section}


def ids(df):
    return {r.source_order: r.block_id for r in blocks.assign_ids(df).collect()}


def test_ids_come_from_content(spark):
    base = ids(rows(spark, text(0, "Total net revenue 57,347"), text(1, "Thank you."), text(2, "Thank  you. ")))
    moved = ids(rows(spark, text(0, "inserted"), text(1, "Total net revenue 57,347"), text(2, "Thank you."), text(3, "Thank you.")))
    assert base[0] == moved[1] and base[1] == moved[2] and base[2] == base[1] + "#2" == moved[3]
    other = ids(rows(spark, text(0, "Total net revenue 57,348"), text(1, "thank you.")))
    assert other[0] != base[0] and other[1] != base[1]


def test_serialization_and_offsets(spark):
    df = rows(
        spark,
        text(0, "Head "),
        {"doc_id": "d", "block_type": "table", "source_order": 1, "raw_html": "<table/>", "flat_text": "2026 21.7", "records": ["a | b", "c | d"]},
        {"doc_id": "d", "block_type": "table", "source_order": 2, "raw_html": "<table/>", "flat_text": "2026 21.7", "records": []},
        {"doc_id": "d", "block_type": "speaker_turn", "source_order": 3, "speaker": "Ann", "text": "Hi \U0001f600."},
    )
    whole = blocks.serialize_documents(df).head().text
    assert whole == "Head a | b\nc | d2026 21.7Ann: Hi \U0001f600."
    for r in blocks.block_offsets(df.withColumn("s", blocks.serialized())).collect():
        assert whole[r.start : r.end] == r.s


def test_round_trip(spark, tmp_path):
    df = blocks.assign_ids(rows(spark, text(0, "a"), text(1, "b\nc")))
    docs = spark.createDataFrame([("d", "p", "page")], "doc_id string, source_path string, doc_type string")
    records.write_blocks(docs, df, str(tmp_path / "ir"))
    d, b = records.read_blocks(spark, str(tmp_path / "ir"))
    assert [tuple(r) for r in d.collect()] == [("d", "p", "page")]
    keep = ["doc_id", "block_type", "source_order", "text", "block_id"]
    assert sorted(b.select(keep).collect()) == sorted(df.select(keep).collect())


def test_windows_cover_and_overlap(spark):
    texts = ["", "x", "ab" * 250, "é" * 451, "z" * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunking.fixed_chunks(df).orderBy("doc_id", "chunk_ord").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: [t[k : k + 500] for k in range(0, len(t), 450)] for i, t in enumerate(texts) if t}


def python_pack(records, size, header):
    whole = "\n".join(records)
    if len(whole) <= 3 * size:
        return [whole]
    chunks, lines = [], []
    for r in records:
        if lines and len("\n".join([*lines, r])) > size and not lines == [header]:
            chunks.append(lines)
            lines = [header]
        lines = [*lines, r]
    return ["\n".join(c) for c in [*chunks, lines]]


def test_records_are_whole(spark):
    many = [f"Capital | Metric row {i:02} | Year ended December 31, 2025 | {i}.7 | millions" for i in range(60)]
    long = [*many[:10], "label " * 120, *many[10:21]]
    cases = [many, many[:12], many[:4], long]
    df = spark.createDataFrame([(i, c, "Capital", "millions") for i, c in enumerate(cases)], "i int, records array<string>, table_title string, unit string")
    got = {r.i: [c.text for c in r.c] for r in df.select("i", chunking.pack_records(F.col("records"), chunking.continuation_header(), 500).alias("c")).collect()}
    header = "Capital (continued) | values in millions unless the record states otherwise"
    for i, case in enumerate(cases):
        assert got[i] == python_pack(case, 500, header)
        assert [line for c in got[i] for line in c.split("\n") if line != header] == case


def test_section_chunks(spark):
    df = rows(
        spark, text(0, "a" * 600, "s1"), text(1, "b" * 10, "s1"),
        {"doc_id": "d", "block_type": "table", "source_order": 2, "section_id": "s1", "raw_html": "<t>", "flat_text": "f", "records": ["r1", "r2"], "block_id": "T"},
        text(3, "c", "s1"), text(4, "e", None), text(5, "f", None), text(6, "g", "s1"),
    )
    got = [(r.section, r.run, r.chunk_index_in_section, r.kind, r.text) for r in chunking.section_chunks(df).orderBy("chunk_ord").collect()]
    assert got == [
        ("s1", 1, 0, "narrative", "a" * 500), ("s1", 1, 1, "narrative", "a" * 150 + "b" * 10), ("s1", 1, 2, "table_records", "r1\nr2"), ("s1", 1, 3, "narrative", "c"),
        (None, 2, 0, "narrative", "ef"), ("s1", 3, 0, "narrative", "g"),
    ]


def test_windows_across_blocks(spark):
    """Pieces are those of a plain cut, wherever blocks end; a long text is not scanned from its start for each piece."""
    letters = "aé𝄞b c"
    for size, overlap in ((1, 0), (5, 2), (50, 49), (2**31 - 1, 3)):
        step = size - overlap
        wide = chunking.BLOCK * step
        lengths = [n for n in {0, 1, size, size + 1, wide - 1, wide, wide + 1, wide + overlap, wide + overlap + 1, 2 * wide + 1} if n < 5000]
        texts = [(n, (letters * n)[:n]) for n in lengths] + [(-1, None)]
        made = spark.createDataFrame(texts, "n int, text string").select("n", chunking.windows(F.col("text"), size, overlap).alias("w"))
        assert {r.n: r.w for r in made.collect()} == {n: [t[i : i + size] for i in range(0, len(t or ""), step)] for n, t in texts}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring") == 2
