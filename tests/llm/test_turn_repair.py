"""Repair of conversations: against an exhaustive search, SQL, and odd input."""

import hashlib
import re
import zlib

import duckdb
import pytest

from verbatrix.llm import turn_repair

FIELDS = "conv_id long, turn long, role string, text string"


def cheapest(rows, faults):
    """Least (cost, audit, lines) over all sequences of edits, row by row, with every number of inserts that can help."""
    done = {("", 0): (0, "", ())}
    legal = re.compile(r"s?(ua)*u?")
    for (role, text), fault in zip([*rows, (None, None)], [*faults, None]):
        for _ in range(3):  # inserts before the row
            for (made, n), (c, a, lines) in list(done.items()):
                for new in ("user", "assistant"):
                    if legal.fullmatch(made + new[0]):
                        keep(done, made + new[0], n, (c + 3, a + "I", (*lines, f"{new}:")))
        if role is None:
            break
        after = {}
        extra = 3 if fault == "truncated" else 0
        for (made, n), (c, a, lines) in done.items():
            keep(after, made, n + 1, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                for new, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if new[:1] in "sua" and new and legal.fullmatch(made + new[0]):
                        keep(after, made + new[0], n + 1, (c + price + extra, a + edit, (*lines, f"{new}:{text}")))
        done = after
    return min(v for (made, _), v in done.items() if re.fullmatch(r"(s?(ua)+)?", made))


def keep(table, made, n, way):
    # Only the grammar state matters for what follows: nothing, s, ...u, ...a.
    key = ("" if not made else made if made == "s" else "su" if made[-1] == "u" else "sua", n)
    key = (key[0].removeprefix("s") if key[0] in ("su", "sua") else key[0], n)
    if key not in table or way < table[key]:
        table[key] = way


def expected(rows):
    text_of = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            harm = zlib.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
            role, text = text_of(role), text_of(text)
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            after += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in after:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in after if t is not None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(after, after[1:]))
        cost, audit, lines = cheapest([(r, t) for _, r, t in after], faults)
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows():
    roles, texts = ["user", "assistant", "system", None, "tool", "", "umpire", "User"], ["Fine.", "cut off", "", None, " \n\t", "Why?\x0c ", "é…!", "Fine."]
    rows = [(c, t if (c + t) % 7 else None, roles[(c * 3 + t * t) % (3 if c % 2 else 8)], f"{texts[(c + t * 5) % 8] or ''}" if (c + t) % 5 else None) for c in range(60) for t in range(c % 9)]
    rows += [(None, 0, "user", "No id."), (None, None, "assistant", "No turn."), (7, 2, "user", "Twice."), (7, 2, "user", "Twice."), (7, 2, "assistant", "Same turn."), (900, 1, "system", "x" * 200_000)]
    return rows + [(901, t, "user" if t % 3 else "assistant", f"Row {t}{'.' if t % 4 else ''}") for t in range(1500)]


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_every_conversation_gets_its_cheapest_repair(spark, segment):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "extra") for r in rows], FIELDS + ", cost string").repartition(5)
    got = {r.conv_id: tuple(r) for r in turn_repair.repaired(turn_repair.damaged(frame), segment).collect()}
    assert got == expected(rows)


def test_conversations_cut_by_batches(spark):
    """Conversations that go on in the next Arrow batch carry their states and hashes along."""
    rows = odd_rows()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: tuple(r) for r in turn_repair.repaired(turn_repair.damaged(spark.createDataFrame(rows, FIELDS)), 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == expected(rows)


def test_sql_agrees_and_empty_tables(spark, small):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = sorted(db.sql(turn_repair.SQL).fetchall())
    assert sorted(tuple(r) for r in turn_repair.op12_turn_repair(spark, small).collect()) == want
    assert turn_repair.repaired(turn_repair.damaged(spark.createDataFrame([], FIELDS))).collect() == []
