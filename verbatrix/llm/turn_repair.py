"""Repair of conversation structure (operator 12): the cheapest edits that give a legal order of roles.

Rows are dealt by a hash of their conversation and sorted by turn. Windows over that one shuffle tell blank, repeated and
truncated rows and adjacent roles. Each Arrow batch of whole or partial conversations then goes through one recursive query
of DuckDB: a recursion advances one row for all segments of all conversations in the batch, and keeps for each grammar state
the least cost and, among the cheapest, the ASCII-least audit of edits.

A segment holds up to ``SEGMENT`` rows. The first segment of a conversation starts in the grammar's start state; later
segments are worked out from every state, and folded in order. Two equally cheap audits of the same rows are never a proper
prefix of each other (a longer one would hold more inserts, at a cost), so the least of a segment stays the least of the
whole. A conversation therefore needs memory for one batch, its audits and four running hashes, whatever its length.

Grammar: the roles' initials form ``(s?(ua)+)?``. Keep (K) costs 0, Rerole (R) to user or assistant 3, Delete (D) 4, Insert (I)
of an empty user or assistant row 3. Blank and duplicate rows must be deleted; a truncated row that stays costs 3 more.

Defined cases: null ids form one conversation with a null id. Null roles and texts count as one space; a role that does not
begin with s, u or a is never kept as it is. Rows of one turn are ordered by role, then text; null turns come first. Repeated
rows are duplicates. A conversation without rows is zeros, an empty audit and the hash of an empty string. Extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

SEGMENT = 512
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after a system, a user, an assistant row; and the letter that leads on from each.
STATES = ("n", "s", "u", "a")
LEGAL = ("su", "ua", "au")
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: One step: the inner select puts inserts before the row, the outer one edits the row. least() passes over nulls.
RECURSION = f"""walk(k, began, pos, n, s, u, a) AS (
  SELECT k, began, 0,
         CASE WHEN began = 'n' THEN struct_pack(c := 0, e := '') END, CASE WHEN began = 's' THEN struct_pack(c := 0, e := '') END,
         CASE WHEN began = 'u' THEN struct_pack(c := 0, e := '') END, CASE WHEN began = 'a' THEN struct_pack(c := 0, e := '') END
  FROM begun
  UNION ALL
  SELECT k, began, pos, __D(n), least(__D(s), CASE WHEN kind = 's' THEN __E(n, pen, 'K') END),
         least(__D(u), CASE WHEN kind = 'u' THEN __E(free, pen, 'K') END, CASE WHEN NOT must THEN __E(free, pen + {REROLE}, 'R') END),
         least(__D(a), CASE WHEN kind = 'a' THEN __E(u, pen, 'K') END, CASE WHEN NOT must THEN __E(u, pen + {REROLE}, 'R') END)
  FROM (SELECT *, least(n, s, a) AS free FROM (
    SELECT w.k, w.began, r.pos, r.must, r.pen, CASE WHEN NOT r.must THEN r.kind END AS kind, w.n, w.s,
           least(w.u, __E(w.n, {INSERT}, 'I'), __E(w.s, {INSERT}, 'I'), __E(w.a, {INSERT}, 'I')) AS u,
           least(w.a, __E(w.u, {INSERT}, 'I'), __E(w.n, {2 * INSERT}, 'II'), __E(w.s, {2 * INSERT}, 'II')) AS a
    FROM walk w JOIN turns r ON r.k = w.k AND r.pos = w.pos + 1))
)"""


def _step_sql(sql: str) -> str:
    """The two macros written out: __E(x, cost, letters) edits a state, __D(x) deletes the row."""
    edit = lambda x, c, letters: f"CASE WHEN {x} IS NOT NULL THEN struct_pack(c := {x}.c + {c}, e := {x}.e || {letters}) END"
    out, rest = "", sql
    while "__" in rest:
        before, _, rest = rest.partition("__")
        which, args = rest[0], rest[2 : rest.index(")")]
        rest = rest[rest.index(")") + 1 :]
        out += before + (edit(*(x.strip() for x in args.split(","))) if which == "E" else edit(args, DELETE, "'D'"))
    return out + rest


WALK = _step_sql(RECURSION)
STEPS = f"WITH RECURSIVE {WALK} SELECT w.k, w.began, w.n, w.s, w.u, w.a FROM walk w JOIN sizes z ON z.k = w.k AND z.size = w.pos"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the hash of conversation and turn; ``gone`` marks the rows that it drops."""
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    text, role = as_text("text"), as_text("role")
    harm = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), harm.alias("harm"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("harm") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows with their first fault and what they add to gaps and illegal pairs, sorted by conversation and turn.

    All windows cluster by the conversation, so the one shuffle serves them; they stream over sorted rows and can spill.
    """
    dealt = rows.repartition(kit.buckets_for(rows), "conv_id")
    in_turn = [F.asc_nulls_first("turn"), "role", "text", "seen"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    w = Window.partitionBy("conv_id", "gone").orderBy(*in_turn)
    pair = F.concat(F.substring(F.lag("role").over(w), 1, 1), F.substring("role", 1, 1))
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(solid == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated")
    # Spark may swap windows, so the order is asked for at the end; where the last window has it, no sort is added.
    return dealt.withColumn("seen", seen).select(
        "conv_id", "gone", "turn", "role", "text", fault.alias("fault"), F.coalesce(~pair.isin(*LEGAL), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(w))).alias("new_turn"),
    ).sortWithinPartitions("conv_id", "gone", *in_turn)


class _Run:
    """One conversation while its rows come in: counts, and the cheapest way to each grammar state with its hash."""

    def __init__(self, conv_id):
        self.conv_id, self.begun = conv_id, False
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.first = self.last = None
        #: By state: cost, audit, running hash, and whether a row was written.
        self.ways = {"n": (0, "", hashlib.sha256(), False)}
        #: The last segment, hashed only when it is known where it leads.
        self.solved, self.rows = None, None

    def add(self, solved: dict, rows: dict) -> None:
        if self.solved:
            self.ways = {state: (cost, audit, *self._hash(began, edits)) for state, (cost, audit, began, edits) in self._ends().items()}
        self.begun, self.solved, self.rows = True, solved, rows
        for fault in rows["fault"]:
            if fault:
                self.counts[fault] += 1
        self.illegal += sum(rows["illegal"])
        self.turns += sum(rows["new_turn"])
        known = [t for t in rows["turn"] if t is not None]
        if known:
            self.first, self.last = (known[0] if self.first is None else self.first), known[-1]

    def _ends(self) -> dict:
        """For each state at the end of the last segment: cost, audit, the state where it began, and the segment's own audit."""
        best = {}
        for began, ends in self.solved.items():
            if began in self.ways:
                cost, audit = self.ways[began][:2]
                for state, end in zip(STATES, ends):
                    if end is not None and (state not in best or (cost + end["c"], audit + end["e"]) < best[state][:2]):
                        best[state] = (cost + end["c"], audit + end["e"], began, end["e"])
        return best

    def _hash(self, state: str, edits: str) -> tuple:
        _, _, digest, some = self.ways[state]
        digest, rows = digest.copy(), zip(self.rows["role"], self.rows["text"])
        for edit in edits:
            role, text = next(rows) if edit != "I" else ("", "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            digest.update(("\n" * some + f"{role}:{text}").encode())
            some = True
        return digest, some

    def result(self) -> tuple:
        if self.solved is None:
            return (self.conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
        tails = {"n": "", "s": "II", "u": "I", "a": ""}
        cost, audit, began, edits = min((cost + INSERT * len(tails[state]), audit + tails[state], began, edits + tails[state]) for state, (cost, audit, began, edits) in self._ends().items())
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, audit, self._hash(began, edits)[0].hexdigest())


def _segments(db, rows: pa.Table, keys: np.ndarray, fresh: list[bool]) -> dict:
    """The recursion's result for each segment: {began: its four states}, by segment number."""
    starts = np.flatnonzero(kit.run_starts(keys))
    fault = rows.column("fault")
    is_fault = lambda *names: pc.fill_null(pc.is_in(fault, pa.array(names)), False)
    turns = pa.table({
        "k": pa.array(keys), "pos": pa.array(np.arange(len(keys)) - starts[keys] + 1), "kind": pc.utf8_slice_codeunits(rows.column("role"), 0, 1),
        "must": is_fault("blank", "duplicate"), "pen": pc.if_else(is_fault("truncated"), TRUNCATED, 0),
    })
    sizes = pa.table({"k": pa.array(keys[starts]), "size": pa.array(np.diff(np.append(starts, len(keys))))})
    began = [(k, s) for k, new in enumerate(fresh) for s in (STATES[:1] if new else STATES)]
    begun = pa.table({"k": pa.array([k for k, _ in began], pa.int64()), "began": pa.array([s for _, s in began], pa.string())})
    for name, table in (("turns", turns), ("sizes", sizes), ("begun", begun)):
        db.register(name, table)
    found: dict[int, dict] = {}
    for k, start, *ends in db.execute(STEPS).fetchall():
        found.setdefault(k, {})[start] = ends
    return found


def _repair(segment: int):
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def emit(ended: list[_Run]) -> pa.RecordBatch:
        rows = [r.result() for r in ended]
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches):
        here = None
        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column("conv_id")
                edges = np.flatnonzero(kit.run_starts(np.asarray(pc.fill_null(ids, 0)).astype(np.int64), np.asarray(pc.is_null(ids))))
                runs = [_Run(c) for c in ids.take(pa.array(edges)).to_pylist()]
                if here is not None and here.conv_id == runs[0].conv_id:
                    runs[0] = here
                elif here is not None:
                    yield emit([here])
                alive = ~np.asarray(batch.column("gone"))
                owner = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, batch.num_rows)))[alive]
                if len(owner):
                    _feed(db, pa.table(batch).filter(pa.array(alive)), runs, owner, segment)
                here = runs[-1]
                if runs[:-1]:
                    yield emit(runs[:-1])
            if here is not None:
                yield emit([here])

    return run


def _feed(db, rows: pa.Table, runs: list[_Run], owner: np.ndarray, segment: int) -> None:
    """Cut the rows into segments, solve all of them at once, and hand each to its conversation in order."""
    within = np.arange(len(owner)) - np.searchsorted(owner, owner)
    heads = kit.run_starts(owner, within // segment)
    keys, starts = np.cumsum(heads) - 1, np.flatnonzero(heads)
    found = _segments(db, rows, keys, [within[a] == 0 and not runs[owner[a]].begun for a in starts])
    column = {n: rows.column(n).to_pylist() for n in ("role", "text", "fault", "illegal", "new_turn", "turn")}
    for k, (a, b) in enumerate(zip(starts.tolist(), np.append(starts[1:], len(owner)).tolist())):
        runs[owner[a]].add(found[k], {n: c[a:b] for n, c in column.items()})


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row a conversation of ``damaged`` rows: its faults, the cheapest repair and the hash of what it gives."""
    return judged(rows).mapInArrow(_repair(segment), SCHEMA)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(kit.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


SQL = f"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                         lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM conversations, bits
), harmed AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS again
  FROM hashed WHERE harm <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, seen) AS pos
  FROM (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
               row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM harmed)
), faulty AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY k ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), turns AS (
  SELECT k, CAST(pos AS INTEGER) AS pos, left(role, 1) AS kind, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS pen FROM faulty
), begun AS (SELECT DISTINCT k, 'n' AS began FROM turns),
{WALK}, ended AS (
  SELECT k, least(n, a, struct_pack(c := u.c + {INSERT}, e := u.e || 'I'), struct_pack(c := s.c + {2 * INSERT}, e := s.e || 'II')) AS best
  FROM walk WHERE (k, pos) IN (SELECT (k, max(pos)) FROM turns GROUP BY k)
), edits AS (
  SELECT k, i, edit, sum(CAST(edit <> 'I' AS INTEGER)) OVER w AS pos, sum(CAST(edit <> 'D' AS INTEGER)) OVER w AS place
  FROM (SELECT k, unnest(range(len(best.e))) AS i, unnest(string_split(best.e, '')) AS edit FROM ended WHERE best.e <> '')
  WINDOW w AS (PARTITION BY k ORDER BY i)
), lines AS (
  SELECT e.k, e.i, e.edit, f.text, f.role, e.place - max(CASE WHEN e.place = 1 AND e.edit = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.k) AS place
  FROM edits e LEFT JOIN faulty f ON f.k = e.k AND f.pos = e.pos AND e.edit <> 'I' WHERE e.edit <> 'D'
), mended AS (
  SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS all_lines
  FROM lines GROUP BY k
), counted AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY k
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(all_lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.k = coalesce(CAST(o.conv_id AS VARCHAR), ' ') LEFT JOIN ended e ON e.k = c.k LEFT JOIN mended m ON m.k = c.k
"""
