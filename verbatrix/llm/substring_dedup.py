"""Removal of repeated passages (operator 6): Rabin-Karp hashes of every 20-word window, counted in Spark.

1. Every window of every text is hashed. Its hash picks a bucket and a 32-bit key; buckets get packed arrays of keys, each
   with the text it came from, and find the keys that occur twice. Few keys agree by chance, as there are as many more
   buckets as the input is larger.
2. Only windows with such a key are hashed again, with two independent 64-bit hashes, and dealt out once more. Of equal
   windows the earliest (smaller doc_id, then earlier start) stays; the starts of all others are returned to their texts.
3. A text's starts merge into maximal intervals of words, which are removed.

A window that is common in one slice of texts is sent from there once, so that a passage in a third of all texts does not
flood one bucket. Two different windows pass as equal only if two 64-bit hashes agree.

Defined cases: a null text has no words, one with fewer words than a window loses nothing. Null ids sort after all others.
Rows that share a doc_id are judged together: a window starts earlier only at a smaller start, so exact repeats of a row
are treated alike and do not remove each other. Ids are expected to be keys otherwise. Extra columns are ignored, or kept
by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

WINDOW = 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: kind 0: windows for a bucket; kind 1: an answer that a slice could give by itself, passed through by the bucket of its texts.
MESSAGE = "bucket int, kind int, ids binary, tags binary, owner binary, key binary, key2 binary, start binary"
#: Answers for many texts in one row: how many found values each has, and all of them.
ANSWERS = "home int, ids binary, tags binary, counts binary, found binary"
FOUND = "id long, tag long, found binary"


def _message(bucket, kind, ids, tags, owner, key, key2, start) -> pa.RecordBatch:
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), ids, tags, owner, key, key2, start], names)


def _home(tags: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which a text's answers meet."""
    return (kit.mix(tags.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _answers(ids, tags, owner, found, buckets: int) -> tuple:
    """Packed answers, one entry per home of the texts: home, ids, tags, counts, found."""
    home = _home(tags, buckets)[owner]
    order = np.lexsort((owner, home))
    home, owner, found = home[order], owner[order], found[order]
    first = np.flatnonzero(kit.run_starts(home, owner))
    counts = np.diff(np.append(first, len(owner))).astype(np.uint32)
    who = owner[first]
    new = kit.run_starts(home)
    cuts, text_cuts = np.append(np.flatnonzero(new), len(owner)), np.append(np.flatnonzero(kit.run_starts(home[first])), len(who))
    return home[cuts[:-1]].astype(np.int32), kit.packed(ids[who], text_cuts), kit.packed(tags[who], text_cuts), kit.packed(counts, text_cuts), kit.packed(found, cuts)


def _pass_through(ids, tags, owner, found, buckets: int) -> pa.RecordBatch:
    home, a_ids, a_tags, counts, a_found = _answers(ids, tags, owner, found, buckets)
    none = kit.packed(np.empty(0, np.uint8), np.zeros(len(home) + 1, np.int64))
    return _message(home, np.ones(len(home), np.int32), a_ids, a_tags, counts, a_found, none, none)


def _bucketed(bucket, ids, tags, owner, key, key2, start) -> pa.RecordBatch:
    """kind 0 messages from windows sorted by bucket; each has the ids of the slice's texts that occur in it."""
    cuts = np.append(np.flatnonzero(kit.run_starts(bucket)), len(bucket))
    cell_ids, cell_tags, cell_owner = [], [], np.empty(len(owner), np.uint32)
    for a, b in zip(cuts[:-1], cuts[1:]):
        there, cell_owner[a:b] = np.unique(owner[a:b], return_inverse=True)
        cell_ids.append(ids[there].tobytes())
        cell_tags.append(tags[there].tobytes())
    n = len(cuts) - 1
    empty = kit.packed(np.empty(0, np.uint8), np.zeros(n + 1, np.int64))
    small = np.uint16 if len(ids) < 1 << 16 else np.uint32
    return _message(
        bucket[cuts[:-1]].astype(np.int32), np.zeros(n, np.int32), pa.array(cell_ids, pa.binary()), pa.array(cell_tags, pa.binary()),
        kit.packed(cell_owner.astype(small), cuts), kit.packed(key, cuts), empty if key2 is None else kit.packed(key2, cuts), empty if start is None else kit.packed(start, cuts),
    )


def _hashed(texts: pa.Array, width: int, bases) -> tuple:
    words, offsets = kit.split_words(texts)
    starts, owner = kit.window_starts(offsets, width)
    base = kit.word_hashes(words) if len(starts) else np.empty(0, np.uint64)
    rolls = [kit.mix(kit.Rolling(b, width)(base, starts)) if len(starts) else base for b in bases]
    return starts - offsets[:-1][owner], owner, rolls


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, key in the lower half."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _send_keys(width: int, buckets: int):
    def run(batches):
        for batch in batches:
            for rows, texts in kit.text_slices(batch):
                _, owner, (h,) = _hashed(texts, width, BASES[:1])
                if not len(h):
                    continue
                ids, tags = kit.filled_ids(rows.column("id")), kit.filled_ids(rows.column("tag"))
                codes = _codes(h, buckets)
                order = np.argsort(codes, kind="stable")
                codes, owner = codes[order], owner[order]
                first = kit.run_starts(codes)
                again = ~first
                again[:-1] |= ~first[1:]
                if again.any():
                    yield _pass_through(ids, tags, owner[again], codes[again], buckets)
                yield _bucketed((codes[first] >> np.uint64(32)).astype(np.int64), ids, tags, owner[first], codes[first].astype(np.uint32), None, None)

    return run


def _gather(group: pa.Table, dtype) -> tuple:
    """Windows of all kind 0 messages of a bucket: message-wide arrays with owners counted through."""
    group = group.filter(pc.equal(group.column("kind"), 0))
    ids, n_ids = kit.unpacked(group.column("ids"), np.int64)
    tags, _ = kit.unpacked(group.column("tags"), np.int64)
    key, n_keys = kit.unpacked(group.column("key"), dtype)
    owner = np.concatenate([np.frombuffer(o, np.uint16 if len(o) == 2 * n else np.uint32).astype(np.int64) for o, n in zip(group.column("owner").to_pylist(), n_keys)] or [np.empty(0, np.int64)])
    return ids, tags, owner + np.repeat(np.cumsum(n_ids) - n_ids, n_keys), key, group


def _direct(group: pa.Table) -> pa.Table:
    """The answers that only pass through."""
    done = group.filter(pc.equal(group.column("kind"), 1))
    columns = {"home": "bucket", "ids": "ids", "tags": "tags", "counts": "owner", "found": "key"}
    return pa.table({to: done.column(at) for to, at in columns.items()})


def _answer_table(*answers) -> pa.Table:
    return pa.table(dict(zip(("home", "ids", "tags", "counts", "found"), map(pa.chunked_array, ([a] if isinstance(a, pa.Array) else [pa.array(a)] for a in answers)))))


def _repeated_keys(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        ids, tags, owner, key, _ = _gather(group, np.uint32)
        out = _direct(group)
        if not len(key):
            return out
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        again = ~kit.run_starts(key)
        again[:-1] |= again[1:]
        bucket = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(32)
        return pa.concat_tables([out, _answer_table(*_answers(ids, tags, owner[again], key[again].astype(np.uint64) | bucket, buckets))])

    return run


def _by_text(dtype):
    """The answers of one home, a row per text."""

    def run(group: pa.Table) -> pa.Table:
        ids, _ = kit.unpacked(group.column("ids"), np.int64)
        tags, _ = kit.unpacked(group.column("tags"), np.int64)
        counts, _ = kit.unpacked(group.column("counts"), np.uint32)
        found, _ = kit.unpacked(group.column("found"), dtype)
        order = np.lexsort((tags, ids))
        new = kit.run_starts(ids[order], tags[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        owner = np.repeat(number, counts)
        by_owner = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_owner], np.arange(new.sum() + 1))
        texts = order[new]
        return pa.table({"id": pa.array(ids[texts]), "tag": pa.array(tags[texts]), "found": kit.packed(found[by_owner], cuts)})

    return run


def _join_found(batch: pa.RecordBatch, dtype) -> list[np.ndarray]:
    return [np.frombuffer(cell or b"", dtype) for cell in batch.column("found").to_pylist()]


def _send_windows(width: int, buckets: int):
    def run(batches):
        for batch in batches:
            for rows, texts in kit.text_slices(batch):
                start, owner, (h, g) = _hashed(texts, width, BASES)
                ids, tags = kit.filled_ids(rows.column("id")), kit.filled_ids(rows.column("tag"))
                codes, wanted = _codes(h, buckets), np.zeros(len(h), bool)
                cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
                for i, found in enumerate(_join_found(rows, np.uint64)):
                    if len(found) and cuts[i + 1] > cuts[i]:
                        wanted[cuts[i] : cuts[i + 1]] = np.isin(codes[cuts[i] : cuts[i + 1]], found)
                if not wanted.any():
                    continue
                start, owner, h, g = start[wanted], owner[wanted], h[wanted], g[wanted]
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((start, ids[owner], g, h, bucket))
                start, owner, h, g, bucket = start[order], owner[order], h[order], g[order], bucket[order]
                first = kit.run_starts(bucket, h, g)
                later = _later(first, ids[owner], start)
                if later.any():
                    yield _pass_through(ids, tags, owner[later], start[later].astype(np.uint32), buckets)
                # Besides the first, windows that tie with it (the same id and start) go on too: they may fall to an earlier one elsewhere.
                send = ~later
                yield _bucketed(bucket[send], ids, tags, owner[send], h[send], g[send], start[send].astype(np.uint32))

    return run


def _later(first: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Among windows sorted so that the earliest of each group is its first: which start later than that one."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return (ids != ids[head]) | (start != start[head])


def _later_windows(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        ids, tags, owner, h, kept = _gather(group, np.uint64)
        out = _direct(group)
        if not len(h):
            return out
        g, start = kit.unpacked(kept.column("key2"), np.uint64)[0], kit.unpacked(kept.column("start"), np.uint32)[0]
        order = np.lexsort((start, ids[owner], g, h))
        owner, start = owner[order], start[order]
        later = _later(kit.run_starts(h[order], g[order]), ids[owner], start)
        return pa.concat_tables([out, _answer_table(*_answers(ids, tags, owner[later], start[later], buckets))])

    return run


def _keyed(docs: DataFrame) -> list:
    return [kit.doc_key().alias("id"), F.xxhash64("text").alias("tag")]


def repeated_starts(docs: DataFrame, held: kit.Durable, width: int = WINDOW) -> DataFrame:
    """id, tag, found: for each text that has any, packed starts of the windows that also start earlier."""
    texts = docs.select(*_keyed(docs), "text").filter("text is not null")
    buckets = kit.buckets_for(docs)

    def answered(messages: DataFrame, judge, dtype) -> DataFrame:
        return messages.groupBy("bucket").applyInArrow(kit.lean_group(judge(buckets)), ANSWERS).groupBy("home").applyInArrow(kit.lean_group(_by_text(dtype)), FOUND)

    # No name is kept for what is only read once: a live plan keeps its shuffle files.
    with kit.small_batches(docs.sparkSession):
        keys = held.write(answered(texts.mapInArrow(kit.lean(_send_keys(width, buckets)), MESSAGE), _repeated_keys, np.uint64), "keys")
        held.forget_shuffles()
        starts = held.write(answered(texts.join(keys, ["id", "tag"]).mapInArrow(kit.lean(_send_windows(width, buckets)), MESSAGE), _later_windows, np.uint32), "starts")
    held.drop("keys")
    held.forget_shuffles()
    return starts


def intervals(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals [from, to) that windows at ``starts`` cover, one per row."""
    starts = np.unique(starts.astype(np.int64))
    if not len(starts):
        return np.empty((0, 2), np.int64)
    new = np.append(True, starts[1:] > starts[:-1] + width)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.stack([starts[new], starts[last] + width], axis=1)


def _digest(width: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), _join_found(batch, np.uint32)):
                words, gone = (text or "").encode().split(), 0
                n_words.append(len(words))
                for a, b in intervals(found, width)[::-1].tolist():
                    del words[a:b]
                    gone += b - a
                n_removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def cut_text(text: str, spans: np.ndarray) -> str:
    """The text without the words in ``spans``; each removed run takes the blanks after it along."""
    if not len(spans):
        return text
    raw = np.frombuffer(text.encode(), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    begins = np.append(begins, len(raw))
    keep = np.ones(len(raw), bool)
    for a, b in spans.tolist():
        keep[begins[a] : begins[b]] = False
    return raw[keep].tobytes().decode()


def _cut(width: int):
    def run(batches):
        for batch in batches:
            texts = [None if t is None else cut_text(t, intervals(f, width)) for t, f in zip(batch.column("text").to_pylist(), _join_found(batch, np.uint32))]
            new = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield new.select([n for n in batch.schema.names if n != "found"])

    return run


def _with_starts(docs: DataFrame, starts: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of docs, and found; the key columns are named apart from whatever docs has."""
    there = starts.select(F.col("id").alias("__vx_id"), F.col("tag").alias("__vx_tag"), "found")
    own = docs.select(*columns, kit.doc_key().alias("__vx_id"), F.xxhash64("text").alias("__vx_tag"))
    return own.join(there, ["__vx_id", "__vx_tag"], "left").select(*columns, "found")


def digests(docs: DataFrame, held: kit.Durable, width: int = WINDOW) -> DataFrame:
    starts = repeated_starts(docs, held, width)
    return _with_starts(docs, starts, ["doc_id", "text"]).mapInArrow(kit.lean(_digest(width)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, held: kit.Durable, width: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut from text; n_chars, if there, is counted anew. Other columns stay."""
    starts = repeated_starts(docs, held, width)
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed_rest = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in other]).alias("rest")) if other else docs.select("doc_id", "text")
    columns = packed_rest.columns
    cut = _with_starts(packed_rest, starts, columns).mapInArrow(kit.lean(_cut(width)), packed_rest.schema)
    value = {"doc_id": F.col("doc_id"), "text": F.col("text"), **{c: F.col("rest").getField(c) for c in other}}
    if "n_chars" in value:
        value["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[value[c].alias(c) for c in docs.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, kit.Durable(spark, "substring-dedup", docs))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, s + j AS pos FROM r, (SELECT unnest(range(20)) AS j)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
y AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""
