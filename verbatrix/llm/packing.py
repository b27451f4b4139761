"""Harmonic packing of token sequences (operator 1).

Class k holds pieces of at most capacity / k ids, and a bin of class k takes exactly k of them, whatever they are. A
document is cut so that little of a slot stays empty: while its remainder would leave more than ``SLACK`` of its slot
unused, a piece that fills the next smaller slot is cut off; the rest goes on. Pieces of 64 ids or less always fit well.

Bins are filled independently by workers: a worker is a share of a class's pieces, dealt by hash, and numbers its pieces;
every k of them make a bin. What workers have left over, less than k pieces each and so a small part of their share, is dealt
out and filled the same way again, in as many turns as it takes until each class is with one worker. What these leave, less
than k pieces a class, is packed together by first fit; so many pieces a class do not grow with the data.

Sequences are padded to the capacity, unless their length is a power of two.

Ids come from a public tokenizer file, by distinct words: it drops white space, so a word's ids do not depend on its
neighbours, and each distinct word of a slice of texts is encoded once at most.

Defined cases: null and empty texts have one id, the end mark. A document of any length is cut into pieces; each id lies in
exactly one. Repeated rows are packed each; null ids stay null. An empty table gives an empty result. Extra columns are
ignored. Ties in order are between equal pieces only, so they do not matter.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END = 2
SLACK = 0.02
#: The least share of a class that a worker fills bins from, in pieces and in bins.
PIECES_PER_WORKER = 4096
BINS_PER_WORKER = 64
#: Words that a worker remembers, that are encoded as one text, and texts of them that are encoded at once.
REMEMBERED = 300_000
TOGETHER = 1000
AT_ONCE = 8
#: Bytes of text whose distinct words are encoded once.
SLICE = 4 << 20
#: What the vocabulary puts to the last token of a word.
WORD_END = "</w>"
#: Letters whose lower case is one letter and which no normalisation changes, and marks that the tokenizer does not tie to letters.
_LETTER, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", '.,;:!?)"-'
LETTERS, MARKED, PLAIN = f"^[{_LETTER}]+$", f"^[{_LETTER}]+[{MARKS}]+$", f"^([{_LETTER}]+|[{MARKS}]+)$"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, copy long"


def cut(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document of ``length`` ids."""
    out = []
    while length:
        k = capacity // length if length <= capacity else 0
        if k and length * k >= (1 - slack) * capacity:
            out.append((length, k))
            return out
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        length -= piece
    return out


def ends_of_words(tokenizer) -> np.ndarray:
    """True for ids that end a word of the tokenizer's own: their tokens carry the vocabulary's mark for it."""
    out = np.zeros(tokenizer.get_vocab_size(), bool)
    out[[i for token, i in tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
    return out


def _together(words: list[str], encode):
    """Ids of words joined by blanks, ``TOGETHER`` at a time, as that is cheaper than one by one; and each group's words."""
    groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
    for some in (groups[i : i + AT_ONCE] for i in range(0, len(groups), AT_ONCE)):
        yield from zip(some, encode([" ".join(g) for g in some], add_special_tokens=False))


def word_ids(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and how many each has; offsets tell whose an id is."""
    ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for group, encoded in _together(words, tokenizer.encode_batch):
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
        at = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded))
        ids.append(np.array(encoded.ids, np.uint32))
        counts.append(np.bincount(np.searchsorted(ends, at, "right"), minlength=len(group)))
    return np.concatenate(ids), np.concatenate(counts)


def plain_word_ids(tokenizer, words: list[str], is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_ids``, for words that are one word to the tokenizer too: its ends of words tell whose an id is, which takes no offsets."""
    ids = [np.empty(0, np.uint32), *(np.array(encoded.ids, np.uint32) for _, encoded in _together(words, tokenizer.encode_batch_fast))]
    flat = np.concatenate(ids)
    ends = np.flatnonzero(is_end[flat])
    return (flat, np.diff(ends, prepend=-1)) if len(ends) == len(words) else word_ids(tokenizer, words)


class WordIds:
    """Ids of distinct words. The first ``REMEMBERED`` that a worker meets, frequent ones among them, are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.is_end = ends_of_words(self.tokenizer)
        # The first word is the end mark.
        self.flat, self.sizes = np.array([END], np.uint32), np.ones(1, np.int64)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words in one array, how many each has, and which of them the given words are. The first is the end mark."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        fresh = pa.array([words[i] for i in new.tolist()], pa.string())
        plain = np.asarray(pc.match_substring_regex(fresh, PLAIN)) if len(new) else np.empty(0, bool)
        # Plain ones first.
        order = np.argsort(~plain, kind="stable")
        fresh = strings(fresh.take(pa.array(order)))
        n = int(plain.sum())
        found = [plain_word_ids(self.tokenizer, fresh[:n], self.is_end), word_ids(self.tokenizer, fresh[n:])]
        base = len(self.sizes)
        at[new[order]] = np.arange(base, base + len(new))
        flat, sizes = np.concatenate([self.flat, *(f[0] for f in found)]), np.concatenate([self.sizes, *(f[1] for f in found)])
        if len(self.known) < REMEMBERED:
            self.known.update(zip(fresh, range(base, base + len(fresh))))
            self.flat, self.sizes = flat, sizes
        return flat, sizes, at


def strings(array: pa.Array) -> list[str]:
    """As to_pylist, but far quicker."""
    return array.to_numpy(zero_copy_only=False).tolist()


def parts(words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of distinct words, and each word's first part and second one (-1 if none).

    A word of letters and a few marks after them is two words to the tokenizer, and so two parts; these letters, and words of
    letters only, are in lower case, as the tokenizer takes them anyway. All other words are one part.
    """
    two = np.asarray(pc.match_substring_regex(words, MARKED))
    lowered = two | np.asarray(pc.match_substring_regex(words, LETTERS))
    heads = pc.if_else(pa.array(lowered), pc.utf8_lower(pc.utf8_rtrim(words, MARKS)), words)
    marked = words.filter(pa.array(two))
    ends = pc.replace_substring_regex(marked, f"^[{_LETTER}]+", "")
    coded = pa.concat_arrays([heads, ends]).dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    second = np.full(len(words), -1)
    second[two] = code[len(words) :]
    return strings(coded.dictionary), code[: len(words)], second


def in_order(flat: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``code``, one after the other, and their numbers: words are binary values, which Arrow copies as they are."""
    ends = np.append(0, np.cumsum(sizes)) * flat.itemsize
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    taken = words.take(pa.array(code, pa.int64()))
    return np.frombuffer(taken.buffers()[2] or b"", flat.dtype)[: int(sizes[code].sum())], sizes[code]


@lru_cache(maxsize=1)
def worker_ids(path: str) -> WordIds:
    """One per worker process, whatever number of tasks it runs. A task has one core, so encoding takes one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def text_ids(texts: pa.Array, ids_of: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end mark, and where each text's ids start (one more entry than texts)."""
    words, offsets = kit.split_words(texts)
    coded = words.dictionary_encode()
    distinct, first, second = parts(coded.dictionary)
    flat, sizes, at = ids_of(distinct)
    # The end mark, of number 0, is one more word after each text.
    code = np.insert(np.asarray(coded.indices).astype(np.int64), offsets[1:], len(first))
    one, two = np.append(at[first], 0)[code], np.append(np.where(second < 0, -1, at[second]), -1)[code]
    more = np.flatnonzero(two >= 0)
    ids, size = in_order(flat, sizes, np.insert(one, more + 1, two[more]))
    marks = offsets[1:] + np.arange(len(texts))
    return ids, np.concatenate([[0], np.cumsum(size)[marks + np.searchsorted(more, marks)]])


def _pieces(path: str, capacity: int):
    def run(batches):
        ids_of = worker_ids(path)
        cuts: dict[int, list] = {}
        for batch in batches:
            for rows, texts in kit.text_slices(batch, most=SLICE):
                ids, bounds = text_ids(texts, ids_of)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                out = [[] for _ in range(6)]
                for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    n, start = b - a, 0
                    # Long documents share the cuts of what remains below a multiple of the capacity.
                    whole, rest = (n // capacity, n % capacity) if n > capacity else (0, n)
                    if rest not in cuts:
                        cuts[rest] = cut(rest, capacity)
                    for length, k in [(capacity, 1)] * whole + cuts[rest]:
                        at = a + start
                        for column, value in zip(out, (row, start, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), n, k)):
                            column.append(value)
                        start += length
                row, start, length, crc, n, k = (np.array(c, np.int64) for c in out)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, n)), pa.array(k.astype(np.int32)), rows.column("copy").take(pa.array(row))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "copy"],
                )

    return run


def _first_fit(capacity: int):
    """Pack the last pieces, longest first, each into the first bin with room."""

    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "copy"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        free, bins, offsets = np.empty(0, np.int64), [], []
        for length in pdf["length"].tolist():
            room = np.flatnonzero(free >= length)
            i = int(room[0]) if len(room) else len(free)
            if i == len(free):
                free = np.append(free, capacity)
            offsets.append(capacity - int(free[i]))
            bins.append(i)
            free[i] -= length
        pdf["bin"], pdf["offset"] = np.array(bins, np.int64), np.array(offsets, np.int64)
        return pdf

    return run


def sequence_number(k: Column, turn: Column, worker: Column, bin_number: Column) -> Column:
    """Tells class, turn, worker and bin apart, in so many bits each; a number that does not fit is an error, never another one's."""
    out = F.lit(0).cast("long")
    for value, bits in ((k, 13), (turn, 4), (worker, 30), (bin_number, 16)):
        fits = (value >= 0) & (value < F.lit(1 << bits))
        out = F.shiftleft(out, bits) + F.when(fits, value.cast("long")).otherwise(F.raise_error(F.lit(f"a number of {bits} bits is too large")).cast("long"))
    return out


def shares(counts: dict[int, int]) -> dict[int, int]:
    """How many workers each class has: as many as fill ``BINS_PER_WORKER`` bins or more each, so that they leave little over."""
    return {k: max(1, n // max(PIECES_PER_WORKER, BINS_PER_WORKER * k)) for k, n in counts.items()}


def pack(docs: DataFrame, held: kit.Durable, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class and sequence_length (with padding)."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("copy"))
    pieces = held.write(read.mapInArrow(kit.lean(_pieces(path, capacity)), PIECE), "pieces", small=True)
    order = ["doc_id", "start", "copy"]
    columns = [f.split()[0] for f in PIECE.split(", ")]

    left, full, turn, several = pieces, [], 0, True
    while several:
        # At most ``capacity`` rows.
        workers = shares({r["class"]: r["count"] for r in left.groupBy("class").count().collect()})
        several = any(n > 1 for n in workers.values())
        of_class = F.broadcast(spark.createDataFrame(sorted(workers.items()), "class int, workers long"))
        hashed = F.pmod(F.xxhash64("doc_id", "start", "copy", F.lit(turn)), F.col("workers"))
        w = Window.partitionBy("class", "worker")
        dealt = left.join(of_class, "class").withColumn("worker", hashed).withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("of", F.count("*").over(w))
        placed = dealt.withColumn("bin", F.floor(F.col("i") / F.col("class"))).withColumn("full", F.col("bin") < F.floor(F.col("of") / F.col("class")))
        placed = held.hold(placed.select(*columns, F.lit(turn).alias("turn"), "worker", "bin", "full"))
        full.append(placed.filter("full").drop("full"))
        left, turn = placed.filter("not full").select(*columns), turn + 1

    place = Window.partitionBy("class", "turn", "worker", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(place), F.lit(0)).alias("offset")
    number = sequence_number(F.col("class"), F.col("turn"), F.col("worker"), F.col("bin")).alias("sequence_id")
    harmonic = reduce(DataFrame.unionByName, full).select(*columns, offset, number)
    # Class 0 has first fit's bins.
    zero = F.lit(0)
    last = left.withColumn("one", zero).groupBy("one").applyInPandas(lambda pdf: _first_fit(capacity)(pdf)[[*columns, "offset", "bin"]], PIECE + ", offset long, bin long")
    packed = harmonic.unionByName(last.select(*columns, "offset", sequence_number(zero, zero, zero, F.col("bin")).alias("sequence_id")))
    filled = F.sum("length").over(Window.partitionBy("sequence_id"))
    power = F.bit_count(filled) == 1
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", F.when(power, filled).otherwise(F.lit(capacity)).cast("long").alias("sequence_length"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, kit.Durable(spark, "packing", docs), tokenizer_path())
