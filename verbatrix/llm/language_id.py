"""Language identification by rank-order profiles (operator 7).

A language's profile lists its most frequent character n-grams (one to three characters, words padded with a blank on
either side) in order. A text is compared by its own most frequent n-grams: each counts how far its rank is from its
rank in the profile, or the profile's length if it is not there; the language with the least sum wins.

Profiles are fitted on a bounded sample: up to ``PER_LANGUAGE`` whole training texts of each language, those of the least
hash of their id. Prediction reads every text whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. If nothing can be learned, every text is
``und``. Training texts that are null or whose language is null are left out. Equal distances go to the lesser language
code, equal counts to the lesser n-gram. Repeated rows are judged one by one. A null id belongs to no training set and is
not held out. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

FOLDS = 4
HELD_OUT = 2
PROFILE = 400
SIZES = (1, 2, 3)
PER_LANGUAGE = 400
#: The ids of the sample are broadcast up to so many rows.
FEW = 1_000_000
#: Bytes of text whose n-grams are numbered together.
SLICE = 2 << 20
BLANK = 32


def _dense(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 for values below ``bound``, in their order, and the distinct values."""
    if bound > 1 << 24:
        values, numbers = np.unique(codes, return_inverse=True)
        return numbers, values
    there = np.bincount(codes, minlength=1) > 0
    values = np.flatnonzero(there)
    number = np.cumsum(there) - 1
    return number[codes], values


def gram_counts(texts: pa.Array):
    """The codes of all n-grams of these texts; then for each text the numbers of its n-grams, and their counts.

    A code holds an n-gram's characters, 21 bits each. Every character of a word has a trigram around it, with a blank
    beyond the word's ends, a pair with what follows, and the first one a pair with the blank before.
    """
    strings = pc.utf8_lower(texts).to_pylist()
    points = np.frombuffer(f" {' '.join(strings)} ".encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    blank = (points == BLANK) | ((points >= 9) & (points <= 13))
    at = np.flatnonzero(~blank)
    bounds = np.searchsorted(at, np.append(begins, len(points)))
    chars = np.where(blank, np.uint32(BLANK), points).astype(np.int64)
    char, alphabet = _dense(chars, int(chars.max()) + 1)
    size = len(alphabet)
    before, here, after = char[at - 1], char[at], char[at + 1]
    opening = np.flatnonzero(blank[at - 1])
    pair, pairs = _dense(np.concatenate([here * size + after, before[opening] * size + here[opening]]), size * size)
    # Numbers for pairs within trigrams: what precedes is a pair too.
    lead, leads = _dense(before * size + here, size * size)
    triple, triples = _dense(lead * size + after, len(leads) * size)
    letter = lambda i: alphabet[i].astype(np.uint64)
    shift = np.uint64(21)
    of_pair = lambda p: letter(p // size) << shift | letter(p % size)
    codes = np.concatenate([letter(np.arange(size)), of_pair(pairs), of_pair(leads[triples // size]) << shift | letter(triples % size)])
    second, third = pair + size, triple + size + len(pairs)
    yield codes
    first_words = np.searchsorted(opening, bounds)
    n = len(at)
    for i in range(len(strings)):
        a, b = bounds[i], bounds[i + 1]
        ids = np.concatenate([here[a:b], second[a:b], second[n + first_words[i] : n + first_words[i + 1]], third[a:b]])
        if 4 * len(ids) > len(codes):
            total = np.bincount(ids, minlength=len(codes))
            seen = np.flatnonzero(total)
            yield seen, total[seen]
        else:
            yield np.unique(ids, return_counts=True)


def _text_profiles(texts: pa.Array):
    """For each text: the codes of its most frequent n-grams in order."""
    found = gram_counts(texts)
    codes = next(found)
    for seen, total in found:
        if len(total) > PROFILE:  # only what can be among the first, with all that tie with the last of them
            top = total >= np.partition(total, -PROFILE)[-PROFILE]
            seen, total = seen[top], total[top]
        own = codes[seen]
        yield own[np.lexsort((own, -total))[:PROFILE]]


def _train(batches):
    """lang, gram, n: n-gram counts of each language in a partition."""
    totals: dict[str, dict[int, int]] = {}
    for batch in batches:
        for rows, texts in kit.text_slices(batch, most=SLICE):
            found = gram_counts(texts)
            codes = next(found)
            sums: dict[str, np.ndarray] = {}
            for lang, (seen, total) in zip(rows.column("lang").to_pylist(), found):
                np.add.at(sums.setdefault(lang, np.zeros(len(codes), np.int64)), seen, total)
            for lang, total in sums.items():
                own = totals.setdefault(lang, {})
                for i in np.flatnonzero(total).tolist():
                    own[int(codes[i])] = own.get(int(codes[i]), 0) + int(total[i])
    for lang, own in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(np.fromiter(own, np.uint64).view(np.int64)), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def profiles(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """The ranked n-grams of each language. What reaches the driver is ``PROFILE`` numbers a language."""
    usable = docs.filter("lang is not null and text is not null and doc_id is not null").filter(kit.hash_fold("doc_id", FOLDS) != HELD_OUT)
    chosen = kit.least_hashed(usable.select("doc_id", "lang"), "lang", "doc_id", per_language).distinct()
    if chosen.count() <= FEW:
        chosen = F.broadcast(chosen)
    sample = usable.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
    counts = sample.select("lang", "text").mapInArrow(kit.lean(_train), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= PROFILE)
    out: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "r").select("lang", "gram").collect():
        out.setdefault(row.lang, []).append(row.gram)
    return out


def _predict(learned: dict[str, list[int]]):
    langs = sorted(learned)

    def run(batches):
        grams = sorted({g for p in learned.values() for g in p})
        known = np.array(grams, np.int64).view(np.uint64)
        rank = np.full((len(known) + 1, max(len(langs), 1)), -1, np.int64)
        for j, lang in enumerate(langs):
            for r, g in enumerate(learned[lang]):
                rank[int(np.searchsorted(known, np.uint64(g & (2**64 - 1)))), j] = r
        for batch in batches:
            for rows, texts in kit.text_slices(batch, most=SLICE):
                lettered = np.asarray(pc.match_substring_regex(texts, r"\pL").fill_null(False))
                pred, score = [], []
                for ok, codes in zip(lettered.tolist(), _text_profiles(texts)):
                    if not ok or not langs or not len(codes):
                        pred.append("und"), score.append(0.0)
                        continue
                    at = np.searchsorted(known, codes)
                    at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != codes)] = len(known)
                    there = rank[at]
                    away = np.where(there < 0, PROFILE, np.abs(there - np.arange(len(codes))[:, None])).sum(axis=0)
                    best = int(np.argmin(away))
                    pred.append(langs[best]), score.append(1.0 - float(away[best]) / (PROFILE * len(codes)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learned: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(kit.hash_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return read.mapInArrow(kit.lean(_predict(learned)), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, profiles(docs))
