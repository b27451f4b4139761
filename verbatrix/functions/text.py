"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() takes for white space, spelled out; \s of the JVM's regular expressions is less.
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
HASH_LENGTH = 12
#: Elements of an array that a scan takes at a time.
SCAN_BLOCK = 128
SHINGLE = 40
#: Characters whose windows are cut out of one piece.
BLOCK = 256
DUPLICATE = 0.85

# The words that searching leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "did", "do",
    "does", "for", "from", "had", "has", "have", "how", "i", "if", "in", "into",
    "is", "it", "its", "just", "much", "of", "on", "or", "our", "s", "so",
    "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "to", "was", "we", "were", "what", "when", "where", "which", "who", "will",
    "with", "would", "you", "your",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; case stays."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"(?s)\A{SPACE}+|{SPACE}+\z", "")


def short_hash(identity: Column) -> Column:
    return F.substring(F.sha2(identity, 256), 1, HASH_LENGTH)


def block_id(doc_id: Column, block_type: Column, identity: Column, occurrence: Column) -> Column:
    suffix = F.when(occurrence > 1, F.concat(F.lit("#"), occurrence.cast("string"))).otherwise(F.lit(""))
    return F.concat(doc_id, F.lit("/"), block_type, F.lit("/"), short_hash(identity), suffix)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, without stop words; other letters end a token."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def term_counts(found: Column) -> Column:
    """array<struct<term,tf>>: the distinct elements of an array of strings and how often each is there, in order; empty if there is none.

    Equal elements stand together once the array is sorted, so a count is the way from one start of a run to the next.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        counted = lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s))), lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).cast("long").alias("tf")))
        return F.when(F.size(s) > 0, let(starts, counted))

    return F.coalesce(let(F.sort_array(found), runs), F.array().cast("array<struct<term:string,tf:bigint>>"))


def char_shingles(text: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of the distinct character windows of the collapsed, lower-case text; none if it is shorter than one.

    The text is cut into blocks first: a substring by position is found by scanning from the start.
    """
    of_block = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (width - 1)), lambda i: F.xxhash64(F.substring(b, i, F.lit(width))))
    blocks = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (width - 1), F.lit(BLOCK)), lambda i: F.substring(t, i, F.lit(BLOCK + width - 1)))
    spread = lambda t: F.when(F.length(t) >= width, F.array_distinct(F.flatten(F.transform(blocks(t), of_block))))
    return F.coalesce(let(F.lower(collapse(text)), spread), F.array().cast("array<bigint>"))


def overlap_of(a: Column, b: Column) -> Column:
    """Shared shingles as a share of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column, width: int = SHINGLE) -> Column:
    return overlap_of(char_shingles(a, width), char_shingles(b, width))


def scanned(values: Column, combine, zero: Column) -> Column:
    """For each element what ``combine`` makes of all up to it; combine must be associative, with ``zero`` as its neutral element.

    Arrays cannot be appended to in place, so the scan runs in blocks: within each by itself, from what those before come to.
    """

    def within(block: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.slice(block, 1, 0).alias("out"))
        step = lambda acc, x: let(combine(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))
        return F.aggregate(block, start, step)

    def whole(all_values: Column) -> Column:
        cut = lambda i: F.slice(all_values, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / SCAN_BLOCK).cast("int")), cut)

        def joined(b: Column) -> Column:
            totals = F.transform(b, lambda block: F.aggregate(block, zero, combine))
            carried = let(within(totals, zero)["out"], lambda ends: F.concat(F.array(zero), F.slice(ends, 1, F.size(ends) - 1)))
            return F.flatten(F.zip_with(b, carried, lambda block, carry: within(block, carry)["out"]))

        return F.when(F.size(all_values) > 0, let(blocks, joined)).otherwise(F.slice(all_values, 1, 0))

    return let(values, whole)


def match_parts(text: Column, pattern: str) -> Column:
    """array<struct<gap,hit>>: the text before each match of a pattern without groups, and the match; what follows the last has no hit."""
    t = F.coalesce(text, F.lit(""))
    return F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias("hit"))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern without groups, as array<struct<start,end,match>>; offsets count code points from 0.

    The text between matches comes from splitting at them, so offsets follow from lengths.
    """

    def spans(parts: Column) -> Column:
        hits = F.filter(parts, lambda p: p["hit"].isNotNull())
        ends = lambda h: scanned(F.transform(h, lambda p: F.length(p["gap"]) + F.length(p["hit"])), lambda a, b: a + b, F.lit(0))
        made = lambda h: F.zip_with(h, ends(h), lambda p, end: F.struct((end - F.length(p["hit"])).alias("start"), end.alias("end"), p["hit"].alias("match")))
        return let(hits, made)

    return let(match_parts(text, pattern), spans)
