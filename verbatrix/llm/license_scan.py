"""License scan by canonical digests (operator 4).

A text is brought to a canonical form: ASCII letters in lower case, copyright lines taken out, punctuation and white space
as single blanks, equivalent spellings as one. The digest of the whole form is joined to the digests of known licenses. So
a text is found if all of it is a license, whatever its layout, case, punctuation and copyright holder are.

A text that is not found so is looked up by its loose form, in which typographic quotes, dashes and blanks are punctuation
too, and copyright lines that only name a holder are taken out: those at the top, below a title at most, and those that are
a paragraph of their own. ``license_digests`` holds digests of loose forms of the common full licenses, each with and without
its title and with and without what follows its terms. The column ``digest`` is of the canonical form always.

Up to ``FEW_KNOWN`` known licenses are broadcast; more are met by digests that are shuffled, where the digest of a text that
many documents have is dealt into parts. Texts are never shuffled.

Defined cases: null, empty and blank texts have an empty form and no license. Repeated rows and null ids are judged one by
one. Of known licenses with one form the name that sorts first counts. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit
from .license_digests import DIGESTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|by\b|:)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
NOT_WORDS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Spellings that mean the same, in canonical form.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"),
    ("favour", "favor"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("judgement", "judgment"), ("per cent", "percent"), ("http ", "https "),
)
FEW_KNOWN = 10_000
#: Quotes, dashes, blanks, bullets and the like that are not ASCII.
MARKS = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2032\u2033\u00ab\u00bb\u2039\u203a\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00ad\u2026\u2022\u00b7\u00a0\u2002\u2003\u2009\u200b\u202f\u3000\ufeff"
_NAMED = r"[^a-z0-9\n]*copyright[ \t]+(?!(?:notice|holder|owner|law|license|permission|statement|protection|treat|interest|and|or|in|on|of|the|to|is|as|for)[a-z]*\b)[^\n]*"
_BLANK = r"[^a-z0-9\n]*(?:\n|\z)"
#: Lines that name a holder without a year: at the top, below a title at most, or as a paragraph of their own.
HOLDER_LINES = (rf"\A((?:{_BLANK})*(?:[^\n]*licen[sc]e[^\n]*\n)?(?:[^a-z0-9\n]*\n)*)(?:{_NAMED}(?:\n|\z))+", rf"(\n[^a-z0-9\n]*\n)(?:{_NAMED}(?:\n|\z))+(?={_BLANK})")

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Short license texts in wide use; others come with the ``known`` argument.
KNOWN = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS,
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_AS_IS),
)


def canonical(text: Column) -> Column:
    """The form of a text that its digest is made of."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), NOT_WORDS, " "), F.lit(" "))
    for spelling, same in EQUIVALENT:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return F.trim(F.regexp_replace(out, " +", " "))


def loose(text: Column) -> Column:
    """The form of a text in which it is looked up if its canonical form is unknown."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER + MARKS, LOWER + " " * len(MARKS))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for lines in HOLDER_LINES:
        out = F.regexp_replace(out, lines, "$1\n")
    return canonical(out)


def scan(docs: DataFrame, known: DataFrame, registered: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest and license (null if the text is none) of every document. known: name, text. registered: names by digests of loose forms."""
    forms = known.select("name", canonical(F.col("text")).alias("form")).filter("form <> ''")
    table = forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("name").alias("license"))
    more = known.select(F.col("name"), loose(F.col("text")).alias("form")).filter("form <> ''").select(F.sha2("form", 256).alias("loose"), "name")
    if registered:
        more = more.unionByName(docs.sparkSession.createDataFrame(sorted(registered.items()), "loose string, name string"))
    more = more.groupBy("loose").agg(F.min("name").alias("by_loose"))
    own = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.sha2(loose(F.col("text")), 256).alias("loose"))
    # Digests of licenses are at most so many rows of each kind as there are names.
    few = known.limit(FEW_KNOWN + 1).count() + len(registered or {}) <= FEW_KNOWN
    meet = (lambda df, names, key: df.join(F.broadcast(names), key, "left")) if few else (lambda df, names, key: kit.spread_join(df, names, key, ["doc_id"], "left"))
    found = meet(meet(own, table, "digest"), more, "loose")
    return found.select("doc_id", "digest", F.coalesce("license", "by_loose").alias("license"))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "name string, text string")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(kit.table(spark, sf_dir, "documents").select("doc_id", "text"), known_licenses(spark), DIGESTS)


def _sql_form(column: str) -> str:
    out = f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"
    out = f"' ' || regexp_replace(regexp_replace({out}, '{COPYRIGHT_LINE}', '', 'g'), '{NOT_WORDS}', ' ', 'g') || ' '"
    for spelling, same in EQUIVALENT:
        out = f"replace({out}, '{spelling}', '{same}')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_ROWS = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
SQL = f"""
WITH known AS (SELECT sha256({_sql_form("t")}) AS digest, min(name) AS license FROM (VALUES {_ROWS}) AS k(name, t) GROUP BY 1)
SELECT doc_id, digest, license FROM (SELECT doc_id, sha256({_sql_form("text")}) AS digest FROM documents) LEFT JOIN known USING (digest)
"""
