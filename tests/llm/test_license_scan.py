import hashlib
import re

from verbatrix.llm import license_scan


def plain(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    t = re.sub(r"^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|by\b|:)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$", "", t, flags=re.MULTILINE)
    t = " " + re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", t) + " "
    for a, b in license_scan.EQUIVALENT:
        t = t.replace(a, b)
    return re.sub(" +", " ", t).strip(" ")


def test_layout_does_not_matter(spark, odd, empty):
    mit, isc = license_scan.KNOWN[0][1], license_scan.KNOWN[1][1]
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    rows = [
        (1, f"MIT\n{mit}"), (2, "Copyright (c) 2020 Someone, Ltd.\nAll rights reserved.\n\n" + wrapped.upper()), (3, "# " + isc.replace(". ", " -- ")), (4, mit[:-20]),
        (5, "© 1999 X\n" + mit.replace("sublicense", "sub-licence").replace('"', "''")), (None, mit), (6, None), (7, " \n"), (7, mit + " and more"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = license_scan.known_licenses(spark)
    got = [(r.doc_id, r.license) for r in license_scan.scan(docs, known).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (2, "MIT"), (3, "ISC"), (4, None), (5, "MIT"), (None, "MIT"), (6, None), (7, None), (7, None)], key=str)
    table = {hashlib.sha256(plain(t).encode()).hexdigest(): n for n, t in license_scan.KNOWN}
    out = sorted(((r.doc_id, r.digest, r.license) for r in license_scan.scan(odd, known).collect()), key=str)
    digest = lambda t: hashlib.sha256(plain(t).encode()).hexdigest()
    assert out == sorted(((r.doc_id, digest(r.text), table.get(digest(r.text))) for r in odd.collect()), key=str)
    assert license_scan.scan(empty, known).count() == 0 and license_scan.scan(docs, known.limit(0)).filter("license is not null").count() == 0


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""


def test_whole_license_files_are_found(spark):
    """License files as they are: a title, holders without a year, typographic marks, and licenses that are known by digest only."""
    mit = license_scan.KNOWN[0][1]
    quoted = mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS IS\u201d")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Foo\n\n" + mit), (2, "Copyright Foo Inc.\n\n" + mit), (3, "The MIT License (MIT)\nCopyright Foo Inc.\nCopyright Bar\n" + mit), (4, quoted),
        (5, UNLICENSE), (6, "The Unlicense\n\n" + UNLICENSE.replace(" - ", " \u2014 ")), (7, mit.replace("The above copyright", "The above\ncopyright")), (8, mit + "\n\nCopyright notice: none"), (9, "MIT License"), (10, "Copyright Foo Inc."), (11, UNLICENSE[:-30]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(docs, license_scan.known_licenses(spark), license_scan.DIGESTS).collect()
    assert {r.doc_id: r.license for r in got} == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "Unlicense", 6: "Unlicense", 7: "MIT", 8: None, 9: None, 10: None, 11: None}
    assert all(r.digest == hashlib.sha256(plain(t).encode()).hexdigest() for r, (_, t) in zip(sorted(got), rows))
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0", "MIT", "ISC", "0BSD"} <= set(license_scan.DIGESTS.values())


def test_many_known_licenses(spark, monkeypatch):
    """Beyond the size that is broadcast the result is the same, also where many documents are one license."""
    from verbatrix.llm import kit

    mit = license_scan.KNOWN[0][1]
    docs = spark.createDataFrame([(i, mit if i % 3 else f"text {i}") for i in range(300)] + [(None, UNLICENSE), (7, None)], "doc_id long, text string")
    known = license_scan.known_licenses(spark)
    want = sorted(map(str, license_scan.scan(docs, known, license_scan.DIGESTS).collect()))
    monkeypatch.setattr(license_scan, "FEW_KNOWN", 0)
    keys = kit.hot_keys
    monkeypatch.setattr(kit, "hot_keys", lambda df, key, rows_each=50: keys(df, key, rows_each))
    many = license_scan.scan(docs, known, license_scan.DIGESTS)
    assert sorted(map(str, many.collect())) == want and "'MIT'" in str(want)
