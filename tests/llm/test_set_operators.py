"""Near duplicates, passages, mixing, packing, urls, vectors: against plain Python, and on odd input."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.llm import components, jaccard_join, kit, mixing, packing, substring_dedup, url_filter, vector_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_texts(seed=0, groups=12, size=60):
    """Groups of edited copies, with exact copies, texts that share a passage, and short ones."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary, 40))
    out = []
    for g in range(groups):
        base = list(rng.choice(vocabulary, size))
        for _ in range(int(rng.integers(1, 7))):
            words = list(base)
            for at in rng.integers(0, size, int(rng.integers(0, 4))):
                words[at] = str(rng.choice(vocabulary))
            out.append(" ".join(words) + (" " + shared if g % 3 == 0 else ""))
        out.append(out[-1].upper())
    return out + ["a b", "A  b", "a b c", "", "a b c d e", "A B C D E"]


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """doc_id -> (set size, smallest linked id), from all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_match_brute_force(spark, held, seed):
    rows = list(enumerate(near_texts(seed)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), held).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


@pytest.mark.parametrize("tile_keys", [jaccard_join.TILE_KEYS, 150])
def test_all_links_are_counted(spark, held, monkeypatch, tile_keys):
    """Each component has the number of all its links, between equal and between similar texts, however it is dealt into tiles."""
    monkeypatch.setattr(jaccard_join, "TILE_KEYS", tile_keys)
    monkeypatch.setattr(jaccard_join, "KEYS_AT_ONCE", 64)
    rows = list(enumerate(near_texts(2)))
    component = {i: c for i, (_, c) in brute_components(rows).items()}
    want = dict.fromkeys(component.values(), 0)
    for (i, a), (_, b) in combinations([(i, shingle_set(t)) for i, t in rows], 2):
        want[component[i]] += bool(a and b and 100 * len(a & b) >= 80 * len(a | b))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), held).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (c, want[c]) for i, c in component.items()}
    assert max(want.values()) >= 10


def test_hot_shingles_and_groups_are_dealt_out(spark, held, monkeypatch):
    """The same result where every key counts as hot."""
    keys = kit.hot_keys
    monkeypatch.setattr(kit, "hot_keys", lambda df, key, rows_each=2: keys(df, key, 2))
    rows = list(enumerate(near_texts(3)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), held).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_near_duplicates_on_documents(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = jaccard_join.op10_jaccard_join(spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_near_duplicates_on_odd_input(spark, held, odd, empty):
    got = jaccard_join.near_duplicates(odd, held).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6} and all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert jaccard_join.near_duplicates(empty, kit.Durable(spark, "t")).count() == 0
    kept = jaccard_join.keep_one(odd, kit.Durable(spark, "t"))
    assert kept.schema == odd.schema
    texts = [r.text for r in kept.collect() if shingle_set(r.text)]
    assert len(texts) == len(set(texts)) and not any(r.doc_id == 7 for r in kept.collect())
    assert kept.filter("text is null").count() == odd.filter("text is null").count()
    assert jaccard_join.keep_one(empty, kit.Durable(spark, "t")).count() == 0


def test_components_of_a_long_path(spark, held):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in components.components(edges, held).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0), held).count() == 0


def brute_removal(rows, width):
    """(id, text) -> positions removed: windows whose words start earlier in another place."""
    places = defaultdict(list)
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - width + 1):
            places[tuple(w[s : s + width])].append((kit.NULL_ID if i is None else i, s))
    out = []
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for s in range(len(w) - width + 1):
            if min(places[tuple(w[s : s + width])]) < (kit.NULL_ID if i is None else i, s):
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    shared = [list(rng.choice(words, n)) for n in (5, 9, 25)]
    rows = []
    for i in range(40):
        body = list(rng.choice(words, int(rng.integers(0, 60))))
        for s in rng.integers(0, 3, int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = shared[s]
        rows.append((int(rng.integers(0, 1000)) if i else 500, "  ".join(body)))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("seed, width", [(0, 4), (1, 4), (2, 20)])
def test_removal_matches_brute_force(spark, held, seed, width):
    rows = passages(seed)
    got = substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), held, width).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows, width)


def test_removal_across_slices(spark, held, monkeypatch):
    """The same, with a slice for each text, so that nothing is answered locally."""
    rows = passages(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = substring_dedup.digests(docs, held, 4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows, 4)


def test_removal_on_odd_input(spark, held, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = substring_dedup.digests(odd, held).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows, 20)
    cut = substring_dedup.without_repeats(odd, kit.Durable(spark, "t"))
    assert cut.schema == odd.schema and cut.count() == odd.count()
    for r in cut.collect():
        assert r.text is None or r.n_chars == len(r.text)
    assert substring_dedup.without_repeats(empty, kit.Durable(spark, "t")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab \n\t\x1cé\U0001f600", max_size=60), st.lists(st.integers(0, 20), max_size=6))
def test_cut_text_keeps_the_other_words(text, starts):
    words = WORD.findall(text)
    starts = [s for s in starts if s + 3 <= len(words)]
    spans = substring_dedup.intervals(np.array(starts, np.int64), 3)
    gone = {k for s in starts for k in range(s, s + 3)}
    assert {k for a, b in spans.tolist() for k in range(a, b)} == gone
    assert WORD.findall(substring_dedup.cut_text(text, spans)) == [w for k, w in enumerate(words) if k not in gone]
    assert all(b < c for (_, b), (c, _) in zip(spans.tolist(), spans.tolist()[1:]))


def test_targets_stop_at_three_times(spark):
    sizes = {"a": 10, "b": 1000, "c": 10, None: 500}
    got = mixing.targets(sizes)
    assert got["a"] == 30 and sum(got.values()) <= sum(sizes.values()) and all(got[s] <= 3 * sizes[s] for s in sizes)
    left = Fraction(1520 - 30)
    rest = {"b": 2, "c": 1, None: 5}
    assert got["c"] == 30 and got["b"] == (left - 30) * rest["b"] / 7 and got[None] == (left - 30) * rest[None] / 7
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def brute_route(patterns, quotas, costs=(0, 1, 3)):
    """The cheapest largest flow by trying all integer amounts (small cases)."""
    from itertools import product

    names = list(patterns)
    options = []
    for p in names:
        most = len(costs) * patterns[p]
        options.append([x for x in product(range(most + 1), repeat=len(p)) if sum(x) <= most])
    best = None
    for choice in product(*options):
        load = defaultdict(int)
        for p, x in zip(names, choice):
            for s, v in zip(p, x):
                load[s] += v
        if any(load[s] > quotas[s] for s in load):
            continue
        cost = 0
        for p, x in zip(names, choice):
            full, part = divmod(sum(x), patterns[p]) if patterns[p] else (0, 0)
            cost += sum(costs[:full]) * patterns[p] + (costs[full] * part if part else 0)
        key = (-sum(load.values()), cost)
        best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("patterns, quotas", [({("a",): 3, ("b",): 1}, {"a": 4, "b": 9}), ({("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 5, "b": 4}), ({("a", "b"): 2, ("b", "c"): 2}, {"a": 1, "b": 3, "c": 2})])
def test_flow_is_cheapest(patterns, quotas):
    given_words = mixing.route(patterns, quotas)
    cost = 0
    for p, x in given_words.items():
        full, part = divmod(x, patterns[p])
        cost += sum((0, 1, 3)[:full]) * patterns[p] + ((0, 1, 3)[full] * part if part else 0)
    assert (-sum(given_words.values()), cost) == brute_route(patterns, quotas)


def test_mix_on_documents(spark, small):
    out = mixing.op3_mixing(spark, small)
    rows = out.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    size = defaultdict(int)
    for d in docs.values():
        size[d.source] += len(WORD.findall(d.text or ""))
    aims = mixing.targets(dict(size))
    taken = defaultdict(int)
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(WORD.findall(d.text or "")) and r.source_size == size[d.source] and r.target == pytest.approx(float(aims[d.source])) and 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
    assert len(rows) == len(docs) and sum(abs(taken[s] - aims[s]) for s in size) <= 0.04 * sum(size.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op3_mixing(spark, small).collect()))


def test_mix_on_odd_and_overlapping_input(spark, odd, empty):
    held = kit.Durable(spark, "t")
    out = mixing.mix(mixing.sized_documents(odd, held), held)
    assert out.count() == odd.count() and out.filter("taken > 3 * size or taken < 0").count() == 0
    held = kit.Durable(spark, "t")
    assert mixing.mix(mixing.sized_documents(empty, held), held).count() == 0
    mixed = mixing.mixed(odd, kit.Durable(spark, "t"))
    assert mixed.schema == odd.schema and mixed.filter("text is null").count() == 0
    rows = [(i, 1 + i % 5, sorted(["a", "b"][: 1 + i % 2])) for i in range(60)]
    held = kit.Durable(spark, "t")
    both = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, sources array<string>"), held)
    assert both.count() == 60 and both.filter("taken > 3 * size").count() == 0


@given(st.integers(1, 20_000))
@settings(max_examples=200, deadline=None)
def test_cuts_fit_their_class(length):
    parts = packing.cut(length)
    assert sum(n for n, _ in parts) == length and all(n * k <= packing.CAPACITY and n > 0 for n, k in parts)


def check_packing(docs, rows, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc_id].append(ids)
    assert sum(len(i) for v in want.values() for i in v) == sum(r.length for r in rows)
    for (doc_id, n), parts in by_doc.items():
        same = [i for i in want[doc_id] if len(i) == n]
        seen = {(r.start, r.length, r.ids_crc32) for r in parts}
        assert seen <= {(s, k, zlib.crc32(i[s : s + k].tobytes())) for i in same for s, k, _ in parts_of(parts)}
        assert len(parts) % len(seen) == 0 if len(same) == 1 else True
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding


def parts_of(parts):
    return {(r.start, r.length, 0) for r in parts}


def test_packing(spark, small, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = packing.op1_packing(spark, small).collect()
    assert check_packing(docs, rows, tokenizer) <= 0.05 * sum(r.length for r in rows)
    strange = packing.pack(odd, kit.Durable(spark, "t"), packing.tokenizer_path()).collect()
    check_packing([(r.doc_id, r.text) for r in odd.collect()], strange, tokenizer)
    assert packing.pack(empty, kit.Durable(spark, "t"), packing.tokenizer_path()).count() == 0


def test_sequence_numbers_differ(spark):
    """Also those of the last worker and bin that a number has room for; beyond it there is an error, not another's number."""
    cells = [(k, t, w, b) for k in (1, 2, 3, packing.CAPACITY - 1, packing.CAPACITY) for t in (0, 1, 15) for w in (0, 1, 4095, 4096, 2**30 - 1) for b in (0, 1, 2**16 - 1)] + [(0, 0, 0, 0), (0, 0, 0, 5)]
    number = packing.sequence_number(F.col("class"), F.col("turn"), F.col("worker"), F.col("bin")).alias("s")
    rows = spark.createDataFrame(cells, "class int, turn int, worker long, bin long").select(number).collect()
    assert len({r.s for r in rows}) == len(cells) and min(r.s for r in rows) >= 0
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([(1, 0, 2**30, 0)], "class int, turn int, worker long, bin long").select(number).collect()


def test_workers_leave_little_over(spark, monkeypatch):
    """Several workers a class and several turns: bins are full but for a bounded rest, at every size."""
    monkeypatch.setattr(packing, "PIECES_PER_WORKER", 8)
    monkeypatch.setattr(packing, "BINS_PER_WORKER", 2)
    docs = spark.createDataFrame([(i, "the cat sat on it " * (1 + i % 9)) for i in range(20_000)], "doc_id long, text string")
    rows = packing.pack(docs, kit.Durable(spark, "t"), packing.tokenizer_path()).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    assert sum(len(p) for p in by_sequence.values()) >= 20_000 and len({r.sequence_id >> 46 & 15 for r in rows}) > 1
    for parts in by_sequence.values():
        at = np.cumsum([0] + [r.length for r in sorted(parts, key=lambda r: r.offset)])
        assert [r.offset for r in sorted(parts, key=lambda r: r.offset)] == at[:-1].tolist() and at[-1] <= packing.CAPACITY
    assert len(by_sequence) * packing.CAPACITY <= 1.03 * sum(r.length for r in rows) + 40 * packing.CAPACITY


def test_many_small_pieces_fill_bins_by_count(spark):
    docs = spark.createDataFrame([(i, "the cat sat on it") for i in range(3000)], "doc_id long, text string")
    rows = packing.pack(docs, kit.Durable(spark, "t"), packing.tokenizer_path()).collect()
    sizes = sorted(np.unique([r.sequence_id for r in rows], return_counts=True)[1].tolist())
    k = packing.cut(rows[0].doc_tokens)[0][1]
    assert sizes[1:] == [k] * (3000 // k) and sizes[0] == 3000 % k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_word_ids_equal_whole_text_ids(texts):
    import pyarrow as pa

    ids_of = packing.worker_ids(packing.tokenizer_path())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = packing.text_ids(pa.array(texts, pa.string()), ids_of)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == [*ids_of.tokenizer.encode(t, add_special_tokens=False).ids, 2]


URLS = [
    ("https://WWW.Example.NET/en/1?x", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/1#/en/", "example.net", "/de/1", "net/", "block"),
    ("ftp://a.example.com/de/2", "a.example.com", "/de/2", "example.com/de/", "block"),
    ("http://badexample.com/de/2", "badexample.com", "/de/2", None, None),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.org/fr", "x.org", "/fr", None, None),
    ("http://org?u=http://a.net/", "org", "", None, None),
    ("no scheme.net/", "", "", None, None),
    (None, "", "", None, None),
    ("://net/", "net", "/", "net/", "block"),
    ("http://É.net", "É.net", "", None, None),
]


def test_urls(spark, held):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "y"), (None, "http://a.net/b", None)], "page_id long, url string, verdict string")
    got = url_filter.judge(pages, held).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            _, host, path, rule, verdict = URLS[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (("block", "allow") if verdict is None else (verdict,))
    assert url_filter.judge(pages.limit(0), kit.Durable(spark, "t")).count() == 0


def test_templates_learn_from_labels(spark, held):
    """Numbered articles under a blocked section are rejected as a template; those of a section with good labels are not."""
    rows = [(i, f"http://h.io/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(140)], "page_id long, blocked boolean")
    got = url_filter.judge(pages, held, labels=labels).collect()
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in got)
    few = url_filter.judge(pages, kit.Durable(spark, "t"), labels=labels.filter("page_id < 10")).collect()
    assert {r.verdict for r in few} == {"allow"}


@pytest.mark.parametrize("urls", [200, 2000])
def test_few_labels_speak_for_their_template(spark, held, urls):
    """Ten labels a branch decide, however many urls have none; what a rule blocks says nothing of its neighbours."""
    pages = spark.createDataFrame([(i, f"http://h.io/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(urls)] + [(-1 - i, f"http://a.example.com/{'de' if i < 5 else 'en'}/{i}") for i in range(50)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(20)], "page_id long, blocked boolean")
    got = url_filter.judge(pages, held, labels=labels).collect()
    assert len(got) == urls + 50 and all((r.verdict == "block") == ("/spam/" in r.path or r.path.startswith("/de/")) for r in got)


def brute_kind(segment):
    body, dot, extension = re.fullmatch(r"(?s)(.*?)((\.[A-Za-z]{1,5})?)", segment).group(1, 2, 3)
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", body):
        return "{date}" + dot
    if re.fullmatch(r"[0-9]+", body):
        return "{number}" + dot
    if re.fullmatch(r"[0-9a-fA-F-]{8,}", body) and re.search(r"[0-9]", body):
        return "{hex}" + dot
    if len(body) > 40:
        return "{long}" + dot
    return re.sub(r"[0-9]+", "{number}", body) + dot if re.search("[0-9]", body) else segment


def brute_templates(nodes, hosts):
    """(host, shape) -> [n, known, bad] to (host, shape) -> template, by walking each host's tree. hosts: shape -> (host, share) of those that have labels."""
    import math

    out = {}

    def g_test(a, b):
        cats = sorted(set(a) | set(b))
        if len(cats) < 2:
            return True
        table = [[x.get(c, 0) for c in cats] for x in (a, b)]
        total, g = sum(map(sum, table)), 0.0
        for row in table:
            for j, o in enumerate(row):
                if o:
                    g += 2 * o * math.log(o / (sum(row) * (table[0][j] + table[1][j]) / total))
        d = len(cats) - 1
        return g <= d * (1 - 2 / (9 * d) + 3.719 * (2 / (9 * d)) ** 0.5) ** 3

    def walk(host, template, level, members):
        for s in [s for s in members if len(s) == level]:
            out[host, s] = template
        if len(members) == 1:
            for s in members:
                out[host, s] = "".join([template, *("/" + x for x in s[level:])])
            return
        branches = defaultdict(list)
        for s in members:
            if len(s) > level:
                branches[s[level]].append(s)
        size = {b: sum(nodes[host, s][0] for s in own) for b, own in branches.items()}
        whole, step = sum(size.values()), {}
        word = lambda x: "{" not in x and x != ""
        rare = {b for b in branches if word(b) and len(branches) > 32 and size[b] < 0.02 * whole}
        leaders = []
        for b in sorted(branches, key=lambda b: (-size[b], b)):
            if b in rare:
                step[b] = "{any}"
            elif not word(b):
                step[b] = b
            else:
                after = defaultdict(int)
                for s in branches[b]:
                    x = s[level + 1] if level + 1 < len(s) else None
                    m = re.search(r"\{\w+\}", x or "")
                    after["" if x is None else m[0] if m else "/" if x == "" else "word"] += nodes[host, s][0]
                known = sum(nodes[host, s][1] + sum(h != host for h, _ in hosts[s]) for s in branches[b])
                bad = sum(nodes[host, s][2] + sum(x for h, x in hosts[s] if h != host) for s in branches[b])
                for lead in leaders:
                    if bool(lead[2]) == bool(known) and g_test(lead[1], after) and (not known or g_test({"b": lead[3], "g": lead[2] - lead[3]}, {"b": bad, "g": known - bad})):
                        lead[4].append(b)
                        break
                else:
                    leaders.append((b, after, known, bad, [b]))
        for b, *_, own in leaders:
            for x in own:
                step[x] = "{~%s}" % b if len(own) > 1 else b
        below = defaultdict(list)
        for b, own in branches.items():
            below[step[b]].extend(own)
        for name, own in below.items():
            walk(host, template + "/" + name, level + 1, own)

    by_host = defaultdict(list)
    for host, s in nodes:
        by_host[host].append(s)
    for host, own in by_host.items():
        walk(host, "", 0, own)
    return out


def brute_urls(rows, labels=None):
    """page_id -> (host, path, rule, verdict, template, purity), by plain Python."""
    found, nodes = {}, defaultdict(lambda: [0, 0, 0])
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(-len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = min(fits, default=(0, None, None))
        label = verdict == "block" if verdict else (labels or {}).get(i)
        own = tuple(brute_kind(x) for x in path.split("/")[1:])
        found[i] = (host, path, rule, verdict, own)
        node = nodes[host, own]
        node[0] += 1
        node[1] += label is not None
        node[2] += bool(label)
    hosts, told = defaultdict(list), {}
    for (host, own), (_, known, bad) in nodes.items():
        if known:
            hosts[own].append((host, bad / known))
    template_of = brute_templates(nodes, hosts)
    by_template = defaultdict(lambda: [0, 0, 0, 0.0])
    for (host, own), (n, known, bad) in nodes.items():
        share = (sum(x for _, x in hosts[own]) + 2) / (len(hosts[own]) + 4)
        at = by_template[host, template_of[host, own]]
        for k, x in enumerate((n, known, bad, n * share)):
            at[k] += x
    for i, (host, path, rule, verdict, own) in found.items():
        n, known, bad, weight = by_template[host, template_of[host, own]]
        purity = (bad + 4 * weight / n) / (known + 4)
        told[i] = (host, path, rule, verdict or ("block" if known and purity >= 0.7 else "allow"), template_of[host, own], round(purity, 6))
    return told


def as_told(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 6)) for r in df.collect()}


def test_urls_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = brute_urls([(r.page_id, r.url) for r in pages.select("page_id", "url").collect()])
    assert as_told(url_filter.op2_url_filter(spark, "/root/testdata/sf0.01")) == want
    assert {v for _, _, rule, v, _, _ in want.values() if rule is None} == {"allow", "block"}
    # Shapes of other hosts reject nothing where a template has no label of its own.
    ruled = {(h, t) for h, _, rule, _, t, _ in want.values() if rule}
    assert all((h, t) in ruled for h, _, _, v, t, _ in want.values() if v == "block")


def test_trees_match_brute_force(spark, held):
    """Deep paths, many rare segments, long ones, labels on some of them, paths that end within others."""
    rng = np.random.default_rng(6)
    words = ["news", "blog", "shop", "spam", "ads", "x" * 60, "a-b", "v1.2", "", "2024-01-02", "deadbeef01", "page.html"]
    rows = []
    for i in range(1500):
        host = f"h{int(rng.integers(0, 6))}.io"
        depth = int(rng.integers(0, 9))
        path = "".join("/" + (words[int(rng.integers(0, len(words)))] if rng.random() < 0.8 else f"s{'abcdefghij'[int(rng.integers(0, 10))]}{'klmnopqrst'[int(rng.integers(0, 10))]}") for _ in range(depth))
        rows.append((i, f"http://{host}{path}"))
    rows += [(2000 + i, f"http://wide.io/tag/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26 % 26]}/{i}") for i in range(400)]
    rows += [(3000 + i, f"http://wide.io/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    rows += [(4000, "http://deep.io" + "/a" * 40), (4001, "http://deep.io" + "/a" * 39 + "/b"), (4002, "http://deep.io" + "/" * 30), (4003, "http://long.io/" + "q" * 20_000 + "/1"), (4004, None), (4005, "nothing")]
    labels = {i: bool(rng.random() < (0.9 if "spam" in (u or "") else 0.1)) for i, u in rows if rng.random() < 0.3}
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), held, labels=spark.createDataFrame(list(labels.items()), "page_id long, blocked boolean"))
    want = brute_urls(rows, labels)
    assert as_told(got) == want
    assert any("{any}" in t for *_, t, _ in want.values()) and any("{~" in t for *_, t, _ in want.values()) and {"allow", "block"} == {w[3] for w in want.values()}


def test_equally_long_rules(spark, held):
    rules = (("a.io", "/x/", "block"), ("b.a.io", "/", "allow"), ("a.io", "/y/", "allow"))
    got = url_filter.judge(spark.createDataFrame([(1, "http://b.a.io/x/1"), (2, "http://a.io/x/1")], "page_id long, url string"), held, rules).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("a.io/x/", "block"), 2: ("a.io/x/", "block")}


def brute_search(rows, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(8)] + [(50 * 40, [1.0]), (50 * 41, [2.0, None]), (50 * 42, [float("nan")]), (50 * 43, None), (None, [1.0] * 4), (7777, []), (50 * 44, []), (50 * 45, [3e5, 2e6, 1.0, 1e3]), (9999, [2e6, 3e5, 1e9, 5.0])]
    v = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = vector_search.top_k(v.filter("vec_id % 50 = 0"), v).collect()
    assert sorted(tuple(r) for r in got) == brute_search([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows])
    assert vector_search.top_k(v.limit(0), v.limit(0)).count() == 0


def test_vectors_with_other_columns(spark):
    """Columns whose names the operator uses itself are ignored."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)], i, 1.5, "x", [i], 7) for i in range(120)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long, score double, cell string, v array<int>, dim int")
    v = vector_search.quantised(wide)
    assert sorted(tuple(r) for r in vector_search.top_k(v.filter("vec_id % 50 = 0"), v).collect()) == brute_search([r[:2] for r in rows])


def test_vectors_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_TILE", 3)
    monkeypatch.setattr(vector_search, "SHARD_TILE", 17)
    rng = np.random.default_rng(4)
    rows = [(int(i) * 10, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(200)]
    v = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(tuple(r) for r in vector_search.top_k(v.filter("vec_id % 50 = 0"), v).collect()) == brute_search(rows)


def test_exact_products():
    big = np.array([[2.0**40, 3.0], [2.0**31, -(2.0**31)]])
    assert vector_search.product(big, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3], [2**51 - 2**31]]


def test_pipeline(spark, small):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{small}/documents.parquet"), []
    columns, held = docs.columns, kit.Durable(spark, "t")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, held.write(stage(spark, docs, small), name)
        if i < 4:
            assert docs.columns == columns
            sizes.append(docs.count())
        if name == "near_duplicates":
            groups = defaultdict(set)
            for i_, (_, c) in brute_components([(r.doc_id, r.text) for r in before.collect()]).items():
                groups[c].add(i_)
            assert {r.doc_id for r in docs.collect()} == set(groups)
        if name == "passages":
            want = {i_: n - k for i_, n, k, _ in brute_removal([(r.doc_id, r.text) for r in before.collect()], 20)}
            assert {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()} == want
    assert sizes[0] < 200 and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in docs.collect()}
    assert not any(labels.get(i) == 0 for i in kept)


def test_pipeline_on_odd_input(spark, odd, empty, small):
    import corpus_pipeline

    for start in (odd, empty):
        docs, held = start, kit.Durable(spark, "t")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, docs = docs, held.write(stage(spark, docs, small), name)
            if i < 4:
                assert docs.schema == start.schema
                ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
                assert ids(docs) <= ids(before)
        rows = docs.collect()
        # What is packed is what the mix took, text by text.
        assert {r.doc_id for r in rows} == ids(before) and sum(r.start == 0 for r in rows) == before.count()
        assert (start is empty) == (len(rows) == 0)
