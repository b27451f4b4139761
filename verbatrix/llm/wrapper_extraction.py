"""Main text of pages by wrappers of their hosts (operator 11): union-free expressions, inferred by aligning token streams.

1. A page becomes a tree of blocks whose repeats are folded (``page_tree``); its expression is its shape, and each block text
   knows the slot it fills. Pages are parsed once; shape and texts are written.
2. Shapes are counted by host, with the characters, links and least and greatest hash of each slot's texts, so what is aligned
   grows with a host's different shapes and not with its pages.
3. A host's shapes are aligned one after another, in parts of ``PART`` shapes, then the parts' results in turn, until one wrapper
   is left: mismatches become optional or repeated groups, texts that differ become slots, equal ones stay fixed.
4. Each shape is aligned with its host's wrapper, so its slots have fields; what the fields hold over the whole host says which
   are main text. That choice is joined back to the pages, whose texts are filtered and joined without Python.

Which fields are main text: never those in menus, footers, forms and so on, by tag or by the words of class, id and role.
Then all within ``article``; without one, within ``main``; without one, within blocks that call themselves content. Otherwise the
block is taken that holds most characters of fields whose texts differ between pages and are mostly no links, and in it fields
that are links or the same on all of ``FIXED_PAGES`` pages or more are left out. A ``header`` within the chosen part stays.

A host may have a third of all pages: counts are combined before shuffles, shapes are dealt into parts, and the choice is
broadcast if its checked size is small, else joined with hot keys dealt out.

Defined cases: null html or a page without main text gives an empty text, a null url belongs to a host without a name, null and
repeated page ids stay as rows. White space is what Unicode calls so. Blocks are joined by one space, lines broken by ``br`` too;
inline tags join without one. Unclosed tags end where HTML ends them; nesting beyond 256 levels is flattened, its text stays.
Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import sys

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit, page_tree

#: Shapes that one task aligns in a round.
PART = 256
#: A text that is the same on so many pages is part of the template, where no tag says what the main text is.
FIXED_PAGES = 3
LINKED = 0.5
BROADCAST_BYTES = 32 << 20
PARSED = "page_id long, url string, host string, shape string, texts array<struct<slot:int,text:string,linked:int>>"


def _parse(batches):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * page_tree.DEPTH))
    types = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("linked", pa.int32())]))
    for batch in batches:
        for piece, pages in kit.text_slices(batch, "html"):
            shapes, texts = [], []
            for html in pages.to_pylist():
                root, found, linked = page_tree.blocks(html)
                root = page_tree.folded(root)
                slot_of = {at: slot for slot, (leaf, _) in enumerate(page_tree.leaves(root)) for at in leaf.texts}
                shapes.append(page_tree.written(root))
                texts.append([{"slot": slot_of[i], "text": t, "linked": n} for i, (t, n) in enumerate(zip(found, linked))])
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), piece.column("host"), pa.array(shapes, pa.string()), pa.array(texts, types)], ["page_id", "url", "host", "shape", "texts"])


def host_of(url):
    """The host of a url, lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^/?#]*?://([^/?#]*)", 1), F.lit("")))


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of all expressions of a part, the most frequent ones first."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * page_tree.DEPTH))
    frame = frame.sort_values(["n", "shape"], ascending=[False, True])
    wrapper = None
    for shape in frame["shape"]:
        tree = page_tree.read(shape)
        wrapper = tree if wrapper is None else page_tree.merged(wrapper, tree)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "shape": [page_tree.written(page_tree.folded(wrapper))], "n": [int(frame["n"].sum())]})


def wrappers(shapes: DataFrame, held: kit.Durable, part: int = PART) -> DataFrame:
    """host, wrapper of shapes (host, shape, n), by rounds of parts; a part is a fixed share of a host's shapes by hash."""
    rows = shapes.select("host", "shape", "n")
    while True:
        per_host = rows.groupBy("host").agg(F.count("*").alias("shapes"))
        most = per_host.agg(F.max("shapes")).head()[0] or 0
        parts = kit.spread_join(rows, per_host, "host", ["shape"]).withColumn("part", F.pmod(F.xxhash64("shape"), F.ceil(F.col("shapes") / part)).cast("int"))
        rows = held.hold(parts.select("host", "shape", "n", "part").groupBy("host", "part").applyInPandas(_merge, "host string, shape string, n long"))
        if most <= part:
            return rows.select("host", F.col("shape").alias("wrapper"))


def _fields(frames):
    """The wrapper's slot for each slot of a shape; one that the wrapper lacks is a field of its own, by a negative number."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * page_tree.DEPTH))
    for frame in frames:
        out = []
        for host, shape, wrapper in zip(frame["host"], frame["shape"], frame["wrapper"]):
            whole, mine = page_tree.read(wrapper), page_tree.read(shape)
            known = sum(1 for _ in page_tree.leaves(whole))
            for leaf, _ in page_tree.leaves(mine):
                leaf.texts = [known + s for s in leaf.texts]
            fields = {}
            for leaf, _ in page_tree.leaves(page_tree.merged(whole, mine)):
                field = min((t for t in leaf.texts if t < known), default=None)
                fields |= {t - known: field if field is not None else known - 1 - t for t in leaf.texts if t >= known}
            out += [(host, shape, slot, field) for slot, field in sorted(fields.items())]
        yield pd.DataFrame(out, columns=["host", "shape", "slot", "field"])


def chosen(shape: str, slots: list[dict]) -> list[int]:
    """The slots of a shape that hold main text, by its tree and what its fields hold over the host."""
    root = page_tree.read(shape)
    stats = {s["slot"]: s for s in slots}
    found = [(leaf.texts[0], [n for n in above]) for leaf, above in page_tree.leaves(root)]
    tag = lambda node: node.label.rstrip("!^").split(".")[0]
    beside = lambda nodes: any(n.label.endswith("!") for n in nodes)
    for is_root in (lambda n: tag(n) == "article", lambda n: tag(n) == "main", lambda n: n.label.endswith("^")):
        inside = []
        for slot, above in found:
            at = next((i for i, n in enumerate(above) if is_root(n)), None)
            if at is not None and not beside(above[: at + 1]) and not beside(n for n in above[at + 1 :] if tag(n) != "header"):
                inside.append(slot)
        if inside:
            return inside
    same = lambda s: s["least"] == s["greatest"] and s["pages"] >= FIXED_PAGES
    free = [(slot, above) for slot, above in found if not beside(above) and "head" not in map(tag, above) and stats[slot]["linked"] <= LINKED * stats[slot]["chars"]]
    varied = [x for x in free if not same(stats[x[0]])] or free
    weight: dict[int, int] = {}
    for slot, above in varied:
        for node in above:
            weight[id(node)] = weight.get(id(node), 0) + stats[slot]["chars"] // max(1, stats[slot]["pages"])
    node = root
    while True:
        inner = [c for c in node.children if c.children and weight.get(id(c), 0) > 0.6 * weight.get(id(node), 0)]
        if not inner:
            break
        node = inner[0]
    return [slot for slot, above in varied if any(n is node for n in above)]


def _choose(frames):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * page_tree.DEPTH))
    for frame in frames:
        yield pd.DataFrame({"host": frame["host"], "shape": frame["shape"], "main": [chosen(s, [r if isinstance(r, dict) else r.asDict() for r in slots]) for s, slots in zip(frame["shape"], frame["slots"])]})


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    held = kit.Durable(pages.sparkSession, "wrappers", pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    with kit.small_batches(pages.sparkSession):
        parsed = held.write(rows.mapInArrow(kit.lean(_parse), PARSED), "parsed")
        slots = parsed.select("host", "shape", F.explode("texts").alias("t")).groupBy("host", "shape", F.col("t.slot").alias("slot")).agg(
            F.count("*").alias("pages"), F.sum(F.length("t.text")).alias("chars"), F.sum("t.linked").alias("linked"), F.min(F.xxhash64("t.text")).alias("least"), F.max(F.xxhash64("t.text")).alias("greatest")
        )
        slots = held.write(slots, "slots", small=True)
        shapes = held.write(parsed.groupBy("host", "shape").agg(F.count("*").alias("n")), "shapes", small=True)
        fields = kit.spread_join(shapes.select("host", "shape"), wrappers(shapes, held), "host", ["shape"]).mapInPandas(_fields, "host string, shape string, slot int, field int")
        fields = held.write(fields.join(slots, ["host", "shape", "slot"]), "fields", small=True)
        # A negative field is one shape's own.
        owner = F.when(F.col("field") < 0, F.col("shape"))
        whole = fields.groupBy("host", "field", owner.alias("owner")).agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        known = fields.select("host", "shape", "slot", "field", owner.alias("owner")).alias("f").join(whole.alias("w"), F.expr("f.host = w.host AND f.field = w.field AND f.owner <=> w.owner"))
        listed = known.select("f.host", "shape", F.struct("slot", "pages", "chars", "linked", "least", "greatest").alias("s")).groupBy("host", "shape").agg(F.collect_list("s").alias("slots"))
        choice = held.write(listed.mapInPandas(_choose, "host string, shape string, main array<int>"), "choice", small=True)
    size = choice.agg(F.sum(F.length("shape") + F.length("host") + 4 * F.size("main") + 64).alias("n")).head().n or 0
    if size <= BROADCAST_BYTES:
        joined = parsed.join(F.broadcast(choice), ["host", "shape"], "left")
    else:
        keyed = lambda df: df.withColumn("key", F.md5(F.concat_ws("\n", "host", "shape")))
        joined = kit.spread_join(keyed(parsed), keyed(choice).select("key", "main"), "key", ["page_id"], "left")
    main = F.filter("texts", lambda t: F.array_contains(F.coalesce("main", F.array().cast("array<int>")), t.slot))
    text = F.array_join(F.transform(main, lambda t: t.text), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op11_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(kit.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
