"""Near-duplicate join on word shingles by vertical partitioning (operator 10).

A document's set holds its distinct five-word shingles, as 64-bit hashes; documents with equal sets form a class, and all
further work is on classes. Links are pairs of classes with a Jaccard similarity of 0.8 or more.

1. Each text's shingles are dealt into buckets by hash. A bucket counts in how many classes each shingle occurs and
   returns those of two or more to their classes. The others can be part of no overlap.
2. The global order of shingles is by that count, rare ones first. Two similar sets share a shingle within their
   prefixes, the first |x| - ceil(0.8 |x|) + 1 of each in this order. Most classes fill theirs with shingles that nobody
   else has, and drop out.
3. The order is cut into fragments: the prefixes, and then some that hold about equally many shingles. A pair's overlap
   is counted in each fragment by itself, and the partial counts are summed per pair. Pairs whose prefixes share too little
   for what may follow are not counted further.
4. Pairs come in three rounds, so that a large group of similar classes is not expanded into all its pairs. First, each
   class meets one hub; then the hubs of all its prefix shingles, and last all classes that share one, in both rounds only
   where the two are not linked yet, directly or through others. So every link between different components is found,
   and within one no more than hold it together.
5. Where links are counted, all of them are: every link lies within a component, so each component's classes are dealt
   into tiles, by length and then by hash, and all pairs of tiles whose lengths fit are compared, each class with each.
   A link is between rows: classes of i and j equal texts that are similar have i * j, and a class of i has i * (i - 1) / 2.

Defined cases: texts of fewer than five words have one shingle, the whole sequence; null or blank texts have none and are
linked with nothing, so component_id is doc_id and n_links 0. Rows that share an id are judged each by its own text. Null ids
yield a null component_id unless a linked document has an id. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit
from .components import components

WIDTH = 5
PERCENT = 80
#: Bytes of text whose shingles are arrays at once.
SLICE = 1 << 20
FRAGMENTS = 8
#: Shingles of a tile, about, and how many of them are compared at once.
TILE_KEYS = 100_000
KEYS_AT_ONCE = 1024
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MESSAGE = "bucket int, kind int, sigs binary, sizes binary, owner binary, key binary"
FOUND = "kind int, doc_id long, tag long, n int, sig binary, keys binary, counts binary"


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, and two hashes of each."""
    words, offsets = kit.split_words(pc.ascii_lower(texts))
    hashes = kit.word_hashes(words)
    starts, owner = kit.window_starts(offsets, width)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < width))
    pairs = []
    for base in BASES:
        rolled = kit.mix(kit.Rolling(base, width)(hashes, starts)) if len(starts) else np.empty(0, np.uint64)
        whole = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):
            for w in hashes[offsets[t] : offsets[t + 1]].tolist():
                whole[i] = ((int(whole[i]) + w + 1) * base) & (2**64 - 1)
        pairs.append(np.concatenate([rolled, kit.mix(whole)]))
    owner = np.concatenate([owner, short])
    order = np.lexsort((pairs[1], pairs[0], owner))
    owner, key, other = owner[order], pairs[0][order], pairs[1][order]
    new = kit.run_starts(owner, key, other)
    return owner[new], key[new], other[new]


def _signatures(owner, key, other, n: int) -> np.ndarray:
    """128 bits that stand for a set, in whatever order its shingles come."""
    out = np.zeros((n, 2), np.uint64)
    if len(owner):
        first = np.flatnonzero(kit.run_starts(owner))
        out[owner[first], 0] = np.add.reduceat(kit.mix(key), first)
        out[owner[first], 1] = np.add.reduceat(kit.mix(other ^ np.uint64(BASES[0])), first)
    return out


def _blob(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _send(width: int, buckets: int):
    names = [f.split()[0] for f in MESSAGE.split(", ")]

    def message(bucket, kind, *blobs):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *blobs], names)

    def run(batches):
        for batch in batches:
            for rows, texts in kit.text_slices(batch, most=SLICE):
                owner, key, other = shingles(texts, width)
                sizes = np.bincount(owner, minlength=len(texts)).astype(np.uint32)
                sigs = _signatures(owner, key, other, len(texts))
                ids = kit.filled_ids(rows.column("doc_id"))
                yield message([int(ids[0] % buckets)], [1], _blob(sigs), _blob(sizes), _blob(ids), _blob(kit.filled_ids(rows.column("tag"))))
                order = np.lexsort((sigs[:, 1], sigs[:, 0]))
                one = np.zeros(len(texts), bool)
                one[order[kit.run_starts(sigs[order, 0], sigs[order, 1])]] = True
                chosen = one[owner]
                if not chosen.any():
                    continue
                owner, key, bucket = owner[chosen], key[chosen], (other[chosen] % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((key, bucket))
                owner, key, bucket = owner[order], key[order], bucket[order]
                cuts = np.append(np.flatnonzero(kit.run_starts(bucket)), len(bucket))
                cell_sigs, cell_sizes, cell_owner = [], [], np.empty(len(owner), np.uint16 if len(texts) < 1 << 16 else np.uint32)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    there, cell_owner[a:b] = np.unique(owner[a:b], return_inverse=True)
                    cell_sigs.append(sigs[there].tobytes())
                    cell_sizes.append(sizes[there].tobytes())
                yield message(bucket[cuts[:-1]], np.zeros(len(cuts) - 1, np.int32), pa.array(cell_sigs, pa.binary()), pa.array(cell_sizes, pa.binary()), kit.packed(cell_owner, cuts), kit.packed(key, cuts))

    return run


def _rows(kind: int, ids, tags, sizes, sigs: np.ndarray, keys, counts) -> pa.Table:
    n = len(sizes)
    return pa.table({
        "kind": pa.array(np.full(n, kind, np.int32)), "doc_id": ids, "tag": tags, "n": pa.array(sizes.astype(np.int32)),
        "sig": kit.packed(sigs.reshape(-1), 2 * np.arange(n + 1)).cast(pa.binary()), "keys": keys, "counts": counts,
    })


def _count(group: pa.Table) -> pa.Table:
    """The documents of a bucket's messages, and its shingles of two classes or more, by class."""
    docs = group.filter(pc.equal(group.column("kind"), 1))
    d_sizes = kit.unpacked(docs.column("sizes"), np.uint32)[0]
    d_ids = kit.unpacked(docs.column("owner"), np.int64)[0]
    d_tags = kit.unpacked(docs.column("key"), np.int64)[0]
    none = pa.nulls(len(d_ids), pa.binary())
    out = [_rows(1, pa.array(d_ids, mask=d_ids == kit.NULL_ID), pa.array(d_tags), d_sizes, kit.unpacked(docs.column("sigs"), np.uint64)[0], none, none)]
    sent = group.filter(pc.equal(group.column("kind"), 0))
    key, n_keys = kit.unpacked(sent.column("key"), np.uint64)
    if len(key):
        sizes, n_sigs = kit.unpacked(sent.column("sizes"), np.uint32)
        sigs = kit.unpacked(sent.column("sigs"), np.uint64)[0].reshape(-1, 2)
        owner = np.concatenate([np.frombuffer(o, np.uint16 if len(o) == 2 * n else np.uint32).astype(np.int64) for o, n in zip(sent.column("owner").to_pylist(), n_keys)])
        owner += np.repeat(np.cumsum(n_sigs) - n_sigs, n_keys)
        order = np.lexsort((sigs[:, 1], sigs[:, 0]))
        new = kit.run_starts(sigs[order, 0], sigs[order, 1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        sigs, sizes, owner = sigs[order[new]], sizes[order[new]], number[owner]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        once = kit.run_starts(key, owner)
        key, owner = key[once], owner[once]
        first = np.flatnonzero(kit.run_starts(key))
        count = np.diff(np.append(first, len(key)))
        count = np.repeat(count, count)
        shared = count > 1
        key, owner, count = key[shared], owner[shared], count[shared].astype(np.uint32)
        order = np.argsort(owner, kind="stable")
        key, owner, count = key[order], owner[order], count[order]
        cuts = np.append(np.flatnonzero(kit.run_starts(owner)), len(owner))
        who = owner[cuts[:-1]]
        out.append(_rows(0, pa.nulls(len(who), pa.int64()), pa.nulls(len(who), pa.int64()), sizes[who], sigs[who], kit.packed(key, cuts), kit.packed(count, cuts)))
    return pa.concat_tables(out)


def _order(percent: int):
    """Shared shingles of each class in the global order, with how many of its own come before them."""

    def run(batches):
        for batch in batches:
            sig, n, own, keys, place = [], [], [], [], []
            for s, size, parts in zip(*(batch.column(c).to_pylist() for c in ("sig", "n", "parts"))):
                key = np.frombuffer(b"".join(p["keys"] for p in parts), np.uint64)
                if 100 * len(key) < percent * size:
                    continue
                count = np.frombuffer(b"".join(p["counts"] for p in parts), np.uint32).astype(np.float64)
                rank = count + key / 2.0**64
                order = np.lexsort((key, rank))
                sig.append(s), n.append(size), own.append(size - len(key)), keys.append(key[order].view(np.int64)), place.append(rank[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(own, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(place, pa.list_(pa.float64()))], ["sig", "n", "own", "keys", "place"]
            )

    return run


def _enough(overlap, n_a, n_b, percent: int):
    """Whether 100 * overlap >= percent * union, for a union of n_a + n_b - overlap."""
    return (100 + percent) * overlap >= percent * (n_a.cast("long") + n_b)


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, overlap of the pairs (a, b): counted fragment by fragment, summed per pair."""
    side = lambda x: segments.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), "fragment", F.col("part").alias(f"part_{x}"))
    parts = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("o"))
    return parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("o").alias("overlap"))


def promising(pairs: DataFrame, first_parts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough for a link.

    Whatever two sets share lies within the prefix of the one that ends first in the global order, or behind it there.
    """
    side = lambda x: first_parts.select(F.col("sig").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "after", "part", "last")])
    shared = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("o", F.size(F.array_intersect("part_a", "part_b")))
    after = F.when(F.col("last_a") < F.col("last_b"), F.col("after_a")).when(F.col("last_b") < F.col("last_a"), F.col("after_b")).otherwise(F.greatest("after_a", "after_b"))
    return shared.filter((F.col("o") > 0) & _enough(F.col("o") + after, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def similar_classes(docs: DataFrame, held: kit.Durable, percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, tag, n, sig) of every document, tag being a hash of its text; (node, label) of classes that are linked to others; (sig, n, keys) of classes."""
    spark, buckets = docs.sparkSession, kit.buckets_for(docs)
    # No name is kept for what is only read once: a live plan keeps its shuffle files.
    with kit.small_batches(spark):
        found = held.write(docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(kit.lean(_send(width, buckets)), MESSAGE).groupBy("bucket").applyInArrow(kit.lean_group(_count), FOUND), "found")
    held.forget_shuffles()
    members = found.filter("kind = 1").select("doc_id", "tag", "n", "sig")
    sets = held.write(
        found.filter("kind = 0").groupBy("sig", "n").agg(F.sum(F.length("keys") / 8).alias("m"), F.collect_list(F.struct("keys", "counts")).alias("parts"))
        .filter(F.lit(100) * F.col("m") >= F.lit(percent) * F.col("n")).select("sig", "n", "parts")
        .mapInArrow(kit.lean(_order(percent)), "sig binary, n int, own int, keys array<long>, place array<double>"),
        "sets",
    )
    members = held.write(members, "members")
    held.drop("found")
    held.forget_shuffles()
    prefix = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 1
    heads = sets.select("sig", "n", "own", F.posexplode(F.slice("keys", 1, F.greatest(prefix - F.col("own"), F.lit(0)).cast("int"))).alias("i", "key"))
    postings = held.write(heads.select("key", "sig", "n", "own", "i"), "postings")

    size = F.least(F.greatest(prefix - F.col("own"), F.lit(0)), F.size("keys")).cast("int")
    first_parts = held.write(sets.select("sig", "n", size.alias("size"), (F.col("n") - F.col("own") - size).alias("after"), F.slice("keys", 1, size).alias("part"), F.get("place", size - 1).alias("last")), "first-parts")

    edges = [F.lit(k / FRAGMENTS) for k in range(1, FRAGMENTS)]
    cuts = sets.select(F.explode("place").alias("p")).agg(F.percentile_approx("p", F.array(*edges), F.lit(1000)).alias("cuts")).head().cuts or []
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bound = F.array(*[F.struct(F.lit(i).alias("fragment"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))])
    below = lambda x: F.size(F.filter("place", lambda p: p <= x))
    segments = (
        sets.select("sig", "n", "keys", "place", F.inline(bound))
        .select("sig", "n", "keys", "fragment", below(F.col("low")).alias("start"), below(F.col("high")).alias("stop"))
        .filter("stop > start")
        .select("sig", "n", "fragment", F.slice("keys", F.col("start") + 1, F.col("stop") - F.col("start")).alias("part"))
    )
    segments = held.write(segments, "segments")

    lengths_fit = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    is_link = _enough(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)
    verified = lambda pairs: held.hold(overlaps(promising(pairs.distinct(), first_parts, percent), segments).filter(is_link).select("a", "b"))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def spokes(over: DataFrame) -> DataFrame:
        """Each posting with the hub of its shingle: the class that has the fewest shingles to itself."""
        hubs = over.groupBy("key").agg(F.min(F.struct("own", F.col("sig").alias("hub"), F.col("n").alias("hub_n"), "label")).alias("h"))
        hubs = hubs.select("key", "h.own", "h.hub", "h.hub_n", F.col("h.label").alias("hub_label")).withColumnRenamed("own", "hub_own")
        return kit.spread_join(over, hubs, "key", ["sig"]).filter((F.col("sig") != F.col("hub")) & (F.col("label") != F.col("hub_label")) & lengths_fit(F.col("n"), F.col("hub_n")))

    def unresolved(labels: DataFrame) -> DataFrame:
        """The postings of shingles whose classes are not all linked yet."""
        placed = postings.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        open_keys = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
        return held.hold(placed.join(open_keys, "key", "left_semi"), small=False)

    none = spark.createDataFrame([], "node binary, label binary")
    least_hub = spokes(unresolved(none)).groupBy("sig").agg(F.min(F.struct("hub_own", "hub")).alias("h"))
    links = verified(least_hub.select(*pair(F.col("sig"), F.col("h.hub"))))
    labels = components(links, held)
    for meet in (lambda x: spokes(x).select(*pair(F.col("sig"), F.col("hub"))), lambda x: _across(x, lengths_fit, percent).select(*pair(F.col("x.sig"), F.col("y.sig")))):
        more = verified(meet(unresolved(labels)))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links, held)
    return members, labels, sets.select("sig", "n", "keys")


def _across(still: DataFrame, lengths_fit, percent: int) -> DataFrame:
    """Pairs of classes that share a prefix shingle, are not linked yet, and may overlap enough from that shingle on.

    The first shingle that two sets share has nothing in common before it, so a similar pair passes there. The postings of a
    frequent shingle are dealt into parts, and each two parts meet in a task of their own.
    """
    parts = F.coalesce("__vx_parts", F.lit(1))
    dealt = still.join(F.broadcast(kit.hot_keys(still, "key", 2000)), "key", "left").withColumn("part", F.pmod(F.xxhash64("sig"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    x, y = dealt.withColumn("met", other).alias("x"), dealt.withColumn("met", other).alias("y")
    after = lambda c: F.col(f"{c}.n") - F.col(f"{c}.own") - F.col(f"{c}.i")
    fits = lengths_fit(F.col("x.n"), F.col("y.n")) & _enough(F.least(after("x"), after("y")), F.col("x.n"), F.col("y.n"), percent)
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.met") == F.col("y.part")) & (F.col("y.met") == F.col("x.part")) & (F.col("x.label") < F.col("y.label")) & fits)


def _overlaps_of_tiles(x_keys, x_owner, x_rows: int, y_keys, y_owner, y_rows: int) -> np.ndarray:
    """How many shingles each class of one tile shares with each of the other: products of 0/1 matrices."""
    both, out = np.intersect1d(x_keys, y_keys), np.zeros((x_rows, y_rows), np.int64)

    def placed(keys, owner):
        at = np.minimum(np.searchsorted(both, keys), max(len(both) - 1, 0))
        there = np.flatnonzero(both[at] == keys) if len(both) else np.empty(0, np.int64)
        there = there[np.argsort(at[there], kind="stable")]
        return at[there], owner[there]

    def matrix(at, owner, rows, start):
        a, b = np.searchsorted(at, [start, start + KEYS_AT_ONCE])
        one = np.zeros((rows, min(KEYS_AT_ONCE, len(both) - start)), np.float32)
        one[owner[a:b], at[a:b] - start] = 1
        return one

    x, y = placed(x_keys, x_owner), placed(y_keys, y_owner)
    for start in range(0, len(both), KEYS_AT_ONCE):
        out += (matrix(*x, x_rows, start) @ matrix(*y, y_rows, start).T).astype(np.int64)
    return out


def _count_in_tiles(percent: int):
    """label and links of each pair of tiles; within one tile each pair of classes counts once."""

    def run(batches):
        for batch in batches:
            links = []
            for i, same in enumerate(batch.column("same").to_pylist()):
                n, copies, keys, owner = [], [], [], []
                for side in "xy":
                    cell = lambda c: np.asarray(batch.column(f"{c}_{side}")[i].values)  # noqa: B023, E731
                    n.append(cell("ns").astype(np.int64)), copies.append(cell("copies")), keys.append(cell("keys"))
                    owner.append(np.repeat(np.arange(len(n[-1])), cell("sizes")))
                overlap = _overlaps_of_tiles(keys[0], owner[0], len(n[0]), keys[1], owner[1], len(n[1]))
                link = (100 + percent) * overlap >= percent * (n[0][:, None] + n[1][None, :])
                link = np.triu(link, 1) if same else link
                links.append(int(copies[0] @ (link @ copies[1])))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(links, pa.int64())], ["label", "links"])

    return run


def count_links(members: DataFrame, labels: DataFrame, sets: DataFrame, held: kit.Durable, percent: int = PERCENT) -> DataFrame:
    """label and n_links: the number of all pairs of rows of that label that are equal or similar."""
    copies = held.hold(members.filter("n > 0").groupBy("sig").agg(F.count("*").alias("copies")))
    label_of = labels.withColumnRenamed("node", "sig")
    equal = copies.filter("copies > 1").join(label_of, "sig", "left").select(F.coalesce("label", "sig").alias("label"), F.expr("copies * (copies - 1) div 2").alias("links"))

    # Linked lengths differ by less than a band, so they lie in one band or in two that meet; a little more is for rounding.
    band = 1.001 * max(math.log(100 / percent), 0.01)
    placed = held.write(sets.join(label_of, "sig").join(copies, "sig").withColumn("band", F.floor(F.log("n") / F.lit(band))), "placed")
    weights = placed.groupBy("label", "band").agg(F.ceil(F.sum(F.size("keys")) / F.lit(TILE_KEYS)).alias("parts"))
    # No more rows than shingles / TILE_KEYS.
    large = F.broadcast(weights.filter("parts > 1"))
    part = F.coalesce(F.pmod(F.xxhash64("sig"), "parts"), F.lit(0))
    dealt = placed.join(large, ["label", "band"], "left").withColumn("part", part)
    tiles = dealt.groupBy("label", "band", "part").agg(F.collect_list(F.struct("n", "copies", F.size("keys").alias("size"), "keys")).alias("s"))
    tiles = held.write(tiles.select("label", "band", "part", F.col("s.n").alias("ns"), F.col("s.copies").alias("copies"), F.col("s.size").alias("sizes"), F.flatten("s.keys").alias("keys")), "tiles")
    held.drop("placed")

    side = lambda x, *columns: tiles.select("label", *[F.col(c).alias(f"{c}_{x}") for c in ("band", "part", *columns)])
    order = (F.col("band_y") == F.col("band_x")) & (F.col("part_y") >= F.col("part_x")) | (F.col("band_y") == F.col("band_x") + 1)
    pairs = held.hold(side("x").join(side("y"), "label").filter(order))
    filled = ("ns", "copies", "sizes", "keys")
    met = pairs.join(side("x", *filled), ["label", "band_x", "part_x"]).join(side("y", *filled), ["label", "band_y", "part_y"])
    met = met.select("label", ((F.col("band_x") == F.col("band_y")) & (F.col("part_x") == F.col("part_y"))).alias("same"), *[f"{c}_{x}" for x in "xy" for c in filled])
    similar = met.mapInArrow(kit.lean(_count_in_tiles(percent)), "label binary, links long")
    return held.hold(equal.unionByName(similar).groupBy("label").agg(F.sum("links").alias("n_links")))


def _labelled(members: DataFrame, labels: DataFrame, held: kit.Durable) -> DataFrame:
    """doc_id, tag, n and label of every document; texts of one label are linked. Without shingles the label is null."""
    named = kit.spread_join(members, labels.withColumnRenamed("node", "sig"), "sig", ["doc_id", "tag"], "left")
    return held.hold(named.select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.coalesce("label", "sig")).alias("label")))


def near_duplicates(docs: DataFrame, held: kit.Durable, percent: int = PERCENT, width: int = WIDTH, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every document and, if ``counted``, n_links: the number of all links of its component."""
    members, labels, sets = similar_classes(docs, held, percent, width)
    named = _labelled(members, labels, held)
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if counted:
        least = least.join(count_links(members, labels, sets, held, percent), "label", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return kit.spread_join(named, least, "label", ["doc_id", "tag"], "left").select(*columns)


def keep_one(docs: DataFrame, held: kit.Durable, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """docs with one row of each group of linked ones: that of the smallest id. Rows without words all stay."""
    members, labels, _ = similar_classes(docs, held, percent, width)
    named = _labelled(members, labels, held).withColumn("id", kit.doc_key())
    first = named.filter("label is not null").groupBy("label").agg(F.min(F.struct("id", "tag")).alias("k")).select(F.col("k.id").alias("__vx_id"), F.col("k.tag").alias("__vx_tag"), F.lit(1).alias("__vx_most"))
    blank = named.filter("label is null").select(F.col("id").alias("__vx_id"), F.col("tag").alias("__vx_tag"), F.lit(None).cast("int").alias("__vx_most")).distinct()
    own = docs.withColumn("__vx_id", kit.doc_key()).withColumn("__vx_tag", F.xxhash64("text"))
    kept = own.join(first.unionByName(blank), ["__vx_id", "__vx_tag"])
    nth = F.row_number().over(Window.partitionBy("__vx_id", "__vx_tag").orderBy(F.lit(0)))
    return kept.withColumn("__vx_n", nth).filter("__vx_most is null or __vx_n <= __vx_most").select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, kit.Durable(spark, "jaccard-join", docs), counted=False)


def op10_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_jaccard_join with n_links as a further column, which that query's SQL does not have."""
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, kit.Durable(spark, "jaccard-links", docs))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM o WHERE 100 * o >= 80 * (na + nb - o) UNION ALL SELECT b, a FROM o WHERE 100 * o >= 80 * (na + nb - o)),
r AS (SELECT doc_id, doc_id AS reach FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""
