"""Mixing overlapping sources to target weights by min-cost flow (operator 3).

Documents are aggregated by membership pattern: the set of sources they belong to. Patterns and their sizes make a flow
network: each pattern may send its words once, twice or three times, each repetition at a higher cost, to the sources of
its members, and each source takes up to its target. The cheapest of the largest flows says how many words each pattern
gives. Its documents then are all taken so many times whole, and of the rest those that come first by a seeded hash,
and up to three whose sizes come nearest to what is then missing.

Targets: sources in code point order, null last, get the weights in turn and share the total size by them. A target that is
above ``MOST`` times its source's size stops there, and the excess is shared by weight among the others until none is above.

What reaches the driver is one row a pattern, that is, about one a source: the flow is solved there, and more than
``MOST_PATTERNS`` are an error, not another result. Documents are only ever summed, by hash buckets within a pattern, so a
source with a third of all documents costs as many rows as any other.

Defined cases: a null or blank text has size 0 and takes nothing. A null source is a source of its own, the last. Repeated
rows and null ids are documents of their own; rows that agree in id, size and pattern are taken alike. With equal hashes the
smaller id comes first. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240229
#: Hash buckets within a pattern; only the bucket in which a pattern's remainder ends is sorted.
CELLS = 1024
MOST_PATTERNS = 1_000_000
#: The cost of a pattern's words the first, second and third time.
COSTS = (0, 1, 3)


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), kit.BLANKS), "")).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, Fraction]:
    """Each source's target: its share of the total by weight, where none may be above ``most`` times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_names, out = Fraction(sum(sizes.values())), set(names), {}
    while open_names:
        unit = left / sum(weight[s] for s in open_names)
        full = [s for s in open_names if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_names}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            open_names.remove(s)
    return out


class _Network:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self):
        self.edges: dict[object, list[list]] = defaultdict(list)

    def add(self, a, b, capacity: int, cost: int) -> list:
        forth = [b, capacity, cost, None]
        back = [a, 0, -cost, forth]
        forth[3] = back
        self.edges[a].append(forth)
        self.edges[b].append(back)
        return forth

    def run(self, source, sink) -> None:
        potential: dict[object, int] = defaultdict(int)
        while True:
            far, via, queue, turn = {source: 0}, {}, [(0, 0, source)], 0
            done = set()
            while queue:
                d, _, node = heapq.heappop(queue)
                if node in done:
                    continue
                done.add(node)
                for edge in self.edges[node]:
                    to, capacity, cost, _ = edge
                    step = d + cost + potential[node] - potential[to]
                    if capacity > 0 and (to not in far or step < far[to]):
                        far[to], via[to] = step, (node, edge)
                        turn += 1
                        heapq.heappush(queue, (step, turn, to))
            if sink not in far:
                return
            for node in list(self.edges):
                potential[node] += min(far.get(node, far[sink]), far[sink])
            path, node = [], sink
            while node != source:
                node, edge = via[node]
                path.append(edge)
            amount = min(edge[1] for edge in path)
            for edge in path:
                edge[1] -= amount
                edge[3][1] += amount


def route(patterns: dict[tuple, int], quotas: dict, costs=COSTS) -> dict[tuple, int]:
    """How many words each pattern gives, for its size and the sources' quotas. Sources that share no pattern are solved apart."""
    root = {s: s for p in patterns for s in p}

    def find(s):
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for p in patterns:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    groups = defaultdict(list)
    for p in sorted(patterns, key=lambda p: [(s is None, s or "") for s in p]):
        if p:
            groups[find(p[0])].append(p)
    given = dict.fromkeys(patterns, 0)
    for own in groups.values():
        net, taps = _Network(), defaultdict(list)
        for i, p in enumerate(own):
            for cost in costs:
                taps[p].append(net.add("from", ("pattern", i), patterns[p], cost))
            for s in p:
                net.add(("pattern", i), ("source", s), len(costs) * patterns[p], 0)
        for s in sorted({s for p in own for s in p}, key=lambda s: (s is None, s or "")):
            net.add(("source", s), "to", int(quotas[s]), 0)
        net.run("from", "to")
        for p, edges in taps.items():
            given[p] = sum(edge[3][1] for edge in edges)
    return given


def mix(sized: DataFrame, held: kit.Durable, weights=WEIGHTS, most: int = MOST, seed: int = SEED, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds source_size, target and taken to (keys, size, sources): ``sources`` is a sorted array, of one or more sources.

    source_size and target are those of the first source; taken is the document's size times how often the mix takes it.
    """
    spark = sized.sparkSession
    cell = F.pmod(F.xxhash64(*keys, "size", F.lit(seed)), F.lit(CELLS))
    named = sized.select(*keys, "size", "sources", cell.alias("cell"))
    cells = held.hold(named.groupBy("sources", "cell").agg(F.sum("size").alias("size")))
    if (found := cells.select("sources").distinct().limit(MOST_PATTERNS + 1).count()) > MOST_PATTERNS:
        raise ValueError(f"{found} patterns of sources or more; the flow is solved for up to {MOST_PATTERNS}")
    patterns = {tuple(r.sources): int(r.size) for r in cells.groupBy("sources").agg(F.sum("size").alias("size")).collect()}
    sizes: dict = defaultdict(int)
    for p, size in patterns.items():
        for s in p:
            sizes[s] += size
    # With overlaps, sources hold more than there is; what is shared out is what there is.
    total, held_total = sum(patterns.values()), sum(sizes.values())
    aims = targets(dict(sizes), weights, most)
    if held_total != total:
        aims = {s: a * Fraction(total, held_total) for s, a in aims.items()}
    given = route(patterns, {s: round(a) for s, a in aims.items()})
    plan_rows = []
    for p, size in patterns.items():
        whole = min(len(COSTS), given[p] // size) if size else 0
        plan_rows.append((list(p), float(aims[p[0]]) if p else 0.0, sizes[p[0]] if p else 0, whole, given[p] - whole * size))
    plan = spark.createDataFrame(plan_rows, "sources array<string>, target double, source_size long, whole long, rest long")
    order = Window.partitionBy("sources").orderBy("cell")
    reach = cells.withColumn("after", F.sum("size").over(order)).select("sources", "cell", "after", (F.col("after") - F.col("size")).alias("before"))
    cut = reach.join(plan, "sources").select("sources", "cell", "target", "source_size", "whole", "rest", "before", "after")
    placed = named.join(cut, ["sources", "cell"], "left")
    inside = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    # Of the cell in which the remainder ends, documents are taken as long as they fit.
    within = Window.partitionBy("sources", "cell").orderBy(F.xxhash64(*keys, "size", F.lit(seed + 1)), *keys, "size")
    edge = placed.filter(inside).withColumn("so_far", F.col("before") + F.sum("size").over(within))
    edge = edge.withColumn("more", F.when(F.col("so_far") <= F.col("rest"), 1).otherwise(0))
    clear = placed.filter(~inside).withColumn("more", F.when(F.col("after") <= F.col("rest"), 1).otherwise(0))
    columns = [*keys, "size", "sources", "source_size", "target", "whole", "rest", "more"]
    chosen = held.hold(clear.select(*columns).unionByName(edge.select(*columns)))
    # What is still missing goes to the largest document that fits, again to such a one, and then to the nearest if that helps.
    for turn, reach_of in enumerate((1, 1, 2)):
        gaps = chosen.groupBy("sources").agg((F.max("rest") - F.sum(F.col("size") * F.col("more"))).alias("gap"))
        others = chosen.filter("more = 0 and size > 0").join(gaps, "sources").filter(F.col("size") < reach_of * F.col("gap") + int(reach_of == 1))
        filler = others.groupBy("sources").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.xxhash64(*keys, "size", F.lit(seed)).alias("h"), *keys, "size")).alias("f"))
        filler = filler.select("sources", F.col("f.size").alias("f_size"), *[F.col(f"f.{k}").alias(f"f_{k}") for k in keys])
        picked = F.col("size") == F.col("f_size")
        for k in keys:
            picked = picked & F.col(k).eqNullSafe(F.col(f"f_{k}"))
        chosen = held.hold(chosen.join(filler, "sources", "left").withColumn("more", F.when(picked, 1).otherwise(F.col("more"))).select(*columns))
    return chosen.select(*keys, "size", "sources", "source_size", "target", (F.col("size") * F.least(F.col("whole") + F.col("more"), F.lit(most))).alias("taken"))


def sized_documents(docs: DataFrame, held: kit.Durable) -> DataFrame:
    """doc_id, size and sources of every document, read once."""
    return held.write(docs.select("doc_id", word_count(F.col("text")).alias("size"), F.array("source").alias("sources")), "sized")


def mixed(docs: DataFrame, held: kit.Durable) -> DataFrame:
    """docs with each row as often as the mix takes it; rows of size 0 are not taken."""
    tag = F.xxhash64("text")
    sized = held.write(docs.select(kit.doc_key().alias("__vx_id"), tag.alias("__vx_tag"), word_count(F.col("text")).alias("size"), F.array("source").alias("sources")), "sized")
    times = mix(sized, held, keys=("__vx_id", "__vx_tag")).filter("taken > 0").select("__vx_id", "__vx_tag", (F.col("taken") / F.col("size")).cast("int").alias("__vx_times"))
    # Rows that agree in id and text are taken alike; a differing source would make another row of them.
    times = times.groupBy("__vx_id", "__vx_tag").agg(F.max("__vx_times").alias("__vx_times"))
    own = docs.withColumn("__vx_id", kit.doc_key()).withColumn("__vx_tag", tag).join(times, ["__vx_id", "__vx_tag"])
    return own.withColumn("__vx_copy", F.explode(F.array_repeat(F.lit(0), F.col("__vx_times")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    held = kit.Durable(spark, "mixing", docs)
    return mix(sized_documents(docs, held), held).drop("sources")
