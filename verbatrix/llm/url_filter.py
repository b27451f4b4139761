"""URL filtering by explicit rules and by a tree of path templates (operator 2).

Rules name a host (and all its subdomains) and a path prefix; the longest that fits decides. All other urls are judged by
templates. A host's paths form a tree of segments, which is generalised from the root on, level by level:

- a segment that is evidently variable (digits, hexadecimal, a date, very long) becomes a wildcard of its kind, also with
  the extension that follows; a path of segments so far is its shape;
- a branch point with many different segments, of which most are rare, turns its rare ones into one wildcard;
- of the other branches each, from the largest on, is merged with the first larger one that it is similar to: G-tests find no
  difference in what kinds of segments follow, nor in the shares of blocked urls among the evidence. That is a branch's own
  labelled urls, and each other host that has labels of one of its shapes, as one url. A branch that has evidence is never
  similar to one that has none.

Labels are the urls that a rule decided, or labels that are given. A template's purity is the share of blocked ones among its
labelled urls, smoothed towards what other hosts say of its shapes: a shape's share is the mean over the hosts that have
labels of it, each host counting once, smoothed towards one half. A template is rejected if it has a labelled url of its own and its
purity reaches ``REJECT``: what other hosts say only smooths a host's own labels, so a template without labels is allowed.

Segments are counted before any shuffle, so a host with a third of all pages costs one row a distinct shape; joins that such
a host, or a shape that all hosts have, would gather in one task are dealt into parts. Depth costs one turn a level, for those
templates only that still have several shapes below.

Defined cases: a null url, or one without "://", has an empty host and path and no rule; its path has no segments. A host
may keep its port and login. Of equally long rules the lesser (by text) decides. Of branches with equally many urls the
lesser segment counts as the larger one. Repeated rows are judged alike, each in a row of its own. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

#: (host, path, verdict); the rules of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A branch point with more distinct segments than this wildcards those that hold less than RARE of its urls.
FAN_OUT = 32
RARE = 0.02
#: Branches differ if a G statistic is beyond this many standard deviations of its normal transform (one in ten thousand by chance).
APART = 3.719
#: Weight of what a share is smoothed towards, in urls, or in hosts for a shape.
PRIOR = 4.0
REJECT = 0.7


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The text of the longest rule that fits, and its verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r[0] + r[1]))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    pick = lambda value: F.coalesce(*[F.when(f, F.lit(value(r))) for f, r in zip(fits, ordered)])
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def _kind(segment: Column) -> Column:
    """A segment, or the wildcard of its kind if it is evidently variable."""
    body = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}\z", "")
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})\z", 1)
    wild = (
        F.when(body.rlike(r"\A\d{4}-\d{2}(-\d{2})?\z"), F.lit("{date}"))
        .when(body.rlike(r"\A\d+\z"), F.lit("{number}"))
        .when(body.rlike(r"\A[0-9a-fA-F-]{8,}\z") & body.rlike(r"\d"), F.lit("{hex}"))
        .when(F.length(body) > 40, F.lit("{long}"))
        .when(body.rlike(r"\d"), F.regexp_replace(body, r"\d+", "{number}"))
    )
    return F.coalesce(F.concat(wild, extension), segment)


def shape(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""
    return F.transform(F.slice(F.split(path, "/", -1), 2, 1 << 30), _kind)


def critical(freedom: int) -> float:
    """What a G statistic of so many degrees of freedom seldom exceeds, by the cube root transform of its distribution."""
    return freedom * (1 - 2 / (9 * freedom) + APART * math.sqrt(2 / (9 * freedom))) ** 3


def differ(a: dict, b: dict) -> bool:
    """Whether a G-test tells two distributions, as counts by category, apart."""
    total_a, total_b = sum(a.values()), sum(b.values())
    both = {c: a.get(c, 0) + b.get(c, 0) for c in {**a, **b}}
    all_of = total_a + total_b
    g = 2 * sum(n * math.log(n * all_of / (both[c] * total)) for own, total in ((a, total_a), (b, total_b)) for c, n in own.items() if n)
    return len(both) > 1 and g > critical(len(both) - 1)


def _merge(pdf):
    """The step of each branch of one branch point: its segment, or a wildcard that it shares with those it is similar to."""
    rows = sorted(zip(pdf["n"], pdf["segment"], pdf["follows"], pdf["known"] + pdf["others"], pdf["bad"] + pdf["others_bad"]), key=lambda r: (-r[0], r[1]))
    leaders, led_by = [], {}
    for _, segment, follows, seen, bad in rows:
        own = (dict(follows), {"bad": bad, "good": seen - bad})
        like = next((name for name, (after, labels) in leaders if (sum(labels.values()) > 0) == (seen > 0) and not differ(after, own[0]) and not (seen and differ(labels, own[1]))), None)
        if like is None:
            leaders.append((segment, own))
        else:
            led_by[segment] = like
    shared = set(led_by.values())
    pdf["step"] = ["{~%s}" % led_by.get(s, s) if s in shared or s in led_by else s for s in pdf["segment"]]
    return pdf[["point", "segment", "step"]]


def templates(urls: DataFrame, held: kit.Durable) -> DataFrame:
    """From (host, shape, label) to (host, shape, n, known, bad, told, hosts, template): label is 1 for blocked, 0 for allowed, null if unknown.

    hosts is how many hosts have labels of the shape, told the sum of their shares of blocked ones.

    Works on one row per host and shape, written after each level, so that plans stay short.
    """
    counted = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    counted = held.hold(counted, small=False)
    labelled = counted.filter("known > 0").groupBy("shape").agg(F.sum(F.col("bad") / F.col("known")).alias("told"), F.count("*").alias("hosts"))
    told = kit.spread_join(counted, labelled, "shape", ["host"], "left").withColumns({"told": F.coalesce("told", F.lit(0.0)), "hosts": F.coalesce("hosts", F.lit(0))})
    # Without the host's own share; differences of sums are rounded.
    elsewhere = F.when(F.col("known") > 0, F.greatest(F.round(F.col("told") - F.col("bad") / F.col("known"), 9), F.lit(0.0))).otherwise(F.col("told"))
    told = told.withColumns({"others_bad": elsewhere, "others": F.col("hosts") - (F.col("known") > 0).cast("int")})
    todo = held.hold(told.withColumn("template", F.lit("")).withColumn("level", F.lit(0)), small=False)
    columns, done, sums = todo.columns, [], [F.sum(c).alias(c) for c in ("n", "known", "bad", "others", "others_bad")]
    while True:
        # Nothing is left to tell apart where a path ends, or below a template with one shape.
        point = F.struct("host", "template").alias("point")
        alone = todo.groupBy(point).agg(F.count("*").alias("rows"))
        placed = kit.spread_join(todo.withColumn("point", point), alone, "point", ["shape"]).withColumn("open", (F.col("rows") > 1) & (F.size("shape") > F.col("level")))
        placed = held.hold(placed.select(*columns, "open"), small=False)
        rest = F.array_join(F.slice("shape", F.col("level") + 1, F.lit(1 << 30)), "/")
        last = F.when(F.size("shape") > F.col("level"), F.concat("template", F.lit("/"), rest)).otherwise(F.col("template"))
        done.append(placed.filter("not open").withColumn("template", last).drop("open", "level"))
        todo = placed.filter("open").drop("open")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        after = F.get("shape", F.col("level") + 1)
        follows = F.when(after.isNull(), F.lit("")).when(after.rlike(r"\{"), F.regexp_extract(after, r"(\{\w+\})", 1)).when(after == "", F.lit("/")).otherwise(F.lit("word"))
        here = todo.withColumn("point", point).withColumn("segment", F.get("shape", "level"))
        # There are few kinds of segments, so a branch's distribution is a short list.
        kinds = here.withColumn("follows", follows).groupBy("point", "segment", "follows").agg(*sums)
        branches = held.hold(kinds.groupBy("point", "segment").agg(F.map_from_entries(F.collect_list(F.struct("follows", "n"))).alias("follows"), *sums), small=False)
        points = branches.groupBy("point").agg(F.count("*").alias("fan"), F.sum("n").alias("all"))
        judged = kit.spread_join(branches, points, "point", ["segment"])
        variable = F.col("segment").rlike(r"\{") | (F.col("segment") == "")
        rare = (F.col("fan") > FAN_OUT) & (F.col("n") < RARE * F.col("all"))
        kind = F.when(variable, F.lit("as it is")).when(rare, F.lit("rare")).otherwise(F.lit("branch"))
        judged = held.hold(judged.withColumn("kind", kind), small=False)
        fixed = judged.filter("kind <> 'branch'").select("point", "segment", F.when(F.col("kind") == "rare", F.lit("{any}")).otherwise(F.col("segment")).alias("step"))
        # At most FAN_OUT, or 1 / RARE, branches a point.
        merged = judged.filter("kind = 'branch'").groupBy("point").applyInPandas(_merge, "point struct<host:string,template:string>, segment string, step string")
        steps = fixed.unionByName(merged).select(F.struct("point", "segment").alias("branch"), "step")
        stepped = kit.spread_join(here.withColumn("branch", F.struct("point", "segment")), steps, "branch", ["shape"])
        todo = held.hold(stepped.withColumn("template", F.concat("template", F.lit("/"), "step")).withColumn("level", F.col("level") + 1).select(*columns), small=False)


def purity(nodes: DataFrame) -> DataFrame:
    """host, template, its number of labelled urls and its smoothed share of blocked ones."""
    told = nodes.withColumn("share", (F.col("told") + PRIOR * 0.5) / (F.col("hosts") + PRIOR))
    by_template = told.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"), (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("prior"))
    # Rounded, as the order of addition is not fixed.
    return by_template.select("host", "template", "known", F.round((F.col("bad") + PRIOR * F.col("prior")) / (F.col("known") + PRIOR), 9).alias("purity"))


def judge(pages: DataFrame, held: kit.Durable, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page. ``labels`` (page_id, blocked) add to what rules decide."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("decided", decided).withColumn("shape", shape(F.col("path")))
    own = F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0)
    if labels is not None:
        given = labels.filter("blocked is not null").groupBy("page_id").agg(F.max(F.col("blocked").cast("int")).alias("given"))
        ruled = ruled.join(given, "page_id", "left")
        own = F.coalesce(own, F.col("given"))
    nodes = held.hold(templates(ruled.withColumn("label", own), held), small=False)
    point = F.struct("host", "template").alias("point")
    rated = kit.spread_join(nodes.withColumn("point", point), purity(nodes).select(point, F.col("known").alias("labelled"), "purity"), "point", ["shape"])
    named = held.hold(rated.select(F.struct("host", "shape").alias("node"), "template", "labelled", "purity"), small=False)
    out = kit.spread_join(ruled.withColumn("node", F.struct("host", "shape")), named, "node", ["page_id"], "left")
    verdict = F.coalesce("decided", F.when((F.col("labelled") > 0) & (F.col("purity") >= REJECT), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = kit.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, kit.Durable(spark, "url-filter", pages))
