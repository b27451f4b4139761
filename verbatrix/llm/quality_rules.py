"""Quality rules with risk-controlled thresholds (operator 9). DataFrame functions only.

Every text gets counts of words, symbols, repeated lines and repeated 5-word windows, and five ratios of them. Its badness is
the worst of its ratios, each against what is usual: the 99th percentile of that ratio among good documents of a fitting
fold, a quarter of the labelled documents by a hash of their id.

The other labelled documents are the holdout. Within a stratum (a language; null is one too) texts worse than a threshold are
rejected. With n good documents of the holdout, of which k are rejected, a threshold is admitted only if the exact binomial
tail P(Binomial(n, risk) <= k) is at most ``delta / strata`` (Bonferroni across strata). There is one score and one threshold
a stratum, and thresholds are tested from the laxest on until the first fails, so no further correction is due. So, with
probability 1 - delta, no stratum loses more than ``risk`` of the good documents that pass the base rule, by all five ratios
together; what the base rule takes is not counted. A stratum with too few good documents for any threshold rejects nothing.

Defined cases: null and empty texts have no words, so all counts are 0 and base_failed is true. A document labelled more
than once counts as good if any label says so. Labels of unknown documents and null labels are ignored. Rows with equal
or null doc_id are judged one by one; null ids carry no label. An empty table gives an empty result. Extra columns are
ignored. Texts as bad as the threshold are kept. Without a fitting fold, what is usual is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

WINDOW = 5
#: Ratios count in so many steps.
STEPS = 1000
#: One in so many labelled documents, by hash, tells what is usual, up to this share of good ones.
FOLDS = 4
USUAL = 0.99
#: Rule name: ratio, of which larger values are worse.
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "word_chars"),
}
RISK = 0.02
DELTA = 0.05


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column, width: int) -> Column:
    """How many positions the windows at the sorted ``starts`` cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + s + width - F.greatest(s, acc["end"])).alias("n"), (s + width).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _repeated(windows: Column, width: int) -> Column:
    """Positions that lie in a window whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))
    flagged = let(pairs, lambda p: F.filter(p, lambda x, i: same(p, x, i)))
    return _covered(F.sort_array(F.transform(flagged, lambda x: x["i"])), width)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every whole text; one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", text.alias("t"))
    split = base.select(
        "doc_id", "lang",
        F.array_remove(F.split("t", kit.BLANKS), "").alias("words"),
        F.length(F.regexp_replace("t", kit.BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("t", r"[^!]+", "")).cast("long").alias("n_exclamations"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counts = ["word_chars", "n_symbols", "n_capitals", "n_exclamations"]
    roll = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - WINDOW), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(WINDOW)]))
    hashed = split.select(
        "doc_id", "lang", *counts,
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, let(F.transform("words", lambda w: F.xxhash64(w)), roll)).alias("windows"),
    )
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated(F.col("windows"), WINDOW)).otherwise(0)
    return hashed.select("doc_id", "lang", *counts, "n_words", "n_lines", "n_dup_lines", F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _step(rule: str) -> Column:
    part, whole = RATIOS[rule]
    return F.when(F.col(whole) > 0, F.floor(F.lit(STEPS) * F.col(part) / F.col(whole))).otherwise(F.lit(0)).cast("int")


def _log_factorial(n: Column) -> Column:
    """Exact up to 20!, beyond it Stirling's series, whose error is less than 1 / (1680 n ** 7)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n > 20, series).otherwise(F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double")))


def tail_is_small(k: Column, n: Column, risk: float, level: Column) -> Column:
    """Whether P(Binomial(n, risk) <= k) <= level: then the exact upper confidence bound of k in n is at most risk.

    Terms are added from the k-th down, each by its ratio to the one before. Below the mean these fall faster than a geometric
    series, which bounds what follows the last one added; some 40 standard deviations of terms leave nothing that counts.
    """
    odds = risk / (1 - risk)
    ratio = lambda i: i / ((n - i + 1) * odds)
    terms = F.least(k, F.ceil(40 * F.sqrt(k.cast("double"))) + 40)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda acc, j: let(acc["term"] * ratio(k - j), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))
    steps = F.when(terms > 0, F.sequence(F.lit(0).cast("long"), terms.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    rest = ratio(k - terms)
    total = F.aggregate(steps, start, step, lambda acc: acc["sum"] + acc["term"] * rest / (1 - rest))
    log_term = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(risk) + (n - k) * math.log1p(-risk)
    # The margin is for rounding: logarithms of factorials are large numbers.
    return F.when(k >= risk * n, F.lit(False)).otherwise(log_term + F.log(total) <= F.log(level) - 1e-5)


def usual(good: DataFrame) -> dict[str, int]:
    """Each rule's usual step, from good documents of the fitting fold: one row."""
    row = good.agg(*[F.percentile(_step(r), USUAL).alias(r) for r in RATIOS]).head()
    return {r: math.ceil(row[r] or 0) for r in RATIOS}


def badness(steps: dict[str, int]) -> Column:
    """The worst of a text's ratios against what is usual."""
    return F.greatest(*[(_step(r) + 1) / F.lit(float(steps[r] + 1)) for r in RATIOS])


def good_documents(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of documents that are labelled good and pass the base rule, and whether they belong to the fitting fold."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return counts.filter(~base_failed()).join(good, "doc_id", "left_semi").withColumn("fitting", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0)


def thresholds(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, threshold: texts that are worse are rejected. holdout: lang and badness of good documents.

    Badness has at most some thousands of values, so what is ranked is a few rows a stratum.
    """
    cells = holdout.groupBy("lang", "badness").agg(F.count("*").alias("here"))
    by_lang = Window.partitionBy("lang")
    worse = F.sum("here").over(by_lang.orderBy(F.desc("badness")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = cells.select("lang", "badness", F.sum("here").over(by_lang).alias("n"), worse.alias("k"))
    strata = holdout.select("lang").distinct().count()
    level = F.lit(delta / max(strata, 1))
    judged = ranked.select("lang", "badness", tail_is_small(F.lit(0).cast("long"), F.col("n"), risk, level).alias("any"), tail_is_small(F.col("k"), F.col("n"), risk, level).alias("ok"))
    # To reject all that are as bad as a value or worse fails for the least value at the latest.
    return judged.filter("any and not ok").groupBy(F.col("lang").alias("stratum")).agg(F.max("badness").alias("threshold"))


def judge(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """counts with base_failed and kept."""
    good = good_documents(counts, labels)
    steps = usual(good.filter("fitting"))
    chosen = thresholds(good.filter("not fitting").select("lang", badness(steps).alias("badness")), risk, delta)
    # One row a language; languages of unknown number are joined as they come.
    joined = counts.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    rejected = F.coalesce(badness(steps) > F.col("threshold"), F.lit(False))
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = kit.Durable(spark, "quality-rules", docs).write(text_counts(docs), "counts")
    return judge(counts, kit.table(spark, sf_dir, "labels"))
