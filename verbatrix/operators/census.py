"""Table census: what a table looks like, and whether it holds data or only lays out a page.

Input is a row a table: rows (array of arrays of cells), flat_text, nested, ix_nonfraction, ix_nonnumeric. All metrics are
expressions on that row; there is no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written
from . import sections

# What cells hold.
NUMERIC_CELL = r"^[\s$€£¥(){}\[\]\-–—%0-9.,:]*[0-9][\s$€£¥(){}\[\]\-–—%0-9.,:]*$"
YEAR = r"\b(?:19|20)\d{2}\b"
PAREN_NEGATIVE = r"^\(\s*[\d.,]+\s*\)$"
CURRENCY = r"[$€£¥]"
PERIOD = r"(?i)(\b(?:19|20)\d{2}\b)|(\b[1-4]\s*[QH]\s*\d{2}\b)|(\b[QH]\s*[1-4]\b)|(\bFY\s*\d{2,4}\b)"
# Thresholds.
DATA_ROWS, DATA_COLUMNS, NUMERIC_ROWS = 3, 2, 2
CONSISTENT, IRREGULAR = 0.8, 0.5
NUMERIC, FEW_NUMBERS = 0.30, 0.15
MOSTLY_EMPTY, PROSE_CHARS, PARAGRAPH_CHARS = 0.90, 80, 400
FACTS, FACTS_PER_CELL = 5, 0.20
HEADER_ROWS, PREVIEW = 3, 300
#: Ranges into which values are cut at a time, and distinct values that a task sorts.
BINS, RANKED = 256, 1_000_000
BUCKETS = ("likely_data", "likely_layout", "ambiguous", "nested", "mostly_text", "merged_header", "ixbrl_heavy")


def is_numeric(text: Column) -> Column:
    return text.rlike(NUMERIC_CELL)


def is_period(text: Column) -> Column:
    return text.rlike(PERIOD)


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)


def profile(tables: DataFrame) -> DataFrame:
    """Adds the metrics, primary_bucket and buckets. Ratios have three decimals, halves going to the even one."""
    texts = lambda row: F.transform(row, lambda c: c["text"])
    base = (
        tables.withColumn("cells", F.flatten("rows"))
        .withColumn("widths", F.transform(F.filter("rows", lambda r: F.size(r) > 0), lambda r: _total(F.transform(r, lambda c: c["colspan"].cast("long")))))
        .withColumn("texts", F.transform("cells", lambda c: c["text"]))
        .withColumn("filled", F.filter("texts", lambda t: t != ""))
        .withColumn("lengths", F.transform("filled", lambda t: F.length(t)))
    )
    ratio = lambda part, whole, digits=3: F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(0.0))
    modal = F.array_max(F.transform(F.array_distinct("widths"), lambda w: _count(F.col("widths"), lambda x: x == w)))
    first = F.get(F.filter("rows", lambda r: F.exists(r, lambda c: c["text"] != "")), F.lit(0))
    labels = lambda f: (F.size(f) >= 2) & (2 * _count(f, lambda t: ~is_numeric(t)) >= F.size(f))
    header = F.coalesce(T.let(F.filter(texts(first), lambda t: t != ""), labels), F.lit(False))
    periods = lambda i: F.coalesce(_count(F.get("rows", i), lambda c: is_period(c["text"])), F.lit(0)) >= 2
    spanning = lambda i: F.coalesce(F.exists(F.get("rows", i), lambda c: c["colspan"] > 1), F.lit(False))
    above = F.lit(False)
    for i in range(HEADER_ROWS):
        above = above | (spanning(F.lit(i)) & (periods(F.lit(i + 1)) | periods(F.lit(i + 2))))
    has = lambda pattern: _count(F.col("texts"), lambda t: t.rlike(pattern))
    measured = base.select(
        *tables.columns,
        F.size("rows").alias("n_rows"), F.coalesce(F.array_max("widths"), F.lit(0)).cast("int").alias("max_cols"), F.coalesce(F.array_min("widths"), F.lit(0)).cast("int").alias("min_cols"),
        ratio(modal, F.size("widths")).alias("col_count_consistency"),
        _count(F.col("cells"), lambda c: c["tag"] == "td").alias("td_count"), _count(F.col("cells"), lambda c: c["tag"] == "th").alias("th_count"),
        ratio(_count(F.col("filled"), is_numeric), F.size("filled")).alias("numeric_ratio"),
        F.when(F.size("texts") > 0, F.bround(1 - F.size("filled") / F.size("texts"), 3)).otherwise(F.lit(0.0)).alias("empty_cell_ratio"),
        _count(F.col("rows"), lambda r: _count(r, lambda c: is_numeric(c["text"])) >= 2).alias("numeric_row_count"),
        has(YEAR).alias("year_count"), has(CURRENCY).alias("currency_count"), has("%").alias("percent_count"), has(PAREN_NEGATIVE).alias("paren_negative_count"),
        _count(F.col("cells"), lambda c: c["rowspan"] > 1).alias("rowspan_count"), _count(F.col("cells"), lambda c: c["colspan"] > 1).alias("colspan_count"),
        ratio(_total(F.col("lengths")), F.size("lengths"), 1).alias("avg_cell_chars"), F.coalesce(F.array_max("lengths"), F.lit(0)).alias("max_cell_chars"),
        F.length("flat_text").alias("total_chars"), header.alias("has_header_row_candidate"), above.alias("superheader_suspected"),
        F.substring(T.collapse(F.col("flat_text")), 1, PREVIEW).alias("text_preview"),
    )
    identity = T.collapse(F.col("flat_text"))
    named = F.when(identity == "", F.concat(F.lit("empty-"), F.col("table_order").cast("string"))).otherwise(identity)
    return classify(measured.withColumn("table_id", T.block_id(F.col("doc_id"), F.lit("table"), named, F.lit(1))))


def classify(measured: DataFrame) -> DataFrame:
    """Adds data_signals, layout_signals, buckets and primary_bucket."""
    c = F.col
    repeated = c("numeric_row_count") >= NUMERIC_ROWS
    signal = lambda name, test: F.when(test, F.lit(name))
    data = [
        signal("rows>=3", c("n_rows") >= DATA_ROWS), signal("cols>=2", c("max_cols") >= DATA_COLUMNS), signal("consistent_widths", c("col_count_consistency") >= CONSISTENT),
        signal("numeric", c("numeric_ratio") >= NUMERIC), signal("repeated_numeric_rows", repeated), signal("period_headers", (c("year_count") >= 2) | c("superheader_suspected")),
        signal("accounting_marks", (c("currency_count") > 0) | (c("percent_count") > 0) | (c("paren_negative_count") > 0)), signal("header_row", c("has_header_row_candidate")),
    ]
    layout = [
        signal("few_rows", c("n_rows") < DATA_ROWS), signal("irregular_widths", c("col_count_consistency") < IRREGULAR), signal("paragraph_cell", c("max_cell_chars") >= PARAGRAPH_CHARS),
        signal("prose_cells", c("avg_cell_chars") >= PROSE_CHARS), signal("nested", c("nested") > 0), signal("single_column", c("max_cols") <= 1),
        signal("mostly_empty", c("empty_cell_ratio") >= MOSTLY_EMPTY), signal("few_numbers", c("numeric_ratio") < FEW_NUMBERS), signal("no_repeated_rows", ~repeated),
    ]
    signals = measured.withColumn("data_signals", F.array_compact(F.array(*data))).withColumn("layout_signals", F.array_compact(F.array(*layout)))
    facts, cells = c("ix_nonfraction") + c("ix_nonnumeric"), c("td_count") + c("th_count")
    is_layout = F.size("layout_signals") >= 2
    is_data = (c("numeric_ratio") >= NUMERIC) & repeated & (F.size("data_signals") >= 4) & ~is_layout
    shape = F.when(is_data, F.lit("likely_data")).when(is_layout, F.lit("likely_layout")).otherwise(F.lit("ambiguous"))
    text_heavy = (c("avg_cell_chars") >= PROSE_CHARS) & (c("numeric_ratio") < FEW_NUMBERS)
    buckets = F.array_compact(F.array(
        signal("nested", c("nested") > 0), signal("ixbrl_heavy", (facts >= FACTS) & (cells > 0) & (facts >= FACTS_PER_CELL * cells)),
        signal("merged_header", c("superheader_suspected") | ((c("colspan_count") > 0) & c("has_header_row_candidate")) | (c("rowspan_count") > 0)),
        signal("mostly_text", text_heavy), shape,
    ))
    primary = F.when((c("nested") > 0) & (shape == "likely_data"), F.lit("nested")).when(text_heavy & (shape != "likely_layout"), F.lit("mostly_text")).otherwise(shape)
    return signals.withColumn("buckets", buckets).withColumn("primary_bucket", primary)


def attribute(tables: DataFrame, made: DataFrame) -> DataFrame:
    """Tables with the section in which they start. Boundaries must come from the unconverted text, as the offsets do."""
    placed = tables.drop("section_id").withColumn("offset", F.coalesce("start", F.lit(0)).cast("long"))
    return sections.located(placed, sections.with_front_matter(made)).drop("offset")


def find_tables(profiles: DataFrame, table_id: str | None = None, contains: list[str] | None = None) -> DataFrame:
    """The first table, by document and order, with this id or with all of these strings in its text."""
    hit = F.lit(False)
    if table_id:
        hit = hit | (F.col("table_id") == table_id)
    if contains:
        all_there = F.lit(True)
        for needle in contains:
            all_there = all_there & F.col("flat_text").contains(needle)
        hit = hit | all_there
    return profiles.filter(hit).orderBy("doc_id", "table_order").limit(1)


def _looked_up(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """x with the further columns of y, of which there is one row for each value of ``by``; nulls are values too."""
    right = y.withColumnsRenamed({c: f"__{c}" for c in by})
    if not by:
        return x.join(F.broadcast(right))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return x.join(right, same).drop(*[f"__{c}" for c in by])


def percentiles(df: DataFrame, column: str, keys: tuple[str, ...] = (), points: tuple[int, ...] = (0, 25, 50, 75, 90, 100), most: int = RANKED, bins: int = BINS) -> DataFrame:
    """p0, p25, ... by position: the value at floor(p / 100 * n) of the sorted values, or the last. Values are numbers.

    Rows are counted by value first. Then ranges of values are cut ``bins`` ways: their counts tell which ranges hold
    a wanted position, and only these are kept, until none has more than ``most`` distinct values. What is sorted in one task is so
    many values, whatever the size of a group. Groups without a value are left out.
    """
    wanted = lambda n: F.array(*[F.least(F.floor(F.lit(p) / 100 * n), n - 1) for p in points])
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("here"))
    rows = written(counts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "v", "here", F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("before")), "values")
    names = [f"k{i}" for i in range(len(keys))]
    totals = written(rows.groupBy(*names).agg(F.sum("here").alias("n")), "totals")
    while (rows.groupBy(*names, "range").agg(F.count("*").alias("values")).agg(F.max("values")).head()[0] or 0) > most:
        cuts = rows.groupBy(*names, "range").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 100 * bins).alias("cuts"))
        cut = _looked_up(rows, cuts, [*names, "range"]).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).drop("cuts")
        sizes = cut.groupBy(*names, "range", "before", "bin").agg(F.sum("here").alias("size"))
        # A range has few bins: their running sums are made within a row.
        lists = sizes.groupBy(*names, "range", "before").agg(F.sort_array(F.collect_list(F.struct("bin", "size"))).alias("l"))
        sums = lists.withColumn("ends", T.scanned(F.transform("l", lambda e: e["size"]), lambda a, b: a + b, F.lit(0).cast("long")))
        placed = _looked_up(sums, totals, names).select(*names, "range", "n", F.inline(F.zip_with("l", "ends", lambda e, end: F.struct(e["bin"].alias("bin"), (F.col("before") + end - e["size"]).alias("start"), (F.col("before") + end).alias("end")))))
        holds = F.exists(wanted(F.col("n")), lambda at: (at >= F.col("start")) & (at < F.col("end")))
        kept = placed.filter(holds).select(*names, "range", "bin", "start")
        rows = written(_looked_up(cut, kept, [*names, "range", "bin"]).select(*names, "v", "here", F.xxhash64("range", "bin").alias("range"), F.col("start").alias("before")), "values")
    upto = F.col("before") + F.sum("here").over(Window.partitionBy(*names, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = _looked_up(rows.withColumn("upto", upto), totals, names).withColumn("at", wanted(F.col("n")))
    value = lambda i: F.max(F.when((F.col("at")[i] < F.col("upto")) & (F.col("at")[i] >= F.col("upto") - F.col("here")), F.col("v")))
    made = ranked.groupBy(*names).agg(*[value(i).alias(f"p{p}") for i, p in enumerate(points)])
    return made.withColumnsRenamed(dict(zip(names, keys)))


def bucket_counts(profiles: DataFrame) -> DataFrame:
    """doc_id, bucket, primary (tables of which it is the primary bucket) and any (that carry it); doc_id null for the total."""
    one = profiles.select("doc_id", F.explode(F.transform("buckets", lambda b: F.struct(b.alias("bucket"), (b == F.col("primary_bucket")).cast("int").alias("primary")))).alias("b"))
    # A primary bucket that is not among the buckets counts too.
    extra = profiles.filter(~F.array_contains("buckets", F.col("primary_bucket"))).select("doc_id", F.struct(F.col("primary_bucket").alias("bucket"), F.lit(1).alias("primary")).alias("b"))
    every = one.select("doc_id", "b.bucket", "b.primary", F.lit(1).alias("any")).unionByName(extra.select("doc_id", "b.bucket", "b.primary", F.lit(0).alias("any")))
    sums = every.groupingSets([["doc_id", "bucket"], ["bucket"]], "doc_id", "bucket").agg(F.sum("primary").alias("primary"), F.sum("any").alias("any"))
    return sums


def merged_headers(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("doc_id").agg(
        F.count("*").alias("tables"), F.count_if(F.array_contains("buckets", "merged_header")).alias("merged_header"), F.count_if("superheader_suspected").alias("superheader"),
        F.count_if(F.col("rowspan_count") > 0).alias("rowspan"), F.count_if(F.col("colspan_count") > 0).alias("colspan"),
    )


def ixbrl_coverage(profiles: DataFrame) -> DataFrame:
    facts = F.col("ix_nonfraction") + F.col("ix_nonnumeric")
    return profiles.groupBy("doc_id").agg(
        F.count("*").alias("tables"), F.count_if(facts > 0).alias("with_facts"), F.sum(facts).alias("facts"), F.sum("ix_nonfraction").alias("nonfraction"),
        F.sum("ix_nonnumeric").alias("nonnumeric"), F.count_if(F.array_contains("buckets", "ixbrl_heavy")).alias("ixbrl_heavy"),
    )


def examples(profiles: DataFrame, key: str = "primary_bucket", count: int = 3) -> DataFrame:
    """Every k-th table of each bucket, ``count`` of them."""
    w = Window.partitionBy(key)
    placed = profiles.withColumn("i", F.row_number().over(w.orderBy("doc_id", "table_order")) - 1).withColumn("n", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("n") / count), F.lit(1))
    return placed.filter((F.col("i") % step == 0) & (F.col("i") / step < count)).drop("i", "n")
