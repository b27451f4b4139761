"""Grading of answers against labelled questions.

A grade of null means "does not apply", which is not False; only ``correct`` is never null. Runs are rows
(question_id, question, answer_text, resolved_citations), questions follow ``sources.records.QUESTION``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..providers import LanguageModel
from .calls import Ledger, complete

# How a refusal reads.
DECLINES = (
    "does not provide", "does not contain", "not provided", "cannot answer",
    "not specified", "is missing", "are missing", "lacks details", "lacks specific",
    "no information", "not included", "not disclosed", "unable to determine",
    "not detailed", "does not include", "does not specify", "not available",
)
# Spellings of units.
UNIT_SPELLINGS = {
    "usd millions": (
        "usd millions", "usd million", "$ million", "$million", "million dollars",
        "millions of dollars", "million usd", "millions usd", "in millions",
        "$ billion", "billion dollars", "billion usd", "usd billions", "usd billion",
        "millions", "million", "billions", "billion",
    ),
    "million shares": ("million shares", "millions of shares", "shares", "million common shares"),
    "percent": ("percent", "%", "percentage points", "pct"),
    "usd billions, full year": ("billion", "billions", "usd billion", "usd billions", "$ billion", "billion dollars"),
}
# What scale words and units multiply by, and which filing periods stand for a period.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
UNIT_FACTORS = {"usd millions": 1e6, "million shares": 1e6, "percent": 1.0, "usd billions, full year": 1e9}
PERIODS = {"Q2-2026": ("Q2-2026",), "H1-2026": ("Q2-2026",), "Q2-2026 vs Q2-2025": ("Q2-2026",), "FY2025": ("FY2025",)}
# Limits, and the expected keys that are figures.
TOLERANCE, PERCENT_WITHIN, CLAIMS_PASS = 0.01, 14, 0.75
FIGURES = ("value", "shares", "cost", "value_2026", "value_2025", "value_from", "value_to")
CATEGORIES = ("tabular", "narrative", "transcript", "no_answer")

NUMBER = r"-?\d[\d,]*\.?\d*"
JUDGE_RULES = "You judge whether an answer states given facts. Wording may differ, figures and subjects may not. Reply with JSON only."


def numbers(text: Column) -> Column:
    """array<struct<number, scale, percent>> of all figures; percent if "%" or "percent" follows within a few characters.

    What follows a figure is the text up to the next one, and as many more parts as have those characters.
    """
    word_after = r"(?i)\A\s*(thousand|million|billion|trillion)"

    def one(hit: Column, after: Column) -> Column:
        gap = F.coalesce(F.get(after, F.lit(0))["gap"], F.lit(""))
        word = F.lower(F.regexp_extract(gap, word_after, 1))
        scale = reduce(lambda c, s: c.when(word == s, F.lit(SCALES[s])), list(SCALES)[1:], F.when(word == "thousand", F.lit(1e3))).otherwise(F.lit(1.0))
        tail = F.regexp_replace(gap, r"(?i)\A\s*(?:thousand|million|billion|trillion)|\A\s*", "")
        short = lambda t: F.substring(F.coalesce(t, F.lit("")), 1, PERCENT_WITHIN)
        more = F.array_join(F.transform(after, lambda p, i: F.concat(F.when(i == 0, short(tail)).otherwise(short(p["gap"])), short(p["hit"]))), "")
        near = F.lower(short(more))
        return F.struct(F.regexp_replace(hit, ",", "").cast("double").alias("number"), scale.alias("scale"), (near.contains("%") | near.contains("percent")).alias("percent"))

    def read(parts: Column) -> Column:
        made = F.transform(parts, lambda p, i: F.when(p["hit"].isNotNull(), one(p["hit"], F.slice(parts, i + 2, F.lit(PERCENT_WITHIN + 1)))))
        return F.filter(made, lambda x: x.isNotNull())

    return T.let(T.match_parts(text, NUMBER), read)


def _lookup(key: Column, table: dict, default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for k, v in table.items():
        out = out.when(key == k, v if isinstance(v, Column) else F.lit(v))
    return out.otherwise(default)


def value_present(found: Column, expected: Column, unit: Column) -> Column:
    """Whether some figure equals the expected one within the tolerance, by its own scale, by the unit's, or as written."""
    name = F.lower(F.coalesce(unit, F.lit("")))
    factor = _lookup(name, UNIT_FACTORS, F.lit(1.0))

    def matches(target: Column) -> Column:
        near = lambda v: F.when(target == 0, F.abs(v) < 1e-9).otherwise(F.abs(v - target) / F.abs(target) <= TOLERANCE)
        hit = lambda n: near(n["number"] * n["scale"]) | near(n["number"] * factor) | near(n["number"])
        return F.exists(found, lambda n: ((name != "percent") | n["percent"]) & hit(n))

    return F.when(expected.isNotNull(), T.let(expected * factor, matches))


def unit_of(key: str) -> Column:
    """The unit of an expected figure: its own, a default for shares, or the general one."""
    own = F.col(f"expected.{key}_unit") if key in ("shares", "cost") else F.lit(None).cast("string")
    general = F.lit("million shares") if key == "shares" else F.coalesce("expected.unit", F.lit(""))
    return F.coalesce(F.when(own != "", own), general)


def _required(key: str) -> Column:
    """Whether the question asks for this figure: "value" alone if there is one, else all."""
    there = F.col(f"expected.{key}").isNotNull()
    return there if key == "value" else there & F.col("expected.value").isNull()


def _all(tests: list[tuple[Column, Column]]) -> Column:
    """Conjunction of the tests that apply; null if none does."""
    results = F.array_compact(F.array(*[F.when(applies, test) for applies, test in tests]))
    return F.when(F.size(results) > 0, F.forall(results, lambda x: x))


def unit_matches(text: Column, unit: Column) -> Column:
    lowered = F.lower(text)
    own = lowered.contains(F.lower(unit))
    return _lookup(F.lower(unit), {u: reduce(lambda a, s: a | lowered.contains(s), spellings, F.lit(False)) for u, spellings in UNIT_SPELLINGS.items()}, own)


def declined(text: Column, n_citations: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, p: a | lowered.contains(p), DECLINES, n_citations == 0)


def judged(runs: DataFrame, questions: DataFrame, model: LanguageModel | None, ledger: Ledger | None = None) -> DataFrame:
    """question_id and claims_score: the share of expected claims that the answer states; null if the reply cannot be read."""
    own = runs.select("question_id", "question", "answer_text")
    joined = own.join(questions.select(F.col("id").alias("question_id"), "category", "expected"), "question_id").filter("category in ('narrative', 'transcript') and size(expected.claims) > 0")
    listed = F.array_join(F.transform("expected.claims", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    ask = F.concat(F.lit("Question:\n"), F.coalesce("question", F.lit("")), F.lit("\n\nAnswer:\n"), F.coalesce("answer_text", F.lit("")), F.lit("\n\nFacts:\n"), listed, F.lit("\n\nReply with a JSON array of booleans, one a fact, in order."))
    if model is None:
        return joined.select("question_id", F.lit(None).cast("double").alias("claims_score"))
    asked = complete(joined.withColumn("n", F.size("expected.claims")), model, JUDGE_RULES, ask, "reply", ledger)
    return asked.select("question_id", claims_score(F.col("reply"), F.col("n")).alias("claims_score"))


def claims_score(reply: Column, n: Column) -> Column:
    """The share of true among n judgements: a JSON array of booleans, or else as many words true and false."""
    parsed = F.from_json(F.regexp_replace(T.strip(reply), r"\A`+|`+\z", ""), "array<boolean>")
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(reply, F.lit(""))), F.lit(r"\b(true|false)\b"), F.lit(1)), lambda w: w == "true")
    whole = (F.size(parsed) == n) & F.forall(parsed, lambda x: x.isNotNull())
    read = F.when(F.coalesce(whole, F.lit(False)), parsed).when(F.size(words) == n, words)
    return F.when(n > 0, F.size(F.filter(read, lambda x: x)) / F.when(read.isNotNull(), n))


def grade(runs: DataFrame, questions: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """A row of grades for each run whose question is known. claims: what ``judged`` gives."""
    spec = questions.select(F.col("id").alias("question_id"), "category", "expected", "evidence")
    g = runs.select("question_id", "answer_text", "resolved_citations").join(spec, "question_id")
    g = g.join(claims, "question_id", "left") if claims is not None else g.withColumn("claims_score", F.lit(None).cast("double"))
    cited = F.filter(F.coalesce("resolved_citations", F.array().cast(runs.schema["resolved_citations"].dataType)), lambda c: c["metadata"].isNotNull())
    name = lambda m: F.concat_ws("_", *[F.when(m[k] != "", m[k]) for k in ("company", "form", "period")])
    document, period = F.col("evidence.document"), F.col("evidence.period")
    accepted = _lookup(period, {p: F.array(*map(F.lit, v)) for p, v in PERIODS.items()}, F.array(period))
    stated = F.when(F.coalesce(document, F.lit("")) != "", F.exists(cited, lambda c: name(c["metadata"]) == document))
    in_period = F.when(F.coalesce(period, F.lit("")) != "", F.exists(cited, lambda c: F.coalesce(F.array_contains(accepted, c["metadata"]["period"]), F.lit(False))))
    n_citations = F.size(F.coalesce("resolved_citations", F.array().cast(runs.schema["resolved_citations"].dataType)))
    tabular, text = F.col("category") == "tabular", F.coalesce("answer_text", F.lit(""))
    g = g.withColumn("found", numbers(text)).withColumn("declined", declined(F.col("answer_text"), n_citations))
    figure = lambda k: value_present(F.col("found"), F.col(f"expected.{k}"), unit_of(k))
    asked_units = [(_required(k) & (unit_of(k) != ""), unit_matches(text, unit_of(k))) for k in FIGURES]
    any_units = [(F.coalesce(F.col(f"expected.{u}"), F.lit("")) != "", unit_matches(text, F.col(f"expected.{u}"))) for u in ("unit", "shares_unit", "cost_unit")]
    extra = [(F.col(f"expected.{k}").isNotNull() & ~_required(k), figure(k)) for k in FIGURES]
    g = g.select(
        "question_id", "category", stated.alias("document_correct"), in_period.alias("period_correct"),
        F.when(tabular, F.coalesce(_all(asked_units), _all(any_units))).alias("unit_correct"),
        F.when(tabular, _all([(_required(k), figure(k)) for k in FIGURES])).alias("value_correct"),
        F.when(tabular, value_present(F.col("found"), F.col("expected.change_pct"), F.lit("percent"))).alias("change_pct_correct"),
        F.when(tabular, _all(extra)).alias("supplementary_values_correct"), F.when(F.col("category").isin("narrative", "transcript"), F.col("claims_score")).alias("claims_score"),
        F.when(F.col("category") == "no_answer", F.col("declined") == F.coalesce("expected.should_decline", F.lit(False))).alias("decline_correct"),
        ((F.col("category") != "no_answer") & F.col("declined")).alias("false_decline"), "declined", n_citations.alias("citations"),
    )
    right = (
        F.when(F.col("category") == "tabular", F.col("value_correct") & F.col("document_correct") & F.col("period_correct"))
        .when(F.col("category").isin("narrative", "transcript"), F.col("claims_score") >= CLAIMS_PASS)
        .when(F.col("category") == "no_answer", F.col("decline_correct"))
    )
    return g.withColumn("correct", F.coalesce(right, F.lit(False)))


def summary(grades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by category, and over all where category is null."""
    scoped = F.coalesce(F.col("value_correct"), F.lit(False)) & ~(F.coalesce("document_correct", F.lit(False)) & F.coalesce("period_correct", F.lit(False)))
    sets = [[*keys, "category"], [*keys]]
    return grades.groupingSets(sets, *keys, "category").agg(
        F.count("*").alias("questions"), F.count_if("correct").alias("correct"), F.count_if("false_decline").alias("false_declines"),
        F.count_if(~F.col("unit_correct")).alias("unit_wrong"), F.count_if(scoped).alias("right_number_wrong_scope"),
        F.count_if(F.col("category").isin("narrative", "transcript") & F.col("claims_score").isNull()).alias("claims_unread"),
    )


def by_version(grades: DataFrame, versions: list[str]) -> DataFrame:
    """question_id, category and, per version, "PASS" or "fail" with the claims score; "(missing)" where it was not run."""
    mark = F.concat(F.when(F.col("correct"), F.lit("PASS")).otherwise(F.lit("fail")), F.when(F.col("claims_score").isNotNull(), F.format_string(" %.2f", "claims_score")).otherwise(F.lit("")))
    wide = grades.groupBy("question_id", "category").pivot("version", versions).agg(F.first(mark))
    return wide.fillna("(missing)", versions)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """question_id, in_a, in_b, answer_changed, sources_changed, sources_a, sources_b of two run sets."""
    pair = lambda c: F.when(c["metadata"].isNotNull(), F.concat(c["metadata"]["form"], F.lit("/"), c["metadata"]["period"])).otherwise(F.lit("UNRESOLVED"))
    side = lambda df, s: df.select("question_id", F.col("answer_text").alias(f"answer_{s}"), F.array_distinct(F.transform("resolved_citations", pair)).alias(f"sources_{s}"), F.lit(True).alias(f"in_{s}"))
    both = side(a, "a").join(side(b, "b"), "question_id", "full")
    there = F.col("in_a") & F.col("in_b")
    return both.select(
        "question_id", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"), F.when(there, ~F.col("answer_a").eqNullSafe(F.col("answer_b"))).alias("answer_changed"),
        F.when(there, ~F.col("sources_a").eqNullSafe(F.col("sources_b"))).alias("sources_changed"), "sources_a", "sources_b",
    )


def side_by_side(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Two ranked lists next to each other, by rank."""
    left, right = a.select(*keys, "rank", F.col("id").alias("id_a")), b.select(*keys, "rank", F.col("id").alias("id_b"))
    return left.join(right, [*keys, "rank"], "full")
