"""Answers: context, citations, verification and confidence, as columns over a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..providers import LanguageModel
from .calls import Ledger, complete

# How citations look (1 to 99, so that years in brackets are not taken for one), and how a refusal reads.
CITATION = r"\[([1-9]\d?(?:\s*,\s*[1-9]\d?)*)\]"
CITATION_PLAIN = r"\[[1-9]\d?(?:\s*,\s*[1-9]\d?)*\]"
REFUSALS = ("does not provide", "does not contain", "does not specify", "not enough information", "no information", "is missing")
# Confidence.
REFUSED, SUPPORT, RETRIEVAL = 0.35, 0.6, 0.4
NO_PASSAGE = "citation number does not resolve to a context passage"

ANSWER_RULES = """Answer from the numbered passages alone.
Cite the passage of each statement as [n], several as [1][2]. Give figures as written, with unit, period and scope, and do not
combine figures of different periods or scopes. If the passages hold only part of the answer, give that part and name what is
missing; if they hold none of it, say that the context does not provide it. Be brief."""
SUPPORT_RULES = """Say whether the passage supports the claim: every figure, period and name of the claim must be in it.
Reply on one line: YES - reason, or NO - reason, in a few words."""


def header(number: Column, form: Column, period: Column, section: Column) -> Column:
    """ "[n] (form, period, section)"; a section "none" is left out."""
    inside = F.concat_ws(", ", form, period, F.when(section != "none", section))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] ("), inside, F.lit(")"))


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, context and citation_map (number -> id) of (query_id, rank, id, text, form, period, section), by rank."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    numbered = hits.withColumn("number", number)
    passage = F.concat(header(F.col("number"), F.col("form"), F.col("period"), F.coalesce("section", F.lit("none"))), F.lit("\n"), "text")
    rows = numbered.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("number", passage.alias("passage"), "id"))).alias("p"))
    return rows.select("query_id", F.array_join(F.transform("p", lambda x: x["passage"]), "\n\n").alias("context"), F.map_from_entries(F.transform("p", lambda x: F.struct(x["number"], x["id"]))).alias("citation_map"))


def citations(text: Column) -> Column:
    """Cited numbers in the order in which they first appear."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda n: T.strip(n).cast("int")))


def resolve(answers: DataFrame) -> DataFrame:
    """query_id, position, number and id (null if no passage has the number) of (query_id, answer_text, citation_map)."""
    cited = answers.select("query_id", "citation_map", F.posexplode(citations(F.col("answer_text"))).alias("position", "number"))
    return cited.select("query_id", "position", "number", F.try_element_at("citation_map", F.col("number")).alias("id"))


def claims(text: Column) -> Column:
    """array<struct<number, claim>>: for each citation the text since the one before; next to each other they share it."""
    numbers = lambda hit: F.split(F.regexp_replace(hit, r"[\[\]\s]", ""), ",")

    def cut(parts: Column) -> Column:
        own = F.transform(parts, lambda p: T.strip(p["gap"]))
        shared = T.scanned(own, lambda before, here: F.when(here == "", before).otherwise(here), F.lit(""))
        return F.flatten(F.zip_with(parts, shared, lambda p, claim: F.transform(numbers(p["hit"]), lambda n: F.struct(n.cast("int").alias("number"), claim.alias("claim")))))

    return T.let(F.filter(T.match_parts(text, CITATION_PLAIN), lambda p: p["hit"].isNotNull()), cut)


def verdict(reply: Column) -> tuple[Column, Column]:
    """supported and reason of a reply; anything that does not begin with YES is no support."""
    text = T.strip(F.coalesce(reply, F.lit("")))
    supported = F.upper(T.strip(F.substring_index(text, "-", 1))).startswith("YES")
    reason = T.strip(F.when(F.instr(text, "-") > 0, F.substring(text, F.instr(text, "-") + 1, F.length(text))).otherwise(F.lit("")))
    return supported, F.when(reason == "", text).otherwise(reason)


def generate(questions: DataFrame, hits: DataFrame, model: LanguageModel, ledger: Ledger | None = None) -> DataFrame:
    """query_id, query, context, citation_map, answer_text and answer_text_error."""
    ready = questions.select("query_id", "query").join(contexts(hits), "query_id", "left")
    user = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "query")
    return complete(ready, model, ANSWER_RULES, user, "answer_text", ledger)


def verify(answers: DataFrame, passages: DataFrame, model: LanguageModel, ledger: Ledger | None = None) -> DataFrame:
    """query_id, position, number, id, claim, supported, reason: one row per citation in (query_id, answer_text, citation_map).

    passages: query_id, id, text. A number without a passage is not supported, and no model is asked.
    """
    made = answers.select("query_id", "citation_map", F.posexplode(claims(F.col("answer_text"))).alias("position", "c"))
    pairs = made.select("query_id", "position", "c.number", "c.claim", F.try_element_at("citation_map", F.col("c.number")).alias("id"))
    joined = pairs.join(passages.select("query_id", "id", F.col("text").alias("passage")), ["query_id", "id"], "left")
    user = F.concat(F.lit("Passage:\n"), "passage", F.lit("\n\nClaim:\n"), "claim", F.lit("\n\nDoes the passage support the claim?"))
    asked = complete(joined.filter("passage is not null"), model, SUPPORT_RULES, user, "reply", ledger)
    supported, reason = verdict(F.col("reply"))
    yes = asked.select("query_id", "position", "number", "id", "claim", supported.alias("supported"), reason.alias("reason"))
    no = joined.filter("passage is null").select("query_id", "position", "number", "id", "claim", F.lit(False).alias("supported"), F.lit(NO_PASSAGE).alias("reason"))
    return yes.unionByName(no)


def refused(text: Column, n_citations: Column) -> Column:
    """Cites nothing and says so."""
    lowered, phrase = F.lower(text), F.lit(False)
    for p in REFUSALS:
        phrase = phrase | lowered.contains(p)
    return (n_citations == 0) & phrase


def confidence(answers: DataFrame, cited: DataFrame, reranked: DataFrame, verified: DataFrame | None, digits: int = 3) -> DataFrame:
    """query_id and confidence, between 0 and 1.

    A refusal has a fixed one. Otherwise support (the share of citations that hold) and retrieval (the sigmoid of the best
    score among cited passages) are weighed; without verification retrieval stands alone.
    """
    per = answers.select("query_id", refused(F.col("answer_text"), F.size(citations(F.col("answer_text")))).alias("refused"))
    best = cited.join(reranked.select("query_id", "id", "rerank_score"), ["query_id", "id"]).groupBy("query_id").agg(F.max("rerank_score").alias("best"))
    out = per.join(best, "query_id", "left").withColumn("retrieval", F.coalesce(1 / (1 + F.exp(-F.col("best"))), F.lit(0.0)))
    if verified is None:
        value = F.col("retrieval")
    else:
        held = verified.groupBy("query_id").agg(F.avg(F.col("supported").cast("int")).alias("support"))
        out = out.join(held, "query_id", "left")
        value = SUPPORT * F.coalesce("support", F.lit(0.0)) + RETRIEVAL * F.col("retrieval")
    return out.select("query_id", F.when(F.col("refused"), F.lit(REFUSED)).otherwise(F.round(value, digits)).alias("confidence"))
