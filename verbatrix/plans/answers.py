"""From questions to cited, verified answers with a confidence, and what that would cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.tables import written
from ..operators import answer
from ..operators.calls import Ledger
from ..providers import LanguageModel
from ..sources.records import RUN
from .search import SearchResult

# Prices in dollars for a million tokens, and tokens of one call.
EMBEDDING_PRICE, INPUT_PRICE, OUTPUT_PRICE = 0.02, 0.15, 0.60
QUESTION_TOKENS, VERIFY_TOKENS, JUDGE_TOKENS = (30, 1100, 300), (700, 25), (500, 30)
CHARS_PER_TOKEN = 4.0
METADATA = ("company", "form", "period", "section", "strategy", "kind", "block_id")


@dataclass
class Answered:
    answers: DataFrame
    citations: DataFrame
    verified: DataFrame | None
    confidence: DataFrame


def answer_questions(questions: DataFrame, found: SearchResult, model: LanguageModel, verify: bool = True, ledger: Ledger | None = None) -> Answered:
    """questions: query_id, query. A question whose model call fails has an error and no answer; the others go on.

    Each distinct prompt is asked once, and answers and verdicts are written, so that citations, confidence and records tell of
    the same replies. A ledger that is kept spares calls of later runs too.
    """
    ledger = ledger or Ledger(questions.sparkSession)
    hits = found.reranked.withColumn("rank", F.col("rerank_rank"))
    for column in ("form", "period", "section"):
        if column not in hits.columns:
            hits = hits.withColumn(column, F.lit("none"))
    answers = written(answer.generate(questions, hits, model, ledger), "answers")
    cited = answer.resolve(answers)
    verified = written(answer.verify(answers, hits, model, ledger), "verified") if verify else None
    return Answered(answers, cited, verified, answer.confidence(answers, cited.filter("id is not null"), found.reranked, verified))


def _metadata(df: DataFrame):
    """The columns that describe a chunk, as far as df has them."""
    return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in METADATA]).alias("metadata")


def _listed(df: DataFrame, name: str, order: str, *fields) -> DataFrame:
    """query_id and its rows as one array, in order."""
    entry = F.struct(F.col("id").cast("string").alias("id"), *fields, _metadata(df), "text")
    by_place = lambda a, b: (a["at"] - b["at"]).cast("int")
    return df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), entry.alias("e"))), by_place), lambda x: x["e"]).alias(name))


def run_records(questions: DataFrame, found: SearchResult, done: Answered, lists: tuple[str, ...] = ("dense", "sparse")) -> DataFrame:
    """A row of ``records.RUN`` a question: every list of its search, what was dropped, its context, answer and citations.

    questions: query_id, query and, if there is one, category. Lists hold a query's top n, so a run is a bounded row.
    """
    int_of, named = (lambda c: F.col(c).cast("int")), F.transform_keys("found_in", lambda k, v: F.get(F.array(*map(F.lit, lists)), k))
    hits = lambda df, kind: (int_of("rank").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(kind).alias("score_type"))
    parts = [
        _listed(found.dense, "dense", "rank", *hits(found.dense, "squared_l2_distance")),
        _listed(found.sparse, "sparse", "rank", *hits(found.sparse, "bm25")),
        _listed(found.fused, "fused", "rank", int_of("rank").alias("rank"), "rrf_score", named.alias("found_in")),
        _listed(found.reranked, "reranked", "rerank_rank", int_of("rerank_rank").alias("rerank_rank"), "rerank_score", int_of("rank").alias("rrf_rank"), "rrf_score", named.alias("found_in")),
        found.dropped.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("list", F.col("id").cast("string").alias("id"), F.col("kept_id").cast("string").alias("kept_id")))).alias("dropped")),
    ]
    about = found.reranked.select("query_id", "id", _metadata(found.reranked))
    resolved = done.citations.join(about, ["query_id", "id"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", F.struct("number", F.col("id").cast("string").alias("chunk_id"), "metadata").alias("c")))).alias("r"))
    mapped = F.transform(F.array_sort(F.map_entries("citation_map")), lambda e: F.struct(e["key"].alias("number"), e["value"].cast("string").alias("chunk_id")))
    own = done.answers.select("query_id", "answer_text", "context", mapped.alias("citation_map"), answer.citations(F.col("answer_text")).alias("parsed_citations"), F.col("answer_text_error").alias("error"))
    category = F.col("category") if "category" in questions.columns else F.lit(None).cast("string")
    out = questions.select("query_id", F.col("query").alias("question"), category.alias("category")).join(own, "query_id", "left")
    for part in (*parts, resolved.select("query_id", F.transform("r", lambda x: x["c"]).alias("resolved_citations"))):
        out = out.join(part, "query_id", "left")
    # What a question does not have is empty, not missing.
    full = [F.coalesce(F.col(f.name), F.array()).cast(f.dataType).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(RUN).fields if f.name != "question_id"]
    return out.select(F.col("query_id").cast("string").alias("question_id"), *full)


def verify_runs(runs: DataFrame, model: LanguageModel, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """The citations of stored runs, verified anew, and (query_id, confidence)."""
    answers = runs.select(F.col("question_id").alias("query_id"), "answer_text", F.map_from_entries("citation_map").alias("citation_map"))
    passages = runs.select(F.col("question_id").alias("query_id"), F.inline("reranked"))
    verified = written(answer.verify(answers, passages.select("query_id", "id", "text"), model, ledger), "verified")
    return verified, answer.confidence(answers, answer.resolve(answers).filter("id is not null"), passages, verified)


def question_cost(questions: int) -> float:
    embed, read, write = QUESTION_TOKENS
    return questions * (embed * EMBEDDING_PRICE + read * INPUT_PRICE + write * OUTPUT_PRICE) / 1e6


def call_cost(calls: int, tokens: tuple[int, int] = VERIFY_TOKENS) -> float:
    return calls * (tokens[0] * INPUT_PRICE + tokens[1] * OUTPUT_PRICE) / 1e6


def embedding_cost(chunks: DataFrame) -> DataFrame:
    """doc_id, chars, tokens and dollars of embedding all chunks; doc_id null for the total."""
    chars = chunks.rollup("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    tokens = F.col("chars") / CHARS_PER_TOKEN
    return chars.select("doc_id", "chars", tokens.alias("tokens"), (tokens / 1e6 * EMBEDDING_PRICE).alias("dollars"))


def citation_counts(answers: DataFrame) -> DataFrame:
    """query_id and how many citations a verification would check."""
    return answers.select("query_id", F.size(answer.claims(F.col("answer_text"))).alias("checks"))


def confidence_range(confidence: DataFrame) -> DataFrame:
    return confidence.agg(F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.avg("confidence").alias("mean"))
