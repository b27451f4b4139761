"""JSON records: blocks of documents, questions, runs and reports."""

from __future__ import annotations

import inspect
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import file_system

METADATA = "struct<company:string,form:string,period:string,section:string,strategy:string,kind:string,block_id:string>"
BLOCK = (
    "record string, doc_id string, source_path string, doc_type string, block_type string, source_order int, section_id string, block_id string, text string, raw_html string, "
    "flat_text string, records array<string>, conversion_status string, reason_code string, table_title string, unit string, speaker string, turn_index int, level int"
)
QUESTION = (
    "id string, category string, difficulty string, question string, notes string, "
    "expected struct<value:double,unit:string,shares:double,shares_unit:string,cost:double,cost_unit:string,value_2026:double,value_2025:double,"
    "change_pct:double,value_from:double,value_to:double,claims:array<string>,should_decline:boolean,reason:string>, "
    "evidence struct<document:string,section:string,table:string,row:string,column:string,period:string,passage:string,speaker:string,responding_to:string,topic:string,note:string>"
)
HIT = f"struct<id:string,rank:int,score:double,score_type:string,metadata:{METADATA},text:string>"
FUSED = f"struct<id:string,rank:int,rrf_score:double,found_in:map<string,int>,metadata:{METADATA},text:string>"
RERANKED = f"struct<id:string,rerank_rank:int,rerank_score:double,rrf_rank:int,rrf_score:double,found_in:map<string,int>,metadata:{METADATA},text:string>"
RUN = (
    f"question_id string, question string, category string, answer_text string, dense array<{HIT}>, sparse array<{HIT}>, fused array<{FUSED}>, reranked array<{RERANKED}>, "
    f"citation_map array<struct<number:int,chunk_id:string>>, parsed_citations array<int>, resolved_citations array<struct<number:int,chunk_id:string,metadata:{METADATA}>>, "
    "dropped array<struct<list:string,id:string,kept_id:string>>, context string, error string"
)


def write_blocks(documents: DataFrame, blocks: DataFrame, path: str) -> None:
    """A line a document (doc_id, source_path, doc_type) and a line a block."""
    head = documents.select(F.lit("document").alias("record"), "doc_id", "source_path", "doc_type")
    body = blocks.withColumn("record", F.lit("block"))
    head.unionByName(body, allowMissingColumns=True).write.mode("errorifexists").json(path)


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and blocks, as ``write_blocks`` wrote them."""
    rows = spark.read.schema(BLOCK).json(path)
    return rows.filter("record = 'document'").select("doc_id", "source_path", "doc_type"), rows.filter("record = 'block'").drop("record", "source_path", "doc_type")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question a line; blank lines are skipped."""
    return spark.read.schema(QUESTION).json(path).filter("id is not null")


def read_runs(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Runs of a folder, one a file or one a line, without those of failed questions."""
    read = lambda whole: spark.read.schema(RUN).option("multiLine", whole).option("pathGlobFilter", "*.json").json(path).filter(~F.input_file_name().endswith(".error.json") & F.col("question_id").isNotNull())
    lines = read(False)
    # Of a file with a run a line, reading it as one value finds the first run again.
    runs = lines.unionByName(read(True).join(lines.select("question_id"), "question_id", "left_anti")).filter("error is null")
    return runs.filter(F.col("question_id").isin(ids)) if ids else runs


def write_runs(runs: DataFrame, path: str) -> None:
    """A run a line; those of failed questions go along with their error, and are not read back as runs."""
    runs.write.mode("overwrite").json(path)


def write_report(verified: DataFrame, confidence: DataFrame, path: str) -> None:
    """Verified citations with each question's confidence."""
    verified.join(confidence, "query_id", "left").write.mode("overwrite").json(path)


def effective(*functions: Callable) -> dict[str, str]:
    """Parameters that functions use unless told otherwise, as "function.parameter": what a run without settings did."""
    known = [(f.__name__, p) for f in functions for p in inspect.signature(f).parameters.values()]
    return {f"{name}.{p.name}": str(p.default) for name, p in known if p.default is not inspect.Parameter.empty and not callable(p.default)}


def provenance(folder: str = ".") -> dict[str, str]:
    """Commit, branch and whether files differ from it, of the working copy at a folder; an error where there is none."""
    told = lambda *words: subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return {"commit": told("rev-parse", "HEAD"), "branch": told("rev-parse", "--abbrev-ref", "HEAD"), "dirty": str(bool(told("status", "--porcelain"))).lower()}
    except (OSError, subprocess.CalledProcessError) as error:
        return {"error": str(error)}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """What a folder takes, by whatever file system holds it."""
    files, where = file_system(spark, path)
    return files.getContentSummary(where).getLength()


def snapshot(chunks: DataFrame, path: str, functions: tuple[Callable, ...] = (), archive: dict[str, str] | None = None, origin: dict[str, str] | None = None, **settings) -> DataFrame:
    """Write the chunks, copies of tables and a manifest, and return the manifest.

    Its rows are documents (company, form, period, chunks and, where the chunks have it, strategy). Each row bears the ``settings``
    and the effective parameters of ``functions``, the ``origin`` (see ``provenance``), and the bytes of the chunks and of every
    Parquet folder of ``archive`` (name: path), which executors copy to ``archive/name``.
    """
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    sizes = {"chunks": stored_bytes(spark, f"{path}/chunks")}
    for name, source in (archive or {}).items():
        spark.read.parquet(source).write.mode("overwrite").parquet(f"{path}/archive/{name}")
        sizes[name] = stored_bytes(spark, f"{path}/archive/{name}")
    told = effective(*functions) | {k: str(v) for k, v in settings.items()}
    pairs = lambda d, kind: F.map_from_arrays(*[F.array(*[F.lit(x) for x in xs]).cast(f"array<{k}>") for xs, k in ((sorted(d), "string"), ([d[k] for k in sorted(d)], kind))])
    stored = spark.read.parquet(f"{path}/chunks")
    strategy = F.min("strategy") if "strategy" in stored.columns else F.lit(None).cast("string")
    counts = stored.groupBy("company", "form", "period").agg(F.count("*").alias("chunks"), strategy.alias("strategy"))
    manifest = counts.select("*", pairs(told, "string").alias("settings"), pairs(origin or {}, "string").alias("origin"), pairs(sizes, "bigint").alias("bytes"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")
