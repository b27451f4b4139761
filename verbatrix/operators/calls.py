"""Calls of a language model as a table: each distinct prompt is asked once, and its reply is kept.

A prompt's key is a digest of the model's name, the rules and the prompt. Keys that the ledger holds are not asked again: it is a
folder of Parquet that outlives jobs, and new prompts are those of an anti-join with it. They are asked in rounds of bounded size,
each round one job that appends its replies, so a failed job loses a round at most. Within a task, prompts are asked in small
chunks, several at a time, with retries; a chunk leaves a receipt in the shared folder, so a task that is run again after
its executor was lost reads its own replies instead of asking anew. Where the folder cannot be opened by path from a task,
there are no receipts, and such a task asks again.

A prompt that fails to the last try has an error for now, and is asked again another time. Null prompts are not asked.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import exists, shared_path
from ..providers import LanguageModel

ROUND, CHUNK, AT_ONCE, TRIES, PAUSE = 20_000, 16, 4, 3, 0.2
ENTRY = "key string, reply string, error string"


def model_name(model: LanguageModel) -> str:
    return getattr(model, "name", type(model).__qualname__)


class Ledger:
    """Replies by key, below ``path``; without a path in a new folder of the shared one."""

    def __init__(self, spark: SparkSession, path: str | None = None, at_once: int = AT_ONCE, tries: int = TRIES, round_size: int = ROUND, chunk: int = CHUNK):
        self.spark, self.path = spark, (path or shared_path(spark, "calls")).rstrip("/")
        self.at_once, self.tries, self.round_size, self.chunk = at_once, tries, round_size, chunk

    def replies(self) -> DataFrame:
        """key and reply of every prompt that has one."""
        if not exists(self.spark, f"{self.path}/replies"):
            return self.spark.createDataFrame([], "key string, reply string")
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/replies").filter("reply is not null").groupBy("key").agg(F.min("reply").alias("reply"))

    def ask(self, prompts: DataFrame, model: LanguageModel, system: str) -> DataFrame:
        """key, reply and error of prompts (key, prompt): from the ledger, or from the model, which the ledger then holds."""
        wanted = prompts.filter("prompt is not null").groupBy("key").agg(F.min("prompt").alias("prompt"))
        missing = wanted.join(self.replies().select("key"), "key", "left_anti")
        count = missing.count()
        rounds = -(-count // self.round_size)
        failed = []
        for r in range(rounds):
            # A round is a share of the keys by hash, which does not change as the ledger grows.
            part = missing.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r) if rounds > 1 else missing
            tasks = max(1, min(count // (4 * self.chunk), 4 * self.spark.sparkContext.defaultParallelism))
            target = f"{self.path}/rounds/{time.time_ns()}"
            asked = part.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_asking(model, system, f"{self.path}/receipts", self.at_once, self.tries, self.chunk), ENTRY)
            asked.write.parquet(target)
            done = self.spark.read.schema(ENTRY).parquet(target)
            done.filter("reply is not null").write.mode("append").parquet(f"{self.path}/replies")
            failed.append(done.filter("reply is null").select("key", "error"))
        out = wanted.select("key").join(self.replies(), "key", "left")
        if not failed:
            return out.withColumn("error", F.lit(None).cast("string"))
        errors = failed[0]
        for more in failed[1:]:
            errors = errors.unionByName(more)
        return out.join(errors, "key", "left")


def _asking(model: LanguageModel, system: str, receipts: str, at_once: int, tries: int, chunk: int):
    def one(prompt: str) -> tuple:
        for attempt in range(tries):
            try:
                return model.complete(system, prompt) or "", None
            except Exception as e:  # one prompt's failure is its own result
                error = f"{type(e).__name__}: {e}"
                if attempt + 1 < tries:
                    time.sleep(PAUSE * 2**attempt)
        return None, error

    def run(batches):
        store = where = None
        with contextlib.suppress(Exception):  # not every store can be opened from a task
            store, where = fs.FileSystem.from_uri(re.sub("^file:(?!//)", "", receipts))
            store.create_dir(where, recursive=True)
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, chunk):
                    part = batch.slice(start, chunk).to_pydict()
                    keys, name = part["key"], f"{where}/{part['key'][0]}.json"
                    replies = _receipt(store, name, keys) if store else None
                    if replies is None:
                        replies = list(pool.map(one, part["prompt"]))
                        if store:
                            _sign(store, name, keys, replies)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([r[i] for r in replies], pa.string()) for i in (0, 1))], ["key", "reply", "error"])

    return run


def _receipt(store, name: str, keys: list[str]) -> list | None:
    """The replies of a chunk that was asked before; None if there are none, or some of them failed."""
    with contextlib.suppress(Exception):
        with store.open_input_stream(name) as f:
            told = json.loads(f.read())
        if told["keys"] == keys and all(r[1] is None for r in told["replies"]):
            return told["replies"]
    return None


def _sign(store, name: str, keys: list[str], replies: list) -> None:
    with contextlib.suppress(Exception):
        with store.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps({"keys": keys, "replies": replies}).encode())
        store.move(f"{name}.part", name)


def complete(df: DataFrame, model: LanguageModel, system: str, user: Column, out: str, ledger: Ledger | None = None) -> DataFrame:
    """Adds the model's reply to ``user`` in ``out`` and, where the call failed, the error in ``out``_error; other rows go on."""
    ledger = ledger or Ledger(df.sparkSession)
    own = F.sha2(F.concat(F.lit(f"{model_name(model)}\n{system}\n"), F.col("__prompt")), 256)
    keyed = df.withColumn("__prompt", user).withColumn("__key", own)
    told = ledger.ask(keyed.select(F.col("__key").alias("key"), F.col("__prompt").alias("prompt")), model, system)
    told = told.select(F.col("key").alias("__key"), F.col("reply").alias(out), F.col("error").alias(f"{out}_error"))
    return keyed.join(told, "__key", "left").drop("__key", "__prompt")
