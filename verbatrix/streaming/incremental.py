"""Keeping an index up to date from a stream of documents that come, change and go.

A stream of changes (doc_id, seq, text; a null text deletes) passes a stateful operator that holds each document's last change.
It lets through what is newer, with the text that this replaces; changes that come twice, or late, end there. A document's text is
indexed under its ``gen``, the seq that brought it. Each micro-batch then writes, by itself and without reading earlier ones, the
chunks and postings of new texts, the generations that are gone, and signed sums: what new texts add to the statistics less what
replaced ones had. Statistics are sums of batches, and gone generations are left out by an anti-join, so the index always equals
one that is built anew.

A batch is a folder named by its id, complete once its marker is there: readers see whole batches only, and a batch that is run
again after a failure is written anew, or left alone if it was complete. ``compact`` folds all complete batches into a base of
live rows, ``vacuum`` deletes what a base has replaced.

The operator's state holds the texts (RocksDB, on executors' disks), as replaced texts cannot be taken out of the sums otherwise.
Changes without doc_id or seq are no changes. Of changes with one seq the greatest text in a batch counts, or the first batch's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as T
from ..functions.tables import exists, file_system
from ..operators import chunking, sparse
from ..operators.sparse import SparseIndex

CHANGE = "doc_id string, seq bigint, text string, old_seq bigint, old_text string"
DONE = "_DONE"
TABLES = ("chunks", "postings", "df", "sums", "gone")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastChange(StatefulProcessor):
    """Of each document's changes the newest, if it is newer than the last one before, with what it replaces."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seq bigint, text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max((int(r["seq"]), r["text"] is not None, r["text"] or "") for r in rows)
        old_seq, old_text = self.held.get() or (None, None)
        if old_seq is None or newest[0] > old_seq:
            seq, text = newest[0], newest[2] if newest[1] else None
            self.held.update((seq, text))
            yield Row(doc_id=key[0], seq=seq, text=text, old_seq=old_seq, old_text=old_text)

    def close(self) -> None:
        pass


def newest_changes(stream: DataFrame) -> DataFrame:
    """doc_id, seq, text, old_seq and old_text of a stream of changes (doc_id, seq, text)."""
    named = stream.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "text")
    given = named.filter("doc_id is not null and seq is not null")
    return given.groupBy("doc_id").transformWithState(LastChange(), CHANGE, outputMode="Update", timeMode="None")


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of complete batches or bases."""
    files, where = file_system(spark, f"{path}/{kind}")
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{path}/{kind}/{n}/{DONE}"))


def _finish(spark: SparkSession, folder: str) -> None:
    files, where = file_system(spark, f"{folder}/{DONE}")
    files.create(where, True).close()


def _pieces(texts: DataFrame) -> DataFrame:
    """The chunks of (doc_id, gen, text)."""
    cut = chunking.fixed_chunks(texts.select(F.struct("doc_id", "gen").alias("doc_id"), "text")).select("doc_id.*", "chunk_ord", "text")
    return cut.select(F.concat("doc_id", F.lit("_"), F.col("chunk_ord").cast("string")).alias("id"), F.struct("doc_id", "chunk_ord").alias("ord"), "doc_id", "gen", "text")


def _postings(chunks: DataFrame) -> DataFrame:
    """id, doc_id, gen, dl (terms in all) and terms (with their tf) of each chunk. A chunk is short, so its terms are counted in its row.

    dl and terms come from one struct: a chunk is split into terms once, which a filter on either would undo.
    """
    counted = T.let(T.tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("dl"), T.term_counts(t).alias("terms")))
    return chunks.select("id", "doc_id", "gen", counted.alias("c")).select("id", "doc_id", "gen", "c.dl", "c.terms")


def _listed(postings: DataFrame, *names: str) -> DataFrame:
    """The named columns of postings with each term and its tf; chunks without terms have none."""
    return postings.select(*names, F.inline_outer("terms")).filter("term is not null")


def _signed(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))


def apply_changes(changes: DataFrame, batch_id: int, path: str) -> None:
    """Index one batch of changes, as ``newest_changes`` gives them. Nothing happens if the batch is complete already."""
    spark = changes.sparkSession
    if batch_id in _complete(spark, path, "batches") or batch_id <= max(_complete(spark, path, "bases"), default=-1):
        return
    folder = f"{path}/batches/{batch_id}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    # Read several times below: the stateful operator must run once.
    given = keep(changes, "changes")
    chunks = keep(_pieces(given.select("doc_id", F.col("seq").alias("gen"), "text").filter("text is not null")), "chunks")
    postings = keep(_postings(chunks), "postings")
    replaced = given.filter("old_seq is not null")
    old = _pieces(replaced.select("doc_id", F.col("old_seq").alias("gen"), F.col("old_text").alias("text")).filter("text is not null"))
    both = _signed(_listed(postings), _listed(_postings(old))).groupBy("term")
    terms = keep(both.agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("tokens")), "terms")
    keep(terms.filter("df <> 0").select("term", "df"), "df")
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias(c))
    n = _signed(chunks.select("gen"), old.select("gen")).withColumnRenamed("sign", "n")
    keep(total(n, "n").join(F.broadcast(total(terms, "tokens"))), "sums")
    keep(replaced.select("doc_id", F.col("old_seq").alias("gen")), "gone")
    _finish(spark, folder)


def add_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Index one batch of (doc_id, text), none of which was there before."""
    none = lambda kind: F.lit(None).cast(kind)
    apply_changes(batch.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(batch_id).cast("long").alias("seq"), "text", none("long").alias("old_seq"), none("string").alias("old_text")), batch_id, path)


def follow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Index what a stream of (doc_id, text) has now, and end. Every document is taken as new."""
    return stream.writeStream.foreachBatch(lambda df, i: add_batch(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_changes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Index what a stream of changes (doc_id, seq, text) has now, and end."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    # A query keeps the settings it is started with; the session's own stay as they were.
    conf.set(STATE_STORE, ROCKSDB)
    try:
        sink = newest_changes(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: apply_changes(df, i, path))
        return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def _live(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], int]:
    """The tables over all complete batches without gone generations, and the last of these batches."""
    base = max(_complete(spark, path, "bases"), default=-1)
    later = [i for i in _complete(spark, path, "batches") if i > base]
    folders = ([f"{path}/bases/{base}"] if base >= 0 else []) + [f"{path}/batches/{i}" for i in later]
    if not folders:
        raise FileNotFoundError(f"no batch is complete in {path}")
    tables = {name: spark.read.parquet(*[f"{f}/{name}" for f in folders]) for name in TABLES}
    live = lambda name: tables[name].join(tables["gone"], ["doc_id", "gen"], "left_anti")
    sums = tables["sums"].agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    df = tables["df"].groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    return {"chunks": live("chunks"), "postings": live("postings"), "df": df, "sums": sums, "gone": tables["gone"].limit(0)}, max([base, *later])


def current_index(spark: SparkSession, path: str) -> SparseIndex:
    """The index over all complete batches; equal to one built at once from the documents as they are now."""
    tables, _ = _live(spark, path)
    totals = tables["sums"].select("n", F.try_divide("tokens", "n").alias("avgdl"))
    raw = tables["df"].join(F.broadcast(totals.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = F.when(F.col("raw") < 0, sparse.EPSILON * F.col("mean")).otherwise(F.col("raw"))
    terms = raw.join(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("term", "df", idf.alias("idf"))
    return SparseIndex(_listed(tables["postings"], "id", "dl").select("term", "id", "tf", "dl"), terms, totals, tables["chunks"].drop("doc_id", "gen"))


def compact(spark: SparkSession, path: str) -> int:
    """Fold all complete batches into a base, and return the last batch in it. Batches may be added meanwhile."""
    tables, last = _live(spark, path)
    if last not in _complete(spark, path, "bases"):
        folder = f"{path}/bases/{last}"
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        _finish(spark, folder)
    return last


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete batches and bases that the newest base has replaced, and return them. Not while readers of these run."""
    base = max(_complete(spark, path, "bases"), default=-1)
    old = [f"batches/{i}" for i in _complete(spark, path, "batches") if i <= base] + [f"bases/{i}" for i in _complete(spark, path, "bases") if i < base]
    for name in old:
        files, where = file_system(spark, f"{path}/{name}")
        files.delete(where, True)
    return old
