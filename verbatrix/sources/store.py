"""Collections of chunks on disk, in versions: chunks with embeddings, the inverted index, and the filed vectors.

A collection is a folder. Every change writes its tables to a folder of its own and then commits a manifest, which names the
folder of each table, by one rename; readers take the newest manifest and never see a table that is being written. A failure
before the rename leaves the old version as it was. Two writers that start from one version cannot both commit.

The manifest holds a fingerprint of the chunks (order does not matter, every id and text does), and that of the chunks from which
the index and the filed vectors were made; where they differ the index is stale, even if the counts agree.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import exists, file_system
from ..operators import ann, dense, sparse
from ..operators.sparse import SparseIndex
from ..providers import Embedder

LEGACY = "v1"
MANIFESTS = "_manifests"
#: Dollars for a million tokens of an embedding, and characters of a token.
EMBEDDING_PRICE, CHARS_PER_TOKEN = 0.02, 4.0


class StaleIndex(RuntimeError):
    """The sparse tables or lists were not built from the chunks of their collection."""


class ConcurrentChange(RuntimeError):
    """Another writer committed a version since this one began."""


@dataclass
class Manifest:
    version: int = 0
    chunks: int = 0
    fingerprint: str = ""
    indexed: str = ""
    """The fingerprint of the chunks that the inverted index covers."""
    filed: str = ""
    """The same of the filed vectors."""
    tables: dict[str, list[str]] = field(default_factory=dict)
    """Table name: the folders that hold it, relative to the collection."""


def metadata() -> list:
    """The stored columns of a chunk, with "none" and "narrative" where there is nothing."""
    named = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("none")).alias(c)
    return ["company", "form", "period", named("section"), "strategy", F.coalesce("kind", F.lit("narrative")).alias("kind"), named("block_id")]


def fingerprint(chunks: DataFrame) -> tuple[int, str]:
    """How many chunks there are, and a digest of all ids and texts that does not depend on their order."""
    both = F.xxhash64(F.col("id").cast("string"), "text")
    told = chunks.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(both), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(both, F.lit(1 << 31))), F.lit(0)).alias("s")).head()
    return told.n, f"{told.n}-{told.x & (2**64 - 1):016x}-{told.s:x}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, the newest last."""
    files, where = file_system(spark, f"{path}/{MANIFESTS}")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The manifest of a version, by default of the newest; an empty one if nothing is committed."""
    known = versions(spark, path)
    if version is None and not known:
        return Manifest()
    number = known[-1] if version is None else version
    return Manifest(**json.loads(spark.read.text(f"{path}/{MANIFESTS}/{number:08d}.json", wholetext=True).head()[0]))


def commit(spark: SparkSession, path: str, made: Manifest) -> Manifest:
    """Publish a version: the manifest is written beside and renamed into place, which is the only moment that readers notice."""
    files, folder = file_system(spark, f"{path}/{MANIFESTS}")
    files.mkdirs(folder)
    target, draft = f"{path}/{MANIFESTS}/{made.version:08d}.json", f"{path}/{MANIFESTS}/_{uuid.uuid4().hex}"
    if exists(spark, target):
        raise ConcurrentChange(f"version {made.version} was committed meanwhile")
    out = files.create(file_system(spark, draft)[1], False)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    if not files.rename(file_system(spark, draft)[1], file_system(spark, target)[1]):
        raise ConcurrentChange(f"version {made.version} was committed meanwhile")
    return made


def _new_folder(now: Manifest, name: str) -> str:
    return f"versions/{now.version + 1:08d}-{uuid.uuid4().hex[:8]}/{name}"


def _table(spark: SparkSession, path: str, made: Manifest, name: str) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{folder}" for folder in made.tables[name]])


def build_cost(chunks: DataFrame) -> DataFrame:
    """What embedding would take: chunks, chars, tokens and dollars. Nothing is embedded or written."""
    tokens = F.col("chars") / CHARS_PER_TOKEN
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).select("chunks", "chars", tokens.alias("tokens"), (tokens / 1e6 * EMBEDDING_PRICE).alias("dollars"))


def write_collection(chunks: DataFrame, embedder: Embedder, path: str, replace: bool = False, append: bool = False) -> Manifest:
    """Embed and store (id, ord, text, metadata columns) as a new version. An existing collection needs ``replace`` or ``append``.

    The index of the version before stays with it; the new version has none until ``write_sparse`` makes it.
    """
    spark = chunks.sparkSession
    rows = chunks.select("id", "ord", "text", *metadata())
    if rows.isEmpty():
        raise ValueError("there are no chunks to store")
    now = manifest(spark, path)
    if path.rstrip("/").endswith(f"/{LEGACY}") and (replace or append):
        raise ValueError("the first collection is kept as it is")
    if now.version and not (replace or append):
        raise FileExistsError(f"{path} already exists: replace it or append to it")
    folder = _new_folder(now, "chunks")
    dense.embed(rows, embedder).write.parquet(f"{path}/{folder}")
    folders = [*(now.tables.get("chunks", []) if append else []), folder]
    made = Manifest(now.version + 1, indexed=now.indexed, filed=now.filed, tables={**now.tables, "chunks": folders})
    made.chunks, made.fingerprint = fingerprint(_table(spark, path, made, "chunks"))
    return commit(spark, path, made)


def read_collection(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _table(spark, path, manifest(spark, path, version), "chunks")


def write_sparse(spark: SparkSession, path: str) -> Manifest:
    """(Re)build the inverted index from the stored text. Postings are sorted by term, so that a term reads few row groups."""
    now = manifest(spark, path)
    index = sparse.build(_table(spark, path, now, "chunks"))
    folders = {name: _new_folder(now, name) for name in ("postings", "terms", "totals")}
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{folders['postings']}")
    index.terms.write.parquet(f"{path}/{folders['terms']}")
    index.totals.write.parquet(f"{path}/{folders['totals']}")
    tables = now.tables | {name: [folder] for name, folder in folders.items()}
    return commit(spark, path, Manifest(now.version + 1, now.chunks, now.fingerprint, now.fingerprint, now.filed, tables))


def read_sparse(spark: SparkSession, path: str, rebuild: bool = False, version: int | None = None) -> SparseIndex:
    made = write_sparse(spark, path) if rebuild else manifest(spark, path, version)
    if made.indexed != made.fingerprint:
        raise StaleIndex(f"the index covers chunks {made.indexed or 'none'}, the collection has {made.fingerprint}; rebuild it")
    return SparseIndex(*[_table(spark, path, made, name) for name in ("postings", "terms", "totals", "chunks")])


def write_vectors(spark: SparkSession, path: str, lists: int | None = None) -> Manifest:
    """(Re)file the stored embeddings in an inverted file."""
    now = manifest(spark, path)
    folder = _new_folder(now, "vectors")
    ann.build(_table(spark, path, now, "chunks"), f"{path}/{folder}", lists)
    return commit(spark, path, Manifest(now.version + 1, now.chunks, now.fingerprint, now.indexed, now.fingerprint, now.tables | {"vectors": [folder]}))


def read_vectors(spark: SparkSession, path: str, version: int | None = None) -> ann.VectorIndex:
    made = manifest(spark, path, version)
    if made.filed != made.fingerprint:
        raise StaleIndex(f"the lists cover chunks {made.filed or 'none'}, the collection has {made.fingerprint}; file them anew")
    return ann.read(spark, f"{path}/{made.tables['vectors'][0]}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep``, and folders that none of these names; also what failed writers left. Returns the folders.

    Not while a writer runs: its folder is in no manifest yet.
    """
    known = versions(spark, path)
    kept = [manifest(spark, path, v) for v in known[-keep:]]
    used = {folder for m in kept for parts in m.tables.values() for folder in parts}
    files, where = file_system(spark, f"{path}/versions")
    gone = []
    for made in files.listStatus(where) if files.exists(where) else []:
        for table in files.listStatus(made.getPath()):
            name = f"versions/{made.getPath().getName()}/{table.getPath().getName()}"
            if name not in used:
                files.delete(table.getPath(), True)
                gone.append(name)
    for version in known[:-keep]:
        files.delete(file_system(spark, f"{path}/{MANIFESTS}/{version:08d}.json")[1], False)
    return sorted(gone)
