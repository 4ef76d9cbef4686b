"""An index as a log of epochs: every batch of documents is appended once, and readers take each document's last epoch.

Two Parquet tables under one path, both in folders of epoch and seller: ``documents`` has a row
for each document of an epoch, with what became of it, and ``chunks`` the index rows of those
that were indexed. A document that comes again, changed, emptied or deleted, leaves its older
rows where they are; its last epoch alone counts. So a batch writes no more than its own rows
however large the index is, and writing an epoch again replaces that epoch's folders: a
replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import embedding as E
from siltstone.operators import chunking, index
from siltstone.sources import corpus

INDEXED, REJECTED, DELETED = "indexed", "rejected", "deleted"
#: The epoch of compacted rows: a stream's are from 0.
BEFORE = -1
_INDEX_COLUMNS = [c.split()[0] for c in schemas.INDEX.split(", ")]
_KEPT = [c for c in schemas.DOCUMENT_COLUMNS if c != "seller_id"]
_DOCUMENTS = f"{schemas.DOCUMENT}, status string, error string, epoch long"
_CHUNKS = f"{schemas.INDEX}, start int, `end` int, epoch long"


def last_rows(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the greatest by ``order`` (null is least), of equal ones that of the greatest hash. Without a shuffle of more than one row a key and task."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*([F.col(order)] if order else []), F.xxhash64(*rows.columns))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r"))
    return best.select(*((F.col(c) if c in keys else F.col("r")[c].alias(c)) for c in rows.columns))


def _written(spark: SparkSession, rows: DataFrame, folder: str, schema: str) -> DataFrame:
    """rows in one folder a seller, a large seller in several files, and read back."""
    rows.hint("rebalance", "seller_id").write.mode("overwrite").partitionBy("seller_id").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def write_epoch(spark: SparkSession, path: str, raw: DataFrame, epoch: int, *, order: str | None = None, model: str = E.MODEL, dimensions: int = E.DIMENSIONS, **chunk_options) -> DataFrame:
    """Append raw documents (rows for corpus.parsed, perhaps with a boolean column deleted) as one epoch; returns its documents.

    A document without seller, id, format or text is rejected: it is in the log with its error,
    and what an earlier epoch has of it goes, too. Of several rows of one document in a batch
    the last by ``order`` counts. Written again, an epoch is replaced.
    """
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in raw.columns else F.lit(False)
    keys = ["seller_id", "document_id"]
    marked = raw.withColumn("deleted", gone)
    # rows without a key aren't rows of one document: each is rejected by itself
    given = last_rows(marked.dropna(subset=keys), keys, order).unionByName(marked.where(F.col("seller_id").isNull() | F.col("document_id").isNull()))
    parsed = corpus.parsed(given.where("not deleted"), strict=False).withColumn("status", F.when(F.col("error").isNull(), INDEXED).otherwise(REJECTED))
    empty = [F.lit(None).cast(parsed.schema[c].dataType).alias(c) for c in _KEPT if c != "document_id"]
    deleted = given.where("deleted").select("seller_id", "document_id", *empty, F.lit(DELETED).alias("status"), F.lit(None).cast("string").alias("error"))
    told = parsed.unionByName(deleted).withColumn("epoch", F.lit(epoch).cast("long"))
    docs = _written(spark, told, f"{path}/documents/epoch={epoch}", _DOCUMENTS.replace(", epoch long", "")).withColumn("epoch", F.lit(epoch).cast("long"))

    good = docs.where(F.col("status") == INDEXED).drop("status", "error", "epoch")
    chunks = chunking.chunk_documents(good, **chunk_options)
    rows = index.index_rows(chunks, model=model, dimensions=dimensions, strict=False, also=("start", "end"))
    _written(spark, rows, f"{path}/chunks/epoch={epoch}", _CHUNKS.replace(", epoch long", ""))
    return docs


def create(spark: SparkSession, path: str) -> None:
    """Empty tables at the path, if there are none; what is there stays."""
    for name, schema in (("documents", _DOCUMENTS), ("chunks", _CHUNKS)):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("epoch", "seller_id").parquet(f"{path}/{name}")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The last row of every document: in its last epoch."""
    rows = spark.read.schema(_DOCUMENTS).parquet(f"{path}/documents")
    return rows.join(_latest(rows), ["seller_id", "document_id", "epoch"], "left_semi")


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seller_id", "document_id").agg(F.max("epoch").alias("epoch"))


def current(spark: SparkSession, path: str, seller_id: str | None = None) -> DataFrame:
    """The index rows of all documents, or of one seller's, as their last epochs have them, with start, end and epoch. The seller prunes folders of both tables."""
    docs, chunks = spark.read.schema(_DOCUMENTS).parquet(f"{path}/documents"), spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    if seller_id is not None:
        docs, chunks = (t.where(F.col("seller_id") == seller_id) for t in (docs, chunks))
    return chunks.join(_latest(docs), ["seller_id", "document_id", "epoch"], "left_semi").select(*_INDEX_COLUMNS, "start", "end", "epoch")


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """Write what counts at one path to another, as an epoch before all others: later epochs go on there, with the same checkpoint.

    Deleted documents and older rows are left behind. Nothing at ``path`` changes, and the same
    call again writes the same.
    """
    create(spark, to)
    docs = documents(spark, path).where(F.col("status") != DELETED).drop("epoch")
    _written(spark, docs, f"{to}/documents/epoch={BEFORE}", _DOCUMENTS.replace(", epoch long", ""))
    _written(spark, current(spark, path).drop("epoch"), f"{to}/chunks/epoch={BEFORE}", _CHUNKS.replace(", epoch long", ""))
