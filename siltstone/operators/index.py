"""The index: a Parquet table in one folder a seller and bucket of documents, written by keyed upserts of whole buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.errors import IndexingError
from siltstone.functions import embedding as E
from siltstone.functions import text as T
from siltstone.sources import storage

KEYS = ["seller_id", "chunk_id"]
#: What a chunk's id is made of, as far as the chunks have it.
IDENTITY = ["document_id", "chunk_position", "start", "end", "seller_id", "version", "text"]
#: Buckets of a seller's documents. An upsert rewrites those that its documents are in; a bucket is several files, by size.
BUCKETS = 64


def _required(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip(T.SPACES):
        raise IndexingError(f"{name} is required")
    return value.strip(T.SPACES)


def open_index(spark: SparkSession, path: str) -> str:
    """Create the empty index at path if it isn't there; returns the path."""
    if not storage.exists(spark, path):
        spark.createDataFrame([], _STORED).write.partitionBy("seller_id", "bucket").parquet(path)
    return path


_STORED = f"{schemas.INDEX}, bucket int"


def _stored(spark: SparkSession, path: str, seller_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(_STORED).parquet(path)
    return rows if seller_id is None else rows.where(F.col("seller_id") == seller_id)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("bucket")


def bucket_of(document_id: str) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(BUCKETS)).cast("int")


def mixed_sellers(chunks: DataFrame, seller_id: str) -> DataFrame:
    """The chunks that are not the seller's."""
    return chunks.where(~F.col("seller_id").eqNullSafe(F.lit(seller_id)))


def index_rows(chunks: DataFrame, *, dimensions: int = E.DIMENSIONS, model: str = E.MODEL, strict: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of schemas.INDEX: identity hash, metadata as sorted JSON, and vector of each chunk; and the columns ``also``, which the metadata has too."""
    return E.embed(_named(_checked(chunks, strict), also), dimensions=dimensions, model=model, strict=strict)


def _checked(chunks: DataFrame, strict: bool) -> DataFrame:
    position = F.col("chunk_position")
    return chunks.withColumn("document_id", T.required(F.col("document_id"), "document_id", strict)).withColumn(
        "chunk_position", F.when(position >= 0, position).otherwise(F.raise_error(F.lit("a chunk's position is a whole number from 0")).cast("int")) if strict else position
    )


def _named(checked: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """index_rows without the vectors."""
    extra = [c for c in sorted(checked.columns) if c not in ("text", "embedding")]
    have = lambda c: F.col(c) if c in checked.columns else F.lit(None).cast("string")
    return checked.select(
        "seller_id", E.chunk_id({n: have(n) for n in IDENTITY}).alias("chunk_id"), "document_id", have("version").alias("version"), F.col("chunk_position").cast("int").alias("chunk_position"), "text",
        F.to_json(F.struct(*(F.col(f"`{c}`") for c in extra)), {"ignoreNullFields": "false"}).alias("metadata"), *also,
    )


def merged(old: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """old and new, new rows in place of old ones of their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def last_of_batch(rows: DataFrame, order: str, keys: list[str] = KEYS) -> DataFrame:
    """Of the rows of one key the last in the batch's order."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n", order)


def _store(rows: DataFrame, path: str) -> None:
    """Replace the buckets that rows has. The rows may come from the table itself: Spark puts the new files in place when all of them are written."""
    (
        rows.withColumn("bucket", bucket_of("document_id"))
        .hint("rebalance", "seller_id", "bucket")  # a large bucket is several files
        .sortWithinPartitions("seller_id", "bucket", "document_id", "version", "chunk_position")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seller_id", "bucket").parquet(path)
    )


#: Folders of sellers and buckets that a plan names one by one, at most; beyond, rows are matched by a join.
MOST_FOLDERS = 10_000


def _touched(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """What is stored in the folders of (seller_id, document_id): the others aren't read, unless there are very many."""
    pairs = keys.select("seller_id", bucket_of("document_id").alias("bucket")).distinct()
    folder = F.concat_ws("/", F.col("bucket").cast("string"), "seller_id")
    named = [r[0] for r in pairs.select(folder.alias("f")).limit(MOST_FOLDERS + 1).collect()]
    stored = _stored(spark, path)
    return stored.where(folder.isin(named)) if len(named) <= MOST_FOLDERS else stored.join(pairs, ["seller_id", "bucket"], "left_semi").select(*stored.columns)


def _upsert(spark: SparkSession, path: str, chunks: DataFrame, dimensions: int, model: str, replace_documents: bool, order: str | None, wordless: bool = False) -> DataFrame:
    at = order or "__at"
    ordered = chunks if order else chunks.withColumn(at, F.monotonically_increasing_id())
    # rows of one key are those of one identity: ids and vectors are made of the rows that stay, and don't travel
    checked = _checked(ordered, True)
    last = last_of_batch(checked, at, [c for c in IDENTITY if c in checked.columns])
    made = E.embed(_named(last), dimensions=dimensions, model=model, strict=not wordless)
    rows = storage.held(made.where(F.col("embedding").isNotNull()) if wordless else made, "batch")
    open_index(spark, path)
    old = _touched(spark, path, rows).drop("bucket")
    if replace_documents:
        old = old.join(rows.select("seller_id", "document_id").distinct(), ["seller_id", "document_id"], "left_anti")
    _store(merged(old, rows), path)
    return rows.select("seller_id", "document_id", "chunk_position", "chunk_id")


def index_chunks(
    spark: SparkSession, path: str, seller_id: str, chunks: DataFrame, *, dimensions: int = E.DIMENSIONS, model: str = E.MODEL, replace_documents: bool = False, order: str | None = None
) -> DataFrame:
    """Embed and upsert one seller's non-empty batch; returns (document_id, chunk_position, chunk_id) of it.

    Nothing is written if a chunk is another seller's or a row is bad. Of several chunks of one
    key the last counts: by the column ``order``, which isn't stored, or else as the rows come.
    With replace_documents all stored chunks of the batch's documents go first, so that none is
    left of older texts.
    """
    seller_id = _required(seller_id, "seller_id")
    if chunks.isEmpty():
        raise IndexingError("a batch without chunks can't be indexed")
    if not mixed_sellers(chunks, seller_id).isEmpty():
        raise IndexingError(f"the batch has chunks that aren't {seller_id}'s")
    return _upsert(spark, path, chunks, dimensions, model, replace_documents, order).drop("seller_id")


def index_all(
    spark: SparkSession, path: str, chunks: DataFrame, *, dimensions: int = E.DIMENSIONS, model: str = E.MODEL, replace_documents: bool = False, order: str | None = None, wordless: bool = False
) -> DataFrame:
    """Embed and upsert a batch of many sellers in one job, as index_chunks does for one; returns (seller_id, document_id, chunk_position, chunk_id).

    A chunk without a seller fails the batch; an empty batch changes nothing. With wordless chunks
    without a vector are left out, which fail the batch otherwise.
    """
    checked = chunks.withColumn("seller_id", T.required(F.col("seller_id"), "seller_id"))
    return _upsert(spark, path, checked, dimensions, model, replace_documents, order, wordless)


def delete_documents(spark: SparkSession, path: str, seller_id: str, document_ids: DataFrame | list[str]) -> None:
    """Remove all chunks of some of a seller's documents (a table with document_id, or a list); only their buckets are written."""
    seller_id = _required(seller_id, "seller_id")
    ids = document_ids if isinstance(document_ids, DataFrame) else spark.createDataFrame([(d,) for d in document_ids], "document_id string")
    delete_all(spark, path, ids.select(F.lit(seller_id).alias("seller_id"), "document_id"))


def delete_all(spark: SparkSession, path: str, documents: DataFrame) -> None:
    """Remove all chunks of documents (seller_id, document_id) of any sellers. A bucket that is left without rows loses its folder."""
    gone = storage.held(documents.select("seller_id", "document_id").distinct(), "gone")
    kept = storage.held(_touched(spark, path, gone).join(gone, ["seller_id", "document_id"], "left_anti"), "kept")
    folders = ["seller_id", "bucket"]
    emptied = gone.select("seller_id", bucket_of("document_id").alias("bucket")).distinct().join(kept.select(*folders).distinct(), folders, "left_anti")
    if not kept.isEmpty():
        _store(kept.drop("bucket"), path)
    for seller, bucket in emptied.toLocalIterator():
        storage.delete(spark, f"{path}/seller_id={seller}/bucket={bucket}")


def list_indexed_chunks(spark: SparkSession, path: str, seller_id: str) -> DataFrame:
    """One seller's chunks in stored order; no unscoped read is offered. The filter prunes all other folders."""
    seller_id = _required(seller_id, "seller_id")
    rows = read_index(spark, path).where(F.col("seller_id") == seller_id)
    return rows.orderBy(F.asc_nulls_first("document_id"), F.asc_nulls_first("version"), "chunk_position", "chunk_id")


def configurations(rows: DataFrame) -> DataFrame:
    """(seller_id, configurations, supported): how many embedding configurations a seller's chunks have."""
    return rows.groupBy("seller_id").agg(
        F.count_distinct(F.struct("embedding_model", "embedding_dimensions")).alias("configurations"), F.bool_and(F.col("embedding_model").isin(*E.HASHES)).alias("supported")
    )
