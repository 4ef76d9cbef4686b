"""Exact dense top-K within a tenant: one question as a sort with a limit, many as matrix products and a ranked window."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.errors import IndexingError
from siltstone.functions import embedding as E
from siltstone.operators import index as I
from siltstone.sources import storage

#: Questions scored in one pass: what is sent to every task. More are scored in blocks of about so many.
MOST_QUESTIONS = 4096
#: Rows, and questions, of one matrix product.
BLOCK_ROWS, BLOCK_QUESTIONS = 4_096, 128
VECTOR_COLUMNS = ("embedding", "embedding_model", "embedding_dimensions")


def _checked_k(top_k: int) -> None:
    if not isinstance(top_k, int) or isinstance(top_k, bool) or top_k < 1:
        raise IndexingError("top_k is how many chunks are wanted: a whole number from 1")


def one_configuration(rows: DataFrame) -> tuple[str, int] | None:
    """The embedding model and dimensions of all rows; None without rows, an error if there are several or an unknown one."""
    found = rows.select("embedding_model", "embedding_dimensions").distinct().limit(2).collect()
    if len(found) > 1 or found and found[0][0] not in E.HASHES:
        raise IndexingError("the chunks to search don't have one known embedding model and size")
    return (found[0][0], found[0][1]) if found else None


def retrieve_chunks(spark: SparkSession, path: str, seller_id: str, query: str, *, top_k: int = 5) -> DataFrame:
    """A seller's top_k chunks by cosine with the query (score desc, chunk_id asc), without vector columns, ranked from 1."""
    seller_id, query = I._required(seller_id, "seller_id"), I._required(query, "query")
    _checked_k(top_k)
    rows = I.read_index(spark, path).where(F.col("seller_id") == seller_id)
    found = one_configuration(rows)
    if found is None:
        return rows.drop(*VECTOR_COLUMNS).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(1)).limit(0)
    vector = E.embed_text(query, dimensions=found[1], model=found[0])
    scored = rows.withColumn("score", E.dot(F.array(*map(F.lit, vector)), F.col("embedding"))).drop(*VECTOR_COLUMNS)
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("seller_id").orderBy(F.desc("score"), "chunk_id")))


def top_k_of(
    rows: DataFrame, asked: DataFrame, *, question_id: str, vector: str, order: tuple[str, ...], tenant: str | None = None, row_tenant: str | None = None, top_k: int = 5, digits: int = 12,
    row_vector: str | None = None, embedded: tuple[str, str, int] | None = None,
) -> DataFrame:
    """(question_id, row_tenant, score, rank, *order) of each question's top_k rows: in its tenant, or in every one, or (without row_tenant) in all.

    rows: order, row_tenant and a vector (of another name, if row_vector is given), rows with a
    null in vector or row_tenant left out; asked: question_id, tenant and a vector. The questions are a stated set, sent in blocks of
    MOST_QUESTIONS: each batch of rows is one matrix product, and sends on only its own best
    top_k, so that the exchange carries candidates, not scores. Ties go by order.

    embedded: the rows' text, model and dimensions, if they have no vectors yet. They are made by
    the worker that scores them, and go no further; only if there are several blocks of
    questions are they written.
    """
    spark = rows.sparkSession
    n = asked.where(F.col(vector).isNotNull()).count()
    blocks = max(1, -(-n // MOST_QUESTIONS))
    named = asked.where(F.col(vector).isNotNull()).select(F.col(question_id).alias("q"), (F.col(tenant) if tenant else F.lit(None).cast("string")).alias("t"), F.col(vector).cast("array<double>").alias("v"))
    keys = [row_tenant] if row_tenant else []
    kept = [*keys, *order]
    if embedded and blocks > 1:
        rows = storage.held(E.embed(rows.select(*kept, embedded[0]), text=embedded[0], model=embedded[1], dimensions=embedded[2], strict=False).drop(embedded[0]), "vectors")
        row_vector, embedded = "embedding", None
    value = F.col(embedded[0]) if embedded else F.col(row_vector or vector).cast("array<double>")
    usable = rows.select(*kept, value.alias("__v")).dropna(subset=["__v", *keys])
    ddl = ", ".join([f"`{question_id}` {asked.schema[question_id].dataType.simpleString()}", "score double", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)])
    found = None
    for k in range(blocks):
        block = named.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).toArrow()
        sent = spark.sparkContext.broadcast((block.column("q").to_pylist(), block.column("t").to_pylist(), _matrix(block.column("v").combine_chunks()), block.column("q").type))
        best = usable.mapInArrow(_scorer(sent, question_id, row_tenant, bool(tenant), kept, order, top_k, digits, embedded), ddl)
        found = best if found is None else found.unionByName(best)
    window = Window.partitionBy(question_id, *keys).orderBy(F.desc("score"), *order)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1 if len(lists) else 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of BLOCK_ROWS, the last of fewer, however they come: what a block needs and sends on doesn't depend on Spark's batches."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            if held and n + part.num_rows > BLOCK_ROWS:
                yield pa.concat_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.concat_batches(held)


def best_of(scores: np.ndarray, place: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the top_k rows of every column, ties by place: only rows that reach a column's top_k-th score are sorted."""
    n = len(scores)
    least = np.partition(scores, n - top_k, axis=0)[n - top_k] if n > top_k else np.full(scores.shape[1], -np.inf)
    column, row = np.nonzero((scores >= least).T)
    score = scores[row, column]
    order = np.lexsort((place[row], -score, column))
    row, column, score = row[order], column[order], score[order]
    first = np.searchsorted(column, column)  # where the column's rows begin
    kept = np.arange(len(column)) - first < top_k
    return row[kept], column[kept], score[kept]


def _scorer(sent, question_id: str, tenant: str | None, scoped: bool, kept: list[str], order: tuple[str, ...], top_k: int, digits: int, embedded: tuple[str, str, int] | None):
    def with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts in __v replaced by their vectors, rows without one left out."""
        _, model, dimensions = embedded
        for batch, found in E.vectors(batches, "__v", dimensions, model):
            made = pa.record_batch([*(batch.column(c) for c in kept), found], [*kept, "__v"])
            yield made.filter(found.is_valid()) if found.null_count else made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tenants, asked, kind = sent.value
        of_tenant = defaultdict(list)
        for i, t in enumerate(tenants):
            of_tenant[t].append(i)
        for batch in _blocks(with_vectors(batches) if embedded else batches) if len(ids) else ():
            vectors = _matrix(batch.column("__v"))
            keys = [batch.column(c).to_pylist() for c in order]
            place = np.empty(batch.num_rows, np.int64)
            place[sorted(range(batch.num_rows), key=lambda i: tuple(k[i] for k in keys))] = np.arange(batch.num_rows)  # noqa: B023
            members = defaultdict(list)
            for i, t in enumerate(batch.column(tenant).to_pylist() if tenant else [None] * batch.num_rows):
                members[t].append(i)
            rows, told, scores = [], [], []
            for t, mine in members.items():
                questions = of_tenant.get(t, []) if scoped else list(range(len(ids)))
                mine = np.array(mine)
                for a in range(0, len(questions), BLOCK_QUESTIONS):  # a product of bounded size
                    part = questions[a : a + BLOCK_QUESTIONS]
                    row, column, score = best_of(np.round(vectors[mine] @ asked[part].T, digits), place[mine], top_k)
                    rows.append(mine[row])
                    told += [ids[part[j]] for j in column.tolist()]
                    scores.append(score)
            if rows:
                taken = batch.select(kept).take(pa.array(np.concatenate(rows)))
                yield pa.record_batch([pa.array(told, kind), pa.array(np.concatenate(scores)), *taken.columns], [question_id, "score", *kept])

    return run


def retrieve_batch(
    chunks: DataFrame, questions: DataFrame, *, question_id: str, tenant: str = "seller_id", text: str = "text", order: tuple[str, ...] = ("chunk_id",), top_k: int = 5,
    dimensions: int = E.DIMENSIONS, model: str = E.MODEL, digits: int = 12, threshold: float | None = None,
) -> DataFrame:
    """(question_id, tenant, rank, score, *order) of each question's top_k in its tenant, or in every one if questions has no tenant.

    chunks are rows of an index, whose vectors are used (one configuration for all sellers that
    are read, else an error), or chunks with a text, which are embedded on the way. Questions
    without a vector find nothing.
    """
    _checked_k(top_k)
    if "embedding" in chunks.columns:
        configuration = one_configuration(chunks)
        model, dimensions = configuration or (model, dimensions)
    scoped = tenant in questions.columns
    asked = E.embed(questions.select(question_id, *([tenant] if scoped else []), text).dropna(), text=text, dimensions=dimensions, model=model, strict=False)
    found = top_k_of(chunks, asked, question_id=question_id, vector="embedding", order=order, tenant=tenant if scoped else None, row_tenant=tenant, top_k=top_k, digits=digits, embedded=None if "embedding" in chunks.columns else (text, model, dimensions))
    return found if threshold is None else found.where(F.col("score") >= threshold)


def stored_top_k(vectors: DataFrame, queries: DataFrame, *, id_column: str, vector: str, tenant: str | None = None, top_k: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) of stored vectors against a stated set of them; within their tenant if one is given."""
    asked = queries.select(F.col(id_column).alias("query_id"), F.col(vector), *([F.col(tenant)] if tenant else []))
    found = top_k_of(vectors, asked, question_id="query_id", vector=vector, order=(id_column,), tenant=tenant, row_tenant=tenant, top_k=top_k, digits=digits)
    return found.select("query_id", id_column, "score", "rank")
