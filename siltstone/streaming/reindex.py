"""Keep a bucketed index up to date from a stream of documents: one upsert of all sellers a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import chunking
from siltstone.operators import index as I


def reindex(documents: DataFrame, path: str, checkpoint: str, **chunk_options) -> StreamingQuery:
    """Chunk, embed and replace the documents of each micro-batch; a replayed batch writes the same rows again.

    Each batch writes the buckets it touches anew. Where that is much more than the batch itself,
    ``operators.deltas`` appends instead.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        I.index_all(batch.sparkSession, path, chunking.chunk_documents(batch, **chunk_options), replace_documents=True)

    return documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
