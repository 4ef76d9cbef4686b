"""Incremental indexing: a stream over a folder of documents, each batch of new files one epoch of the index.

    python -m jobs.index_documents --documents DOCS --output INDEX --checkpoint MARK [--config FILE]

DOCS has Parquet files of doc_id, text, source, lang, and perhaps updated_at (of several rows of a
document in one batch the latest counts) and deleted (the document goes). Files that an earlier
run has seen aren't read again: the checkpoint names them. A batch that fails is run again under
its number, which replaces what it had written. INDEX and MARK belong together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from siltstone.functions import embedding as E
from siltstone.operators import deltas
from siltstone.sources import corpus

#: What a file of documents may have; other columns aren't read.
COLUMNS = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "updated_at": "string", "deleted": "boolean"}
OPTIONS = {"strategy", "chunk_size", "overlap", "separators", "model", "dimensions", "files_per_batch"}


def as_pattern(path: str) -> str:
    """The path as a pattern that matches it alone: a stream takes one file, or a folder, only so."""
    path = path.rstrip("/")
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path[:-1]) + f"[{path[-1]}]"


def raw_documents(rows: DataFrame) -> DataFrame:
    """Rows for the index: source is the seller, doc_id the document, lang the policy type."""
    more = [c for c in ("updated_at", "deleted") if c in rows.columns]
    # without a text a document is rejected as an empty one
    return corpus.table_documents(rows.withColumn("text", F.coalesce("text", F.lit(""))), more).withColumn("source_format", F.lit("text"))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, *, files_per_batch: int = 64, model: str = E.MODEL, dimensions: int = E.DIMENSIONS, **chunk_options) -> DataFrame:
    """Index what is new in the folder, wait for the stream to end, and return the index as it stands."""
    there = dict(spark.read.parquet(documents).dtypes)
    schema = ", ".join(f"{c} {there[c]}" for c in COLUMNS if c in there)
    order = "updated_at" if "updated_at" in there else None
    deltas.create(spark, output)
    done: dict[int, dict[str, int]] = {}

    def index(batch: DataFrame, epoch: int) -> None:
        told = deltas.write_epoch(batch.sparkSession, output, raw_documents(batch), epoch, order=order, model=model, dimensions=dimensions, **chunk_options)
        done[epoch] = {r["status"]: r["count"] for r in told.groupBy("status").count().collect()}
        common.log.info("epoch %d of %s: documents %s", epoch, output, done[epoch])

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(documents))
    query = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    common.log.info("read %d new documents of %s, wrote epochs %s of %s", sum(sum(d.values()) for d in done.values()), documents, sorted(done), output)
    return deltas.current(spark, output)


def main() -> None:
    given = common.parser(__doc__.splitlines()[0], __file__, "documents", "output", "checkpoint").parse_args()
    spark = common.session("index-documents")
    try:
        run(spark, given.documents, given.output, given.checkpoint, **common.configuration(spark, given.config, OPTIONS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
