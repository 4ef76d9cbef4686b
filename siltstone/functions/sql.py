"""The library's steps as SQL functions of a session: chunks as a table function, vectors, cosines, cleaning and titles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.functions import embedding as E
from siltstone.operators import chunking

CHUNK_ROW = "chunk_position int, start int, `end` int, text string"


class ChunkText:
    """chunk_text(text, strategy, size, overlap): a row for each chunk of a text, for LATERAL; none for a null or empty one."""

    def eval(self, text: str, strategy: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        chunking.checked_config(strategy, size, overlap, chunking.SEPARATORS)
        bounds = chunking.fixed_bounds(len(text or ""), size, overlap) if strategy == "fixed" else chunking.recursive_bounds(text or "", size, overlap, chunking.SEPARATORS)
        for i, (a, b) in enumerate(bounds):
            yield i, a, b, text[a:b]


def _vectors(model: str, dimensions: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = E.Embedder(dimensions, model)
        for texts in parts:
            yield pd.Series([embedder.direction(t) for t in texts], dtype=object)

    return run


def register(spark: SparkSession, *, model: str = E.MODEL, dimensions: int = E.DIMENSIONS) -> None:
    """Temporary functions of the session:

    chunk_text(text, strategy, size, overlap), a table function; embed_text(text), a unit vector of
    this model and size, null for a text without one; cosine(v, w) of unit vectors, null if one is
    null. Registered again, they are replaced.
    """
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType=CHUNK_ROW))
    spark.udf.register("embed_text", F.pandas_udf(_vectors(model, dimensions), "array<double>"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(v ARRAY<DOUBLE>, w ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(v, w, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)")
