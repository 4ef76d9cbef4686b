"""The jobs as registered queries: each runs its job twice over the whole tables, into a new shared folder, and reads the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import evaluate_retrieval, index_documents
from siltstone.functions import embedding as E
from siltstone.plans import catalogue as C
from siltstone.plans import entry_points as P
from siltstone.plans.registry import query
from siltstone.sources import storage


#: The documents as the index cleans them, in fixed chunks: (doc_id, seller_id, chunk_position, text, s, e), and the digest that names a chunk.
_CLEANED = f"cleaned AS (SELECT doc_id, source, {P._STRIPPED.format('text')} AS text FROM documents), {C._CHUNKS.replace('FROM documents', 'FROM cleaned')}"
_CHUNK_ID = f"""sha256('{{"chunk_position":' || chunk_position || ',"document_id":"' || doc_id || '","end":' || e || ',"seller_id":"' || seller_id || '","start":' || s || ',"text":"' || {P._ESCAPED} || '","version":"1"}}')"""


@query(f"""WITH {C._VECTORS},
named AS (SELECT *, {_CHUNK_ID} AS chunk_id FROM chunks),
held AS (SELECT b.item_id, d.source AS seller_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
asked AS (SELECT DISTINCT item_id, seller_id FROM held JOIN qn USING (item_id)),
dots AS (SELECT a.item_id, cv.seller_id, cv.doc_id, cv.chunk_position, sum(cv.w * qv.w) AS dot FROM asked a JOIN qv USING (item_id) JOIN cv ON cv.p = qv.p AND cv.seller_id = a.seller_id GROUP BY ALL),
pairs AS (SELECT a.item_id, a.seller_id, c.doc_id, k.chunk_id, round(coalesce(d.dot, 0) / c.n / q.n, 12) AS score FROM asked a JOIN cn c ON c.seller_id = a.seller_id JOIN qn q ON q.item_id = a.item_id
  JOIN named k ON k.doc_id = c.doc_id AND k.chunk_position = c.chunk_position LEFT JOIN dots d ON d.item_id = a.item_id AND d.doc_id = c.doc_id AND d.chunk_position = c.chunk_position),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, seller_id ORDER BY score DESC, chunk_id) AS rank FROM pairs QUALIFY rank <= 10),
met AS (SELECT h.item_id, h.seller_id, h.doc_id, min(rank) AS rank FROM held h LEFT JOIN ranked r ON r.item_id = h.item_id AND r.seller_id = h.seller_id AND r.doc_id = h.doc_id GROUP BY ALL)
SELECT item_id, seller_id, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (WHERE rank <= 5) AS BIGINT) AS found, round(count(*) FILTER (WHERE rank <= 5) / count(*), 9) AS recall, round(coalesce(1.0 / min(rank), 0), 9) AS reciprocal_rank
FROM met GROUP BY item_id, seller_id""")
def job1_evaluate_retrieval(spark, d):
    """Each benchmark item asked in every seller that has documents with its text, over fixed chunks and the vectors that SQL can follow."""
    out = storage.fresh(spark, "evaluation")
    for _ in range(2):
        graded = evaluate_retrieval.run(spark, f"{d}/documents.parquet", f"{d}/benchmark.parquet", out, run_id="tables", strategy="fixed", model=E.TWIN)
    rounded = [F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank")]
    return graded.select("item_id", "seller_id", F.col("expected").cast("long").alias("expected"), F.col("found").cast("long").alias("found"), *rounded)


@query(f"""WITH {_CLEANED},
places AS (SELECT doc_id, chunk_position, count(*) AS places FROM (
  SELECT doc_id, chunk_position, {C._PLACE} AS p FROM (SELECT doc_id, chunk_position, unnest({C._TOKENS.format('text')}) AS t FROM chunks) GROUP BY ALL HAVING sum({C._SIGN}) <> 0) GROUP BY ALL)
SELECT seller_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(c.chunk_position AS INTEGER) AS chunk_position, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", {_CHUNK_ID.replace("chunk_position ||", "c.chunk_position ||")} AS chunk_id,
  md5(text) AS digest, coalesce(places, 0) AS places FROM chunks c LEFT JOIN places USING (doc_id, chunk_position)""")
def job2_index_documents(spark, d):
    """The documents streamed into an index of fixed chunks, and streamed again, which finds nothing new; places: of a chunk's vector those that aren't 0."""
    out = storage.fresh(spark, "indexed")
    for _ in range(2):
        rows = index_documents.run(spark, f"{d}/documents.parquet", f"{out}/index", f"{out}/checkpoint", strategy="fixed", model=E.TWIN)
    places = F.size(F.filter(F.coalesce("embedding", F.array().cast("array<double>")), lambda x: x != 0)).cast("long")
    return rows.select("seller_id", "document_id", "chunk_position", "start", "end", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"), places.alias("places"))
