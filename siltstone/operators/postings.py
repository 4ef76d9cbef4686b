"""Lexical ranking over stored postings: an inverted index as a Parquet table, of which a batch of questions reads its own tokens.

``postings`` has a row for each tenant, token and chunk, with how often the token is in the
chunk and how many tokens the chunk has, in folders of tenant and token block, sorted by token:
a question's blocks are the only folders that are read, and of those the row groups that may
have its tokens. ``totals`` has each tenant's chunks and mean length. Texts aren't read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import lifecycle

#: Blocks of a tenant's tokens; folders that a batch of questions names one by one, at most.
BLOCKS, MOST_FOLDERS = 32, 10_000


def block_of(token: str):
    return F.pmod(F.xxhash64(token), F.lit(BLOCKS)).cast("int")


def postings(chunks: DataFrame, *, chunk_id: str, tenant: str, text: str = "text") -> DataFrame:
    """(tenant, token, chunk_id, tf, length) of every token of a chunk. Counted where the chunk is: no shuffle."""
    sized = chunks.select(F.col(tenant).alias("tenant"), F.col(chunk_id).alias("chunk_id"), F.array_sort(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("tokens")).withColumn("length", F.size("tokens"))
    # equal tokens are neighbours: where runs begin, and where the next one does
    places = F.when(F.col("length") > 0, F.sequence(F.lit(0), F.col("length") - 1)).otherwise(F.array().cast("array<int>"))
    begun = sized.withColumn("begins", F.filter(places, lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1))))
    runs = F.transform("begins", lambda at, k: F.struct(F.get("tokens", at).alias("token"), (F.coalesce(F.get("begins", k + 1), F.col("length")) - at).alias("tf")))
    return begun.select("tenant", "chunk_id", "length", F.explode(runs).alias("r")).select("tenant", "r.token", "chunk_id", "r.tf", "length")


def write_postings(chunks: DataFrame, path: str, *, chunk_id: str, tenant: str, text: str = "text") -> None:
    """Replace the postings at path by those of the chunks. A null text has no tokens; rows without a tenant are left out."""
    rows = postings(chunks.where(F.col(tenant).isNotNull()), chunk_id=chunk_id, tenant=tenant, text=text)
    placed = rows.withColumn("block", block_of("token"))
    placed.hint("rebalance", "tenant", "block").sortWithinPartitions("tenant", "block", "token").write.mode("overwrite").partitionBy("tenant", "block").parquet(f"{path}/postings")
    each = chunks.where(F.col(tenant).isNotNull()).select(F.col(tenant).alias("tenant"), F.size(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("length"))
    each.groupBy("tenant").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def bm25(spark: SparkSession, path: str, questions: DataFrame, *, question_id: str, tenant: str, text: str = "text", k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(question_id, chunk_id, tenant, bm25) of the chunks that share a token with a question asked in their tenant, from the postings at path."""
    asked = questions.select(question_id, F.col(tenant).alias("tenant"), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("token")).withColumn("block", block_of("token"))
    wanted = asked.select("tenant", "block", "token").distinct()
    held = spark.read.parquet(f"{path}/postings")
    folder = F.concat_ws("/", "tenant", F.col("block").cast("string"))
    folders = [r[0] for r in wanted.select(folder.alias("f")).distinct().limit(MOST_FOLDERS + 1).collect()]
    if len(folders) <= MOST_FOLDERS:  # the others aren't read at all
        held = held.where(folder.isin(folders))
    held = held.join(wanted, ["tenant", "block", "token"])
    scored = lifecycle.bm25_weights(held.select("tenant", "token", "chunk_id", "tf", "length"), spark.read.parquet(f"{path}/totals"), k1=k1, b=b)
    best = scored.join(asked.drop("block"), ["tenant", "token"]).groupBy(question_id, "chunk_id", "tenant").agg(F.round(F.sum("w"), digits).alias("bm25"))
    return best.withColumnRenamed("tenant", tenant)
