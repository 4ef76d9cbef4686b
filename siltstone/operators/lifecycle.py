"""Beyond plain retrieval: lexical and hybrid ranking, metadata filters, abstention, unresolved questions, an experiment log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

NO_EVIDENCE, WEAK_EVIDENCE = "no_evidence", "insufficient_evidence"
FALLBACK = "I can't answer that from the policies I have. Please contact the seller."


def abstain(best: DataFrame, least_score: float, score: str = "score") -> DataFrame:
    """best (one row a query, its best score or null) with abstained, reason and the text to send instead."""
    reason = F.when(F.col(score).isNull(), NO_EVIDENCE).when(F.col(score) < least_score, WEAK_EVIDENCE)
    return best.withColumn("reason", reason).withColumn("abstained", F.col("reason").isNotNull()).withColumn("fallback", F.when(F.col("abstained"), FALLBACK))


def abstention_metrics(rows: DataFrame) -> DataFrame:
    """Precision and recall of abstaining on unanswerable queries, and the share of those answered. rows: abstained, answerable."""
    right = F.count_if(F.col("abstained") & ~F.col("answerable"))
    ratio = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    unanswerable = F.count_if(~F.col("answerable"))
    return rows.agg(
        ratio(right, F.count_if("abstained")).alias("abstention_precision"), ratio(right, unanswerable).alias("abstention_recall"), ratio(unanswerable - right, unanswerable).alias("false_answer_rate")
    )


def unresolved(log: DataFrame, topic: Column, top: int = 10) -> DataFrame:
    """The topics of most unresolved questions: (topic, questions), ties by topic."""
    return log.groupBy(topic.alias("topic")).agg(F.count("*").alias("questions")).orderBy(F.desc("questions"), "topic").limit(top)


def bm25(chunks: DataFrame, questions: DataFrame, *, chunk_id: str, question_id: str, tenant: str, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(question_id, chunk_id, tenant, bm25) of the chunks that share a token with a question asked in their tenant.

    Term and document frequencies are summed by key; only the questions' tokens, a small
    stated set, meet the chunks' tokens.
    """
    asked = questions.select(question_id, tenant, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    sized = chunks.select(chunk_id, tenant, T.tokens(F.col("text")).alias("tokens"))
    totals = sized.groupBy(tenant).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    wanted = asked.select(tenant, "token").distinct()
    # counted where the chunk is: the exchange carries the questions' terms only
    terms = sized.select(chunk_id, tenant, F.size("tokens").alias("length"), F.explode("tokens").alias("token")).join(wanted, [tenant, "token"])
    tf = terms.groupBy(chunk_id, tenant, "length", "token").agg(F.count("*").alias("tf"))
    named = tf.withColumnRenamed(tenant, "tenant") if tenant != "tenant" else tf
    scored = bm25_weights(named, totals.withColumnRenamed(tenant, "tenant") if tenant != "tenant" else totals, k1=k1, b=b)
    met = scored.join(asked.withColumnRenamed(tenant, "tenant") if tenant != "tenant" else asked, ["tenant", "token"])
    return met.groupBy(question_id, chunk_id, "tenant").agg(F.round(F.sum("w"), digits).alias("bm25")).withColumnRenamed("tenant", tenant)


def bm25_weights(tf: DataFrame, totals: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """tf (tenant, token, tf, length and a chunk's key) with w, what the token adds to the chunk's score; totals: tenant, n chunks and their mean length."""
    df = tf.groupBy("tenant", "token").agg(F.count("*").alias("df"))  # a row a term of the questions: partial sums, then few rows
    known = df.join(totals, "tenant")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return tf.join(known, ["tenant", "token"]).withColumn("w", weight).drop("df", "n", "mean", "tf", "length")


def hybrid(dense: DataFrame, lexical: DataFrame, keys: list[str], *, query: str, weight: float = 0.5, top_k: int = 5, order: str = "chunk_id", digits: int = 12) -> DataFrame:
    """Weighted sum of dense scores and lexical ones scaled to each query's best, reranked; digits rounds it before ties go by order."""
    best = F.max("bm25").over(Window.partitionBy(query))
    scaled = lexical.withColumn("lexical", F.col("bm25") / F.when(best != 0, best))
    both = dense.join(scaled.select(*keys, "lexical"), keys, "full").withColumn("hybrid", F.round(weight * F.coalesce("score", F.lit(0.0)) + (1 - weight) * F.coalesce("lexical", F.lit(0.0)), digits))
    return reranked(both, "hybrid", query=query, order=(order,), top_k=top_k)


def reranked(found: DataFrame, score: str, *, query: str, order: tuple[str, ...] = ("chunk_id",), top_k: int = 5) -> DataFrame:
    """found with new ranks by another score, the top_k of each query."""
    return found.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), *order))).where(F.col("rank") <= top_k)


def with_metadata(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """The rows that have all the values wanted, in a column or, where there is none of the name, in the stored metadata; None is null."""
    for name, value in sorted(wanted.items()):
        found = F.col(name) if name in rows.columns else F.get_json_object("metadata", f"$.{name}")
        rows = rows.where(found.eqNullSafe(F.lit(value)))
    return rows


def with_parents(children: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Each retrieved chunk with the region that holds it: small chunks find, whole regions answer."""
    r = regions.select(*keys, F.col("start").alias("region_start"), F.col("end").alias("region_end"), F.col("text").alias("region_text"))
    return children.join(r, keys).where((F.col("start") >= F.col("region_start")) & (F.col("end") <= F.col("region_end")))


def rewritten(queries: DataFrame, synonyms: dict[str, str], text: str = "text") -> DataFrame:
    """Queries with words of a small table replaced, as whole words."""
    out = F.col(text)
    for word, other in sorted(synonyms.items()):
        out = F.regexp_replace(out, rf"(?iU)(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])", other)
    return queries.withColumn(text, out)


def log_experiment(metrics: DataFrame, path: str, run_id: str, configuration: str) -> None:
    """Append a run's metrics to the log table."""
    metrics.withColumn("run_id", F.lit(run_id)).withColumn("configuration", F.lit(configuration)).write.mode("append").parquet(path)
