"""Retrieval evaluation by tenant: are the documents that hold an answer among the chunks that its question finds?

    python -m jobs.evaluate_retrieval --documents DOCS --questions QUESTIONS --output OUT [--config FILE]

DOCS is a Parquet table of documents, QUESTIONS one of item_id and text. A question is asked in every
seller that has documents with its text, which are what it should find. OUT gets, for the run of
the configuration, the index rows (index), a graded row for each question and seller (cases), both
in folders of run and seller, and the sums by seller and over all (metrics, JSON). A run of the
same name replaces what it had written. The command line fails if the run doesn't pass.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from siltstone.functions import embedding as E
from siltstone.operators import chunking, evidence, index, metrics, reports
from siltstone.sources import corpus, storage

OPTIONS = {"run_id", "strategy", "chunk_size", "overlap", "separators", "model", "dimensions", "top_k", "least_recall"}


def asked_and_expected(docs: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, expected): a case for each question and seller that has documents with its text, and those documents."""
    found = evidence.containing(docs, questions, doc_id="document_key", text="text", passage_id="item_id", passage="text_")
    found = storage.held(found.select("item_id", F.col("document_key.seller_id").alias("seller_id"), F.col("document_key.document_id").alias("document_id")), "evidence")
    case = F.concat_ws("/", "seller_id", "item_id").alias("case_id")
    expected = found.select(case, "seller_id", "document_id", F.lit("1").alias("version"), F.lit(None).cast("string").alias("section"))
    pairs = found.select("item_id", "seller_id").distinct().join(questions, "item_id")
    return pairs.select(case, "item_id", "seller_id", F.col("text_").alias("query")), expected


def run(
    spark: SparkSession, documents: str, questions: str, output: str, *, run_id: str = "baseline", model: str = E.MODEL, dimensions: int = E.DIMENSIONS, top_k: int = 10, least_recall: float = 0.5, **chunk_options
) -> DataFrame:
    """Index the documents, ask, grade and write; returns the graded cases, read back."""
    at = lambda name: f"{output}/{name}/run_id={run_id}"
    docs = corpus.table_documents(spark.read.parquet(documents)).where("length(text) > 0 and length(trim(seller_id)) > 0 and document_id is not null")
    rows = index.index_rows(chunking.chunk_documents(docs, **chunk_options), model=model, dimensions=dimensions, strict=False)
    rows.hint("rebalance", "seller_id").write.mode("overwrite").partitionBy("seller_id").parquet(at("index"))
    stored = spark.read.schema(rows.schema).parquet(at("index")).withColumn("section", F.lit(None).cast("string"))

    items = spark.read.parquet(questions).select("item_id", F.col("text").alias("text_"))
    cases, expected = asked_and_expected(docs.select(F.struct("seller_id", "document_id").alias("document_key"), "text"), items)
    summed, report = reports.evaluate_retrieval(stored.where("embedding is not null"), cases, expected, model=model, dimensions=dimensions, top_k=top_k, measured_at="")
    graded = report.join(cases.select("case_id", "item_id", "seller_id"), "case_id").drop("latency_ms")
    graded.hint("rebalance", "seller_id").write.mode("overwrite").partitionBy("seller_id").parquet(at("cases"))
    written = spark.read.schema(graded.schema).parquet(at("cases"))

    by_seller = metrics.run_metrics(written.withColumn("latency_ms", F.lit(None).cast("double")), "seller_id").drop("latency_mean", "latency_p50")
    status = F.when((F.col("status") == "passed") & (F.coalesce("recall_at_5", F.lit(0.0)) >= least_recall), "passed").otherwise("failed")
    whole = summed.withColumn("status", status).drop("latency_mean", "latency_p50", "measured_at")
    by_seller.unionByName(whole, allowMissingColumns=True).orderBy("seller_id").coalesce(1).write.mode("overwrite").json(at("metrics"))
    told = summary(spark, output, run_id)
    common.log.info("read %s and %s: %d chunks, %d questions asked; wrote %s of run %s: %s", documents, questions, told["indexed_chunks"], told["collected"], output, run_id, told["status"])
    return written


def summary(spark: SparkSession, output: str, run_id: str) -> dict:
    """The run's row over all sellers."""
    return spark.read.json(f"{output}/metrics/run_id={run_id}").where("status is not null").first().asDict()


def main() -> None:
    given = common.parser(__doc__.splitlines()[0], __file__, "documents", "questions", "output").parse_args()
    spark = common.session("evaluate-retrieval")
    try:
        config = common.configuration(spark, given.config, OPTIONS)
        run(spark, given.documents, given.questions, given.output, **config)
        passed = summary(spark, given.output, config.get("run_id", "baseline"))["status"] == "passed"
    finally:
        spark.stop()
    sys.exit(0 if passed else 1)


if __name__ == "__main__":
    main()
