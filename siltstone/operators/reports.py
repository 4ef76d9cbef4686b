"""Runs and reports: fingerprints, run identity, evaluation, comparison, writing and caching."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import embedding as E
from siltstone.functions import text as T
from siltstone.operators import metrics, retrieval
from siltstone.sources import storage

CONFIG = {"strategy": "recursive", "chunk_size": 1000, "overlap": 100, "dimensions": 256, "top_k": 10}


def fingerprint(spark: SparkSession, paths: list[str] | DataFrame, root: str) -> str:
    """SHA-256 over the files in order of their paths: path from root, NUL, content, NUL.

    paths: a list, or a table with the column path of the files as Spark names them. Each file
    is read and sent to the driver by itself; nothing holds all of them.
    """
    files = spark.read.format("binaryFile")
    named = files.load(paths) if isinstance(paths, list) else files.option("recursiveFileLookup", "true").load(root).join(paths.select("path"), "path", "left_semi")
    relative = F.substring_index("path", f"{root.rstrip('/')}/", -1).alias("relative")
    digest = hashlib.sha256()
    for row in named.select(relative, "content").orderBy("relative").toLocalIterator():
        digest.update(row["relative"].encode() + b"\0" + bytes(row["content"]) + b"\0")
    return digest.hexdigest()


def tree_snapshot(spark: SparkSession, root: str, definitions: dict, excluded: tuple[str, ...] = (), mutable: tuple[str, ...] = ("status", "blocker", "evidence")) -> str:
    """SHA-256 of a folder's files without the excluded ones, and of its task definitions without what may change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    for x in excluded:
        files = files.where(~F.contains("path", F.lit(f"/{x}")))
    fixed = {**definitions, "features": [{k: v for k, v in f.items() if k not in mutable} for f in definitions["features"]]}
    return hashlib.sha256((fingerprint(spark, files, root) + json.dumps(fixed, sort_keys=True)).encode()).hexdigest()


def run_id(identity: dict) -> str:
    return hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:16]


def evaluate_retrieval(
    chunks: DataFrame, cases: DataFrame, expected: DataFrame, *, latency: DataFrame | None = None, model: str = E.MODEL, dimensions: int = E.DIMENSIONS, top_k: int = 10, measured_at: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(metrics, cases) of a run: the top ten of every case, graded, and summed up in one row.

    chunks: index rows, or chunk_id, seller_id, the identity columns and text; cases: case_id,
    seller_id, query. A query that has no vector (null, blank, without words, or of words that
    cancel) fails its case: it is reported with a reason, is in neither recall nor MRR, and the
    run doesn't pass. Nor does one with evidence of another seller, or without a graded case.
    """
    order = ("chunk_id", "document_id", "version", "section")
    if "embedding" in chunks.columns:
        model, dimensions = retrieval.one_configuration(chunks) or (model, dimensions)
    asked = storage.held(E.embed(cases.select("case_id", "seller_id", F.coalesce("query", F.lit("")).alias("query")), text="query", model=model, dimensions=dimensions, strict=False), "asked")
    found = storage.held(retrieval.top_k_of(chunks, asked, question_id="case_id", vector="embedding", order=order, tenant="seller_id", row_tenant="seller_id", top_k=top_k, embedded=None if "embedding" in chunks.columns else ("text", model, dimensions)), "retrieved")
    graded = metrics.grade(cases, expected, found)
    blank = F.length(T.strip(F.col("query"))) == 0
    why = F.when(blank, "the query is blank").when(F.col("embedding").isNull(), "the query has no words that make a vector")
    listed = found.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "seller_id", *order[1:], "chunk_id", "score"))).alias("retrieved"))
    told = graded.join(asked.select("case_id", why.alias("error")), "case_id").join(listed, "case_id", "left")
    told = told.join(latency, "case_id", "left") if latency is not None else told.withColumn("latency_ms", F.lit(None).cast("double"))
    good = F.col("error").isNull()
    report = told.select(
        "case_id", "expected", F.when(good, F.col("found")).alias("found"), F.when(good, F.col("recall")).alias("recall"), F.when(good, F.col("reciprocal_rank")).alias("reciprocal_rank"),
        F.when(good, F.col("leaked")).otherwise(0).alias("leaked"), F.when(good, F.col("matched")).alias("matched"), "retrieved", F.when(good, F.col("latency_ms")).alias("latency_ms"), (~good).alias("failed"),
        F.when(~good, F.col("error")).when(F.col("leaked") > 0, "evidence of another seller").alias("failure_reason"),
    )
    summed = metrics.run_metrics(report).crossJoin(report.agg(F.count("*").alias("collected"), F.count_if("failed").alias("failed_cases"))).withColumn("executed", F.col("collected") - F.col("failed_cases"))
    summed = summed.crossJoin(chunks.agg(F.count("*").alias("indexed_chunks"))).withColumn("measured_at", F.lit(measured_at or datetime.now(UTC).isoformat()))
    passed = (F.col("error_rate") == 0) & (F.col("seller_leakage_count") == 0) & (F.col("graded_case_count") > 0)
    return summed.withColumn("status", F.when(passed, "passed").otherwise("failed")), report


def differences(current: DataFrame, baseline: DataFrame, volatile: tuple[str, ...] = ("latency_ms", "latency_mean", "latency_p50", "measured_at")) -> DataFrame:
    """Rows that only one of two reports has, times apart: none if the reports are equal."""
    keep = [c for c in current.columns if c not in volatile]
    a, b = current.select(*keep), baseline.select(*keep)
    return a.exceptAll(b).withColumn("side", F.lit("current")).unionByName(b.exceptAll(a).withColumn("side", F.lit("baseline")))


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    storage.write_whole(spark, path, json.dumps(value, indent=2, ensure_ascii=False).encode())


def write_baseline(spark: SparkSession, report: dict, path: str, wanted: bool) -> bool:
    """Pin a report only when asked to, and never a failing one."""
    if not wanted or report.get("status") != "passed":
        return False
    save_json(spark, path, report)
    return True


def cached(spark: SparkSession, path: str, source_sha256: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table kept at path for this fingerprint, made anew if there is none or force is set."""
    at = f"{path}/source_sha256={source_sha256}"
    if force or not storage.exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
