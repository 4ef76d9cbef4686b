import glob
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, evaluate_retrieval, index_documents
from siltstone.operators import deltas, retrieval
from tests.conftest import ROOT

DIR = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, source string, lang string, updated_at string, deleted boolean"


def size(path):
    return sum(os.path.getsize(p) for p in glob.glob(f"{path}/**/*.parquet", recursive=True))


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)


def texts(rows):
    return {(r["seller_id"], r["document_id"]): r["text"] for r in rows.collect()}


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "mark")]


def test_growing_input(spark, places):
    folder, out, mark = places
    arrive(spark, folder, [(1, "red coats", "a", "en", "1", None), (2, "blue hats", "a", "en", "1", False), (1, "green boots", "b", "en", "1", None), (3, None, "a", "en", "1", None), (4, "none's", None, "en", "1", None), (None, "x", "a", "en", "1", None), (None, "y", "a", "en", "1", None)])
    first = texts(index_documents.run(spark, folder, out, mark))
    assert first == {("a", "1"): "red coats", ("a", "2"): "blue hats", ("b", "1"): "green boots"}
    told = deltas.documents(spark, out).groupBy("status", "error").count().collect()
    assert {tuple(r) for r in told if r["status"] == "rejected" and r["error"] == "the document has no text"} == {("rejected", "the document has no text", 1)}
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/**/*.parquet", recursive=True)}

    assert texts(index_documents.run(spark, folder, out, mark)) == first  # nothing new
    assert {p: os.path.getmtime(p) for p in glob.glob(f"{out}/**/*.parquet", recursive=True)} == before

    # changed twice in one batch, deleted, emptied, new
    arrive(spark, folder, [(1, "white coats", "a", "en", "3", None), (1, "grey coats", "a", "en", "2", None), (2, "blue hats", "a", "en", "2", True), (1, " \n", "b", "en", "2", None), (5, "socks " * 400, "b", "en", "2", None)])
    rows = index_documents.run(spark, folder, out, mark, chunk_size=1000, overlap=0)
    assert {k for k in texts(rows)} == {("a", "1"), ("b", "5")} and texts(rows)["a", "1"] == "white coats"
    assert sorted(r["chunk_position"] for r in rows.where("document_id = '5'").collect()) == [0, 1, 2]
    assert set(before) <= set(glob.glob(f"{out}/**/*.parquet", recursive=True))
    statuses = {(r["seller_id"], r["document_id"]): r["status"] for r in deltas.documents(spark, out).where("document_id is not null").collect()}
    assert statuses["a", "2"] == "deleted" and statuses["b", "1"] == "rejected" and statuses["a", "1"] == "indexed"
    assert {r["document_id"] for r in deltas.current(spark, out, "a").collect()} == {"1"}
    asked = spark.createDataFrame([("q", "a", "coats")], "question_id string, seller_id string, text string")
    assert retrieval.retrieve_batch(rows, asked, question_id="question_id", top_k=3).count() == 1

    # a document comes back
    arrive(spark, folder, [(2, "blue hats again", "a", "en", "9", None)])
    assert texts(index_documents.run(spark, folder, out, mark))["a", "2"] == "blue hats again"


def test_a_failed_batch_is_replayed(spark, places, monkeypatch):
    folder, out, mark = places
    arrive(spark, folder, [(i, f"words of {i}", f"s{i % 3}", "en", None, None) for i in range(30)])
    right = deltas._written
    written = []

    def breaks(spark, rows, path, schema):
        written.append(path)
        if len(written) == 2:  # after the epoch's documents, before its chunks
            raise RuntimeError("executor lost")
        return right(spark, rows, path, schema)

    monkeypatch.setattr(deltas, "_written", breaks)
    with pytest.raises(Exception, match="executor lost"):
        index_documents.run(spark, folder, out, mark)
    rows = index_documents.run(spark, folder, out, mark)
    assert rows.count() == 30 == deltas.documents(spark, out).count()
    assert {r["epoch"] for r in rows.collect()} == {0}
    # the same epoch once more changes nothing
    raw = index_documents.raw_documents(spark.read.parquet(folder))
    deltas.write_epoch(spark, out, raw, 0)
    assert deltas.current(spark, out).count() == 30 and len(written) == 6


def test_a_small_batch_writes_little(spark, places):
    folder, out, mark = places
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words that are kept "), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit("en").alias("lang"))
    rows.coalesce(2).write.parquet(folder)
    assert index_documents.run(spark, folder, out, mark, dimensions=16).count() == 10_000
    whole = size(out)
    spark.createDataFrame([(7, "other words", "s3", "en")], "doc_id long, text string, source string, lang string").coalesce(1).write.mode("append").parquet(folder)
    assert index_documents.run(spark, folder, out, mark, dimensions=16).count() == 10_000
    assert whole > 1 << 20 and 0 < size(out) - whole < 1 << 14


def test_batches_of_files_and_an_empty_folder(spark, places):
    folder, out, mark = places
    arrive(spark, folder, [])
    assert index_documents.run(spark, folder, out, mark).count() == 0 == deltas.documents(spark, out).count()
    for i in range(5):
        arrive(spark, folder, [(1, f"version {i}", "a", "en", None, None), (i + 10, "its own", "a", "en", None, None)])
    rows = index_documents.run(spark, folder, out, mark, files_per_batch=2)
    assert rows.count() == 6 and rows.select("epoch").distinct().count() > 1


def test_a_compacted_index_goes_on(spark, places, tmp_path):
    folder, out, mark = places
    arrive(spark, folder, [(i, f"words of {i}", f"s{i % 2}", "en", "1", None) for i in range(20)])
    index_documents.run(spark, folder, out, mark)
    arrive(spark, folder, [(i, f"new words of {i}", f"s{i % 2}", "en", "2", i % 3 == 0) for i in range(10)])
    before = texts(index_documents.run(spark, folder, out, mark))
    to = str(tmp_path / "compacted")
    for _ in range(2):
        deltas.compacted(spark, out, to)
        assert texts(deltas.current(spark, to)) == before and len(before) == 16
    assert deltas.documents(spark, to).count() == 16 and texts(deltas.current(spark, out)) == before
    arrive(spark, folder, [(1, "newest", "s1", "en", "3", None), (0, "back", "s0", "en", "3", None), (19, "x", "s1", "en", "3", True)])
    after = texts(index_documents.run(spark, folder, to, mark))
    assert after == {**{k: t for k, t in before.items() if k != ("s1", "19")}, ("s1", "1"): "newest", ("s0", "0"): "back"}


def test_many_rows_of_one_document(spark):
    rows = spark.range(1000).select(F.lit("a").alias("k"), F.when(F.col("id") != 500, F.col("id")).alias("at"), "id")
    assert [tuple(r) for r in deltas.last_rows(rows, ["k"], "at").collect()] == [("a", 999, 999)]
    assert deltas.last_rows(rows.unionAll(rows), ["k"]).count() == 1


def test_evaluation_reruns_and_sums(spark, tmp_path):
    out = str(tmp_path / "out")
    run = lambda **more: evaluate_retrieval.run(spark, f"{DIR}/documents.parquet", f"{DIR}/benchmark.parquet", out, run_id="r", **more)
    first = {tuple(map(str, r)) for r in run().collect()}
    summed = evaluate_retrieval.summary(spark, out, "r")
    assert {tuple(map(str, r)) for r in run().collect()} == first and evaluate_retrieval.summary(spark, out, "r") == summed
    cases = spark.read.parquet(f"{out}/cases/run_id=r")
    assert summed["graded_case_count"] == cases.count() > 0 and summed["recall_at_5"] == pytest.approx(cases.agg(F.avg("recall")).first()[0])
    by_seller = spark.read.json(f"{out}/metrics/run_id=r").where("seller_id is not null").collect()
    means = {r[0]: r[1] for r in cases.groupBy("seller_id").agg(F.avg("recall")).collect()}
    assert {r["seller_id"]: pytest.approx(r["recall_at_5"]) for r in by_seller} == means
    assert os.path.isdir(f"{out}/index/run_id=r/seller_id=src1") and summed["status"] == "passed"
    run(least_recall=1.01)
    assert evaluate_retrieval.summary(spark, out, "r")["status"] == "failed"


def test_evaluation_of_odd_tables(spark, tmp_path):
    docs, asked, out = (str(tmp_path / n) for n in ("docs", "asked", "out"))
    long = "where the blue boats go in winter"
    rows = [(1, f"so {long} often", "a", "en"), (1, f"so {long} often", "a", "en"), (2, None, "a", "en"), (3, "", None, "en"), (4, f"x {long} y", None, "en"), (5, "...", "a", "en"), (6, f"and {long} too", "b c", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(docs)
    spark.createDataFrame([(1, long), (2, None), (3, "not there in any text at all"), (4, "?")], "item_id long, text string").write.parquet(asked)
    graded = evaluate_retrieval.run(spark, docs, asked, out).collect()
    assert {(r["item_id"], r["seller_id"], r["expected"], r["recall"]) for r in graded} == {(1, "a", 1, 1.0), (1, "b c", 1, 1.0)}
    spark.createDataFrame([], "doc_id long, text string, source string, lang string").write.mode("overwrite").parquet(docs)
    assert evaluate_retrieval.run(spark, docs, asked, out).count() == 0
    assert evaluate_retrieval.summary(spark, out, "baseline")["status"] == "failed"


def test_command_line(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"strategy": "fixed", "chunk_size": 2000, "overlap": 0}))
    given = [sys.executable, "-m", "jobs.index_documents", "--documents", f"{DIR}/documents.parquet", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark"), "--config", str(config)]
    done = subprocess.run(given, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0 and "read 200 new documents" in done.stderr and "wrote epochs [0]" in done.stderr, done.stderr[-2000:]
    assert glob.glob(str(tmp_path / "out/chunks/epoch=0/seller_id=src1/*.parquet"))


def test_configurations(spark, tmp_path):
    for job in (index_documents, evaluate_retrieval):
        assert set(common.configuration(spark, f"{ROOT}/jobs/{job.__name__.split('.')[-1]}.json", job.OPTIONS)) <= job.OPTIONS
    bad = tmp_path / "bad.json"
    bad.write_text('{"chunksize": 3}')
    with pytest.raises(ValueError, match="chunksize"):
        common.configuration(spark, str(bad), index_documents.OPTIONS)
