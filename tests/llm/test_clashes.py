"""Every operator that returns its input's columns, over tables that have all its helper columns' names, nulls and repeated rows."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import common, decontaminate, fill_in_middle, hamming_dedup, line_dedup, mixing, pii, seed_extend, toxicity, url_filter
from siltstone.llm.common import table, written

DIR = "/root/testdata/sf0.001"


def names(*modules):
    found = {n for m in (common, *modules) for n in re.findall(r"[\"'`.](__[a-z0-9_]*[a-z0-9])\b(?!__)", inspect.getsource(m))}
    return sorted(found - {"__main__"} | {"__other"})


def odd_documents(spark, *modules):
    """Some documents of the table, one of them twice, nulls in every column, and a column of each helper's name."""
    docs = table(spark, DIR, "documents").where("doc_id < 40")
    null = docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    no_id = docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionByName(docs.where("doc_id = 3")).unionByName(null).unionByName(null).unionByName(no_id)
    return rows.select("*", *(F.concat(F.lit(n), F.lit("="), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in names(*modules)))


def right(rows, given):
    assert rows.columns[: len(given.columns)] == given.columns
    extra = [c for c in given.columns if c.startswith("__")]
    assert extra
    for r in rows.collect():
        assert all(r[c] == f"{c}={'?' if r['doc_id'] is None else r['doc_id']}" for c in extra), r


def test_the_pipeline(spark):
    docs = odd_documents(spark, decontaminate, hamming_dedup, line_dedup, mixing, toxicity)
    assert {"__keep", "__rate", "__count", "__mark", "__starts", "__items"} <= set(docs.columns)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DIR), name)
        right(out, docs)
        counts[name] = (docs.count(), out.count())
        docs = out if name != "mixing" else docs
    assert counts["line_dedup"][0] == counts["line_dedup"][1] and all(b > 0 for _, b in counts.values())
    # the repeated row is one near-duplicate, rows without an id aren't
    last = docs.where("doc_id is null").count()
    assert last == 3 and docs.where("doc_id = 3").count() <= 1


@pytest.mark.parametrize(
    ("module", "run"),
    [
        (decontaminate, lambda s, d: decontaminate.remove_passages(d, table(s, DIR, "benchmark"))),
        (line_dedup, lambda s, d: line_dedup.apply_bitmaps(d.drop("__n_lines", "__n_dropped"), line_dedup.keep_bitmaps(d))),
        (seed_extend, lambda s, d: seed_extend.without_repeats(d)),
        (fill_in_middle, lambda s, d: fill_in_middle.fill_in_middle(d)),
        (toxicity, lambda s, d: toxicity.score_texts(d, toxicity.fit(d, table(s, DIR, "labels")))),
        (pii, lambda s, d: pii.replace_pii(d.drop("__entities"))),
    ],
    ids=lambda x: getattr(x, "__name__", "run").rpartition(".")[2],
)
def test_each(spark, module, run):
    docs = odd_documents(spark, module)
    given = docs.drop("__n_lines", "__n_dropped", "__entities")
    right(run(spark, docs), given)


def test_urls(spark):
    pages = table(spark, DIR, "pages").limit(30).select("page_id", "url", *(F.lit(n).alias(n) for n in names(url_filter)))
    rules = spark.createDataFrame([("com", "/", "allow"), ("net", "/es/", "block")], "host string, path string, action string")
    found = url_filter.filter_urls(pages, rules)
    assert found.columns == [*pages.columns, "host", "path", "rule", "verdict"] and found.count() == pages.count()
    assert all(r[n] == n for r in found.collect() for n in names(url_filter))
