"""The pipeline's rows against each stage done by brute force in Python."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.llm.common import table
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_near_duplicates import brute as groups

DIR = "/root/testdata/sf0.001"


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_run_matches_brute_force(spark):
    docs = table(spark, DIR, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, DIR, "labels"))
    distance = model.distance()
    kept = [(i, r["text"]) for i, r in rows.items() if model.score(r["text"], distance) < 0.7]
    assert len(kept) < len(rows)
    texts = {d: t for d, _, _, t in without_lines(kept)}
    texts = {d: texts[d] for d, v in groups(list(texts.items()), 5).items() if v[1] == d}
    items = [(r["item_id"], r["text"]) for r in table(spark, DIR, "benchmark").collect()]
    hits = contaminated(list(texts.items()), items)
    texts = {d: texts[d] for d, n, hit, _ in hits if not (hit and 20 * hit >= n)}
    sizes = Counter(rows[d]["source"] for d in texts)
    want = Counter()
    for d in texts:
        u = int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) / 16**13
        if n := poisson(len(texts) / len(sizes) / sizes[rows[d]["source"]], u):
            want[d] = n
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == [*docs.columns, "copy"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == want
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["source"] == rows[r["doc_id"]]["source"] for r in got)
    assert [r["copy"] for r in sorted(got, key=lambda r: (r["doc_id"], r["copy"]))] == [k for d in sorted(want) for k in range(1, want[d] + 1)]


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = table(spark, DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0 and out.columns == [*docs.columns, *(["copy"] if name == "mixing" else [])]
