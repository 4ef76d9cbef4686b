import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate as D
from siltstone.llm.fm_index import FMIndex, suffix_order
from tests.llm.conftest import SPECIAL, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def brute(rows, items, window=13):
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if x := found.get(tuple(w[i : i + n])):
                    ids |= x
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(sample):
    w = [t.split() for _, t in sample if t and len(t.split()) > 60]
    return [(1, " ".join(w[0][5:40])), (2, "one"), (3, " ".join(w[1][3:9])), (4, None), (5, "..."), (6, " ".join(w[0][10:45])), (6, " ".join(w[2][:14])), (None, "lost"), (7, "the the")]


def test_index_matches_scan():
    draw = np.random.default_rng(3)
    for _ in range(60):
        codes = draw.integers(1, 4, draw.integers(1, 40))
        starts = np.unique(np.concatenate([[0], draw.integers(0, len(codes), 3)]))
        ends = np.repeat(np.append(starts[1:], len(codes)), np.diff(np.append(starts, len(codes))))
        assert suffix_order(codes, ends).tolist() == sorted(range(len(codes)), key=lambda i: (codes[i : ends[i]].tolist(), i))
        index = FMIndex(codes, starts, 2, every=4)
        lengths = draw.integers(1, 4, 20)
        phrases = np.zeros((20, 3), np.int64)
        for row, n in zip(phrases, lengths, strict=True):
            row[3 - n :] = draw.integers(1, 4, n)
        lo, hi = index.search(phrases, lengths)
        for row, n, a, b in zip(phrases, lengths, lo, hi, strict=True):
            want = [p for p in range(len(codes)) if codes[p : ends[p]][:n].tolist() == row[3 - n :].tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("most", [D.MOST_WINDOWS, 7])
def test_matches_brute_force(spark, sample, items, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)
    monkeypatch.setattr(D, "FETCHED", 50 * most)
    rows = [*sample, (None, SPECIAL[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(frame(spark, rows), bench).select("doc_id", "__n_words", D.hit_words(), "__items").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, [i for i in items if i[0] is not None])
    named = D.find_contamination(frame(spark, rows), bench.withColumn("item_id", F.concat(F.lit("q"), "item_id")), keep=["text", "doc_id"])
    want = brute(rows, [(f"q{i}", t) for i, t in items if i is not None])
    assert sorted(map(tuple, named.select("doc_id", "__n_words", D.hit_words(), "__items").collect()), key=repr) == want


def test_blocks_of_windows_lose_none(spark, monkeypatch):
    monkeypatch.setattr(D, "CUT", 10)
    text = " ".join(f"w{i % 37}" for i in range(200))
    assert list(D.stream_words(text)) == D.words_of(text)
    bench = spark.createDataFrame([(1, text), (2, "a b"), (3, " ".join(text.split()[:13])), (4, "")], "item_id long, text string")
    for most in (1, 5, 50, 10_000):
        windows = {}
        for block, _ in D.benchmark_blocks(bench, "item_id", "text", 13, most):
            names = {v: k for k, v in block.code.items()}
            for p, row in enumerate(block.symbols.tolist()):
                windows.setdefault(tuple(names[c] for c in row if c), set()).update(block.items(p))
        words = D.words_of(text)
        want = {tuple(words[i : i + 13]): {1} for i in range(188)} | {(b"a", b"b"): {2}}
        want[tuple(words[:13])] = {1, 3}
        assert windows == want


def test_a_large_benchmark_is_packed():
    import pickle

    draw = np.random.default_rng(4)
    pieces = [(i, [b"%d" % x for x in draw.integers(0, 5_000, 400)]) for i in range(500)]
    block = D.Phrases(pieces)
    assert len(block.symbols) == 500 * 388 and len(pickle.dumps(block)) < 100 * len(block.symbols)
    assert block.items(0) == [i for i, w in pieces if tuple(block.symbols[0]) in {tuple(block.code[x] for x in w[k : k + 13]) for k in range(388)}]


def test_drops_contaminated_and_keeps_columns(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(1, items[0][1]), (2, "clean words only"), (3, None)])
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {2, 3}
    assert D.decontaminate(docs.where(F.lit(False)), bench).count() == 0
    assert D.decontaminate(docs, bench.where(F.lit(False))).count() == 3


def test_passages_are_cut_out(spark):
    item = " ".join(f"Item{i}" for i in range(20))
    long = " ".join(f"own{i}" for i in range(900))
    rows = [(1, f"é {long}, {item.upper()}! {long}"), (2, item), (3, long), (4, None), (5, f"a {item} b\n{item} c"), (5, f"a {item} b\n{item} c"), (None, "")]
    docs, bench = frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = D.remove_passages(docs, bench)
    assert cut.columns == docs.columns
    want = [(1, f"é {long}, ! {long}"), (2, ""), (3, long), (4, None), (5, "a  b\n c"), (5, "a  b\n c"), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=repr) == sorted(want, key=repr)
    assert {r[0] for r in D.decontaminate(docs, bench).select("doc_id").collect()} == {1, 3, 4, None}
