import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bwt_merge as B
from tests.llm.conftest import frame


def brute(rows, length=100):
    """rows in order: what is left of each, and its removed runs."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(rows):
    return {(r["doc_id"], r["n_bytes"], sum(r["ends"]) - sum(r["starts"]), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows}


def test_matches_brute_force(spark, sample, unique):
    shared = "a passage of some length that several documents hold in the middle of other words, with many small changes around it "
    rows = [*unique, *((20_000 + i, f"{i} " * (i % 7) + "x" * i + shared[: 80 + 3 * i] + "y" * (3 * i) + shared * (i % 3)) for i in range(40)), (None, shared * 2), (30_000, "ab" * 400), (30_001, "z" * 99), (30_002, "z" * 300)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {(d, *x) for (d, _), x in zip(order, brute([t for _, t in order]), strict=True)}
    assert result(B.repeated_spans(frame(spark, rows)).collect()) == want


def test_repeated_rows_are_one_document(spark):
    text = "".join(map(str, range(100)))
    rows = [(1, text), (1, text), (2, text), (2, "other " + text), (3, None)]
    got = B.repeated_spans(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], sum(r["ends"]) - sum(r["starts"])) for r in got) == [(1, 190, 0), (1, 190, 0), (2, 190, 190), (2, 196, 190), (3, 0, 0)]
    assert B.repeated_spans(frame(spark, rows).where(F.lit(False))).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_merged_transforms_equal_a_scan(seed, monkeypatch):
    draw = np.random.default_rng(seed)
    monkeypatch.setattr(B, "SHARD", int(draw.choice([150, 400, 1 << 14])))
    base = draw.integers(97, 97 + draw.integers(1, 4), 400).astype(np.uint8).tobytes()
    counts, pieces = [], []
    for _ in range(draw.integers(1, 30)):
        n = int(draw.integers(1, B.PLACES))
        a = int(draw.integers(0, 400 - n - B.LENGTH))
        piece = bytearray(base[a : a + n + B.LENGTH - 1])
        if draw.random() < 0.5:
            piece[int(draw.integers(0, len(piece)))] = 122
        counts.append(n)
        pieces.append(bytes(piece))
    docs, starts = draw.integers(0, 5, len(pieces)), draw.permutation(1000)[: len(pieces)] * 1000
    got = B.repeated(pieces, np.array(counts), docs, starts)
    windows = [(d, s + i, p[i : i + B.LENGTH]) for p, n, d, s in zip(pieces, counts, docs, starts, strict=True) for i in range(n)]
    first = {}
    for d, s, w in windows:
        first[w] = min(first.get(w, (d, s)), (d, s))
    assert got.tolist() == [first[w] != (d, s) for d, s, w in windows]


def ruled(n):
    """Documents with a long ruled line of their own length between words of their own."""
    return [(i, f"{i * 7919} begins " + "-" * (150 + i % 37) + f" and {i * 104729} ends " + "=-" * (i % 90)) for i in range(n)]


def crowd(texts, hot):
    """The most different fragments of one anchor."""
    pairs = np.unique(np.stack(B.fragments(texts, hot)[3:]), axis=1)
    return np.unique(pairs[0], return_counts=True)[1].max()


def test_hot_pieces_are_avoided(spark, monkeypatch):
    rows = ruled(300)
    texts = [t.encode() for _, t in rows]
    monkeypatch.setattr(B, "SAMPLE", 1)
    monkeypatch.setattr(B, "HOT", 50)
    docs = spark.createDataFrame(rows, "doc long, text string")
    hot = B.hot_pieces(docs)
    assert len(hot) and crowd(texts, hot) < 50 and crowd(texts, None) > 250
    want = {(d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows]), strict=True)}
    assert result(B.repeated_spans(docs.toDF("doc_id", "text").repartition(4)).collect()) == want


def test_fragments_cover_every_string_once_without_hot_pieces():
    draw = np.random.default_rng(5)
    texts = [t.encode() for _, t in ruled(40)] + [b"a" * 500, b"ab" * 200, draw.integers(97, 100, 2000).astype(np.uint8).tobytes(), b""]
    told = {}
    every = B.Rolling(np.frombuffer(b"".join(texts), np.uint8)).all_of(B.GRAM)
    for hot in (None, B.Hot(every[::7]), B.Hot(every)):
        text, start, count, h, f = B.fragments(texts, hot)
        strings = [(t, s + i, k) for t, s, n, k in zip(text.tolist(), start.tolist(), count.tolist(), h.tolist(), strict=True) for i in range(n)]
        assert sorted((t, s) for t, s, _ in strings) == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - B.LENGTH + 1)]
        for t, s, k in strings:  # equal strings have equal anchors
            assert told.setdefault((None if hot is None else len(hot), texts[t][s : s + B.LENGTH]), k) == k


def test_symbols_are_told_apart_by_their_bytes(monkeypatch):
    data = np.frombuffer(bytes(range(97, 123)) * 4, np.uint8)
    rolling = B.Rolling(data)
    want = B._names(rolling, np.arange(60))
    monkeypatch.setattr(B.Rolling, "of", lambda self, starts, length: np.zeros(len(starts), np.uint64))
    got = B._names(rolling, np.arange(60))
    assert len({*zip(want.tolist(), got.tolist(), strict=True)}) == len(set(want.tolist())) == len(set(got.tolist()))


def test_removed_runs_are_joined():
    doc, at = np.array([2, 1, 1, 1]), B._pack(np.array([5, 30, 0, 10]), np.array([3, 1, 10, 20]))
    doc, at = B._together(doc, at)
    start, count = B._unpack(at)
    assert (doc.tolist(), start.tolist(), count.tolist()) == ([1, 2], [0, 5], [31, 3])


def test_fragments_cover_every_string_once():
    draw = np.random.default_rng(4)
    texts = [draw.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 99, 100, 101, 350, 2000)]
    text, start, count, _, _ = B.fragments(texts)
    told = sorted((t, s + i) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True) for i in range(n))
    assert told == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - B.LENGTH + 1)]
