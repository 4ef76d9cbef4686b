import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import hamming_dedup as H
from siltstone.llm import minhash as M
from siltstone.llm.common import WordHashes
from siltstone.llm.components import connected
from tests.llm.conftest import frame
from tests.llm.test_decontaminate import FOLD


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def similar(a, b):
    both = len(a & b)
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def brute(rows, k):
    sets = {d: shingle_set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        if similar(sets[a], sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_groups_by_signature_bands(spark, unique):
    """The same groups where buckets are bands; every pair at 0.8 shares one but for a probability of a millionth."""
    got = {(r["doc"], r["n_shingles"], r["component"]) for r in H.near_groups(frame(spark, unique), bands=True).collect()}
    assert got == {(d, n, c) for d, (n, c) in brute(unique, 5).items()}
    flat = np.arange(1, 2_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    near = np.concatenate([flat[:1_800], flat[:200] + np.uint64(7)])
    keys = M.band_keys(np.concatenate([flat, near, flat]), np.array([0, 2_000, 4_000, 6_000]))
    assert keys.shape == (3, M.bands_for(M.LEAST)) and (keys[0] == keys[2]).all()
    assert 5 < (keys[0] == keys[1]).sum() < keys.shape[1]  # at a similarity of 0.82 a band of four is shared with 0.45
    assert len(set(keys[0].tolist())) == keys.shape[1]


@pytest.mark.parametrize("k", [2, 5])
def test_groups_match_brute_force(spark, sample, unique, k):
    got = {(r["doc"], r["n_shingles"], r["component"]) for r in H.near_groups(frame(spark, sample), k=k).collect()}
    assert got == {(d, *v) for d, v in brute(unique, k).items()}


def test_blocks_of_one_bucket(spark, unique, monkeypatch):
    from siltstone.llm import common

    monkeypatch.setattr(H, "BLOCK", 2)
    monkeypatch.setattr(H, "PAIRS", 2)
    monkeypatch.setattr(H, "PIVOTS", (0,))
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    got = {(r["doc"], r["component"]) for r in H.near_groups(frame(spark, unique), k=2).collect()}
    assert got == {(d, v[1]) for d, v in brute(unique, 2).items()}


def test_crowded_buckets_part_by_a_second_chunk(spark, unique, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 2)
    monkeypatch.setattr(H, "CROWDED", 1)
    monkeypatch.setattr(H, "PIVOTS", (0,))
    got = {(r["doc"], r["component"]) for r in H.near_groups(frame(spark, unique), k=2).collect()}
    assert got == {(d, v[1]) for d, v in brute(unique, 2).items()}


def test_second_keys_are_of_another_chunk():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(2)
    sigs = draw.integers(0, 2**16, (3, H.CHUNKS * H.CHUNK)).astype(np.uint16)
    keys = H.chunk_keys(sigs)
    for at in (0, 5, 13, 31):
        batch = pa.record_batch([pa.array(keys[:, at]), pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array([9, 9, 9]), pa.array([x.tobytes() for x in sigs]), pa.array(keys.tolist())], ["key", "node", "root", "members", "sig", "keys"])
        told = next(H._second(iter([batch])))
        assert told.num_rows == 3 * 7 * 6
        mine = H.more_keys(sigs)[:, at % H.CHUNKS]
        assert not set(told.column("sub").to_pylist()) & set(mine.reshape(-1).tolist())


def test_one_of_a_group_stays(spark, unique):
    docs = frame(spark, [*unique, (None, "without an id"), (None, "without an id")])
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {d for d, v in brute(unique, 5).items() if v[1] == d}
    rows = [r[0] for r in kept.select("doc_id").collect()]
    assert {d for d in rows if d is not None} == want and rows.count(None) == 2 and len(rows) == len(want) + 2
    assert H.drop_near_duplicates(docs.where(F.lit(False))).count() == 0


def test_pigeonhole_keys():
    import numpy as np

    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**16, (1, H.CHUNKS * H.CHUNK)).astype(np.uint16)
    for _ in range(50):
        b = a.copy()
        apart = H.CHUNKS * (H.ERRORS + 1) - 1
        b[0, draw.permutation(b.shape[1])[:apart]] ^= 1
        assert (H.chunk_keys(a) == H.chunk_keys(b)).any()


@pytest.mark.parametrize("hot", [10_000, 3])
def test_components(spark, monkeypatch, hot):
    from siltstone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = [(1, 2), (3, 2), (5, 4), (7, 7), (9, 1), (None, 3)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)]
    got = {(r["a"], r["b"]) for r in connected(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {(2, 1), (3, 1), (9, 1), (5, 4)} | {(100 + i, 100) for i in range(1, 41)} | {(501 + i, 500) for i in range(30)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_follow_order_and_edits(spark, unique):
    rows = [*unique, (None, "first of all")]
    got = {r["doc_id"]: r for r in M.fingerprint_edits(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts, key=lambda d: (d is not None, d or 0))
    import hashlib

    words = WordHashes()
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[d])
        edited = texts[d][: n - n // 4] + texts[after][: n // 4]
        r = got[d]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = M.fingerprints([texts[d], edited, texts[after]], words)
        assert r["fingerprint"] == own.hex().upper() and r["edited_fingerprint"] == other.hex().upper()
        assert r["near_edited"] == M.likeness(own, other) and r["near_next"] == M.likeness(own, following)


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f g h")], [(1, None)], [(5, "b b b"), (5, "a a a a"), (5, "a a a a"), (None, ""), (3, None), (9, "x" * 50)], [(i, "w " * 40_000 + str(i)) for i in range(3)]])
def test_fingerprints_of_odd_tables(spark, rows):
    import hashlib

    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in M.fingerprint_edits(docs).collect()), key=repr)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, words = [], WordHashes()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t)
        own, other = M.fingerprints([t, after], words)
        want.append((i, n, hashlib.sha256((t[: n - n // 4] + after[: n // 4]).encode()).hexdigest(), M.likeness(own, other)))
    assert got == sorted(want, key=repr)


def test_estimates_are_near_the_truth(unique):
    words = WordHashes()
    texts = [t for _, t in unique if t and len(t.split()) > 100][:20]
    for t in texts:
        cut = M.edited_text(t, texts[0])
        a, b = shingle_set(t, 5), shingle_set(cut, 5)
        assert abs(M.likeness(*M.fingerprints([t, cut], words)) - len(a & b) / len(a | b)) < 0.2


def test_banded_pairs_are_verified(spark, unique):
    pairs, members = M.near_pairs(frame(spark, unique))
    sets = {d: shingle_set(t, 5) for d, t in unique}
    found = {(r["a"], r["b"]): r["jaccard"] for r in pairs.collect()}
    reps = {r["doc"]: r["rep"] for r in members.collect()}
    assert all(sets[d] == sets[r] for d, r in reps.items())
    for (a, b), j in found.items():
        assert j >= 0.8 and abs(j - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-9
    near = {(a, b) for a, b in combinations(sorted(set(reps.values())), 2) if len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    assert near <= set(found)


@pytest.mark.parametrize("members", [4096, 3])
def test_banded_pairs_are_complete_at_the_threshold(spark, monkeypatch, members):
    monkeypatch.setattr(M, "MEMBERS", members)
    # single words as shingles: 8 of 10 are shared at exactly 0.8, or 12 of 14 above it
    rows = []
    for n in range(150):
        own = [f"w{n}x{i}" for i in range(14)]
        first, second = (own[:9], own[1:10]) if n % 3 else (own[:13], own[1:14])
        rows += [(2 * n, " ".join(first)), (2 * n + 1, " ".join(second))]
    rows += [(1000 + i, " ".join(["same", *(f"v{j}" for j in range(40)), f"end{i}"])) for i in range(8)]
    sets = {d: shingle_set(t, 1) for d, t in rows}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = [(r["a"], r["b"]) for r in M.near_pairs(frame(spark, rows), k=1)[0].collect()]
    assert len(want) == 150 + 28 and len(found) == len(set(found)) and set(found) == want


def test_bands_follow_the_least_similarity():
    for least in (0.5, 0.7, 0.8, 0.9):
        n = M.bands_for(least)
        assert (1 - least ** (M.PERMUTATIONS // n)) ** n <= 1e-6
    assert M.bands_for(0.8) == 32 and M.least_equal(0.8) < 0.66 * M.PERMUTATIONS
