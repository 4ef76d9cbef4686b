"""MinHash fingerprints: universal hash permutations over word shingles, banded joins, verified Jaccard.

The i-th number of a signature is the least value of the i-th hash (multiply, add and
take the high bits: a universal family over the mixed 64-bit shingle hashes) over a
text's shingles. The share of equal numbers estimates the Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WordHashes, mixed, shingles, text_or_empty, written

#: Permutations, bytes kept of each number, words of a shingle, least similarity.
PERMUTATIONS, KEPT_BYTES, WORDS, LEAST = 128, 2, 5, 0.8
#: Largest probability with which a pair at the least similarity shares no band, and with which its signatures differ too much.
LOSS = 1e-6
#: Members of a band's bucket that are compared at once.
MEMBERS = 4096
#: Shingles hashed at a time: what fits a core's cache.
BLOCK = 1 << 16


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, np.uint64)


def signatures(flat: np.ndarray, offsets: np.ndarray, n: int = PERMUTATIONS, seed: int = 1) -> np.ndarray:
    """(texts, n) uint32 signatures of the shingle hashes flat[offsets[i]:offsets[i + 1]]; all ones without shingles."""
    a, b = permutations(n, seed)
    texts = len(offsets) - 1
    out = np.full((texts, n), 0xFFFFFFFF, np.uint32)
    i = 0
    while i < texts:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        part, full = flat[offsets[i] : offsets[j]], np.flatnonzero(np.diff(offsets[i : j + 1]))
        if len(full):
            at = offsets[i:j][full] - offsets[i]
            for p in range(n):
                out[i + full, p] = (np.minimum.reduceat(part * a[p] + b[p], at) >> np.uint64(32)).astype(np.uint32)
        i = j
    return out


def fingerprints(texts: Iterable[str], words: WordHashes, k: int = WORDS, n: int = PERMUTATIONS, kept: int = KEPT_BYTES) -> list[bytes]:
    """For each text the low ``kept`` bytes of its signature's numbers."""
    flat, offsets = shingles([t.encode("utf-8", "surrogatepass") for t in texts], k, words)
    low = signatures(flat, offsets, n).view(np.uint8).reshape(-1, n, 4)[:, :, :kept]
    return [row.tobytes() for row in np.ascontiguousarray(low)]


def likeness(a: bytes, b: bytes, kept: int = KEPT_BYTES) -> float:
    """Estimated Jaccard similarity of two fingerprints: the share of equal numbers, less what equals by chance."""
    kind = np.dtype(f"u{kept}")
    same = float((np.frombuffer(a, kind) == np.frombuffer(b, kind)).mean())
    chance = 256.0**-kept
    return max(0.0, (same - chance) / (1 - chance))


def edited_text(text: str, other: str) -> str:
    """text with its last quarter of code points replaced by the first as many (or all) of other."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n] if n else text


_OUT = pa.schema(
    [("edge", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_DDL = "edge int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
INNER, FIRST, LAST = 0, 1, 2
#: Documents fingerprinted at a time.
GROUP = 256


def _compared(rows: list[tuple], words: WordHashes) -> list[tuple]:
    """For rows[:-1] what is told of a document and its successor."""
    docs = rows[:-1]
    edited = [edited_text(a[1], b[1]) for a, b in zip(docs, rows[1:], strict=True)]
    own = fingerprints([r[1] for r in rows], words)
    other = fingerprints(edited, words)
    return [
        (INNER, d[0], None, len(d[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, g, likeness(f, g), likeness(f, h))
        for d, e, f, g, h in zip(docs, edited, own[:-1], other, own[1:], strict=True)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_OUT)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the next; its first and last row go out with their text."""
    words, held, first = WordHashes(), [], None
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if first is None:
                first = (FIRST, doc, text, None, None, None, None, None, None)
            held.append((doc, text))
            if len(held) > GROUP:
                yield _batch(_compared(held, words))
                held = held[-1:]
    if first is not None:
        doc, text = held[-1]
        yield _batch([*_compared(held, words), first, (LAST, doc, text, None, None, None, None, None, None)])


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every document and its edited text, and compare with those and the next document.

    The text of a document travels once, to its place in the order of ids; only the first and
    last documents of the partitions travel again, to meet across the borders. A null text is
    empty; null ids come first; rows with equal ids follow each other in the order of their
    texts. A table of one row is its own successor; an empty one gives no rows.
    """
    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    dealt = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = written(dealt.mapInArrow(_in_order, _DDL), "fingerprints")
    columns = [F.hex(c).alias(c) if c.endswith("fingerprint") else c for c in found.columns if c not in ("edge", "text")]

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("edge", "doc_id", "text")), strict=True)]
        for i, (kind, doc, mine) in enumerate(rows):
            if kind == LAST:
                yield _batch(_compared([(doc, mine), rows[(i + 1) % len(rows)][1:]], words))

    # two rows for each partition, however many documents there are
    edges = found.where(F.col("edge") != INNER).repartition(1).sortWithinPartitions("doc_id", F.col("text"), "edge")
    return found.where(F.col("edge") == INNER).select(*columns).unionByName(edges.mapInArrow(borders, _DDL).select(*columns))


def bands_for(least: float) -> int:
    """The fewest bands, all of one size, in one of which a pair at ``least`` meets but for a probability of LOSS; all numbers if none are enough."""
    fits = (n for n in range(1, PERMUTATIONS + 1) if PERMUTATIONS % n == 0 and (1 - least ** (PERMUTATIONS // n)) ** n <= LOSS)
    return next(fits, PERMUTATIONS)


def least_equal(least: float) -> int:
    """The most equal numbers that signatures of a pair at ``least`` have but for a probability of LOSS."""
    below = 0.0
    for n in range(PERMUTATIONS + 1):
        below += math.comb(PERMUTATIONS, n) * least**n * (1 - least) ** (PERMUTATIONS - n)
        if below > LOSS:
            return n
    return PERMUTATIONS


def band_keys(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, bands) int64: a hash of each band of each text's signature, in as many bands as bands_for(LEAST) says."""
    sigs = signatures(flat, offsets).astype(np.uint64).reshape(len(offsets) - 1, bands_for(LEAST), -1)
    keys = np.broadcast_to(np.arange(1, sigs.shape[1] + 1, dtype=np.uint64), sigs.shape[:2])
    for i in range(sigs.shape[2]):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, i])
    return keys.view(np.int64)


def signature_bands(docs: DataFrame, doc_id: str, text: str, k: int, bands: int) -> DataFrame:
    """(doc, set, keys, signature): for each document with words its shingle set's hash, band keys and signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for b in batches:
            flat, offsets = shingles([t.encode("utf-8", "surrogatepass") for t in b["text"]], k, words)
            sigs = signatures(flat, offsets)
            full = np.flatnonzero(np.diff(offsets))
            each = [hashlib.blake2b(np.unique(flat[offsets[i] : offsets[i + 1]]).tobytes(), digest_size=16).hexdigest() for i in full]
            rows = PERMUTATIONS // bands
            hashed = lambda i, j: hashlib.blake2b(sigs[i, j * rows : (j + 1) * rows].tobytes(), digest_size=8, salt=b"%d" % j).digest()
            keys = [np.frombuffer(b"".join(hashed(i, j) for j in range(bands)), np.int64) for i in full]
            yield pd.DataFrame({"doc": b["doc"].to_numpy()[full], "set": each, "keys": keys, "signature": [sigs[i].tobytes() for i in full]})

    named = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].cast("long").alias("doc"), text_or_empty(docs, text).alias("text"))
    return named.mapInPandas(run, "doc long, set string, keys array<long>, signature binary")


def _met(equal: int):
    """Over rows sorted by bucket and blocks: the pairs (a, b) with ``equal`` equal numbers, in the bucket of their least common key."""

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        doc, block, i, j = (rows.column(c).to_numpy() for c in ("doc", "block", "i", "j"))
        sigs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(len(doc), -1)
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        here = rows.column("key")[0].as_py()
        a, b = [], []
        for n in range(len(doc) - 1):
            rest = np.arange(n + 1, len(doc))
            if i[0] != j[0]:  # two blocks of one bucket: only across them
                rest = rest[block[rest] != block[n]]
            near = rest[(sigs[rest] == sigs[n]).sum(axis=1) >= equal]
            near = near[np.where(keys[near] == keys[n], keys[near], np.iinfo(np.int64).max).min(axis=1) == here]
            a += [int(doc[n])] * len(near)
            b += doc[near].tolist()
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = (np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                group = (k[start], i[start], j[start])
                if held and group != last:
                    yield pairs(held)
                    held = []
                held.append(batch.slice(start, end - start))
                last = group
        if held:
            yield pairs(held)

    return run


def near_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, least: float = LEAST, bands: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near-duplicate pairs (a, b, jaccard) of class representatives, and (doc, rep) of all documents.

    A class holds the documents of one shingle set, its representative is the least id. Pairs
    meet in a signature band, are compared by signature where they lie, a large bucket in
    blocks, and are verified on their full sets. With the bands of bands_for a pair at ``least``
    is missed with a probability of 2 * LOSS at most, as long as single numbers are enough bands
    for that (from 0.11 on). Rows without an id, and texts without words, take no part; a
    document stated twice with one id counts once.
    """
    found = written(signature_bands(docs, doc_id, text, k, bands or bands_for(least)), "bands")
    reps = written(found.groupBy("set").agg(F.min(F.struct("doc", "keys", "signature")).alias("one")).select("set", "one.doc", "one.keys", "one.signature"), "representatives")
    members = found.select("doc", "set").distinct().join(reps.select("set", F.col("doc").alias("rep")), "set").select("doc", "rep")
    keyed = reps.select("doc", F.explode("keys").alias("key"))
    blocks = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / F.lit(MEMBERS)).cast("int").alias("blocks"))
    placed = keyed.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    spread = placed.select("key", "doc", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    full = spread.join(reps.select("doc", "keys", "signature"), "doc").select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "keys", "signature")
    pairs = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_met(least_equal(least)), "a long, b long").where("a < b").distinct()
    texts = docs.select(docs[doc_id].cast("long").alias("__doc"), text_or_empty(docs, text).alias("__text")).dropDuplicates(["__doc"])
    both = pairs.join(texts, F.col("a") == F.col("__doc")).select("a", "b", F.col("__text").alias("ta"))
    both = both.join(texts, F.col("b") == F.col("__doc")).select("a", "b", "ta", F.col("__text").alias("tb"))
    return both.mapInPandas(jaccards(k), "a long, b long, jaccard double").where(F.col("jaccard") >= least), members


def jaccards(k: int):
    """For mapInPandas over (a, b, ta, tb): the similarity of the full shingle sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            out = []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                flat, o = shingles([ta.encode("utf-8", "surrogatepass"), tb.encode("utf-8", "surrogatepass")], k, words)
                x, y = np.unique(flat[o[0] : o[1]]), np.unique(flat[o[1] : o[2]])
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / max(1, len(x) + len(y) - both))
            yield batch[["a", "b"]].assign(jaccard=out)

    return run
