"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A signature has CHUNKS x CHUNK numbers of BITS bits. Two signatures that differ in at
most CHUNKS * (ERRORS + 1) - 1 numbers have, by the pigeonhole principle, a chunk in
which at most ERRORS numbers differ. Every chunk is enumerated with each choice of
ERRORS numbers left out; signatures that agree in such a key meet in its bucket, so no
pair under that distance is missed. A pair at similarity 0.8 escapes all chunks with
probability (1 - 0.819)**8, about 1e-6.

Documents of one shingle set are one node, so copies never multiply. A bucket doesn't
list its pairs: for a few rounds its members are tested against one pivot each
on full sets, and members that got into one component are done with each other. The
members of buckets that still hold several components are then compared by sketch where
they lie, and only pairs across components that may be similar enough are tested on
full sets. So every pair of a bucket is tested, excluded, or within one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import HOT_KEYS, WordHashes, forget, hot_join, mixed, plain_names, shingles, text_or_empty, written
from siltstone.llm.components import connected
from siltstone.llm.minhash import band_keys, signatures

CHUNKS, CHUNK, ERRORS, BITS = 8, 4, 1, 16
#: Link from this share on: intersection * SHARE[1] >= union * SHARE[0].
SHARE = (80, 100)
#: A sketch: the least hash of each of so many ranges, in a byte. Of two sets at similarity 0.8 more than
#: MOST_APART places differ (102 do on average, 9 is the deviation) with probability 9e-7.
PLACES, MOST_APART = 512, 147
#: Masks under which the least member of a bucket is its pivot, one for each round; members of a bucket compared at once.
PIVOTS, BLOCK = (0, 0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D), 4096
#: Blocks of a bucket from which on its members are told apart by a second chunk before they are compared.
CROWDED = 8
WORDS = 5
#: Pairs of one node, at least, beyond which they are dealt to several tasks.
PAIRS = 2_000

_PREPARED = "doc long, mark long, n_shingles long, set binary, sketch binary, keys array<long>, sig binary"
_LARGEST = np.iinfo(np.int64).max
_NAMES = ["doc", "mark", "n_shingles", "set", "sketch", "keys", "sig"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(texts, keys) int64: for each chunk, and each choice of ERRORS numbers to leave out, a hash of the rest."""
    parts = sigs.reshape(len(sigs), CHUNKS, CHUNK).astype(np.uint64)
    out = []
    for left_out in combinations(range(CHUNK), ERRORS):
        kept = [i for i in range(CHUNK) if i not in left_out]
        key = np.full(parts.shape[:2], sum(1 << i for i in kept), np.uint64) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(1 << CHUNK)
        for i in kept:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
        out.append(key)
    return np.concatenate(out, axis=1).view(np.int64)


def more_keys(sigs: np.ndarray) -> np.ndarray:
    """(texts, keys) int64: for each chunk, and each choice of ERRORS + 1 numbers to leave out, a hash of the rest.

    Two signatures at similarity 0.8 that agree in one chunk agree in such a key of another one but with probability 2e-11.
    """
    parts = sigs.reshape(len(sigs), CHUNKS, CHUNK).astype(np.uint64)
    out = []
    for left_out in combinations(range(CHUNK), ERRORS + 1):
        kept = [i for i in range(CHUNK) if i not in left_out]
        key = np.full(parts.shape[:2], sum(1 << i for i in kept) + 7, np.uint64) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(1 << CHUNK + 3)
        for i in kept:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
        out.append(key)
    return np.stack(out, axis=2).view(np.int64)


def sketch_of(hashes: np.ndarray) -> bytes:
    """For each of PLACES equal ranges of the sorted hashes a byte of its least one, 0 if it has none."""
    starts = np.searchsorted(hashes, np.arange(PLACES, dtype=np.uint64) * np.uint64(2**64 // PLACES))
    ends = np.append(starts[1:], len(hashes))
    out = np.zeros(PLACES, np.uint8)
    some = ends > starts
    out[some] = 1 + (hashes[starts[some]] % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def _prepare(k: int, bands: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                flat, offsets = shingles([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], k, words)
                sets = [np.unique(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sigs = signatures(flat, offsets, CHUNKS * CHUNK, seed=10).astype(np.uint16)
                keys = (band_keys(flat, offsets) if bands else chunk_keys(sigs)).tolist()
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [batch.column("doc"), batch.column("mark"), [len(s) for s in sets], ids, [sketch_of(s) for s in sets], [q if len(s) else None for q, s in zip(keys, sets, strict=True)], [x.tobytes() for x in sigs]]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return run


def _linked(k: int):
    """Keep the pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        seen: dict[str, np.ndarray] = {}

        def full(text: str) -> np.ndarray:
            if text not in seen:
                while len(seen) >= 32:
                    del seen[next(iter(seen))]
                seen[text] = np.unique(shingles([text.encode("utf-8", "surrogatepass")], k, words)[0])
            return seen[text]

        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                x, y = full(ta), full(tb)
                less, more = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if less * SHARE[1] >= more * SHARE[0] else 0
                keep.append(both > 0 and both * SHARE[1] >= (len(x) + len(y) - both) * SHARE[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _far(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Which rows of sketches x, of sets of the sizes, can't be linked with sketch y of a set of ``size``."""
    less, more = np.minimum(sizes, size), np.maximum(sizes, size)
    apart = (x != y).sum(axis=1)
    # a place differs only if an element that one set lacks is in it: a ninth of both sizes at most
    return (less * SHARE[1] < more * SHARE[0]) | (apart > np.minimum(MOST_APART, (sizes + size) // 9))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket and blocks: the pairs (a, b) of different components that aren't far apart by sketch."""

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        node, root, size, block, first, second = (rows.column(c).to_numpy() for c in ("node", "root", "n_shingles", "block", "i", "j"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        here = rows.column("key")[0].as_py()
        a, b = [], []
        for k in range(len(node) - 1):
            other = root[k + 1 :] != root[k]
            if first[0] != second[0]:  # two blocks of one bucket: only across them
                other &= block[k + 1 :] != block[k]
            rest = np.flatnonzero(other) + k + 1
            near = rest[~_far(sketch[rest], sketch[k], size[rest], size[k])] if len(rest) else rest
            # a pair meets in many buckets: it is told of in that of its least common key
            near = near[np.where(keys[near] == keys[k], keys[near], _LARGEST).min(axis=1) == here] if len(near) else near
            a += [int(node[k])] * len(near)
            b += node[near].tolist()
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group_of = [batch.column(c).to_numpy() for c in ("key", "sub", "i", "j")]
        cuts = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in group_of], axis=0)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            group = tuple(x[start] for x in group_of)
            if held and group != last:
                yield pairs(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = group
    if held:
        yield pairs(held)


def _with_text(pairs: DataFrame, texts: DataFrame, end: str, total: int) -> DataFrame:
    """pairs with the text of one end. A node of many pairs (a pivot) is dealt to several tasks, its text to each of them."""
    most = max(PAIRS, -(-total // HOT_KEYS))
    crowded = F.broadcast(pairs.groupBy(end).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    other = "b" if end == "a" else "a"
    dealt = pairs.join(crowded, end, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    copies = texts.toDF(end, f"t{end}").join(crowded, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copies, [end, "part"]).drop("part")


def verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that are similar enough on the full sets of their texts, written."""
    pairs = written(pairs, "pairs") if getattr(pairs, "_written_at", None) is None else pairs
    total = pairs.count()
    both = _with_text(_with_text(pairs, texts, "a", total), texts, "b", total)
    links = written(both.select("a", "b", "ta", "tb").mapInArrow(_linked(k), "a long, b long"), "links")
    forget(pairs)
    return links


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, bands: bool = False) -> DataFrame:
    """(doc, mark, n_shingles, component) for each row of docs: the least id of its near-duplicate group.

    doc is the id and mark the text's hash. A text with fewer than k words is one shingle; a
    null or empty text, or one of white space, has none and is linked with nothing. Rows of one id
    are one document, linked by any of its texts. Rows without an id take no part: their
    component is null. An empty table gives no rows.

    bands: buckets are bands of MinHash signatures instead (see minhash); all else is the same.
    """
    named = docs.select(docs[doc_id].cast("long").alias("doc"), F.xxhash64(text_or_empty(docs, text)).alias("mark"), text_or_empty(docs, text).alias("text"))
    rows = written(named.mapInArrow(_prepare(k, bands), _PREPARED), "prepared")
    full = rows.where("set is not null and doc is not null")
    # one node for each shingle set, named by the least document that has it
    nodes = written(full.groupBy("set").agg(F.min(F.struct("doc", "mark", "n_shingles", "sketch", "keys", "sig")).alias("one")).select("set", F.col("one.doc").alias("node"), "one.mark", "one.n_shingles", "one.sketch", "one.keys", "one.sig"), "nodes")

    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(hot_join(keyed, shared, "key", nodes.count() * CHUNKS * CHUNK), "met")
    wanted = met.select("node").distinct().join(nodes.select("node", "mark"), "node")
    texts = written(named.join(wanted, (named["doc"] == wanted["node"]) & (named["mark"] == wanted["mark"])).groupBy("node", wanted["mark"]).agg(F.first("text").alias("text")).select("node", "text"), "texts")

    labels = None
    for mask in PIVOTS:
        left = _open(met, labels)
        masked = F.col("node").bitwiseXOR(F.lit(mask)).alias("masked")
        pivots = left.groupBy("key").agg(F.min(masked).alias("pivot"), F.count("*").alias("n"))
        # a node is tested once in a round: with the least pivot of all its buckets
        near = hot_join(left.select("key", "node", masked), pivots, "key", left.count()).where("masked <> pivot").groupBy("node").agg(F.min("pivot").bitwiseXOR(F.lit(mask)).alias("pivot"))
        near = near.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        labels = _joined(labels, verified(_apart(near, labels), texts, k))
        if left is not met:
            forget(left)
    left = _open(met, labels)
    rest = _rest(left, nodes)
    labels = _joined(labels, verified(rest, texts, k))
    forget(rest, left, met, texts)
    # a root is the least node of its component, and a node the least document of its set
    named_sets = nodes.select("set", "node").join(labels.toDF("node", "root"), "node", "left").select("set", F.coalesce("root", "node").alias("root"))
    return rows.join(named_sets, "set", "left").select("doc", "mark", "n_shingles", F.coalesce("root", "doc").alias("component"))


def _with_roots(rows: DataFrame, labels: DataFrame | None, node: str, root: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(root, F.col(node))
    return rows.join(labels.toDF(node, "__root"), node, "left").withColumn(root, F.coalesce("__root", node)).drop("__root")


def _open(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, root): the rows of the buckets that hold several components."""
    if labels is None:
        return met.withColumn("root", F.col("node"))
    rooted = _with_roots(met, labels, "node", "root")
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y").select("key", "n")
    return written(hot_join(rooted, several, "key", met.count()).select("key", "node", "root"), "open")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components."""
    if labels is None:
        return pairs
    return _with_roots(_with_roots(pairs, labels, "a", "x"), labels, "b", "y").where("x <> y").select("a", "b")


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components of labels and edges; both are written, and go."""
    if labels is None:
        after = connected(edges)
    elif edges.limit(1).count():
        after = connected(labels.unionByName(edges))
        forget(labels)
    else:
        after = labels
    forget(edges)
    return after


def _rest(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of open buckets, across components, that aren't far apart by sketch.

    Buckets are compared where they lie, in blocks of BLOCK members: a larger one is spread
    over a task for each two of its blocks. The members of a crowded bucket first part into
    buckets of a second chunk, so that its rows don't grow with the square of its members.
    """
    sizes = left.groupBy("key").agg(F.count("*").alias("n")).withColumn("members", F.col("n"))
    placed = written(hot_join(left, sizes, "key", left.count()), "placed")
    crowded = F.col("members") > CROWDED * BLOCK
    plain = placed.withColumn("sub", F.lit(0).cast("long"))
    if placed.where(crowded).limit(1).count():
        parted = placed.where(crowded).join(nodes.select("node", "sig", "keys"), "node").mapInArrow(_second, "key long, node long, root long, members long, sub long")
        together = parted.groupBy("key", "sub").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key", "sub", "n", F.col("n").alias("size"))
        parted = hot_join(parted.drop("members"), together, ["key", "sub"], placed.count()).withColumnRenamed("size", "members").select(plain.columns)
        plain = plain.where(~crowded).unionByName(parted)
    blocked = plain.withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = blocked.select("key", "sub", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    full = spread.join(nodes.select("node", "n_shingles", "sketch", "keys"), "node").select(
        "key", "sub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n_shingles", "sketch", "keys"
    )
    dealt = full.repartition("key", "sub", "i", "j").sortWithinPartitions("key", "sub", "i", "j")
    pairs = written(dealt.mapInArrow(_compare, "a long, b long").distinct(), "apart")
    forget(placed)
    return pairs


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a bucket once for every key of another chunk than the bucket's."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        subs = more_keys(sigs)
        own = np.array(batch.column("keys").to_pylist(), np.int64)
        # keys are listed by what they leave out, then by chunk
        here = (own == batch.column("key").to_numpy()[:, None]).argmax(axis=1) % CHUNKS
        others = np.stack([np.delete(x, c, axis=0).reshape(-1) for x, c in zip(subs, here.tolist(), strict=True)])
        row = np.repeat(np.arange(batch.num_rows), others.shape[1])
        taken = batch.select(["key", "node", "root", "members"]).take(pa.array(row))
        yield pa.record_batch([*taken.columns, pa.array(others.reshape(-1))], ["key", "node", "root", "members", "sub"])


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """One row of each near-duplicate group of docs: that of the least id, and of its texts the one of least hash.

    All columns stay as they are. A text without words is a group of its own; rows without an id all stay.
    """
    docs, (doc_id, text), back = plain_names(docs, doc_id, text)
    groups = near_groups(docs, doc_id, text, k)
    best = written(groups.where("doc = component").groupBy("doc").agg(F.min("mark").alias("mark"), F.count("*").alias("n")), "keepers")
    kept = docs.join(
        best.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")),
        (docs[doc_id].cast("long") == F.col("__doc")) & (F.xxhash64(text_or_empty(docs, text)) == F.col("__mark")),
    )
    if best.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["__doc"])
    return back(kept.select(*(docs[c] for c in docs.columns)).unionByName(docs.where(docs[doc_id].isNull())))
