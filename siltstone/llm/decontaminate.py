"""Benchmark decontamination: an FM-index over each shard of the documents, searched for every phrase.

A phrase is a window of consecutive words of a benchmark item. A shard is a run of
documents inside one task; no document and no index row leaves its task. Words that no
phrase has can't be part of a hit, nor can two neighbours that no phrase has side by
side, so the index covers only the runs of words between them; positions map back to
the whole text. Phrases are searched backward, all at once, through wavelet-matrix
ranks; hits are located by sampled suffix positions and merged to removal spans.

The benchmark may be large: its items come to the driver as a stream, MOST_WINDOWS
windows at a time in packed arrays, and each such block is one pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, plain_names, text_or_empty, written
from siltstone.llm.fm_index import FMIndex

#: Words of a window; a document is contaminated if so much of it, or more, is hit.
WINDOW, LEAST_SHARE = 13, 1 / 20
#: Windows that are sent to the tasks at once, some 100 bytes each; a larger benchmark is searched in several passes.
MOST_WINDOWS = 1_000_000
#: UTF-8 bytes of the items that the driver fetches at once, about; bytes of a text that are cut into words at once.
FETCHED, CUT = 4 << 20, 1 << 20
#: Words of an index shard; a longer document is a shard of its own.
SHARD_WORDS = 2_000_000

#: ASCII characters that aren't part of a word become spaces; A-Z become a-z.
_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
#: A word of words_of in the text itself.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def stream_words(text: str) -> Iterator[bytes]:
    """words_of a long text, without a list of all of them."""
    data = text.encode("utf-8", "surrogatepass").translate(_WORDS)
    a = 0
    while a < len(data):
        b = data.find(b" ", a + CUT)
        b = len(data) if b < 0 else b
        yield from data[a:b].split()
        a = b


class Phrases:
    """The distinct windows of benchmark items, in symbols 1 .. n of the words they hold, and the items that have each.

    A piece of an item has at least a window's words, or is a whole shorter item.
    """

    def __init__(self, pieces: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        number: dict[object, int] = {}
        coded, owner = [], []
        for item, words in pieces:
            if words:
                coded.append(np.fromiter((self.code.setdefault(w, len(self.code) + 1) for w in words), np.int32, len(words)))
                owner.append(number.setdefault(item, len(number)))
        self.ids = list(number)
        self.base = len(self.code) + 1
        self.bits = max(1, (self.base - 1).bit_length())
        self.single = np.zeros(self.base, bool)
        size = np.array([len(c) for c in coded], np.int64)
        flat = np.concatenate([*coded, np.zeros(0, np.int32)])
        begins = np.concatenate([[0], np.cumsum(size)])[:-1]
        inner = np.ones(len(flat), bool)
        inner[begins] = False
        then = np.flatnonzero(inner)
        self.pairs = np.unique(flat[then - 1].astype(np.int64) * self.base + flat[then])
        windows = np.maximum(1, size - window + 1)
        piece = np.repeat(np.arange(len(size)), windows)
        start = begins[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        before = np.maximum(window - size, 0)[piece]  # empty places at the left of a short window
        every = np.zeros((len(piece), window), np.int32)
        for j in range(window):
            some = before <= j
            every[some, j] = flat[start[some] + j - before[some]]
        rows = every.view(np.dtype((np.void, window * 4)))[:, 0]
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        self.symbols = every[first]
        self.lengths = window - before[first]
        self.shortest = int(self.lengths.min(initial=window)) if len(first) else 0
        self.single[self.symbols[self.lengths == 1, -1]] = True
        has = np.unique(which * len(self.ids) + np.array(owner, np.int64)[piece]) if len(piece) else np.zeros(0, np.int64)
        self._item = (has % max(1, len(self.ids))).astype(np.int32)
        self._item_at = np.searchsorted(has // max(1, len(self.ids)), np.arange(len(first) + 1))

    def items(self, phrase: int) -> list:
        return [self.ids[i] for i in self._item[self._item_at[phrase] : self._item_at[phrase + 1]].tolist()]

    def hits(self, codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase) of all occurrences in codes; breaks[i] says that i begins a document."""
        n = len(codes)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n or not len(self.lengths):
            return none
        joined = np.zeros(n + 1, bool)  # joined[i]: i - 1 and i stand side by side in some phrase
        near = np.flatnonzero((codes[1:] > 0) & (codes[:-1] > 0) & ~breaks[1:]) + 1
        if len(self.pairs) and len(near):
            pair = codes[near - 1] * self.base + codes[near]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[near] = self.pairs[at] == pair
        kept = joined[:-1] | joined[1:] | self.single[codes]
        where = np.flatnonzero(kept)
        if not len(where):
            return none
        starts = np.flatnonzero(~joined[where])
        long = np.diff(np.append(starts, len(where))) >= self.shortest
        keep = np.repeat(long, np.diff(np.append(starts, len(where))))
        where = where[keep]
        if not len(where):
            return none
        starts = np.flatnonzero(~joined[where])
        index = FMIndex(codes[where], starts, self.bits)
        lo, hi = index.search(self.symbols, self.lengths)
        some = np.flatnonzero(hi > lo)
        count = hi[some] - lo[some]
        rows = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return where[index.locate(rows)], np.repeat(some, count)


def _search(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[int], list[int], list]]:
    """For each text of a shard: its words, the merged spans of words that are hit, and the items."""
    words = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    breaks = np.zeros(offsets[-1], bool)
    breaks[offsets[:-1][counts > 0]] = True
    change = np.zeros(offsets[-1] + 1, np.int32)
    items: dict[int, set] = {}
    get = phrases.code.get
    codes = np.fromiter((get(w, 0) for doc in words for w in doc), np.int64, offsets[-1])
    at, phrase = phrases.hits(codes, breaks)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.lengths[phrase], -1)
    doc = np.searchsorted(offsets, at, "right") - 1
    for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
        items.setdefault(d, set()).update(phrases.items(p))
    covered = np.cumsum(change[:-1]) > 0
    begins = np.flatnonzero(covered & (breaks | ~np.concatenate([[False], covered[:-1]]))) if len(covered) else np.zeros(0, np.int64)
    last = np.concatenate([breaks[1:], [True]]) if len(covered) else breaks
    stops = np.flatnonzero(covered & (last | ~np.concatenate([covered[1:], [False]]))) + 1 if len(covered) else begins
    cut = np.searchsorted(begins, offsets)
    return [
        (int(counts[d]), (begins[cut[d] : cut[d + 1]] - offsets[d]).tolist(), (stops[cut[d] : cut[d + 1]] - offsets[d]).tolist(), sorted(items.get(d, ())))
        for d in range(len(texts))
    ]


def _shards(sent, others: list[str], text: str, item: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(item))
        for batch in batches:
            texts = batch.column(text)
            ends, size = [], 0
            for i, n in enumerate(pc.binary_length(texts).to_pylist()):
                size += (n or 0) // 4
                if size >= SHARD_WORDS:
                    ends.append(i + 1)
                    size = 0
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                found = _search(part.column(text).to_pylist(), phrases)
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.record_batch([*(part.column(c) for c in others), *columns], [*others, "__n_words", "__starts", "__ends", "__items"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several passes over one document, joined to maximal ones."""
    for batch in batches:
        out = []
        for starts, ends in zip(batch.column("__starts").to_pylist(), batch.column("__ends").to_pylist(), strict=True):
            made: list[list[int]] = []
            for a, b in sorted(zip(starts, ends, strict=True)):
                if made and a <= made[-1][1]:
                    made[-1][1] = max(b, made[-1][1])
                else:
                    made.append([a, b])
            out.append(([x[0] for x in made], [x[1] for x in made]))
        rest = [c for c in batch.schema.names if c not in ("__starts", "__ends")]
        columns = [pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.record_batch([*(batch.column(c) for c in rest), *columns], [*rest, "__starts", "__ends"])


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW, most: int | None = None) -> Iterator[tuple[Phrases, bool]]:
    """The windows of all items with an id and a text, MOST_WINDOWS at a time, and whether more follow; a long item may be in several blocks.

    Ids are whole numbers, else they are taken as text. The driver holds about FETCHED bytes of items and one block.
    """
    most = most or MOST_WINDOWS
    kind = "long" if benchmark.schema[item_id].dataType.simpleString() in _WHOLE else "string"
    items = benchmark.where(benchmark[item_id].isNotNull() & benchmark[text].isNotNull()).select(
        benchmark[item_id].cast(kind).alias("item"), benchmark[text].alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > FETCHED:
        items = items.repartition(-(-size // FETCHED), F.xxhash64("item", "text"))
    held: list[tuple[object, list[bytes]]] = []
    room = most
    for row in items.toLocalIterator():
        words, tail = stream_words(row["text"]), []
        while True:
            size = room if room > 0 else most
            fresh = list(islice(words, size if tail else size + window - 1))
            if not fresh:
                break
            if room <= 0:  # a block is told when there is more than it
                yield Phrases(held, window), True
                held, room = [], most
            piece = tail + fresh
            held.append((row["item"], piece))
            tail = piece[len(piece) - window + 1 :]
            room -= max(1, len(piece) - window + 1)
    if held:
        yield Phrases(held, window), False


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None
) -> DataFrame:
    """For each row of docs: the columns ``keep`` (doc_id alone if None), and

    __n_words long, __starts and __ends array<int> (maximal runs of hit words, ends
    exclusive) and __items, an array of the ids of the items with a window in the text, sorted
    (long, or string if the ids aren't whole numbers).

    A null or empty text, or one without words, has no words and no hits. Items without id, text
    or words have no windows; rows of one item id are one item. Every row is judged by itself:
    repeated rows and null ids too. The documents aren't shuffled, unless the benchmark has over
    MOST_WINDOWS windows: each block of it is then a pass over the documents whose hits are
    written, and they meet the documents by id and hash of the text.
    """
    keep = [doc_id] if keep is None else keep
    spark = docs.sparkSession
    inner = text if text in keep else "__text"  # sent once, even if it is to be kept
    chosen = docs.select(*(docs[c] for c in keep), *([] if text in keep else [text_or_empty(docs, text).alias(inner)]))
    whole = benchmark.schema[item_id].dataType.simpleString() in _WHOLE
    item = pa.int64() if whole else pa.string()
    added = f"__n_words long, __starts array<int>, __ends array<int>, __items array<{'long' if whole else 'string'}>"
    blocks = benchmark_blocks(benchmark, item_id, item_text, window)
    now, more = next(blocks, (Phrases([], window), False))

    def searched(rows: DataFrame, phrases: Phrases, kept: list[str]):
        sent = spark.sparkContext.broadcast(phrases)
        ddl = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), added])
        return rows.mapInArrow(_shards(sent, kept, inner, item), ddl), sent

    if not more:
        return searched(chosen, now, keep)[0]
    mark = F.xxhash64(F.coalesce(F.col(f"`{inner}`"), F.lit("")))
    narrow = docs.select(docs[doc_id].alias("__id"), docs[text].alias(inner)).withColumn("__mark", mark)
    passes = []
    while True:
        found, sent = searched(narrow, now, ["__id", "__mark"])
        passes.append(written(found.where(F.size("__items") > 0) if passes else found, "pass"))
        sent.unpersist()
        if not more:
            break
        now, more = next(blocks)
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    # equal rows have equal results
    each = every.groupBy("__id", "__mark", "__n_words").agg(
        F.collect_set(F.struct("__starts", "__ends")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("__items")
    )
    part = lambda c: F.flatten(F.transform("__spans", lambda s: s[c])).alias(c)
    each = each.select("__id", "__mark", "__n_words", "__items", part("__starts"), part("__ends"))
    merged = written(each.mapInArrow(_merged, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema)), "merged")
    forget(*passes)
    own = docs.select(*(docs[c] for c in keep), docs[doc_id].alias("__id2"), F.xxhash64(text_or_empty(docs, text)).alias("__mark2"))
    met = own.join(merged, own["__id2"].eqNullSafe(merged["__id"]) & (own["__mark2"] == merged["__mark"]))
    return met.select(*(own[c] for c in keep), "__n_words", "__starts", "__ends", "__items")


def hit_words() -> Column:
    """Words of a find_contamination row that are hit."""
    return F.aggregate(F.zip_with("__ends", "__starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def is_contaminated() -> Column:
    """At least one word, and at least LEAST_SHARE of the words, is hit."""
    return (hit_words() > 0) & (hit_words() * round(1 / LEAST_SHARE) >= F.col("__n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns, and all other rows, as they are."""
    if docs.columns.count(text) != 1:
        raise ValueError(f"docs needs one column {text}")
    docs, (doc_id, text), back = plain_names(docs, doc_id, text)
    return back(find_contamination(docs, benchmark, doc_id, text, keep=docs.columns).where(~is_contaminated()).select(*(f"`{c}`" for c in docs.columns)))


def text_spans(text: str | None, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Code point offsets, ends exclusive, of spans of words: from each one's first word to the end of its last."""
    if not starts:
        return []
    words = [m.span() for m in _WORD.finditer(text or "")]
    return [(words[a][0], words[b - 1][1]) for a, b in zip(starts, ends, strict=True)]


def _cut(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, starts, ends in zip(*(batch.column(c).to_pylist() for c in (text, "__starts", "__ends")), strict=True):
                for a, b in reversed(text_spans(t, starts, ends)):
                    t = t[:a] + t[b:]
                out.append(t)
            kept = [c for c in batch.schema.names if c not in ("__starts", "__ends")]
            yield pa.record_batch([pa.array(out, pa.string()) if c == text else batch.column(c) for c in kept], kept)

    return run


def remove_passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, every row, with all passages that are hit cut out of the text, however small their share is.

    What separates words stays, and null texts stay null. The pipeline drops contaminated
    documents and doesn't call this.
    """
    if docs.columns.count(text) != 1:
        raise ValueError(f"docs needs one column {text}")
    docs, (doc_id, text), back = plain_names(docs, doc_id, text)
    found = find_contamination(docs, benchmark, doc_id, text, keep=docs.columns).select(*(f"`{c}`" for c in docs.columns), "__starts", "__ends")
    return back(found.mapInArrow(_cut(text), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)))
