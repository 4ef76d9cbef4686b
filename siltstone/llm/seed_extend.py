"""Substring dedup by seed and extend: words that a run of LENGTH words covers which an earlier document has too.

Seeds are winnowed anchors: of the SEED-word pieces of every window of LENGTH words the one of
least hash, so that equal windows have equal seeds at equal places. Neighbouring windows share
a seed; what they cover together is the seed's match candidate, which reaches as far to both
sides as windows with that seed can.

Documents meet by seed. Occurrences that agree to both ends of their candidates are one class,
and all but those of its earliest document repeat it. Where a seed has several classes (at the
edges of repeats), each class is extended from the seed to LENGTH words in every way, l words
to the left and the rest to the right; extensions meet in turn, and those that an earlier
document has too are matches. Matches that touch make up the maximal repeats, which are of
LENGTH words or more. No pair of occurrences is listed.

Rows are range-partitioned by (seed, class, document): a seed or a class of a third of all
documents spreads over as many partitions as its rows need. What a partition doesn't see is
beyond its first and last seed; all classes of those two are extended, which decides them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bwt_merge import Rolling
from siltstone.llm.common import hot_join, mixed, written
from siltstone.llm.line_dedup import NO_ID

#: Words of a match at least, and of a seed.
LENGTH, SEED = 13, 7
#: Characters of text, or bytes, that are hashed at once.
CHUNK = 2 << 20
REPEATED, OPEN = 0, 1

_SEEDS = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("f", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.int64())])
_COLUMNS = _SEEDS.names[1:]
_SEEDS_DDL = "kind int, h long, f long, doc long, mark long, at long"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _least(order: np.ndarray, width: int) -> np.ndarray:
    """The position of the least of every ``width`` neighbours; order holds positions in its low half."""
    least, have = order, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return ((np.minimum(least[: len(least) - rest], least[rest:]) if rest else least) & _LOW).astype(np.int64)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word, CHUNK bytes at a time."""
    hashes, places, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(data):
        end = _SPACE.search(data, a + CHUNK)
        b = end.start() if end else len(data)
        part = np.frombuffer(b" " + data[a:b] + b" ", np.uint8)
        space = _IS_SPACE[part]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        hashes.append(Rolling(part).of(starts, ends - starts))
        places.append(starts + (a - 1))
        a = b
    return np.concatenate(hashes), np.concatenate(places)


class Texts:
    """The words of some texts, one text after the other, as hashes."""

    def __init__(self, texts: list[str | None], length: int):
        self.length = length
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        hashes, places = _word_hashes(b"\n".join(parts))
        ends = np.cumsum([len(x) + 1 for x in parts])
        self.begins = np.concatenate([[0], np.searchsorted(places, ends)])
        self.rolling = Rolling(hashes)

    def candidates(self, seed: int) -> tuple[np.ndarray, ...]:
        """(text, first window, windows, seed's hash, content's hash) of every run of windows with one seed, text by text."""
        lengths = np.diff(self.begins)
        if not (lengths >= self.length).any():
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        pieces = self.rolling.all_of(seed)
        at = _least((pieces & _HIGH) | np.arange(len(pieces), dtype=np.uint64), self.length - seed + 1)
        whole = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]  # the text of each window, if it ends there too
        within = np.arange(len(at)) + self.length <= self.begins[whole + 1]
        fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])])
        starts = np.flatnonzero(fresh & within)
        # a run ends at the next one, or where the windows reach over the text's end
        ends = np.append(np.flatnonzero(fresh), len(at))
        ends = np.minimum(ends[np.searchsorted(ends, starts, "right")], self.begins[whole[starts] + 1] - self.length + 1)
        text, count = whole[starts], ends - starts
        content = mixed(self.rolling.of(starts, count + self.length - 1) + count.astype(np.uint64))
        return text, starts - self.begins[text], count, pieces[at[starts]], content

    def windows(self, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window that begins there."""
        at = self.begins[text] + start
        half = self.length // 2
        return self.rolling.of(at, self.length), mixed(self.rolling.of(at, half) ^ mixed(self.rolling.of(at + half, self.length - half)))


def _rows(kind: int, h, f, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    h, f = (np.zeros(len(doc), np.int64) if x is None else x for x in (h, f))
    return pa.record_batch([pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(x.view(np.int64)) for x in (h, f, doc, mark, at))], schema=_SEEDS)


def _merged(doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows (first << 32 | count), those that follow each other in one text as one."""
    if not len(doc):
        return doc, mark, at
    order = np.lexsort((at, mark, doc))
    doc, mark, start, count = doc[order], mark[order], at[order] >> 32, at[order] & 0xFFFFFFFF
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + count[:-1])]))
    last = np.maximum.reduceat(start + count, fresh)
    return doc[fresh], mark[fresh], start[fresh] << 32 | (last - start[fresh])


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices with about CHUNK characters of text each."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        n = len(text or "")
        if b > a and size + n > CHUNK:
            yield a, b
            a, size = b, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def _seeded(length: int, seed: int):
    """Seeds of the documents. Of one class and chunk only the earliest document's occurrences go on; the others repeat them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks, texts = batch.column("doc").to_numpy(), batch.column("mark").to_numpy(), batch.column("text").to_pylist()
            for a, b in _grouped(texts):
                by_doc = np.argsort(docs[a:b], kind="stable")
                text, start, count, h, f = Texts([texts[a + i] for i in by_doc.tolist()], length).candidates(seed)
                # documents come in order: so do the rows of a class when all are sorted by one hash of it
                order = np.argsort(mixed(h ^ mixed(f)), kind="stable")
                row = a + by_doc[text[order]]
                h, f, doc, mark, at = h[order], f[order], docs[row], marks[row], start[order] << 32 | count[order]
                later = _later(h, f, doc)
                yield _rows(OPEN, *(x[~later] for x in (h, f, doc, mark, at)))
                doc, mark, at = _merged(doc[later], mark[later], at[later])
                yield _rows(REPEATED, mixed(doc.view(np.uint64)), None, doc, mark, at)

    return run


def _later(h: np.ndarray, f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows that are sorted by class (h, f), and by doc within one, those whose class has an earlier document."""
    if not len(h):
        return np.zeros(0, bool)
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])
    return doc > doc[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h, f, doc): later documents of a class repeat it; the earliest go on where the seed has several classes, or is the partition's first or last."""
    top: tuple[int, int, int] | None = None  # the class of the last row, and its earliest document
    held = tuple(np.zeros(0, np.int64) for _ in _COLUMNS)  # what the last seed has, as long as it is one class
    known = None  # the last seed, if all it has goes on
    began = False
    for batch in batches:
        kind, *columns = (batch.column(c).to_numpy() for c in _SEEDS.names)
        done = kind == REPEATED
        yield _rows(REPEATED, None, None, *(x[done] for x in columns[2:]))
        h, f, doc, mark, at = (x[~done] for x in columns)
        if not len(h):
            continue
        first = np.concatenate([[top is None or (h[0], f[0]) != top[:2]], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])
        where = np.maximum.accumulate(np.where(first, np.arange(len(h)), -1))
        least = np.where(where < 0, top[2] if top else 0, doc[np.maximum(where, 0)])
        top = (int(h[-1]), int(f[-1]), int(least[-1]))
        later = doc > least
        yield _rows(REPEATED, None, None, *_merged(doc[later], mark[later], at[later]))

        h, f, doc, mark, at = (np.concatenate([x, y[~later]]) for x, y in zip(held, (h, f, doc, mark, at), strict=True))
        if not len(h):
            continue
        cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(h)]])
        classes = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (f[1:] != f[:-1]))])
        go = classes[ends - 1] > classes[begins]
        go[0] |= not began or h[0] == known
        began = True
        every = np.repeat(go, ends - begins)
        yield _rows(OPEN, h[every], None, doc[every], mark[every], at[every])
        known = None if not go[-1] else h[-1]
        rest = slice(len(h), None) if go[-1] else slice(begins[-1], None)
        held = tuple(x[rest] for x in (h, f, doc, mark, at))
    h, _, doc, mark, at = held
    yield _rows(OPEN, h, None, doc, mark, at)


def _extended(length: int):
    """Every extension of the open candidates to ``length`` words: (w1, w2, doc, mark, start), from (doc, mark, text, list of at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text").to_pylist(), batch.column("wanted").to_pylist()
            docs, marks = (batch.column(c).to_numpy() for c in ("doc", "mark"))
            for a, b in _grouped(texts):
                found = Texts(texts[a:b], length)
                at = np.array([x for w in wanted[a:b] for x in w], np.int64)
                row = np.repeat(np.arange(b - a), [len(w) for w in wanted[a:b]])
                start, count = at >> 32, at & 0xFFFFFFFF
                row = np.repeat(row, count)
                start = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                w1, w2 = found.windows(row, start)
                yield pa.record_batch([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(docs[a:b][row]), pa.array(marks[a:b][row]), pa.array(start)], ["w1", "w2", "doc", "mark", "start"])

    return run


def _spans(runs: list[int] | None, length: int) -> list[tuple[int, int]]:
    """(start, end) in words of what runs of windows (first << 32 | count) cover; those that touch are one."""
    spans: list[list[int]] = []
    for at in sorted(runs or ()):
        a, b = at >> 32, (at >> 32) + (at & 0xFFFFFFFF) + length - 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _left(words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(words)]
    return b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b])


def _joined(docs: DataFrame, doc_id: str, text: str, length: int, seed: int, rest: list[str]) -> DataFrame:
    """(doc_id, text, rest, runs) of each row; rest: a struct of those columns."""
    if not 1 <= seed <= length:
        raise ValueError("a seed has 1 word at least, and no more than a match")
    number = docs[doc_id].cast("long")
    named = docs.select(number.alias("doc_id"), docs[text].alias("text"), F.struct(*(docs[c].alias(c) for c in rest)).alias("rest"), F.coalesce(number, F.lit(NO_ID)).alias("doc"))
    repeats = bool(named.groupBy("doc").count().where("count > 1").limit(1).count())
    # texts of one id are told apart by a hash, which costs room in every row: only where there are any
    keyed = named.withColumn("mark", F.coalesce(F.xxhash64("text"), F.lit(0)) if repeats else F.lit(0).cast("long"))
    key, order = ["doc", "mark"], ["h", "f", "doc"]
    dealt = keyed.repartition(*key)

    seeds = keyed.select(*key, "text").mapInArrow(_seeded(length, seed), _SEEDS_DDL)
    found = written(seeds.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_settle, _SEEDS_DDL), "seeds")

    wanted = found.where(F.col("kind") == OPEN).groupBy(*key).agg(F.collect_set("at").alias("wanted"))
    # all columns of the dealt texts, so that both uses share one exchange
    reached = written(dealt.join(wanted, key).mapInArrow(_extended(length), "w1 long, w2 long, doc long, mark long, start long"), "extensions")
    firsts = reached.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    again = hot_join(reached, firsts, ["w1", "w2"], reached.count()).where("doc > first").select(*key, (F.shiftleft("start", 32) + 1).alias("at"))

    runs = found.where(F.col("kind") == REPEATED).select(*key, "at").unionByName(again).groupBy(*key).agg(F.collect_set("at").alias("runs"))
    return dealt.join(runs, key, "left").select("doc_id", "text", "rest", "runs")


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, starts, ends, kept) of each row: the maximal runs of words that windows of ``length`` words cover

    which a document of smaller id has too, and the other words, joined by spaces, as UTF-8.
    A null id is smaller than all others. Rows of one id are one document: none repeats another,
    and equal rows have equal results. A null text has no words; texts of fewer than ``length``
    words lose nothing; an empty table gives no rows. Other columns are left out.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t) for t in batch.column("text").to_pylist()]
            spans = [_spans(r, length) for r in batch.column("runs").to_pylist()]
            starts, ends = (pa.array([[s[i] for s in one] for one in spans], pa.list_(pa.int64())) for i in (0, 1))
            kept = pa.array([_left(w, s) for w, s in zip(words, spans, strict=True)], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), starts, ends, kept], ["doc_id", "n_words", "starts", "ends", "kept"])

    return _joined(docs, doc_id, text, length, seed, []).select("doc_id", "text", "runs").mapInArrow(tell, "doc_id long, n_words long, starts array<long>, ends array<long>, kept binary")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs, the texts that repeated_words finds repeats in as the words that are left; all other texts, null ones too, and all other columns as they are."""

    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if r is None or not len(r) else _left(_words(t), _spans(r.tolist(), length)).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs, strict=True)], dtype=object)

    rest = [c for c in docs.columns if c != text]
    joined = _joined(docs, doc_id, text, length, seed, rest)
    left = F.pandas_udf(cut, "string")(F.col("text"), F.col("runs"))
    return joined.select(*((left if c == text else F.col("rest")[c]).alias(c) for c in docs.columns))
