"""Suffix dedup: bytes that a LENGTH-byte string which also starts earlier covers, by merging shard Burrows-Wheeler transforms.

Strings of LENGTH bytes can only be equal if they agree in their anchor, the least hash
among their GRAM-byte pieces. Neighbouring strings share an anchor, and what they cover
together is a fragment. Fragments meet by anchor. Equal fragments are one class, of
which only the earliest counts; anchors with a single fragment have no repeats. Only
where an anchor has several different fragments (at the edges of repeats) are suffixes
compared: fragments are dealt to shards, each shard's transform is built over symbols
of SYMBOL bytes, and transforms are merged by refining their interleave symbol by
symbol (Holt and McMillan, 2014) until it is stable. The refinement's blocks at depth
LENGTH / SYMBOL are the intervals of equal strings; no merged suffix is sorted again.

A piece that many different fragments would have as their anchor (a ruled line between
paragraphs) is hot: it is taken only where a string has no other piece, and then the whole
string is the anchor. So no anchor gathers more fragments than one task can hold. Which
pieces are hot is found on a sample, as it decides on the way, never on the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import mixed, text_or_empty, written
from siltstone.llm.line_dedup import NO_ID

LENGTH, GRAM, SYMBOL = 100, 32, 25
#: Starts of a string's pieces; suffixes of a shard; suffixes merged at once; bytes hashed at once.
PLACES, SHARD, MOST, CHUNK = LENGTH - GRAM + 1, 1 << 14, 56_000, 2 << 20
#: A piece is hot from about so many different fragments on, counted in one of SAMPLE documents; hot pieces at most; rounds of looking for them.
HOT, SAMPLE, MOST_HOT, ROUNDS = 4_096, 32, 100_000, 3
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
REMOVED, FRAGMENT = 0, 1

_FOUND = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("f", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])
_FOUND_DDL = "kind int, h long, f long, doc long, at long"


class Rolling:
    """Hashes of any stretch of bytes from running sums."""

    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, data: np.ndarray):
        if len(data) + 1 > len(self._powers[0]):
            n = max(len(data) + 1, 1 << 16)
            for i, b in enumerate((_BASE, _BACK)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                self._powers[i] = np.multiply.accumulate(steps)
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[1][: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * self._powers[0][starts])

    def all_of(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[: n]) * self._powers[0][:n])


_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _least(order: np.ndarray) -> np.ndarray:
    """The position of the least of every PLACES neighbours; order holds positions in its low half."""
    least, width = order, 1
    while width * 2 <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :]) & _LOW).astype(np.int64)


class Hot:
    """A set of pieces' hashes, with a table of their low bits that most other hashes don't pass."""

    def __init__(self, hashes: Iterable[int] = ()):
        self.hashes = np.unique(np.array(hashes, np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & self._low).astype(np.int64)] = True

    _low = np.uint64((1 << 20) - 1)

    def __len__(self) -> int:
        return len(self.hashes)

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        if len(self.hashes):
            some = np.flatnonzero(self.bits[(x & self._low).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, x[some]), len(self.hashes) - 1)
            out[some] = self.hashes[at] == x[some]
        return out


def fragments(texts: list[bytes], hot: Hot | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, count, anchor hash, content hash) of every run of strings with one anchor.

    A run's strings start at start .. start + count - 1, and cover count + LENGTH - 1 bytes.
    hot: the pieces that are anchors only of strings without another piece; such a string is a
    run by itself, and its content its anchor.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < LENGTH:
        return none
    rolling = Rolling(data)
    grams = rolling.all_of(GRAM)
    # the hash's high half, then the position: the leftmost of equal pieces is least
    order = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    anchor = _least(order)
    single = np.zeros(len(anchor), bool)
    if hot and hot.has(grams[anchor[np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))]]).any():
        order[hot.has(grams)] |= _HIGH
        anchor = _least(order)
        single = hot.has(grams[anchor])
    left = np.full(len(anchor), -1, np.int64)  # the text of each string, -1 for those over two texts
    for i, (a, n) in enumerate(zip(begins[:-1].tolist(), lengths.tolist(), strict=True)):
        if n >= LENGTH:
            left[a : a + n - LENGTH + 1] = i
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | single[1:] | single[:-1]])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(anchor)))
    starts, counts = starts[left[starts] >= 0], counts[left[starts] >= 0]
    text = left[starts]
    content = mixed(rolling.of(starts, counts + LENGTH - 1) + counts.astype(np.uint64))
    return text, starts - begins[text], counts, np.where(single[starts], content, grams[anchor[starts]]), content


def _pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return start << 32 | count


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 32, at & 0xFFFFFFFF


def _together(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of strings, those that follow each other in one document as one."""
    order = np.lexsort((at, doc))
    doc, (start, count) = doc[order], _unpack(at[order])
    if not len(doc):
        return doc, at
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])]))
    return doc[fresh], _pack(start[fresh], np.add.reduceat(count, fresh))


def _rows(kind: int, h: np.ndarray | None, f: np.ndarray | None, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; hashes that nothing needs any more are 0, which takes no room."""
    h, f = (np.zeros(len(doc), np.int64) if x is None else x for x in (h, f))
    return pa.record_batch([pa.array(np.full(len(doc), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(doc), pa.array(at)], schema=_FOUND)


def _chunks(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[tuple[np.ndarray, ...]]:
    """(h, f, doc, at, first, texts by doc) of the fragments of about CHUNK bytes of documents, sorted; first: of equal ones the earliest."""
    for batch in batches:
        docs, texts = batch.column("doc").to_numpy(), [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
                size += len(texts[b])
                b += 1
            text, start, count, h, f = fragments(texts[a:b], hot)
            doc, at = docs[a:b][text], _pack(start, count)
            order = np.lexsort((at, doc, f, h))
            h, f, doc, at = h[order], f[order], doc[order], at[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])]) if len(h) else np.zeros(0, bool)
            yield h, f, doc, at, first, dict(zip(docs[a:b].tolist(), texts[a:b], strict=True))
            a = b


def _cut(sent):
    """Fragments of the documents. Of equal fragments of one chunk only the earliest goes on; the others are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, f, doc, at, first, _ in _chunks(batches, sent.value):
            yield _rows(FRAGMENT, h[first], f[first], doc[first], at[first])
            gone, where = _together(doc[~first], at[~first])
            yield _rows(REMOVED, mixed(gone.view(np.uint64)), None, gone, where)

    return run


def hot_pieces(texts: DataFrame) -> Hot:
    """The pieces that would be the anchor of about HOT different fragments or more, MOST_HOT at most; texts: doc, text.

    Where a piece is such an anchor, the pieces around it that are as common are hot too, or
    one of them would take its place.
    """
    spark = texts.sparkSession
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    hot = Hot()

    def common(rows: DataFrame) -> np.ndarray:
        found = rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLE >= HOT).orderBy(F.desc("n"), "h").limit(MOST_HOT - len(hot))
        return found.select("h").toArrow().column("h").to_numpy().view(np.uint64)

    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(hot)

        def anchors(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for h, f, _, _, first, _ in _chunks(batches, sent.value):
                first = first & (h != f)
                yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(f[first].view(np.int64))], ["h", "f"])

        found = common(some.mapInArrow(anchors, "h long, f long").distinct().withColumn("n", F.lit(1)))
        if not len(found):
            break
        crowded = spark.sparkContext.broadcast((hot, Hot(found)))

        def around(batches: Iterator[pa.RecordBatch], crowded=crowded) -> Iterator[pa.RecordBatch]:
            hot, now = crowded.value
            for h, _, doc, at, first, own in _chunks(batches, hot):
                rows = np.flatnonzero(first & now.has(h))
                if not len(rows):
                    continue
                start, count = _unpack(at[rows])
                parts = [own[d][a : a + n + LENGTH - 1] for d, a, n in zip(doc[rows].tolist(), start.tolist(), count.tolist(), strict=True)]
                ends = np.cumsum([len(x) for x in parts])
                grams = Rolling(np.frombuffer(b"".join(parts), np.uint8)).all_of(GRAM)
                over = np.zeros(len(grams) + GRAM, np.int64)  # pieces that reach over the end of a fragment don't count
                for e in ends[:-1].tolist():
                    over[max(0, e - GRAM + 1) : e] = 1
                value, n = np.unique(grams[over[: len(grams)] == 0], return_counts=True)
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n)], ["h", "n"])

        near = common(some.mapInArrow(around, "h long, n long"))
        sent.unpersist()
        crowded.unpersist()
        hot = Hot(np.concatenate([hot.hashes, found, near]))
    return hot


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h, f, doc, at): later fragments of a class are removed, and the first ones of anchors with several classes go on."""
    last, several = (None, None), None  # the class of the last row; the last anchor, if it is known to have several
    wait = tuple(np.zeros(0, np.int64) for _ in range(3))  # the first class of the last anchor, as long as it has no other
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, h, f, doc, at = (batch.column(c).to_numpy() for c in _FOUND.names)
        done = kind == REMOVED
        yield _rows(REMOVED, None, None, doc[done], at[done])
        h, f, doc, at = (x[~done] for x in (h, f, doc, at))
        if not len(h):
            continue
        new = np.concatenate([[last != (h[0], f[0])], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])
        last = (h[-1], f[-1])
        yield _rows(REMOVED, None, None, *_together(doc[~new], at[~new]))
        h, doc, at = (np.concatenate([x, y[new]]) for x, y in zip(wait, (h, doc, at), strict=True))
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        go = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (h == several if several is not None else False)
        yield _rows(FRAGMENT, h[go], None, doc[go], at[go])
        several = h[-1] if go[-1] else None
        wait = tuple(x[-1:] if not go[-1] else x[:0] for x in (h, doc, at))


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in 16 bits if it fits: those are sorted by radix."""
    return x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x


class Transform:
    """The Burrows-Wheeler transform of strings of symbols, with the suffix that each row is.

    Symbols are from 1; 0 before a string's first suffix. Rows of empty suffixes come first.
    """

    def __init__(self, bwt: np.ndarray, suffix: np.ndarray, empty: int):
        self.bwt, self.suffix, self.empty = bwt, suffix, empty

    @classmethod
    def of(cls, symbol: np.ndarray, suffix: np.ndarray, following: np.ndarray, before: np.ndarray) -> Transform:
        """symbol: of each suffix, 0 if it is empty; following: index of the suffix one symbol on; before: the symbol before."""
        rank = _narrow(symbol)
        groups = 0
        while True:  # prefix doubling over this shard alone
            then = rank[following]
            order = np.argsort(then, kind="stable")
            order = order[np.argsort(rank[order], kind="stable")]
            x, y = rank[order], then[order]
            new = np.concatenate([[0], np.cumsum((x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
            rank = np.empty(len(order), np.int64)
            rank[order] = new
            rank, following = _narrow(rank), following[following]
            if new[-1] == groups:
                break
            groups = new[-1]
        order = np.argsort(rank, kind="stable")
        return cls(before[order], suffix[order], int((symbol == 0).sum()))


def refine(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The merged transform, and for each of its rows the block of rows that agree in ``depth`` symbols.

    One round takes the rows in the order so far and deals them, stably, by the symbol before
    them: then rows agree with the merged order in one symbol more. Ends when nothing moves.
    """
    both = _narrow(np.concatenate([a.bwt, b.bwt]))
    na, n = len(a.bwt), len(both)
    head = np.concatenate([np.zeros(a.empty, np.int8), np.ones(b.empty, np.int8)])
    side = np.concatenate([np.zeros(na, np.int8), np.ones(n - na, np.int8)])
    block, told = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rounds = 0
    while True:
        place = np.empty(n, np.int64)  # of each row in the order so far: the next of its own transform
        place[side == 0] = np.arange(na)
        place[side == 1] = np.arange(na, n)
        symbol = both[place]
        real = np.flatnonzero(symbol > 0)
        order = real[np.argsort(symbol[real], kind="stable")]
        moved = np.concatenate([head, side[order]])
        s, k = symbol[order], block[order]
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])]) if len(order) else np.zeros(0, bool)
        block = np.concatenate([np.zeros(len(head), np.int64), np.cumsum(fresh)])
        rounds += 1
        if rounds == depth:
            told, told_side = block, moved
        if rounds >= depth and (moved == side).all():
            break
        side = moved
    place = np.empty(n, np.int64)
    place[side == 0] = np.arange(na)
    place[side == 1] = np.arange(na, n)
    suffix = np.concatenate([a.suffix, b.suffix])
    merged = Transform(both[place], suffix[place], a.empty + b.empty)
    # blocks of a coarser order: rows keep their block when rows within a block move
    at_depth = np.empty(n, np.int64)
    early = np.empty(n, np.int64)
    early[told_side == 0] = np.arange(na)
    early[told_side == 1] = np.arange(na, n)
    at_depth[early] = told
    return merged, at_depth[place]


def _names(rolling: Rolling, at: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the SYMBOL bytes at each place, equal for equal bytes only: hashes sort them, the bytes are compared."""
    names = np.unique(rolling.of(at, SYMBOL), return_inverse=True)[1] + 1
    order = np.argsort(names, kind="stable")
    symbols = np.lib.stride_tricks.sliding_window_view(rolling.data, SYMBOL)
    then, now = order[:-1], order[1:]
    equal = names[then] == names[now]
    if (symbols[at[then[equal]]] != symbols[at[now[equal]]]).any():  # two symbols of one hash
        names = np.unique(np.ascontiguousarray(symbols[at]).view(np.dtype((np.void, SYMBOL)))[:, 0], return_inverse=True)[1] + 1
    return names


def repeated(pieces: list[bytes], counts: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each string (the first counts[i] of piece i, in order) also starts earlier in one of the pieces."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    rolling = Rolling(np.frombuffer(b"".join(pieces), np.uint8))
    # a suffix for each byte of a piece, and empty ones: SYMBOL more after its last whole symbol
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    offset = np.arange(len(piece)) - first[piece]
    whole = offset + SYMBOL <= lengths[piece]
    names = np.zeros(len(piece), np.int64)
    names[whole] = _names(rolling, begins[piece[whole]] + offset[whole])
    following = np.where(whole, np.arange(len(piece)) + SYMBOL, np.arange(len(piece)))
    before = np.where(offset >= SYMBOL, names[np.maximum(np.arange(len(piece)) - SYMBOL, 0)], 0)
    # the suffixes within SYMBOL of the end begin no whole symbol; each ends one string
    used = whole | (offset >= SYMBOL)
    shard = np.cumsum(lengths + 1) // SHARD
    transforms = []
    for s in np.unique(shard).tolist():
        mine = np.flatnonzero(used & (shard[piece] == s))
        local = np.full(len(piece), 0, np.int64)
        local[mine] = np.arange(len(mine))
        transforms.append(Transform.of(names[mine], mine, local[following[mine]], before[mine]))
    depth = LENGTH // SYMBOL
    if len(transforms) == 1:
        transforms.append(Transform(np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
    while True:
        pairs = [refine(x, y, depth) for x, y in zip(transforms[::2], transforms[1::2], strict=False)]
        rest = transforms[len(pairs) * 2 :]
        transforms = [*(p[0] for p in pairs), *rest]
        if len(transforms) == 1:
            break
    block = np.empty(len(piece), np.int64)
    block[transforms[0].suffix] = pairs[0][1]
    string = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
    where = np.repeat(starts, counts) + offset[string]
    doc, kind = np.repeat(docs, counts), block[string]
    order = np.lexsort((where, doc, kind))
    later = np.concatenate([[False], kind[order][1:] == kind[order][:-1]]) if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order[later]] = True
    return out


_PIECES = "h long, doc long, start long, count int, piece binary"
#: Strings whose anchor is fewer bytes after their start share the CORE bytes from the anchor on; the others those that end with it.
HALF = PLACES // 2 + 1
CORE = LENGTH - HALF + 1


def halves(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, pieces: list[bytes]) -> tuple[list[int], ...]:
    """(key, index, start, count, piece): fragments cut in two, by where in its strings the anchor is, with longer anchors.

    A common anchor has many different surroundings. What all strings of a half share is
    over twice as long, so that few other fragments have it.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    rolling = Rolling(np.frombuffer(b"".join(pieces), np.uint8))
    place = begins[:, None] + np.minimum(np.arange(PLACES)[None, :], (lengths - GRAM)[:, None])
    anchor = (rolling.of(place, GRAM) == h.view(np.uint64)[:, None]).argmax(axis=1)  # the leftmost
    out: tuple[list, ...] = ([], [], [], [], [])
    cut = np.clip(anchor - HALF + 1, 0, counts)  # strings before it have their anchor far from their start
    near = np.flatnonzero(cut < counts)
    far = np.flatnonzero(cut > 0)
    keys = (mixed(rolling.of((begins + anchor)[near], CORE) + np.uint64(1)), mixed(rolling.of((begins + anchor)[far] - HALF, HALF + GRAM) + np.uint64(2)))
    for which, key, low, high in ((near, keys[0], cut, counts), (far, keys[1], np.zeros_like(cut), cut)):
        for i, k in zip(which.tolist(), key.view(np.int64).tolist(), strict=True):
            a, b = int(low[i]), int(high[i])
            for column, value in zip(out, (k, i, int(starts[i]) + a, b - a, pieces[i][a : b + LENGTH - 1]), strict=True):
                column.append(value)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of halved fragments, from (doc, text, list of (h, at))."""
    for batch in batches:
        h, docs, ats, found = [], [], [], []
        for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wanted")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                start, count = w["at"] >> 32, w["at"] & 0xFFFFFFFF
                h.append(w["h"])
                docs.append(doc)
                ats.append(w["at"])
                found.append(data[start : start + count + LENGTH - 1])
        for a in range(0, len(h), 4096):
            part = slice(a, a + 4096)
            starts, counts = _unpack(np.array(ats[part], np.int64))
            key, at, start, count, piece = halves(np.array(h[part], np.int64), starts, counts, found[part])
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array([docs[a + i] for i in at], pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int32()), pa.array(piece, pa.binary())], ["h", "doc", "start", "count", "piece"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by anchor: (doc, start, end) of the strings that start earlier too, whole anchors at a time."""

    def tell(rows: pa.Table) -> pa.RecordBatch:
        doc, start, count = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "count"))
        gone = repeated(rows.column("piece").to_pylist(), count, doc, start)
        where = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
        row = np.repeat(np.arange(len(doc)), count)
        x, y = where[gone], row[gone]
        new = np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 0)]) if len(x) else np.zeros(0, bool)
        last = np.concatenate([new[1:], [True]]) if len(x) else new
        return pa.record_batch([pa.array(doc[y[new]]), pa.array(x[new]), pa.array(x[last] + LENGTH)], ["doc", "start", "end"])

    held: list[pa.RecordBatch] = []
    size, last, alone = 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        cuts = (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and h[a] != last:
                if alone:  # a key with one fragment has no repeats
                    held.pop()
                    size -= LENGTH + HALF
                if size >= MOST:
                    yield tell(pa.Table.from_batches(held))
                    held, size = [], 0
            alone = b - a == 1 and h[a] != last
            held.append(batch.slice(a, b - a))
            size += (b - a) * (LENGTH + HALF)
            last = h[a]
    if held:
        yield tell(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *(x for s in merged for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), [s[0] for s in merged], [s[1] for s in merged], kept))
        n, a, b, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, doc, text): doc orders the rows by id; rows of one id by their texts' hashes, equal rows with one doc."""
    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    own = named.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    if not _has_repeats(own):
        return own
    marked = own.withColumn("mark", F.xxhash64("text"))
    keys = written(marked.select("doc", "mark").distinct().orderBy("doc", "mark").withColumn("key", F.monotonically_increasing_id()), "keys")
    return marked.join(keys, ["doc", "mark"]).select("doc_id", F.col("key").alias("doc"), "text")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) for each row of docs: the maximal runs of bytes that a LENGTH-byte string which

    starts earlier too covers (in an earlier document, or earlier in the same one), and the
    bytes that are left. Documents are ordered by id, null first; rows that repeat an id and
    text are one document and all get its result; other texts of an id follow by their hash. A
    null text is empty. Texts under LENGTH bytes lose nothing.
    """
    keyed = _keyed(docs, doc_id, text)
    dealt = keyed.repartition("doc")
    repeats = _has_repeats(keyed)
    once = keyed.select("doc", "text").dropDuplicates(["doc"]) if repeats else keyed.select("doc", "text")
    order = ["h", "f", "doc", "at"]
    sent = docs.sparkSession.sparkContext.broadcast(hot_pieces(once.select("doc", "text")))
    found = once.mapInArrow(_cut(sent), _FOUND_DDL).repartition("h").sortWithinPartitions(*order).mapInArrow(_settle, _FOUND_DDL)
    found = written(found, "fragments")

    wanted = found.where(F.col("kind") == FRAGMENT).groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("wanted"))
    # all columns of the dealt texts, though doc_id isn't needed: so that both uses share one exchange
    pieces = (once if repeats else dealt).join(wanted, "doc").mapInArrow(_pieces, _PIECES)
    merged = pieces.repartition("h").sortWithinPartitions("h", "doc", "start").mapInArrow(_merge, "doc long, start long, `end` long")
    start, count = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    settled = found.where(F.col("kind") == REMOVED).select("doc", start.alias("start"), (start + count + LENGTH - 1).alias("end"))
    spans = settled.unionByName(merged).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return dealt.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def _has_repeats(keyed: DataFrame) -> bool:
    return bool(keyed.groupBy("doc").count().where("count > 1").limit(1).count())
