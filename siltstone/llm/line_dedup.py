"""Line dedup over range-partitioned hashes, answered by keep bitmaps instead of text.

Each document sends one row for each distinct long line: the line key's 128-bit hash,
the document and the positions of the line in it. Rows are range-partitioned by (hash,
document) and sorted by hash, then document from the largest down, then position, so
that a pass over a partition meets the document that keeps the line first. A line of a
third of all documents is spread over as many partitions as its rows need; only the
first and last run of a partition may go on in a neighbour, and those leave at most a
few rows and one sum for a small join. What returns to a document is a compressed
bitmap of the lines to keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import FOLD_BYTES, plain_names, small_or_plain, text_or_empty, written

SPACE = " \t\n\v\f\r"
#: A line key of fewer code points is left alone; so is one that fewer documents hold.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Stands for a null document id: smaller than all others.
NO_ID = -(2**63)
#: Runs at partition edges that are broadcast at most: two for each partition.
MOST_EDGES = 100_000

_LINES = "h1 long, h2 long, doc long, mark long, n_lines int, at array<int>"
_FOUND = "kind int, h1 long, h2 long, doc long, mark long, n_lines int, at array<int>, docs long"
_FOUND_ARROW = pa.schema(
    [("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("n_lines", pa.int32()), ("at", pa.list_(pa.int32())), ("docs", pa.int64())]
)
DROP, PENDING, EDGE = 0, 1, 2


def line_key(line: str) -> bytes:
    """The line stripped, A-Z lower-cased, as UTF-8."""
    return line.strip(SPACE).encode("utf-8", "surrogatepass").translate(FOLD_BYTES)


def _long_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs, marks, counts, places = bytearray(), [], [], [], []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text")), strict=True):
                found: dict[bytes, list[int]] = {}
                lines = text.split("\n")
                for i, line in enumerate(lines):
                    if len(line) >= least_chars and len(line.strip(SPACE)) >= least_chars:
                        found.setdefault(xxhash.xxh3_128_digest(line_key(line)), []).append(i)
                for h, at in found.items():
                    hashes += h
                    docs.append(doc)
                    marks.append(mark)
                    counts.append(len(lines))
                    places.append(at)
            two = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(counts, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                ["h1", "h2", "doc", "mark", "n_lines", "at"],
            )

    return run


class _Run:
    """The rows of one line key, met from the largest document down."""

    def __init__(self, key: tuple[int, int], first: bool):
        self.key, self.first = key, first
        self.docs, self.top, self.last = 0, 0, None
        self.held: list[tuple] = []
        self.tops: list[tuple] = []

    def feed(self, row: tuple, least_docs: int, drops: list[tuple]) -> None:
        doc = row[2]
        if doc != self.last or not self.docs:
            self.docs += 1
            self.last = doc
            if self.docs == 1:
                self.top = doc
            if self.docs == least_docs:
                drops += self.held
                self.held = []
        if doc == self.top:
            self.tops.append(row)
        elif self.docs >= least_docs:
            drops.append(row)
        else:
            self.held.append(row)

    def edge(self) -> list[tuple]:
        rows = [(PENDING, *r, None) for r in [*self.held, *(self.tops if self.first else [])]]
        return [*rows, (EDGE, *self.key, self.top, None, None, None, self.docs)]


def _stream(least_docs: int):
    """Decide every run of a sorted partition; the first and the last, if still open, leave their rest and a sum."""

    def tell(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(_FOUND_ARROW)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Run | None = None
        began = False
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            cuts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.concatenate([cuts, [len(h1)]])
            wanted = (ends - starts > 1) | (starts == 0) | (ends == len(h1))
            drops, told = [], []
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                key = (int(h1[a]), int(h2[a]))
                if now is None or now.key != key:
                    if now is not None and now.first:
                        told += now.edge()
                    now = _Run(key, not began)
                    began = True
                part = batch.slice(a, b - a)
                for row in zip(*(part.column(c).to_pylist() for c in range(6)), strict=True):
                    now.feed(row, least_docs, drops)
            yield tell([(DROP, *r, None) for r in drops] + told)
        if now is not None:
            yield tell(now.edge())

    return run


def _bitmap(n_lines: int, dropped: np.ndarray) -> tuple[int, bytes]:
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return int(n_lines - keep.sum()), zlib.compress(np.packbits(keep).tobytes(), 6)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, mark, n_lines, n_dropped, keep) for the documents that lose lines; all others keep every line.

    doc is the id (NO_ID for null) and mark the text's hash: together they name a document, so
    that repeated rows share a bitmap, and different texts of one id have their own but count as
    one document. keep is a zlib-compressed bitmap, first line at the highest bit. A null text is
    empty: one empty line. Nothing is dropped from an empty table.
    """
    named = docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_or_empty(docs, text)).alias("mark"), text_or_empty(docs, text).alias("text")
    )
    # written first: to find the ranges' borders the rows are read twice
    lines = written(named.mapInArrow(_long_lines(least_chars), _LINES), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, F.col("at"))
    found = written(dealt.mapInArrow(_stream(least_docs), _FOUND), "runs")

    edges = found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("top"))
    edges = small_or_plain(edges.where(F.col("all_docs") >= least_docs), MOST_EDGES)
    wide = ["doc", "mark", "n_lines", "at"]
    late = found.where(F.col("kind") == PENDING).join(edges, ["h1", "h2"]).where("doc <> top").select(*wide)
    drops = found.where(F.col("kind") == DROP).select(*wide).unionByName(late).distinct()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_bitmap(n, at) for n, at in zip(b["n_lines"], b["at"], strict=True)]
            yield b[["doc", "mark", "n_lines"]].assign(n_dropped=[m[0] for m in made], keep=[m[1] for m in made])

    each = drops.groupBy("doc", "mark", "n_lines").agg(F.flatten(F.collect_list("at")).alias("at"))
    return each.mapInPandas(pack, "doc long, mark long, n_lines int, n_dropped int, keep binary")


def kept_lines(text: str, keep: bytes) -> tuple[str, int, int]:
    """The text that a bitmap leaves, its lines before, and how many it loses."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(x for x, b in zip(lines, bits.tolist(), strict=True) if b), len(lines), int(len(lines) - bits.sum())


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cut to the kept lines, and __n_lines, __n_dropped in place of columns of these names; other columns and all rows as they are.

    A text that loses nothing, null too, is returned unchanged.
    """
    docs, (doc_id, text), back = plain_names(docs.drop("__n_lines", "__n_dropped"), doc_id, text)
    keep = bitmaps.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("keep").alias("__keep"))
    joined = docs.join(
        keep, (F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)) == keep["__doc"]) & (F.xxhash64(text_or_empty(docs, text)) == keep["__mark"]), "left"
    ).select(*(docs[c] for c in docs.columns), "__keep")
    # only texts that lose lines go to Python, and come back
    kept = F.col("__keep").isNull()
    done = joined.withColumn("__cut", F.pandas_udf(_cut, "text string, n_lines long, n_dropped long")(F.when(~kept, F.coalesce(F.col(text), F.lit(""))), F.col("__keep")))
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return back(
        done.select(
            *((F.when(kept, F.col(text)).otherwise(F.col("__cut.text")).alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns),
            F.when(kept, lines.cast("long")).otherwise(F.col("__cut.n_lines")).alias("__n_lines"),
            F.when(kept, F.lit(0).cast("long")).otherwise(F.col("__cut.n_dropped")).alias("__n_dropped"),
        )
    )


def _cut(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
    made = [(None, None, None) if k is None else kept_lines(t, k) for t, k in zip(texts, keeps, strict=True)]
    return pd.DataFrame(made, columns=["text", "n_lines", "n_dropped"])


def dedupe_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the long lines that many documents hold, except in the largest id that holds them."""
    docs, (doc_id, text), back = plain_names(docs, doc_id, text)
    cut = apply_bitmaps(docs, keep_bitmaps(docs, doc_id, text, least_chars, least_docs), doc_id, text)
    return back(cut.drop("__n_lines", "__n_dropped"))


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with its column of text lengths, if it has one, set to the texts' code points."""
    if length not in docs.columns:
        return docs
    kind = docs.schema[length].dataType
    return docs.withColumn(length, F.length(text).cast(kind))
