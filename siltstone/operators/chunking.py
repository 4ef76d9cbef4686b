"""Chunks with positions and offsets: fixed ones in closed form, recursive ones and regions in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import ChunkingError
from siltstone.functions import text as T

SEPARATORS = ("\n\n", "\n", ". ", " ")
_HEADING = re.compile(r"^## ([^\n]+)$", re.MULTILINE)


def checked_config(strategy: str, chunk_size: int, overlap: int, separators: Sequence[str]) -> None:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if strategy not in ("fixed", "recursive"):
        raise ChunkingError(f"unsupported strategy {strategy!r}")
    if not whole(chunk_size) or chunk_size < 1:
        raise ChunkingError("chunk_size counts characters: a whole number from 1")
    if not whole(overlap) or not 0 <= overlap < chunk_size:
        raise ChunkingError("overlap is a whole number from 0, below chunk_size")
    if not isinstance(separators, (tuple, list)) or not separators or not all(isinstance(s, str) and s for s in separators):
        raise ChunkingError("separators are strings, one at least, none of them empty")


def fixed_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of the fixed chunks of a text of this length: 0, size - overlap, ... until one reaches the end."""
    step = size - overlap
    more = F.greatest(F.ceil((length - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), more), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, text: str = "text") -> DataFrame:
    """docs, one row a chunk, the text that of the chunk, with chunk_position, start and end. No Python, no shuffle."""
    checked_config("fixed", size, overlap, SEPARATORS)
    rows = docs.select("*", F.posexplode(fixed_starts(F.length(text), size, overlap)).alias("chunk_position", "start"))
    piece = F.substring(F.col(text), F.col("start") + 1, F.lit(size))
    return rows.withColumn("end", F.least(F.col("start") + size, F.length(text))).withColumn(text, piece)


def recursive_bounds(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[tuple[int, int]]:
    """(start, end): each chunk ends after the last of the first separator that its window has, past the window's start."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            for s in separators:
                at = text.rfind(s, start + 1, end)
                if at >= 0:
                    end = at + len(s)
                    break
        out.append((start, end))
        if end == n:
            break
        start = end - overlap if end - overlap > start else end
    return out


def fixed_bounds(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    starts = range(0, max(n - overlap, 1), size - overlap) if n else ()
    return [(s, min(s + size, n)) for s in starts]


def _in_order(text: str, parts: Sequence[str]) -> list[tuple[int, int]]:
    """Where each part lies in the text, each after the one before."""
    ends = [0]
    for part in parts:
        place = text.find(part, ends[-1])
        if place < 0:
            raise ChunkingError("a page's text isn't in its document, or not in the pages' order")
        ends.append(place + len(part))
    return [(end - len(part), end) for part, end in zip(parts, ends[1:], strict=True)]


def regions(text: str, section: str | None = None, pages: Sequence[dict] = ()) -> list[tuple[int, int, str | None, int | None]]:
    """(start, end, section, page): the pages with text, else what lies between level-two headings, else the whole."""
    with_text = [p for p in pages or () if p and p["text"]]
    if with_text:
        spans = _in_order(text, [p["text"] for p in with_text])
        return [(*span, section, p["page"]) for span, p in zip(spans, with_text, strict=True)]
    names = {m.start(): m[1].split(T.DASH, 1)[0].strip(T.SPACES) for m in _HEADING.finditer(text)}
    cuts = sorted({0, *names})
    return [(a, b, names.get(a, section), None) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def chunk_documents(docs: DataFrame, *, strategy: str = "recursive", chunk_size: int = 1000, overlap: int = 100, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """One row a chunk: the documents' columns without text, sections, pages, section and page, then

    section, page, chunk_position, start, end (code points, end exclusive) and text. docs needs
    seller_id, document_id and text; a row without one of them fails the job. Documents are cut
    where they are read: a narrow step over Arrow batches.
    """
    checked_config(strategy, chunk_size, overlap, separators)
    missing = {"seller_id", "document_id", "text"} - set(docs.columns)
    if missing:
        raise ChunkingError(f"{sorted(missing)[0]} is required")
    # "end" and "start" of an earlier cut are replaced
    made = ("section", "page", "chunk_position", "start", "end", "text")
    kept = [c for c in docs.columns if c not in {*made, "sections", "pages"}]
    section = F.col("section") if "section" in docs.columns else F.lit(None).cast("string")
    pages = F.col("pages") if "pages" in docs.columns else F.lit(None).cast("array<struct<page: int, text: string>>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, columns = [], {c: [] for c in made}
            rows = zip(*(batch.column(c).to_pylist() for c in ("seller_id", "document_id", "__text", "__section", "__pages")), strict=True)
            for row, (seller, document, text, name, page_list) in enumerate(rows):
                for field, value in (("seller_id", seller), ("document_id", document), ("document text", text)):
                    if not value or field != "document text" and not value.strip(T.SPACES):
                        raise ChunkingError(f"{field} is required")
                position = 0
                for start, end, where, page in regions(text, name, page_list):
                    part = text[start:end]
                    bounds = fixed_bounds(len(part), chunk_size, overlap) if strategy == "fixed" else recursive_bounds(part, chunk_size, overlap, separators)
                    for a, b in bounds:
                        source.append(row)
                        for c, v in zip(made, (where, page, position, start + a, start + b, part[a:b]), strict=True):
                            columns[c].append(v)
                        position += 1
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            taken = batch.select(kept).take(pa.array(source, pa.int64()))
            yield pa.record_batch([*taken.columns, *(pa.array(columns[c], t) for c, t in zip(made, types, strict=True))], [*kept, *made])

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "section string, page int, chunk_position int, start int, `end` int, text string"])
    return docs.select(*kept, F.col("text").alias("__text"), section.alias("__section"), pages.alias("__pages")).mapInArrow(cut, ddl)
