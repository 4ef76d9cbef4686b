"""Document sources: catalog and files of a tenant, single documents, and tables of texts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.errors import IngestionError
from siltstone.functions import text as T
from siltstone.sources import storage
from siltstone.sources.pdf import pdf_pages

FORMATS = ("pdf", "markdown", "txt", "text")
ALIASES = {"md": "markdown"}
#: The error of a document that was read, but is empty or blank.
NO_TEXT = "the document has no text"


def known_format(name: str | None) -> str:
    name = ALIASES.get(name, name)
    if name not in FORMATS:
        raise IngestionError(f"unsupported source_format {name!r}")
    return name


def scope_violation(seller_id: Column, path: Column) -> Column:
    """What is wrong with a seller-scoped path: null if nothing. One part is in scope; of more the first is the seller's."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return (
        F.when(path.isNull() | (F.length(T.strip(path)) == 0), "path is missing")
        .when(path.startswith("/"), "path is absolute")
        .when(F.array_contains(parts, ".."), "path leaves its folder")
        .when((F.size(parts) > 1) & (F.element_at(parts, 1) != seller_id), "path is another seller's")
    )


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The object of a JSON file as one row, or with ``lines`` that of each line; anything but objects of this schema fails."""
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a document, with its seller and place in the catalog; path: a file, or a pattern of several.

    With ``lines`` a file has a catalog on each line, as there are of very many sellers. Its place is the
    file's and, for the line, a number that grows in the file: ``file`` orders them.
    """
    catalogs = read_json(spark, path, schemas.CATALOG, lines)
    file = F.col("_metadata.file_path")
    if lines:  # numbers grow within a part of a file, and parts by where they begin
        number = lambda n: F.lpad(n.cast("string"), 20, "0")
        file = F.concat_ws("#", file, number(F.col("_metadata.file_block_start")), number(F.monotonically_increasing_id()))
    sellers = catalogs.select(file.alias("file"), "sellers").select("file", F.posexplode("sellers").alias("seller_at", "s"))
    return sellers.select("file", "seller_at", "s.seller_id", "s.seller_name", F.posexplode("s.documents").alias("document_at", "d")).select(
        "file", "seller_at", "document_at", "seller_id", "seller_name", "d.*"
    )


_PDF = "text string, pages array<struct<page: int, text: string>>, error string"


def _pdf(contents: pd.Series) -> pd.DataFrame:
    made = []
    for data in contents:
        try:
            made.append(("", [{"page": i, "text": t} for i, t in enumerate(pdf_pages(bytes(data)), 1)], None) if data is not None else ("", [], None))
        except IngestionError as error:
            made.append(("", [], str(error)))
    return pd.DataFrame(made, columns=["text", "pages", "error"])


def parsed(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of schemas.DOCUMENT from rows with seller_id, document_id, source_format, source_path and text or content.

    Optional columns: document_name, policy_type, section, version, created_at, updated_at, and
    scope, which says what is wrong with the row's path (null if nothing). A row with another
    format, with bytes that aren't UTF-8 or no PDF, or without text is an error: strict fails the
    job, else the column ``error`` says what is wrong (null if nothing).
    """
    have = raw.columns
    optional = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    kind = F.coalesce(F.nullif(F.when(F.col("source_format") == "md", "markdown").otherwise(F.col("source_format")), F.lit("")), F.lit("?"))
    content = F.col("content") if "content" in have else F.lit(None).cast("binary")
    given = optional("text")
    is_pdf = kind == "pdf"
    rows = raw.select(
        T.required(F.col("seller_id"), "seller_id", False).alias("seller_id"), T.required(F.col("document_id"), "document_id", False).alias("document_id"),
        *(optional(c).alias(c) for c in ("document_name", "policy_type", "section", "version", "created_at", "updated_at")),
        kind.alias("source_format"), optional("source_path").alias("source_path"), optional("scope").alias("scope"), given.alias("given"), content.alias("content"),
        F.is_valid_utf8(content.cast("string")).alias("utf8"),
    )
    # only PDF rows carry bytes to the Python workers
    rows = rows.withColumn("pdf", F.pandas_udf(_pdf, _PDF)(F.when(is_pdf, F.col("content")))) if "content" in have else rows.withColumn(
        "pdf", F.lit(None).cast(f"struct<text: string, pages: array<{schemas.PAGE}>, error: string>")
    )
    pages = F.transform("pdf.pages", lambda p: F.struct(p["page"].alias("page"), T.clean(p["text"]).alias("text")))
    from_pages = F.array_join(F.filter(F.transform(pages, lambda p: p["text"]), lambda t: t != ""), "\n\n")
    text = T.clean(F.when(F.col("given").isNotNull(), F.col("given")).when(F.col("source_format") == "pdf", from_pages).otherwise(F.col("content").cast("string")))
    error = (
        F.when(F.col("scope").isNotNull(), F.concat_ws(": ", "source_path", "scope"))
        .when(F.col("seller_id").isNull(), "seller_id is required")
        .when(F.col("document_id").isNull(), "document_id is required")
        .when(~F.col("source_format").isin(*FORMATS), F.concat(F.lit("unsupported source_format "), "source_format"))
        .when(F.col("given").isNotNull() == F.col("content").isNotNull(), "either text or content is wanted")
        .when((F.col("source_format") == "pdf") & F.col("given").isNotNull(), "a PDF comes as content")
        .when(F.col("pdf.error").isNotNull(), F.col("pdf.error"))
        .when((F.col("source_format") != "pdf") & F.col("content").isNotNull() & ~F.col("utf8"), "content is not valid UTF-8")
        .when(F.coalesce(F.length("text"), F.lit(0)) == 0, NO_TEXT)
    )
    done = rows.withColumn("text", text).withColumn("pages", F.coalesce(pages, F.array().cast(f"array<{schemas.PAGE}>"))).withColumn("error", error)
    done = done.withColumn("document_name", T.document_name(F.col("document_name"), F.col("text"), F.col("document_id"))).withColumn("sections", T.sections(F.col("text")))
    columns = schemas.DOCUMENT_COLUMNS
    if not strict:
        return done.select(*columns, "error")
    checked = F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat_ws(": ", "document_id", "error")).cast("string"))
    return done.withColumn("text", checked).select(*columns)


def ingest_document(spark: SparkSession, seller_id: str, document_id: str, *, source_format: str, text=None, content=None, path=None, root=".", **described) -> DataFrame:
    """One document, from a text, from bytes, or from a file under root: one row of schemas.DOCUMENT."""
    for name, value in (("seller_id", seller_id), ("document_id", document_id)):
        if not isinstance(value, str) or not value.strip(T.SPACES):
            raise IngestionError(f"{name} is required")
    kind = known_format(source_format)
    if sum(x is not None for x in (text, content, path)) != 1:
        raise IngestionError("one input is wanted: a text, bytes or a path")
    if text is not None and kind == "pdf":
        raise IngestionError("a PDF comes as bytes or a path, not as text")
    if path is not None:
        parts = [p for p in re.split("/", str(path)) if p not in ("", ".")]
        if not str(path).strip() or str(path).startswith("/") or ".." in parts or len(parts) > 1 and parts[0] != seller_id.strip():
            raise IngestionError(f"path {path} is not scoped to {seller_id}")
        content = bytes(spark.read.format("binaryFile").load(f"{root}/{path}").select("content").first()[0])
    unknown = set(described) - {"document_name", "policy_type", "section", "version", "created_at", "updated_at"}
    if unknown:
        raise IngestionError(f"unknown fields {sorted(unknown)}")
    row = {"seller_id": seller_id, "document_id": document_id, "source_format": kind, "source_path": path, "text": text, "content": content, **described}
    ddl = ", ".join(f"{k} {'binary' if k == 'content' else 'string'}" for k in row)
    return parsed(spark.createDataFrame([tuple(row.values())], ddl))


#: The folder under a root that holds many small files as rows of a table. Readers of files pass over names that begin so.
PACKED = "_packed"


def pack(files: DataFrame, root: str) -> None:
    """Add files (path under root, content) as rows of a Parquet table: for more small files than a file system, or the driver that lists them, can bear.

    What reads the files under root reads both kinds alike. A path that is there twice is two files.
    """
    files.select("path", "content").write.mode("append").parquet(f"{root}/{PACKED}")


def files_under(spark: SparkSession, root: str, seller_id: str | None = None, beside: bool = True) -> DataFrame:
    """(path, content) of the files under root, packed ones too, by their full paths: all, or those in a seller's folder and, with ``beside``, in root itself."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = []
    if seller_id is None or storage.exists(spark, f"{root}/{seller_id}"):
        found.append(every.load(root if seller_id is None else f"{root}/{seller_id}").select("path", "content"))
    packed = storage.exists(spark, f"{root}/{PACKED}")
    if seller_id is not None and (beside or not found and not packed):
        found.append(spark.read.format("binaryFile").load(root).select("path", "content"))
    if packed:
        rows = spark.read.schema("path string, content binary").parquet(f"{root}/{PACKED}")
        if seller_id is not None:
            mine = F.startswith("path", F.lit(f"{seller_id}/"))
            rows = rows.where(mine | ~F.contains("path", F.lit("/")) if beside else mine)
        found.append(rows.select(F.concat(F.lit(f"{storage.qualified(spark, root)}/"), "path").alias("path"), "content"))
    return reduce(DataFrame.unionByName, found)


def ingest_files(spark: SparkSession, root: str, *, source_format: str | None = None, strict: bool = True) -> DataFrame:
    """Every file in a seller's folder under root as a document: the folder is the seller, the rest of the path the document's id.

    The format is the name's ending, or ``source_format``. Errors as in ``parsed``.
    """
    files = files_under(spark, root)
    relative = F.substring(F.col("path"), F.lit(len(storage.qualified(spark, root)) + 2), F.length("path"))
    named = files.select(relative.alias("source_path"), "content").where(F.contains("source_path", F.lit("/")))
    ending = F.lower(F.substring_index("source_path", ".", -1))
    return parsed(
        named.select(F.substring_index("source_path", "/", 1).alias("seller_id"), F.regexp_replace("source_path", "^[^/]*/", "").alias("document_id"), "source_path", "content", (F.lit(source_format) if source_format else ending).alias("source_format")), strict
    )


def ingest_corpus(spark: SparkSession, *, root: str, catalog: str = "corpus.json", seller_id: str | None = None, strict: bool = True, lines: bool = False) -> DataFrame:
    """All documents of a catalog, or of one seller: of each seller its first entry, joined with the files under root by path.

    catalog: a path under root, or a pattern of several files, with ``lines`` of a catalog on each line. With strict the first document that
    can't be read, or whose path is out of its seller's scope, fails the job; else its row says
    why in the column ``error`` and all other documents are there.
    """
    listed = read_catalog(spark, f"{root}/{catalog}", lines)
    if lines:  # which lines are numbered how is settled once
        listed = storage.held(listed, "catalog")
    if seller_id is not None:
        listed = listed.where(F.col("seller_id") == seller_id)
    first = listed.groupBy("seller_id").agg(F.min(F.struct("file", "seller_at")).alias("first"))
    listed = listed.join(first, "seller_id").where((F.col("file") == F.col("first.file")) & (F.col("seller_at") == F.col("first.seller_at"))).withColumn("scope", scope_violation(F.col("seller_id"), F.col("path")))
    files = files_under(spark, root, seller_id, beside=seller_id is not None and not listed.where(~F.contains("path", F.lit("/"))).isEmpty())
    full = F.concat(F.lit(f"{storage.qualified(spark, root)}/"), F.col("c.path"))
    joined = listed.alias("c").join(files.alias("f"), F.when(F.col("c.scope").isNull(), full) == F.col("f.path"), "left")
    described = [F.col(f"c.{c}").alias(c) for c in ("seller_id", "document_id", "document_name", "policy_type", "version", "created_at", "updated_at")]
    raw = joined.select(*described, F.col("c.format").alias("source_format"), F.col("c.path").alias("source_path"), "f.content", F.col("c.scope").alias("scope"))
    return parsed(raw, strict)


def ingest_seller_corpus(spark: SparkSession, seller_id: str, *, root: str, catalog: str = "corpus.json", strict: bool = True) -> DataFrame:
    """All documents of a seller, as ``ingest_corpus`` has them; an unknown seller, or one without documents, fails."""
    if read_catalog(spark, f"{root}/{catalog}").where(F.col("seller_id") == seller_id).isEmpty():
        raise IngestionError(f"unknown seller_id {seller_id!r}, or no documents")
    return ingest_corpus(spark, root=root, catalog=catalog, seller_id=seller_id, strict=strict)


def table_documents(docs: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The driver's documents table as tenant documents: source is the seller, doc_id the document, lang the policy type; and columns named in ``more``."""
    return docs.select(
        F.col("source").alias("seller_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("1").alias("version"), F.col("lang").alias("policy_type"), "text", *more
    )
