import json
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.errors import IndexingError, IngestionError
from siltstone.operators import chunking as C
from siltstone.operators import index as I
from siltstone.operators import retrieval as R
from siltstone.sources import corpus as S
from siltstone.sources.pdf import Pdf, Scanner, pdf_pages, shown_text


def pdf(pages, deflate=False):
    out, kids = [b"%PDF-1.4\n"], []
    for i, content in enumerate(pages):
        body = zlib.compress(content) if deflate else content
        head = b"<< /Filter /FlateDecode >>" if deflate else b"<< >>"
        kids.append(10 + 2 * i)
        out.append(b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n%d 0 obj %s stream\n%s\nendstream endobj\n" % (10 + 2 * i, 11 + 2 * i, 11 + 2 * i, head, body))
    refs = b" ".join(b"%d 0 R" % k for k in reversed(kids))
    return b"".join([*out, b"1 0 obj << /Type /Pages /Kids [" + refs + b"] >> endobj\n"])


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf(deflate):
    data = pdf([b"(one) Tj", rb"[(a\)b) -2 <6364>] TJ <65> Tj (x\101\n\q) Tj"], deflate)
    assert pdf_pages(data) == ["xA\nq\ne\na)b\ncd", "one"]
    assert list(Scanner(b"(\\0612 a(b(c))\\)) <48 6> /N [1 (x) 2 0 R] % note\n<< /A << /B 7 >> /C 3 0 R >> 1.5 ")) == ["12 a(b(c)))", "H`", "N", [1, "x", 2], {"A": {"B": 7}, "C": 3}, "1.5"]
    assert shown_text(b"(a) Tj [(b]) (c)] TJ (d) Tj (open") == "a\nd\nb]\nc"
    assert list(Pdf(b"%PDF\n1 0 obj endobj 2 1 obj (x) endobj 3 0 obj (y) endobj 3 0 obj << >> endobj 4 0 obj (z").objects.items()) == [(1, ("endobj", None)), (3, ({}, None))]
    with pytest.raises(IngestionError):
        pdf_pages(b"no")


def test_pdf_without_tree_and_bad_stream(spark):
    flat = b"%PDF\n5 0 obj << /Type /Page /Contents [6 0 R 9 0 R] >> endobj 6 0 obj stream\r\n(hi) Tj\r\nendstream endobj"
    assert pdf_pages(flat) == ["hi\n"]
    loop = b"%PDF\n1 0 obj << /Type /Pages /Kids [1 0 R] >> endobj 2 0 obj << /Type /Page >> endobj"
    assert pdf_pages(loop) == [""]
    bad = flat.replace(b"6 0 obj stream", b"6 0 obj << /Filter /FlateDecode >> stream")
    rows = spark.createDataFrame([("s", "d", "pdf", bad), ("s", "e", "txt", b"\xff"), ("s", "f", "doc", b"x"), ("s", "g", "txt", b" \n"), (" ", "h", "txt", b"x"), ("s", "i", "md", b"# T\r\n\r\n## A\nx")], "seller_id string, document_id string, source_format string, content binary")
    got = {r["document_id"]: r for r in S.parsed(rows, strict=False).collect()}
    assert [bool(got[k]["error"]) for k in "defghi"] == [True] * 5 + [False] and got["i"]["document_name"] == "T" and got["i"]["sections"][0]["section"] == "A"
    with pytest.raises(Exception, match="UTF-8"):
        S.parsed(rows.where("document_id = 'e'")).collect()


def test_one_document(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "a.pdf").write_bytes(pdf([b"(text) Tj"]))
    row = S.ingest_document(spark, "shop", "a", source_format="pdf", path="shop/a.pdf", root=str(tmp_path)).first()
    assert row["text"] == "text" and row["pages"][0]["page"] == 1 and row["source_path"] == "shop/a.pdf"
    assert S.ingest_document(spark, "shop", "b", source_format="md", text="# Hello\nx", version="2").first()["document_name"] == "Hello"
    for bad in ({"text": "x", "content": b"y"}, {}, {"path": "/etc/x"}, {"path": "../x"}, {"path": "other/x"}):
        with pytest.raises(IngestionError):
            S.ingest_document(spark, "shop", "a", source_format="txt", **bad)
    with pytest.raises(IngestionError):
        S.ingest_document(spark, "shop", "a", source_format="doc", text="x")


def catalog(tmp_path, sellers):
    listed = []
    for seller, documents in sellers.items():
        (tmp_path / seller).mkdir(exist_ok=True)
        entries = []
        for name, text in documents.items():
            (tmp_path / seller / f"{name}.md").write_text(text)
            entries.append({"document_id": name, "document_name": name.title(), "policy_type": "p", "version": "1", "format": "markdown", "path": f"{seller}/{name}.md", "created_at": "then", "updated_at": "now"})
        listed.append({"seller_id": seller, "seller_name": seller, "documents": entries})
    (tmp_path / "corpus.json").write_text(json.dumps({"corpus_id": "c", "corpus_version": "1", "created_at": "x", "notes": "", "sellers": listed}))


TEXTS = {"north": {"returns": "# Returns\n## Window — days\nGoods return within thirty days.\n## Fee\nNo fee at all.", "care": "# Care\nWash cold."}, "south": {"returns": "# Returns\n## Window\nGoods return within seven days."}}


def test_corpus_to_answers_by_tenant(spark, tmp_path):
    catalog(tmp_path, TEXTS)
    path = str(tmp_path / "index")
    for seller in TEXTS:
        docs = S.ingest_seller_corpus(spark, seller, root=str(tmp_path))
        assert {r["document_id"] for r in docs.collect()} == set(TEXTS[seller])
        I.index_chunks(spark, path, seller, C.chunk_documents(docs))
    for seller, days in (("north", "thirty"), ("south", "seven")):
        best = R.retrieve_chunks(spark, path, seller, "goods return within how many days", top_k=1).first()
        assert days in best["text"] and best["seller_id"] == seller and best["rank"] == 1 and "embedding" not in best.asDict()
    assert R.retrieve_chunks(spark, path, "nobody", "goods").count() == 0
    listed = I.list_indexed_chunks(spark, path, "north").collect()
    assert [(r["document_id"], r["chunk_position"]) for r in listed] == sorted((r["document_id"], r["chunk_position"]) for r in listed) and len(listed) == 4
    with pytest.raises(IngestionError):
        S.ingest_seller_corpus(spark, "west", root=str(tmp_path))


def chunks(spark, rows):
    return spark.createDataFrame(rows, "seller_id string, document_id string, chunk_position int, text string")


def test_upsert_replace_delete(spark, tmp_path):
    path = str(tmp_path / "index")
    first = chunks(spark, [("a", "d", 0, "coats may go back"), ("a", "d", 1, "shipping abroad"), ("a", "e", 0, "warranty claims")])
    ids = [r["chunk_id"] for r in I.index_chunks(spark, path, "a", first).collect()]
    I.index_chunks(spark, path, "a", first)
    I.index_chunks(spark, path, "b", chunks(spark, [("b", "d", 0, "other tenant")]))
    assert sorted(r["chunk_id"] for r in I.list_indexed_chunks(spark, path, "a").collect()) == sorted(ids)
    I.index_chunks(spark, path, "a", chunks(spark, [("a", "d", 0, "returns changed")]))
    assert I.list_indexed_chunks(spark, path, "a").count() == 4
    I.index_chunks(spark, path, "a", chunks(spark, [("a", "d", 0, "returns changed again")]), replace_documents=True)
    assert I.list_indexed_chunks(spark, path, "a").count() == 2
    I.delete_documents(spark, path, "a", ["d"])
    assert [r["document_id"] for r in I.list_indexed_chunks(spark, path, "a").collect()] == ["e"] and I.list_indexed_chunks(spark, path, "b").count() == 1
    for bad in (chunks(spark, []), chunks(spark, [("a", "x", 0, "fine"), ("b", "x", 0, "foreign")])):
        with pytest.raises(IndexingError):
            I.index_chunks(spark, path, "a", bad)
    with pytest.raises(Exception):
        I.index_chunks(spark, path, "a", chunks(spark, [("a", "x", -1, "negative")]))
    assert I.list_indexed_chunks(spark, path, "a").count() == 1
    with pytest.raises(IndexingError):
        R.retrieve_chunks(spark, path, "a", "x", top_k=0)
    twice = chunks(spark, [("a", "e", 0, "warranty claims")]).crossJoin(spark.createDataFrame([(i,) for i in range(6)], "n int")).withColumn("document_name", F.concat(F.lit("name"), "n"))
    I.index_chunks(spark, path, "a", twice.repartition(4), order="n")
    I.index_chunks(spark, path, "a", chunks(spark, [("a", f"f{i}", 0, "much more") for i in range(30)]))
    stored = {r["document_id"]: json.loads(r["metadata"]) for r in I.list_indexed_chunks(spark, path, "a").collect()}
    assert len(stored) == 31 and stored["e"]["document_name"] == "name5" and "n" not in stored["e"]
    I.delete_documents(spark, path, "a", [f"f{i}" for i in range(30)])
    last = spark.createDataFrame([("a", "e", 0, "warranty claims", f"row{i}") for i in range(4)], "seller_id string, document_id string, chunk_position int, text string, document_name string").coalesce(1)
    I.index_chunks(spark, path, "a", last)
    assert [json.loads(r["metadata"])["document_name"] for r in I.list_indexed_chunks(spark, path, "a").collect()] == ["row3"]
    I.index_chunks(spark, path, "a", chunks(spark, [("a", "z", 0, "two dimensions")]), dimensions=8)
    with pytest.raises(IndexingError):
        R.retrieve_chunks(spark, path, "a", "x")


def test_plan_prunes_other_tenants(spark, tmp_path):
    path = str(tmp_path / "index")
    I.index_chunks(spark, path, "a", chunks(spark, [("a", "d", 0, "x")]))
    plan = I.list_indexed_chunks(spark, path, "a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(seller_id" in plan


def test_batch_equals_single(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = chunks(spark, [("a", f"d{i}", i, f"word{i % 3} common text{i}") for i in range(12)])
    I.index_chunks(spark, path, "a", rows)
    stored = I.list_indexed_chunks(spark, path, "a")
    asked = spark.createDataFrame([("q", "a", "common word1")], "query_id string, seller_id string, text string")
    batch = R.retrieve_batch(stored, asked, question_id="query_id", top_k=4, digits=9).orderBy("rank").collect()
    single = R.retrieve_chunks(spark, path, "a", "common word1", top_k=12).select("chunk_id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "chunk_id").limit(4).collect()
    assert [(r["chunk_id"], r["score"]) for r in batch] == [(r["chunk_id"], r["s"]) for r in single]


def test_stream_reindexes(spark, tmp_path):
    from siltstone.streaming.reindex import reindex

    path, source = str(tmp_path / "index"), str(tmp_path / "in")
    ddl = "seller_id string, document_id string, text string"
    spark.createDataFrame([("a", "d", "old words"), ("b", "d", "other words")], ddl).write.parquet(source)
    stream = lambda: reindex(spark.readStream.schema(ddl).parquet(source), path, str(tmp_path / "at")).awaitTermination()
    stream()
    spark.createDataFrame([("a", "d", "new words")], ddl).write.mode("append").parquet(source)
    stream()
    assert [r["text"] for r in I.list_indexed_chunks(spark, path, "a").collect()] == ["new words"] and I.list_indexed_chunks(spark, path, "b").count() == 1


def test_packed_files_and_catalogs_by_line(spark, tmp_path):
    """Packed files are read like those beside them, in every scope; of a seller on several lines the first entry counts."""
    root = str(tmp_path / "root")
    for path, text in (("a/x/one.md", "one"), ("top.md", "top")):
        (tmp_path / "root" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / path).write_text(text)
    packed = spark.createDataFrame([("a/y/two.md", b"two"), ("b/three.md", b"three"), ("ab/five.md", b"five"), ("low.md", b"low")], "path string, content binary")
    S.pack(packed.where("path not like 'b/%'"), root)
    S.pack(packed.where("path like 'b/%'"), root)
    found = lambda **scope: {r.path.removeprefix(f"file:{root}/"): bytes(r.content).decode() for r in S.files_under(spark, root, **scope).collect()}
    assert found() == {"a/x/one.md": "one", "top.md": "top", "a/y/two.md": "two", "b/three.md": "three", "ab/five.md": "five", "low.md": "low"}
    assert found(seller_id="a", beside=False) == {"a/x/one.md": "one", "a/y/two.md": "two"}
    assert found(seller_id="b") == {"b/three.md": "three", "low.md": "low", "top.md": "top"}
    assert {(r.seller_id, r.document_id, r.text) for r in S.ingest_files(spark, root).collect()} == {("a", "x/one.md", "one"), ("a", "y/two.md", "two"), ("b", "three.md", "three"), ("ab", "five.md", "five")}

    entry = lambda seller, name, *paths: {"seller_id": seller, "seller_name": name, "documents": [{"document_id": p, "path": p, "format": "md"} for p in paths]}
    lines = [{"sellers": [entry("a", "first", "a/x/one.md", "a/y/two.md"), entry("a", "second", "a/gone.md")]}, {"sellers": [entry("b", "b", "b/three.md")]}, {"sellers": [entry("a", "late", "a/gone.md")]}]
    (tmp_path / "root" / "all.json").write_text("\n".join(json.dumps(x) for x in lines))
    assert S.read_catalog(spark, f"{root}/all.json", lines=True).count() == 5
    made = S.ingest_corpus(spark, root=root, catalog="all.json", lines=True)
    assert {(r.seller_id, r.document_id, r.text) for r in made.collect()} == {("a", "a/x/one.md", "one"), ("a", "a/y/two.md", "two"), ("b", "b/three.md", "three")}


def test_ingest_queries_write_few_files(spark, monkeypatch):
    """The documents of a table aren't a file and a folder each: what is written doesn't grow by a file a document."""
    import glob

    from siltstone.plans import entry_points as P

    root = P._files(spark, "/root/testdata/sf0.01")
    assert len(glob.glob(f"{root}/**/*.txt", recursive=True)) == 2
    assert S.files_under(spark, root).count() == 1000


def test_long_literal_is_read_by_runs():
    """Brackets and escapes are met, what lies between is taken at once: 20 MB in seconds."""
    import time

    run = b"x" * 5_000_000
    began = time.perf_counter()
    made = Scanner(b"(" + run + b"(a\\)b)" + run + b"\\101" + run + run + b") Tj").next()
    assert time.perf_counter() - began < 2
    x = run.decode()
    assert made == x + "(a)b)" + x + "A" + x + x


def test_wordless_chunks_are_left_out(spark, tmp_path):
    """Asked for, and not by a pass of their own; the folder that is read is the one that is written."""
    path = str(tmp_path / "index")
    rows = [("a", "d", 0, "coats may go back"), ("a", "d", 1, "???"), ("b", "e", 0, ""), ("b", "e", 1, "warranty")]
    with pytest.raises(Exception):
        I.index_all(spark, path, chunks(spark, rows))
    told = I.index_all(spark, path, chunks(spark, rows), wordless=True)
    I.index_all(spark, path, chunks(spark, [("a", "d", 2, "more"), ("a", "d", 3, "...")]), wordless=True)
    assert sorted((r.document_id, r.chunk_position) for r in told.collect()) == [("d", 0), ("e", 1)]
    assert sorted((r.document_id, r.chunk_position) for r in I.read_index(spark, path).collect()) == [("d", 0), ("d", 2), ("e", 1)]
    assert not list(tmp_path.glob("*-staged-*"))
