import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from siltstone.errors import ChunkingError
from siltstone.functions import embedding as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


TEXTS = ["  \t# Title here \r\nline  \r\rb\x00c \n\n", "", " 　 ", "# A\n## One — more\nx \n## \ny\n## One\nz", "no heading", "#  \nx", "a\x1c\nb\x85\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_clean_title_sections(spark, text):
    flat = text.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
    cleaned = "\n".join(x.rstrip() for x in flat.split("\n")).strip()
    assert one(spark, T.clean(F.col("t")), t=text) == cleaned
    head = re.match(r"# (.+)", cleaned)
    assert one(spark, T.title(F.col("t")), t=cleaned) == ((head[1].strip() or None) if head else None)
    parts = [p.partition("\n") for p in re.split(r"(?m)^## ", cleaned)[1:]]
    named = [(h.split(" — ", 1)[0].strip(), b.strip()) for h, _, b in parts]
    assert [tuple(s) for s in one(spark, T.sections(F.col("t")), t=cleaned)] == [s for s in named if s[0]]
    assert one(spark, T.section_map(F.col("t")), t=cleaned) == dict(named)


def test_sentences_words_points_fences(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One. Two?  Three!\nfour.5 x ") == ["One.", "Two?", "Three!", "four.5 x"]
    assert sorted(one(spark, T.content_words(F.col("t")), t="The Refund of $50 is for 14 days, and the refund")) == ["$50", "days", "refund"]
    assert one(spark, T.point_sentence(F.col("t")), t="Done?!.") == "Done."
    assert one(spark, T.unfenced(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, T.unfenced(F.col("t")), t=" {} ") == "{}"
    assert one(spark, T.lexical_support(F.col("p"), F.col("e")), p="refund within fourteen days", e="a refund takes days") == 0.5
    assert one(spark, T.lexical_support(F.col("p"), F.col("e")), p="of it", e="x") == 0.0


def test_required(spark):
    assert one(spark, T.required(F.col("t"), "t"), t=" a ") == "a"
    assert one(spark, T.required(F.col("t"), "t", strict=False), t=" ") is None
    with pytest.raises(Exception, match="t is required"):
        one(spark, T.required(F.col("t"), "t"), t="\n")


def documents(spark, rows, ddl="seller_id string, document_id string, text string"):
    return spark.createDataFrame(rows, ddl)


def cut(spark, text, **config):
    rows = C.chunk_documents(documents(spark, [("s", "d", text)]), **config).orderBy("chunk_position").collect()
    return [(r["text"], r["start"], r["end"]) for r in rows]


def test_fixed_golden(spark):
    want = [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10)]
    assert cut(spark, "abcdefghij", strategy="fixed", chunk_size=4, overlap=1) == want
    rows = C.fixed_chunks(documents(spark, [("s", "d", "abcdefghij")]), 4, 1).orderBy("chunk_position").collect()
    assert [(r["text"], r["start"], r["end"]) for r in rows] == want


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (7, 3), (50, 0), (1, 0)])
def test_fixed_forms_agree(spark, size, overlap):
    docs = documents(spark, [("s", str(i), "x" * i) for i in range(1, 30)])
    key = lambda r: (r["document_id"], r["chunk_position"], r["start"], r["end"], r["text"])
    assert sorted(map(key, C.fixed_chunks(docs, size, overlap).collect())) == sorted(map(key, C.chunk_documents(docs, strategy="fixed", chunk_size=size, overlap=overlap).collect()))


def test_recursive(spark):
    assert cut(spark, "a\n\n" + "b" * 20, chunk_size=10, overlap=5)[-1][2] == 23
    pieces = cut(spark, "One two. Three four. Five six", chunk_size=12, overlap=0)
    assert [p[0] for p in pieces] == ["One two. ", "Three four. ", "Five six"]


def test_sections_and_pages(spark):
    text = "# T\nintro\n## Returns — how\nbody\n## Fees\nmore"
    rows = C.chunk_documents(documents(spark, [("s", "d", text)])).orderBy("chunk_position").collect()
    assert [r["section"] for r in rows] == [None, "Returns", "Fees"] and all(text[r["start"] : r["end"]] == r["text"] for r in rows)
    ddl = "seller_id string, document_id string, text string, section string, pages array<struct<page: int, text: string>>, extra int"
    rows = C.chunk_documents(documents(spark, [("s", "d", "first page\n\nsecond one", "S", [(1, "first page"), (2, ""), (3, "second one")], 7)], ddl), chunk_size=8, overlap=0).collect()
    assert {r["page"] for r in rows} == {1, 3} and {r["section"] for r in rows} == {"S"} and {r["extra"] for r in rows} == {7}
    assert sorted(r["chunk_position"] for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("config", [{"strategy": "semantic"}, {"chunk_size": 0}, {"chunk_size": True}, {"chunk_size": 5, "overlap": 5}, {"overlap": -1}, {"separators": ()}, {"separators": ("",)}])
def test_bad_configs(spark, config):
    with pytest.raises(ChunkingError):
        C.chunk_documents(documents(spark, [("s", "d", "x")]), **config)


def test_bad_documents(spark):
    with pytest.raises(ChunkingError):
        C.chunk_documents(spark.createDataFrame([("d", "x")], "document_id string, text string"))
    for row in [(None, "d", "x"), (" ", "d", "x"), ("s", "d", "")]:
        with pytest.raises(Exception, match="is required"):
            C.chunk_documents(documents(spark, [row])).collect()


def test_embedding(spark):
    def own(text, d):
        v = [0.0] * d
        for token in re.findall(r"\w+", text.casefold()):
            h = hashlib.blake2b(token.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "big") % d] += 1 if h[4] & 1 else -1
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    for text in ("Refunds, refunds and straße_2 ²", "ΣΊΣΥΦΟΣ İ x"):
        assert E.embed_text(text, dimensions=32) == pytest.approx(own(text, 32))
    for bad in ("", " ", "..."):
        with pytest.raises(ValueError):
            E.embed_text(bad)
    for d in (0, True, 1.5):
        with pytest.raises(ValueError):
            E.embed_text("x", dimensions=d)
    rows = E.embed(spark.createDataFrame([("a b",), ("...",)], "text string"), strict=False).collect()
    assert rows[0]["embedding"] == pytest.approx(own("a b", 256)) and rows[1]["embedding"] is None


@pytest.mark.parametrize("text", ['plain "quoted" \\ \n\t', "ümlaut 😀  "])
def test_chunk_id(spark, text):
    values = {"chunk_position": 3, "document_id": "d", "end": 9, "seller_id": "s", "start": 2, "text": text, "version": None}
    c = {k: F.lit(v).cast("string" if isinstance(v, (str, type(None))) else "int") for k, v in values.items()}
    want = hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert spark.range(1).select(E.chunk_id(c)).first()[0] == want


def test_section_map_of_very_many_sections(spark):
    """A repeated name's last text counts, names stay in the order they came in, and a text of thousands of sections takes seconds."""
    import time

    parts = [(f"N{i % 3000}" if i % 7 else "", f"t{i}") for i in range(6000)]
    text = "x\n" + "\n".join(f"## {name}\n{body}" for name, body in parts)
    began = time.perf_counter()
    made = spark.createDataFrame([(text,), ("no sections",), (None,)], "text string").select(F.map_entries(T.section_map(F.col("text"))).alias("m")).collect()
    assert time.perf_counter() - began < 20
    assert list(map(tuple, made[0].m)) == list(dict(parts).items())
    assert made[1].m == [] and made[2].m is None


def test_chunk_id_takes_no_python(spark, capsys):
    """JSON of any script is escaped by expressions; what Python's json makes is what comes out."""
    import hashlib
    import json

    texts = ["plain", "gr\u00fc\u00df\n\u2028", "\U0001f600 x", "back\\u00FFslash \\\\ \"q\"", "\x0b\x1f\x01 \x7f \u00e9", "\t\u4e00/"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_position int, text string")
    c = {n: F.col(n) for n in ("chunk_position", "text")} | {"document_id": F.lit("d"), "end": F.lit(2), "seller_id": F.lit("s"), "start": F.lit(1), "version": F.lit(None).cast("string")}
    made = rows.select("chunk_position", E.chunk_id(c).alias("id"))
    made.explain()
    assert "Python" not in capsys.readouterr().out
    identity = lambda i, t: {"chunk_position": i, "document_id": "d", "end": 2, "seller_id": "s", "start": 1, "text": t, "version": None}
    assert dict(made.collect()) == {i: hashlib.sha256(json.dumps(identity(i, t), sort_keys=True, separators=(",", ":")).encode()).hexdigest() for i, t in enumerate(texts)}


def test_vectors_are_made_a_slice_at_a_time(spark):
    """However many rows a batch has: a worker holds the vectors of a few hundred, and nulls stay in their places."""
    rows = spark.range(2500).selectExpr("id", "if(id % 3 = 0, '???', concat('word', id)) text").coalesce(1)
    sizes = E.embed(rows, strict=False).select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n")).orderBy("id").collect()
    assert [r.n for r in sizes] == [None if r.id % 3 == 0 else 256 for r in sizes]
    assert [r.id for r in E.with_vector(rows).orderBy("id").collect()] == [i for i in range(2500) if i % 3]
    import pyarrow as pa

    assert max(b.num_rows for b in E._slices(iter([pa.record_batch([pa.array(range(10_000))], ["x"])]))) <= 500


def test_a_slice_has_the_vectors_of_its_texts(spark, monkeypatch):
    """Texts are summed together, in parts by their tokens, as each by itself; words of ASCII need no pattern, and places are forgotten in two steps."""
    every = "".join(f"a{chr(c)}B{chr(c)} " for c in range(0x2100))
    assert all(E.words(t) == E._TOKEN.findall(t.casefold()) for t in (every, every[: 5 * 128], "", "_ x__9\x1c\x0by"))
    monkeypatch.setattr(E, "_TOKENS", 7)
    monkeypatch.setattr(E, "_REMEMBERED", 3)
    texts = [None, "one two two", "???", "grüß an alle " * 9, *(f"w{i} w{i % 5} of" for i in range(40)), ""]
    for dimensions in (3, 256):
        embedder = E.Embedder(dimensions)
        found, good = embedder.directions(texts)
        for text, row, has in zip(texts, found, good, strict=True):
            plain = [0] * dimensions
            for token in E._TOKEN.findall((text or "").casefold()):
                place, sign = E.place_of(token, dimensions=dimensions)
                plain[place] += sign
            norm = sum(x * x for x in plain) ** 0.5
            assert has == (norm > 0) and row.tolist() == [x / (norm or 1) for x in plain]
        assert len(embedder.known) <= 3 and len(embedder.known.aside) <= 3
