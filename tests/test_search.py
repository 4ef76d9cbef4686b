import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.errors import IndexingError  # noqa: F401
from siltstone.functions import embedding as E
from siltstone.functions import sql
from siltstone.operators import clusters, conversations, evidence, lifecycle, metrics, postings, retrieval

DIR = "/root/testdata/sf0.001"


def vectors(spark, n=600, dimensions=6, groups=5, seed=2):
    draw = np.random.default_rng(seed)
    middle = draw.standard_normal((groups, dimensions)) * 3
    rows = [(i, (middle[i % groups] + draw.standard_normal(dimensions) * 0.3).tolist(), f"x{i}") for i in range(n)]
    rows += [(n, None, "none"), (n + 1, [0.0] * dimensions, "zero"), (n + 2, rows[7][1], "copy"), (n + 3, rows[7][1], "copy")]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, cell string").repartition(4)


def test_kmeans_is_a_plain_loop(spark):
    rows, df = vectors(spark)
    centres = clusters.kmeans(df, id_column="id", vector="v", k=5, rounds=4, seed=3)
    order = [r["id"] for r in df.where("v is not null and exists(v, x -> x <> 0)").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(5).collect()]
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and any(v)}
    plain = np.unique([units[i] for i in order], axis=0)
    for _ in range(4):
        near = {i: int((plain @ u).argmax()) for i, u in units.items()}
        sums = [sum(units[i] for i in near if near[i] == c) for c in range(len(plain))]
        plain = np.array([np.round(s / np.linalg.norm(s), 9) if np.ndim(s) else plain[c] for c, s in enumerate(sums)])
    assert np.abs(plain - centres).max() < 2e-9
    got = {r["id"]: r for r in clusters.assigned(df, centres, vector="v").collect()}
    for i, v, _ in rows:
        if v is None or not any(v):
            assert got[i]["cell"] is None and got[i]["away"] is None
        else:
            assert got[i]["cell"] == int((centres @ units[i]).argmax()) and got[i]["size"] == pytest.approx(np.linalg.norm(v))
    assert clusters.kmeans(df.limit(0), id_column="id", vector="v", k=3).size == 0
    assert len(clusters.kmeans(df.where("cell = 'copy'"), id_column="id", vector="v", k=3)) == 1


def test_the_tables_questions_cluster_as_in_a_plain_loop(spark):
    from siltstone.plans.entry_points import question_clusters

    got = {r["question_id"]: r["cell"] for r in question_clusters(spark, DIR).collect()}
    asked = spark.read.parquet(f"{DIR}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    by_hash = [r["id"] for r in asked.orderBy(F.xxhash64(F.lit(1), "id"), "id").collect()]
    embedder = E.Embedder(model=E.TWIN)
    units = {r["id"]: np.array(u) for r in asked.collect() if (u := embedder.unit(r["text"])) is not None}
    centres = np.unique([units[i] for i in by_hash if i in units][:8], axis=0)
    for _ in range(5):
        near = {i: int((centres @ u).argmax()) for i, u in units.items()}
        sums = [sum((units[i] for i in near if near[i] == c), np.zeros(256)) for c in range(len(centres))]
        centres = np.array([np.round(s / np.linalg.norm(s), 9) if s.any() else centres[c] for c, s in enumerate(sums)])
    assert {i: c for i, c in got.items() if c is not None} == {i: int((centres @ u).argmax()) for i, u in units.items()}


@pytest.mark.parametrize("top_k", [1, 3, 700])
def test_pruned_search_is_exact(spark, tmp_path, top_k):
    rows, df = vectors(spark)
    path = str(tmp_path / "cells")
    clusters.write_cells(df.drop("cell"), path, id_column="id", vector="v", cells=5, rounds=6)
    asked = [(f"q{i}", rows[i][1]) for i in range(0, 40, 3)] + [("q-none", None), ("q-far", [-x for x in rows[0][1]]), ("q-zero", [0.0] * 6)]
    found, visited = clusters.nearest(spark, path, spark.createDataFrame(asked, "q string, v array<double>"), query_id="q", vector="v", order=("id",), top_k=top_k)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["q"], []).append((r["id"], r["score"]))
    for q, v in asked:
        scores = [(-round(float(np.dot(v, w)), 6), i) for i, w, _ in rows if w and any(w)] if v else []
        want = [(i, -s) for s, i in sorted(scores)[:top_k]]
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want], q
    pairs = visited.distinct()
    assert pairs.count() == visited.count() <= 5 * (len(asked) - 1)
    if top_k < 700:  # of clustered vectors most cells aren't read
        near = visited.where("q not in ('q-zero', 'q-far')")
        assert near.count() < 0.4 * 5 * near.select("q").distinct().count()


def test_best_of_breaks_ties_by_place():
    draw = np.random.default_rng(1)
    scores = draw.integers(0, 4, (50, 7)).astype(float)
    place = draw.permutation(50)
    for k in (1, 3, 50, 80):
        row, column, score = retrieval.best_of(scores, place, k)
        for j in range(7):
            want = sorted(range(50), key=lambda i: (-scores[i, j], place[i]))[:k]
            assert row[column == j].tolist() == want and score[column == j].tolist() == scores[want, j].tolist()


def test_postings_are_the_ranking(spark, tmp_path):
    texts = ["red coats and red hats", "blue hats", "", None, "Straße 12 straße", "and and and", "red"] * 3
    rows = [(f"s{i % 2}" if i % 5 else None, i, t, "extra", i) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "seller_id string, chunk_id long, text string, token string, tf int").repartition(3)
    asked = spark.createDataFrame([("q1", "s0", "Red hats?"), ("q2", "s1", "strasse"), ("q3", "s1", ""), ("q4", "s9", "red"), ("q5", "s0", None)], "q string, seller_id string, text string")
    path = str(tmp_path / "p")
    for _ in range(2):  # written again, the same
        postings.write_postings(chunks, path, chunk_id="chunk_id", tenant="seller_id")
    stored = postings.bm25(spark, path, asked, question_id="q", tenant="seller_id")
    plain = lifecycle.bm25(chunks.where("seller_id is not null").withColumn("text", F.coalesce("text", F.lit(""))).select("seller_id", "chunk_id", "text"), asked, chunk_id="chunk_id", question_id="q", tenant="seller_id")
    key = lambda df: {(r["q"], r["chunk_id"], r["seller_id"]): r["bm25"] for r in df.collect()}
    assert key(stored) == key(plain) and len(key(plain)) == 4 and {k[0] for k in key(plain)} == {"q1", "q2"}
    tf = {(r["chunk_id"], r["token"]): (r["tf"], r["length"]) for r in postings.postings(chunks, chunk_id="chunk_id", tenant="seller_id").collect()}
    assert tf[0, "red"] == (2, 5) and tf[4, "strasse"] == (2, 3) and not any(i in (2, 3) for i, _ in tf)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert any("concat_ws(/" in part.split("PushedFilters")[0] for part in plan.split("PartitionFilters")[1:])


def test_passages_by_their_rarest_words(spark):
    docs = [(i, "what is the of it all common words here " + ("needle in some stack " if i == 7 else "") + "end of it") for i in range(50)] + [(60, None), (61, "")]
    passages = [(1, "what is the of it all common words here needle in"), (2, "what is the of it all"), (3, "here needle in some"), (4, "nowhere at all to be found there"), (5, None), (6, "stack"), (7, "")]
    found = evidence.containing(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item long, passage string"), doc_id="doc_id", text="text", passage_id="item", passage="passage"
    )
    want = {(p, d) for p, x in passages for d, t in docs if x is not None and t is not None and x in t}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_many_short_passages(spark, monkeypatch):
    monkeypatch.setattr(evidence, "SHORT_BLOCK", 4)
    docs = spark.createDataFrame([(i, f"word{i} and word{i + 1}") for i in range(30)], "doc_id long, text string")
    passages = spark.createDataFrame([(i, f"word{i}") for i in range(13)], "item long, passage string")
    found = {tuple(r) for r in evidence.containing(docs, passages, doc_id="doc_id", text="text", passage_id="item", passage="passage").collect()}
    assert found == {(i, d) for i in range(13) for d in range(30) if f"word{i}" in f"word{d} and word{d + 1}"}


def test_sql_functions(spark):
    for model in (E.MODEL, E.TWIN):  # registered again, replaced
        sql.register(spark, model=model, dimensions=32)
    docs = spark.createDataFrame([(1, "abcdef"), (2, None), (3, ""), (4, "one. two three")], "doc_id long, text string")
    rows = spark.sql("SELECT doc_id, c.* FROM {d}, LATERAL chunk_text(text, 'fixed', 4, 1) c", d=docs).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["text"]) for r in rows if r["doc_id"] == 1} == {(1, 0, 4, "abcd"), (1, 3, 6, "def")} and {r["doc_id"] for r in rows} == {1, 4}
    cut = spark.sql("SELECT c.text FROM {d}, LATERAL chunk_text(text, 'recursive', 6, 0) c WHERE doc_id = 4", d=docs).collect()
    assert [r["text"] for r in cut] == ["one. ", "two ", "three"]
    found = spark.sql("SELECT doc_id, embed_text(text) AS v, cosine(embed_text(text), embed_text(text)) AS one FROM {d}", d=docs).collect()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["v"] == pytest.approx(E.embed_text("abcdef", model=E.TWIN, dimensions=32)) and by[4]["one"] == pytest.approx(1) and by[2]["v"] is by[2]["one"] is by[3]["v"] is None
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM {d}, LATERAL chunk_text(text, 'fixed', 4, 4) c", d=docs).collect()


def test_memory_over_a_table_and_a_stream(spark, tmp_path):
    rows = [(c, t, f"c{c} t{t}" if (c + t) % 4 else None) for c in range(4) for t in range(6)] + [(9, 0, "same"), (9, 0, "place"), (None, 1, "no id")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(3)
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((t, x or "", x is not None) for cc, t, x in rows if cc == c), key=lambda r: (r[0], r[2], r[1]))
        for i, (t, x, _) in enumerate(mine):
            want[c, t, x] = [y for _, y, _ in mine[max(0, i - 2) : i]]
    got = {(r["conv_id"], r["turn"], r["text"] or ""): r["memory"] for r in conversations.remembered(turns, 2).collect()}
    assert got == want
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in ("turn < 2", "turn >= 2 and turn < 5", "turn >= 5"):  # what is remembered outlives a run
        turns.where(part).write.mode("append").parquet(folder)
        stream = conversations.remember(spark.readStream.schema(turns.schema).parquet(folder), 2)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    told = [((r["conv_id"], r["turn"]), r["memory"]) for r in spark.read.parquet(out).collect()]
    assert sorted(told, key=repr) == sorted((((c, t), m) for (c, t, _), m in want.items()), key=repr)


@pytest.mark.parametrize("sorted_at_once", [1, 7, 4096])
def test_selection_in_rounds(spark, monkeypatch, sorted_at_once):
    monkeypatch.setattr(metrics, "SORTED", sorted_at_once)
    monkeypatch.setattr(metrics, "RANGES", 8)
    draw = np.random.default_rng(5)
    values = {"a": draw.standard_normal(500).tolist(), "b": [3.0] * 40 + [4.0], None: [1.0, 2.0], "big": [-math.inf, -1e308, 5e-324, 0.0, 1e308, math.inf], "close": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)], "one": [7.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", math.nan), ("none", None)]
    fractions = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "max": 1.0}
    got = {(r["g"], r["name"]): r["value"] for r in metrics.selected(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", fractions, "g").collect()}
    want = {(g, n): sorted(vs)[max(1, math.ceil(round(len(vs) * f, 9))) - 1] for g, vs in values.items() for n, f in fractions.items()}
    assert got == want
    assert [r["value"] for r in metrics.selected(spark.createDataFrame(rows, "g string, v double").where("g = 'b'"), "v", {"m": 0.5}).collect()] == [3.0]
    assert metrics.selected(spark.createDataFrame([], "v double"), "v", {"m": 0.5}).count() == 0


def test_question_flow_ranks_in_blocks(spark):
    """Scores are matrix products in tasks: no row of the plan is a pair of a question and a chunk."""
    from siltstone.plans import entry_points as P

    plan = P.question_flow(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "zipwith" not in plan.lower() and "Join" not in plan.replace("LateralJoin", "")


def test_passages_are_found_in_one_pass_over_the_keys(spark):
    """The texts' words are hashed when keys are written, and not again in the plan; a document that has a key twice counts once."""
    from siltstone.operators.evidence import containing

    docs = spark.createDataFrame([(1, "x a b c d e y a b c d e"), (2, "a b c d e"), (3, "a b c d"), (4, None)], "doc int, text string")
    found = containing(docs, spark.createDataFrame([(7, "a b c d e")], "item int, passage string"), doc_id="doc", text="text", passage_id="item", passage="passage")
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(text" not in plan


def test_texts_are_embedded_where_they_are_scored(spark, monkeypatch):
    """One worker makes vectors and scores them; the ranking is that over stored vectors, in one block of questions or several."""
    texts = ["coats may go back", "???", None, "shipping coats abroad", "warranty claims", "coats", "back and back", ""]
    chunks = spark.createDataFrame([(s, f"{i:02}", t) for s in ("a", "b") for i, t in enumerate(texts)], "seller_id string, chunk_id string, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(("coats", "go back", "claims abroad", "...", "warranty"))], "q int, text string")
    search = lambda rows: retrieval.retrieve_batch(rows, asked, question_id="q", top_k=3)
    ranked = lambda found: sorted((r["q"], r["seller_id"], r["rank"], r["chunk_id"], r["score"]) for r in found.collect())
    once = search(chunks)
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    stored = ranked(search(E.embed(chunks, strict=False)))
    assert len(stored) == 24 and ranked(once) == stored
    monkeypatch.setattr(retrieval, "MOST_QUESTIONS", 2)
    assert ranked(search(chunks)) == stored
