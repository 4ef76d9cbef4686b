import json
import math

import pytest
from pyspark.sql import functions as F

from siltstone.errors import EvaluationError, EvaluationUnavailable, GenerationUnavailableError
from siltstone.functions import text as T
from siltstone.operators import answers as A
from siltstone.operators import judging as J
from siltstone.operators import lifecycle as L
from siltstone.operators import metrics as M
from siltstone.operators import reports as R
from siltstone.operators import taskgraph as G
from siltstone.operators import validation as V

EVIDENCE = "query_id string, query string, seller_id string, evidence_seller_id string, rank int, text string, document_name string, section string, page int"


def evidence(spark, n=6, **changes):
    row = {"query_id": "q", "query": "What now?", "seller_id": "s", "evidence_seller_id": "s"} | changes
    return spark.createDataFrame([(*row.values(), i, f"Text {i}. More {i}.", f"Doc {i}", "Sec" if i == 1 else None, i if i == 2 else None) for i in range(1, n + 1)], EVIDENCE)


def test_spaces():
    assert set(T.SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_request_and_transport(spark):
    assert A.request("q", ["a", "b"])["format"]["properties"]["evidence_ids"]["items"]["enum"] == ["E1", "E2"]
    assert json.loads(A.request("q", ["a"])["messages"][1]["content"]) == {"question": "q", "evidence": [{"evidence_id": "E1", "text": "a"}]}

    def fake(url, payload, timeout):
        shown = json.loads(payload["messages"][1]["content"])["evidence"]
        assert url.endswith("/api/chat") and [e["evidence_id"] for e in shown] == ["E1", "E2", "E3", "E4", "E5"] and shown[0]["text"] == "Text 1. More 1."
        return {"message": {"content": '{"answer": " Yes. ", "evidence_ids": ["E2", "E1"]}'}, "eval_count": 3}

    row = A.generate(evidence(spark), transport=fake).first()
    assert (row["answer"], row["evidence_ids"], row["eval_count"], row["prompt_eval_count"], row["error"]) == ("Yes.", ["E2", "E1"], 3, None, None)
    cited = A.resolve_citations(spark.createDataFrame([("q", ["E2", "E1"])], "query_id string, evidence_ids array<string>"), evidence(spark))
    assert json.loads(A.citation_json(cited).first()["citations"]) == [{"evidence_id": "E2", "document_name": "Doc 2", "page": 2}, {"evidence_id": "E1", "document_name": "Doc 1", "section": "Sec"}]
    assert A.generate(evidence(spark), transport=A.extractive).first()["error"] is None


@pytest.mark.parametrize("content", ["not json", '{"answer":"a"}', '{"answer":"a","evidence_ids":[]}', '{"answer":" ","evidence_ids":["E1"]}', '{"answer":"a","evidence_ids":["E9"]}', '{"answer":"a","evidence_ids":["E1","E1"]}', "[]"])
def test_bad_answers(spark, content):
    row = A.generate(evidence(spark), transport=lambda u, p, t: {"message": {"content": content}}, strict=False).first()
    assert row["answer"] is None and row["error"]
    with pytest.raises(Exception, match="generation failed"):
        A.generate(evidence(spark), transport=lambda u, p, t: {"message": {"content": content}}).collect()


@pytest.mark.parametrize("change", [{"evidence_seller_id": "other"}, {"query": " "}])
def test_refused_before_the_call(spark, change):
    def never(*_):
        raise AssertionError("called")

    assert A.generate(evidence(spark, **change), transport=never, strict=False).first()["error"]


def test_unavailable(spark):
    def down(*_):
        raise GenerationUnavailableError("down")

    assert "unavailable" in A.generate(evidence(spark), transport=down, strict=False).first()["error"]
    with pytest.raises(GenerationUnavailableError):
        A.post_json("http://127.0.0.1:9/api", {}, 0.2)
    with pytest.raises(Exception, match="cited evidence is unknown"):
        A.resolve_citations(spark.createDataFrame([("q", ["E6"])], "query_id string, evidence_ids array<string>"), evidence(spark)).collect()


def test_judge(spark):
    schema = A.judge_schema(["supported", "relevant"], 2, [0, 1])
    assert schema["properties"]["results"]["minItems"] == 2 and schema["properties"]["results"]["items"]["properties"]["relevant"] == {"type": "boolean"}
    told = lambda c: lambda u, p, t: {"message": {"content": c}}
    assert A.structured_judge([], {}, transport=told('```json\n{"results": [1]}\n```'))[0] == [1]
    for bad in ("x", '{"other": 1}', "[]"):
        with pytest.raises(EvaluationError):
            A.structured_judge([], {}, transport=told(bad))
    expected = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 2)], "batch_id int, example_index int, bound int")
    results = spark.createDataFrame([(1, 0, [0, 1]), (1, 0, [0]), (1, 1, [2]), (1, 7, [])], "batch_id int, example_index int, xs array<int>")
    assert {(r["example_index"], r["problem"]) for r in A.judge_problems(results, expected, ["xs"]).collect()} == {(0, "repeated"), (2, "omitted"), (7, "invented"), (1, "out of bounds")}
    rows = spark.createDataFrame([(i, 1 + i % 2) for i in range(20)], "i int, size int")
    assert {tuple(r) for r in A.batches_by_size(rows, "size", "i").groupBy("size", "batch").count().collect()} == {(1, 0, 8), (1, 1, 2), (2, 0, 8), (2, 1, 2)}
    judged = A.lexical_judge(spark.createDataFrame([("c", "refund days?", "Refund takes fourteen days. Pigs fly.", "refund takes fourteen days", "refund takes fourteen days", ["refund takes fourteen days", "carrier pays shipping"])], "case_id string, query string, answer string, cited_text string, evidence_text string, points array<string>")).first()["judgment"]
    assert (judged["faithful"], judged["relevant"], judged["unsupported_claims"], judged["available_answer_point_indices"], judged["covered_answer_point_indices"]) == (False, True, ["Pigs fly."], [0], [0])


def test_grading(spark):
    cases = spark.createDataFrame([("a", "s"), ("b", "s")], "case_id string, seller_id string")
    ids = "case_id string, seller_id string, document_id string, version string, section string"
    want = spark.createDataFrame([("a", "s", "d", None, "x"), ("a", "s", "e", None, None)], ids)
    got = spark.createDataFrame([("a", "s", "z", "1", None, 1), ("a", "s", "e", None, None, 2), ("a", "t", "e", None, None, 3), ("a", "s", "d", None, "x", 6), ("a", "s", "e", None, None, 4)], ids + ", rank int")
    rows = {r["case_id"]: r for r in M.grade(cases, want, got).collect()}
    assert (rows["a"]["recall"], rows["a"]["reciprocal_rank"], rows["a"]["leaked"]) == (0.5, 0.5, 1)
    assert rows["b"]["recall"] is None and rows["b"]["reciprocal_rank"] is None


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [float(i) for i in range(41)]])
def test_quantiles(spark, values):
    row = spark.createDataFrame([(v,) for v in values], "x double").agg(M.upper_median("x").alias("m"), M.nearest_rank("x", 0.95).alias("p")).first()
    ordered = sorted(values)
    assert row["m"] == ordered[len(values) // 2] and row["p"] == ordered[math.ceil(len(values) * 0.95) - 1]


def test_kappa(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "expected boolean, actual boolean")
    assert tuple(M.kappa(pairs([(True, True), (False, False)])).first()) == (1.0, 1.0) and tuple(M.kappa(pairs([(True, True)])).first()) == (1.0, 1.0)
    assert M.kappa(pairs([(True, True), (True, False), (False, False), (False, False)])).first()["cohens_kappa"] == pytest.approx(0.5)
    with pytest.raises(EvaluationError):
        M.kappa(pairs([]))


@pytest.mark.parametrize(("codes", "want"), [([0, 0], 0), ([0, 3], 3), ([3, 2], 2), ([2, 7], 1), ([-1], 1)])
def test_exit_codes(spark, codes, want):
    assert spark.createDataFrame([(c,) for c in codes], "c int").agg(M.combined_exit(F.col("c"))).first()[0] == want


BODY = "# Policy\n\nSeller: Shop\nVersion: 1\n\n## Returns — basic\nReturn goods within fourteen days of delivery.\n"


def corpus(spark, **changes):
    row = {"seller_id": "shop", "seller_name": "Shop", "document_id": "returns", "version": "1", "path": "shop/returns.md", "document_name": "Policy", "text": BODY, "at": 0} | changes
    return spark.createDataFrame([tuple(row.values())], "seller_id string, seller_name string, document_id string, version string, path string, document_name string, text string, at long")


@pytest.mark.parametrize(("change", "rule"), [({}, None), ({"version": " "}, "document_identity"), ({"path": "shop/../x"}, "document_path"), ({"path": "x.md"}, "document_path"), ({"text": None}, "document_readable"), ({"document_name": "Other"}, "document_title"), ({"seller_name": "Else"}, "document_seller"), ({"text": "# Policy\nSeller: Shop\nVersion: 1"}, "document_sections")])
def test_document_rules(spark, change, rule):
    found = {r["rule"] for r in V.document_errors(corpus(spark, **change)).collect()}
    assert found == ({rule} if rule else set())


def test_dataset_rules(spark):
    n = 40
    category = [c for c, k in zip(V.CATEGORIES, (16, 8, 6, 6, 4), strict=True) for _ in range(k)]
    source = [("shop", "returns", "1", "Policy", "Returns")]
    ddl = "case_id string, category string, seller_id string, query string, answerable boolean, expected_sources array<string>, expected_source_identity array<struct<seller_id: string, document_id: string, version: string, document_name: string, section: string>>, expected_answer_points array<string>, notes string, at long"
    rows = [(f"c{i}", category[i], "shop", "q", True, ["returns"], source, ["Goods return within fourteen days."], None, i) for i in range(n)]
    envelope = {"dataset_id": "d", "dataset_version": "1", "corpus_id": "c", "corpus_version": "1", "distribution": dict(zip(V.CATEGORIES, (16, 8, 6, 6, 4), strict=True)), "stem": "set-v1"}
    owner = {"corpus_id": "c", "corpus_version": "1"}
    summary, errors = V.validate(spark.createDataFrame(rows, ddl), corpus(spark), envelope, owner)
    assert errors.collect() == [] and summary["status"] == "passed" and summary["executed"] == n
    _, errors = V.validate(spark.createDataFrame(rows[:3], ddl), corpus(spark), envelope | {"stem": "set", "corpus_id": "z"}, owner)
    assert {r["rule"] for r in errors.collect()} == {"dataset_size", "dataset_target", "dataset_distribution", "dataset_file", "dataset_corpus_id"}
    _, errors = V.validate(spark.createDataFrame([], ddl), corpus(spark), envelope, owner)
    assert "dataset_cases" in {r["rule"] for r in errors.collect()}


TASK = "id string, name string, parent string, status string, blocker string, dependencies array<string>, required_gates array<string>, at long"


def tasks(spark, rows):
    return spark.createDataFrame([(i, i, p, s, "why" if s == "blocked" else None, d, ["harness"], n) for n, (i, p, s, d) in enumerate(rows)], TASK)


def test_invalidation_and_cycles(spark):
    rows = [("p0", None, "implemented", []), ("p1", None, "verified", ["p0"]), ("a", "p1", "verified", []), ("p2", None, "verified", []), ("b", "p2", "verified", []), ("c", "p2", "implemented", ["b"])]
    after = {r["id"]: r["status"] for r in G.invalidate(tasks(spark, rows)).collect()}
    assert after == {"p0": "implemented", "p1": "blocked", "a": "blocked", "p2": "implemented", "b": "verified", "c": "implemented"}
    again = G.invalidate(tasks(spark, [(i, p, after[i], d) for i, p, _, d in reversed(rows)]))
    assert {r["id"]: r["status"] for r in again.collect()} == after
    assert G.cycles(tasks(spark, rows)).count() == 0
    ring = tasks(spark, [("x", None, "verified", ["y"]), ("y", None, "verified", ["z"]), ("z", None, "verified", ["x"]), ("w", None, "odd", ["x"])])
    assert {r["id"] for r in G.cycles(ring).collect()} == {"x", "y", "z", "w"}
    found = {(r["rule"], r["id"]) for r in G.rule_errors(ring, ("verified", "blocked"), ("harness",)).collect()}
    assert ("invalid status", "w") in found and ("dependency cycle", "x") in found
    assert {tuple(r) for r in G.prerequisites(tasks(spark, rows)).where("id = 'a'").collect()} == {("a", "p0")}


def test_status_view(spark):
    rows = [("p0", None, "verified", []), ("p1", None, "in_progress", ["p0"]), ("a", "p1", "in_progress", []), ("b", "p1", "not_started", []), ("c", "p1", "blocked", ["b"])]
    view = {r["id"]: (r["standing"], r["reasons"]) for r in G.status_view(tasks(spark, rows)).collect()}
    assert view["a"] == ("Active", []) and view["b"] == ("Blocked", ["after the active task a"]) and view["c"][1] == ["waiting for b", "c: why", "after the active task a"]
    assert G.status_view(tasks(spark, [("p0", None, "verified", [])])).count() == 0


def test_reports(spark, tmp_path):
    (tmp_path / "b").write_bytes(b"2")
    (tmp_path / "a").write_bytes(b"1")
    import hashlib

    paths = [str(tmp_path / n) for n in ("b", "a")]
    assert R.fingerprint(spark, paths, str(tmp_path)) == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()
    assert len(R.run_id({"x": 1})) == 16
    out = str(tmp_path / "report.json")
    assert not R.write_baseline(spark, {"status": "failed"}, out, True) and not R.write_baseline(spark, {"status": "passed"}, out, False) and R.write_baseline(spark, {"status": "passed"}, out, True)
    assert R.write_baseline(spark, {"status": "passed", "n": 2}, out, True) and json.loads((tmp_path / "report.json").read_text())["n"] == 2
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert R.cached(spark, str(tmp_path / "c"), "h", make).count() == 3 and R.cached(spark, str(tmp_path / "c"), "h", make).count() == 3 and len(made) == 1
    assert len(R.tree_snapshot(spark, str(tmp_path), {"features": [{"id": 1, "status": "x"}]}, excluded=("c/",))) == 64


def generation_tables(spark, n=6):
    """n answerable cases of one seller, each with its own chunk, and one that isn't answerable."""
    ident = "seller_id string, document_id string, version string, section string"
    texts = [(f"c{i}", "shop", f"d{i}", "1", "s", 0, f"Item{i} may be sent back within {i + 3} days. Item{i} costs {i} coins to ship.") for i in range(n)]
    chunks = spark.createDataFrame(texts, f"chunk_id string, {ident}, chunk_position int, text string")
    expected = spark.createDataFrame([(f"k{i}", "shop", f"d{i}", "1", "s") for i in range(n)], f"case_id string, {ident}")
    rows = [(f"k{i}", "shop", f"What of Item{i}?", [f"Item{i} may be sent back within {i + 3} days", f"Item{i} costs {i} coins to ship"], True) for i in range(n)]
    cases = spark.createDataFrame([*rows, ("no", "shop", "Who knows?", [], False)], "case_id string, seller_id string, query string, points array<string>, answerable boolean")
    definitions = spark.createDataFrame([(f"k{i}", "holdout" if i % 3 == 0 else "tune", "Pigs fly over purple mountains.") for i in range(n)], "case_id string, split string, unsupported_sentence string")
    return chunks, expected, cases, definitions


def test_generation_run(spark):
    chunks, expected, cases, definitions = generation_tables(spark)
    gold = J.gold_evidence(chunks, expected)
    assert gold.count() == 6 and {r["rank"] for r in gold.collect()} == {1}
    thresholds = M.THRESHOLDS | {"cases": 6, "gold_relevant_cases": 6, "gold_complete_points": 6, "retrieved_relevant_cases": 6, "retrieved_complete_points": 6, "retrieved_conditional_completeness": 0.5}
    run = lambda **k: J.generation_run(cases, gold, gold, definitions, exactly=6, holdout=2, thresholds=thresholds, **({"transport": A.extractive, "judge_transport": J.lexical_transport} | k))
    report, results, failures = run(measured_at="then")
    row = report.first()
    assert row["status"] == "passed" and row["measured_at"] == "then" and failures.count() == 0 and results.count() == 12
    assert row["calibration"]["agreement"] == 1 and row["calibration"]["label_count"] == 12 * 2 + 12 + 12 * 4 and row["holdout"]["cohens_kappa"] == 1
    assert row["gold"]["faithful_cases"] == 6 and row["gold"]["available_answer_points"] == 12 and row["gold"]["covered_answer_points"] == 6
    assert row["judge_prompt_tokens"] > 0 and row["generation_output_tokens"] > 0 and row["generation_p95"] is not None

    def cites_nothing(url, payload, timeout):
        return {"message": {"content": '{"answer": "x", "evidence_ids": []}'}}

    report, results, failures = run(transport=cites_nothing)
    assert report.first()["status"] == "failed" and failures.count() == 12 and results.count() == 0
    foreign = gold.withColumn("seller_id", F.when(F.col("case_id") == "k1", "other").otherwise(F.col("seller_id")))
    report, results, failures = J.generation_run(cases, gold, foreign, definitions, exactly=6, holdout=2, thresholds=thresholds, transport=A.extractive, judge_transport=J.lexical_transport)
    assert report.first()["leakage"] == 1 and {tuple(r)[:2] for r in failures.collect()} == {("k1", "retrieved")} and report.first()["status"] == "failed"
    with pytest.raises(EvaluationError):
        J.answerable(cases)
    with pytest.raises(EvaluationError):
        J.gold_evidence(chunks.limit(0), expected)
    with pytest.raises(EvaluationError):
        J.calibration_examples(definitions.withColumn("split", F.lit("odd")), cases, gold, exactly=6, holdout=0)
    with pytest.raises(EvaluationError):
        J.calibrate(definitions, cases.where("answerable"), gold, transport=cites_nothing, exactly=6, holdout=2)


def test_judge_batches(spark):
    sent = []

    def spy(url, payload, timeout):
        sent.append(payload)
        return J.lexical_transport(url, payload, timeout)

    items = spark.createDataFrame([(f"e{i}", "q", "One two. Three four." if i % 2 else "One two.", ["one two"], ["E1"], ["one two", "other"]) for i in range(20)], "example string, query string, answer string, points array<string>, evidence_ids array<string>, evidence array<string>")
    rows = J.judge(J.judged_items(items), "support", transport=J.lexical_transport).collect()
    calls = {}
    for r in rows:
        calls.setdefault(r["call"], []).append(r["example"])
        assert r[J.SUPPORT[0]] == [0] and r["error"] is None
    assert sorted(map(len, calls.values())) == [2, 2, 8, 8] and sum(r["latency_ms"] is not None for r in rows) == 4
    good = [{"example_index": 1, "supported_sentence_indices": [1, 0, 1], "relevant": True}, {"example_index": 0, "supported_sentence_indices": [], "relevant": False}]
    assert [r["supported_sentence_indices"] for r in J.checked_results(good, [2, 2], J.SUPPORT)] == [[], [0, 1]]
    for change in ({"example_index": 0}, {"example_index": True}, {"relevant": 1}, {"supported_sentence_indices": [2]}, {"supported_sentence_indices": [True]}, {"more": 1}):
        with pytest.raises(EvaluationError):
            J.checked_results([dict(good[0]) | change, dict(good[1])], [2, 2], J.SUPPORT)
    for bad in (None, good[:1], [1, 2]):
        with pytest.raises(EvaluationError):
            J.checked_results(bad, [2, 2], J.SUPPORT)


def test_installed_model():
    def tags(url, payload, timeout):
        return {"models": [{"name": "a", "digest": "1"}, {"model": "b", "size": 2}]}

    assert J.installed_model("a", get=tags)["digest"] == "1" and J.installed_model("b", get=tags)["name"] == "b"
    with pytest.raises(EvaluationUnavailable):
        J.installed_model("c", get=tags)


def test_retrieval_run_with_failing_cases(spark):
    ident = "seller_id string, document_id string, version string, section string"
    chunks = spark.createDataFrame([("c1", "s", "d1", "1", None, "refund days thirty"), ("c2", "s", "d2", "1", None, "shipping cost"), ("c3", "t", "d3", "1", None, "refund days")], f"chunk_id string, {ident}, text string")
    cases = spark.createDataFrame([("a", "s", "refund days"), ("b", "s", "???"), ("c", "s", "  "), ("d", "s", None), ("e", "s", "shipping")], "case_id string, seller_id string, query string")
    expected = spark.createDataFrame([(k, "s", "d1", "1", None) for k in "abcd"], f"case_id string, {ident}")
    summed, report = R.evaluate_retrieval(chunks, cases, expected, measured_at="now")
    row = summed.first()
    assert (row["status"], row["error_rate"], row["graded_case_count"], row["ungraded_case_count"], row["recall_at_5"]) == ("failed", 0.6, 1, 4, 1.0)
    assert (row["collected"], row["executed"], row["failed_cases"], row["indexed_chunks"], row["measured_at"]) == (5, 2, 3, 3, "now")
    rows = {r["case_id"]: r for r in report.collect()}
    assert [m["document_id"] for m in rows["a"]["matched"]] == ["d1"] and [x["document_id"] for x in rows["a"]["retrieved"]] == ["d1", "d2"]
    assert rows["b"]["failure_reason"] == "the query has no words that make a vector" and rows["c"]["failure_reason"] == rows["d"]["failure_reason"] == "the query is blank" and rows["e"]["recall"] is None
    assert R.evaluate_retrieval(chunks, cases.where("case_id = 'a'"), expected)[0].first()["status"] == "passed"


def test_passages_in_documents(spark):
    from siltstone.operators.evidence import containing

    texts = ["a bb ccc dddd eeeee ff", "xa bb ccc dddd eeeeex", "bb ccc dddd", "a  bb ccc\ndddd eeeee", None, "", "one"]
    passages = ["a bb ccc dddd eeeee", "bb ccc", "a  bb ccc\ndddd e", "one", None, "zz bb ccc dddd eeeee", "bb ccc dddd eeeee f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item long, part string")
    got = {(r["item"], r["doc"]) for r in containing(docs, items, doc_id="doc", text="text", passage_id="item", passage="part").collect()}
    assert got == {(i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t}


def test_lifecycle(spark):
    chunks = spark.createDataFrame([("a", "c1", "refund policy refund"), ("a", "c2", "shipping policy"), ("b", "c3", "refund")], "seller_id string, chunk_id string, text string")
    asked = spark.createDataFrame([("q", "a", "refund")], "query_id string, seller_id string, text string")
    lexical = L.bm25(chunks, asked, chunk_id="chunk_id", question_id="query_id", tenant="seller_id")
    assert [r["chunk_id"] for r in lexical.collect()] == ["c1"]
    dense = spark.createDataFrame([("q", "c2", 0.4), ("q", "c1", 0.3)], "query_id string, chunk_id string, score double")
    assert [r["chunk_id"] for r in L.hybrid(dense, lexical, ["query_id", "chunk_id"], query="query_id").orderBy("rank").collect()] == ["c1", "c2"]
    assert L.rewritten(asked, {"refund": "repayment"}).first()["text"] == "repayment"
    region = spark.createDataFrame([("d", 0, 10, "0123456789")], "document_id string, start int, end int, text string")
    child = spark.createDataFrame([("d", 2, 5, "234")], "document_id string, start int, end int, text string")
    assert L.with_parents(child, region, ["document_id"]).first()["region_text"] == "0123456789"
