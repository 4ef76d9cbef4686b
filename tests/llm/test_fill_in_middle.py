import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import fill_in_middle as M
from tests.llm.conftest import frame


def brute(doc, text, unit, seed=1):
    text = text or ""
    units = [m[0] for m in re.finditer(f"(?:{unit}|(?s:.))", text)]
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc, len(units), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = [(None, "no id, some text"), (None, "no id, some text"), (None, None), (50, "<P>"), (51, "a <S b> <M >"), (52, "x<M>"), (53, "😀" * 200 + "\r\n \x00é" * 40), (53, "another text of one id"), (54, "y" * 64), (55, "y" * 128), (56, "y" * 65), (57, "<S" * 70), (58, "long " * 30_000)]


@pytest.mark.parametrize("unit", [M.CODE_POINT, r"\w+ ?", r"[^\n]*\n", "ab|a|b"])
def test_matches_brute_force(spark, sample, unit):
    rows = [*sample, *ODD, *((100 + i, "abab b\n" * i) for i in range(40))]
    if unit == r"\w+ ?":
        unit = r"[a-zA-Z0-9]+ ?"  # the same to both kinds of regular expression
    made = M.fill_in_middle(frame(spark, rows), unit=unit)
    got = [(r["doc_id"], *r["fim"]) for r in made.collect()]
    assert sorted(got, key=repr) == sorted((brute(d, t, unit) for d, t in rows), key=repr)
    forms = {g[2] for g in got}
    assert forms == {"plain", "psm", "spm"}
    back = made.where(~F.coalesce("text", F.lit("")).eqNullSafe(M.restored(F.col("fim.output"), F.col("fim.form"))))
    assert back.count() == 0


def test_seed_and_shares(spark):
    rows = [(i, f"text number {i}") for i in range(400)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: tuple(r["fim"]) for r in M.fill_in_middle(docs, seed=9).collect()}
    assert all(got[d] == brute(d, t, M.CODE_POINT, 9)[1:] for d, t in rows)
    shares = M.fill_in_middle(docs, plain=0, suffix_first=100).groupBy("fim.form").count().collect()
    assert [tuple(r) for r in shares] == [("spm", 400)]


def test_clashing_columns_and_empty_table(spark):
    clash = ["doc", "mark", "id", "row", "form", "middle", "n", "start", "end", "blocks", "requests", "block", "which", "unit", "u"]
    docs = frame(spark, [(1, "abc"), (2, None)]).withColumns({c: F.lit(c) for c in clash}).withColumn("FIM", F.lit(1))
    made = M.fill_in_middle(docs)
    assert made.columns == [*(c for c in docs.columns if c != "FIM"), "fim"]
    assert {tuple(r) for r in made.select("doc_id", "text", *clash).collect()} == {(1, "abc", *clash), (2, None, *clash)}
    assert M.fill_in_middle(docs.where(F.lit(False))).count() == 0
