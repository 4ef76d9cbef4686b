import pytest
from pyspark.sql import functions as F

from siltstone.llm import line_dedup as L
from tests.llm.conftest import frame


def brute(rows, least=5):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(L.line_key(line).decode()) >= 40:
                held.setdefault(L.line_key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := held.get(L.line_key(x), ())) < least or doc == max(h)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_matches_brute_force(spark, sample, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [*sample, *((9000 + i, "x" * 45) for i in range(300))]  # one line over many partitions
        docs = frame(spark, rows)
        done = L.apply_bitmaps(docs, L.keep_bitmaps(docs))
        got = done.select("doc_id", "__n_lines", "__n_dropped", F.coalesce("text", F.lit(""))).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)
        assert L.dedupe_lines(docs).columns == docs.columns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_null_and_lengths(spark):
    docs = frame(spark, [(1, None), (None, "y" * 50), (None, "y" * 50)])
    assert {tuple(r) for r in L.dedupe_lines(docs).select("doc_id", "text").collect()} == {(1, None), (None, "y" * 50)}
    assert L.dedupe_lines(docs.where(F.lit(False))).count() == 0
    assert L.with_length(docs).where("n_chars <> length(text)").count() == 0


def test_bitmap_round_trip():
    import numpy as np

    dropped, packed = L._bitmap(11, np.array([0, 3, 10]))
    assert dropped == 3 and L.kept_lines("\n".join(map(str, range(11))), packed) == ("1\n2\n4\n5\n6\n7\n8\n9", 11, 3)
