import pytest

from siltstone.llm.line_dedup import SPACE

SPECIAL = [
    (None, "no id but words enough for one shingle", "extra"), (7001, None, None), (7002, "", "x"), (7003, " \t\n ", "x"), (7004, "one", "x"), (7005, "one", "x"),
    (7006, "a" * 60 + "\n" + "word " * 3000, "x"), (7007, "ÄÖ ß \u2028 émoji 😀 x\u0000y", "x"), (7007, "ÄÖ ß \u2028 émoji 😀 x\u0000y", "x"),
]


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the driver's smallest table, with copies, near copies, shared lines and odd texts added."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))
    long = [(i, x) for i, x in rows if len(x.split()) > 150][:6]
    rows += [(8000 + i, long[0][1]) for i in range(6)]
    for i, (_, x) in enumerate(long):
        words = x.split(" ")
        rows += [(8100 + 10 * i + k, " ".join([*words[: 40 + k], "changed", *words[41 + k :]])) for k in range(3)]
    line = "A Line That Many Documents Hold, and it is long enough"
    rows += [(8300 + i, f"start {i}\n{line}{SPACE[0] * (i % 3)}\n{line.upper()}\nend {i}") for i in range(8)]
    rows += [(i, x) for i, x, _ in SPECIAL if i is not None]
    return rows


@pytest.fixture(scope="session")
def unique(sample):
    return [(i, x) for n, (i, x) in enumerate(sample) if i not in {j for j, _ in sample[:n]}]


def frame(spark, rows, extra=True):
    """documents with clashing extra columns."""
    df = spark.createDataFrame([(i, x, "en", "src0", None if x is None else len(x), 1, "k") for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, copy int, key string")
    return df.repartition(3) if extra else df
