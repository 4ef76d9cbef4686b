"""Texts far longer than those of the tables, through the operators that compare texts."""

import random

import pytest

from siltstone.llm import bwt_merge, decontaminate, hamming_dedup, line_dedup, seed_extend
from tests.llm.conftest import frame


@pytest.fixture(scope="module")
def long():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(20_000)]
    return " ".join(draw.choices(words, k=250_000))


def test_substrings(spark, long):
    passage = long[700_000:700_900]
    found = bwt_merge.repeated_spans(frame(spark, [(1, long), (2, f"own words {passage} and more of it"), (3, long[: len(long) // 2])])).collect()
    removed = {r["doc_id"]: list(zip(r["starts"], r["ends"], strict=True)) for r in found}
    assert removed[1] == [] and removed[2] == [(10, 910)] and removed[3] == [(0, len(long) // 2)]


def test_word_runs(spark, long):
    words = long.split()
    passage = " ".join(words[100_000:100_060])
    rows = [(1, long), (2, f"own words {passage} and more"), (3, " ".join([*words[:50_000], "changed", *words[50_001:]]))]
    removed = {r["doc_id"]: list(zip(r["starts"], r["ends"], strict=True)) for r in seed_extend.repeated_words(frame(spark, rows)).collect()}
    assert removed[1] == [] and removed[2] == [(2, 62)] and removed[3] == [(0, 50_000), (50_001, 250_000)]


def test_near_duplicates(spark, long):
    words = long.split()
    near = " ".join("x" if i % 40 == 7 else w for i, w in enumerate(words))  # five-word shingles: about 0.79 of them stay, two-word ones: 0.95
    rows = [(1, long), (2, near), (3, " ".join(words[:100_000])), (4, long + " end")]
    two = {r["doc"]: r["component"] for r in hamming_dedup.near_groups(frame(spark, rows), k=2).collect()}
    assert two == {1: 1, 2: 1, 3: 3, 4: 1}


def test_lines_and_phrases(spark, long):
    line = "a long line that at least five documents hold, with some words"
    lines = [(i, f"{line}\n{long}\n{line}") for i in range(5)]
    kept = {r["doc_id"]: len(r["text"]) for r in line_dedup.dedupe_lines(frame(spark, lines)).collect()}
    assert kept[4] == len(long) + 2 * len(line) + 2 and kept[0] == 0  # the long text is a line of all five, too
    item = " ".join(long.split()[200_000:200_015])
    found = decontaminate.find_contamination(frame(spark, [(1, long), (2, "x" * 3_000_000)]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["__n_words"], tuple(r["__starts"]), tuple(r["__ends"])) for r in found} == {(1, 250_000, (200_000,), (200_015,)), (2, 1, (), ())}
