"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage is a function (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes every stage's result to the shared folder and reads it again.
The first four return the columns they are given; the last adds the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, hamming_dedup, line_dedup, mixing, toxicity
from siltstone.llm.common import forget, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled ones that aren't held out."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that at least five documents hold stay only in the one of largest id; n_chars follows the text."""
    return line_dedup.with_length(line_dedup.dedupe_lines(docs))


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least id stays."""
    return hamming_dedup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of rows on average, in one global random order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedupe_lines),
    ("near_dedup", dedupe_documents),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix),
]

#: A learnt score and similarity over signatures aren't SQL: the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the stages keep, as often as the last one repeats them. A stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
    return docs
