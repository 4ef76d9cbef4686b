"""Which documents contain which of a stated set of passages: word windows as join keys, checked on the whole text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources import storage

#: Words between single spaces that make a key; passages too short for a key that are looked for in every document in one pass.
KEY_WORDS, SHORT_BLOCK = 3, 1_000


def _keys(words: Column) -> Column:
    """A hash of every KEY_WORDS words in a row; the last ones, of fewer, are of no use and do no harm."""
    shifted = F.arrays_zip(*(F.slice(words, i + 1, F.size(words)).alias(f"w{i}") if i else words.alias("w0") for i in range(KEY_WORDS)))
    return F.transform(shifted, lambda words: F.xxhash64(words))


def inner_keys(passage_id: str, items: DataFrame) -> DataFrame:
    """(passage_id, __key): the keys of a passage between its first and last word."""
    return items.select(passage_id, F.explode(F.array_distinct(F.slice(_keys(F.col("__words")), 2, F.size("__words") - KEY_WORDS - 1))).alias("__key"))


def rarest_keys(keyed: DataFrame, passage_id: str, items: DataFrame) -> DataFrame:
    """(passage_id, passage, __key): of each passage's inner keys the one that fewest documents have; keyed: a row for each document and inner key of it."""
    inner = inner_keys(passage_id, items)
    held = keyed.groupBy("__key").agg(F.count("*").alias("__n"))
    best = inner.join(held, "__key", "left").groupBy(passage_id).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__key")).alias("__best"))
    # a key that no document has finds nothing
    return best.where("__best.n > 0").select(passage_id, F.col("__best.__key").alias("__key")).join(items.drop("__words"), passage_id)


def containing(docs: DataFrame, passages: DataFrame, *, doc_id: str, text: str, passage_id: str, passage: str) -> DataFrame:
    """(passage_id, doc_id) of the documents whose text contains the passage, character for character.

    What stands between two spaces of a passage stands between two spaces of a text that contains
    it: so both meet by KEY_WORDS such words, of each passage the ones that fewest documents have
    (a common beginning is no common key), and the text decides. Passages without so many words
    are looked for everywhere, SHORT_BLOCK in a pass. Nulls contain nothing and are contained in
    nothing; the empty passage is in every text. Passage ids tell passages apart.
    """
    words = F.split(F.col(passage), " ")
    items = passages.where(F.col(passage).isNotNull()).select(passage_id, passage, words.alias("__words"))
    long = F.size("__words") >= KEY_WORDS + 2
    own = docs.where(F.col(text).isNotNull()).select(doc_id, text)
    # one pass over the texts, split once: of their keys only those of passages are kept, and counted and joined from there
    keys = own.select(doc_id, F.split(F.col(text), " ").alias("__words")).select(doc_id, F.explode(_keys(F.col("__words"))).alias("__key"))
    met = storage.held(keys.join(inner_keys(passage_id, items.where(long)).select("__key").distinct(), "__key", "left_semi").distinct(), "keys")
    pairs = met.join(rarest_keys(met, passage_id, items.where(long)), "__key").select(doc_id, passage_id, passage)
    found = [own.join(pairs, doc_id).where(F.contains(text, passage)).select(passage_id, doc_id)]
    short = items.where(~long).select(passage_id, passage)
    blocks = -(-short.count() // SHORT_BLOCK)
    for i in range(blocks):
        part = short.where(F.pmod(F.xxhash64(passage), F.lit(blocks)) == i)
        found.append(own.join(F.broadcast(part), F.contains(text, passage)).select(passage_id, doc_id))
    return reduce(DataFrame.unionByName, found)
