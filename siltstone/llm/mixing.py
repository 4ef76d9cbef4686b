"""Mixing sources to target weights by Poisson replication.

Each source has a target mean repetition rate; each document's count of copies is
drawn by inverting the Poisson distribution of that rate at a uniform number hashed
from the seed and the document's id. Counts so depend on nothing but seed, id and
rate: any executor that recomputes a row draws the same. Copies are then put in one
global random order by a hash of seed, id and copy number: the hash deals them to
partitions, and orders them within their partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, plain_names, small_or_plain

#: Sources whose rates are broadcast at most; with more, the join is an ordinary one over so many parts of each source.
MOST_SOURCES, PARTS = 5_000, 64
#: Copies of a row that one task makes: a row with more is dealt to several.
COPIES = 1_000
#: Hexadecimal digits of the hash that make the uniform number: 52 bits, exact in a double.
DIGITS = 13


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) hashed from seed and key; a null key hashes as ``null``."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


@lru_cache(maxsize=64)
def poisson_window(rate: float) -> tuple[int, np.ndarray]:
    """The least count k that can be drawn, and P(X <= k), P(X <= k + 1), ...: 24 deviations of the rate and a constant, however large it is.

    What lies beyond, under 1e-30, can't be told from 0 and 1 by a number of 52 bits.
    """
    far = 12 * math.sqrt(rate) + 40
    least, most = max(0, math.floor(rate - far)), math.ceil(rate + far)
    steps = np.log(rate / np.arange(least + 1, most + 1, dtype=np.float64))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.exp(log - log.max())
    below = np.cumsum(share)
    return least, below / below[-1]


def poisson_counts(rate: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The Poisson distributions of the rates inverted at u: how many k have P(X <= k) <= u. Null and other rates that aren't positive give 0."""
    out = np.zeros(len(rate), np.int64)
    for value in np.unique(rate[rate > 0]).tolist():
        mine = rate == value
        least, below = poisson_window(value)
        out[mine] = least + np.searchsorted(below, u[mine], "right")
    return out


def _drawn(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for rate, u in parts:
        yield pd.Series(poisson_counts(rate.to_numpy(np.float64), u.to_numpy(np.float64)))


def source_rates(docs: DataFrame, source: str, weights: Mapping[str, float] | None, total: float | None) -> DataFrame:
    """(source, rate): copies that a document of the source has on average.

    weights: the share of each source, in any unit; without it all sources that occur weigh
    the same. Sources without a weight, or with a weight that isn't positive, get rate 0.
    total: rows wanted, as many as docs has if None. The null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        given = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        lookup = F.create_map(*given)[F.col("__source")] if given else F.lit(None).cast("double")
        weight = F.greatest(F.coalesce(lookup, F.lit(0.0)), F.lit(0.0))
    weighed = counts.select("__source", "n", weight.alias("w"))
    sums = weighed.agg(F.sum("w"), F.sum("n")).first()
    scale = (total if total is not None else sums[1] or 0) / sums[0] if sums[0] else 0.0
    return weighed.select("__source", (F.col("w") * F.lit(float(scale)) / F.col("n")).alias("__rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: float | None = None,
    seed: int = 17,
    key: str = "doc_id",
    source: str = "source",
    number: str = "copy",
    shuffle: bool = True,
) -> DataFrame:
    """docs with each row as often as drawn, all columns kept, in a global random order.

    Adds ``number``, 1 to the row's count of copies, with underscores at its end if docs has
    such a column. Rows of one key draw the same count (repeated rows, and all rows whose key
    is null). An empty table stays empty. Rates may be large: what a draw costs grows with their
    root, and the copies of one row are made by many tasks. ``shuffle=False`` leaves out the
    global order.
    """
    number = free_name(docs.columns, number)
    docs, (key, source), back = plain_names(docs, key, source)
    rates = source_rates(docs, source, weights, total)
    small = small_or_plain(rates, MOST_SOURCES)
    on = docs[source].eqNullSafe(small["__source"])
    if small is rates:  # many sources, one of which may have most rows: each meets its rate in PARTS keys
        small = rates.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
        on = docs[source].eqNullSafe(small["__source"]) & (F.pmod(F.xxhash64(docs[key]), F.lit(PARTS)) == small["__part"])
    joined = docs.join(small, on)
    drawn = joined.select(*(docs[c] for c in docs.columns), F.pandas_udf(_drawn, "long")("__rate", uniform(seed, docs[key])).alias("__count")).where("__count > 0")
    own = [F.col(f"`{c}`") for c in docs.columns]
    runs = drawn.select(*own, "__count", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__count"), F.lit(COPIES).cast("long"))).alias("__from"))
    if (rates.agg(F.max("__rate")).first()[0] or 0) > COPIES:
        runs = runs.repartition(F.xxhash64(F.col(f"`{key}`"), "__from"))
    upto = F.least("__count", F.col("__from") + (COPIES - 1))
    copies = runs.select(*own, F.explode(F.sequence(F.col("__from").cast("int"), upto.cast("int"))).alias(number))
    if not shuffle:
        return back(copies)
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.col(number)).cast("binary"))
    return back(copies.repartition(order).sortWithinPartitions(order, F.col(f"`{key}`"), F.col(number)))
