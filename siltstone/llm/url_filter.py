"""URL rules behind a blocked Bloom filter, in DataFrame functions only.

Listed canonical URLs (host and path prefix) are hashed into a Bloom filter of
256-bit blocks: one block for a key, one bit in each of the block's eight words.
Every distinct URL's candidate keys (each of its host and parent domains that is listed,
with its path cut to the prefix lengths that this host has on the list) are tested
against their one block; what passes goes to an exact equi-join with the list, which
removes the false positives. The longest listed key that is left decides; URLs that none
fits are allowed. A page, host or rule that a large part of the rows has is hot: its row
of the smaller table is broadcast, the other rows meet by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import folded, free_name, hot_join, plain_names, small_or_plain

#: Filter bits for each listed key; rows of the filter, and of the list, that are broadcast at most.
BITS_A_KEY, MOST_BLOCKS, MOST_LISTED = 16, 65_536, 50_000
WORDS, WORD_BITS = 8, 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(folded(host), F.lit("")), F.coalesce(path, F.lit(""))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and for each word of the block the key's bit."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    spread = F.xxhash64(key, F.lit("bits"))
    return block, [F.shiftrightunsigned(spread, 5 * i).bitwiseAND(WORD_BITS - 1).cast("int") for i in range(WORDS)]


def blocked_bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """Filter rows (block, w0 .. w7) of the distinct keys; blocks without keys have no row."""
    block, bits = _place(F.col(key), blocks)
    one = [F.expr("shiftleft(1L, b{0})".format(i)).alias(f"w{i}") for i in range(WORDS)]
    placed = listed.select(block.alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(bits)))
    return placed.select("block", *one).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def possible(candidates: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidate rows whose key may be listed: no listed key is missed, a few others pass."""
    block, bits = _place(F.col(key), blocks)
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.expr(f"__w{i}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
    renamed = bloom.toDF("__block", *(f"__w{i}" for i in range(WORDS)))
    return candidates.join(renamed, block == F.col("__block")).where(hit).select(*candidates.columns)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    rules: host, path, action (``allow`` or ``block``). A rule fits its host and all
    subdomains if the URL's path starts with the rule's. A rule listed twice with both
    actions blocks; rules with a null in any column are left out. A null URL, or one
    without ``://``, has an empty host and path and is allowed. Each input row, repeated
    ones too, gives one row; if pages has columns of the added names, the added ones get
    underscores at the end. No rules: all is allowed. The list may be large: it is
    broadcast only up to MOST_LISTED rows and joined by hash beyond.
    """
    names = []
    for wanted in ("host", "path", "rule", "verdict"):
        names.append(free_name([*pages.columns, *names], wanted))
    pages, (url,), back = plain_names(pages, url)
    host, path = url_parts(pages[url].cast("string"))
    parted = pages.select("*", host.alias(names[0]), path.alias(names[1]))

    listed = (
        rules.select(folded(F.col("host")).alias("h"), F.col("path").alias("p"), "action")
        .dropna()
        .groupBy("h", "p")
        .agg(F.max("action").alias("action"))
        .select("h", F.concat("h", "p").alias("key"), F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("cut"), "action")
    )
    n_listed = listed.count()
    if not n_listed:
        return back(parted.select("*", F.lit(None).cast("string").alias(names[2]), F.lit("allow").alias(names[3])))
    blocks = max(1, n_listed * BITS_A_KEY // (WORDS * WORD_BITS))
    bloom = small_or_plain(blocked_bloom(listed, "key", blocks), MOST_BLOCKS)
    exact = listed.select("key", "action")
    close = small_or_plain(exact, MOST_LISTED)
    most_labels = listed.agg(F.max("labels")).first()[0]

    total = pages.count()
    urls = parted.groupBy(F.col(names[0]).alias("__host"), F.col(names[1]).alias("__path")).agg(F.count("*").alias("n"))
    # the listed parents of each host, and the lengths that their paths have
    cuts = small_or_plain(listed.groupBy(F.col("h").alias("__h")).agg(F.collect_set("cut").alias("__cuts")), MOST_LISTED)
    labels = F.split("__host", r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_labels))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    hosts = urls.groupBy("__host").agg(F.count("*").alias("n"))
    known = hosts.select("__host", "n", F.explode(parents).alias("__h")).join(cuts, "__h").groupBy("__host", "n").agg(F.collect_list(F.struct("__h", "__cuts")).alias("__parents"))
    cut = lambda p: F.transform(F.filter(p["__cuts"], lambda c: c <= F.length("__path")), lambda c: F.concat(p["__h"], F.substring(F.col("__path"), F.lit(1), c)))
    keys = F.flatten(F.transform("__parents", cut))
    candidates = hot_join(urls.select("__host", "__path"), known, "__host", total).select("__host", "__path", F.explode(keys).alias("key"))
    passed = possible(candidates, "key", bloom, blocks)
    if close is exact:
        hits = hot_join(passed, exact.join(passed.groupBy("key").agg(F.count("*").alias("n")), "key"), "key", total)
    else:
        hits = passed.join(close, "key")
    best = hits.groupBy("__host", "__path").agg(F.max(F.struct(F.length("key").alias("long"), "key", "action")).alias("__best"))
    judged = urls.join(best, ["__host", "__path"], "left").toDF(names[0], names[1], "n", "__best")
    found = hot_join(parted, judged, names[:2], total)
    return back(found.select(*(f"`{c}`" for c in parted.columns), F.col("__best.key").alias(names[2]), F.coalesce("__best.action", F.lit("allow")).alias(names[3])))
