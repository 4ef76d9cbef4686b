"""Fill-in-middle: texts are cut in units, and prefix, middle and suffix put in another order.

Everything is relational. A text's matches are exploded with their positions; running sums of
their numbers and lengths over a window tell which unit ends where; two cut requests a document
meet them by unit ordinal; the ends they find are aggregated to one row of offsets a document,
and the text is cut there by substring.

A match holds up to BLOCK units, and only where a cut falls it is matched again unit by unit, so
that a document doesn't have a row for each unit. Matches travel as two arrays of numbers and are
exploded where they arrive; the text itself travels once, to meet its offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import written
from siltstone.llm.line_dedup import NO_ID

#: Units of a block.
BLOCK = 64
#: Percent of the documents that stay as they are, and of the others that begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"
#: A unit, for regexp functions: one code point.
CODE_POINT = "(?s:.)"
MADE = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, h: list[Column], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> Column:
    """plain (empty texts and those with a mark, too), spm or psm."""
    marked = F.contains(text, F.lit(PREFIX_MARK)) | F.contains(text, F.lit(SUFFIX_MARK)) | F.contains(text, F.lit(MIDDLE_MARK))
    return F.when((text == "") | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    p, s, m = map(F.lit, (PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK))
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, f"{PREFIX_MARK}|{SUFFIX_MARK}|{MIDDLE_MARK}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def _matched(keyed: DataFrame, unit: str, seed: int, plain: int, suffix_first: int) -> DataFrame:
    """(doc, mark, n, ordinals, units, chars) from (doc, mark, id, text): how many units a text has, after which of them it is cut
    (0: before the first), and of each of its matches up to the last cut how many units and code points it has.

    A plain text has no ordinals and no matches.
    """
    one_unit = F.lit(f"(?:{unit}|{CODE_POINT})")
    matched = keyed.withColumn("piece", F.regexp_extract_all("text", F.concat(one_unit, F.lit(f"{{1,{BLOCK}}}+")), F.lit(0)))
    within = lambda piece: F.regexp_extract_all(piece, one_unit, F.lit(0))
    last = F.size(within(F.coalesce(F.try_element_at("piece", F.lit(-1)), F.lit(""))))
    counted = matched.withColumn("n", (F.greatest(F.size("piece") - 1, F.lit(0)) * BLOCK + last).cast("long"))
    h = draws(F.col("id"), seed)
    one, other = (h[i] % (F.col("n") + 1) for i in (0, 1))
    cut = form_of(F.col("text"), h, plain, suffix_first) != "plain"
    asked = counted.select("doc", "mark", "n", "piece", F.when(cut, F.array(F.least(one, other), F.greatest(one, other))).alias("ordinals"))
    block = lambda i: F.ceil(F.col("ordinals")[i] / BLOCK).cast("int") - 1
    parts = F.transform(F.slice("piece", 1, block(1) + 1), lambda x, i: F.when((i == block(0)) | (i == block(1)), within(x)).otherwise(F.array(x)))
    single = F.transform(F.slice("piece", 1, block(1) + 1), lambda x, i: F.when((i == block(0)) | (i == block(1)), F.array_repeat(F.lit(1), F.size(within(x)))).otherwise(F.array(F.lit(BLOCK))))
    is_cut = F.col("ordinals").isNotNull()
    return asked.select(
        "doc", "mark", "n", "ordinals", F.when(is_cut, F.flatten(single)).alias("units"), F.when(is_cut, F.transform(F.flatten(parts), lambda x: F.length(x))).alias("chars")
    )


def offsets(matched: DataFrame) -> DataFrame:
    """(doc, mark, n, start, end): how many code points of each text are before the middle, and before the suffix; null if it isn't cut."""
    key = ["doc", "mark"]
    # a fixed number of partitions: their size in bytes says little of how many rows they are exploded to
    n = int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that repeat an id and text are one document
    once = matched.where(F.col("units").isNotNull()).repartition(n, *key).groupBy(*key).agg(F.any_value(F.struct("units", "chars", "ordinals")).alias("d"))
    matches = once.select(*key, "d.ordinals", F.posexplode(F.arrays_zip("d.units", "d.chars")).alias("at", "m")).select(*key, "ordinals", "at", "m.units", "m.chars")
    running = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = matches.withColumn("ordinal", F.sum("units").over(running)).withColumn("end", F.sum("chars").over(running))
    ended = ended.where(F.array_contains("ordinals", F.col("ordinal"))).select(*key, "ordinal", "end")

    requests = matched.select(*key, "n", F.posexplode_outer("ordinals").alias("which", "ordinal"))
    met = requests.join(ended, [*key, "ordinal"], "left").withColumn("end", F.when(F.col("ordinal") == 0, 0).otherwise(F.col("end")).cast("long"))
    of = lambda i: F.max(F.when(F.col("which") == i, F.col("end")))
    return met.groupBy(*key).agg(F.max("n").alias("n"), of(0).alias("start"), of(1).alias("end"))


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, unit: str = CODE_POINT, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, made: str = "fim"
) -> DataFrame:
    """docs with a struct column ``made`` of MADE: units, form, code points of prefix and middle (null if plain), and output.

    unit: a regular expression, matched from left to right; what it leaves out is cut in code
    points. It must not match nothing, nor look beyond what it matches. A null text is empty,
    and an empty text plain. Cuts and form depend on seed and id alone, a null id is an empty
    one; repeated rows have the same result each. An empty table gives no rows. The column
    replaces one of the same name.
    """
    columns = [c for c in docs.columns if c.lower() != made.lower()]
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    number = docs[doc_id].cast("long")
    keyed = docs.select(F.coalesce(number, F.lit(NO_ID)).alias("doc"), F.xxhash64(content).alias("mark"), number.alias("id"), content.alias("text"))
    found = offsets(written(_matched(keyed, unit, seed, plain, suffix_first), "units"))

    # the text travels once: a null one is told by a flag
    rest = [c for c in columns if c != text]
    named = docs.select(F.struct(F.lit(1).alias("row"), *(docs[c].alias(f"c_{c}") for c in rest)).alias("rest"), docs[text].isNull().alias("no_text"), F.coalesce(number, F.lit(NO_ID)).alias("doc"), F.xxhash64(content).alias("mark"), number.alias("id"), content.alias("text"))
    joined = named.join(found, ["doc", "mark"], "left")
    form = form_of(F.col("text"), draws(F.col("id"), seed), plain, suffix_first)
    cut = joined.withColumn("form", form).withColumn("middle", F.col("end") - F.col("start"))
    piece = lambda a, n: F.substring(F.col("text"), a.cast("int"), n.cast("int"))
    output = arranged(F.col("form"), piece(F.lit(1), F.col("start")), piece(F.col("start") + 1, F.col("middle")), piece(F.col("end") + 1, F.length("text") - F.col("end")))
    told = F.struct(F.col("n"), F.col("form"), F.col("start").alias("prefix_chars"), F.col("middle").alias("middle_chars"), F.coalesce(output, F.col("text")).alias("output"))
    own = F.when(~F.col("no_text"), F.col("text"))
    return cut.select(*((own if c == text else F.col("rest")[f"c_{c}"]).alias(c) for c in columns), told.cast(MADE).alias(made))
