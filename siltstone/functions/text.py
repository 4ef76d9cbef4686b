"""String dataflow as Column expressions: cleaning, titles, sections, sentences, content words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space, for stripping and in a regular expression's class.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
SPACE_CLASS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Words without content, and what a content word is made of.
STOP_WORDS = (
    "after", "and", "are", "before", "for", "from", "has", "have", "into", "may", "must", "only", "that", "the", "their", "this", "was", "when", "with",
)
CONTENT_WORD = r"[a-z0-9@.$%]+"
#: What a token of an embedding is made of.
TOKEN = r"[\p{L}\p{N}_]+"
DASH = " — "


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(x, F.lit(SPACES))


def required(x: Column, name: str, strict: bool = True) -> Column:
    """Stripped; a null or blank value fails the job, or with strict=False becomes null."""
    short = strip(x)
    good = F.when(F.length(short) > 0, short)
    return F.coalesce(good, F.raise_error(F.lit(f"{name} is required")).cast("string")) if strict else good


def clean(text: Column) -> Column:
    """No NUL, every line end a newline, lines stripped on the right, the whole stripped."""
    lines = F.replace(F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(lines, rf"[{SPACE_CLASS}&&[^\n]]++(?=\n|\z)", ""))


def title(text: Column) -> Column:
    """The heading of level one that the text begins with, else null."""
    return F.nullif(strip(F.regexp_extract(text, r"^# ([^\n]+)", 1)), F.lit(""))


def document_name(name: Column, text: Column, document_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), title(text), document_id)


def heading_name(heading: Column) -> Column:
    return strip(F.substring_index(heading, DASH, 1))


def all_sections(text: Column) -> Column:
    """(section, text) of every level-two heading, in order, those without a name too."""
    split = F.split(text, r"(?md)^## ", -1)
    return F.transform(
        F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0))),
        lambda p: F.struct(
            heading_name(F.substring_index(p, "\n", 1)).alias("section"), strip(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")
        ),
    )


def sections(text: Column) -> Column:
    """(section, text) of every level-two heading with a name, in order, repeated names too."""
    return F.filter(all_sections(text), lambda p: p["section"] != "")


def section_map(text: Column) -> Column:
    """section to text: the last of a repeated name counts, and an empty name is one. Names are sorted, not searched for: n log n steps for n sections."""
    placed = F.sort_array(F.transform(all_sections(text), lambda p, i: F.struct(p["section"].alias("section"), i.alias("at"), p["text"].alias("text"))))

    def entries(parts: Column) -> Column:
        beside = lambda p, i: ~F.get(parts, i)["section"].eqNullSafe(p["section"])
        first, last = F.filter(parts, lambda p, i: (i == 0) | beside(p, i - 1)), F.filter(parts, lambda p, i: beside(p, i + 1))
        return F.sort_array(F.zip_with(first, last, lambda a, b: F.struct(a["at"].alias("at"), b["section"].alias("section"), b["text"].alias("text"))))

    # the sorted array is a lambda's variable: named within a lambda as an expression, it would be made again for each element
    listed = F.transform(F.array(placed), entries)[0]
    return F.map_from_entries(F.transform(listed, lambda e: F.struct(e["section"], e["text"])))


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences: cut at white space after a full stop, question or exclamation mark."""
    cut = F.split(strip(text), rf"(?<=[.!?])[{SPACE_CLASS}]+")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def content_words(text: Column) -> Column:
    """Distinct lower-cased words of over two characters that aren't stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({CONTENT_WORD})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def lexical_support(point: Column, evidence: Column) -> Column:
    """The share of a point's content words that the evidence has; 0 for a point without any."""
    words = content_words(point)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, content_words(evidence))) / F.size(words)).otherwise(F.lit(0.0))


def point_sentence(point: Column) -> Column:
    """An answer point with exactly one full stop."""
    return F.concat(F.rtrim(point, F.lit(".!?")), F.lit("."))


def unfenced(content: Column) -> Column:
    """JSON without the Markdown fence around it."""
    bare = strip(content)
    after = F.when(F.locate("\n", bare) > 0, F.regexp_replace(bare, r"^[^\n]*\n", "")).otherwise(bare)
    inner = F.substring(after, F.lit(1), F.length(after) - F.locate("```", F.reverse(after)) - 2)
    fenced = F.startswith(bare, F.lit("```")) & F.endswith(bare, F.lit("```"))
    return F.when(fenced & (F.locate("```", after) > 0), strip(inner)).when(fenced, after).otherwise(bare)


def without_fence(content: str) -> str:
    """unfenced for one text, where a task has it at hand."""
    bare = content.strip(SPACES)
    if not (bare.startswith("```") and bare.endswith("```")):
        return bare
    return bare.partition("\n")[2].rpartition("```")[0].strip(SPACES) if "\n" in bare else bare


def folded(text: Column) -> Column:
    """Lower case with sharp s written out: equals full case folding but for a few letters of rare scripts."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"), F.lit(1))
