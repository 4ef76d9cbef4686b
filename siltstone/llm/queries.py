"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import attention_lm, bwt_merge, decontaminate, fill_in_middle, hamming_dedup, line_dedup, minhash, mixing, pii, seed_extend, toxicity, url_filter
from siltstone.llm.common import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and benchmark items of every document; a null text has none, repeated rows are judged each, no documents give no rows."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("__items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        decontaminate.hit_words().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced, checked for collisions; a null text stays null and has no entities."""
    replaced, _ = pii.replace_checked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    entities = F.col("__entities")
    return replaced.select(
        "doc_id",
        F.size(entities).cast("long").alias("n_entities"),
        F.size(F.array_distinct(F.transform(entities, lambda e: F.struct(e["kind"], F.lower(e["entity"]))))).cast("long").alias("n_distinct"),
        "text",
    )


def op3_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a 100-byte string covers which starts earlier too; a null text is empty, rows of one id and text are one document."""
    found = bwt_merge.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from the labelled ones that aren't held out; null and empty texts score as texts without words, without labels all score 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.LEAST_SCORE).cast("int").alias("predicted"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word base and model score of every document, learnt from those that aren't held out; a null text is empty: its one token is the end."""
    return attention_lm.score_texts(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, in the order of the ids; a null text is empty."""
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document over five-word shingles, by signature bands with similarity verified on full sets."""
    groups = hamming_dedup.near_groups(table(spark, sf_dir, "documents"), bands=True)
    return groups.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; a null URL has an empty host and path and is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and a digest of what stays of every document; a null or empty text is one empty line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its id draw, so that all sources have the same share; the null source is one of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs)


def op10_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document over two-word shingles; texts without words are groups of their own."""
    groups = hamming_dedup.near_groups(table(spark, sf_dir, "documents"), k=2)
    return groups.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def op11_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a window of 13 words covers which a smaller doc_id has too; a null text has none, an id's own repeats stay."""
    found = seed_extend.repeated_words(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, middle and suffix of every text in the order of its form, and the text rebuilt from them; a null text is empty, and plain."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(F.col("fim.output")).alias("output_sha256"),
        digest(fill_in_middle.restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_bwt_merge": op3_bwt_merge,
    "op4_toxicity": op4_toxicity,
    "op5_attention_lm": op5_attention_lm,
    "op6_fingerprints": op6_fingerprints,
    "minhash_groups": minhash_groups,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_hamming_dedup": op10_hamming_dedup,
    "op11_seed_extend": op11_seed_extend,
    "op12_fill_in_middle": op12_fill_in_middle,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+')"

def _near_groups_sql(k: int) -> str:
    words = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: {words}) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS goal FROM w UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.goal = edge.a)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(goal) AS component_id, min(goal) = w.doc_id AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id"""


#: op5's model isn't SQL; its base score is tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS part
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS part
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, part)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op3_bwt_merge": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
piece AS (SELECT doc_id, n, p, substr(x, 2000 * p + 1, 2198) AS x FROM (SELECT *, unnest(range(0, n // 1000 + 1)) AS p FROM n)),
string AS (
  SELECT doc_id, 1000 * p + i AS pos, md5_number(substr(x, 2 * i + 1, 200)) AS k
  FROM (SELECT *, unnest(range(0, greatest(0, least(1000, n - 99 - 1000 * p)))) AS i FROM piece)
), early AS (SELECT k, min(struct_pack(doc_id := doc_id, pos := pos)) AS one FROM string GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, pos FROM string JOIN early USING (k) WHERE one <> struct_pack(doc_id := string.doc_id, pos := string.pos)),
edge AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, true) AS fresh FROM gone),
run AS (SELECT doc_id, pos, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM edge),
span AS (SELECT doc_id, r, min(pos) AS a, max(pos) + 100 AS b FROM run GROUP BY doc_id, r),
hole AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (
  SELECT doc_id, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS x
  FROM (SELECT doc_id, a, before FROM hole UNION ALL SELECT n.doc_id, n, coalesce(b, 0) FROM n LEFT JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY doc_id) USING (doc_id)) JOIN n USING (doc_id) GROUP BY doc_id
), told AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)""",
    "op10_hamming_dedup": _near_groups_sql(2),
    "minhash_groups": _near_groups_sql(5),
    "op7_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op8_line_dedup": """
WITH lines AS (
  SELECT doc_id, i, l AS line,
    translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS l
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, i, line, hot.k IS NOT NULL AND doc_id <> top AS gone FROM lines LEFT JOIN hot ON lines.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_mixing": """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) / (SELECT count(*) FROM n) / n AS rate FROM n),
logs AS (
  SELECT source, k, -rate + CASE WHEN k = 0 THEN 0 ELSE sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k) END AS lp
  FROM r, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS t(k)
), cdf AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS p FROM logs),
u AS (
  SELECT doc_id, source, text, CAST('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents
), drawn AS (
  SELECT u.doc_id, u.source, any_value(u.text) AS text, count(*) FILTER (WHERE p <= u) AS c FROM u JOIN cdf ON u.source = cdf.source GROUP BY u.doc_id, u.source
)
SELECT doc_id, source, text, CAST(unnest(range(1, c + 1)) AS INTEGER) AS copy FROM drawn""",
    "op11_seed_extend": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
part AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
early AS (SELECT x, min(doc_id) AS one FROM part GROUP BY x HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM part JOIN early USING (x) WHERE doc_id > one),
holes AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)) AS left_ FROM d LEFT JOIN holes USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(left_, ' '), '')) AS kept_sha256 FROM kept""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o""",
}
