"""Dataset validation: one table of (rule, label, message) from a catalog with texts and a set of cases.

Rules are grouped by what they need: rows of one table, a table as a whole, or a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.corpus import scope_violation

#: The share of each category, and how many cases a dataset has.
CATEGORIES = {"simple": 0.40, "paraphrased": 0.20, "multi_policy": 0.15, "unanswerable": 0.15, "ambiguous_adversarial": 0.10}
FEWEST_CASES, MOST_CASES, LEAST_SUPPORT = 30, 50, 0.5


def _blank(x: Column) -> Column:
    return x.isNull() | (F.length(T.strip(x)) == 0)


#: What each rule says of a row that breaks it; a rule about one value of a row appends it.
MESSAGES = {
    "seller_id": "a seller needs an id of its own", "seller_documents": "a seller needs documents", "catalog_sellers": "the catalog needs sellers",
    "document_identity": "seller, document and version must all be named", "document_unique": "this version of the document is listed before", "document_path": "the file must lie in its seller's folder",
    "document_readable": "the file has no text that can be read", "document_empty": "the text is blank", "document_title": "the first heading isn't the document's name",
    "document_seller": "the text doesn't name its seller", "document_version": "the text doesn't name its version", "document_sections": "the text has no section",
    "case_id": "a case needs an id of its own", "case_skipped": "a case is marked to be skipped", "case_category": "no such category", "case_seller": "no such seller in the corpus",
    "case_query": "the question is blank", "case_answerable": "answerable is neither true nor false", "sources_list": "the expected sources are no list of names", "sources_unique": "an expected source is named twice",
    "identity_list": "the expected identities are no list", "identity_seller": "an identity belongs to another seller", "identity_known": "an identity isn't in the corpus", "identity_name": "an identity has another document's name",
    "identity_section": "an identity names no section of its document", "sources_match": "sources and identities name different documents", "points_needed": "an answerable case needs answer points",
    "point_supported": "the cited sections don't hold the point", "points_forbidden": "a case without an answer has answer points", "notes_needed": "a case without an answer needs a note why",
    "corpus_corpus_id": "the corpus has no id", "corpus_corpus_version": "the corpus has no version", "dataset_dataset_id": "the dataset has no id", "dataset_dataset_version": "the dataset has no version",
    "dataset_corpus_id": "the dataset is of another corpus", "dataset_corpus_version": "the dataset is of another version of the corpus", "dataset_file": "the file's name doesn't end with the version",
    "dataset_cases": "the dataset has no cases", "dataset_size": f"a dataset has {FEWEST_CASES} to {MOST_CASES} cases", "dataset_skipped": "no case is run", "dataset_coverage": "a seller has no case",
    "dataset_target": "the categories' shares are off", "dataset_distribution": "the declared numbers of categories aren't the actual ones",
}


def _broken(rows: DataFrame, label: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """A row (rule, label, message) for each rule that a row breaks, all in one pass; a rule that can't be judged is broken."""
    said = lambda rule: F.lit(MESSAGES[rule]) if detail is None else F.concat(F.lit(f"{MESSAGES[rule]}: "), F.coalesce(detail, F.lit("?")))
    each = [F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(rule).alias("rule"), label.cast("string").alias("label"), said(rule).alias("message"))) for rule, bad in rules.items()]
    return rows.select(F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.*")


def catalog_errors(sellers: DataFrame) -> DataFrame:
    """sellers: seller_id, documents (an array, or null) and at (catalog order): ids that are blank or come twice, empty lists."""
    n = F.row_number().over(Window.partitionBy("seller_id").orderBy("at"))
    rows = sellers.withColumn("n", n)
    named = F.coalesce(F.nullif(T.strip(F.col("seller_id")), F.lit("")), F.concat(F.lit("seller "), (F.col("at") + 1).cast("string")))
    found = _broken(rows, named, {"seller_id": _blank(F.col("seller_id")) | (F.col("n") > 1), "seller_documents": F.col("documents").isNull() | (F.size("documents") < 1)})
    none = sellers.agg(F.count("*").alias("n"))
    return found.unionByName(_broken(none, F.lit("catalog"), {"catalog_sellers": F.col("n") < 1}))


def document_errors(documents: DataFrame) -> DataFrame:
    """documents: seller_id, seller_name, document_id, version, path, document_name, text (null if it can't be read), at (catalog order).

    A document without an identity, or listed before, is judged by that alone; one whose file is out of place isn't read.
    """
    blank = _blank(F.col("seller_id")) | _blank(F.col("document_id")) | _blank(F.col("version"))
    nth = F.row_number().over(Window.partitionBy("seller_id", "document_id", "version").orderBy("at"))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    astray = F.col("path").isNull() | scope_violation(F.col("seller_id"), F.col("path")).isNotNull() | (F.size(parts) != 2)
    rows = documents.withColumn("blank", blank).withColumn("again", ~blank & (nth > 1)).withColumn("astray", F.coalesce(astray, F.lit(True)))
    own = ~F.col("blank") & ~F.col("again")
    placed = own & ~F.col("astray")
    read = placed & F.col("text").isNotNull()
    says = lambda prefix, what: F.contains("text", F.concat(F.lit(prefix), F.coalesce(what, F.lit("None"))))
    headed = F.startswith("text", F.concat(F.lit("# "), F.coalesce("document_name", F.lit("None")), F.lit("\n")))
    of_text = {
        "document_empty": _blank(F.col("text")), "document_title": ~headed, "document_seller": ~says("Seller: ", F.col("seller_name")), "document_version": ~says("Version: ", F.col("version")),
        "document_sections": ~F.col("text").rlike(r"(?md)^## "),
    }
    rules = {"document_identity": F.col("blank"), "document_unique": F.col("again"), "document_path": own & F.col("astray"), "document_readable": placed & F.col("text").isNull()}
    return _broken(rows, F.concat_ws("/", "seller_id", "document_id", "version"), rules | {rule: read & F.coalesce(bad, F.lit(True)) for rule, bad in of_text.items()})


def case_errors(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """cases: rows of schemas.CASE with at (order), and optionally skip and status; documents as for document_errors."""
    have = cases.columns
    none = F.array().cast("array<string>")
    ids, points = F.coalesce("expected_sources", none), F.coalesce("expected_answer_points", none)
    label = F.coalesce(F.nullif("case_id", F.lit("")), F.concat(F.lit("case "), F.col("at") + 1))
    flag = lambda c, value: F.coalesce(F.col(c) == value, F.lit(False)) if c in have else F.lit(False)
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("at"))
    rows = cases.withColumn("n", nth).withColumn("label", label).withColumn("skipped", flag("skip", True) | flag("status", "skipped"))
    rows = rows.join(documents.select("seller_id").distinct().withColumn("has_corpus", F.lit(True)), "seller_id", "left")
    answerable = F.col("answerable").eqNullSafe(F.lit(True))
    listed = (F.size(points) > 0) & ~F.exists(points, _blank)
    alone = _broken(rows, F.col("label"), {
        "case_id": _blank(F.col("case_id")) | (F.col("n") > 1), "case_skipped": F.col("skipped"), "case_category": ~F.col("category").isin(*CATEGORIES), "case_seller": F.col("has_corpus").isNull(),
        "case_query": _blank(F.col("query")), "case_answerable": F.col("answerable").isNull(), "sources_list": F.col("expected_sources").isNull() | F.exists(ids, lambda x: x.isNull() | (x == "")),
        "sources_unique": F.size(F.array_distinct(ids)) != F.size(ids), "identity_list": F.col("expected_source_identity").isNull(), "points_needed": answerable & ~listed,
        "points_forbidden": ~answerable & (F.size(points) > 0), "notes_needed": F.col("answerable").eqNullSafe(F.lit(False)) & _blank(F.col("notes")),
    })

    # identities against the corpus: the first entry of a version, the last section of a name
    known = documents.groupBy("seller_id", "document_id", "version").agg(F.min_by("document_name", "at").alias("known_name"), F.min_by("text", "at").alias("text"))
    bodies = known.select("seller_id", "document_id", "version", F.posexplode(T.all_sections(F.col("text"))).alias("nth", "part"))
    bodies = bodies.groupBy("seller_id", "document_id", "version", F.col("part.section").alias("section")).agg(F.max_by("part.text", "nth").alias("body"))
    cited = rows.select("at", "label", F.col("seller_id").alias("case_seller"), F.posexplode_outer("expected_source_identity").alias("i", "source")).where("source is not null").select("at", "label", "case_seller", "i", "source.*")
    same = lambda other: (F.col("c.seller_id") == F.col(f"{other}.seller_id")) & (F.col("c.document_id") == F.col(f"{other}.document_id")) & F.col("c.version").eqNullSafe(F.col(f"{other}.version"))
    met = cited.alias("c").join(known.drop("text").alias("k"), same("k"), "left").join(bodies.alias("b"), same("b") & (F.col("c.section") == F.col("b.section")), "left")
    met = met.select("c.*", F.col("k.document_id").isNotNull().alias("known"), "known_name", "body")
    identities = _broken(met, F.col("label"), {
        "identity_seller": ~F.col("seller_id").eqNullSafe(F.col("case_seller")), "identity_known": ~F.col("known"),
        "identity_name": F.col("known") & ~F.col("document_name").eqNullSafe(F.col("known_name")), "identity_section": F.col("known") & F.col("body").isNull(),
    })

    # what the known identities say together
    together = met.where("known").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("i", "document_id", F.coalesce("body", F.lit("")).alias("body")))).alias("found"))
    whole = rows.join(together, "at", "left").withColumn("evidence", F.array_join(F.coalesce(F.col("found.body"), none), " "))
    sources = _broken(whole, F.col("label"), {"sources_match": F.array_distinct(F.coalesce(F.col("found.document_id"), none)) != ids})
    each = whole.where(answerable & listed).select("label", "evidence", F.explode(points).alias("point"))
    supported = _broken(each, F.col("label"), {"point_supported": T.lexical_support(F.col("point"), F.col("evidence")) < LEAST_SUPPORT}, F.col("point"))
    return reduce(DataFrame.unionByName, [alone, identities, sources, supported])


def distribution(cases: DataFrame) -> DataFrame:
    """(category, actual, expected) of all categories; expected rounds halves to even."""
    spark = cases.sparkSession
    target = spark.createDataFrame([(c, r) for c, r in CATEGORIES.items()], "category string, ratio double")
    actual = cases.groupBy("category").agg(F.count("*").alias("actual"))
    total = cases.agg(F.count("*").alias("total"))
    both = F.broadcast(target).join(actual, "category", "left").join(F.broadcast(total))
    return both.select("category", F.coalesce("actual", F.lit(0)).alias("actual"), F.bround(F.col("total") * F.col("ratio")).cast("long").alias("expected"))


def dataset_errors(cases: DataFrame, documents: DataFrame, envelope: dict, corpus: dict) -> DataFrame:
    """Errors of the dataset as a whole. envelope: dataset_id, dataset_version, corpus_id, corpus_version, distribution, file stem; corpus: its id and version."""
    missing = lambda x: not isinstance(x, str) or not x.strip()
    version, names = envelope.get("dataset_version"), ("corpus_id", "corpus_version")
    skip = F.coalesce(F.col("skip"), F.lit(False)) if "skip" in cases.columns else F.lit(False)
    n, skipped = cases.agg(F.count("*"), F.count_if(skip)).first()
    counted = {r["category"]: (r["actual"], r["expected"]) for r in distribution(cases).collect()}  # a row a category
    actual = {c: a for c, (a, _) in counted.items() if a}
    uncovered = n > 0 and not documents.select("seller_id").join(cases.select("seller_id"), "seller_id", "left_anti").isEmpty()
    broken = {
        **{f"corpus_{c}": missing(corpus.get(c)) for c in names}, **{f"dataset_{c}": envelope.get(c) != corpus.get(c) for c in names},
        **{f"dataset_{c}": missing(envelope.get(c)) for c in ("dataset_id", "dataset_version")}, "dataset_file": bool(version) and not str(envelope.get("stem", "")).endswith(f"-v{version}"),
        "dataset_cases": n == 0, "dataset_size": n > 0 and not FEWEST_CASES <= n <= MOST_CASES, "dataset_skipped": 0 < n == skipped, "dataset_coverage": uncovered,
        "dataset_target": n > 0 and any(a != e for a, e in counted.values()), "dataset_distribution": n > 0 and (envelope.get("distribution") or {}) != actual,
    }
    rows = [(rule, rule.partition("_")[0], MESSAGES[rule]) for rule, bad in broken.items() if bad]
    return cases.sparkSession.createDataFrame(rows, "rule string, label string, message string")


def validate(cases: DataFrame, documents: DataFrame, envelope: dict, corpus: dict, sellers: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """The summary and all errors; sellers: as for catalog_errors, if the catalog itself is to be judged."""
    errors = document_errors(documents).unionByName(case_errors(cases, documents)).unionByName(dataset_errors(cases, documents, envelope, corpus))
    if sellers is not None:
        errors = catalog_errors(sellers).unionByName(errors)
    failed = errors.count()
    collected = cases.count()
    skipped = cases.where("coalesce(skip, false)").count() if "skip" in cases.columns else 0
    summary = {
        "status": "failed" if failed else "passed", "corpus_id": corpus.get("corpus_id"), "corpus_version": corpus.get("corpus_version"), "dataset_id": envelope.get("dataset_id"),
        "dataset_version": envelope.get("dataset_version"), "collected": collected, "executed": collected - skipped, "skipped": skipped, "failed_checks": failed,
        "seller_count": cases.join(documents.select("seller_id").distinct(), "seller_id", "left_semi").select("seller_id").distinct().count(),
        "document_count": documents.select("seller_id", "document_id", "version").distinct().count(),
    }
    return summary, errors
