"""Retrieval and answer metrics as aggregations."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.errors import EvaluationError
from siltstone.sources import storage

IDENTITY = ("seller_id", "document_id", "version", "section")
#: The least that a generation report must reach.
THRESHOLDS = {
    "calibration_agreement": 0.90, "calibration_kappa": 0.80, "unsupported_precision": 0.95, "unsupported_recall": 0.90, "gold_relevant_cases": 30, "gold_complete_points": 64,
    "retrieved_relevant_cases": 27, "retrieved_complete_points": 40, "retrieved_conditional_completeness": 0.90, "cases": 31,
}


def identity(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in IDENTITY))


def grade(cases: DataFrame, expected: DataFrame, retrieved: DataFrame, *, case_id: str = "case_id", recall_at: int = 5, rank_at: int = 10) -> DataFrame:
    """Per case: expected, found (distinct expected identities among the first recall_at), recall, reciprocal_rank, leaked, matched.

    expected: case_id and the identity columns; retrieved: the same with rank. Nulls in an identity
    are equal. Cases that expect nothing have null recall and reciprocal rank. matched lists the
    identities that were found, sorted, nulls first.
    """
    want = expected.select(case_id, identity().alias("want")).distinct()
    hits = want.alias("w").join(retrieved.select(case_id, "rank", identity().alias("got")).alias("r"), (F.col(f"w.{case_id}") == F.col(f"r.{case_id}")) & F.col("w.want").eqNullSafe(F.col("r.got")))
    found = hits.groupBy(F.col(f"w.{case_id}").alias(case_id)).agg(
        F.array_sort(F.collect_set(F.when(F.col("rank") <= recall_at, F.col("want")))).alias("matched"), F.min(F.when(F.col("rank") <= rank_at, F.col("rank"))).alias("first_rank")
    )
    n = want.groupBy(case_id).agg(F.count("*").alias("expected"))
    leaked = retrieved.alias("r").join(cases.select(case_id, F.col("seller_id").alias("case_seller")), case_id).groupBy(case_id).agg(F.count_if(~F.col("seller_id").eqNullSafe(F.col("case_seller"))).alias("leaked"))
    graded = cases.select(case_id).join(n, case_id, "left").join(found, case_id, "left").join(leaked, case_id, "left")
    matched = F.coalesce("matched", F.array().cast(f"array<{schemas.IDENTITY}>"))
    graded = graded.withColumn("matched", matched).withColumn("found", F.size("matched"))
    return graded.select(
        case_id, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"),
        F.when(F.col("expected") > 0, F.coalesce("found", F.lit(0)) / F.col("expected")).alias("recall"),
        F.when(F.col("expected") > 0, F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("reciprocal_rank"), F.coalesce("leaked", F.lit(0)).alias("leaked"), "matched",
    )


def upper_median(x: str) -> Column:
    """The element at half the count, from 0, of the sorted values: of an even number the upper one in the middle."""
    # the lower median of the negated values: a mergeable count of values, not a list of them
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{x}`)")


def nearest_rank(x: str, fraction: float) -> Column:
    """The value of nearest rank, ceil(n * fraction), of the sorted values; null without values."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY `{x}`)")


#: Ranges that a selection cuts a group's values in, in every round; values of a group that are sorted at once, at most.
RANGES, SORTED = 512, 4_096
_GREATEST = sys.float_info.max


def selected(rows: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """(by, name, value) for each fraction by name: the value of nearest rank, ceil(n * fraction), of each group, exactly, whatever its size.

    In every round a group's range of values is cut in RANGES, counted, and the one range that has
    the rank is looked at next, until it has SORTED values at most or one value many times. So no
    task holds a group's values: partial counts travel. Nulls and NaNs don't count; a group
    without values has none.
    """
    keys = [f"k{i}" for i in range(len(by))]
    values = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(f)).alias("f")) for n, f in fractions.items()))).alias("w")
    state = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("*", wanted)
    # a fraction is taken as the decimal number it is written as
    rank = F.greatest(F.ceil(F.round(F.col("n") * F.col("w.f"), 9)), F.lit(1)).cast("long")
    state = storage.held(state.select(*keys, "w.name", "n", "lo", "hi", rank.alias("rank")), "ranks")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    inside = lambda s: values.alias("x").join(s.alias("s"), same("x", "s") & F.col("x.v").between(F.col("s.lo"), F.col("s.hi"))).select("s.*", "x.v")
    wide = (F.col("n") > SORTED) & (F.col("lo") < F.col("hi"))
    while not state.where(wide).isEmpty():
        # lo and hi are in different ranges, however close they are; infinite ones count as the greatest numbers
        v, lo, hi = (F.greatest(F.least(F.col(c), F.lit(_GREATEST)), F.lit(-_GREATEST)) for c in ("v", "lo", "hi"))
        share = F.when(hi / 2 - lo / 2 < _GREATEST / 2, (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
        counted = inside(state.where(wide)).withColumn("at", F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).groupBy(*keys, "name", "rank", "at").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("m").over(Window.partitionBy(*keys, "name").orderBy("at"))
        next_ = counted.withColumn("upto", upto).where("upto >= rank and upto - m < rank").select(*keys, "name", F.col("m").alias("n"), F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("rank") - (F.col("upto") - F.col("m"))).alias("rank"))
        before, state = state, storage.held(state.where(~wide).unionByName(next_), "ranks")
        storage.delete_held(before)
    done = state.where("lo = hi").select(*keys, "name", F.col("lo").alias("value"))
    last = inside(state.where("lo < hi")).groupBy(*keys, "name", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs")).select(*keys, "name", F.element_at("vs", F.col("rank").cast("int")).alias("value"))
    return done.unionByName(last).select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "name", "value")


def run_metrics(graded: DataFrame, *by: str) -> DataFrame:
    """The metrics of a retrieval run over graded cases with latency_ms and failed: one row, or one for each group."""
    return graded.groupBy(*by).agg(
        F.avg("recall").alias("recall_at_5"), F.avg("reciprocal_rank").alias("mrr_at_10"), F.count("recall").alias("graded_case_count"),
        (F.count("*") - F.count("recall")).alias("ungraded_case_count"), F.sum("leaked").alias("seller_leakage_count"),
        F.try_divide(F.count_if("failed").cast("double"), F.count("*").cast("double")).alias("error_rate"), F.avg("latency_ms").alias("latency_mean"), upper_median("latency_ms").alias("latency_p50"),
    )


def agreement(expected: Column, actual: Column) -> dict[str, Column]:
    """Observed agreement and Cohen's kappa of two boolean columns; kappa is 1 if chance agreement is."""
    e, a = expected.cast("double"), actual.cast("double")
    same = F.avg((expected == actual).cast("double"))
    chance = F.avg(e) * F.avg(a) + (1 - F.avg(e)) * (1 - F.avg(a))
    return {"agreement": same, "cohens_kappa": F.when(chance == 1, F.lit(1.0)).otherwise((same - chance) / F.when(chance != 1, 1 - chance))}


def kappa(labels: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """One row: agreement and cohens_kappa; labels must not be empty."""
    if labels.isEmpty():
        raise EvaluationError("agreement needs at least one label")
    return labels.agg(*(c.alias(n) for n, c in agreement(F.col(expected), F.col(actual)).items()))


def calibration_labels(rows: DataFrame) -> DataFrame:
    """(case_id, kind, split, label, expected, actual): every boolean that a calibration row stands for.

    rows: case_id, kind, split, sentence_count, point_count, and expected and actual structs of index lists and relevance.
    """

    def flags(count: str, field: str, label: str) -> Column:
        e, a = F.col(f"expected.{field}"), F.col(f"actual.{field}")
        indices = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(indices, lambda i: F.struct(F.lit(label).alias("label"), F.array_contains(e, i).alias("expected"), F.array_contains(a, i).alias("actual")))

    relevance = F.array(F.struct(F.lit("relevant").alias("label"), F.col("expected.relevant").alias("expected"), F.col("actual.relevant").alias("actual")))
    every = F.concat(
        flags("sentence_count", "supported_sentence_indices", "sentence"), relevance,
        flags("point_count", "available_answer_point_indices", "available"), flags("point_count", "covered_answer_point_indices", "covered"),
    )
    return rows.select("case_id", "kind", "split", F.explode(every).alias("l")).select("case_id", "kind", "split", "l.*")


def calibration_metrics(rows: DataFrame) -> DataFrame:
    """(part, label_count, agreement, cohens_kappa, unsupported precision, recall and false count): overall and of the holdout."""
    labels = calibration_labels(rows)
    sentence = F.col("label") == "sentence"
    e, a = F.col("expected"), F.col("actual")
    hit, false, missed = F.count_if(sentence & ~e & ~a), F.count_if(sentence & e & ~a), F.count_if(sentence & ~e & a)
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), (x + y).cast("double")), F.lit(1.0))
    parts = labels.withColumn("part", F.explode(F.array_compact(F.array(F.lit("overall"), F.when(F.col("split") == "holdout", F.lit("holdout"))))))
    return parts.groupBy("part").agg(
        F.count("*").alias("label_count"), *(c.alias(n) for n, c in agreement(e, a).items()),
        ratio(hit, false).alias("unsupported_precision"), ratio(hit, missed).alias("unsupported_recall"), false.alias("false_unsupported_count"),
    )


def view_metrics(results: DataFrame) -> DataFrame:
    """Per view, over rows with case_id, view and judgment."""
    available, covered = F.sum(F.size("judgment.available_answer_point_indices")), F.sum(F.size("judgment.covered_answer_point_indices"))
    return results.groupBy("view").agg(
        F.count("*").alias("case_count"), F.count_if("judgment.faithful").alias("faithful_cases"), F.count_if("judgment.relevant").alias("relevant_cases"),
        F.count_if("judgment.citation_correct").alias("citation_correct_cases"), available.alias("available_answer_points"), covered.alias("covered_answer_points"),
        F.try_divide(covered, available).alias("conditional_completeness"), F.sum(F.size("judgment.unsupported_claims")).alias("unsupported_claim_count"),
    )


def token_usage(calls: DataFrame) -> DataFrame:
    """Token sums of generations and of judge calls, missing counts as 0. calls: kind, prompt_eval_count, eval_count."""
    n = lambda kind, c: F.coalesce(F.sum(F.when((F.col("kind") == "generation") == F.lit(kind == "generation"), F.coalesce(c, F.lit(0)))), F.lit(0))
    return calls.agg(
        n("generation", "prompt_eval_count").alias("generation_prompt_tokens"), n("generation", "eval_count").alias("generation_output_tokens"),
        n("judge", "prompt_eval_count").alias("judge_prompt_tokens"), n("judge", "eval_count").alias("judge_output_tokens"),
    )


def passes(t: dict = THRESHOLDS) -> Column:
    """Over one row of calibration, holdout, gold and retrieved structs, failures and leakage: whether a report passes."""
    c = F.col
    checks = [c("failures") == 0, c("leakage") == 0]
    for part in ("calibration", "holdout"):
        checks += [c(f"{part}.agreement") >= t["calibration_agreement"], c(f"{part}.cohens_kappa") >= t["calibration_kappa"], c(f"{part}.unsupported_precision") >= t["unsupported_precision"]]
        checks += [c(f"{part}.unsupported_recall") >= t["unsupported_recall"], c(f"{part}.false_unsupported_count") == 0]
    for view in ("gold", "retrieved"):
        checks += [c(f"{view}.{n}") == t["cases"] for n in ("case_count", "faithful_cases", "citation_correct_cases")]
        checks += [c(f"{view}.unsupported_claim_count") == 0, c(f"{view}.relevant_cases") >= t[f"{view}_relevant_cases"], c(f"{view}.covered_answer_points") >= t[f"{view}_complete_points"]]
    checks.append(c("retrieved.conditional_completeness") >= t["retrieved_conditional_completeness"])
    whole = F.lit(True)
    for check in checks:
        whole = whole & F.coalesce(check, F.lit(False))
    return whole


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(case_id, view, metric): what was faithful, or correctly cited, in the baseline and no longer is. Cases the baseline lacks don't count."""
    both = current.select("case_id", "view", F.col("judgment").alias("now")).join(baseline.select("case_id", "view", F.col("judgment").alias("then")), ["case_id", "view"])
    lost = [F.when(F.col(f"then.{f}") & ~F.col(f"now.{f}"), F.lit(m)) for f, m in (("faithful", "faithfulness"), ("citation_correct", "citation_correctness"))]
    return both.select("case_id", "view", F.explode(F.array_compact(F.array(*lost))).alias("metric"))


def metric_deltas(current: DataFrame, baseline: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, delta) of the numbers that both reports have."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select(*keys, "x.*")
    return long(current, "now").join(long(baseline, "then"), [*keys, "metric"]).where("now is not null and then is not null").select(*keys, "metric", (F.col("now") - F.col("then")).alias("delta"))


def rank_metrics(ranked: DataFrame, *, case_id: str = "case_id", k: int = 5) -> DataFrame:
    """Per case, over rows with rank, relevant (boolean) and expected (count): precision, hit and nDCG at k."""
    top = ranked.where(F.col("rank") <= k)
    gain = F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.max("expected"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return top.groupBy(case_id).agg((F.count_if("relevant") / F.lit(k)).alias("precision"), F.max(F.col("relevant").cast("int")).alias("hit"), (gain / ideal).alias("ndcg"))


def combined_exit(code: Column) -> Column:
    """One exit code of several: 1 if any is not 0, 2 or 3; else 2 before 3 before 0."""
    worst = F.max(F.when(code == 0, 0).when(code == 3, 1).when(code == 2, 2).otherwise(3))
    return F.element_at(F.array(F.lit(0), F.lit(3), F.lit(2), F.lit(1)), F.coalesce(worst, F.lit(0)) + 1)
