"""Rubric verdicts: parsing, repeats folded to items, failure clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.functions.payload import keys_of

VERDICT = ("criteria array<struct<criterion_id:string,passed:boolean,rationale:string>>, overall_rationale string")


def rubric_ids(own: Column, task: Column, gold: Column, judged_fields) -> Column:
    """An item's criteria, plus one per free-text field its gold answer states."""
    extra = F.filter(
        F.array(*[F.when(gold[f].isNotNull(), F.lit(f"{f}_correct")) for f in judged_fields]), lambda x: x.isNotNull())
    return F.when(task == "feature_extractor", F.concat(own, extra)).otherwise(own)


def candidate_text(payload_json: Column, text: Column) -> Column:
    """What the judge is shown: the structured answer, else non-blank text, else nothing."""
    return F.coalesce(payload_json, F.when(F.trim(text) != "", text))


def scoring_requests(calls: DataFrame, repeats: int) -> DataFrame:
    """One scoring request per call and repeat."""
    return calls.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))


def parse_verdicts(raw: DataFrame, rubric: Column) -> DataFrame:
    """Judge answers to verdicts; anything but exactly the rubric, once each, is an error."""
    body = F.coalesce("payload_json", "tool_args", F.col("output_text"))
    staged = raw.withColumn("_body", body).withColumns({
        "_keys": keys_of(F.col("_body")), "_v": F.from_json("_body", VERDICT), "_want": F.array_sort(rubric)})
    criteria = F.col("_v.criteria")
    got = F.array_sort(F.transform(criteria, lambda c: c["criterion_id"]))
    reason = (
        F.when(F.col("status") == "error", F.concat(F.lit("judge call failed: "), F.coalesce("error", F.lit("unknown"))))
        .when(F.col("_keys").isNull(), F.lit("no JSON object"))
        .when(F.coalesce(F.size(criteria), F.lit(0)) <= 0, F.lit("no criteria array"))
        .when(F.exists(criteria, lambda c: c["criterion_id"].isNull() | c["passed"].isNull() | c["rationale"].isNull()),
              F.lit("unparseable criterion"))
        .when(got != F.col("_want"), F.lit("criteria differ from the rubric"))
        .when(F.exists(criteria, lambda c: F.trim(c["rationale"]) == ""), F.lit("blank rationale"))
    )
    passed = F.size(F.filter(criteria, lambda c: c["passed"]))
    kept = [c for c in raw.columns if c not in ("status", "error", "payload_json", "tool_args", "output_text")]
    return staged.withColumn("reject", reason).select(
        *kept,
        F.when(F.col("reject").isNull(), "ok").otherwise("error").alias("status"),
        F.when(F.col("reject").isNull(), F.try_divide(passed, F.size(criteria))).alias("score"),
        F.when(F.col("reject").isNull(), criteria).alias("criteria"),
        F.col("_v.overall_rationale").alias("overall"), "reject",
    )


def cell_score(criteria: Column) -> Column:
    return F.try_divide(F.size(F.filter(criteria, lambda c: c["passed"])), F.size(criteria))


def repeat_scores(cells: DataFrame, by=("task", "arm", "item_id")) -> DataFrame:
    """Scores of an item in repeat order, null where the repeat failed; repeats are few by design."""
    packed = F.array_sort(F.collect_list(F.struct("repeat", "score")))
    return cells.groupBy(*by).agg(F.transform(packed, lambda x: x["score"]).alias("scores"))


def fold_repeats(cells: DataFrame, by=("task", "arm"), item: str = "item_id") -> DataFrame:
    """One row per item: mean over the repeats that worked, and how they spread."""
    return cells.groupBy(*by, item).agg(
        F.avg("score").alias("item_mean"), F.count("score").alias("n_good"), F.count("*").alias("n_repeats"),
        F.when(F.count("score") >= 2, F.stddev_samp("score")).alias("sd"),
        F.when(F.count("score") >= 2, F.max("score") - F.min("score")).alias("spread"),
    )


def aggregate_repeats(items: DataFrame, expected_k: int, by=("task", "arm")) -> DataFrame:
    """Arm summary of folded items, with the judge's own noise kept visible."""
    return items.groupBy(*by).agg(
        F.count("item_mean").alias("n_items"), F.avg("item_mean").alias("mean_score"),
        F.sum(F.col("n_repeats") - F.col("n_good")).alias("failed_repeats"),
        F.count_if(F.col("item_mean").isNull()).alias("dropped_items"),
        F.count_if((F.col("n_good") > 0) & (F.col("n_good") < expected_k)).alias("short_items"),
        F.avg("sd").alias("mean_within_sd"), F.max("spread").alias("max_range"),
        F.avg((F.col("spread") == 0).cast("double")).alias("full_agreement_rate"),
    )


def failed_criteria(cells: DataFrame, by=("task", "arm")) -> DataFrame:
    """Distinct (criterion, item) failures; one row each, so no cluster is held in one place."""
    rows = cells.filter("status = 'ok'").select(*by, "item_id", F.explode("criteria").alias("c"))
    return rows.filter(~F.col("c.passed")).select(*by, F.col("c.criterion_id").alias("criterion_id"), "item_id").distinct()


def failure_clusters(cells: DataFrame, by=("task", "arm")) -> DataFrame:
    return failed_criteria(cells, by).groupBy(*by, "criterion_id").agg(F.count("*").alias("n_items"))
