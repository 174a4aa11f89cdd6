"""Report tables over result frames; none of them grows with the call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.functions import render, text


def metric_rank(order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric"))


def metrics_frame(metrics: DataFrame, order: list[str]) -> DataFrame:
    """One row per (task, arm, metric) in the caller's order, exclusions beside the mean."""
    chosen = metrics.withColumn("rank", metric_rank(order)).filter("rank > 0")
    return chosen.withColumn("shown", F.coalesce(F.call_function("format_number", "mean", F.lit("0.000")), F.lit(render.NOT_MEASURED)))


def judge_frame(judge: DataFrame) -> DataFrame:
    """A judged score never without its n and split."""
    score = F.coalesce(F.call_function("format_number", "mean_score", F.lit("0.000")), F.lit(render.NOT_MEASURED))
    return judge.withColumn("shown", F.concat(score, F.lit(" (judged n="), F.col("n_items").cast("string"), F.lit(", split="), "split", F.lit(")")))


def ablation_frame(records: DataFrame, metric: str, fallback: str) -> DataFrame:
    value = F.coalesce(metric, fallback)
    return records.withColumns({"value": value, "metric": F.when(F.col(metric).isNotNull(), metric).when(F.col(fallback).isNotNull(), fallback),
                                "state": F.when(F.col("status") == "measured", "measured").otherwise("no recordings")})


def latency_frame(stats: DataFrame, metrics: list[str], by=("task", "arm")) -> DataFrame:
    return stats.unpivot(list(by), metrics, "metric", "value")


def gate_table(evidence: DataFrame, checks: DataFrame, gates: DataFrame, prices_verified: Column, same_region: Column) -> DataFrame:
    """Segment x gate rows with bound, measured text, tested bound and result."""
    shown = render.estimate_text(F.col("point"), F.col("lo"), F.col("hi"), F.col("unit"))
    paired = (F.col("unit") == "percentage_points") & F.col("point").isNotNull()
    cell = (
        F.when(paired, render.paired_delta_text(shown, F.col("n"), F.col("dropped")))
        .when(F.col("gate") == "cost_savings_pct", render.cost_cell(prices_verified, F.when(F.col("point").isNotNull(), shown)))
        .when(F.col("gate") == "latency_p95", render.latency_cell(F.when(F.col("point").isNotNull(), shown), same_region, F.lit("global")))
        .otherwise(shown))
    result = F.when(F.col("passed").isNull(), "not evaluated").when(F.col("passed"), "PASS").when(
        F.col("alt_passed"), F.concat(F.lit("PASS (by alternative clause: "), "alt_summary", F.lit(")"))).otherwise("FAIL")
    rules = F.broadcast(gates.select("gate", "ordinal", "bound"))
    tested = checks.select("task", "gate", "passed", "alt_passed", "alt_summary", "compared_bound")
    return evidence.join(rules, "gate").join(tested, ["task", "gate"], "left").select(
        "task", "ordinal", "gate", "bound", cell.alias("measured"), "compared_bound", result.alias("result"), "reason")


def lineage_banner(calls: DataFrame, by=("task",)) -> DataFrame:
    s = calls.groupBy(*by).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count("*").alias("_n"), F.count_distinct("model").alias("_m"))
    return s.select(*by, F.concat(F.lit("replayed "), F.col("_n").cast("string"), F.lit(" calls over "), F.col("_m").cast("string"), F.lit(" models; "),
                                  text.sgt_window(F.col("_a"), F.col("_b"))).alias("banner"))


def models_page(models: DataFrame, windows: DataFrame, roles: list[str]) -> DataFrame:
    """Model table in role order with its recording window; ``never called`` if none."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role")), F.lit(0)), F.lit(len(roles) + 1))
    window = F.coalesce(text.sgt_window(F.col("first_ts"), F.col("last_ts")), F.lit("never called"))
    return models.join(windows, "model", "left").select("model", "role", rank.cast("int").alias("rank"), window.alias("recorded"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


def footer_line(report: DataFrame) -> DataFrame:
    """One part per task of the second-judge line."""
    shown = F.coalesce(F.concat(F.call_function("format_number", F.col("agreement") * 100, F.lit("0.0")), F.lit("%")), F.lit(render.NOT_MEASURED))
    k = F.coalesce(F.concat(F.lit("kappa "), F.call_function("format_number", "kappa", F.lit("0.000"))), F.lit("kappa undefined"))
    return report.filter("arm is null").select("task", F.concat("task", F.lit(" "), shown, F.lit(" ("), k, F.lit(", "), "verdict", F.lit(")")).alias("line"))
