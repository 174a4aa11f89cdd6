"""Latency summaries, regions and when two latencies may be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armparity.operators import bootstrap as B
from armparity.operators import order_statistics as OS
from armparity.operators import ranking as R


def latency_stats(calls: DataFrame, by, total: str = "total_ms", first: str = "ttft_ms") -> DataFrame:
    """p50 and p95 of both timings with what each was measured on.

    Timings are whole milliseconds, so each group's state is its distinct values.
    """
    by = list(by)
    counts = calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.count(total).alias("n_total"), F.count(first).alias("n_ttft"))
    both = calls.select(*by, F.inline(F.array(
        F.struct(F.lit("total").alias("_what"), F.col(total).alias("_ms")), F.struct(F.lit("ttft").alias("_what"), F.col(first).alias("_ms")))))
    pct = R.percentiles_of_counts(R.value_counts(both, [*by, "_what"], "_ms"), [*by, "_what"], "_ms", {"p50": 0.5, "p95": 0.95})
    wide = pct.groupBy(*by).agg(*[
        F.max(F.when(F.col("_what") == w, F.col(p))).alias(f"{w}_{p}") for w in ("total", "ttft") for p in ("p50", "p95")])
    return counts.join(wide, by, "left")


def arm_region(models: DataFrame, env: dict[str, dict[str, str]], default: Column) -> DataFrame:
    """Region of a model and where that came from: its pin, its provider's settings, the customer.

    ``env`` maps provider to its ordered settings; a provider expected to have its own
    setting first is unverified when only a later one answers.
    """
    region, source = default, F.lit("customer profile")
    for provider, settings in env.items():
        own = next(iter(settings), None)
        for name, value in reversed(list(settings.items())):
            hit = (F.col("provider") == provider) & F.lit(value is not None)
            note = f"env:{name}" + ("" if name == own else " (unverified)")
            region = F.when(hit, F.lit(value)).otherwise(region)
            source = F.when(hit, F.lit(note)).otherwise(source)
    pinned = F.col("pinned_region").isNotNull()
    return models.withColumns({"region": F.when(pinned, F.col("pinned_region")).otherwise(region),
                               "region_source": F.when(pinned, F.lit("model registry")).otherwise(source)})


def disclosure(baseline_region: Column, candidate_region: Column, baseline_source: Column) -> Column:
    return (
        F.when(baseline_region != candidate_region, F.concat(F.lit("CROSS-REGION: "), baseline_region, F.lit(" vs "), candidate_region))
        .when(F.contains(baseline_source, F.lit("unverified")), F.concat(F.lit("REGION UNVERIFIED: "), baseline_region))
        .otherwise(F.concat(F.lit("Same region ("), baseline_region, F.lit(")"))))


def p95_interval(calls: DataFrame, by, resamples: int = B.RESAMPLES, method: str = "order", key: str = "call_id") -> DataFrame:
    """``n``, ``point``, ``lo``, ``hi`` of the 95th percentile per group: by drawn order statistics, or with ``hash`` weights as SQL can draw them."""
    by = list(by)
    if method == "hash":
        return B.interval(B.hash_percentile_replicates(calls, by, key, "total_ms", 0.95, resamples), by, F.col("stat"))
    return B.interval(OS.percentile_replicates(R.value_counts(calls, by, "total_ms"), by, "total_ms", 0.95, resamples), by, F.col("stat"))


def probe_summary(calls: DataFrame, by, resamples: int = B.RESAMPLES, method: str = "order") -> DataFrame:
    """A probe's calls, percentiles and p95 interval; one observation has no interval."""
    by = list(by)
    stats = latency_stats(calls, by).join(
        calls.groupBy(*by).agg(F.count_if(F.col("status") == "ok").alias("calls_ok"), F.count_if(F.col("status") != "ok").alias("calls_error")), by)
    ci = p95_interval(calls, by, resamples, method)
    out = stats.join(ci.select(*by, "lo", "hi"), by, "left")
    few = F.col("n_total") < 2
    return out.withColumns({"lo": F.when(~few, F.col("lo")), "hi": F.when(~few, F.col("hi")),
                            "reason": F.when(few, F.lit("fewer than two timings"))})


def eligible_probes(probes: DataFrame, declared_region: Column, candidate: str, unit: Column) -> DataFrame:
    """A probe may feed the latency gate only if one region served both arms of the right candidate."""
    reject = (
        F.when(F.col("baseline_region").isNull() | F.col("candidate_region").isNull(), F.lit("one arm was not probed"))
        .when((F.col("baseline_region") != F.col("candidate_region")) | (F.col("baseline_region") != declared_region), F.lit("more than one region"))
        .when(unit != "ms", F.lit("not in milliseconds")).when(F.col("candidate_model") != candidate, F.lit("another candidate")))
    return probes.withColumn("reject", reject)


def drift(p95: DataFrame, by, on: str, value: str = "p95") -> DataFrame:
    """Change of the same arm's p95 since the previous probe; one row per probe, so groups are short."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(on))
    return p95.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous"))
