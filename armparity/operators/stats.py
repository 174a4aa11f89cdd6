"""Paired samples, estimates, agreement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.operators import bootstrap as B


def pair_samples(long: DataFrame, by, item: str = "item_id", value: str = "value", arm: str = "arm",
                 baseline: str = "baseline", candidate: str = "candidate") -> DataFrame:
    """Both arms of each item on one row, one-sided items kept with their side named.

    One scan and one shuffle instead of a join of two filtered scans; an item measured
    twice in one arm is an error.
    """
    def one(which: str) -> Column:
        return F.max(F.when(F.col(arm) == which, F.col(value)))

    def seen(which: str) -> Column:
        return F.count(F.when((F.col(arm) == which) & F.col(value).isNotNull(), 1))

    grouped = long.groupBy(*by, item).agg(
        one(baseline).alias("base"), one(candidate).alias("cand"), F.greatest(seen(baseline), seen(candidate)).alias("_n"))
    side = F.when(F.col("base").isNotNull() & F.col("cand").isNotNull(), "both").when(
        F.col("base").isNotNull(), "baseline_only").when(F.col("cand").isNotNull(), "candidate_only")
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate item in a sample: "), F.col(item).cast("string"))).cast("string")).otherwise(side)
    return grouped.withColumn("side", checked).filter("side is not null").drop("_n")


def _replicates(rows: DataFrame, by, key: str, values, resamples: int, seed: int, method: str) -> DataFrame:
    if method == "hash":
        return B.hash_replicates(rows, by, key, values, resamples, seed)
    if method == "histogram":
        return B.histogram_replicates(rows, by, values, resamples, seed)
    raise ValueError(f"unknown bootstrap method {method!r}")


def paired_delta(pairs: DataFrame, by, key: str = "item_id", resamples: int = B.RESAMPLES, seed: int = 20260801,
                 method: str = "histogram") -> DataFrame:
    """Estimate of mean(candidate) - mean(baseline) drawing the same items in both arms."""
    return B.estimate(_replicates(pairs, by, key, ("base", "cand"), resamples, seed, method), by, B.delta_stat("base", "cand"))


def mean_estimate(values: DataFrame, by, key: str = "item_id", value: str = "value", resamples: int = B.RESAMPLES,
                  seed: int = 20260801, method: str = "histogram") -> DataFrame:
    """Mean with its interval; rows without a value are counted as dropped."""
    return B.estimate(_replicates(values, by, key, (value,), resamples, seed, method), by, B.mean_stat(value))


#: Fixed rescalings: only a fraction may become percentage points or percent.
RESCALE = {("fraction", "percentage_points"): 100.0, ("fraction", "percent"): 100.0}


def rescale(est: DataFrame, target: str) -> DataFrame:
    """Rescaled estimates; any other change of unit is rejected with a reason."""
    factor = F.lit(None).cast("double")
    for (source, to), f in RESCALE.items():
        if to == target:
            factor = F.when(F.col("unit") == source, F.lit(f)).otherwise(factor)
    factor = F.when(F.col("unit") == target, F.lit(1.0)).otherwise(factor)
    reject = F.when(factor.isNull(), F.concat(F.lit("cannot rescale "), "unit", F.lit(f" to {target}")))
    return est.withColumns({**{c: F.col(c) * factor for c in ("point", "lo", "hi")},
                            "reject": reject, "unit": F.when(factor.isNotNull(), F.lit(target)).otherwise(F.col("unit"))})


def kappa(labels: DataFrame, by, a: Column, b: Column) -> DataFrame:
    """Raw agreement, pass rates and Cohen's kappa in one pass; undefined is null, not 0."""
    sums = labels.select(*by, a.cast("double").alias("_a"), b.cast("double").alias("_b")).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"),
        F.avg("_a").alias("rate_a"), F.avg("_b").alias("rate_b"))
    return with_kappa(sums)


def with_kappa(sums: DataFrame) -> DataFrame:
    """Adds kappa and its caveat to ``n, agreement, rate_a, rate_b``."""
    chance = F.col("rate_a") * F.col("rate_b") + (1 - F.col("rate_a")) * (1 - F.col("rate_b"))
    defined = chance < 1.0 - 1e-12
    note = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.lit("no pairs"))
        .when(~defined, F.lit("undefined: one label only")).when(chance >= 0.8, F.lit("deflated by prevalence"))
    )
    return sums.withColumns({
        "kappa": F.when(defined, (F.col("agreement") - chance) / (1 - chance)), "kappa_note": note})


def ceiling(long: DataFrame, by) -> DataFrame:
    """Metrics whose both arms hold one identical value: a point, not a tight interval."""
    spread = long.filter("value is not null").groupBy(*by).agg(
        F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count_distinct("arm").alias("arms"))
    return spread.withColumn("at_ceiling", (F.col("arms") == 2) & (F.col("lowest") == F.col("highest"))).drop("arms")
