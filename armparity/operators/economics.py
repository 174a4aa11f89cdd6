"""Cost of calls, run rates, caching and the cost audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.operators import bootstrap as B

PER_MILLION = 1_000_000.0
DAYS_PER_YEAR, HOURS_PER_DAY = 365.0, 24.0
DAYS_PER_MONTH = DAYS_PER_YEAR / 12.0
MULTIPLIERS = (0.5, 1.0, 2.0)


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """USD of each call at uncached list price; the price table is one row per model."""
    priced = calls.join(F.broadcast(prices), "model", "left")
    missing = F.raise_error(F.concat(F.lit("no price for model "), "model")).cast("double")
    usd = F.col("input_tokens") / PER_MILLION * F.col("input_per_1m") + F.col("output_tokens") / PER_MILLION * F.col("output_per_1m")
    return priced.withColumn("usd", F.when(F.col("input_per_1m").isNull(), missing).otherwise(usd))


def paired_costs(calls: DataFrame, prices: DataFrame, by=("task",)) -> DataFrame:
    """Cost of both arms per item where both calls worked; others keep their side for the count."""
    costed = call_cost(calls, prices).withColumn("usd", F.when(F.col("status") == "ok", F.col("usd")))

    def one(which: str) -> Column:
        return F.max(F.when(F.col("arm") == which, F.col("usd")))

    both = F.col("base").isNotNull() & F.col("cand").isNotNull()
    return costed.groupBy(*by, "item_id").agg(one("baseline").alias("base"), one("candidate").alias("cand")).withColumn(
        "side", F.when(both, "both").otherwise("dropped"))


def savings(pairs: DataFrame, by, resamples: int = B.RESAMPLES, seed: int = 20260801, method: str = "histogram") -> DataFrame:
    """Percent saved with its interval, or why there is none; one pass over the pairs.

    Pairs with one side missing carry nulls on both, so they are counted and not costed.
    """
    both = F.col("side") == "both"
    rows = pairs.withColumns({c: F.when(both, F.col(c)) for c in ("base", "cand")})
    reps = (B.hash_replicates(rows, by, "item_id", ("base", "cand"), resamples, seed) if method == "hash"
            else B.histogram_replicates(rows, by, ("base", "cand"), resamples, seed))
    est = B.estimate(reps, by, B.savings_stat("base", "cand"))
    reason = F.when(F.col("n") < 2, F.lit("fewer than two paired items")).when(
        F.coalesce("base_usd", F.lit(0.0)) <= 0, F.lit("baseline costs nothing"))
    out = est.withColumnsRenamed({"sum_base": "base_usd", "sum_cand": "cand_usd"}).withColumn("reason", reason)
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("point", "lo", "hi")})


# --- run rates --------------------------------------------------------------------------

def segment_volumes(calls: DataFrame, by) -> DataFrame:
    """Calls per day and mean tokens of each segment found in a call log."""
    day = F.to_date("ts")
    return calls.groupBy(*by).agg(
        (F.count("*") / F.count_distinct(day)).alias("calls_per_day"),
        F.avg("input_tokens").alias("avg_in"), F.avg("output_tokens").alias("avg_out"))


def confirm_volumes(defaults: DataFrame, supplied: DataFrame, by) -> DataFrame:
    """Supplied volumes over the defaults; ``confirmed`` says where the numbers came from."""
    names = ("calls_per_day", "avg_in", "avg_out")
    over = supplied.select(*by, *[F.col(c).cast("double").alias(f"_{c}") for c in names], F.lit(True).alias("_given"))
    out = defaults.join(over, list(by), "left")
    return out.select(*by, *[F.coalesce(f"_{c}", F.col(c)).alias(c) for c in names], F.coalesce("_given", F.lit(False)).alias("confirmed"))


def unknown_segments(defaults: DataFrame, supplied: DataFrame, by) -> DataFrame:
    """Supplied volumes for segments nobody declared: an error to report, never dropped silently."""
    return supplied.join(defaults.select(*by), list(by), "left_anti")


def cost_per_call(avg_in: Column, avg_out: Column, cached_share: Column, rates: Column) -> Column:
    fresh = avg_in * (1 - cached_share) / PER_MILLION * rates["input"]
    cached = avg_in * cached_share / PER_MILLION * rates["cached"]
    return fresh + cached + avg_out / PER_MILLION * rates["output"]


def cost_grid(volumes: DataFrame, baseline: dict[str, float], candidate: dict[str, float], by,
              multipliers=MULTIPLIERS, cached_share: float = 1.0) -> DataFrame:
    """Run rate per segment, volume multiplier and caching scenario.

    The scenarios are exploded from each segment row, so the grid needs no join.
    """
    def rates(r: dict[str, float]) -> Column:
        return F.struct(*[F.lit(float(r[k])).alias(k) for k in ("input", "output", "cached")])

    grid = volumes.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))).withColumn(
        "_s", F.explode(F.array(*[F.struct(F.lit(n).alias("caching"), F.lit(float(v)).alias("share")) for n, v in (("uncached", 0.0), ("cached", cached_share))])))
    calls = F.col("calls_per_day") * F.col("multiplier")
    daily = {n: cost_per_call(F.col("avg_in"), F.col("avg_out"), F.col("_s.share"), rates(r)) * calls
             for n, r in (("baseline_daily", baseline), ("candidate_daily", candidate))}
    out = grid.withColumns(daily)
    return out.select(
        *by, "multiplier", F.col("_s.caching").alias("caching"), "baseline_daily", "candidate_daily",
        (F.col("baseline_daily") * DAYS_PER_MONTH).alias("baseline_monthly"), (F.col("candidate_daily") * DAYS_PER_MONTH).alias("candidate_monthly"),
        (F.col("baseline_daily") * DAYS_PER_YEAR).alias("baseline_annual"), (F.col("candidate_daily") * DAYS_PER_YEAR).alias("candidate_annual"),
        (100 * F.try_divide(F.col("baseline_daily") - F.col("candidate_daily"), F.nullif("baseline_daily", F.lit(0.0)))).alias("savings_pct"))


def blockers(books: DataFrame, volumes: DataFrame) -> DataFrame:
    """What keeps a cost from being shown, and what clears it."""
    prices = books.filter(~F.col("verified")).select(
        F.concat(F.lit("book "), F.col("book").cast("string")).alias("subject"), F.lit("prices unverified").alias("blocker"), F.lit("verify every rate").alias("clears_when"))
    open_volumes = volumes.filter(~F.col("confirmed")).select(
        "subject", F.lit("volumes unconfirmed").alias("blocker"), F.lit("the owner confirms volumes").alias("clears_when"))
    return prices.unionByName(open_volumes)


# --- caching ----------------------------------------------------------------------------

def cache_breakeven(groups: DataFrame, prices: DataFrame, ttl_hours, storage_rate: float = 1.0) -> DataFrame:
    """Breakeven calls per day for caching each (model, preamble size), per time to live.

    A saving of nothing or less never breaks even.
    """
    priced = groups.join(F.broadcast(prices), "model").withColumn("ttl_hours", F.explode(F.array(*[F.lit(float(t)) for t in ttl_hours])))
    millions = F.col("preamble_tokens") / PER_MILLION
    costed = priced.withColumns({
        "write_usd": millions * F.col("input_per_1m"), "storage_usd": millions * F.col("ttl_hours") * storage_rate,
        "saving_usd": millions * (F.col("input_per_1m") - F.col("cached_per_1m"))})
    pays = F.col("saving_usd") > 0
    reads = F.when(pays, (F.col("write_usd") + F.col("storage_usd")) / F.col("saving_usd"))
    return costed.withColumns({"never_breaks_even": ~pays, "breakeven_calls_per_day": reads * (HOURS_PER_DAY / F.col("ttl_hours"))}).drop(
        "input_per_1m", "output_per_1m", "cached_per_1m")


def net_per_day(breakeven: DataFrame, calls_per_day: Column) -> Column:
    overhead = F.col("write_usd") + F.col("storage_usd")
    return calls_per_day * F.col("saving_usd") - HOURS_PER_DAY / F.col("ttl_hours") * overhead


def shared_preamble(chunks: DataFrame, by, order, limit: int) -> DataFrame:
    """First ``limit`` chunks per group in item order: characters and items used (a top-k)."""
    from pyspark.sql import Window

    first = chunks.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= limit)
    return first.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_distinct("item_id").alias("items"), F.sum(F.length("text")).alias("characters"))


def reconciled(pairs: DataFrame) -> Column:
    """A warm call reads exactly what the cache holds."""
    return F.col("warm_cached").eqNullSafe(F.col("cache_size"))


# --- audit ------------------------------------------------------------------------------

def arm_audit(calls: DataFrame, by) -> DataFrame:
    """Token and cost audit of an arm; ``calls`` carries ``usd``, rates and ``chars``.

    Tokens billed beyond the characters returned are a floor on what was never returned.
    """
    floor = F.greatest(F.lit(0), F.col("output_tokens") - F.col("chars"))
    return calls.filter("status = 'ok'").groupBy(*by).agg(
        F.count("*").alias("calls_ok"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"), F.sum("chars").cast("long").alias("emitted_chars"),
        F.try_divide(F.sum("chars"), F.sum("output_tokens")).alias("chars_per_output_token"),
        F.count_if(floor > 0).alias("calls_billed_over_emitted"), F.sum(floor).cast("long").alias("unreturned_floor"),
        F.try_divide(F.sum(floor), F.sum("output_tokens")).alias("unreturned_share"),
        F.sum(F.col("input_tokens") / PER_MILLION * F.col("input_per_1m")).alias("input_usd"),
        F.sum(F.col("output_tokens") / PER_MILLION * F.col("output_per_1m")).alias("output_usd"), F.sum("usd").alias("usd"))


def rate_ratios(prices: DataFrame, reference: DataFrame, name: str, key) -> DataFrame:
    """Each model's rates relative to a reference row of its group."""
    ref = reference.select(*key, F.col("input").alias("_i"), F.col("output").alias("_o"))
    return prices.join(ref, list(key), "left").withColumns({
        f"{name}_input": F.try_divide("input", F.nullif("_i", F.lit(0.0))), f"{name}_output": F.try_divide("output", F.nullif("_o", F.lit(0.0)))}).drop("_i", "_o")


def breakeven_rates(audit: DataFrame, target: float) -> DataFrame:
    """What output rate or scale would reach the savings target, and the cost at the baseline's output."""
    base = audit.filter("arm = 'baseline'").select("task", *[F.col(c).alias(f"b_{c}") for c in ("input_tokens", "output_tokens", "usd")])
    cand = audit.filter("arm = 'candidate'").select("task", *[F.col(c).alias(f"c_{c}") for c in ("input_tokens", "output_tokens", "usd", "input_usd", "output_usd")])
    both = base.join(cand, "task")
    budget = F.col("b_usd") * (1 - target)
    rate = F.col("c_output_usd") / F.col("c_output_tokens")
    capped = F.col("c_input_usd") + F.col("b_output_tokens") * rate
    remaining = budget - F.col("c_input_usd")
    return both.select(
        "task", (F.col("c_output_tokens") / F.col("b_output_tokens")).alias("output_ratio"), (F.col("c_input_tokens") / F.col("b_input_tokens")).alias("input_ratio"),
        F.when((remaining > 0) & (F.col("c_output_tokens") > 0), remaining / F.col("c_output_tokens") * PER_MILLION).alias("output_rate_needed"),
        F.try_divide(budget, F.col("c_usd")).alias("scale_needed"), ((F.col("b_usd") - capped) / F.col("b_usd") * 100).alias("counterfactual_savings_pct"))


def cost_panel(pairs: DataFrame, by) -> DataFrame:
    """Configurations side by side over the items each one shares with the baseline."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("b_usd").alias("baseline_usd"), F.sum("c_usd").alias("candidate_usd"),
        F.sum("c_out").alias("output_tokens"), F.sum("b_out").alias("baseline_output_tokens"),
        F.try_divide(F.sum("c_out"), F.sum("b_out")).alias("output_ratio"),
        (100 * F.try_divide(F.sum("b_usd") - F.sum("c_usd"), F.sum("b_usd"))).alias("savings_pct"))


def project(calls: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Measured tokens at another model's rates: a projection, labelled as one."""
    return call_cost(calls.withColumn("measured_model", F.col("model")).withColumn("model", F.lit(model)), prices).withColumn("basis", F.lit("projection"))
