"""Intervals, pairing and agreement statistics."""

from pyspark.sql import functions as F

from armparity.operators import bootstrap as B
from armparity.operators import judge as J
from armparity.operators import latency as L
from armparity.operators import metrics as M
from armparity.operators import ranking as R
from armparity.operators import stats as S
from armparity.plans.q_judge import FOLDED, _CV, scored_cells
from armparity.plans.q_metrics import LONG, _pairs
from armparity.plans.registry import query

_VIEWS = ("calls", "items")
SEED, REPS = 20260801, 96


def duck_replicates(name, frm, by, key, values, reps=REPS, seed=SEED):
    """DuckDB text of the hash replicates, written independently of the Spark form."""
    sums = ", ".join(f"sum(w * {v}) AS s_{v}" for v in values)
    steps = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in B.POISSON_STEPS)
    return f""", {name}_u AS (SELECT {by}, {', '.join(values)}, b * 8 + j AS replicate,
    CAST('0x' || substr(md5(concat('{seed}|', b, '|', {key})), CAST(1 + 4 * j AS INTEGER), 4) AS BIGINT) AS u
  FROM {frm}, (SELECT unnest(range({-(-reps // 8)})) AS b), (SELECT unnest(range(8)) AS j)),
 {name}_r AS (SELECT {by}, replicate, sum(w) AS sw, {sums} FROM (SELECT *, {steps} AS w FROM {name}_u) GROUP BY ALL)"""


def q(expr, p):
    return f"round(quantile_cont({expr}, {p}), 9)"


@query("sta_mean", " SELECT task, arm, avg(total_ms) AS mean_ms, count(total_ms) AS n FROM calls GROUP BY ALL", ("calls",))
def sta_mean(src):
    """Mean of what was measured; no rows, no mean."""
    return src.view("calls").filter("total_ms is not null").groupBy("task", "arm").agg(
        (F.sum("total_ms") / F.count("*")).alias("mean_ms"), F.count("*").alias("n"))


@query("sta_bootstrap_mean", FOLDED + ", src AS (SELECT task, arm, item_id, item_mean AS value FROM folded WHERE item_mean IS NOT NULL)"
       + duck_replicates("m", "src", "task, arm", "item_id", ["value"]) + f"""
 SELECT p.*, lo, hi FROM (SELECT task, arm, count(*) AS n, round(avg(value), 9) AS point FROM src GROUP BY ALL) p
 JOIN (SELECT task, arm, {q('s_value / sw', 0.025)} AS lo, {q('s_value / sw', 0.975)} AS hi FROM m_r GROUP BY ALL) USING (task, arm)""", _CV)
def sta_bootstrap_mean(src):
    items = J.fold_repeats(scored_cells(src, "gated")).withColumnRenamed("item_mean", "value")
    est = S.mean_estimate(items, ("task", "arm"), resamples=REPS, method="hash")
    return est.select("task", "arm", "n", *[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


@query("jdg_arm_report", FOLDED + ", sp AS (SELECT *, CASE WHEN item_id % 5 < 2 THEN 'core' ELSE 'rest' END AS split, item_mean AS value FROM folded), spv AS (SELECT * FROM sp WHERE value IS NOT NULL)"
       + duck_replicates("j", "spv", "task, arm, split", "item_id", ["value"]) + f"""
 SELECT * FROM (SELECT task, arm, split, count(item_mean) AS n_items, round(avg(item_mean), 9) AS mean_score, CAST(sum(n_repeats - n_good) AS BIGINT) AS failed_repeats,
   count(*) FILTER (WHERE item_mean IS NULL) AS dropped_items, count(*) FILTER (WHERE n_good > 0 AND n_good < 2) AS short_items, round(avg(sd), 9) AS mean_within_sd,
   round(max(spread), 9) AS max_range, round(avg(CAST(spread = 0 AS INTEGER)), 9) AS full_agreement_rate FROM sp GROUP BY ALL)
 JOIN (SELECT task, arm, split, {q('s_value / sw', 0.025)} AS lo, {q('s_value / sw', 0.975)} AS hi FROM j_r GROUP BY ALL) USING (task, arm, split)""", _CV)
def jdg_arm_report(src):
    """Judge report per arm and split."""
    items = J.fold_repeats(scored_cells(src, "gated"), ("task", "arm")).withColumn(
        "split", F.when(F.col("item_id") % 5 < 2, "core").otherwise("rest"))
    by = ("task", "arm", "split")
    est = S.mean_estimate(items.withColumnRenamed("item_mean", "value"), by, resamples=REPS, method="hash")
    out = J.aggregate_repeats(items, 2, by).join(est.select(*by, "lo", "hi"), list(by))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_score", "mean_within_sd", "max_range", "full_agreement_rate", "lo", "hi")})


PAIRS = LONG + """, pairs AS (SELECT task, metric, item_id, max(value) FILTER (WHERE arm = 'baseline') AS base, max(value) FILTER (WHERE arm = 'candidate') AS cand
  FROM outcomes WHERE value IS NOT NULL GROUP BY ALL)"""


@query("sta_pair_samples", PAIRS + """ SELECT task, metric, item_id, round(base, 9) AS base, round(cand, 9) AS cand, CASE WHEN cand IS NULL THEN 'baseline_only'
  WHEN base IS NULL THEN 'candidate_only' ELSE 'both' END AS side FROM pairs""", _VIEWS)
def sta_pair_samples(src):
    pairs = S.pair_samples(M.outcomes(_pairs(src)), ("task", "metric"))
    return pairs.withColumns({"base": F.round("base", 9), "cand": F.round("cand", 9)})


@query("sta_paired_delta", PAIRS + ", both_arms AS (SELECT * FROM pairs WHERE base IS NOT NULL AND cand IS NOT NULL)"
       + duck_replicates("d", "both_arms", "task, metric", "item_id", ["base", "cand"]) + f"""
 SELECT p.*, lo, hi FROM (SELECT task, metric, count(base + cand) AS n, count(*) - count(base + cand) AS dropped, round(avg(cand - base), 9) AS point FROM pairs GROUP BY ALL) p
 JOIN (SELECT task, metric, {q('(s_cand - s_base) / sw', 0.025)} AS lo, {q('(s_cand - s_base) / sw', 0.975)} AS hi FROM d_r GROUP BY ALL) USING (task, metric)""", _VIEWS)
def sta_paired_delta(src):
    pairs = S.pair_samples(M.outcomes(_pairs(src)), ("task", "metric"))
    est = S.paired_delta(pairs, ("task", "metric"), resamples=REPS, method="hash")
    return est.select("task", "metric", "n", "dropped", *[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


def sound(spread):
    """The interval holds the point and is about as wide as the normal law says of ``spread``, the statistic's standard error; a constant has none."""
    wide = (F.col("hi") - F.col("lo")) / spread
    return ((F.col("lo") <= F.col("point")) & (F.col("point") <= F.col("hi")) & F.when(spread > 1e-12, wide.between(2.6, 5.2)).otherwise(F.col("hi") - F.col("lo") < 1e-9)).alias("sound")


@query("sta_paired_delta_counts", PAIRS + """ SELECT task, metric, count(base + cand) AS n, count(*) - count(base + cand) AS dropped, round(avg(cand - base), 9) AS point, 10000 AS resamples, true AS sound
 FROM pairs GROUP BY ALL HAVING count(base + cand) > 1""", _VIEWS)
def sta_paired_delta_counts(src):
    """The default interval: 10,000 replicates drawn from counts of distinct pairs."""
    pairs = S.pair_samples(M.outcomes(_pairs(src)), ("task", "metric"))
    d = F.col("cand") - F.col("base")
    spread = pairs.groupBy("task", "metric").agg((F.stddev_pop(d) / F.sqrt(F.count(d))).alias("se"))
    est = S.paired_delta(pairs, ("task", "metric")).filter("n > 1").join(spread, ["task", "metric"])
    return est.select("task", "metric", "n", "dropped", F.round("point", 9).alias("point"), "resamples", sound(F.col("se")))


def usd_pairs(src):
    from armparity.operators import economics as E

    return E.paired_costs(src.view("calls"), src.view("prices"))


USD = """, usd AS (SELECT c.*, input_tokens / 1e6 * input_per_1m + output_tokens / 1e6 * output_per_1m AS usd FROM calls c JOIN prices USING (model)),
 cost_pairs AS (SELECT task, item_id, max(usd) FILTER (WHERE arm = 'baseline') AS base, max(usd) FILTER (WHERE arm = 'candidate') AS cand
   FROM usd WHERE status = 'ok' GROUP BY ALL HAVING count(DISTINCT arm) = 2)"""


@query("sta_savings", USD + duck_replicates("s", "cost_pairs", "task", "item_id", ["base", "cand"]) + f"""
 SELECT p.*, lo, hi FROM (SELECT task, count(*) AS n, round(100 * (sum(base) - sum(cand)) / sum(base), 7) AS point FROM cost_pairs GROUP BY ALL) p
 JOIN (SELECT task, round(quantile_cont(100 * (s_base - s_cand) / s_base, 0.025), 7) AS lo, round(quantile_cont(100 * (s_base - s_cand) / s_base, 0.975), 7) AS hi FROM s_r WHERE s_base > 0 GROUP BY ALL) USING (task)""", ("calls", "prices"))
def sta_savings(src):
    from armparity.operators import economics as E

    est = E.savings(usd_pairs(src), ("task",), resamples=REPS, method="hash")
    return est.select("task", "n", *[F.round(c, 7).alias(c) for c in ("point", "lo", "hi")])


@query("sta_savings_counts", USD + " SELECT task, count(*) AS n, round(100 * (sum(base) - sum(cand)) / sum(base), 7) AS point, 10000 AS resamples, true AS sound FROM cost_pairs GROUP BY ALL", ("calls", "prices"))
def sta_savings_counts(src):
    from armparity.operators import economics as E

    pairs = usd_pairs(src).filter("side = 'both'")
    # the ratio's error by its residuals around the line through the origin
    ratio = pairs.groupBy("task").agg((F.sum("cand") / F.sum("base")).alias("r"))
    spread = pairs.join(ratio, "task").groupBy("task").agg((100 * F.stddev_pop(F.col("cand") - F.col("r") * F.col("base")) * F.sqrt(F.count("*")) / F.sum("base")).alias("se"))
    est = E.savings(usd_pairs(src), ("task",)).join(spread, "task")
    return est.select("task", "n", F.round("point", 7).alias("point"), "resamples", sound(F.col("se")))


P95_REPS = 24


def duck_p95(by, where):
    """DuckDB text of hash replicates ``p95_r`` of the 95th percentile of ``total_ms``."""
    return f""", p95_x AS (SELECT {by}, total_ms, b * 8 + j AS replicate, CAST('0x' || substr(md5(concat('{SEED}|', b, '|', call_id)), CAST(1 + 4 * j AS INTEGER), 4) AS BIGINT) AS u
  FROM calls, (SELECT unnest(range({-(-P95_REPS // 8)})) AS b), (SELECT unnest(range(8)) AS j) WHERE total_ms IS NOT NULL AND {where}),
 p95_y AS (SELECT {by}, replicate, total_ms, unnest(range({' + '.join(f'CAST(u >= {s} AS INTEGER)' for s in B.POISSON_STEPS)})) AS copy FROM p95_x),
 p95_r AS (SELECT {by}, replicate, quantile_cont(total_ms, 0.95) AS stat FROM p95_y GROUP BY ALL)"""


@query("sta_p95", duck_p95("task, arm", "status = 'ok'") + """
 SELECT task, arm, round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi FROM p95_r GROUP BY ALL""", ("calls",))
def sta_p95(src):
    calls = src.view("calls").filter("status = 'ok'")
    return L.p95_interval(calls, ("task", "arm"), P95_REPS, "hash").select("task", "arm", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("sta_p95_counts", " SELECT task, arm, count(*) AS n, round(quantile_cont(total_ms, 0.95), 6) AS point, 10000 AS resamples, true AS lo_sound, true AS hi_sound FROM calls WHERE total_ms IS NOT NULL AND status = 'ok' GROUP BY ALL", ("calls",))
def sta_p95_counts(src):
    """The default interval, with a check of where in the sample its bounds lie."""
    calls = src.view("calls").filter("status = 'ok' and total_ms is not null")
    out = L.p95_interval(calls, ("task", "arm"))
    below = calls.join(out, ["task", "arm"]).groupBy("task", "arm").agg(
        *[F.avg((F.col("total_ms") <= F.col(b)).cast("double")).alias(f"at_{b}") for b in ("lo", "hi")])
    error = F.sqrt(F.lit(0.95 * 0.05) / F.col("n"))
    return out.join(below, ["task", "arm"]).select(
        "task", "arm", "n", F.round("point", 6).alias("point"), "resamples", ((F.col("at_lo") - 0.95) / error).between(-2.9, -1.0).alias("lo_sound"),
        ((F.col("at_hi") - 0.95) / error).between(1.0, 2.9).alias("hi_sound"))


@query("sta_percentile", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
 round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY ALL""")
def sta_percentile(src):
    out = R.exact_percentiles(src.table("lineitem"), ("l_returnflag",), "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p999": 0.999})
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p999")})


@query("sta_rescale", """ SELECT task, arm, unit_to AS unit, round(m * f, 9) AS point, CASE WHEN f IS NULL THEN concat('cannot rescale ', unit, ' to percentage_points') END AS reject FROM (
  SELECT *, CASE unit WHEN 'fraction' THEN 100.0 END AS f, CASE unit WHEN 'fraction' THEN 'percentage_points' ELSE unit END AS unit_to FROM (
  SELECT task, arm, CASE WHEN arm = 'baseline' THEN 'fraction' ELSE 'ms' END AS unit, avg(CASE WHEN arm = 'baseline' THEN CAST(status = 'ok' AS INTEGER) ELSE total_ms END) AS m FROM calls GROUP BY ALL))""", ("calls",))
def sta_rescale(src):
    base = F.col("arm") == "baseline"
    v = F.when(base, (F.col("status") == "ok").cast("double")).otherwise(F.col("total_ms"))
    est = src.view("calls").groupBy("task", "arm").agg(F.avg(v).alias("point")).withColumns({
        "unit": F.when(base, "fraction").otherwise("ms"), "lo": F.col("point"), "hi": F.col("point")})
    return S.rescale(est, "percentage_points").select("task", "arm", "unit", F.round("point", 9).alias("point"), "reject")


@query("sta_kappa", """WITH s AS (SELECT source, count(*) AS n, avg(CAST((quality = 1) = (toxic = 0) AS INTEGER)) AS agreement, avg(CAST(quality = 1 AS INTEGER)) AS a, avg(CAST(toxic = 0 AS INTEGER)) AS b
  FROM labels JOIN documents USING (doc_id) GROUP BY ALL), e AS (SELECT *, a * b + (1 - a) * (1 - b) AS ch FROM s)
SELECT source, n, round(agreement, 9) AS agreement, round(a, 9) AS rate_a, round(b, 9) AS rate_b, round(CASE WHEN ch < 1 - 1e-12 THEN (agreement - ch) / (1 - ch) END, 9) AS kappa,
 CASE WHEN ch >= 1 - 1e-12 THEN 'undefined: one label only' WHEN ch >= 0.8 THEN 'deflated by prevalence' END AS kappa_note FROM e""")
def sta_kappa(src):
    rated = src.table("labels").join(src.table("documents").select("doc_id", "source"), "doc_id")
    out = S.kappa(rated, ("source",), F.col("quality") == 1, F.col("toxic") == 0)
    return out.withColumns({c: F.round(c, 9) for c in ("agreement", "rate_a", "rate_b", "kappa")})


@query("sta_ceiling", LONG + """ SELECT task, metric, round(min(value), 9) AS lowest, round(max(value), 9) AS highest, count(DISTINCT arm) = 2 AND min(value) = max(value) AS at_ceiling
 FROM outcomes WHERE value IS NOT NULL GROUP BY ALL""", _VIEWS)
def sta_ceiling(src):
    return S.ceiling(M.outcomes(_pairs(src)), ("task", "metric")).withColumns({c: F.round(c, 9) for c in ("lowest", "highest")})


@query("sta_delta_failure_kind", PAIRS + """, s AS (SELECT task, metric, avg(cand - base) AS d, stddev_samp(cand - base) / sqrt(count(*)) AS se FROM pairs WHERE base IS NOT NULL AND cand IS NOT NULL GROUP BY ALL)
 SELECT task, metric, CASE WHEN d - 0.02 + 1.96 * se < 0 THEN 'measured regression' WHEN d - 0.02 - 1.96 * se <= 0 THEN 'parity not demonstrated' END AS kind FROM s""", _VIEWS)
def sta_delta_failure_kind(src):
    from armparity.functions.render import delta_failure_kind

    both = S.pair_samples(M.outcomes(_pairs(src)), ("task", "metric")).filter("side = 'both'")
    d = F.col("cand") - F.col("base")
    s = both.groupBy("task", "metric").agg(F.avg(d).alias("d"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"))
    mid = F.col("d") - 0.02
    return s.select("task", "metric", delta_failure_kind(mid - 1.96 * F.col("se"), mid + 1.96 * F.col("se")).alias("kind"))
