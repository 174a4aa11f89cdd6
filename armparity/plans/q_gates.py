"""Evidence, gates and verdicts."""

from pyspark.sql import functions as F

from armparity.operators import agreement as A
from armparity.operators import bootstrap as B
from armparity.operators import economics as E
from armparity.operators import gates as G
from armparity.operators import judge as J
from armparity.operators import latency as L
from armparity.operators import metrics as M
from armparity.operators import ranking as R
from armparity.operators import stats as S
from armparity.plans.q_judge import FOLDED, scored_cells
from armparity.plans.q_metrics import LONG, SCORED, _pairs
from armparity.plans.q_shadow import AGREE, TSUM, shadow_calls, triage
from armparity.plans.q_stats import P95_REPS, REPS, SEED, USD, duck_replicates
from armparity.plans.registry import query

_EST = ("task", "gate", "n", "dropped", "point", "lo", "hi", "unit")
_VIEWS = ("calls", "items", "cells", "verdicts", "prices", "gates")


def mean_gates(src):
    """The four gates that are means or paired mean differences, as one paired frame.

    A level gate has no baseline side, so its baseline is 0. The metric gates come out
    of one pass over the outcomes.
    """
    grounded = F.lit(None).cast("string")
    for task, metric in G.GROUNDEDNESS.items():
        grounded = F.when(F.col("task") == task, F.lit(metric)).otherwise(grounded)
    gate = F.when(F.col("metric") == "json_schema_validity", "json_schema_validity").when(F.col("metric") == grounded, "groundedness_delta_pp")
    metric_rows = M.outcomes(_pairs(src)).withColumn("gate", gate).filter("gate is not null").select("task", "gate", "arm", "item_id", "value")
    judged = J.fold_repeats(scored_cells(src, "gated")).select(
        "task", F.lit("quality_delta_pp").alias("gate"), "arm", "item_id", F.col("item_mean").alias("value"))
    paired = S.pair_samples(metric_rows.unionByName(judged), ("task", "gate"))
    level = F.col("gate") == "json_schema_validity"
    paired = paired.select("task", "gate", "item_id", F.when(level, F.lit(0.0)).otherwise(F.col("base")).alias("base"), "cand").filter(
        ~level | F.col("cand").isNotNull())
    agreed = A.compare_items(shadow_calls(src), "baseline", "candidate").filter("comparable").select(
        "task", F.lit("shadow_agreement").alias("gate"), "item_id", F.lit(0.0).alias("base"), F.col("agreed").cast("double").alias("cand"))
    return paired.unionByName(agreed)


def estimates(src, resamples=B.RESAMPLES, p95_resamples=B.RESAMPLES, hashed=False):
    """Estimates of all six gates per task; ``hashed`` draws as SQL can, for comparison with it."""
    how = {"method": "hash"} if hashed else {}
    means = S.paired_delta(src.once(mean_gates), ("task", "gate"), resamples=resamples, **how)
    pp = F.col("gate").endswith("_pp")
    means = means.withColumns({c: F.col(c) * F.when(pp, 100.0).otherwise(1.0) for c in ("point", "lo", "hi")}).withColumn(
        "unit", F.when(pp, "percentage_points").otherwise("fraction"))
    cost = E.savings(E.paired_costs(src.view("calls"), src.view("prices")), ("task",), resamples=resamples, **how).withColumns(
        {"gate": F.lit("cost_savings_pct"), "unit": F.lit("percent")})
    calls = src.view("calls").filter("status = 'ok' and arm = 'candidate'")
    latency = L.p95_interval(calls, ("task",), p95_resamples, **how).withColumns(
        {"gate": F.lit("latency_p95"), "unit": F.lit("ms"), "dropped": F.lit(0).cast("long")})
    return means.select(*_EST).unionByName(cost.select(*_EST)).unionByName(latency.select(*_EST))


def sentinels(src):
    """The incumbent's own p95, which bounds the candidate's."""
    calls = src.view("calls").filter("status = 'ok' and arm = 'baseline'")
    p95 = R.percentiles_of_counts(R.value_counts(calls, ("task",), "total_ms"), ("task",), "total_ms", {"value": 0.95})
    return p95.withColumn("sentinel", F.lit("baseline_p95"))


def _est(reps, p95_reps):
    """DuckDB text of the evidence and checks from ``reps`` draws of each mean and ratio and ``p95_reps`` of the percentile."""
    return LONG + FOLDED + AGREE[len(SCORED):] + """, mg AS (
  SELECT task, 'quality_delta_pp' AS gate, item_id, max(item_mean) FILTER (WHERE arm = 'baseline') AS base, max(item_mean) FILTER (WHERE arm = 'candidate') AS cand FROM folded GROUP BY ALL HAVING count(item_mean) > 0
  UNION ALL SELECT task, 'groundedness_delta_pp', item_id, max(value) FILTER (WHERE arm = 'baseline'), max(value) FILTER (WHERE arm = 'candidate') FROM outcomes WHERE value IS NOT NULL
    AND metric = CASE task WHEN 'chunk_summarizer' THEN 'citation_coverage' WHEN 'feature_extractor' THEN 'supported_claim_rate' END GROUP BY ALL
  UNION ALL SELECT task, 'json_schema_validity', item_id, 0, value FROM outcomes WHERE metric = 'json_schema_validity' AND arm = 'candidate'
  UNION ALL SELECT task, 'shadow_agreement', item_id, 0, CAST(agreed AS INTEGER) FROM ia WHERE comparable),
 mb AS (SELECT * FROM mg WHERE base IS NOT NULL AND cand IS NOT NULL)""" + duck_replicates("e", "mb", "task, gate", "item_id", ["base", "cand"], reps) + USD + duck_replicates("s", "cost_pairs", "task", "item_id", ["base", "cand"], reps) + f""",
 lx AS (SELECT task, total_ms, b * 8 + j AS replicate, CAST('0x' || substr(md5(concat('{SEED}|', b, '|', call_id)), CAST(1 + 4 * j AS INTEGER), 4) AS BIGINT) AS u FROM calls, (SELECT unnest(range({-(-p95_reps // 8)})) AS b), (SELECT unnest(range(8)) AS j)
   WHERE total_ms IS NOT NULL AND status = 'ok' AND arm = 'candidate'),
 ly AS (SELECT task, replicate, quantile_cont(total_ms, 0.95) AS stat FROM (SELECT task, replicate, total_ms, unnest(range({' + '.join(f'CAST(u >= {s} AS INTEGER)' for s in B.POISSON_STEPS)})) FROM lx) GROUP BY ALL),
 est AS (SELECT p.task, p.gate, n, dropped, point * f AS point, lo * f AS lo, hi * f AS hi, CASE WHEN f = 100 THEN 'percentage_points' ELSE 'fraction' END AS unit
   FROM (SELECT task, gate, count(base + cand) AS n, count(*) - count(base + cand) AS dropped, avg(cand - base) AS point, CASE WHEN gate LIKE '%_pp' THEN 100 ELSE 1 END AS f FROM mg GROUP BY ALL) p
   JOIN (SELECT task, gate, quantile_cont((s_cand - s_base) / sw, 0.025) AS lo, quantile_cont((s_cand - s_base) / sw, 0.975) AS hi FROM e_r GROUP BY ALL) USING (task, gate)
  UNION ALL SELECT task, 'cost_savings_pct', n, d, point, lo, hi, 'percent' FROM (SELECT task, count(*) AS n, 100 * (sum(base) - sum(cand)) / sum(base) AS point FROM cost_pairs GROUP BY ALL)
   JOIN (SELECT task, quantile_cont(100 * (s_base - s_cand) / s_base, 0.025) AS lo, quantile_cont(100 * (s_base - s_cand) / s_base, 0.975) AS hi FROM s_r GROUP BY ALL) USING (task)
   JOIN (SELECT task, count(DISTINCT item_id) - (SELECT count(*) FROM cost_pairs cp WHERE cp.task = c.task) AS d FROM calls c GROUP BY task) USING (task)
  UNION ALL SELECT task, 'latency_p95', n, 0, point, lo, hi, 'ms' FROM (SELECT task, count(total_ms) AS n, quantile_cont(total_ms, 0.95) AS point FROM calls WHERE status = 'ok' AND arm = 'candidate' AND total_ms IS NOT NULL GROUP BY ALL)
   JOIN (SELECT task, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM ly GROUP BY ALL) USING (task)),
 sent AS (SELECT task, quantile_cont(total_ms, 0.95) AS value FROM calls WHERE status = 'ok' AND arm = 'baseline' AND total_ms IS NOT NULL GROUP BY ALL),
 ev AS (SELECT s.task, g.gate, est.n, est.dropped, est.point, est.lo, est.hi, est.unit, CASE WHEN est.point IS NULL THEN CASE WHEN g.gate = 'groundedness_delta_pp' AND s.task = 'query_rewriter' THEN 'inapplicable: the task has no groundedness instrument' ELSE 'not measured' END END AS reason
   FROM (SELECT DISTINCT task FROM calls) s CROSS JOIN gates g LEFT JOIN est ON est.task = s.task AND est.gate = g.gate),
 chk AS (SELECT ev.task, g.gate, g.direction, coalesce(TRY_CAST(g.bound AS DOUBLE), sent.value) AS bound_value, CASE WHEN g.direction = 'min' THEN lo ELSE hi END AS compared_value, g.alt, g.role, ev.point, ev.lo, ev.hi, ev.unit, ev.n
   FROM ev JOIN gates g USING (gate) LEFT JOIN sent ON sent.task = ev.task WHERE ev.lo IS NOT NULL),
 chk2 AS (SELECT *, CASE WHEN direction = 'min' THEN compared_value >= bound_value ELSE compared_value <= bound_value END AS passed FROM chk)"""


EST = _est(REPS, P95_REPS)
_TRIED = TSUM[TSUM.index(", cs AS"):].replace(CS := FOLDED[:FOLDED.index(", folded AS")], "", 1) + """, chk3 AS (SELECT c.*, CASE WHEN NOT passed AND alt IS NOT NULL THEN CASE WHEN wins + losses + ties > 0 THEN wins >= losses END END AS alt_passed, wins, losses FROM chk2 c LEFT JOIN ts USING (task)),
 st AS (SELECT t.task, g.gate, g.role, passed OR coalesce(alt_passed, false) AS ok, alt_passed FROM (SELECT DISTINCT task FROM calls) t CROSS JOIN gates g LEFT JOIN chk3 c ON c.task = t.task AND c.gate = g.gate),
 dc AS (SELECT task, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT ok), '') AS failed, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE ok IS NULL), '') AS missing,
   coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE alt_passed), '') AS passed_by_alt, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT ok AND role = 'blocking'), '') AS blk, count(*) FILTER (WHERE NOT ok AND role <> 'quality') AS hard FROM st GROUP BY ALL)"""
ALT = EST + _TRIED


def hashed_estimates(src):
    return estimates(src, REPS, P95_REPS, hashed=True)


def evidence(src):
    """Evidence from draws that SQL can repeat."""
    return G.build_evidence(src.view("calls").select("task").distinct(), src.once(hashed_estimates), src.view("gates"))


def checks(src):
    return G.check_gates(src.once(evidence), src.view("gates"), sentinels(src))


def all_hashed_estimates(src):
    """All 10,000 replicates of each statistic, from draws that SQL can repeat."""
    return estimates(src, hashed=True)


def all_hashed_evidence(src):
    return G.build_evidence(src.view("calls").select("task").distinct(), src.once(all_hashed_estimates), src.view("gates"))


def all_hashed_checks(src):
    return G.check_gates(src.once(all_hashed_evidence), src.view("gates"), sentinels(src))


def drawn_evidence(src):
    """Evidence from 10,000 replicates of each statistic."""
    return G.build_evidence(src.view("calls").select("task").distinct(), src.once(estimates), src.view("gates"))


def drawn_checks(src):
    return G.check_gates(src.once(drawn_evidence), src.view("gates"), sentinels(src))


def _six(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("gate_evidence", EST + " SELECT task, gate, n, dropped, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, unit, reason FROM ev", _VIEWS)
def gate_evidence(src):
    return _six(src.once(evidence).select("task", "gate", "n", "dropped", "point", "lo", "hi", "unit", "reason"), "point", "lo", "hi")


@query("gate_evidence_drawn", None)
def gate_evidence_drawn(src):
    """The evidence a verdict is made of: 10,000 draws of every bound."""
    return src.once(drawn_evidence).select("task", "gate", "n", "dropped", "point", "lo", "hi", "unit", "reason")


@query("gate_resolve_bounds", EST + " SELECT task, 'latency_p95' AS gate, round(value, 6) AS bound_value FROM sent", _VIEWS)
def gate_resolve_bounds(src):
    return G.resolve_bounds(src.view("gates"), sentinels(src)).withColumn("bound_value", F.round("bound_value", 6))


@query("gate_checks", EST + " SELECT task, gate, direction, round(bound_value, 6) AS bound_value, round(compared_value, 6) AS compared_value, passed FROM chk2", _VIEWS)
def gate_checks(src):
    return _six(src.once(checks).select("task", "gate", "direction", "bound_value", "compared_value", "passed"), "bound_value", "compared_value")


@query("gate_missing", EST + " SELECT task, gate FROM ev WHERE lo IS NULL", _VIEWS)
def gate_missing(src):
    return G.missing_gates(src.view("calls").select("task").distinct(), src.once(checks), src.view("gates"))


@query("gate_alternatives", _est(B.RESAMPLES, B.RESAMPLES) + _TRIED + " SELECT task, gate, passed, alt_passed, passed OR coalesce(alt_passed, false) AS effective_passed, CASE WHEN alt_passed IS NOT NULL THEN concat(wins, 'W/', losses, 'L') END AS alt_summary FROM chk3", _VIEWS)
def gate_alternatives(src):
    return G.apply_alternatives(src.once(all_hashed_checks), A.triage_summary(triage(src))).select("task", "gate", "passed", "alt_passed", "effective_passed", "alt_summary")


@query("gate_verdict", ALT + """ SELECT task, CASE WHEN blk <> '' THEN 'HOLD' WHEN missing <> '' THEN 'INCOMPLETE' ELSE r END AS verdict, CASE WHEN blk = '' AND missing <> '' THEN r END AS provisional, failed, missing, passed_by_alt,
  concat(CASE WHEN blk <> '' THEN concat('blocking gates failed: ', blk, '. the structure fails') WHEN missing <> '' THEN concat('not measured: ', missing, '; were these to pass: ', r) WHEN failed = '' THEN 'every gate holds on its bound'
   WHEN hard = 0 THEN concat('quality gates failed: ', failed, '. the structure holds, quality is short') ELSE concat('no rule covers the failed gates: ', failed) END, CASE WHEN passed_by_alt <> '' THEN concat('; by agreed alternative: ', passed_by_alt) ELSE '' END) AS rationale
 FROM (SELECT *, CASE WHEN failed = '' THEN 'MIGRATE' WHEN hard = 0 THEN 'TUNE_FIRST' ELSE 'UNDETERMINED' END AS r FROM dc)""", _VIEWS)
def gate_verdict(src):
    return _decided(src, checks)


def _decided(src, checked):
    alt = G.apply_alternatives(src.once(checked), A.triage_summary(triage(src)))
    return G.decide(src.view("calls").select("task").distinct(), alt, src.view("gates"), src.view("verdict_rules"))


@query("gate_verdict_drawn", None)
def gate_verdict_drawn(src):
    """The verdict on 10,000 draws of every bound; the form above decides from the draws that SQL can repeat."""
    return _decided(src, drawn_checks)


@query("gate_declared_only", """, g AS (SELECT task, count(*) AS n, avg(CAST(status = 'error' AS INTEGER)) AS r, avg(CAST(total_ms IS NOT NULL AS INTEGER)) AS m FROM calls WHERE arm = 'candidate' GROUP BY task),
 b AS (SELECT *, r + 1.96 * sqrt(r * (1 - r) / n) > 0.05 AS bad, m - 1.96 * sqrt(m * (1 - m) / n) < 0.999 AS short FROM g)
 SELECT task, CASE WHEN bad THEN 'STOP' ELSE 'INCOMPLETE' END AS verdict, CASE WHEN bad THEN 'blocking gates failed: error_rate. too many errors' ELSE concat('not measured: cost_savings_pct; were these to pass: ', CASE WHEN short THEN 'POLISH' ELSE 'GO' END) END AS rationale,
  concat(CASE WHEN bad THEN 'error_rate' ELSE '' END, CASE WHEN bad AND short THEN ',' ELSE '' END, CASE WHEN short THEN 'timed_share' ELSE '' END) AS failed, 'cost_savings_pct' AS missing FROM b""", ("calls",))
def gate_declared_only(src):
    """Gates and verdict names that only the tables declare: one fails, one is never measured."""
    spark = src.spark
    gates = spark.sql("""SELECT * FROM VALUES ('error_rate', 'max', '0.05', 'fraction', NULL, 'blocking'), ('timed_share', 'min', '0.999', 'fraction', NULL, 'quality'),
      ('cost_savings_pct', 'min', '30', 'percent', NULL, 'other') AS g(gate, direction, bound, unit, alt, role)""").withColumn("alt", F.col("alt").cast("string"))
    names = spark.sql("SELECT * FROM VALUES ('GO', 'all_pass', 'good'), ('POLISH', 'only_quality_gates_fail', 'nearly'), ('STOP', 'any_blocking_gate_fails', 'too many errors') AS v(verdict, rule, description)")
    calls = src.view("calls").filter("arm = 'candidate'")
    shares = calls.groupBy("task").agg(F.count("*").alias("n"), F.avg((F.col("status") == "error").cast("double")).alias("error_rate"),
                                       F.avg(F.col("total_ms").isNotNull().cast("double")).alias("timed_share"))
    long = shares.unpivot(["task", "n"], ["error_rate", "timed_share"], "gate", "point")
    half = 1.96 * F.sqrt(F.col("point") * (1 - F.col("point")) / F.col("n"))
    est = long.select("task", "gate", "n", F.lit(0).alias("dropped"), "point", (F.col("point") - half).alias("lo"), (F.col("point") + half).alias("hi"), F.lit("fraction").alias("unit"))
    segments = calls.select("task").distinct()
    none = spark.createDataFrame([], "task string, sentinel string, value double")
    checked = G.check_gates(G.build_evidence(segments, est, gates), gates, none)
    done = checked.withColumns({"alt_passed": F.lit(None).cast("boolean"), "effective_passed": F.col("passed")})
    return G.decide(segments, done, gates, names).select("task", "verdict", "rationale", "failed", "missing")


SMALL = SCORED + """, vp AS (SELECT task, item_id, max(CAST(tag = 'valid' AS INTEGER)) FILTER (WHERE arm = 'baseline') AS base, max(CAST(tag = 'valid' AS INTEGER)) FILTER (WHERE arm = 'candidate') AS cand FROM tagged GROUP BY ALL)""" + duck_replicates("v", "vp", "task", "item_id", ["base", "cand"])


@query("gate_verdict_sql", SMALL + """ SELECT task, count(*) AS n, round(avg(cand - base) * 100, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, lo >= -2.0 AS passed, CASE WHEN lo >= -2.0 THEN 'MIGRATE' ELSE 'HOLD' END AS verdict
 FROM vp JOIN (SELECT task, quantile_cont(100 * (s_cand - s_base) / sw, 0.025) AS lo, quantile_cont(100 * (s_cand - s_base) / sw, 0.975) AS hi FROM v_r GROUP BY ALL) USING (task) GROUP BY task, lo, hi""", ("calls", "items"))
def gate_verdict_sql(src):
    """The flagship slice in the form that SQL can say: validity per call, paired delta, hash-drawn interval, gate, verdict."""
    tag = M.validity_tag(F.col("status"), F.col("task"), F.col("p"), F.col("shape"))
    rows = _pairs(src).select("task", "arm", "item_id", (tag == "valid").cast("double").alias("value"))
    est = S.rescale(S.paired_delta(S.pair_samples(rows, ("task",)), ("task",), resamples=REPS, method="hash").withColumn("unit", F.lit("fraction")), "percentage_points")
    passed = F.col("lo") >= -2.0
    return est.select("task", "n", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")], passed.alias("passed"), F.when(passed, "MIGRATE").otherwise("HOLD").alias("verdict"))


@query("gate_verify_published", LONG + """, a AS (SELECT task, arm, metric, avg(value) AS m, count(value) AS n FROM outcomes GROUP BY ALL),
 p AS (SELECT task, arm, metric, m + CASE WHEN metric = 'filter_recall' THEN 0.001 ELSE 0 END AS m, n + CASE WHEN metric = 'filter_f1' THEN 1 ELSE 0 END AS n FROM a WHERE metric <> 'omission_rate')
 SELECT task, arm, metric, CASE WHEN p.n IS NULL THEN 'not published' WHEN a.n <> p.n THEN 'n differs' ELSE 'mean differs' END AS problem FROM a LEFT JOIN p USING (task, arm, metric) WHERE p.n IS NULL OR a.n <> p.n OR abs(a.m - p.m) > 1e-9""", ("calls", "items"))
def gate_verify_published(src):
    now = M.arm_metrics(M.outcomes(_pairs(src)))
    stale = now.filter("metric <> 'omission_rate'").withColumns({
        "mean": F.col("mean") + F.when(F.col("metric") == "filter_recall", 0.001).otherwise(0.0),
        "n": F.col("n") + F.when(F.col("metric") == "filter_f1", 1).otherwise(0)})
    return G.verify_published(now, stale, ("task", "arm", "metric"))
