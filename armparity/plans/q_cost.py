"""Economics and latency."""

from pyspark.sql import functions as F

from armparity.operators import economics as E
from armparity.operators import latency as L
from armparity.operators import metrics as M
from armparity.operators import ranking as R
from armparity.plans.q_metrics import SCORED
from armparity.plans.q_stats import P95_REPS, REPS, USD, duck_p95, duck_replicates
from armparity.plans.registry import query
from armparity.sources import registries as reg

_CP = ("calls", "prices")
BASE = {"input": 2.0, "output": 10.0, "cached": 0.2}
CAND = {"input": 0.3, "output": 2.5, "cached": 0.03}


def rounded(df, *cols, digits=7):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("eco_call_cost", USD + " SELECT call_id, round(usd, 10) AS usd FROM usd", _CP)
def eco_call_cost(src):
    return E.call_cost(src.view("calls"), src.view("prices")).select("call_id", F.round("usd", 10).alias("usd"))


@query("eco_savings", USD + duck_replicates("s", "cost_pairs", "task", "item_id", ["base", "cand"]) + """ SELECT e.*, lo, hi FROM (SELECT c.task, count(p.item_id) AS n, count(*) - count(p.item_id) AS dropped, round(sum(base), 9) AS base_usd, round(sum(cand), 9) AS cand_usd, round(100 * (sum(base) - sum(cand)) / sum(base), 7) AS point,
  CASE WHEN count(p.item_id) < 2 THEN 'fewer than two paired items' END AS reason FROM (SELECT DISTINCT task, item_id FROM calls) c LEFT JOIN cost_pairs p USING (task, item_id) GROUP BY ALL) e
  LEFT JOIN (SELECT task, round(quantile_cont(100 * (s_base - s_cand) / s_base, 0.025), 7) AS lo, round(quantile_cont(100 * (s_base - s_cand) / s_base, 0.975), 7) AS hi FROM s_r WHERE s_base > 0 GROUP BY ALL) USING (task)""", _CP)
def eco_savings(src):
    est = E.savings(E.paired_costs(src.view("calls"), src.view("prices")), ("task",), resamples=REPS, method="hash")
    return est.select("task", "n", "dropped", *[F.round(c, 9).alias(c) for c in ("base_usd", "cand_usd")], *[F.round(c, 7).alias(c) for c in ("point", "lo", "hi")], "reason")


SEG = """, seg AS (SELECT c_mktsegment AS segment, task, count(*) / count(DISTINCT CAST(ts AS DATE)) AS calls_per_day, avg(input_tokens) AS avg_in, avg(output_tokens) AS avg_out FROM calls JOIN customer ON user_id = c_custkey GROUP BY ALL)"""


def volumes(src):
    segmented = src.view("calls").join(src.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "user_id")
    return E.segment_volumes(segmented, ("segment", "task"))


@query("eco_volumes", SEG + " SELECT segment, task, round(calls_per_day, 7) AS calls_per_day, round(avg_in, 7) AS avg_in, round(avg_out, 7) AS avg_out FROM seg", ("calls",))
def eco_volumes(src):
    return rounded(volumes(src), "calls_per_day", "avg_in", "avg_out")


@query("eco_cached_cost", SEG + " SELECT segment, task, round(avg_in * 0.75 / 1e6 * 0.3 + avg_in * 0.25 / 1e6 * 0.03 + avg_out / 1e6 * 2.5, 10) AS usd FROM seg", ("calls",))
def eco_cached_cost(src):
    rates = F.struct(*[F.lit(CAND[k]).alias(k) for k in CAND])
    return volumes(src).select("segment", "task", F.round(E.cost_per_call(F.col("avg_in"), F.col("avg_out"), F.lit(0.25), rates), 10).alias("usd"))


@query("eco_cost_grid", SEG + """, g AS (SELECT segment, task, m AS multiplier, s AS caching, calls_per_day * m * (avg_in / 1e6 * CASE s WHEN 'cached' THEN 0.2 ELSE 2.0 END + avg_out / 1e6 * 10.0) AS b, calls_per_day * m * (avg_in / 1e6 * CASE s WHEN 'cached' THEN 0.03 ELSE 0.3 END + avg_out / 1e6 * 2.5) AS c
  FROM seg, (VALUES (0.5), (1.0), (2.0)) x(m), (VALUES ('uncached'), ('cached')) y(s))
 SELECT segment, task, CAST(multiplier AS DOUBLE) AS multiplier, caching, round(b, 6) AS baseline_daily, round(c, 6) AS candidate_daily, round(b * 365 / 12, 6) AS baseline_monthly, round(c * 365 / 12, 6) AS candidate_monthly, round(b * 365, 6) AS baseline_annual, round(c * 365, 6) AS candidate_annual, round(100 * (b - c) / b, 6) AS savings_pct FROM g""", ("calls",))
def eco_cost_grid(src):
    out = E.cost_grid(volumes(src), BASE, CAND, ("segment", "task"))
    return rounded(out, "baseline_daily", "candidate_daily", "baseline_monthly", "candidate_monthly", "baseline_annual", "candidate_annual", "savings_pct", digits=6)


def supplied(src):
    return src.table("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("calls_per_day")).filter(
        "segment < 'H'").withColumns({"task": F.lit("query_rewriter"), "avg_in": F.lit(500), "avg_out": F.lit(60)}).unionByName(
        src.table("customer").groupBy(F.concat(F.lit("NEW "), "c_mktsegment").alias("segment")).agg(F.count("*").alias("calls_per_day")).withColumns(
            {"task": F.lit("query_rewriter"), "avg_in": F.lit(1), "avg_out": F.lit(1)}))


SUP = SEG + """, sup AS (SELECT c_mktsegment AS segment, 'query_rewriter' AS task, count(*) AS n FROM customer WHERE c_mktsegment < 'H' GROUP BY ALL UNION ALL SELECT concat('NEW ', c_mktsegment), 'query_rewriter', count(*) FROM customer GROUP BY ALL)"""


@query("eco_confirm_volumes", SUP + " SELECT s.segment, s.task, round(coalesce(n, calls_per_day), 7) AS calls_per_day, n IS NOT NULL AS confirmed FROM seg s LEFT JOIN sup USING (segment, task)", ("calls",))
def eco_confirm_volumes(src):
    out = E.confirm_volumes(volumes(src), supplied(src), ("segment", "task"))
    return out.select("segment", "task", F.round("calls_per_day", 7).alias("calls_per_day"), "confirmed")


@query("eco_unknown_segments", SUP + " SELECT segment, n AS calls_per_day FROM sup WHERE segment NOT IN (SELECT segment FROM seg)", ("calls",))
def eco_unknown_segments(src):
    return E.unknown_segments(volumes(src), supplied(src), ("segment", "task")).select("segment", "calls_per_day")


@query("eco_blockers", SUP + """ SELECT concat('book ', book_id % 97) AS subject, 'prices unverified' AS blocker FROM price_book GROUP BY book_id % 97 HAVING count(*) FILTER (WHERE coalesce('VERIFY' IN (input, output, cached_input), false)) > 0 OR count(*) > count(verified_on)
 UNION ALL SELECT concat(s.segment, '/', s.task), 'volumes unconfirmed' FROM seg s LEFT JOIN sup USING (segment, task) WHERE n IS NULL""", ("calls", "price_book"))
def eco_blockers(src):
    books = reg.book_is_verified(src.view("price_book"), F.col("book_id") % 97)
    vol = E.confirm_volumes(volumes(src), supplied(src), ("segment", "task")).withColumn("subject", F.concat_ws("/", "segment", "task"))
    return E.blockers(books, vol).drop("clears_when")


GRP = """, grp AS (SELECT model, cached_tokens AS preamble_tokens, count(*) / count(DISTINCT CAST(ts AS DATE)) AS calls_per_day FROM calls WHERE cached_tokens > 0 GROUP BY ALL),
 be AS (SELECT g.*, t AS ttl_hours, preamble_tokens / 1e6 * input_per_1m AS w, preamble_tokens / 1e6 * t AS st, preamble_tokens / 1e6 * (input_per_1m - cached_per_1m) AS sv FROM grp g JOIN prices USING (model), (VALUES (1.0), (6.0), (24.0)) x(t))"""


def breakeven(src, ttls):
    groups = src.view("calls").filter("cached_tokens > 0").groupBy("model", F.col("cached_tokens").alias("preamble_tokens")).agg(
        (F.count("*") / F.count_distinct(F.to_date("ts"))).alias("calls_per_day"))
    return E.cache_breakeven(groups, src.view("prices"), ttls)


@query("eco_breakeven", GRP + " SELECT model, preamble_tokens, round(sv, 10) AS saving_usd, sv <= 0 AS never_breaks_even, round(CASE WHEN sv > 0 THEN (w + st) / sv * 24 / ttl_hours END, 6) AS breakeven_calls_per_day FROM be WHERE ttl_hours = 1", _CP)
def eco_breakeven(src):
    return breakeven(src, (1.0,)).select("model", "preamble_tokens", F.round("saving_usd", 10).alias("saving_usd"), "never_breaks_even", F.round("breakeven_calls_per_day", 6).alias("breakeven_calls_per_day"))


@query("eco_breakeven_curve", GRP + " SELECT model, preamble_tokens, CAST(ttl_hours AS DOUBLE) AS ttl_hours, round(CASE WHEN sv > 0 THEN (w + st) / sv * 24 / ttl_hours END, 6) AS breakeven_calls_per_day FROM be", _CP)
def eco_breakeven_curve(src):
    return breakeven(src, (1.0, 6.0, 24.0)).select("model", "preamble_tokens", "ttl_hours", F.round("breakeven_calls_per_day", 6).alias("breakeven_calls_per_day"))


@query("eco_net_per_day", GRP + " SELECT model, preamble_tokens, CAST(ttl_hours AS DOUBLE) AS ttl_hours, round(calls_per_day * sv - 24 / ttl_hours * (w + st), 9) AS net_usd FROM be", _CP)
def eco_net_per_day(src):
    b = breakeven(src, (1.0, 6.0, 24.0))
    return b.select("model", "preamble_tokens", "ttl_hours", F.round(E.net_per_day(b, F.col("calls_per_day")), 9).alias("net_usd"))


@query("eco_preamble", """WITH c AS (SELECT conv_id AS item_id, turn, concat('[c', turn, '] ', text) AS text, conv_id % 3 AS g, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) AS rn FROM conversations WHERE role = 'user')
 SELECT g, count(*) AS chunks, count(DISTINCT item_id) AS items, CAST(sum(length(text)) AS BIGINT) AS characters FROM c WHERE rn <= 40 GROUP BY ALL""")
def eco_preamble(src):
    chunks = src.table("conversations").filter("role = 'user'").select(
        F.col("conv_id").alias("item_id"), "turn", (F.col("conv_id") % 3).alias("g"), F.concat(F.lit("[c"), F.col("turn").cast("string"), F.lit("] "), "text").alias("text"))
    return E.shared_preamble(chunks, ("g",), ("item_id", "turn"), 40)


@query("eco_reconciled", """ SELECT item_id, w.cached_tokens IS NOT DISTINCT FROM b.cached_tokens AS reconciled FROM calls b JOIN calls w USING (item_id) WHERE b.arm = 'baseline' AND w.arm = 'candidate'""", ("calls",))
def eco_reconciled(src):
    one = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("cached_tokens")))
    pairs = src.view("calls").groupBy("item_id").agg(one("baseline").alias("cache_size"), one("candidate").alias("warm_cached"))
    return pairs.select("item_id", E.reconciled(pairs).alias("reconciled"))


AUD = USD + """, ch AS (SELECT *, coalesce(length(output_text), 0) + coalesce(length(CAST(json(TRY_CAST(payload_json AS JSON)) AS VARCHAR)), 0) AS chars FROM usd WHERE status = 'ok'),
 aud AS (SELECT task, arm, count(*) AS calls_ok, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(chars) AS BIGINT) AS emitted_chars,
   sum(chars) / sum(output_tokens) AS chars_per_output_token, count(*) FILTER (WHERE output_tokens > chars) AS calls_billed_over_emitted, CAST(sum(greatest(0, output_tokens - chars)) AS BIGINT) AS unreturned_floor,
   sum(greatest(0, output_tokens - chars)) / sum(output_tokens) AS unreturned_share, sum(input_tokens / 1e6 * input_per_1m) AS input_usd, sum(output_tokens / 1e6 * output_per_1m) AS output_usd, sum(usd) AS usd, quantile_cont(output_tokens, 0.5) AS median_output FROM ch JOIN prices p USING (model) GROUP BY ALL)""".replace("FROM calls c JOIN prices", "FROM calls c JOIN prices")


def audited(src):
    costed = E.call_cost(src.view("calls"), src.view("prices"))
    return costed.withColumn("chars", M.emitted_chars(F.col("output_text"), F.col("payload_json")))


@query("eco_arm_audit", AUD + """ SELECT task, arm, calls_ok, input_tokens, output_tokens, cached_tokens, emitted_chars, round(chars_per_output_token, 7) AS chars_per_output_token, calls_billed_over_emitted, unreturned_floor, round(unreturned_share, 7) AS unreturned_share,
  round(input_usd, 9) AS input_usd, round(output_usd, 9) AS output_usd, round(usd, 9) AS usd, median_output FROM aud""", _CP)
def eco_arm_audit(src):
    calls = audited(src)
    counts = R.value_counts(calls.filter("status = 'ok'"), ("task", "arm"), "output_tokens")
    median = R.percentiles_of_counts(counts, ("task", "arm"), "output_tokens", {"median_output": 0.5})
    out = E.arm_audit(calls, ("task", "arm")).join(median, ["task", "arm"])
    return rounded(rounded(out, "chars_per_output_token", "unreturned_share"), "input_usd", "output_usd", "usd", digits=9)


@query("eco_rate_ratios", """, b AS (SELECT book_id, model, TRY_CAST(input AS DOUBLE) AS i, TRY_CAST(output AS DOUBLE) AS o FROM price_book)
 SELECT x.book_id, round(x.i / nullif(r.i, 0), 9) AS incumbent_input, round(x.o / nullif(r.o, 0), 9) AS incumbent_output, round(x.i / nullif(p.i, 0), 9) AS pro_input, round(x.o / nullif(p.o, 0), 9) AS pro_output
 FROM b x LEFT JOIN b r ON r.book_id = x.book_id % 97 LEFT JOIN b p ON p.book_id = x.book_id // 10 * 10""", ("price_book",))
def eco_rate_ratios(src):
    book = src.view("price_book").select("book_id", F.col("input").try_cast("double").alias("input"), F.col("output").try_cast("double").alias("output"),
                                         (F.col("book_id") % 97).alias("family"), F.expr("book_id div 10").alias("tier"))
    out = E.rate_ratios(book, book.filter("book_id < 97").select("family", "input", "output"), "incumbent", ("family",))
    out = E.rate_ratios(out, book.filter("book_id % 10 = 0").select("tier", "input", "output"), "pro", ("tier",))
    return rounded(out.select("book_id", "incumbent_input", "incumbent_output", "pro_input", "pro_output"), "incumbent_input", "incumbent_output", "pro_input", "pro_output", digits=9)


@query("eco_breakeven_rates", AUD + """, z AS (SELECT b.task, c.output_tokens / b.output_tokens AS r, c.input_tokens / b.input_tokens AS ri, b.usd * 0.7 AS budget, c.input_usd AS ci, c.output_tokens AS co, c.usd AS cu, b.usd AS bu, c.input_usd + b.output_tokens * c.output_usd / c.output_tokens AS capped FROM aud b JOIN aud c USING (task) WHERE b.arm = 'baseline' AND c.arm = 'candidate')
 SELECT task, round(r, 7) AS output_ratio, round(ri, 7) AS input_ratio, round(CASE WHEN budget > ci THEN (budget - ci) / co * 1e6 END, 6) AS output_rate_needed, round(budget / cu, 7) AS scale_needed, round((bu - capped) / bu * 100, 6) AS counterfactual_savings_pct FROM z""", _CP)
def eco_breakeven_rates(src):
    out = E.breakeven_rates(E.arm_audit(audited(src), ("task", "arm")), 0.3)
    return rounded(rounded(out, "output_ratio", "input_ratio", "scale_needed"), "output_rate_needed", "counterfactual_savings_pct", digits=6)


@query("eco_cost_panel", USD + """, pr AS (SELECT b.task, c.model AS configuration, b.usd AS bu, c.usd AS cu, b.output_tokens AS bo, c.output_tokens AS co FROM usd b JOIN usd c USING (item_id) WHERE b.arm = 'baseline' AND c.arm = 'candidate' AND b.status = 'ok' AND c.status = 'ok')
 SELECT task, configuration, count(*) AS n, round(sum(bu), 9) AS baseline_usd, round(sum(cu), 9) AS candidate_usd, CAST(sum(co) AS BIGINT) AS output_tokens, CAST(sum(bo) AS BIGINT) AS baseline_output_tokens, round(sum(co) / sum(bo), 7) AS output_ratio, round(100 * (sum(bu) - sum(cu)) / sum(bu), 6) AS savings_pct FROM pr GROUP BY ALL""", _CP)
def eco_cost_panel(src):
    ok = E.call_cost(src.view("calls").filter("status = 'ok'"), src.view("prices"))
    b = ok.filter("arm = 'baseline'").select("task", "item_id", F.col("usd").alias("b_usd"), F.col("output_tokens").alias("b_out"))
    c = ok.filter("arm = 'candidate'").select("item_id", F.col("model").alias("configuration"), F.col("usd").alias("c_usd"), F.col("output_tokens").alias("c_out"))
    out = E.cost_panel(b.join(c, "item_id"), ("task", "configuration"))
    return rounded(rounded(rounded(out, "output_ratio"), "baseline_usd", "candidate_usd", digits=9), "savings_pct", digits=6)


@query("eco_projection", """ SELECT task, model AS measured_model, 'projection' AS basis, round(sum(input_tokens / 1e6 * 1.25 + output_tokens / 1e6 * 10.0), 9) AS usd FROM calls WHERE status = 'ok' GROUP BY ALL""", ("calls",))
def eco_projection(src):
    ok = src.view("calls").filter("status = 'ok'").select("task", "model", "input_tokens", "output_tokens")
    return E.project(ok, src.view("prices"), "candidate-pro").groupBy("task", "measured_model", "basis").agg(F.round(F.sum("usd"), 9).alias("usd"))


@query("eco_probe", SCORED.replace(", scored AS", ", scored AS", 1) + """, pb AS (SELECT model AS config, count(*) AS calls, count(*) FILTER (WHERE status = 'ok') AS calls_ok, CAST(sum(output_tokens) FILTER (WHERE status = 'ok') AS BIGINT) AS output_tokens, avg(CAST(tag = 'valid' AS INTEGER)) FILTER (WHERE status = 'ok') AS validity,
   quantile_cont(total_ms, 0.5) FILTER (WHERE status = 'ok' AND total_ms IS NOT NULL) AS p50, count(DISTINCT left(split_part(trim(coalesce(error, 'unknown')), ':', 1), 80)) FILTER (WHERE status = 'error') AS error_kinds FROM tagged GROUP BY ALL)
 SELECT config, calls, calls_ok, output_tokens, round(validity, 9) AS validity, p50, error_kinds, round(output_tokens / (SELECT output_tokens FROM pb WHERE config = 'incumbent'), 9) AS output_ratio FROM pb""", ("calls", "items"))
def eco_probe(src):
    from armparity.functions import payload as P
    from armparity.functions.text import error_kind

    ok = F.col("status") == "ok"
    calls = src.view("calls").withColumn("shape", P.shape(F.col("payload_json"))).withColumn("p", P.answer(F.col("payload_json"), F.col("shape")))
    valid = (M.validity_tag(F.col("status"), F.col("task"), F.col("p"), F.col("shape")) == "valid").cast("double")
    sums = calls.withColumn("valid", valid).groupBy(F.col("model").alias("config")).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("calls_ok"), F.sum(F.when(ok, F.col("output_tokens"))).alias("output_tokens"),
        F.round(F.avg(F.when(ok, F.col("valid"))), 9).alias("validity"), F.count_distinct(F.when(~ok, error_kind(F.col("error")))).alias("error_kinds"))
    counts = R.value_counts(src.view("calls").filter(ok).withColumnRenamed("model", "config"), ("config",), "total_ms")
    out = sums.join(R.percentiles_of_counts(counts, ("config",), "total_ms", {"p50": 0.5}), "config")
    # one row per configuration: the window over all of them is as small as the list of models
    from pyspark.sql import Window

    base = F.max(F.when(F.col("config") == "incumbent", F.col("output_tokens"))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("output_ratio", F.round(F.col("output_tokens") / base, 9))


# --- latency ---------------------------------------------------------------------------------

@query("lat_stats", " SELECT task, arm, count(*) AS n_calls, count(total_ms) AS n_total, count(ttft_ms) AS n_ttft, " + ", ".join(
    f"round(quantile_cont({c}, {v}), 6) AS {n}_{p}" for n, c in (("total", "total_ms"), ("ttft", "ttft_ms")) for p, v in (("p50", 0.5), ("p95", 0.95))) + " FROM calls GROUP BY ALL", ("calls",))
def lat_stats(src):
    return rounded(L.latency_stats(src.view("calls"), ("task", "arm")), "total_p50", "total_p95", "ttft_p50", "ttft_p95", digits=6)


def models_of(src):
    s, n, r = src.table("supplier"), src.table("nation"), src.table("region")
    homes = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("home"))
    key = F.col("s_suppkey")
    return s.join(F.broadcast(homes), "s_nationkey").select(
        key.alias("model_id"), "home", F.when(key % 3 == 0, "partner").when(key % 3 == 1, "house").otherwise("other").alias("provider"),
        F.when(key % 5 == 0, "pinned-1").alias("pinned_region"))


ENV = {"partner": {"PARTNER_REGION": None, "REGION": "region-x"}, "house": {"REGION": "region-x"}}
RGN = """WITH m AS (SELECT s_suppkey AS model_id, r_name AS home, CASE s_suppkey % 3 WHEN 0 THEN 'partner' WHEN 1 THEN 'house' ELSE 'other' END AS provider, CASE WHEN s_suppkey % 5 = 0 THEN 'pinned-1' END AS pin
   FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 rg AS (SELECT model_id, coalesce(pin, CASE WHEN provider IN ('partner', 'house') THEN 'region-x' ELSE home END) AS region, CASE WHEN pin IS NOT NULL THEN 'model registry' WHEN provider = 'partner' THEN 'env:REGION (unverified)' WHEN provider = 'house' THEN 'env:REGION' ELSE 'customer profile' END AS region_source FROM m)"""


@query("lat_arm_region", RGN + " SELECT * FROM rg")
def lat_arm_region(src):
    return L.arm_region(models_of(src), ENV, F.col("home")).select("model_id", "region", "region_source")


@query("lat_disclosure", RGN + """ SELECT a.model_id, CASE WHEN a.region <> b.region THEN concat('CROSS-REGION: ', a.region, ' vs ', b.region) WHEN contains(a.region_source, 'unverified') THEN concat('REGION UNVERIFIED: ', a.region) ELSE concat('Same region (', a.region, ')') END AS disclosure
 FROM rg a JOIN rg b ON b.model_id = a.model_id + 1""")
def lat_disclosure(src):
    r = L.arm_region(models_of(src), ENV, F.col("home")).select("model_id", "region", "region_source")
    nxt = r.select((F.col("model_id") - 1).alias("model_id"), F.col("region").alias("candidate_region"))
    return r.join(nxt, "model_id").select("model_id", L.disclosure(F.col("region"), F.col("candidate_region"), F.col("region_source")).alias("disclosure"))


@query("lat_probe_summary", duck_p95("model, region", "true") + """ SELECT s.*, lo, hi FROM (SELECT model, region, count(*) AS n_calls, count(*) FILTER (WHERE status = 'ok') AS calls_ok, round(quantile_cont(total_ms, 0.5), 6) AS total_p50, round(quantile_cont(total_ms, 0.95), 6) AS total_p95, CASE WHEN count(total_ms) < 2 THEN 'fewer than two timings' END AS reason FROM calls GROUP BY ALL) s
  LEFT JOIN (SELECT model, region, round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi FROM p95_r GROUP BY ALL) USING (model, region)""", ("calls",))
def lat_probe_summary(src):
    out = L.probe_summary(src.view("calls"), ("model", "region"), P95_REPS, "hash")
    return rounded(out.select("model", "region", "n_calls", "calls_ok", "total_p50", "total_p95", "lo", "hi", "reason"), "total_p50", "total_p95", "lo", "hi", digits=6)


PRB = """, pb AS (SELECT user_id, CAST(ts AS DATE) AS d, task, min_by(region, call_id) FILTER (WHERE arm = 'baseline') AS br, min_by(CASE WHEN k % 4 = 0 THEN 'region-a' ELSE region END, call_id) FILTER (WHERE arm = 'candidate') AS cr, min_by(model, call_id) FILTER (WHERE arm = 'candidate') AS cm FROM calls GROUP BY ALL)"""


@query("lat_eligible_probes", PRB + """ SELECT user_id, CAST(d AS VARCHAR) AS day, task, CASE WHEN br IS NULL OR cr IS NULL THEN 'one arm was not probed' WHEN br <> cr THEN 'more than one region' WHEN cm <> 'candidate-flash' THEN 'another candidate' END AS reject FROM pb""", ("calls",))
def lat_eligible_probes(src):
    def first(col, arm):
        hit = F.col("arm") == arm
        return F.min_by(F.when(hit, col), F.when(hit, F.col("call_id")))

    shifted = F.when(F.col("k") % 4 == 0, "region-a").otherwise(F.col("region"))
    probes = src.view("calls").groupBy("user_id", F.to_date("ts").cast("string").alias("day"), "task").agg(
        first(F.col("region"), "baseline").alias("baseline_region"), first(shifted, "candidate").alias("candidate_region"), first(F.col("model"), "candidate").alias("candidate_model"))
    return L.eligible_probes(probes, F.col("baseline_region"), "candidate-flash", F.lit("ms")).select("user_id", "day", "task", "reject")


@query("lat_drift", """, p AS (SELECT task, region, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, quantile_cont(total_ms, 0.95) AS p95 FROM calls WHERE arm = 'baseline' AND total_ms IS NOT NULL GROUP BY ALL)
 SELECT task, region, day, round(p95, 6) AS p95, round(p95 - lag(p95) OVER (PARTITION BY task, region ORDER BY day), 6) AS change FROM p""", ("calls",))
def lat_drift(src):
    calls = src.view("calls").filter("arm = 'baseline'").withColumn("day", F.to_date("ts").cast("string"))
    by = ("task", "region", "day")
    p95 = R.percentiles_of_counts(R.value_counts(calls, by, "total_ms"), by, "total_ms", {"p95": 0.95})
    return rounded(L.drift(p95, ("task", "region"), "day").drop("previous"), "p95", "change", digits=6)
