"""Ladder, selection and report frames."""

from pyspark.sql import functions as F

from armparity.functions import render
from armparity.operators import agreement as A
from armparity.operators import crosscheck as X
from armparity.operators import frames as R
from armparity.operators import gates as G
from armparity.operators import judge as J
from armparity.operators import ladder as L
from armparity.operators import latency as LT
from armparity.operators import lineage as LN
from armparity.operators import metrics as M
from armparity.operators import rungs as RG
from armparity.operators import store as ST
from armparity.plans.q_gates import ALT, _VIEWS, checks, evidence
from armparity.plans.q_judge import FOLDED, scored_cells
from armparity.plans.q_metrics import LONG, _pairs
from armparity.plans.q_shadow import _ALL, _SUMMARY, AGREE, TRIAGE, TSUM, XR, shadow_calls, triage
from armparity.plans.registry import query

_S = "strftime({0} + INTERVAL 8 HOUR, '%-d %b %Y, %-I:%M %p')"
REC = """, rec AS (SELECT task, concat('r', k % 8) AS rung, CASE WHEN core THEN 'core' ELSE 'all' END AS split, CASE WHEN status = 'ok' AND k % 8 <> 7 THEN 'measured' ELSE 'no_recordings' END AS status, call_id AS ordinal,
   CASE WHEN status = 'ok' AND k % 8 <> 7 THEN output_tokens / 128 END AS point, k % 9 = 0 AS leaked, 'v1' AS version FROM calls WHERE arm = 'candidate'),
 cur0 AS (SELECT * FROM rec WHERE status = 'measured' QUALIFY row_number() OVER (PARTITION BY task, rung, split ORDER BY ordinal DESC) = 1
   UNION ALL SELECT * FROM rec r WHERE NOT EXISTS (SELECT 1 FROM rec m WHERE m.task = r.task AND m.rung = r.rung AND m.status = 'measured') QUALIFY row_number() OVER (PARTITION BY task, rung ORDER BY ordinal DESC) = 1),
 cur AS (SELECT cur0.*, f.first_seen FROM cur0 JOIN (SELECT task, rung, min(ordinal) AS first_seen FROM rec GROUP BY ALL) f USING (task, rung))"""


def records(src):
    ok = (F.col("status") == "ok") & (F.col("k") % 8 != 7)
    return src.view("calls").filter("arm = 'candidate'").select(
        "task", F.concat(F.lit("r"), (F.col("k") % 8).cast("string")).alias("rung"), F.when(F.col("core"), "core").otherwise("all").alias("split"),
        F.when(ok, "measured").otherwise("no_recordings").alias("status"), F.col("call_id").alias("ordinal"),
        F.when(ok, F.col("output_tokens") / 128).alias("point"), (F.col("k") % 9 == 0).alias("leaked"), F.lit("v1").alias("version"))


def bounded(df):
    return df.withColumns({"lo": F.col("point") - 0.1, "hi": F.col("point") + 0.1})


@query("lad_current", REC + " SELECT task, rung, split, status, ordinal, point, leaked, first_seen FROM cur", ("calls",))
def lad_current(src):
    return L.current_records(records(src)).drop("version")


@query("lad_wide", REC + """, m AS (SELECT task, concat('r', k % 8) AS rung, CASE WHEN core THEN 'core' ELSE 'all' END AS split, round(avg(total_ms), 6) AS ms, round(avg(input_tokens), 6) AS tokens FROM calls WHERE arm = 'candidate' GROUP BY ALL)
 SELECT cur.task, cur.rung, cur.split, leaked, ms, tokens FROM cur LEFT JOIN m USING (task, rung, split)""", ("calls",))
def lad_wide(src):
    rows = src.view("calls").filter("arm = 'candidate'").groupBy(
        "task", F.concat(F.lit("r"), (F.col("k") % 8).cast("string")).alias("rung"), F.when(F.col("core"), "core").otherwise("all").alias("split")).agg(
        F.round(F.avg("total_ms"), 6).alias("ms"), F.round(F.avg("input_tokens"), 6).alias("tokens")).unpivot(
        ["task", "rung", "split"], ["ms", "tokens"], "metric", "value")
    return L.wide(L.current_records(records(src)), rows, ["ms", "tokens"]).select("task", "rung", "split", "leaked", "ms", "tokens")


VS = REC + """, vs AS (SELECT c.*, CASE WHEN i.point IS NULL THEN 'no incumbent on this split' WHEN c.rung = 'r0' THEN 'incumbent' WHEN c.point IS NULL THEN '—' WHEN c.point - 0.1 > i.point THEN 'clears' WHEN c.point + 0.1 < i.point THEN 'below' ELSE 'parity' END AS versus
  FROM cur c LEFT JOIN (SELECT task, split, point FROM cur WHERE rung = 'r0') i USING (task, split))"""


@query("lad_versus_incumbent", VS + " SELECT task, rung, split, point, versus FROM vs", ("calls",))
def lad_versus_incumbent(src):
    return L.versus_incumbent(bounded(L.current_records(records(src))), "r0").select("task", "rung", "split", "point", "versus")


@query("lad_selection", REC + """ SELECT 'ladder' AS origin, split, task, rung, point FROM cur UNION ALL SELECT 'gated', 'all', task, arm, avg(CAST(status = 'ok' AS INTEGER)) FROM calls GROUP BY task, arm""", ("calls",))
def lad_selection(src):
    gated = src.view("calls").groupBy("task", F.col("arm").alias("rung")).agg(F.avg((F.col("status") == "ok").cast("double")).alias("point")).withColumn("split", F.lit("all"))
    return L.selection_rows(L.current_records(records(src)).select("split", "task", "rung", "point"), gated).select("origin", "split", "task", "rung", "point")


@query("lad_ship_arms", REC + """, ch AS (SELECT DISTINCT task, CASE task WHEN 'query_rewriter' THEN 'r3' WHEN 'chunk_summarizer' THEN 'r7' ELSE 'r9' END AS rung FROM calls)
 SELECT ch.task, ch.rung, split, CASE WHEN cur.status IS NULL THEN 'no such rung' WHEN cur.status <> 'measured' THEN 'never measured' END AS reject FROM ch LEFT JOIN cur USING (task, rung)""", ("calls",))
def lad_ship_arms(src):
    rung = F.when(F.col("task") == "query_rewriter", "r3").when(F.col("task") == "chunk_summarizer", "r7").otherwise("r9")
    choice = src.view("calls").select("task").distinct().withColumn("rung", rung)
    cur = L.current_records(records(src))
    out = L.ship_arms(cur, choice).join(cur.select("task", "rung", "split", F.col("point").alias("_p")), ["task", "rung"], "left")
    return out.filter(F.col("point").eqNullSafe(F.col("_p"))).select("task", "rung", "split", "reject").distinct()


@query("lad_append", REC + " SELECT task, rung, count(*) AS n, max(ordinal) AS last FROM (SELECT task, rung, ordinal FROM rec UNION ALL SELECT task, 'new', ordinal + 1000000000 FROM rec WHERE rung = 'r1') GROUP BY ALL", ("calls",))
def lad_append(src):
    prior = records(src)
    new = prior.filter("rung = 'r1'").withColumns({"rung": F.lit("new"), "ordinal": F.col("ordinal") + 1000000000})
    return L.append_records(prior, new).groupBy("task", "rung").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"))


@query("lad_preferred", """, a AS (SELECT user_id, CASE k % 3 WHEN 0 THEN 'capped' WHEN 1 THEN 'current' ELSE 'draft' END AS kind, call_id AS ordinal FROM calls)
 SELECT user_id, kind, ordinal FROM a WHERE kind <> 'draft' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE kind WHEN 'capped' THEN 1 ELSE 2 END, ordinal DESC) = 1""", ("calls",))
def lad_preferred(src):
    kind = F.when(F.col("k") % 3 == 0, "capped").when(F.col("k") % 3 == 1, "current").otherwise("draft")
    art = src.view("calls").select("user_id", kind.alias("kind"), F.col("call_id").alias("ordinal"))
    return L.preferred(art, ["capped", "current"], ("user_id",))


ORDER = ["json_schema_validity", "filter_f1", "citation_coverage", "extraction_accuracy"]


@query("rpt_metrics", LONG + """, am AS (SELECT task, arm, metric, count(value) AS n, avg(value) AS mean, count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable FROM outcomes GROUP BY ALL)
 SELECT task, arm, metric, CAST(list_position(['json_schema_validity', 'filter_f1', 'citation_coverage', 'extraction_accuracy'], metric) AS BIGINT) AS rank, n, n_not_applicable, format('{:.3f}', mean) AS shown FROM am WHERE rank IS NOT NULL""", ("calls", "items"))
def rpt_metrics(src):
    return R.metrics_frame(M.arm_metrics(M.outcomes(_pairs(src))), ORDER).select("task", "arm", "metric", "rank", "n", "n_not_applicable", "shown")


@query("rpt_judge", FOLDED + """ SELECT task, arm, split, concat(format('{:.3f}', avg(item_mean)), ' (judged n=', count(item_mean), ', split=', split, ')') AS shown FROM (SELECT *, CASE WHEN item_id % 5 < 2 THEN 'core' ELSE 'rest' END AS split FROM folded) GROUP BY task, arm, split""", ("cells", "verdicts"))
def rpt_judge(src):
    items = J.fold_repeats(scored_cells(src, "gated")).withColumn("split", F.when(F.col("item_id") % 5 < 2, "core").otherwise("rest"))
    return R.judge_frame(J.aggregate_repeats(items, 2, ("task", "arm", "split"))).select("task", "arm", "split", "shown")


@query("rpt_ablation", REC + """, m AS (SELECT task, concat('r', k % 8) AS rung, avg(CASE WHEN k % 8 < 4 THEN total_ms END) AS ms, avg(input_tokens) AS tokens FROM calls WHERE arm = 'candidate' GROUP BY ALL)
 SELECT task, rung, split, CASE WHEN cur.status = 'measured' THEN 'measured' ELSE 'no recordings' END AS state, CASE WHEN ms IS NOT NULL THEN 'ms' ELSE 'tokens' END AS metric, round(coalesce(ms, tokens), 6) AS value FROM cur LEFT JOIN m USING (task, rung)""", ("calls",))
def rpt_ablation(src):
    m = src.view("calls").filter("arm = 'candidate'").groupBy("task", F.concat(F.lit("r"), (F.col("k") % 8).cast("string")).alias("rung")).agg(
        F.avg(F.when(F.col("k") % 8 < 4, F.col("total_ms"))).alias("ms"), F.avg("input_tokens").alias("tokens"))
    out = R.ablation_frame(L.current_records(records(src)).join(m, ["task", "rung"], "left"), "ms", "tokens")
    return out.select("task", "rung", "split", "state", "metric", F.round("value", 6).alias("value"))


@query("rpt_agreement", AGREE + f" SELECT task, metric, n_compared, CASE metric WHEN 'item' THEN agreement ELSE structured_agreement END AS value FROM ({_SUMMARY}), (VALUES ('item'), ('structured')) v(metric)", ("calls", "items"))
def rpt_agreement(src):
    s = A.agreement_summary(A.compare_items(shadow_calls(src), "baseline", "candidate"))
    rows = F.array(F.struct(F.lit("item").alias("metric"), F.col("agreement").alias("value")), F.struct(F.lit("structured").alias("metric"), F.col("structured_agreement").alias("value")))
    return s.select("task", "n_compared", F.inline(rows)).withColumn("value", F.round("value", 9))


@query("rpt_triage", TRIAGE + " SELECT tv.item_id, tv.verdict, (SELECT string_agg(field, ', ' ORDER BY field) FROM fa WHERE fa.item_id = tv.item_id AND NOT ok) AS fields FROM tv", _ALL)
def rpt_triage(src):
    return triage(src).select("item_id", "verdict", F.array_join(F.array_sort("disagreeing"), ", ").alias("fields"))


@query("rpt_latency", " SELECT task, arm, metric, round(CASE metric WHEN 'total_p50' THEN a WHEN 'total_p95' THEN b ELSE c END, 6) AS value FROM (SELECT task, arm, quantile_cont(total_ms, 0.5) AS a, quantile_cont(total_ms, 0.95) AS b, quantile_cont(ttft_ms, 0.95) AS c FROM calls GROUP BY ALL), (VALUES ('total_p50'), ('total_p95'), ('ttft_p95')) v(metric)", ("calls",))
def rpt_latency(src):
    return R.latency_frame(LT.latency_stats(src.view("calls"), ("task", "arm")), ["total_p50", "total_p95", "ttft_p95"]).withColumn("value", F.round("value", 6))


def _number(x):
    return (f"CASE g.unit WHEN 'fraction' THEN format('{{:.3f}}', {x}) WHEN 'percent' THEN format('{{:.1f}}%', {x}) WHEN 'ms' THEN concat(format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)), ' ms')"
            f" ELSE format('{{:+.2f}} pp', {x}) END")


@query("rpt_scorecard", ALT + """ SELECT ev.task, g.ordinal, g.gate, g.bound, CASE WHEN c.passed IS NULL THEN 'not evaluated' WHEN c.passed THEN 'PASS' WHEN alt_passed THEN concat('PASS (by alternative clause: ', wins, 'W/', losses, 'L)') ELSE 'FAIL' END AS result, ev.reason,
  CASE WHEN ev.point IS NULL THEN CASE WHEN g.gate = 'latency_p95' THEN 'region split: not comparable' ELSE 'not measured' END
   ELSE concat(""" + ", ".join([_number("ev.point"), "' ['", _number("ev.lo"), "', '", _number("ev.hi"), "']'"]) + """,
    CASE WHEN g.unit = 'percentage_points' THEN concat(' (paired n=', ev.n, CASE WHEN ev.dropped > 0 THEN concat(', ', ev.dropped, ' unpaired dropped') ELSE '' END, ')') WHEN g.gate = 'latency_p95' THEN ' (same-region probe, global)' ELSE '' END) END AS measured
 FROM ev JOIN gates g USING (gate) LEFT JOIN chk3 c ON c.task = ev.task AND c.gate = ev.gate""", _VIEWS)
def rpt_scorecard(src):
    alt = G.apply_alternatives(src.once(checks), A.triage_summary(triage(src)))
    table = R.gate_table(src.once(evidence), alt, src.view("gates"), F.lit(True), F.lit(True))
    return table.select("task", "ordinal", "gate", "bound", "result", "reason", "measured")


@query("rpt_figures", XR + " SELECT task, arm, judge, round(CASE judge WHEN 'gated' THEN ra ELSE rb END, 9) AS pass_rate FROM rep, (VALUES ('gated'), ('check')) v(judge) WHERE arm IS NOT NULL", ("cells", "verdicts"))
def rpt_figures(src):
    """Pass rates per judge, chart-ready."""
    rep = X.agreement_report(X.pair_cells(scored_cells(src), "gated", "check")).filter("arm is not null")
    rows = rep.select("task", "arm", F.col("rate_a").alias("gated"), F.col("rate_b").alias("check")).unpivot(["task", "arm"], ["gated", "check"], "judge", "pass_rate")
    return rows.withColumn("pass_rate", F.round("pass_rate", 9))


@query("rpt_banner", f" SELECT task, concat('replayed ', count(*), ' calls over ', count(DISTINCT model), ' models; Recorded ', {_S.format('min(ts)')}, ' (SGT) → ', {_S.format('max(ts)')}, ' (SGT)') AS banner FROM calls GROUP BY ALL", ("calls",))
def rpt_banner(src):
    return R.lineage_banner(src.view("calls"))


@query("rpt_cells", """ SELECT user_id, task, CASE WHEN user_id % 4 = 0 THEN '— (prices unverified)' WHEN user_id % 4 = 1 THEN 'not measured' ELSE format('{:.3f}', avg(output_tokens)) END AS cost,
  CASE WHEN user_id % 3 = 0 AND avg(total_ms) IS NOT NULL THEN concat(format('{:.3f}', avg(total_ms)), ' (same-region probe, global)') ELSE 'region split: not comparable' END AS latency FROM calls GROUP BY user_id, task""", ("calls",))
def rpt_cells(src):
    s = src.view("calls").groupBy("user_id", "task").agg(F.avg("output_tokens").alias("o"), F.avg("total_ms").alias("t"))
    u = F.col("user_id")
    fixed = lambda c: F.call_function("format_number", c, F.lit("0.000"))
    return s.select("user_id", "task", render.cost_cell(u % 4 != 0, F.when(u % 4 != 1, fixed("o"))).alias("cost"),
                    render.latency_cell(fixed("t"), u % 3 == 0, F.lit("global")).alias("latency"))


@query("rpt_clause_text", TSUM + """ SELECT task, CASE WHEN wins + losses + ties = 0 THEN 'cannot be evaluated' WHEN wins_malformed + losses_malformed = 0 THEN CASE WHEN wins >= losses THEN 'passes the clause' ELSE 'fails the clause' END
  WHEN (wins >= losses) = (wins - wins_malformed >= losses - losses_malformed) THEN CASE WHEN wins >= losses THEN 'passes on either figure' ELSE 'fails on either figure' END
  WHEN wins >= losses THEN 'passes overall, not on the quality-only tally' ELSE 'fails overall, though the quality-only tally clears' END AS clause FROM ts""", _ALL)
def rpt_clause_text(src):
    s = A.triage_summary(triage(src))
    return s.select("task", A.clause_text(s).alias("clause"))


@query("rpt_footer", XR + " SELECT task, concat(task, ' ', format('{:.1f}%', ag * 100), ' (kappa ', format('{:.3f}', (ag - ex) / (1 - ex)), ', ', CASE WHEN ag >= 0.85 THEN 'VALIDATED' ELSE 'UNRELIABLE' END, ')') AS line FROM rep WHERE arm IS NULL", ("cells", "verdicts"))
def rpt_footer(src):
    return R.footer_line(X.agreement_report(X.pair_cells(scored_cells(src), "gated", "check")))


@query("rpt_models", f""", w AS (SELECT model, min(ts) AS a, max(ts) AS b, count(*) AS n FROM calls GROUP BY ALL), md AS (SELECT DISTINCT unnest([model, concat(model, '-next')]) AS model FROM calls)
 SELECT md.model, CASE WHEN md.model = 'incumbent' THEN 'baseline' WHEN md.model LIKE '%-next' THEN 'spare' ELSE 'candidate' END AS role, CASE WHEN md.model = 'incumbent' THEN 1 WHEN md.model LIKE '%-next' THEN 3 ELSE 2 END AS rank,
  coalesce(concat('Recorded ', {_S.format('a')}, ' (SGT) → ', {_S.format('b')}, ' (SGT)'), 'never called') AS recorded, coalesce(n, 0) AS n_calls FROM md LEFT JOIN w USING (model)""".replace("coalesce(concat('Recorded ',", "CASE WHEN a IS NULL THEN 'never called' ELSE concat('Recorded ',").replace("' (SGT)'), 'never called') AS recorded", "' (SGT)') END AS recorded"), ("calls",))
def rpt_models(src):
    calls = src.view("calls")
    names = calls.select("model").distinct().select(F.explode(F.array("model", F.concat("model", F.lit("-next")))).alias("model"))
    models = names.withColumn("role", F.when(F.col("model") == "incumbent", "baseline").when(F.col("model").endswith("-next"), "spare").otherwise("candidate"))
    return R.models_page(models, ST.recording_window(calls, ("model",)), ["baseline", "candidate"])


# --- rungs as rows, lineage ------------------------------------------------------------------

def rung_rows(src):
    """Rungs of the given parts: each builds on the part a quarter of its key, and states what it changes."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    parent = F.when(p >= 4, F.concat(F.lit("r"), F.expr("p_partkey div 4").cast("string")))
    entries = F.array(
        F.when(parent.isNull() | (size % 3 == 0), F.struct(F.lit("model").alias("key"), F.col("p_brand").alias("value"))),
        F.when(size % 5 == 0, F.struct(F.lit("prompt").alias("key"), F.concat(F.lit("pack "), size.cast("string")).alias("value"))))
    return src.table("part").select(F.lit("query_rewriter").alias("task"), F.concat(F.lit("r"), p.cast("string")).alias("rung"), parent.alias("parent"),
                                    F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("settings"))


@query("lad_rungs", """WITH RECURSIVE w AS (SELECT p_partkey AS id, p_brand AS model, CASE WHEN CAST(p_size AS BIGINT) % 5 = 0 THEN concat('pack ', CAST(p_size AS BIGINT)) END AS prompt, 0 AS depth, concat('r', p_partkey) AS path FROM part WHERE p_partkey < 4
 UNION ALL SELECT p.p_partkey, CASE WHEN CAST(p.p_size AS BIGINT) % 3 = 0 THEN p.p_brand ELSE w.model END, CASE WHEN CAST(p.p_size AS BIGINT) % 5 = 0 THEN concat('pack ', CAST(p.p_size AS BIGINT)) ELSE w.prompt END, w.depth + 1, concat(w.path, '>r', p.p_partkey)
  FROM part p JOIN w ON p.p_partkey // 4 = w.id WHERE p.p_partkey >= 4)
 SELECT 'query_rewriter' AS task, concat('r', id) AS rung, model, prompt, depth, path FROM w UNION ALL SELECT 'feature_extractor', 'extra', 'plain', 'own', 0, 'extra'""")
def lad_rungs(src):
    """Registered rungs with what they inherit."""
    extra = src.spark.sql("SELECT 'feature_extractor' AS task, 'extra' AS rung, CAST(NULL AS STRING) AS parent, map('model', 'plain', 'prompt', 'own') AS settings")
    found = RG.resolve(RG.register(rung_rows(src), extra, ["query_rewriter", "feature_extractor"]))
    return found.select("task", "rung", F.col("settings")["model"].alias("model"), F.col("settings")["prompt"].alias("prompt"), "depth", F.array_join("path", ">").alias("path"))


_ARM = "count(*) AS n, round(avg(CAST(status = 'ok' AS INTEGER)), 9) AS point, CAST(min(ts) AS VARCHAR)[:19] AS recorded_from, CAST(max(ts) AS VARCHAR)[:19] AS recorded_to"


@query("lad_candidate", f""", arms AS (SELECT task, 'baseline' AS arm, 'incumbent' AS variant, {_ARM} FROM calls WHERE arm = 'baseline' AND k < 50 GROUP BY task
  UNION ALL SELECT task, 'candidate', concat('r', length(task) % 8, ' v', length(task) % 3), {_ARM} FROM calls WHERE arm = 'candidate' AND k % 8 = length(task) % 8 GROUP BY task)
 SELECT *, min(recorded_from) OVER () AS window_from, max(recorded_to) OVER () AS window_to FROM arms""", ("calls",))
def lad_candidate(src):
    """The arms a candidate is scored on, and the window both recordings span."""
    calls = src.view("calls").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    arm = [F.count("*").alias("n"), F.round(F.avg((F.col("status") == "ok").cast("double")), 9).alias("point"), F.min("at").alias("recorded_from"), F.max("at").alias("recorded_to")]
    ships = F.concat(F.lit("v"), (F.length("task") % 3).cast("string"))
    records = calls.filter("arm = 'candidate'").groupBy("task", F.concat(F.lit("r"), (F.col("k") % 8).cast("string")).alias("rung")).agg(*arm).withColumns({"variant": ships, "status": F.lit("measured")})
    baselines = calls.filter("arm = 'baseline' and k < 50").groupBy("task").agg(*arm).withColumn("variant", F.lit("incumbent"))
    choice = calls.select("task").distinct().select("task", F.concat(F.lit("r"), (F.length("task") % 8).cast("string")).alias("rung"), ships.alias("variant"))
    return RG.candidate_arms(records, choice, baselines)


_PRINTED = ["call_id", "item_id", "arm", "model", "status", "total_ms", "error"]
_PRINT = """, d AS (SELECT task, md5(concat(""" + ", ".join(f"CASE WHEN {c} IS NULL THEN '~' ELSE concat(length(CAST({c} AS VARCHAR)), ':', {c}) END" for c in _PRINTED) + """)) AS h FROM calls),
 fp AS (SELECT task, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS sum_a, CAST(sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS sum_b FROM d GROUP BY ALL)"""


def store_prints(src):
    """Fingerprints of a store written in a base and two appends, added up without reading the base again."""
    calls = src.view("calls")
    parts = [LN.fingerprint(calls.filter(F.expr(f"call_id % 7 in ({keys})")), ("task",), _PRINTED) for keys in ("0, 1, 2, 3", "4, 5", "6")]
    held = parts[0]
    for part in parts[1:]:
        held = LN.merge(held.unionByName(part), ("task",))
    return held


@query("rpt_fingerprint", _PRINT + " SELECT task, n, sum_a, sum_b, lower(concat(n, '-', lpad(to_hex(sum_a), 15, '0'), lpad(to_hex(sum_b), 15, '0'))) AS print FROM fp", ("calls",))
def rpt_fingerprint(src):
    return store_prints(src).withColumn("print", LN.text(F.col("n"), F.col("sum_a"), F.col("sum_b")))


@query("rpt_lineage", _PRINT + f""", b AS (SELECT task, concat('replayed ', count(*), ' calls over ', count(DISTINCT model), ' models; Recorded ', {_S.format('min(ts)')}, ' (SGT) → ', {_S.format('max(ts)')}, ' (SGT)') AS banner FROM calls GROUP BY ALL),
 m AS (SELECT task, string_agg(DISTINCT CAST(seed AS VARCHAR), '/' ORDER BY CAST(seed AS VARCHAR)) AS seeds, string_agg(DISTINCT generator_version, '/' ORDER BY generator_version) AS versions FROM items GROUP BY ALL)
 SELECT task, concat(banner, '; seeds ', seeds, '; generator ', versions, '; store ', lower(concat(n, '-', lpad(to_hex(sum_a), 15, '0'), lpad(to_hex(sum_b), 15, '0')))) AS banner FROM b JOIN m USING (task) JOIN fp USING (task)""", ("calls", "items"))
def rpt_lineage(src):
    """The banner with seeds, versions and the store's fingerprint."""
    return LN.banner(src.view("calls"), src.view("items"), store_prints(src))
