"""Agreement, triage, cross-check."""

import pandas as pd
from pyspark.sql import functions as F

from armparity.functions import payload as P
from armparity.functions.plan import filter_above
from armparity.operators import agreement as A
from armparity.operators import crosscheck as X
from armparity.operators import judge as J
from armparity.operators import metrics as M
from armparity.operators import ranking as R
from armparity.operators import stats as S
from armparity.plans.q_judge import CELL_SCORES, scored_cells
from armparity.plans.q_metrics import SCORED, _C, _N
from armparity.plans.q_stats import REPS, duck_replicates, q
from armparity.plans.registry import query

_VIEWS = ("calls", "items")
_ALL = ("calls", "items", "cells", "verdicts")


def shadow_calls(src):
    """The live slice: some candidate calls answer an item that the baseline never saw, whose own item then lacks a candidate."""
    astray = (F.col("arm") == "candidate") & (F.col("k") == 99)
    return src.view("calls").withColumn("item_id", F.col("item_id") + F.when(astray, 10**12).otherwise(0))


def _fv_row(task, field, kind):
    path = "$." + field
    if field == "key_points.text":
        val = "CASE WHEN json_type(j, '$.key_points') = 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.key_points[*]'), lambda x: coalesce(x->>'$.text', '')), chr(10)) ELSE '' END"
    elif field == "key_points.chunk_ids":
        val = f"""coalesce(array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(CASE WHEN json_type(j, '$.key_points') = 'ARRAY' THEN json_extract(j, '$.key_points[*]') ELSE [] END,
          lambda x: coalesce(CAST(x->'$.chunk_ids' AS VARCHAR[]), []))), lambda y: {_N.format('y')}))), '|'), '')"""
    elif kind == "prose":
        val = f"j->>'{path}'"
    elif kind.endswith("_set"):
        norm = (_C if kind == "code_set" else _N).format("x")
        val = f"coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(CAST(json_extract(j, '{path}') AS VARCHAR[]), []), lambda x: x <> ''), lambda x: {norm}))), '|'), '')"
    else:
        val = (_C if kind == "code" else _N).format(f"j->>'{path}'")
        if field == "independent_claim_count":
            val = f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN 'text ' || ({val}) ELSE {val} END"
    return f"SELECT item_id + CASE WHEN arm = 'candidate' AND k = 99 THEN 1000000000000 ELSE 0 END AS item_id, arm, task, j IS NOT NULL AS answered, '{field}' AS field, '{kind}' AS kind, {val} AS val FROM scored WHERE task = '{task}'"


FV = SCORED + ", fvals AS (" + " UNION ALL ".join(_fv_row(t, f, k) for t, ks in P.AGREEMENT_KINDS.items() for f, k in ks.items()) + ")"
_TOKS = "list_distinct(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'))"
AGREE = FV + f""", cmp AS (SELECT coalesce(b.task, c.task) AS task, coalesce(b.item_id, c.item_id) AS item_id, coalesce(b.field, c.field) AS field, coalesce(b.kind, c.kind) AS kind,
   b.item_id IS NOT NULL AS hb, c.item_id IS NOT NULL AS hc, coalesce(b.answered, false) AS ba, coalesce(c.answered, false) AS ca, b.val AS bv, c.val AS cv
   FROM (SELECT * FROM fvals WHERE arm = 'baseline') b FULL JOIN (SELECT * FROM fvals WHERE arm = 'candidate') c ON b.item_id = c.item_id AND b.field = c.field),
 sim AS (SELECT *, CASE WHEN kind = 'prose' AND ba AND ca THEN CASE WHEN coalesce(trim(bv), '') = '' AND coalesce(trim(cv), '') = '' THEN 1.0 WHEN coalesce(trim(bv), '') = '' OR coalesce(trim(cv), '') = '' THEN 0.0
   WHEN len(list_distinct(list_concat({_TOKS.format('bv')}, {_TOKS.format('cv')}))) = 0 THEN 1.0
   ELSE len(list_intersect({_TOKS.format('bv')}, {_TOKS.format('cv')})) / len(list_distinct(list_concat({_TOKS.format('bv')}, {_TOKS.format('cv')}))) END END AS s FROM cmp),
 fa AS (SELECT *, CASE WHEN NOT (ba AND ca) THEN false WHEN kind = 'prose' THEN s >= 0.6 ELSE bv IS NOT DISTINCT FROM cv END AS ok FROM sim),
 ia AS (SELECT task, item_id, bool_or(hb) AS hb, bool_or(hc) AS hc, bool_or(ba OR ca) AS comparable, CASE WHEN bool_or(ba OR ca) THEN bool_and(ok) END AS agreed,
   CASE WHEN bool_or(ba OR ca) THEN bool_and(ok OR (kind = 'prose' AND ba AND ca)) END AS structured,
   CASE WHEN bool_or(ba) AND NOT bool_or(ca) THEN 'candidate' WHEN bool_or(ca) AND NOT bool_or(ba) THEN 'baseline' END AS empty_arm FROM fa GROUP BY ALL)"""


@query("shd_field_values", FV + " SELECT item_id, arm, field, kind, val AS value FROM fvals", _VIEWS)
def shd_field_values(src):
    rows = shadow_calls(src).withColumn("shape", P.shape(F.col("payload_json"))).withColumn("p", P.answer(F.col("payload_json"), F.col("shape")))
    out = rows.select("item_id", "arm", F.inline(A.field_values(F.col("task"), F.col("p"), F.col("shape"))))
    return out.withColumn("value", F.replace("value", F.lit("\u0001"), F.lit("|")))


@query("shd_compare_field", AGREE + " SELECT item_id, field, kind, ok AS agreed, round(s, 9) AS similarity FROM fa WHERE ba OR ca", _VIEWS)
def shd_compare_field(src):
    items = A.compare_items(shadow_calls(src), "baseline", "candidate")
    return items.filter("comparable").select("item_id", F.inline("fields")).withColumn("similarity", F.round("similarity", 9))


@query("shd_compare_item", AGREE + """ SELECT item_id, comparable, agreed, structured AS structured_agreed, empty_arm, CASE WHEN NOT comparable THEN 'no structured output from either arm' END AS reason FROM ia""", _VIEWS)
def shd_compare_item(src):
    return A.compare_items(shadow_calls(src), "baseline", "candidate").select(
        "item_id", "comparable", "agreed", "structured_agreed", "empty_arm", "reason")


def aligned_share(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the words of the longest common subsequence over all words of both texts."""

    def rate(a: str, b: str) -> float:
        a, b = a.lower().split(), b.lower().split()
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b))

    return pd.Series([rate(a, b) for a, b in zip(left, right)], dtype=float)


@query("shd_compare_aligned", None)
def shd_compare_aligned(src):
    """Fields compared by a caller's own score of prose, which looks at the order of words."""
    items = A.compare_items(shadow_calls(src), "baseline", "candidate", A.Scorer(aligned_share))
    return items.filter("comparable").select("task", "item_id", F.inline("fields"))


_SUMMARY = """SELECT task, count(*) AS n_items, count(*) FILTER (WHERE comparable) AS n_compared, count(*) FILTER (WHERE agreed) AS n_agreed, count(*) FILTER (WHERE structured) AS n_structured,
  count(*) FILTER (WHERE NOT comparable) AS n_excluded, count(empty_arm) AS n_one_arm_empty, round(avg(CAST(agreed AS INTEGER)), 9) AS agreement, round(avg(CAST(structured AS INTEGER)), 9) AS structured_agreement FROM ia GROUP BY ALL"""


@query("shd_agreement", AGREE + ", ag AS (SELECT task, item_id, CAST(agreed AS INTEGER) AS value FROM ia WHERE comparable)" + duck_replicates("g", "ag", "task", "item_id", ["value"])
       + f""" SELECT s.*, lo, hi FROM ({_SUMMARY}) s JOIN (SELECT task, {q('s_value / sw', 0.025)} AS lo, {q('s_value / sw', 0.975)} AS hi FROM g_r GROUP BY ALL) USING (task)""", _VIEWS)
def shd_agreement(src):
    items = A.compare_items(shadow_calls(src), "baseline", "candidate")
    est = S.mean_estimate(items.withColumn("value", F.col("agreed").cast("double")), ("task",), resamples=REPS, method="hash")
    out = A.agreement_summary(items).join(est.select("task", "lo", "hi"), "task", "left")
    return out.withColumns({c: F.round(c, 9) for c in ("agreement", "structured_agreement", "lo", "hi")})


@query("shd_field_rates", AGREE + """ SELECT task, field, kind, count(*) AS n, round(avg(CAST(ok AS INTEGER)), 9) AS rate, round(avg(s), 9) AS mean_similarity FROM fa WHERE ba AND ca GROUP BY ALL""", _VIEWS)
def shd_field_rates(src):
    items = A.compare_items(shadow_calls(src), "baseline", "candidate")
    return A.field_rates(items).withColumns({c: F.round(c, 9) for c in ("rate", "mean_similarity")})


def triage(src):
    calls = shadow_calls(src)
    items = A.compare_items(calls, "baseline", "candidate")
    judged = src.view("items").filter("task <> 'query_rewriter' or core").select("task", "item_id")
    cells = scored_cells(src, "gated").withColumn("overall", F.concat(F.lit("note "), F.col("k").cast("string")))
    base = calls.filter("arm = 'baseline'").withColumn("shape", P.shape(F.col("payload_json"))).withColumn("p", P.answer(F.col("payload_json"), F.col("shape")))
    reason = M.malformed_reason(F.col("status"), F.col("error"), F.col("task"), F.col("p"), F.col("shape"), F.col("payload_json"))
    malformed = filter_above(base.select("task", "item_id", reason.alias("baseline_malformed")), F.col("baseline_malformed").isNotNull())
    return A.adjudicate(items, judged, cells, malformed, "baseline", "candidate")


TRIAGE = AGREE + CELL_SCORES + """, js AS (SELECT item_id, arm, avg(score) AS score, count(score) AS n, min(repeat) FILTER (WHERE status = 'ok') AS first FROM cs WHERE judge = 'gated' GROUP BY ALL),
 bad AS (SELECT item_id FROM tagged LEFT JOIN (SELECT DISTINCT call_id AS cid FROM (SELECT call_id, task, TRY_CAST(j->>('$.' || key) AS JSON) AS ij FROM (SELECT call_id, task, j, unnest(json_keys(j)) AS key FROM scored) WHERE json_type(j, '$.' || key) = 'VARCHAR')
     WHERE json_type(ij) = 'OBJECT' AND len(list_filter(json_keys(ij), lambda x: list_contains(CASE task WHEN 'query_rewriter' THEN ['query', 'filters', 'intent'] WHEN 'chunk_summarizer' THEN ['summary', 'key_points']
      ELSE ['title', 'assignee', 'filing_date', 'jurisdiction', 'cpc_codes', 'technical_field', 'independent_claim_count', 'novelty_statement'] END, x))) >= 2) ON cid = call_id
   WHERE arm = 'baseline' AND (tag <> 'valid' OR cid IS NOT NULL)),
 tr AS (SELECT ia.task, ia.item_id, bs.score AS b_score, c2.score AS c_score, bs.first AS bf, c2.first AS cf, CASE WHEN ia.item_id >= 1000000000000 OR (ia.task = 'query_rewriter' AND ia.item_id % 5 >= 2) THEN 'outside the judged split'
    WHEN NOT (hb AND hc) THEN 'one arm has no call for this item' WHEN bs.score IS NULL AND c2.score IS NULL THEN 'no verdict for baseline, candidate'
    WHEN bs.score IS NULL THEN 'no verdict for baseline' WHEN c2.score IS NULL THEN 'no verdict for candidate' END AS reason, ia.item_id IN (SELECT item_id FROM bad) AS malformed
   FROM ia LEFT JOIN js bs ON bs.item_id = ia.item_id AND bs.arm = 'baseline' LEFT JOIN js c2 ON c2.item_id = ia.item_id AND c2.arm = 'candidate' WHERE agreed = false),
 tv AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'not_adjudicated' WHEN c_score > b_score THEN 'win' WHEN c_score < b_score THEN 'loss' ELSE 'tie' END AS verdict FROM tr)"""


@query("shd_adjudicate", TRIAGE + " SELECT task, item_id, verdict, reason, round(b_score, 9) AS b_score, round(c_score, 9) AS c_score, malformed FROM tv", _ALL)
def shd_adjudicate(src):
    return triage(src).select("task", "item_id", "verdict", "reason", F.round("b_score", 9).alias("b_score"), F.round("c_score", 9).alias("c_score"),
                              F.col("baseline_malformed").isNotNull().alias("malformed"))


@query("shd_rationale", TRIAGE + """, lose AS (SELECT item_id, verdict, CASE verdict WHEN 'win' THEN 'baseline' ELSE 'candidate' END AS loser, CASE verdict WHEN 'win' THEN bf ELSE cf END AS lf, CASE verdict WHEN 'win' THEN cf ELSE bf END AS wf
    FROM tv WHERE verdict IN ('win', 'loss')),
  lv AS (SELECT l.item_id, l.verdict, l.loser, v.criterion_id, v.rationale, w.passed AS other FROM lose l JOIN verdicts v ON v.item_id = l.item_id AND v.arm = l.loser AND v.repeat = l.lf AND v.judge = 'gated' AND NOT v.passed
    LEFT JOIN verdicts w ON w.item_id = l.item_id AND w.arm <> l.loser AND w.repeat = l.wf AND w.judge = 'gated' AND w.criterion_id = v.criterion_id)
 SELECT l.item_id, l.verdict, coalesce((SELECT concat(loser, ' lost on [', criterion_id, ']: ', rationale) FROM lv WHERE lv.item_id = l.item_id AND other ORDER BY criterion_id LIMIT 1),
   (SELECT concat(loser, ' failed [', criterion_id, ']: ', rationale) FROM lv WHERE lv.item_id = l.item_id ORDER BY criterion_id LIMIT 1),
   concat(l.loser, ' scored lower; note ', (SELECT k FROM calls c WHERE c.item_id = l.item_id AND c.arm = l.loser))) AS rationale FROM lose l
 UNION ALL SELECT item_id, verdict, concat('equal scores; on candidate: note ', (SELECT k FROM calls c WHERE c.item_id = tv.item_id AND c.arm = 'candidate')) FROM tv WHERE verdict = 'tie'""", _ALL)
def shd_rationale(src):
    return triage(src).filter("verdict <> 'not_adjudicated'").select("item_id", "verdict", "rationale")


TSUM = TRIAGE + """, ts AS (SELECT task, count(*) AS disagreements, count(*) FILTER (WHERE verdict = 'win') AS wins, count(*) FILTER (WHERE verdict = 'loss') AS losses, count(*) FILTER (WHERE verdict = 'tie') AS ties,
  count(*) FILTER (WHERE verdict = 'not_adjudicated') AS not_adjudicated, count(*) FILTER (WHERE verdict = 'win' AND malformed) AS wins_malformed, count(*) FILTER (WHERE verdict = 'loss' AND malformed) AS losses_malformed FROM tv GROUP BY ALL)"""


@query("shd_triage_summary", TSUM + """ SELECT *, CASE WHEN wins + losses + ties > 0 THEN wins >= losses END AS wins_ge_losses,
  CASE WHEN wins + losses + ties > 0 THEN wins - wins_malformed >= losses - losses_malformed END AS quality_wins_ge_losses FROM ts""", _ALL)
def shd_triage_summary(src):
    return A.triage_summary(triage(src))


@query("shd_unadjudicated", TRIAGE + " SELECT task, reason, count(*) AS n FROM tv WHERE verdict = 'not_adjudicated' GROUP BY ALL", _ALL)
def shd_unadjudicated(src):
    return A.unadjudicated_reasons(triage(src))


@query("shd_report", AGREE + f""", lat AS (SELECT task, quantile_cont(total_ms, 0.95) FILTER (WHERE arm = 'baseline') AS b, quantile_cont(total_ms, 0.95) FILTER (WHERE arm = 'candidate') AS c FROM calls
   WHERE total_ms IS NOT NULL GROUP BY ALL) SELECT s.task, n_compared, agreement, structured_agreement, round(b, 6) AS baseline_p95, round(c, 6) AS candidate_p95 FROM ({_SUMMARY}) s JOIN lat USING (task)""", _VIEWS)
def shd_report(src):
    """The whole shadow pass of one arm pair: agreement beside latency per task."""
    calls = shadow_calls(src)
    agreed = A.agreement_summary(A.compare_items(calls, "baseline", "candidate"))
    p95 = R.percentiles_of_counts(R.value_counts(calls, ("task", "arm"), "total_ms"), ("task", "arm"), "total_ms", {"p95": 0.95})
    wide = p95.groupBy("task").pivot("arm", ["baseline", "candidate"]).agg(F.first("p95"))
    return agreed.join(wide, "task").select("task", "n_compared", *[F.round(c, 9).alias(c) for c in ("agreement", "structured_agreement")],
                                            F.round("baseline", 6).alias("baseline_p95"), F.round("candidate", 6).alias("candidate_p95"))


@query("shd_figures", AGREE + f""" SELECT task, CASE WHEN task = 'query_rewriter' THEN 'structured' ELSE 'item' END AS metric, CASE WHEN task = 'query_rewriter' THEN structured_agreement ELSE agreement END AS figure FROM ({_SUMMARY})""", _VIEWS)
def shd_figures(src):
    s = A.agreement_summary(A.compare_items(shadow_calls(src), "baseline", "candidate"))
    structured = F.col("task") == "query_rewriter"
    return s.select("task", F.when(structured, "structured").otherwise("item").alias("metric"),
                    F.round(F.when(structured, F.col("structured_agreement")).otherwise(F.col("agreement")), 9).alias("figure")).filter("figure is not null")


@query("shd_judged_splits", " SELECT task, arm, CASE WHEN bool_or(NOT core) THEN 'all' ELSE 'core' END AS split FROM calls WHERE arm = 'candidate' OR core GROUP BY ALL", ("calls",))
def shd_judged_splits(src):
    return A.judged_split(src.view("calls").filter("arm = 'candidate' or core"), ("task", "arm"))


@query("shd_carry_figures", """, m AS (SELECT task, model AS config, round(avg(CAST(status = 'ok' AS INTEGER)), 9) AS figure FROM calls WHERE arm = 'candidate' GROUP BY ALL),
 g AS (SELECT DISTINCT task, unnest(['candidate-flash', 'candidate-pro', 'candidate-capped']) AS config FROM calls)
 SELECT g.task, g.config, coalesce(m.figure, b.figure) AS figure, m.figure IS NULL AND b.figure IS NOT NULL AS carried FROM g LEFT JOIN m USING (task, config) LEFT JOIN m b ON b.task = g.task AND b.config = 'candidate-flash'""", ("calls",))
def shd_carry_figures(src):
    measured = src.view("calls").filter("arm = 'candidate'").groupBy("task", F.col("model").alias("config")).agg(
        F.round(F.avg((F.col("status") == "ok").cast("double")), 9).alias("figure"))
    grid = src.view("calls").select("task").distinct().withColumn("config", F.explode(F.array(*[F.lit(c) for c in ("candidate-flash", "candidate-pro", "candidate-capped")])))
    return A.carry_figures(grid, measured, "candidate-flash")


# --- cross-check ------------------------------------------------------------------------

XP = CELL_SCORES + """, crit AS (SELECT call_id, judge, repeat, string_agg(criterion_id, ',' ORDER BY criterion_id) AS ids FROM verdicts GROUP BY ALL),
 jc AS (SELECT cs.*, crit.ids FROM cs LEFT JOIN crit USING (call_id, judge, repeat)),
 xp AS (SELECT coalesce(a.task, b.task) AS task, coalesce(a.arm, b.arm) AS arm, coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.repeat, b.repeat) AS repeat, coalesce(a.call_id, b.call_id) AS call_id,
   CASE WHEN a.status IS NULL OR b.status IS NULL THEN 'scored once only' WHEN a.status <> 'ok' THEN concat('no verdict of the gated judge: ', a.error) WHEN b.status <> 'ok' THEN concat('no verdict of the checking judge: ', b.error)
     WHEN a.ids <> b.ids THEN 'criteria differ between the judges' END AS unusable, a.score AS ga, b.score AS ch
   FROM (SELECT * FROM jc WHERE judge = 'gated') a FULL JOIN (SELECT * FROM jc WHERE judge = 'check') b ON a.call_id = b.call_id AND a.repeat = b.repeat),
 xc AS (SELECT x.task, x.arm, x.item_id, x.repeat, a.criterion_id, a.passed AS gated, b.passed AS "check" FROM xp x JOIN verdicts a ON a.call_id = x.call_id AND a.repeat = x.repeat AND a.judge = 'gated'
   JOIN verdicts b ON b.call_id = x.call_id AND b.repeat = x.repeat AND b.judge = 'check' AND a.criterion_id = b.criterion_id WHERE unusable IS NULL)"""
_CV = ("cells", "verdicts")


@query("xck_pair_cells", XP + " SELECT task, arm, item_id, repeat, unusable, CASE WHEN unusable IS NULL THEN ga END AS gated_score, CASE WHEN unusable IS NULL THEN ch END AS check_score FROM xp", _CV)
def xck_pair_cells(src):
    return X.pair_cells(scored_cells(src), "gated", "check").drop("criteria")


@query("xck_criterion_pairs", XP + ' SELECT task, arm, item_id, repeat, criterion_id, gated, "check" FROM xc', _CV)
def xck_criterion_pairs(src):
    return X.criterion_pairs(X.pair_cells(scored_cells(src), "gated", "check")).drop("gated_rationale", "check_rationale")


XR = XP + """, k AS (SELECT task, arm, count(*) AS n, avg(CAST(gated = "check" AS INTEGER)) AS ag, avg(CAST(gated AS INTEGER)) AS ra, avg(CAST("check" AS INTEGER)) AS rb FROM xc GROUP BY GROUPING SETS ((task, arm), (task))),
 c AS (SELECT task, arm, count(DISTINCT item_id) FILTER (WHERE unusable IS NULL) AS items, count(*) FILTER (WHERE unusable IS NULL) AS paired_cells, count(unusable) AS unusable,
   avg(CAST(ga = ch AS INTEGER)) FILTER (WHERE unusable IS NULL) AS isa, avg(abs(ga - ch)) FILTER (WHERE unusable IS NULL) AS gap, avg(ga) FILTER (WHERE unusable IS NULL) AS gm, avg(ch) FILTER (WHERE unusable IS NULL) AS cm FROM xp GROUP BY GROUPING SETS ((task, arm), (task))),
 rep AS (SELECT c.*, k.n, k.ag, k.ra, k.rb, ra * rb + (1 - ra) * (1 - rb) AS ex FROM c LEFT JOIN k ON k.task = c.task AND k.arm IS NOT DISTINCT FROM c.arm)"""


@query("xck_report", XR + """ SELECT task, arm, items, paired_cells, n, round(ag, 9) AS agreement, round(ra, 9) AS rate_a, round(rb, 9) AS rate_b, round(isa, 9) AS item_score_agreement, round(gap, 9) AS mean_abs_gap,
  round(gm, 9) AS gated_mean, round(cm, 9) AS check_mean, unusable, round(CASE WHEN ex < 1 - 1e-12 THEN (ag - ex) / (1 - ex) END, 9) AS kappa, CASE WHEN ex >= 1 - 1e-12 THEN 'undefined: one label only' WHEN ex >= 0.8 THEN 'deflated by prevalence' END AS kappa_note,
  CASE WHEN ag IS NULL THEN 'INSUFFICIENT' WHEN ag >= 0.85 THEN 'VALIDATED' ELSE 'UNRELIABLE' END AS verdict FROM rep""", _CV)
def xck_report(src):
    out = X.agreement_report(X.pair_cells(scored_cells(src), "gated", "check"))
    return out.withColumns({c: F.round(c, 9) for c in ("agreement", "rate_a", "rate_b", "item_score_agreement", "mean_abs_gap", "gated_mean", "check_mean", "kappa")})


@query("xck_unusable", XP + " SELECT task, arm, split_part(unusable, ':', 1) AS reason, count(*) AS n FROM xp WHERE unusable IS NOT NULL GROUP BY ALL", _CV)
def xck_unusable(src):
    return X.unusable_census(X.pair_cells(scored_cells(src), "gated", "check"))


@query("xck_largest", XP + """, r AS (SELECT *, abs(ga - ch) AS gap, row_number() OVER (PARTITION BY task ORDER BY abs(ga - ch) DESC, arm, item_id, repeat) AS rank FROM xp WHERE unusable IS NULL AND ga <> ch)
 SELECT CAST(rank AS INTEGER) AS rank, task, arm, item_id, repeat, ga AS gated_score, ch AS check_score, gap, (SELECT string_agg(criterion_id, ',' ORDER BY criterion_id) FROM xc WHERE xc.item_id = r.item_id AND xc.arm = r.arm AND xc.repeat = r.repeat AND gated <> "check") AS criteria FROM r WHERE rank <= 10""", _CV)
def xck_largest(src):
    return X.largest_disagreements(X.pair_cells(scored_cells(src), "gated", "check"))


@query("xck_verdict", XR + " SELECT task, CASE WHEN ag IS NULL THEN 'INSUFFICIENT' WHEN ag >= 0.85 THEN 'VALIDATED' ELSE 'UNRELIABLE' END AS verdict, unusable FROM rep WHERE arm IS NULL", _CV)
def xck_verdict(src):
    return X.agreement_report(X.pair_cells(scored_cells(src), "gated", "check")).filter("arm is null").select("task", "verdict", "unusable")


@query("xck_managed_figures", CELL_SCORES + """ SELECT cs.task, cs.arm, count(*) AS cases_total, count(score) AS cases_valid, count(*) FILTER (WHERE status <> 'ok') AS cases_error,
  CAST(coalesce(sum(round(n_c * (1 - score))), 0) AS BIGINT) AS failing_verdicts, round(avg(score), 9) AS mean_score, round(stddev_samp(score), 9) AS sd_score, round(avg(CAST(score = 1 AS INTEGER)), 9) AS pass_rate FROM cs WHERE judge = 'check' GROUP BY ALL""", _CV)
def xck_managed_figures(src):
    out = X.managed_figures(scored_cells(src, "check"))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_score", "sd_score", "pass_rate")})


@query("xck_side_by_side", CELL_SCORES + """ SELECT task, arm, 'judge_score' AS metric, CASE judge WHEN 'gated' THEN 'internal' ELSE 'managed' END AS source, count(score) AS n, round(avg(score), 9) AS point FROM cs GROUP BY ALL""", _CV)
def xck_side_by_side(src):
    def figures(judge):
        return scored_cells(src, judge).groupBy("task", "arm").agg(F.count("score").alias("n"), F.round(F.avg("score"), 9).alias("point")).withColumn("metric", F.lit("judge_score"))

    return X.side_by_side(figures("gated"), figures("check"))


@query("xck_clusters", """, cl AS (SELECT task, arm, criterion_id, count(DISTINCT item_id) AS n_items FROM verdicts WHERE judge = 'check' AND NOT passed AND task <> 'query_rewriter' GROUP BY ALL)
 SELECT a.task, a.arm, criterion_id, n_items, CASE WHEN criterion_id IS NULL THEN 'no clusters returned' ELSE 'clustered' END AS status FROM (SELECT DISTINCT task, arm FROM calls) a LEFT JOIN cl USING (task, arm)""", ("calls", "verdicts"))
def xck_clusters(src):
    arms = src.view("calls").select("task", "arm").distinct()
    clusters = J.failure_clusters(scored_cells(src, "check").filter("task <> 'query_rewriter'"))
    return X.cluster_rows(arms, clusters)


@query("xck_run", XP + """, samp AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY md5(concat('7|', item_id)), item_id) AS r FROM (SELECT DISTINCT item_id FROM cells WHERE task = 'feature_extractor')) WHERE r <= 100)
 SELECT task, CASE WHEN task = 'feature_extractor' THEN 'sampled' ELSE 'full' END AS scope, count(*) AS n, round(avg(CAST(gated = "check" AS INTEGER)), 9) AS agreement FROM xc WHERE task <> 'feature_extractor' OR item_id IN (SELECT item_id FROM samp) GROUP BY ALL""", _CV)
def xck_run(src):
    """Cross-check with one task sampled and the others in full."""
    cells = scored_cells(src)
    pool = cells.filter("task = 'feature_extractor'").select("item_id", "task").distinct()
    quotas = pool.select("task").distinct().withColumn("_quota", F.lit(100))
    picked = R.lowest_by_hash(pool, ("task",), quotas, F.md5(F.concat(F.lit("7|"), F.col("item_id").cast("string"))))
    full = cells.filter("task <> 'feature_extractor'")
    scoped = full.unionByName(cells.join(picked, ["task", "item_id"], "left_semi").select(*full.columns))
    pairs = X.criterion_pairs(X.pair_cells(scoped, "gated", "check"))
    scope = F.when(F.col("task") == "feature_extractor", "sampled").otherwise("full").alias("scope")
    return pairs.groupBy("task", scope).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gated") == F.col("check")).cast("double")), 9).alias("agreement"))
