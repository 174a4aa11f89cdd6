"""Judge verdicts."""

from pyspark.sql import functions as F

from armparity.functions import payload as P
from armparity.operators import judge as J
from armparity.operators import metrics as M
from armparity.plans.registry import query


def criteria_of(judge, call_id, repeat, k, n):
    """Nested criteria of a cell, by the same rule as the ``verdicts`` view."""

    def one(c):
        base = (7 * call_id + 13 * repeat + 29 * c + k) % 10 < 8
        flipped = (judge == "check") & ((call_id + repeat + 3 * c + k) % 12 == 0)
        return F.struct(F.concat(F.lit("c"), c.cast("string")).alias("criterion_id"), (base != flipped).alias("passed"),
                        F.concat(F.lit("why "), c.cast("string"), F.lit(" of "), k.cast("string")).alias("rationale"))

    return F.transform(F.sequence(F.lit(1), n), one)


def scored_cells(src, judge=None):
    """Judge cells with nested criteria and a score, null where the call failed."""
    cells = src.view("cells")
    if judge:
        cells = cells.filter(F.col("judge") == judge)
    ok = F.col("status") == "ok"
    crit = criteria_of(*(F.col(c) for c in ("judge", "call_id", "repeat", "k", "n_criteria")))
    return cells.withColumn("criteria", F.when(ok, crit)).withColumn("score", J.cell_score(F.col("criteria")))


CELL_SCORES = """, cs AS (SELECT c.call_id, c.item_id, c.task, c.arm, c.core, c.judge, c.repeat, c.status, c.error, v.score, v.n_c FROM cells c LEFT JOIN
  (SELECT call_id, judge, repeat, avg(CAST(passed AS INTEGER)) AS score, count(*) AS n_c FROM verdicts GROUP BY ALL) v USING (call_id, judge, repeat))"""
FOLDED = CELL_SCORES + """, folded AS (SELECT task, arm, item_id, avg(score) AS item_mean, count(score) AS n_good, count(*) AS n_repeats,
  CASE WHEN count(score) >= 2 THEN stddev_samp(score) END AS sd, CASE WHEN count(score) >= 2 THEN max(score) - min(score) END AS spread
  FROM cs WHERE judge = 'gated' GROUP BY ALL)"""
_CV = ("cells", "verdicts")


@query("jdg_rubric", """ SELECT item_id, array_to_string(list_concat(list_transform(range(1, n_rubric + 1), lambda i: concat('r', i)),
  CASE WHEN task = 'feature_extractor' AND json_type(gold_json, '$.technical_field') = 'VARCHAR' THEN ['technical_field_correct'] ELSE [] END,
  CASE WHEN task = 'feature_extractor' AND json_type(gold_json, '$.novelty_statement') = 'VARCHAR' THEN ['novelty_statement_correct'] ELSE [] END), ',') AS ids FROM items""", ("items",))
def jdg_rubric(src):
    own = F.transform(F.sequence(F.lit(1), F.col("n_rubric").cast("int")), lambda i: F.concat(F.lit("r"), i.cast("string")))
    items = src.view("items").withColumn("g", F.from_json("gold_json", P.ANSWER))
    return items.select("item_id", F.array_join(J.rubric_ids(own, F.col("task"), F.col("g"), M.JUDGED_FIELDS), ",").alias("ids"))


def _parsed(src):
    rubric = F.array(*[F.lit(f"c{i}") for i in range(1, 5)])
    return J.parse_verdicts(src.view("judge_raw"), rubric)


PARSED = """, b AS (SELECT *, TRY_CAST(coalesce(payload_json, tool_args, output_text) AS JSON) AS j FROM judge_raw),
 c AS (SELECT *, CASE WHEN json_type(j, '$.criteria') = 'ARRAY' THEN json_extract(j, '$.criteria[*]') END AS cr FROM b),
 d AS (SELECT *, list_sort(list_transform(cr, lambda x: x->>'$.criterion_id')) AS ids FROM c),
 e AS (SELECT *, CASE WHEN status = 'error' THEN concat('judge call failed: ', error) WHEN json_type(j) IS DISTINCT FROM 'OBJECT' THEN 'no JSON object'
   WHEN coalesce(len(cr), 0) = 0 THEN 'no criteria array' WHEN ids <> ['c1', 'c2', 'c3', 'c4'] THEN 'criteria differ from the rubric'
   WHEN len(list_filter(cr, lambda x: trim(x->>'$.rationale') = '')) > 0 THEN 'blank rationale' END AS reject FROM d)"""


@query("jdg_parse", PARSED + """ SELECT call_id, repeat, CASE WHEN reject IS NULL THEN 'ok' ELSE 'error' END AS status, reject,
  CASE WHEN reject IS NULL THEN len(list_filter(cr, lambda x: x->>'$.passed' = 'true')) / len(cr) END AS score FROM e""", ("judge_raw",))
def jdg_parse(src):
    return _parsed(src).select("call_id", "repeat", "status", "reject", "score")


@query("jdg_repeat_scores", CELL_SCORES + """ SELECT task, arm, item_id, string_agg(coalesce(CAST(score AS VARCHAR), 'failed'), ',' ORDER BY repeat) AS scores
  FROM cs WHERE judge = 'gated' GROUP BY ALL""", _CV)
def jdg_repeat_scores(src):
    lists = J.repeat_scores(scored_cells(src, "gated"))
    return lists.select("task", "arm", "item_id", F.array_join("scores", ",", "failed").alias("scores"))


@query("jdg_item_means", FOLDED + " SELECT task, arm, item_id, round(item_mean, 9) AS item_mean, n_good, n_repeats, round(sd, 9) AS sd, round(spread, 9) AS spread FROM folded", _CV)
def jdg_item_means(src):
    return J.fold_repeats(scored_cells(src, "gated")).withColumns({c: F.round(c, 9) for c in ("item_mean", "sd", "spread")})


@query("jdg_aggregate_repeats", FOLDED + """ SELECT task, arm, count(item_mean) AS n_items, round(avg(item_mean), 9) AS mean_score, CAST(sum(n_repeats - n_good) AS BIGINT) AS failed_repeats,
  count(*) FILTER (WHERE item_mean IS NULL) AS dropped_items, count(*) FILTER (WHERE n_good > 0 AND n_good < 2) AS short_items, round(avg(sd), 9) AS mean_within_sd,
  round(max(spread), 9) AS max_range, round(avg(CAST(spread = 0 AS INTEGER)), 9) AS full_agreement_rate FROM folded GROUP BY ALL""", _CV)
def jdg_aggregate_repeats(src):
    out = J.aggregate_repeats(J.fold_repeats(scored_cells(src, "gated")), 2)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_score", "mean_within_sd", "max_range", "full_agreement_rate")})


@query("jdg_failed_criteria", " SELECT DISTINCT task, arm, criterion_id, item_id FROM verdicts WHERE judge = 'gated' AND NOT passed", ("verdicts",))
def jdg_failed_criteria(src):
    return J.failed_criteria(scored_cells(src, "gated"))


@query("jdg_failure_clusters", " SELECT task, arm, criterion_id, count(DISTINCT item_id) AS n_items FROM verdicts WHERE judge = 'gated' AND NOT passed GROUP BY ALL", ("verdicts",))
def jdg_failure_clusters(src):
    return J.failure_clusters(scored_cells(src, "gated"))


@query("jdg_candidate_text", " SELECT call_id, coalesce(payload_json, CASE WHEN trim(output_text) <> '' THEN output_text END) AS shown FROM calls", ("calls",))
def jdg_candidate_text(src):
    return src.view("calls").select("call_id", J.candidate_text(F.col("payload_json"), F.col("output_text")).alias("shown"))


@query("jdg_requests", " SELECT call_id, item_id, arm, CAST(unnest([1, 2]) AS INTEGER) AS repeat FROM calls WHERE status = 'ok'", ("calls",))
def jdg_requests(src):
    return J.scoring_requests(src.view("calls").filter("status = 'ok'").select("call_id", "item_id", "arm"), 2)
