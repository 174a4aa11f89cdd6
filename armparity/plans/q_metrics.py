"""Per-row metrics and their aggregates."""

from pyspark.sql import functions as F

from armparity.functions import payload as P
from armparity.operators import judge as J
from armparity.operators import metrics as M
from armparity.plans.q_judge import FOLDED, scored_cells
from armparity.plans.registry import query

_VIEWS = ("calls", "items")


def _pairs(src):
    return M.scored_pairs(src.view("calls"), src.view("items"))


def _texts(path):
    return (f"(json_type(j, '{path}') IS NULL OR (json_type(j, '{path}') = 'ARRAY' AND "
            f"len(list_filter(json_extract(j, '{path}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0))")


def _optional(path):
    return f"coalesce(json_type(j, '{path}'), 'NULL') IN ('VARCHAR', 'NULL')"


def _known(keys, path="$"):
    names = ", ".join(f"'{k}'" for k in keys)
    return f"len(list_filter(json_keys(j, '{path}'), lambda x: x NOT IN ({names}))) = 0"


SCORED = f""", scored AS (SELECT c.*, i.gold_json, i.n_chunks, CAST(i.gold_json AS JSON) AS g,
    CASE WHEN json_type(TRY_CAST(c.payload_json AS JSON)) = 'OBJECT' THEN TRY_CAST(c.payload_json AS JSON) END AS j
  FROM calls c JOIN items i USING (item_id)),
 tagged AS (SELECT *, CASE WHEN status = 'error' THEN 'call_error' WHEN j IS NULL THEN 'no_json' WHEN coalesce(CASE task
   WHEN 'query_rewriter' THEN json_type(j, '$.query') = 'VARCHAR' AND json_type(j, '$.intent') = 'VARCHAR'
     AND j->>'$.intent' IN ('prior_art', 'ownership', 'landscape', 'freedom_to_operate', 'citation_lookup')
     AND {_known(['query', 'filters', 'intent'])} AND (json_type(j, '$.filters') IS NULL OR (json_type(j, '$.filters') = 'OBJECT'
       AND {_known(['date_from', 'date_to', 'assignees', 'jurisdictions', 'cpc_codes'], '$.filters')}
       AND {_optional('$.filters.date_from')} AND {_optional('$.filters.date_to')} AND {_texts('$.filters.assignees')}
       AND {_texts('$.filters.jurisdictions')} AND {_texts('$.filters.cpc_codes')}))
   WHEN 'chunk_summarizer' THEN json_type(j, '$.summary') = 'VARCHAR' AND json_type(j, '$.key_points') = 'ARRAY' AND {_known(['summary', 'key_points'])}
     AND len(list_filter(json_extract(j, '$.key_points[*]'), lambda x: NOT coalesce(json_type(x, '$.text') = 'VARCHAR' AND json_type(x, '$.chunk_ids') = 'ARRAY' AND len(json_keys(x)) = 2, false))) = 0
   ELSE {_known(M.ALL_EXTRACT_FIELDS)} AND {' AND '.join(_optional('$.' + f) for f in ('title', 'assignee', 'filing_date', 'jurisdiction', 'technical_field', 'novelty_statement'))}
     AND {_texts('$.cpc_codes')} AND (coalesce(json_type(j, '$.independent_claim_count'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT')
       OR (json_type(j, '$.independent_claim_count') = 'VARCHAR' AND regexp_full_match(j->>'$.independent_claim_count', '[+-]?[0-9]+')))
   END, false) THEN 'valid' ELSE 'invalid' END AS tag FROM scored)"""


@query("met_payload", SCORED + """ SELECT call_id, j IS NOT NULL AS has_object, CAST(len(json_keys(j)) AS INTEGER) AS n_keys FROM scored""", _VIEWS)
def met_payload(src):
    shape = P.shape(F.col("payload_json"))
    return src.view("calls").select("call_id", "payload_json", shape.alias("shape")).select(
        "call_id", F.coalesce(F.col("shape").startswith("OBJECT<"), F.lit(False)).alias("has_object"),
        F.size(F.when(F.col("shape").startswith("OBJECT<"), P.keys_of(F.col("payload_json")))).alias("n"),
    ).select("call_id", "has_object", F.when(F.col("n") >= 0, F.col("n")).alias("n_keys"))


@query("met_schema_validity", SCORED + " SELECT call_id, task, tag, CASE WHEN tag = 'valid' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM tagged", _VIEWS)
def met_schema_validity(src):
    tag = M.validity_tag(F.col("status"), F.col("task"), F.col("p"), F.col("shape"))
    return _pairs(src).select("call_id", "task", tag.alias("tag")).withColumn("value", (F.col("tag") == "valid").cast("double"))


_N = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
_C = "upper(regexp_replace({0}, '\\s+', '', 'g'))"


def _assertions(side):
    parts = []
    for f in M.FILTER_SCALARS:
        parts.append(f"CASE WHEN {side}->>'$.filters.{f}' <> '' THEN ['{f}=' || {_N.format(side + '''->>'$.filters.''' + f + chr(39))}] ELSE [] END")
    for f in M.FILTER_LISTS:
        norm = (_C if f in M.CODE_FIELDS else _N).format("x")
        parts.append(f"list_transform(list_filter(coalesce(CAST(json_extract({side}, '$.filters.{f}') AS VARCHAR[]), []), lambda x: x <> ''), lambda x: '{f}=' || {norm})")
    return f"list_sort(list_distinct(list_concat({', '.join(parts)})))"


PRF = SCORED + f""", sets AS (SELECT call_id, task, arm, {_assertions('g')} AS gs, {_assertions('j')} AS ps FROM scored WHERE task = 'query_rewriter'),
 prf AS (SELECT *, len(list_filter(gs, lambda x: list_contains(ps, x))) AS tp, len(list_filter(ps, lambda x: NOT list_contains(gs, x))) AS fp,
   len(list_filter(gs, lambda x: NOT list_contains(ps, x))) AS fn FROM sets),
 prf2 AS (SELECT *, CASE WHEN len(ps) > 0 THEN tp / len(ps) END AS p, CASE WHEN len(gs) > 0 THEN tp / len(gs) END AS r FROM prf)"""


@query("met_filter_assertions", PRF + " SELECT call_id, 'gold' AS side, array_to_string(gs, '|') AS assertions FROM prf UNION ALL SELECT call_id, 'predicted', array_to_string(ps, '|') FROM prf", _VIEWS)
def met_filter_assertions(src):
    rows = _pairs(src).filter("task = 'query_rewriter'")
    sides = F.array(
        F.struct(F.lit("gold").alias("side"), M.filter_assertions(F.col("g.filters")).alias("a")),
        F.struct(F.lit("predicted").alias("side"), M.filter_assertions(F.col("p.filters")).alias("a")))
    return rows.select("call_id", F.inline(sides)).select("call_id", "side", F.array_join("a", "|").alias("assertions"))


@query("met_filter_prf", PRF + """ SELECT call_id, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, round(p, 9) AS precision, round(r, 9) AS recall,
  round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM prf2""", _VIEWS)
def met_filter_prf(src):
    sets = F.struct(M.filter_assertions(F.col("g.filters")).alias("gold"), M.filter_assertions(F.col("p.filters")).alias("predicted"))
    rows = _pairs(src).filter("task = 'query_rewriter'").select("call_id", sets.alias("s")).select("call_id", M.filter_counts(F.col("s")).alias("c"))
    precision, recall, f1 = (F.round(o["value"], 9) for o in M.filter_prf(F.col("c")))
    return rows.select("call_id", "c.tp", "c.fp", "c.fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


@query("met_exact_key", SCORED + f""" SELECT call_id, CASE WHEN NOT list_contains(json_keys(g), 'intent') THEN NULL WHEN j IS NULL THEN 0.0::DOUBLE
  WHEN {_N.format("g->>'$.intent'")} IS NOT DISTINCT FROM {_N.format("j->>'$.intent'")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
  FROM scored WHERE task = 'query_rewriter'""", _VIEWS)
def met_exact_key(src):
    o = M.exact_key(F.col("g"), F.col("gold_keys"), F.col("p"), "intent")
    return _pairs(src).filter("task = 'query_rewriter'").select("call_id", o["value"].alias("value"))


POINTS = SCORED + """, pts AS (SELECT call_id, unnest(json_extract(j, '$.key_points[*]')) AS pt, n_chunks FROM scored WHERE task = 'chunk_summarizer' AND json_type(j, '$.key_points') = 'ARRAY'),
 cls AS (SELECT call_id, CASE WHEN coalesce(json_array_length(pt, '$.chunk_ids'), 0) = 0 THEN 'uncited'
   WHEN len(list_filter(CAST(pt->'$.chunk_ids' AS VARCHAR[]), lambda c: NOT list_contains(list_transform(range(1, n_chunks + 1), lambda n: concat('c', n)), c))) > 0 THEN 'fabricated'
   ELSE 'grounded' END AS c FROM pts),
 cit AS (SELECT s.call_id, s.arm, s.j, json_type(s.j, '$.key_points') AS t, count(cls.c) AS n, count(*) FILTER (WHERE cls.c = 'grounded') AS grounded,
   count(*) FILTER (WHERE cls.c = 'uncited') AS uncited, count(*) FILTER (WHERE cls.c = 'fabricated') AS fabricated
   FROM scored s LEFT JOIN cls USING (call_id) WHERE s.task = 'chunk_summarizer' GROUP BY ALL)"""


@query("met_citation_coverage", POINTS + """ SELECT call_id, CASE WHEN j IS NULL THEN 0.0 ELSE round(grounded / nullif(n, 0), 9) END AS coverage,
  round(uncited / nullif(n, 0), 9) AS uncited_rate, round(fabricated / nullif(n, 0), 9) AS fabricated_rate,
  CASE WHEN j IS NULL THEN 'no answer to read' WHEN t IS DISTINCT FROM 'ARRAY' THEN 'points are no list' ELSE 'list of points is empty' END AS note FROM cit""", _VIEWS)
def met_citation_coverage(src):
    rows = _pairs(src).filter("task = 'chunk_summarizer'").withColumn(
        "c", M.point_classes(F.col("p.key_points"), M.supplied_chunks(F.col("n_chunks"))))
    rows = rows.select("call_id", M.citation_outcomes(F.col("p"), F.col("c")).alias("o"))
    values = [F.round(F.col("o")[i]["value"], 9).alias(n) for i, n in enumerate(("coverage", "uncited_rate", "fabricated_rate"))]
    return rows.select("call_id", *values, F.col("o")[0]["note"].alias("note"))


def _cmp(side, f):
    if f in M.EXTRACT_LISTS:
        arr = f"CAST(json_extract({side}, '$.{f}') AS VARCHAR[])"
        return f"CASE WHEN len({arr}) > 0 THEN array_to_string(list_sort(list_distinct(list_transform({arr}, lambda x: {_C.format('x')}))), '|') END"
    body = (_C if f in M.CODE_FIELDS else _N).format(f"{side}->>'$.{f}'")
    if f == "independent_claim_count":
        return f"CASE WHEN json_type({side}, '$.{f}') = 'VARCHAR' THEN 'text ' || ({body}) ELSE {body} END"
    return body


def _fields_sql(fields):
    rows = " UNION ALL ".join(
        f"SELECT call_id, arm, '{f}' AS field, list_contains(json_keys(g), '{f}') AS has, {_cmp('g', f)} AS want, {_cmp('j', f)} AS got FROM scored WHERE task = 'feature_extractor'" for f in fields)
    return SCORED + f""", sides AS ({rows}),
 fv AS (SELECT call_id, arm, field, CASE WHEN NOT has THEN 'unscoreable' WHEN want IS NULL AND got IS NULL THEN 'correct_abstention' WHEN want IS NULL THEN 'hallucination'
   WHEN got IS NULL THEN 'omission' WHEN want = got THEN 'correct' ELSE 'wrong' END AS verdict FROM sides),
 fn AS (SELECT call_id, arm, {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in M.FIELD_VERDICTS)} FROM fv GROUP BY ALL),
 fr AS (SELECT call_id, arm, (correct + correct_abstention) / nullif(6 - unscoreable, 0) AS extraction_accuracy,
   correct / nullif(correct + wrong + hallucination, 0) AS answered_precision, (correct + wrong) / nullif(correct + wrong + hallucination, 0) AS supported_claim_rate,
   hallucination / nullif(correct_abstention + hallucination, 0) AS hallucination_rate, omission / nullif(correct + wrong + omission, 0) AS omission_rate FROM fn)"""


@query("met_abstention", SCORED + """ SELECT call_id, coalesce(json_type(j, '$.assignee'), 'NULL') = 'NULL' AS assignee_abstains,
  coalesce(json_array_length(j, '$.cpc_codes'), 0) = 0 AS codes_abstain FROM scored WHERE task = 'feature_extractor'""", _VIEWS)
def met_abstention(src):
    return _pairs(src).filter("task = 'feature_extractor'").select(
        "call_id", F.col("p.assignee").isNull().alias("assignee_abstains"),
        (F.coalesce(F.size("p.cpc_codes"), F.lit(0)) <= 0).alias("codes_abstain"))


@query("met_field_verdicts", _fields_sql(M.EXTRACT_FIELDS) + " SELECT call_id, field, verdict FROM fv", _VIEWS)
def met_field_verdicts(src):
    v = M.field_verdicts(F.col("g"), F.col("gold_keys"), F.col("p"), F.col("shape"))
    return _pairs(src).filter("task = 'feature_extractor'").select("call_id", F.inline(v))


@query("met_extraction", _fields_sql(M.EXTRACT_FIELDS) + " SELECT call_id, " + ", ".join(f"round({m}, 9) AS {m}" for m in (
    "extraction_accuracy", "answered_precision", "supported_claim_rate", "hallucination_rate", "omission_rate")) + " FROM fr", _VIEWS)
def met_extraction(src):
    rows = _pairs(src).filter("task = 'feature_extractor'").withColumn(
        "f", M.field_verdicts(F.col("g"), F.col("gold_keys"), F.col("p"), F.col("shape"))).withColumn("n", M.verdict_counts(F.col("f")))
    names = ("extraction_accuracy", "answered_precision", "supported_claim_rate", "hallucination_rate", "omission_rate")
    return rows.select("call_id", *[F.round(o["value"], 9).alias(n) for n, o in zip(names, M.extraction_outcomes(F.col("n")))])


LONG = _fields_sql(M.EXTRACT_FIELDS) + PRF[len(SCORED):] + POINTS[len(SCORED):] + f""", long AS (
  SELECT call_id, 'json_schema_validity' AS metric, CASE WHEN tag = 'valid' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, tag AS detail, false AS broken FROM tagged
  UNION ALL SELECT call_id, 'filter_precision', p, CASE WHEN p IS NULL THEN 'answer has no filter' END, false FROM prf2
  UNION ALL SELECT call_id, 'filter_recall', r, CASE WHEN r IS NULL THEN 'gold has no filter' END, false FROM prf2
  UNION ALL SELECT call_id, 'filter_f1', CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, CASE WHEN p + r IS NULL THEN 'one of the two shares is undefined' END, false FROM prf2
  UNION ALL SELECT call_id, 'exact_match_intent', CASE WHEN NOT list_contains(json_keys(g), 'intent') THEN NULL WHEN j IS NULL THEN 0 WHEN {_N.format("g->>'$.intent'")} IS NOT DISTINCT FROM {_N.format("j->>'$.intent'")} THEN 1 ELSE 0 END,
    CASE WHEN NOT list_contains(json_keys(g), 'intent') THEN 'gold does not carry intent' END, false FROM scored WHERE task = 'query_rewriter'
  UNION ALL SELECT call_id, m, CASE WHEN j IS NULL AND m = 'citation_coverage' THEN 0 WHEN j IS NOT NULL THEN (CASE m WHEN 'citation_coverage' THEN grounded WHEN 'uncited_claim_rate' THEN uncited ELSE fabricated END) / nullif(n, 0) END,
    CASE WHEN j IS NULL AND m = 'citation_coverage' THEN NULL WHEN j IS NULL THEN 'no answer to read' WHEN t IS DISTINCT FROM 'ARRAY' THEN 'points are no list' WHEN n = 0 THEN 'list of points is empty' END, j IS NOT NULL AND t IS DISTINCT FROM 'ARRAY'
    FROM cit, (VALUES ('citation_coverage'), ('uncited_claim_rate'), ('fabricated_citation_rate')) v(m)
  UNION ALL SELECT call_id, 'extraction_accuracy', extraction_accuracy, CASE WHEN extraction_accuracy IS NULL THEN 'nothing to score in gold' END, false FROM fr
  UNION ALL SELECT call_id, 'answered_precision', answered_precision, CASE WHEN answered_precision IS NULL THEN 'answer leaves every field open' END, false FROM fr
  UNION ALL SELECT call_id, 'supported_claim_rate', supported_claim_rate, CASE WHEN supported_claim_rate IS NULL THEN 'answer leaves every field open' END, false FROM fr
  UNION ALL SELECT call_id, 'hallucination_rate', hallucination_rate, CASE WHEN hallucination_rate IS NULL THEN 'gold leaves no field open' END, false FROM fr
  UNION ALL SELECT call_id, 'omission_rate', omission_rate, CASE WHEN omission_rate IS NULL THEN 'gold leaves every field open' END, false FROM fr),
 outcomes AS (SELECT l.*, c.task, c.arm, c.item_id, c.core, c.status AS call_status, CASE WHEN value IS NOT NULL THEN 'ok' WHEN broken THEN 'error' ELSE 'not_applicable' END AS status FROM long l JOIN calls c USING (call_id))"""


@query("met_outcomes", LONG + " SELECT call_id, metric, status, round(value, 9) AS value, detail FROM outcomes", _VIEWS)
def met_outcomes(src):
    return M.outcomes(_pairs(src)).select("call_id", "metric", "status", F.round("value", 9).alias("value"), "detail")


@query("met_arm_metrics", LONG + """ SELECT task, arm, metric, count(value) AS n, round(avg(value), 9) AS mean, count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable,
  count(*) FILTER (WHERE status = 'error') AS n_error, count(value) FILTER (WHERE call_status = 'error') AS call_errors FROM outcomes GROUP BY ALL""", _VIEWS)
def met_arm_metrics(src):
    return M.arm_metrics(M.outcomes(_pairs(src))).withColumn("mean", F.round("mean", 9))


@query("met_exclusions", LONG + " SELECT task, arm, metric, status, detail, count(*) AS n FROM outcomes WHERE status <> 'ok' GROUP BY ALL", _VIEWS)
def met_exclusions(src):
    return M.exclusion_census(M.outcomes(_pairs(src)))


@query("met_arm_report", LONG + FOLDED + """, ek AS (SELECT task, arm, string_agg(concat(kind, ' x', n), ', ' ORDER BY n DESC, kind) AS error_kinds FROM (
   SELECT task, arm, left(split_part(trim(coalesce(error, 'unknown')), ':', 1), 80) AS kind, count(*) AS n FROM calls WHERE status = 'error' GROUP BY ALL) GROUP BY ALL),
  jr AS (SELECT task, arm, count(item_mean) AS judged_items, round(avg(item_mean), 9) AS judge_score, CAST(sum(n_repeats - n_good) AS BIGINT) AS failed_repeats FROM folded GROUP BY ALL),
  cc AS (SELECT task, arm, count(*) AS n_calls, count(*) FILTER (WHERE status = 'error') AS n_failed, string_agg(DISTINCT model, ', ' ORDER BY model) AS models FROM calls GROUP BY ALL),
  mm AS (SELECT task, arm, metric, count(value) AS n, round(avg(value), 9) AS mean, count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable FROM outcomes GROUP BY ALL)
 SELECT * FROM mm JOIN cc USING (task, arm) LEFT JOIN ek USING (task, arm) LEFT JOIN jr USING (task, arm)""", (*_VIEWS, "cells", "verdicts"))
def met_arm_report(src):
    judged = J.aggregate_repeats(J.fold_repeats(scored_cells(src, "gated")), 2)
    out = M.arm_report(M.outcomes(_pairs(src)), src.view("calls"), judged)
    return out.select("task", "arm", "metric", "n", F.round("mean", 9).alias("mean"), "n_not_applicable", "n_calls", "n_failed", "models", "error_kinds",
                      "judged_items", F.round("judge_score", 9).alias("judge_score"), "failed_repeats")


@query("met_field_tally", _fields_sql(M.ALL_EXTRACT_FIELDS) + " SELECT arm, field, " + ", ".join(
    f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in M.FIELD_VERDICTS) + " FROM fv GROUP BY ALL", _VIEWS)
def met_field_tally(src):
    return M.field_tally(_pairs(src), M.ALL_EXTRACT_FIELDS)


@query("met_malformed", SCORED + """ SELECT call_id, CASE WHEN status = 'error' THEN concat('call failed: ', coalesce(error, 'unknown')) WHEN j IS NULL THEN 'no JSON object'
  WHEN s.key IS NOT NULL THEN concat('re-encoded inside ', s.key) WHEN tag <> 'valid' THEN 'does not validate' END AS reason
FROM tagged LEFT JOIN (SELECT call_id, min(key) AS key FROM (SELECT call_id, task, key, TRY_CAST(j->>('$.' || key) AS JSON) AS inner_j
    FROM (SELECT call_id, task, j, unnest(json_keys(j)) AS key FROM scored) WHERE json_type(j, '$.' || key) = 'VARCHAR')
  WHERE json_type(inner_j) = 'OBJECT' AND len(list_filter(json_keys(inner_j), lambda x: list_contains(CASE task WHEN 'query_rewriter' THEN ['query', 'filters', 'intent'] WHEN 'chunk_summarizer' THEN ['summary', 'key_points']
    ELSE ['title', 'assignee', 'filing_date', 'jurisdiction', 'cpc_codes', 'technical_field', 'independent_claim_count', 'novelty_statement'] END, x))) >= 2 GROUP BY call_id) s USING (call_id)""", _VIEWS)
def met_malformed(src):
    reason = M.malformed_reason(F.col("status"), F.col("error"), F.col("task"), F.col("p"), F.col("shape"), F.col("payload_json"))
    return _pairs(src).select("call_id", reason.alias("reason"))


@query("met_emitted_chars", """ SELECT call_id, CAST(coalesce(length(output_text), 0) + coalesce(length(CAST(json(TRY_CAST(payload_json AS JSON)) AS VARCHAR)), 0) AS INTEGER) AS chars FROM calls""", ("calls",))
def met_emitted_chars(src):
    return src.view("calls").select("call_id", M.emitted_chars(F.col("output_text"), F.col("payload_json")).alias("chars"))
