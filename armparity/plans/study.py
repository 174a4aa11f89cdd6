"""Study tables: call logs, gold items and judge verdicts derived from the given tables.

Each view is written once in SQL that both Spark and DuckDB accept, apart from three
tokens replaced per dialect: ``//`` (integer division), ``@each(a,b)`` (one row per
element) and ``@json(col,key)`` (text of a JSON member). The views are row-local: no
shuffle is needed to build any of them, and all of them grow with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from armparity.constants import INTENTS, TASKS

#: Difficulty buckets with their planned shares.
MIX = (("simple", 0.40), ("multi_hop", 0.25), ("extraction", 0.20), ("edge", 0.15))

BASELINE, CANDIDATE = "baseline", "candidate"


def _text(template: str) -> str:
    """``concat`` expression for text with ``<expr>`` holes."""
    parts = re.split(r"<([^<>]*)>", template)
    args = []
    for i, part in enumerate(parts):
        if i % 2:
            args.append(part)
        elif part:
            args.append("'" + part.replace("'", "''") + "'")
    return "concat(" + ", ".join(args) + ")"


def _pick(index: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {arms} ELSE '{values[-1]}' END"


def _case(*pairs: tuple[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {cond} THEN {_text(t)}" for cond, t in pairs)
    return f"CASE {arms} ELSE {_text(default)} END"


_TASK = _pick("item_id % 3", TASKS)
_BUCKET = (
    "CASE WHEN item_id % 20 < 8 THEN 'simple' WHEN item_id % 20 < 13 THEN 'multi_hop' "
    "WHEN item_id % 20 < 17 THEN 'extraction' ELSE 'edge' END"
)

# --- well-formed answers, one template per task -------------------------------
_QR_FILTERS = _case(
    ("k % 13 = 0", '{"date_from":null,"date_to":"","assignees":[],"jurisdictions":[],"cpc_codes":[]}'),
    ("k % 5 = 0", '{"date_from":null,"assignees":[" acme <item_id % 5> ","Gamma"],"jurisdictions":["EP"],"cpc_codes":[]}'),
    ("k % 3 = 0", '{"date_from":"20<10 + item_id % 9>-01-01","assignees":[" acme <item_id % 5> "],"jurisdictions":["u s"],"cpc_codes":["h01m 10/<item_id % 7>"]}'),
    default='{"date_from":"20<10 + item_id % 9>-01-01","date_to":null,"assignees":["ACME  <item_id % 5>","beta corp"],"jurisdictions":["us"],"cpc_codes":["h01m10/<item_id % 7>","G06F"]}',
)
_QR_TAIL = _case(
    ("k % 4 = 0", "topic <item_id % 17> systems"),
    ("k % 4 = 1", "topic <item_id % 17> system"),
    ("k % 4 = 2", "topic <item_id % 17> systems and methods"),
    default="devices of topic <item_id % 17>",
)
_QR_INTENT = _pick("(item_id + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) % 5", INTENTS)
_QR = f"concat('{{\"query\":\"', {_QR_TAIL}, '\",\"filters\":', {_QR_FILTERS}, ',\"intent\":\"', {_QR_INTENT}, '\"}}')"

_CS = _case(
    ("k % 17 = 0", '{"summary":"digest <item_id % 17>","key_points":[]}'),
    ("k % 19 = 1", '{"summary":"digest <item_id % 17> with notes","key_points":"none"}'),
    ("k % 4 = 0", '{"summary":"digest of topic <item_id % 17>","key_points":[{"text":"claim <item_id % 9>","chunk_ids":["c1"]},{"text":"aside","chunk_ids":[]}]}'),
    ("k % 5 = 0", '{"summary":"digest of topic <item_id % 17> and <k % 3> notes","key_points":[{"text":"claim <item_id % 9>","chunk_ids":["c1","c9"]},{"text":"more","chunk_ids":["c2"]},{"text":"none","chunk_ids":[]}]}'),
    default='{"summary":"digest of topic <item_id % 17>","key_points":[{"text":"claim <item_id % 9>","chunk_ids":["c1"]},{"text":"second","chunk_ids":["c2","c3"]}]}',
)

_FE = _case(
    ("k % 10 = 1", '{"title":null,"assignee":"acme <item_id % 5>","filing_date":"2020-0<1 + item_id % 9>-15","jurisdiction":"u s","cpc_codes":["g06f","h01m 10/<item_id % 7>"],"technical_field":"field <item_id % 6>","independent_claim_count":<1 + item_id % 4>,"novelty_statement":null}'),
    ("k % 10 = 2", '{"title":"Gadget","assignee":null,"filing_date":null,"jurisdiction":"EP","cpc_codes":[],"technical_field":"area <k % 3>","independent_claim_count":null}'),
    ("k % 10 = 3", '{"title":" widget <item_id % 9>  ASSEMBLY","assignee":"Beta","jurisdiction":"US","cpc_codes":["G06F"],"technical_field":null,"independent_claim_count":9,"novelty_statement":"novel <item_id % 5> thing"}'),
    ("k % 50 = 44", "{}"),
    default='{"title":"Widget <item_id % 9> assembly","assignee":"Acme  <item_id % 5>","filing_date":"2020-0<1 + item_id % 9>-15","jurisdiction":"US","cpc_codes":["H01M10/<item_id % 7>","G06F"],"technical_field":"field <item_id % 6>","independent_claim_count":<1 + item_id % 4>,"novelty_statement":"novel <item_id % 5> thing again"}',
)

_CALLS_CORE = f"""
SELECT event_id AS call_id, event_id // 2 AS item_id,
       CASE WHEN event_id % 2 = 0 THEN '{BASELINE}' ELSE '{CANDIDATE}' END AS arm,
       CAST(@json(props,k) AS BIGINT) AS k,
       ts, user_id, value, event_type
FROM events"""

_CALLS_OK = f"""
SELECT c.*, {_TASK} AS task, {_BUCKET} AS bucket, item_id % 5 < 2 AS core,
       CASE {_TASK} WHEN '{TASKS[0]}' THEN {_QR} WHEN '{TASKS[1]}' THEN {_CS} ELSE {_FE} END AS good
FROM ({_CALLS_CORE}) c"""

def _by_task(qr: str, cs: str, fe: str) -> str:
    return f"CASE task WHEN '{TASKS[0]}' THEN '{qr}' WHEN '{TASKS[1]}' THEN '{cs}' ELSE '{fe}' END"


# The well-formed answer is referred to once, so the text built around it stays small.
_BODY = "substr(replace(good, '\"', CASE WHEN k = 37 THEN concat(chr(92), '\"') ELSE '\"' END), CASE WHEN k = 27 THEN 2 ELSE 1 END)"
_BEFORE = "CASE WHEN k = 27 THEN '{\"note\":\"x\",' WHEN k = 37 THEN " + _by_task('{"query":"', '{"summary":"', '{"title":"') + " ELSE '' END"
_AFTER = "CASE WHEN k = 37 THEN " + _by_task('","intent":"prior_art"}', '"}', '"}') + " ELSE '' END"
_PAYLOAD = f"""CASE WHEN event_type = 'error' OR k IN (7, 87, 97) THEN NULL
  WHEN k = 17 THEN '[1, 2]'
  WHEN k = 47 THEN {_by_task('{"query":5,"intent":"prior_art"}', '{"summary":"s","key_points":{}}', '{"title":7}')}
  WHEN k = 57 THEN {_by_task('{"query":"q"}', '{"summary":"s","key_points":[{"text":"t"}]}', '{"independent_claim_count":"3"}')}
  WHEN k = 67 THEN {_by_task('{"query":"q","intent":"browse"}', '{"summary":null,"key_points":[]}', '{"independent_claim_count":3.5}')}
  ELSE concat({_BEFORE}, {_BODY}, {_AFTER}) END"""

_GOLD_QR = "concat(" + _case(
    ("item_id % 11 = 0", '{"query":"topic <item_id % 17> systems","filters":{"date_from":null,"date_to":null,"assignees":[],"jurisdictions":[],"cpc_codes":[]}'),
    ("item_id % 2 = 0", '{"query":"topic <item_id % 17> systems","filters":{"date_from":null,"assignees":["Acme <item_id % 5>"],"jurisdictions":["US"],"cpc_codes":["H01M10/<item_id % 7>"]}'),
    default='{"query":"topic <item_id % 17> systems","filters":{"date_from":"20<10 + item_id % 9>-01-01","assignees":["Acme <item_id % 5>","Beta Corp"],"jurisdictions":["US"],"cpc_codes":["H01M10/<item_id % 7>"]}',
) + ", " + _case(
    ("item_id % 13 = 0", "}"),
    default=',"intent":"<' + _pick("item_id % 5", INTENTS) + '>"}',
) + ")"
_GOLD_CS = _text('{"summary":"digest of topic <item_id % 17>","key_points":[{"text":"claim <item_id % 9>","chunk_ids":["c1"]}]}')
_GOLD_FE = (
    "concat('{', " + _case(("item_id % 10 = 3", ""), default='"title":"Widget <item_id % 9> assembly",').replace("concat()", "''")
    + ", '\"assignee\":', " + _case(("item_id % 7 = 0", "null"), default='"Acme <item_id % 5>"')
    + ", ',\"filing_date\":', " + _case(("item_id % 4 = 0", "null"), default='"2020-0<1 + item_id % 9>-15"')
    + ", ',\"jurisdiction\":\"US\",\"cpc_codes\":', " + _case(("item_id % 6 = 2", "[]"), default='["H01M10/<item_id % 7>","G06F"]')
    + ", ',\"technical_field\":', " + _case(("item_id % 8 = 0", "null"), default='"field <item_id % 6>"')
    + ", ',\"independent_claim_count\":', " + _case(("item_id % 5 = 0", "null"), default="<1 + item_id % 4>")
    + ", ',\"novelty_statement\":', " + _case(("item_id % 9 = 2", "null"), default='"novel <item_id % 5> thing"')
    + ", '}')"
)

VIEWS: dict[str, str] = {}

VIEWS["calls"] = f"""
SELECT call_id, item_id, arm, task, bucket, core, k, ts, user_id,
       CASE WHEN arm = '{BASELINE}' THEN 'incumbent' WHEN k % 10 = 9 THEN 'candidate-pro' ELSE 'candidate-flash' END AS model,
       CASE WHEN user_id % 3 = 0 THEN 'global' WHEN user_id % 3 = 1 THEN 'region-a' ELSE 'region-b' END AS region,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN event_type <> 'error' THEN NULL
            WHEN k % 4 = 0 THEN concat('RateLimit: quota for call ', call_id)
            WHEN k % 4 = 1 THEN concat('Timeout: no answer after ', k, ' s')
            WHEN k % 4 = 2 THEN concat('  connection reset by peer, attempt ', k % 3, '  ')
            ELSE NULL END AS error,
       CASE WHEN k % 33 = 5 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS total_ms,
       CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) // 3 END AS ttft_ms,
       200 + 7 * k AS input_tokens, 20 + (31 * call_id) % 97 AS output_tokens,
       CASE WHEN k % 5 = 0 THEN 100 + k ELSE 0 END AS cached_tokens,
       {_PAYLOAD} AS payload_json,
       CASE WHEN event_type <> 'error' AND k = 7 THEN 'plain words, no object' WHEN event_type <> 'error' AND k = 97 THEN '  ' END AS output_text
FROM ({_CALLS_OK}) r"""

VIEWS["items"] = f"""
SELECT item_id, {_TASK} AS task, {_BUCKET} AS bucket, item_id % 5 < 2 AS core,
       CASE item_id % 3 WHEN 0 THEN {_GOLD_QR} WHEN 1 THEN {_GOLD_CS} ELSE {_GOLD_FE} END AS gold_json,
       2 + item_id % 3 AS n_chunks, 3 + item_id % 3 AS n_rubric,
       concat('tpl-', item_id % 6) AS template_id,
       CASE WHEN item_id % 1000 = 1 THEN 43 ELSE 42 END AS seed,
       CASE WHEN item_id % 3 = 2 AND item_id % 500 = 2 THEN 'v2' ELSE 'v1' END AS generator_version,
       'synthetic' AS provenance
FROM ({_CALLS_CORE}) c WHERE call_id % 2 = 0"""

VIEWS["cells"] = f"""
SELECT call_id, item_id, arm, task, core, k, judge, repeat,
       CASE WHEN judge = 'gated' AND (k + repeat) % 25 = 0 THEN 'error'
            WHEN judge = 'check' AND (k + 2 * repeat) % 23 = 1 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN judge = 'gated' AND (k + repeat) % 25 = 0 THEN 'Timeout: judge gave up'
            WHEN judge = 'check' AND (k + 2 * repeat) % 23 = 1 THEN 'RateLimit: judge refused' END AS error,
       CASE WHEN judge = 'check' AND call_id % 45 = 8 THEN 3 ELSE 4 END AS n_criteria
FROM (SELECT j.*, @each(1,2) AS repeat
      FROM (SELECT call_id, item_id, arm, task, core, k, @each('gated','check') AS judge
            FROM (SELECT event_id AS call_id, event_id // 2 AS item_id,
                         CASE WHEN event_id % 2 = 0 THEN '{BASELINE}' ELSE '{CANDIDATE}' END AS arm,
                         CASE (event_id // 2) % 3 WHEN 0 THEN '{TASKS[0]}' WHEN 1 THEN '{TASKS[1]}' ELSE '{TASKS[2]}' END AS task,
                         (event_id // 2) % 5 < 2 AS core, CAST(@json(props,k) AS BIGINT) AS k
                  FROM events WHERE event_type <> 'error') e) j) x
WHERE NOT (judge = 'check' AND call_id % 40 = 7)"""

VIEWS["verdicts"] = f"""
SELECT call_id, item_id, arm, task, core, k, judge, repeat, concat('c', c) AS criterion_id,
       CASE WHEN judge = 'check' AND (call_id + repeat + 3 * c + k) % 12 = 0
            THEN (7 * call_id + 13 * repeat + 29 * c + k) % 10 >= 8
            ELSE (7 * call_id + 13 * repeat + 29 * c + k) % 10 < 8 END AS passed,
       concat('why ', c, ' of ', k) AS rationale
FROM (SELECT v.*, @each(1,2,3,4) AS c FROM ({VIEWS['cells']}) v WHERE status = 'ok') w
WHERE c <= n_criteria"""

VIEWS["judge_raw"] = """
SELECT call_id, item_id, arm, task, judge, repeat, status, error,
  CASE WHEN status = 'error' OR m IN (0, 1, 2) THEN NULL ELSE body END AS payload_json,
  CASE WHEN status = 'ok' AND m = 1 THEN body END AS tool_args,
  CASE WHEN status = 'ok' AND m = 0 THEN body WHEN status = 'ok' AND m = 2 THEN 'cannot say' END AS output_text
FROM (SELECT n.*, CASE WHEN m = 3 THEN '{"overall_rationale":"none"}'
    WHEN m = 4 THEN concat('{"criteria":[', c1, ',', c1, ',', c3, ',', c4, ']}')
    WHEN m = 5 THEN concat('{"criteria":[', c1, ',', c3, ']}')
    WHEN m = 6 THEN concat('{"criteria":[', replace(c1, 'why', ' '), ',', c2, ',', c3, ',', c4, ']}')
    WHEN m = 7 THEN '{"criteria":"all good"}'
    ELSE concat('{"criteria":[', c4, ',', c1, ',', c2, ',', c3, '],"overall_rationale":"note ', k, '"}') END AS body
  FROM (SELECT o.*, (call_id + repeat) % 50 AS m,
      concat('{"criterion_id":"c1","passed":', CASE WHEN (7 * call_id + 13 * repeat + 29 + k) % 10 < 8 THEN 'true' ELSE 'false' END, ',"rationale":"why"}') AS c1,
      concat('{"criterion_id":"c2","passed":', CASE WHEN (7 * call_id + 13 * repeat + 58 + k) % 10 < 8 THEN 'true' ELSE 'false' END, ',"rationale":"why"}') AS c2,
      concat('{"criterion_id":"c3","passed":', CASE WHEN (7 * call_id + 13 * repeat + 87 + k) % 10 < 8 THEN 'true' ELSE 'false' END, ',"rationale":"why"}') AS c3,
      concat('{"criterion_id":"c4","passed":', CASE WHEN (7 * call_id + 13 * repeat + 116 + k) % 10 < 8 THEN 'true' ELSE 'false' END, ',"rationale":"why"}') AS c4
    FROM (""" + VIEWS["cells"] + """) o WHERE judge = 'gated') n) b"""

#: Small registries the calls are priced and gated with (fixed values of this study).
VIEWS["prices"] = """
SELECT model, CAST(i AS DOUBLE) AS input_per_1m, CAST(o AS DOUBLE) AS output_per_1m, CAST(c AS DOUBLE) AS cached_per_1m
FROM (VALUES ('incumbent', 2.0, 10.0, 0.2), ('candidate-flash', 0.3, 2.5, 0.03), ('candidate-pro', 1.25, 10.0, 0.125)) AS p(model, i, o, c)"""

VIEWS["gates"] = """
SELECT * FROM (VALUES (1, 'quality_delta_pp', 'min', '-2.0', 'percentage_points', NULL, 'quality'),
  (2, 'json_schema_validity', 'min', '0.99', 'fraction', NULL, 'blocking'),
  (3, 'groundedness_delta_pp', 'min', '-1.0', 'percentage_points', NULL, 'quality'),
  (4, 'shadow_agreement', 'min', '0.90', 'fraction', 'wins >= losses', 'blocking'),
  (5, 'cost_savings_pct', 'min', '30', 'percent', NULL, 'other'),
  (6, 'latency_p95', 'max', 'baseline_p95', 'ms', NULL, 'other')) AS g(ordinal, gate, direction, bound, unit, alt, role)"""

VIEWS["verdict_rules"] = """
SELECT * FROM (VALUES ('MIGRATE', 'all_pass', 'every gate holds on its bound'),
  ('TUNE_FIRST', 'only_quality_gates_fail', 'the structure holds, quality is short'),
  ('HOLD', 'any_blocking_gate_fails', 'the structure fails')) AS v(verdict, rule, description)"""

VIEWS["price_book"] = """
SELECT p_partkey AS book_id, concat('m', p_partkey) AS model,
       CASE WHEN p_size % 10 = 0 THEN 'VERIFY' ELSE CAST(CAST(p_size AS BIGINT) AS STRING) END AS input,
       CASE WHEN p_partkey % 9 = 0 THEN 'VERIFY' ELSE CAST(CAST(p_size * 5 AS BIGINT) AS STRING) END AS output,
       CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE CAST(CAST(p_size * 2 AS BIGINT) AS STRING) END AS cached_input,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '2026-01-15' END AS verified_on
FROM part"""

VIEWS["citations"] = """
SELECT concat('m', CASE WHEN p_partkey % 20 = 3 THEN p_partkey + 1000000000 ELSE p_partkey END) AS model,
       concat('section ', p_brand) AS section
FROM part WHERE p_partkey % 6 <> 1"""

VIEWS["gate_book"] = """
SELECT concat('g', s_suppkey) AS gate, s_suppkey AS book_id,
       CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_nationkey % 4 = 0 THEN concat('n', s_nationkey) ELSE CAST(s_nationkey AS STRING) END END AS min_bound,
       CASE WHEN s_suppkey % 4 = 0 THEN concat('n', s_nationkey) END AS max_bound
FROM supplier"""


def _dialect(sql: str, engine: str) -> str:
    if engine == "spark":
        sql = sql.replace("//", " div ")
        sql = re.sub(r"@each\(([^()]*)\)", r"explode(array(\1))", sql)
        return re.sub(r"@json\((\w+),(\w+)\)", r"get_json_object(\1, '$.\2')", sql)
    sql = re.sub(r"@each\(([^()]*)\)", r"unnest([\1])", sql)
    return re.sub(r"@json\((\w+),(\w+)\)", r"json_extract_string(\1, '$.\2')", sql)


_BASE = ("events", "part", "supplier", "nation", "customer", "orders", "lineitem",
         "documents", "labels", "conversations", "benchmark", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One study view as a Spark DataFrame."""
    sql = _dialect(VIEWS[name], "spark")
    used = [t for t in _BASE if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    frames = {}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        frames[t] = table(spark, sf_dir, t)
    if not frames:
        return spark.sql(sql)
    # spark.sql formats with str.format, so literal braces are doubled first
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = sql.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return spark.sql(sql, **frames)


def duck(*names: str) -> str:
    """``WITH`` clause defining the named views for the SQL oracle."""
    return "WITH " + ", ".join(f"{n} AS ({_dialect(VIEWS[n], 'duckdb')})" for n in names)
