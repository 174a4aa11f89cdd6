"""Sources, registries and replay keys."""

from pyspark.sql import functions as F

from armparity.functions import keys
from armparity.operators import store as ops
from armparity.plans.registry import query
from armparity.sources import registries as reg


def _store(src, extra=()):
    """Recordings with repeated keys: four items share one question."""
    return src.view("calls").select(
        "task", "model", keys.sha16(F.concat(F.lit("question "), F.expr("item_id div 4").cast("string"))).alias("input_sha"),
        F.col("call_id").alias("ordinal"), "ts", *extra,
    )


STORE = """, store AS (SELECT task, model, substr(sha256(concat('question ', item_id // 4)), 1, 16) AS input_sha,
  call_id AS ordinal, ts, status, total_ms, item_id FROM calls)"""


def _requests(src):
    """One request per item; some ask for a model or a task nobody recorded."""
    i = F.col("item_id")
    return src.view("items").select(
        "item_id",
        F.when(i % 50 == 3, F.lit("other_task")).otherwise(F.col("task")).alias("task"),
        F.when(i % 7 == 0, F.lit("unseen-model")).when(i % 2 == 0, F.lit("incumbent")).otherwise(F.lit("candidate-pro")).alias("model"),
        keys.sha16(F.concat(F.lit("question "), F.expr("item_id div 4").cast("string"))).alias("input_sha"),
    )


REQUESTS = """, requests AS (SELECT item_id, CASE WHEN item_id % 50 = 3 THEN 'other_task' ELSE task END AS task,
  CASE WHEN item_id % 7 = 0 THEN 'unseen-model' WHEN item_id % 2 = 0 THEN 'incumbent' ELSE 'candidate-pro' END AS model,
  substr(sha256(concat('question ', item_id // 4)), 1, 16) AS input_sha FROM items)"""


@query("key_sha16", "SELECT doc_id, substr(sha256(text), 1, 16) AS sha FROM documents")
def key_sha16(src):
    return src.table("documents").select("doc_id", keys.sha16(F.col("text")).alias("sha"))


@query("key_input_sha", r"""
SELECT conv_id, turn, substr(sha256(list_aggregate(list_transform(
    regexp_extract_all(concat('{"context_chunks":[],"messages":[', CAST(to_json(text) AS VARCHAR), '],"system_prompt_sha":"', substr(sha256(role),1,16), '","tools_offered":["a_tool","emit"]}'), '(?s).'),
    lambda c: CASE WHEN unicode(c) < 128 THEN c
      WHEN unicode(c) > 65535 THEN concat('\u', format('{:04x}', CAST(55296 + (unicode(c) - 65536) // 1024 AS INTEGER)), '\u', format('{:04x}', CAST(56320 + (unicode(c) - 65536) % 1024 AS INTEGER)))
      ELSE concat('\u', format('{:04x}', unicode(c))) END), 'string_agg', '')), 1, 16) AS input_sha
FROM conversations""")
def key_input_sha(src):
    return src.table("conversations").select(
        "conv_id", "turn",
        keys.input_sha(keys.sha16(F.col("role")), F.array("text"), F.array().cast("array<string>"),
                       F.array(F.lit("emit"), F.lit("a_tool"))).alias("input_sha"),
    )


@query("key_keep_latest", STORE + """ SELECT task, model, input_sha, ordinal, status, total_ms FROM store
QUALIFY row_number() OVER (PARTITION BY task, model, input_sha ORDER BY ordinal DESC) = 1""", ("calls",))
def key_keep_latest(src):
    return ops.keep_latest(_store(src, ("status", "total_ms"))).drop("ts")


@query("key_lookup", STORE + REQUESTS + """, latest AS (SELECT * FROM store
  QUALIFY row_number() OVER (PARTITION BY task, model, input_sha ORDER BY ordinal DESC) = 1)
SELECT r.item_id, r.task, r.model, l.ordinal, l.status, l.ordinal IS NOT NULL AS found
FROM requests r LEFT JOIN latest l USING (task, model, input_sha)""", ("calls", "items"))
def key_lookup(src):
    return ops.lookup(_requests(src), _store(src, ("status",))).select(
        "item_id", "task", "model", "ordinal", "status", "found")


@query("key_miss_reasons", STORE + REQUESTS + """,
 bm AS (SELECT task, model, count(*) AS nm FROM store GROUP BY ALL),
 bt AS (SELECT task, string_agg(DISTINCT model, ', ' ORDER BY model) AS models FROM store GROUP BY ALL)
SELECT r.item_id, CASE WHEN bt.task IS NULL THEN 'store has no recordings for this task'
  WHEN bm.nm IS NULL THEN concat('no rows for this model; recorded: ', models)
  ELSE concat('model recorded on ', nm, ' other inputs') END AS reason
FROM requests r LEFT JOIN bt USING (task) LEFT JOIN bm ON bm.task = r.task AND bm.model = r.model
WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.task = r.task AND s.model = r.model AND s.input_sha = r.input_sha)
""", ("calls", "items"))
def key_miss_reasons(src):
    return ops.miss_reasons(_requests(src), _store(src)).select("item_id", "reason")


@query("key_recording_window", """ SELECT task, model, CAST(min(ts) AS VARCHAR)[:19] AS first_ts,
  CAST(max(ts) AS VARCHAR)[:19] AS last_ts, count(*) AS n_calls FROM calls GROUP BY ALL""", ("calls",))
def key_recording_window(src):
    return ops.recording_window(src.view("calls")).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("key_merge_windows", """ SELECT model, CAST(min(ts) AS VARCHAR)[:19] AS first_ts,
  CAST(max(ts) AS VARCHAR)[:19] AS last_ts, count(*) AS n_calls FROM calls GROUP BY ALL""", ("calls",))
def key_merge_windows(src):
    per_task = ops.recording_window(src.view("calls"))
    return ops.merge_windows(per_task, ("model",)).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("key_membership", STORE + REQUESTS + """ SELECT item_id FROM requests r WHERE EXISTS
 (SELECT 1 FROM store s WHERE s.task = r.task AND s.model = r.model AND s.input_sha = r.input_sha)""", ("calls", "items"))
def key_membership(src):
    return _requests(src).join(_store(src), list(ops.KEY), "left_semi").select("item_id")


@query("key_tasks", " SELECT DISTINCT task FROM calls", ("calls",))
def key_tasks(src):
    return src.view("calls").select("task").distinct()


@query("key_recorded_first", STORE + REQUESTS + """,
 k AS (SELECT DISTINCT task, model, input_sha FROM store)
SELECT r.task, CASE WHEN k.task IS NULL THEN 'to_run' ELSE 'recorded' END AS outcome, count(*) AS n
FROM requests r LEFT JOIN k USING (task, model, input_sha) GROUP BY ALL""", ("calls", "items"))
def key_recorded_first(src):
    served = ops.lookup(_requests(src), _store(src))
    outcome = F.when(F.col("found"), "recorded").otherwise("to_run").alias("outcome")
    return served.groupBy("task", outcome).agg(F.count("*").alias("n"))


@query("src_build_calls", """ SELECT i.item_id, i.task, CASE WHEN c.call_id IS NULL OR c.status = 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN c.call_id IS NULL THEN 'no response recorded' WHEN c.status = 'error' THEN coalesce(c.error, 'unstated') END AS error, c.total_ms
FROM items i LEFT JOIN (SELECT * REPLACE (item_id + CASE WHEN k % 20 = 4 THEN 1000000000000 ELSE 0 END AS item_id) FROM calls WHERE arm = 'candidate') c USING (item_id)""", ("items", "calls"))
def src_build_calls(src):
    answers = src.view("calls").filter("arm = 'candidate'").withColumn("item_id", F.col("item_id") + F.when(F.col("k") % 20 == 4, 10**12).otherwise(0)).select(
        "item_id", "total_ms",
        F.when(F.col("status") == "error", F.coalesce("error", F.lit("unstated"))).alias("response_error"))
    requests = src.view("items").select("item_id", "task")
    return ops.build_calls(requests, answers, "item_id").select("item_id", "task", "status", "error", "total_ms")


@query("src_parse_volume", r""", specs AS (SELECT o_orderkey AS spec_id, concat(o_orderpriority, ':', CASE WHEN o_orderkey % 9 = 0 THEN 'many' ELSE CAST(o_custkey AS VARCHAR) END,
   CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ':300' WHEN 2 THEN ':300:40' ELSE concat(':', o_custkey, ':2.5') END) AS spec FROM orders),
 p AS (SELECT spec_id, spec, string_split(spec, ':') AS x FROM specs),
 q AS (SELECT *, len(x) IN (2, 4) AND regexp_full_match(x[2], '[+-]?[0-9]+') AND (len(x) = 2 OR (regexp_full_match(x[3], '[+-]?[0-9]+') AND regexp_full_match(x[4], '[+-]?[0-9]+'))) AS ok FROM p)
SELECT spec_id, ok, CASE WHEN ok THEN x[1] END AS task, CASE WHEN ok THEN CAST(x[2] AS BIGINT) END AS calls_per_day,
 CASE WHEN ok AND len(x) = 4 THEN CAST(x[3] AS BIGINT) END AS avg_in, CASE WHEN ok AND len(x) = 4 THEN CAST(x[4] AS BIGINT) END AS avg_out FROM q""".lstrip(", ").join(["WITH ", ""]))
def src_parse_volume(src):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    spec = F.concat(
        "o_orderpriority", F.lit(":"), F.when(key % 9 == 0, "many").otherwise(cust),
        F.when(key % 4 == 0, "").when(key % 4 == 1, ":300").when(key % 4 == 2, ":300:40").otherwise(F.concat(F.lit(":"), cust, F.lit(":2.5"))))
    v = ops.parse_volume(spec)
    return src.table("orders").select(key.alias("spec_id"), v.alias("v")).select(
        "spec_id", F.col("v").isNotNull().alias("ok"), "v.task", "v.calls_per_day", "v.avg_in", "v.avg_out")


@query("src_registry_join", """ SELECT c.task, c.model, p.input_per_1m, p.output_per_1m, count(*) AS n
FROM calls c JOIN prices p USING (model) GROUP BY ALL""", ("calls", "prices"))
def src_registry_join(src):
    counted = src.view("calls").groupBy("task", "model").agg(F.count("*").alias("n"))
    return counted.join(src.view("prices").drop("cached_per_1m"), "model")


@query("src_unverified_slots", """ SELECT model, kind FROM (
  SELECT model, 'input' AS kind, input AS v FROM price_book UNION ALL SELECT model, 'output', output FROM price_book
  UNION ALL SELECT model, 'cached_input', cached_input FROM price_book) WHERE v = 'VERIFY'""", ("price_book",))
def src_unverified_slots(src):
    return reg.unverified_slots(reg.price_slots(src.view("price_book"))).select("model", "kind")


@query("src_book_verified", """ SELECT book_id % 97 AS book, CAST(count(*) FILTER (WHERE 'VERIFY' IN (input, output, cached_input)) AS BIGINT) AS rows_unset,
  count(*) FILTER (WHERE verified_on IS NULL) AS rows_unstamped,
  count(*) FILTER (WHERE coalesce('VERIFY' IN (input, output, cached_input), false)) = 0 AND count(*) = count(verified_on) AS verified
FROM price_book GROUP BY ALL""", ("price_book",))
def src_book_verified(src):
    return reg.book_is_verified(src.view("price_book"), F.col("book_id") % 97)


@query("src_uncited", " SELECT model FROM price_book WHERE model NOT IN (SELECT model FROM citations)", ("price_book", "citations"))
def src_uncited(src):
    return reg.uncited(src.view("price_book"), src.view("citations"))


@query("src_stale_citations", " SELECT model, section FROM citations WHERE model NOT IN (SELECT model FROM price_book)", ("price_book", "citations"))
def src_stale_citations(src):
    return reg.stale_citations(src.view("price_book"), src.view("citations"))


@query("src_rate_lookup", """, slots AS (SELECT model, 'input' AS kind, input AS v FROM price_book UNION ALL SELECT model, 'output', output FROM price_book
  UNION ALL SELECT model, 'cached_input', cached_input FROM price_book),
 req AS (SELECT l_partkey AS part_id, concat('m', CASE WHEN l_suppkey % 11 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END) AS model,
   CASE l_linenumber % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'output' WHEN 2 THEN 'cached_input' ELSE 'batch' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT req.model, req.kind, n, TRY_CAST(v AS DOUBLE) AS rate, CASE WHEN slots.model IS NULL THEN 'unknown model or kind' WHEN v IS NULL THEN 'no rate stated'
  WHEN v = 'VERIFY' THEN 'rate not verified' END AS reject
FROM req LEFT JOIN slots ON slots.model = req.model AND slots.kind = req.kind""", ("price_book",))
def src_rate_lookup(src):
    line = F.col("l_linenumber") % 4
    kind = F.when(line == 0, "input").when(line == 1, "output").when(line == 2, "cached_input").otherwise("batch")
    part = F.when(F.col("l_suppkey") % 11 == 0, F.col("l_partkey") + 1000000000).otherwise(F.col("l_partkey"))
    requests = src.table("lineitem").groupBy(
        F.concat(F.lit("m"), part.cast("string")).alias("model"), kind.alias("kind")).agg(F.count("*").alias("n"))
    return reg.rate_lookup(requests, reg.price_slots(src.view("price_book")))


@query("gate_defects", """, s AS (SELECT concat('n', n_nationkey) AS sentinel FROM nation WHERE n_regionkey < 3), b AS (
  SELECT *, coalesce(min_bound, max_bound) AS bound FROM gate_book)
SELECT gate, CASE WHEN min_bound IS NOT NULL AND max_bound IS NOT NULL THEN 'two bounds' WHEN bound IS NULL THEN 'no bound'
  ELSE concat('unknown sentinel ', bound) END AS defect
FROM b WHERE (min_bound IS NOT NULL AND max_bound IS NOT NULL) OR bound IS NULL
  OR (TRY_CAST(bound AS DOUBLE) IS NULL AND bound NOT IN (SELECT sentinel FROM s))""", ("gate_book",))
def gate_defects(src):
    sentinels = src.table("nation").filter("n_regionkey < 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sentinel"))
    return reg.gate_defects(src.view("gate_book"), sentinels)


@query("gate_verdict_references", """, r AS (SELECT concat('v', s_suppkey % 11) AS verdict, CASE WHEN s_suppkey % 2 = 0 THEN 'quality' ELSE 'blocking' END AS role, concat('g', s_suppkey + CASE WHEN s_suppkey % 9 = 0 THEN 1000000000 ELSE 0 END) AS gate FROM supplier)
 SELECT verdict, role, gate, concat('verdicts.', verdict, '.', role, ' names no declared gate: ', gate) AS defect FROM r WHERE gate NOT IN (SELECT gate FROM gate_book)""", ("gate_book",))
def gate_verdict_references(src):
    """Verdict rules that name a gate nobody declares."""
    key = F.col("s_suppkey")
    gate = F.concat(F.lit("g"), (key + F.when(key % 9 == 0, 10**9).otherwise(0)).cast("string"))
    rules = src.table("supplier").groupBy(F.concat(F.lit("v"), (key % 11).cast("string")).alias("verdict")).agg(
        F.collect_list(F.when(key % 2 == 0, gate)).alias("quality"), F.collect_list(F.when(key % 2 != 0, gate)).alias("blocking"))
    return reg.verdict_defects(rules, src.view("gate_book"))
