"""Corpus building."""

from pyspark.sql import functions as F

from armparity.operators import sampling as G
from armparity.plans.registry import query
from armparity.plans.study import MIX

_SEED = 7
_W = "(VALUES ('simple', 0.40, 0), ('multi_hop', 0.25, 1), ('extraction', 0.20, 2), ('edge', 0.15, 3)) w(bucket, wt, ord)"


def _alloc(frm, by):
    return f""", ex AS (SELECT {by}, bucket, ord, n, CAST(floor(round(n * wt, 9)) AS BIGINT) AS whole, round(n * wt - floor(round(n * wt, 9)), 9) AS frac FROM {frm}, {_W}),
 alloc AS (SELECT {by}, bucket, ord, whole + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY frac DESC, ord) <= n - sum(whole) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS quota FROM ex)"""


def _order(key):
    return F.md5(F.concat_ws("|", F.lit(str(_SEED)), F.col(key).cast("string")))


@query("gen_allocate", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)" + _alloc("t", "o_custkey") + " SELECT o_custkey, bucket, quota FROM alloc")
def gen_allocate(src):
    totals = src.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return G.allocate(totals, ("o_custkey",), list(MIX)).drop("ord")


SEQ = """, t AS (SELECT task, count(*) AS n FROM items GROUP BY ALL)""" + _alloc("t", "task") + f""", cut AS (SELECT task, bucket, sum(quota) OVER (PARTITION BY task ORDER BY ord) AS hi, sum(quota) OVER (PARTITION BY task ORDER BY ord) - quota AS lo FROM alloc),
 pos AS (SELECT task, item_id, row_number() OVER (PARTITION BY task ORDER BY md5(concat('{_SEED}|', item_id))) - 1 AS position FROM items),
 seq AS (SELECT p.task, p.item_id, position, bucket FROM pos p JOIN cut c ON c.task = p.task AND position >= lo AND position < hi)"""


def sequence(src):
    return G.bucket_sequence(src.view("items").select("task", "item_id"), ("task",), _order("item_id"), list(MIX))


@query("gen_sequence", SEQ + " SELECT * FROM seq", ("items",))
def gen_sequence(src):
    return sequence(src)


@query("gen_mix_of", " SELECT task, bucket, n, round(n / sum(n) OVER (PARTITION BY task), 9) AS share FROM (SELECT task, bucket, count(*) AS n FROM items GROUP BY ALL)", ("items",))
def gen_mix_of(src):
    return G.mix_of(src.view("items"), ("task",)).withColumn("share", F.round("share", 9))


@query("gen_templates", f", pos AS (SELECT task, bucket, item_id, row_number() OVER (PARTITION BY task, bucket ORDER BY md5(concat('{_SEED}|', item_id))) - 1 AS position FROM items) SELECT task, bucket, item_id, list_extract(['t1', 't2', 't3'], CAST(position % 3 + 1 AS BIGINT)) AS template FROM pos", ("items",))
def gen_templates(src):
    placed = G.hash_positions(src.view("items").select("task", "bucket", "item_id"), ("task", "bucket"), _order("item_id"))
    return G.round_robin(placed, ["t1", "t2", "t3"]).drop("position")


@query("gen_topics", SEQ + f""", deck AS (SELECT position // 5 AS cycle, t AS topic, row_number() OVER (PARTITION BY cyc ORDER BY md5(concat('{_SEED}|', cyc, '|', t))) - 1 AS rk, cyc FROM (SELECT DISTINCT position // 5 AS cyc, position // 5 * 5 AS position FROM pos), (SELECT unnest(['optics', 'cells', 'radio', 'enzymes', 'motors']) AS t))
 SELECT p.task, p.item_id, CAST(p.position // 5 AS BIGINT) AS cycle, d.topic FROM pos p JOIN deck d ON d.cyc = p.position // 5 AND d.rk = p.position % 5""", ("items",))
def gen_topics(src):
    placed = G.hash_positions(src.view("items").select("task", "item_id"), ("task",), _order("item_id"))
    return G.deal_topics(placed, ["optics", "cells", "radio", "enzymes", "motors"], _SEED).select("task", "item_id", "cycle", "topic")


@query("gen_items", SEQ + f" SELECT concat(left(task, 2), '-', lpad(CAST(position AS VARCHAR), 7, '0')) AS id, task, bucket, 'synthetic' AS provenance, {_SEED} AS seed, 'v1' AS version FROM seq", ("items",))
def gen_items(src):
    return sequence(src).select(
        F.concat(F.substring("task", 1, 2), F.lit("-"), F.lpad(F.col("position").cast("string"), 7, "0")).alias("id"), "task", "bucket",
        F.lit("synthetic").alias("provenance"), F.lit(_SEED).alias("seed"), F.lit("v1").alias("version"))


def _quota(size, strata):
    return f""", sc AS (SELECT {strata}, count(*) AS c FROM items GROUP BY ALL), sn AS (SELECT *, sum(c) OVER () AS n, {size} * c // sum(c) OVER () AS whole, ({size} * c) % sum(c) OVER () AS rem FROM sc),
 sq AS (SELECT {strata}, whole + CASE WHEN row_number() OVER (ORDER BY rem DESC, {strata}) <= {size} - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM sn),
 smp AS (SELECT item_id FROM (SELECT i.*, quota, row_number() OVER (PARTITION BY {', '.join('i.' + s.strip() for s in strata.split(','))} ORDER BY md5(concat('{_SEED}|', item_id))) AS r FROM items i JOIN sq USING ({strata})) WHERE r <= quota)"""


@query("gen_mark_core", _quota(200, "bucket") + " SELECT item_id, item_id IN (SELECT item_id FROM smp) AS is_core FROM items", ("items",))
def gen_mark_core(src):
    return G.mark_core(src.view("items"), ("bucket",), 200, "item_id", _SEED).select("item_id", "is_core")


@query("gen_stratified_sample", _quota(150, "task, bucket") + " SELECT item_id FROM smp", ("items",))
def gen_stratified_sample(src):
    return G.stratified_sample(src.view("items"), ("task", "bucket"), 150, "item_id", _SEED).select("item_id")


@query("gen_first_per_task", " SELECT task, item_id, CAST(row_number() OVER (PARTITION BY task ORDER BY core DESC, item_id) AS INTEGER) AS rank FROM items QUALIFY rank <= 50", ("items",))
def gen_first_per_task(src):
    return G.first_per_task(src.view("items"), 50).select("task", "item_id", "rank")


@query("gen_split_filter", ", x AS (SELECT *, core AND task <> 'chunk_summarizer' AS c FROM items) SELECT task, item_id FROM x WHERE c OR NOT (SELECT bool_or(y.c) FROM x y WHERE y.task = x.task)", ("items",))
def gen_split_filter(src):
    items = src.view("items").withColumn("core", F.col("core") & (F.col("task") != "chunk_summarizer"))
    return G.split_filter(items, "core").select("task", "item_id")


@query("gen_eligible_pool", " SELECT task, item_id FROM items WHERE task <> 'query_rewriter' OR core", ("items",))
def gen_eligible_pool(src):
    judged = src.view("calls").select("task", F.when(F.col("task") == "query_rewriter", "core").otherwise("all").alias("split"))
    return G.eligible_pool(src.view("items"), judged).select("task", "item_id")


SYS = """, pl AS (SELECT task, item_id, row_number() OVER (PARTITION BY task ORDER BY item_id) - 1 AS p, count(*) OVER (PARTITION BY task) AS n FROM items WHERE NOT core),
 js AS (SELECT task, n, unnest(range(100)) AS j FROM (SELECT DISTINCT task, n FROM pl)),
 pk AS (SELECT DISTINCT pl.task, pl.item_id FROM js JOIN pl ON pl.task = js.task AND pl.p = (7919 % js.n + j * greatest(1, js.n // 100)) % js.n)"""


@query("gen_systematic_sample", SYS + " SELECT * FROM pk", ("items",))
def gen_systematic_sample(src):
    pool = src.view("items").filter("not core").select("task", "item_id")
    return G.systematic_sample(pool, ("task",), "item_id", 100, 7919)


@query("gen_training_rows", SYS + """ SELECT pk.item_id, pk.task, CASE WHEN c.status = 'ok' AND coalesce(trim(coalesce(payload_json, output_text)), '') <> '' THEN coalesce(payload_json, output_text) END AS answer,
  CASE WHEN c.status IS NULL THEN 'not recorded' WHEN c.status <> 'ok' THEN 'the recorded call failed' WHEN coalesce(trim(coalesce(payload_json, output_text)), '') = '' THEN 'nothing to learn from' END AS skipped
 FROM pk LEFT JOIN (SELECT * REPLACE (item_id + CASE WHEN k % 20 = 4 THEN 1000000000000 ELSE 0 END AS item_id) FROM calls WHERE arm = 'candidate') c USING (item_id)""", ("items", "calls"))
def gen_training_rows(src):
    pool = src.view("items").filter("not core").select("task", "item_id")
    sample = G.systematic_sample(pool, ("task",), "item_id", 100, 7919)
    calls = src.view("calls").filter("arm = 'candidate'").withColumn("item_id", F.col("item_id") + F.when(F.col("k") % 20 == 4, 10**12).otherwise(0)).select("item_id", "status", "payload_json", "output_text")
    return G.training_rows(sample, calls)


@query("gen_contamination", " SELECT task, item_id FROM items WHERE item_id % 25 IN (1, 3) AND core", ("items",))
def gen_contamination(src):
    examples = src.view("items").filter("item_id % 25 in (1, 3)").select("task", "item_id")
    return G.contamination(examples, src.view("items").filter("core"))


@query("gen_contract", """, x AS (SELECT *, CASE WHEN item_id % 60 = 7 THEN 'unknown task: tool_caller' WHEN item_id % 70 = 9 THEN 'gold: not JSON' WHEN item_id % 70 = 10 THEN 'gold: not object'
   ELSE nullif(concat_ws('; ', CASE WHEN task = 'query_rewriter' AND item_id % 13 = 0 THEN 'gold.intent: missing' END, CASE WHEN task = 'chunk_summarizer' AND item_id % 70 = 11 THEN 'gold.key_points[0].chunk_ids[1]: not string' END,
    CASE WHEN task = 'feature_extractor' AND item_id % 70 = 12 THEN 'gold.jurisdiction: not string or null' END, CASE WHEN item_id % 70 = 8 THEN 'gold.surplus: unknown key' END), '') END AS g FROM items)
 SELECT item_id, concat_ws('; ', g, CASE WHEN item_id % 40 = 4 THEN 'duplicate rubric id' END, CASE WHEN item_id % 50 = 6 THEN 'duplicate chunk id' END,
  CASE WHEN g IS NULL AND task = 'chunk_summarizer' AND item_id % 30 = 4 THEN 'gold cites an unknown chunk' END,
  CASE WHEN n_rubric + CASE WHEN item_id % 40 = 4 THEN 1 ELSE 0 END NOT BETWEEN 3 AND 5 THEN 'rubric needs three to five criteria' END) AS defects FROM x WHERE defects <> ''""", ("items",))
def gen_contract(src):
    def numbered(prefix, n):
        return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda x: F.concat(F.lit(prefix), x.cast("string")))

    def swapped(old, new):
        return F.replace("gold_json", F.lit(old), F.lit(new))

    i, gold = F.col("item_id"), F.col("gold_json")
    broken = (
        F.when(i % 70 == 8, F.concat(F.lit('{"surplus":1,'), F.substring(gold, 2, 100_000))).when(i % 70 == 9, F.substring(gold, 1, 10)).when(i % 70 == 10, F.concat(F.lit("["), gold, F.lit("]")))
        .when(i % 70 == 11, swapped('["c1"]', '["c1",7]')).when(i % 30 == 4, swapped('["c1"]', '["c9"]')).when(i % 70 == 12, swapped('"jurisdiction":"US"', '"jurisdiction":5')).otherwise(gold))
    items = src.view("items").select(
        "item_id", F.when(i % 60 == 7, "tool_caller").otherwise(F.col("task")).alias("task"), broken.alias("gold"),
        F.when(i % 40 == 4, F.array_append(numbered("r", F.col("n_rubric")), F.lit("r1"))).otherwise(numbered("r", F.col("n_rubric"))).alias("rubric_ids"),
        F.when(i % 50 == 6, F.array_append(numbered("c", F.col("n_chunks")), F.lit("c1"))).otherwise(numbered("c", F.col("n_chunks"))).alias("chunk_ids"))
    return G.contract_defects(items).select("item_id", "defects")


@query("gen_context_chunks", "SELECT conv_id, turn, concat('[c', turn, '] ', text) AS context FROM conversations WHERE role = 'user'")
def gen_context_chunks(src):
    chunk = F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("chunk_id"), F.col("text").alias("text"))
    return src.table("conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(G.context_chunks(F.array(chunk)), "\n").alias("context"))


@query("gen_registry_gaps", ", tp AS (SELECT DISTINCT task, bucket FROM items WHERE NOT (task = 'query_rewriter' AND bucket = 'edge')) SELECT t.task, b.bucket FROM (SELECT DISTINCT task FROM items) t, (SELECT DISTINCT bucket FROM items) b WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.task = t.task AND tp.bucket = b.bucket)", ("items",))
def gen_registry_gaps(src):
    from armparity.plans.study import TASKS

    known = src.view("items").filter("not (task = 'query_rewriter' and bucket = 'edge')").select("task", "bucket").distinct()
    return G.registry_gaps(known, list(TASKS), [b for b, _ in MIX])


@query("gen_duplicate_ids", " SELECT template_id, count(*) AS n FROM (SELECT DISTINCT task, bucket, template_id FROM items) GROUP BY ALL HAVING n > 1", ("items",))
def gen_duplicate_ids(src):
    return G.duplicate_ids(src.view("items").select("task", "bucket", "template_id").distinct())


@query("gen_lineage", """ SELECT task, string_agg(DISTINCT CAST(seed AS VARCHAR), '/' ORDER BY CAST(seed AS VARCHAR)) AS seed, string_agg(DISTINCT generator_version, '/' ORDER BY generator_version) AS generator_version, string_agg(DISTINCT provenance, '/') AS provenance,
  count(DISTINCT seed) > 1 OR count(DISTINCT generator_version) > 1 OR count(DISTINCT provenance) > 1 AS mixed FROM items GROUP BY ALL""", ("items",))
def gen_lineage(src):
    return G.lineage(src.view("items"), ("task",), ("seed", "generator_version", "provenance"))
