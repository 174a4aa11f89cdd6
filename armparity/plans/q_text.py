"""Normalisation, similarity and report text."""

from pyspark.sql import functions as F

from armparity.functions import render, text
from armparity.plans.registry import query

_NORM = "replace(replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"
_CODE = "upper(regexp_replace({0}, '\\s+', '', 'g'))"
_TOK = "list_distinct(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'))"


@query("nrm_scalar", f"SELECT p_partkey, {_NORM.format('x')} AS norm FROM (SELECT p_partkey, concat('  ', upper(p_name), chr(9), ' ', p_type, ' ') AS x FROM part)")
def nrm_scalar(src):
    x = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "), "p_type", F.lit(" "))
    return src.table("part").select("p_partkey", text.normalize_scalar(x).alias("norm"))


@query("nrm_code", f"SELECT p_partkey, {_CODE.format('x')} AS code FROM (SELECT p_partkey, concat(lower(p_brand), ' ', p_size, chr(10), '/', lower(p_type)) AS x FROM part)")
def nrm_code(src):
    x = F.concat(F.lower("p_brand"), F.lit(" "), F.col("p_size").cast("string"), F.lit("\n/"), F.lower("p_type"))
    return src.table("part").select("p_partkey", text.normalize_code(x).alias("code"))


@query("nrm_by_kind", rf"""
WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'scalar' WHEN 1 THEN 'code' WHEN 2 THEN 'scalar_set' ELSE 'code_set' END AS kind,
  CASE WHEN p_partkey % 8 < 6 THEN concat(' ', p_name, ' ', p_type) END AS one,
  CASE WHEN p_partkey % 5 = 0 AND p_partkey % 4 > 1 THEN [p_brand, NULL, '', concat(p_type, ' x'), p_brand] END AS many FROM part),
 s AS (SELECT *, CASE WHEN many IS NULL AND one IS NOT NULL THEN [one] ELSE many END AS m FROM f)
SELECT p_partkey, kind, CASE kind WHEN 'scalar' THEN coalesce({_NORM.format('one')}, 'null') WHEN 'code' THEN coalesce({_CODE.format('one')}, 'null')
  WHEN 'scalar_set' THEN coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(m, lambda v: v IS NOT NULL AND v <> ''), lambda v: {_NORM.format('v')}))), '|'), '')
  ELSE coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(m, lambda v: v IS NOT NULL AND v <> ''), lambda v: {_CODE.format('v')}))), '|'), '') END AS norm FROM s""")
def nrm_by_kind(src):
    key = F.col("p_partkey")
    kind = F.when(key % 4 == 0, "scalar").when(key % 4 == 1, "code").when(key % 4 == 2, "scalar_set").otherwise("code_set")
    one = F.when(key % 8 < 6, F.concat(F.lit(" "), "p_name", F.lit(" "), "p_type"))
    many = F.when((key % 5 == 0) & (key % 4 > 1), F.array(
        "p_brand", F.lit(None).cast("string"), F.lit(""), F.concat("p_type", F.lit(" x")), F.col("p_brand")))
    norm = text.normalize_by_kind(F.col("kind"), F.col("one"), F.col("many"))
    return src.table("part").select(key, kind.alias("kind"), one.alias("one"), many.alias("many")).select(
        "p_partkey", "kind", F.array_join(norm, "|", "null").alias("norm"))


@query("nrm_tokens", f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)")
def nrm_tokens(src):
    return src.table("documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("nrm_similarity", f"""
WITH t AS (SELECT conv_id, turn, {_TOK.format('text')} AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0
  ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 9) AS similarity
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def nrm_similarity(src):
    t = src.table("conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return t.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("w2")), 9).alias("similarity"))


@query("nrm_one_line", r"""
WITH f AS (SELECT doc_id, replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '|', '\|') AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS u FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE concat(left(t, 219), '…') END AS cell,
  CASE WHEN length(u) <= 60 THEN u ELSE concat(left(u, 59), '…') END AS short FROM f""")
def nrm_one_line(src):
    return src.table("documents").select(
        "doc_id", text.one_line(F.col("text")).alias("cell"), text.abbreviate(F.col("text")).alias("short"))


@query("nrm_abbreviate_set", """ SELECT item_id, CASE WHEN length(s) <= 60 THEN s ELSE concat(left(s, 59), '…') END AS cell FROM (
  SELECT item_id, concat('{', array_to_string(list_sort(CAST(json_extract(gold_json, '$.cpc_codes') AS VARCHAR[])), ', '), '}') AS s
  FROM items WHERE task = 'feature_extractor')""", ("items",))
def nrm_abbreviate_set(src):
    codes = F.from_json(F.get_json_object("gold_json", "$.cpc_codes"), "array<string>")
    return src.view("items").filter("task = 'feature_extractor'").select("item_id", text.abbreviate_set(codes).alias("cell"))


@query("nrm_error_kind", """ SELECT arm, left(split_part(trim(coalesce(error, 'unknown')), ':', 1), 80) AS kind, count(*) AS n
FROM calls WHERE status = 'error' GROUP BY ALL""", ("calls",))
def nrm_error_kind(src):
    return src.view("calls").filter("status = 'error'").groupBy(
        "arm", text.error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))


@query("nrm_page_form", """
SELECT page_id, md5(f) AS digest, length(f) AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(html),
  '["''`‘’“”\\\\]|&quot;|&#3[49];|&rsquo;|&ldquo;|&rdquo;', '', 'g'), '[-‐-―]|&mdash;|&ndash;', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM pages)""")
def nrm_page_form(src):
    return src.table("pages").select("page_id", text.page_form(F.col("html")).alias("f")).select(
        "page_id", F.md5("f").alias("digest"), F.length("f").cast("long").alias("n"))


@query("nrm_sgt_text", """SELECT event_id, concat(strftime(ts + INTERVAL 8 HOUR, '%-d %b %Y, %-I:%M %p'), ' (SGT)') AS sgt FROM events""")
def nrm_sgt_text(src):
    return src.table("events").select("event_id", text.sgt_text(F.col("ts")).alias("sgt"))


@query("nrm_sgt_window", """ SELECT task, arm, concat('Recorded ', strftime(min(ts) + INTERVAL 8 HOUR, '%-d %b %Y, %-I:%M %p'), ' (SGT) → ',
 strftime(max(ts) + INTERVAL 8 HOUR, '%-d %b %Y, %-I:%M %p'), ' (SGT)') AS shown FROM calls GROUP BY ALL""", ("calls",))
def nrm_sgt_window(src):
    spans = src.view("calls").groupBy("task", "arm").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("task", "arm", text.sgt_window(F.col("a"), F.col("b")).alias("shown"))


@query("nrm_sgt_key", r"""
WITH b AS (SELECT o_orderkey, concat('ran ', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), ' then ', strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S+00:00'),
   ' not 2024-01-01, again ', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')) AS body FROM orders),
 s AS (SELECT DISTINCT o_orderkey, unnest(regexp_extract_all(body, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\+00:00|Z)')) AS stamp FROM b)
SELECT o_orderkey, stamp, concat(strftime(CAST(stamp[:19] AS TIMESTAMP) + INTERVAL 8 HOUR, '%-d %b %Y, %-I:%M %p'), ' (SGT)') AS sgt FROM s""")
def nrm_sgt_key(src):
    zulu = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = F.date_format(F.expr("o_orderdate + interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    body = F.concat(F.lit("ran "), zulu, F.lit(" then "), later, F.lit(" not 2024-01-01, again "), zulu)
    stamps = src.table("orders").select("o_orderkey", F.explode(text.iso_stamps(body)).alias("stamp"))
    return stamps.withColumn("sgt", text.sgt_text(F.to_timestamp(F.substring("stamp", 1, 19), "yyyy-MM-dd'T'HH:mm:ss")))


@query("nrm_estimate_text", """
WITH e AS (SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN 'percentage_points' WHEN 1 THEN 'percent' WHEN 2 THEN 'ms' ELSE 'fraction' END AS unit,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE avg(l_quantity) - 25 END AS point, CASE WHEN count(*) > 1 THEN min(l_quantity) * 31.5 END AS lo, CASE WHEN count(*) > 1 THEN max(l_quantity) / 16 END AS hi
  FROM lineitem GROUP BY l_orderkey),
 t AS (SELECT *, CASE unit WHEN 'percentage_points' THEN '{:+.2f} pp' WHEN 'percent' THEN '{:.1f}%' WHEN 'ms' THEN '{:,.0f} ms' ELSE '{:.3f}' END AS f FROM e)
SELECT l_orderkey, CASE WHEN point IS NULL THEN 'not measured' WHEN lo IS NULL THEN concat(format('{:.3f}', point), ' (no CI, n=1)')
  ELSE concat(CASE WHEN unit = 'ms' THEN concat(CASE WHEN point < 0 AND round_even(point, 0) = 0 THEN '-0' ELSE format('{:,}', CAST(round_even(point, 0) AS BIGINT)) END, ' ms') ELSE format(f, point) END, ' [',
   CASE WHEN unit = 'ms' THEN concat(CASE WHEN lo < 0 AND round_even(lo, 0) = 0 THEN '-0' ELSE format('{:,}', CAST(round_even(lo, 0) AS BIGINT)) END, ' ms') ELSE format(f, lo) END, ', ',
   CASE WHEN unit = 'ms' THEN concat(CASE WHEN hi < 0 AND round_even(hi, 0) = 0 THEN '-0' ELSE format('{:,}', CAST(round_even(hi, 0) AS BIGINT)) END, ' ms') ELSE format(f, hi) END, ']') END AS shown FROM t""")
def nrm_estimate_text(src):
    key = F.col("l_orderkey")
    several = F.count("*") > 1
    e = src.table("lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("a"), F.when(several, F.min("l_quantity") * 31.5).alias("lo"),
        F.when(several, F.max("l_quantity") / 16).alias("hi"))
    unit = F.when(key % 4 == 0, "percentage_points").when(key % 4 == 1, "percent").when(key % 4 == 2, "ms").otherwise("fraction")
    point = F.when(key % 9 != 0, F.col("a") - 25)
    return e.select("l_orderkey", render.estimate_text(point, F.col("lo"), F.col("hi"), unit).alias("shown"))


@query("nrm_fill_template", """ SELECT item_id, CASE WHEN item_id % 13 = 0 THEN NULL WHEN item_id % 7 = 0 THEN NULL
  ELSE concat('Task ', task, ' item ', item_id, ': ', bucket, ' (', task, ')') END AS prompt FROM items""", ("items",))
def nrm_fill_template(src):
    i = F.col("item_id")
    template = F.when(i % 7 == 0, "Task {{task}} of {{owner}}").otherwise("Task {{task}} item {{item}}: {{bucket}} ({{task}})")
    values = {"task": F.col("task"), "item": i, "bucket": F.when(i % 13 != 0, F.col("bucket"))}
    return src.view("items").select("item_id", text.fill_template(template, values).alias("prompt"))


@query("nrm_prompt_view", " SELECT item_id, task, n_chunks, n_rubric FROM items", ("items",))
def nrm_prompt_view(src):
    """What a prompt may see: never the gold answer."""
    return src.view("items").select("item_id", "task", "n_chunks", "n_rubric")


@query("gen_surface_guard", r"""
WITH d AS (SELECT o_orderkey AS id, concat('heat to ', o_custkey, ' °C for 2.5 h, order ', o_orderkey) AS a,
   concat('warm to ', CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END, CASE WHEN o_orderkey % 7 = 0 THEN ' C' ELSE ' °C' END, ' for 2.5 h',
     CASE WHEN o_orderkey % 11 = 0 THEN ' (as claimed)' ELSE '' END, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(', Order ', o_orderkey) END, CASE WHEN o_orderkey % 17 = 0 THEN ' ±' ELSE '' END) AS b FROM orders),
 q AS (SELECT *, list_sort(list_distinct(regexp_extract_all(a, '[0-9]+(?:[.,][0-9]+)*(?:[eE]-?[0-9]+)?'))) AS qa, list_sort(list_distinct(regexp_extract_all(b, '[0-9]+(?:[.,][0-9]+)*(?:[eE]-?[0-9]+)?'))) AS qb,
   regexp_extract_all(a, '[µμ°²³⁻Ωωπ±×Å]') AS ua, regexp_extract_all(b, '[µμ°²³⁻Ωωπ±×Å]') AS ub FROM d),
 w AS (SELECT *, list_filter(qa, lambda x: NOT list_contains(qb, x)) AS lost, list_filter(qb, lambda x: NOT list_contains(qa, x)) AS gained,
   list_filter(ua, lambda x: NOT list_contains(ub, x)) AS ulost, list_filter(ub, lambda x: NOT list_contains(ua, x)) AS ugained FROM q)
SELECT id, CASE WHEN NOT contains(lower(b), lower(concat('order ', id))) THEN concat('lost word: order ', id)
  WHEN regexp_matches(b, '\(as [a-z]+\)') THEN concat('not allowed: ', regexp_extract(b, '\(as [a-z]+\)'))
  WHEN len(lost) > 0 THEN concat('lost number: ', lost[1]) WHEN len(gained) > 0 THEN concat('new number: ', gained[1])
  WHEN len(ulost) > 0 THEN concat('lost unit sign: ', ulost[1]) WHEN len(ugained) > 0 THEN concat('new unit sign: ', ugained[1]) END AS violation FROM w""")
def gen_surface_guard(src):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    a = F.concat(F.lit("heat to "), cust.cast("string"), F.lit(" °C for 2.5 h, order "), key.cast("string"))
    b = F.concat(
        F.lit("warm to "), F.when(key % 5 == 0, cust + 1).otherwise(cust).cast("string"),
        F.when(key % 7 == 0, " C").otherwise(" °C"), F.lit(" for 2.5 h"), F.when(key % 11 == 0, " (as claimed)").otherwise(""),
        F.when(key % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(", Order "), key.cast("string"))), F.when(key % 17 == 0, " ±").otherwise(""))
    keep = F.array(F.concat(F.lit("order "), F.col("id").cast("string")))
    rows = src.table("orders").select(key.alias("id"), a.alias("a"), b.alias("b"))
    return rows.select("id", text.surface_violation(F.col("b"), F.col("a"), keep, [r"\(as [a-z]+\)"]).alias("violation"))
