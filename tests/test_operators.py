"""Hand-computed cases and properties of the operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from armparity import schemas
from armparity.functions import keys, payload as P, render, text
from armparity.operators import agreement as A
from armparity.operators import bootstrap as B
from armparity.operators import crosscheck as X
from armparity.operators import gates as G
from armparity.operators import metrics as M
from armparity.operators import ranking as R
from armparity.operators import retrieval as RT
from armparity.operators import sampling as SM
from armparity.operators import stats as S
from armparity.sources import jsonl


def one(spark, *cols, row=None):
    base = spark.range(1) if row is None else spark.createDataFrame([row])
    return base.select(*cols).first()


@pytest.mark.parametrize("left,right,expected", [
    ("", "", 1.0), ("a b", "", 0.0), ("Solid state", "solid STATE", 1.0), ("a b c", "b c d", 0.5)])
def test_similarity(spark, left, right, expected):
    assert one(spark, text.lexical_similarity(F.lit(left), F.lit(right)))[0] == pytest.approx(expected)


def test_normal_forms_keep_null_apart(spark):
    r = one(spark, text.normalize_scalar(F.lit("  Straße \t X ")), text.normalize_scalar(F.lit(None).cast("string")),
            text.normalize_code(F.lit("h01m 10/052")))
    assert r[0] == "strasse x" and r[1] is None and r[2] == "H01M10/052"


def test_input_sha_escapes_like_ascii_json(spark):
    import hashlib

    msg = "naïve Ω 😀 \"q\" \n end"
    want = {"system_prompt_sha": "p", "messages": [msg], "context_chunks": [], "tools_offered": ["a", "b"]}
    digest = hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    got = one(spark, keys.input_sha(F.lit("p"), F.array(F.lit(msg)), F.array().cast("array<string>"), F.array(F.lit("b"), F.lit("a"))))[0]
    assert got == digest


def prf(spark, gold, predicted):
    sets = F.struct(F.array(*[F.lit(x) for x in gold]).cast("array<string>").alias("gold"), F.array(*[F.lit(x) for x in predicted]).cast("array<string>").alias("predicted"))
    row = spark.range(1).select(sets.alias("s")).select(M.filter_counts(F.col("s")).alias("c")).select(*[o["value"] for o in M.filter_prf(F.col("c"))]).first()
    return tuple(row)


def test_filter_shares(spark):
    # five of nine stated filters are asserted, and two that nobody stated
    p, r, f1 = prf(spark, list("abcdefghi"), ["a", "c", "e", "g", "i", "u", "v"])
    assert (p, r) == (pytest.approx(5 / 7), pytest.approx(5 / 9)) and f1 == pytest.approx(10 / 16)


def test_undefined_is_not_zero(spark):
    assert prf(spark, ["a"], []) == (None, 0.0, None)
    assert prf(spark, [], []) == (None, None, None)
    assert prf(spark, ["a"], ["b"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("task,doc,valid", [
    ("query_rewriter", '{"query":"q","intent":"prior_art"}', True),
    ("query_rewriter", '{"query":"q","intent":"prior_art","filters":{"assignees":["a",null]}}', False),
    ("query_rewriter", '{"query":"q","intent":"prior_art","filters":null}', False),
    ("query_rewriter", '{"query":"q","intent":"prior_art","extra":1}', False),
    ("query_rewriter", '{"query":1,"intent":"prior_art"}', False),
    ("chunk_summarizer", '{"summary":"s","key_points":[]}', True),
    ("chunk_summarizer", '{"summary":"s","key_points":[{"text":"t","chunk_ids":["c1"]},{"text":"u"}]}', False),
    ("chunk_summarizer", '{"summary":"s","key_points":[{"text":"t","chunk_ids":[]}]}', True),
    ("feature_extractor", "{}", True),
    ("feature_extractor", '{"independent_claim_count":"3"}', True),
    ("feature_extractor", '{"independent_claim_count":3.0}', True),
    ("feature_extractor", '{"independent_claim_count":3.5}', False),
    ("feature_extractor", '{"title":null,"cpc_codes":["x"]}', True),
    ("feature_extractor", '{"cpc_codes":null}', False),
])
def test_schema_rules(spark, task, doc, valid):
    df = spark.createDataFrame([(task, doc)], "task string, j string").withColumn("s", P.shape(F.col("j"))).withColumn("p", P.answer(F.col("j"), F.col("s")))
    assert df.select(P.schema_valid(F.col("task"), F.col("p"), F.col("s"))).first()[0] is valid


def test_rendering_follows_binary_half_even(spark):
    r = one(spark, render.estimate_text(F.lit(0.0625), F.lit(0.5), F.lit(1.0), F.lit("fraction")), render.number_text(F.lit(-2.5), F.lit("percentage_points")),
            render.estimate_text(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit("ms")), render.number_text(F.lit(7388.4), F.lit("ms")))
    assert list(r) == ["0.062 [0.500, 1.000]", "-2.50 pp", "not measured", "7,388 ms"]


# --- intervals -------------------------------------------------------------------------

def sample(spark, values):
    return spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "g string, item_id long, value double")


@pytest.mark.parametrize("method,values,expected", [
    ("histogram", [2, 6], (4.0, 2.0, 6.0)), ("histogram", [3] * 7, (3.0, 3.0, 3.0)), ("hash", [1] * 9, (1.0, 1.0, 1.0))])
def test_interval_goldens(spark, method, values, expected):
    r = S.mean_estimate(sample(spark, values), ("g",), resamples=2000, method=method).first()
    assert (r.point, r.lo, r.hi) == expected and r.n == len(values)


def test_one_observation_has_no_interval(spark):
    r = S.mean_estimate(sample(spark, [1.0]), ("g",), resamples=200).first()
    assert r.point == 1.0 and r.lo is None and r.hi is None


def test_intervals_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    base, cand = rng.integers(0, 5, 400) / 4, rng.integers(0, 5, 400) / 4
    d = (cand - base)[rng.integers(0, 400, (10000, 400))].mean(axis=1)
    lo, hi = np.percentile(d, [2.5, 97.5])
    pairs = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(base, cand))], "g string, item_id long, base double, cand double")
    for method, n, cells in (("histogram", 10000, 2048), ("hash", 1000, None), ("histogram", 4000, 3)):
        reps = (B.hash_replicates(pairs, ("g",), "item_id", ("base", "cand"), n) if method == "hash"
                else B.histogram_replicates(pairs, ("g",), ("base", "cand"), n, cells=cells))
        r = B.estimate(reps, ("g",), B.delta_stat("base", "cand")).first()
        assert r.point == pytest.approx((cand - base).mean(), abs=1e-12) and r.n == 400
        assert r.lo == pytest.approx(lo, abs=0.008) and r.hi == pytest.approx(hi, abs=0.008), method


def test_intervals_do_not_depend_on_partitioning(spark):
    df = sample(spark, np.random.default_rng(2).integers(0, 7, 300))
    for method in ("hash", "histogram"):
        got = {tuple(S.mean_estimate(df.repartition(n), ("g",), resamples=200, method=method).select("point", "lo", "hi").first()) for n in (1, 4, 17)}
        rounded = {tuple(round(v, 10) for v in t) for t in got}
        assert len(rounded) == 1


def test_duplicate_items_are_refused(spark):
    rows = spark.createDataFrame([("t", "baseline", 1, 1.0), ("t", "baseline", 1, 0.0)], "task string, arm string, item_id long, value double")
    with pytest.raises(Exception, match="duplicate item"):
        S.pair_samples(rows, ("task",)).collect()


def test_kappa(spark):
    rows = [(True, True)] * 9 + [(False, False)] * 4 + [(True, False)] * 3 + [(False, True)] * 4
    df = spark.createDataFrame([("x", *r) for r in rows] + [("y", False, False)] * 12, "g string, a boolean, b boolean")
    got = {r.g: r for r in S.kappa(df, ("g",), F.col("a"), F.col("b")).collect()}
    assert got["x"].kappa == pytest.approx((13 / 20 - (12 * 13 + 8 * 7) / 400) / (1 - (12 * 13 + 8 * 7) / 400))
    assert got["y"].kappa is None and "undefined" in got["y"].kappa_note


def test_every_replicate_of_a_small_group_counts(spark):
    r = S.mean_estimate(sample(spark, [2, 6]), ("g",), resamples=500).first()
    assert r.resamples == 500


def test_exact_percentiles_of_small_groups_and_ties(spark):
    rng = np.random.default_rng(6)
    groups = {f"{n}{kind}": rng.normal(size=n) if kind == "a" else rng.integers(0, 3, n).astype(float) for n in (1, 2, 3, 10, 100, 2000) for kind in "ab"}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double")
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}
    for r in R.exact_percentiles(df, ("g",), "v", qs).collect():
        assert [r[k] for k in qs] == pytest.approx([np.quantile(groups[r.g], q) for q in qs.values()])


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_exact_percentiles_on_a_skewed_group(spark, parts):
    x = np.concatenate([np.full(5000, 7.0), np.random.default_rng(5).lognormal(3, 2, 3000)])
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double").repartition(parts)
    r = R.exact_percentiles(df, ("g",), "v", {"a": 0.5, "b": 0.95, "c": 0.999}).first()
    assert [r.a, r.b, r.c] == pytest.approx(list(np.percentile(x, [50, 95, 99.9])))


# --- sampling, retrieval ------------------------------------------------------------------

def test_stratified_sample_is_exact_and_proportional(spark):
    df = spark.range(1000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    for size in (0, 1, 100, 1000, 2000):
        got = SM.stratified_sample(df.repartition(5), ("s",), size, "item_id", 7)
        assert got.count() == min(size, 1000)
    counts = {r.s: r["count"] for r in SM.stratified_sample(df, ("s",), 100, "item_id", 7).groupBy("s").count().collect()}
    assert counts == {"a": 33, "b": 67}


def test_positions_are_dense(spark):
    df = spark.range(0, 5000, 3).select(F.lit("g").alias("g"), F.col("id").alias("o"))
    rows = R.positions(df.repartition(7), ("g",), "o", buckets=16).orderBy("o").select("position", "group_size").collect()
    assert [r.position for r in rows] == list(range(len(rows))) and rows[0].group_size == len(rows)


def test_best_document_matches_brute_force_at_any_rarity(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 12), p=np.arange(30, 0, -1) / 465))) for i in range(200)]
    queries = [(i, " ".join(rng.choice(words, 6))) for i in range(40)] + [(99, "nothing shared")]
    want = {}
    for q, t in queries:
        scores = [(len(set(t.split()) & set(d.split())), -i) for i, d in docs]
        best = max(scores)
        if best[0]:
            want[q] = (-best[1], best[0])
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    for limit in (0, 3, 20, 1000):
        assert {r.query_id: (r.doc_id, r.overlap) for r in RT.best_documents(q, d, limit).collect()} == want, limit


# --- gates ------------------------------------------------------------------------------------

GATES = [("quality_delta_pp", "min", "-2.0", "percentage_points", None, "quality"), ("json_schema_validity", "min", "0.99", "fraction", None, "blocking"),
         ("groundedness_delta_pp", "min", "-1.0", "percentage_points", None, "quality"), ("shadow_agreement", "min", "0.90", "fraction", "clause", "blocking"),
         ("cost_savings_pct", "min", "30", "percent", None, "other"), ("latency_p95", "max", "baseline_p95", "ms", None, "other")]
VERDICTS = [("MIGRATE", "all_pass", "fine"), ("TUNE_FIRST", "only_quality_gates_fail", "close"), ("HOLD", "any_blocking_gate_fails", "broken")]
GOOD = {"quality_delta_pp": (-1.0, 1.0, "percentage_points"), "json_schema_validity": (0.995, 1.0, "fraction"), "groundedness_delta_pp": (0.0, 0.0, "percentage_points"),
        "shadow_agreement": (0.95, 0.99, "fraction"), "cost_savings_pct": (40.0, 50.0, "percent"), "latency_p95": (100.0, 900.0, "ms")}


def decide(spark, wins=(5, 3), extra=(), **changes):
    est = {k: v for k, v in {**GOOD, **changes}.items() if v is not None}
    gates = spark.createDataFrame([*GATES, *extra], "gate string, direction string, bound string, unit string, alt string, role string")
    rows = spark.createDataFrame([("t", g, 10, (lo + hi) / 2, lo, hi, u) for g, (lo, hi, u) in est.items()], "task string, gate string, n long, point double, lo double, hi double, unit string")
    segments = spark.createDataFrame([("t",)], "task string")
    sentinels = spark.createDataFrame([("t", "baseline_p95", 1000.0)], "task string, sentinel string, value double")
    ok = None if wins is None else wins[0] >= wins[1]
    triage = spark.createDataFrame([("t", *(wins or (0, 0)), ok)], "task string, wins long, losses long, wins_ge_losses boolean")
    checks = G.check_gates(G.build_evidence(segments, rows, gates), gates, sentinels)
    return G.decide(segments, G.apply_alternatives(checks, triage), gates, spark.createDataFrame(VERDICTS, "verdict string, rule string, description string")).first()


def test_verdicts(spark):
    bad_agreement = {"shadow_agreement": (0.5, 0.7, "fraction")}
    assert decide(spark).verdict == "MIGRATE"
    assert decide(spark, quality_delta_pp=(-3.0, 1.0, "percentage_points")).verdict == "TUNE_FIRST"
    assert decide(spark, cost_savings_pct=(10.0, 20.0, "percent")).verdict == "UNDETERMINED"
    missing = decide(spark, latency_p95=None)
    assert (missing.verdict, missing.provisional, missing.missing) == ("INCOMPLETE", "MIGRATE", "latency_p95")
    assert decide(spark, latency_p95=None, json_schema_validity=(0.5, 0.6, "fraction")).verdict == "HOLD"
    carried = decide(spark, **bad_agreement)
    assert (carried.verdict, carried.passed_by_alt) == ("MIGRATE", "shadow_agreement")
    assert decide(spark, wins=(1, 2), **bad_agreement).verdict == "HOLD"
    assert decide(spark, wins=None, **bad_agreement).verdict == "HOLD"


def test_gates_and_rules_come_from_the_tables(spark):
    extra = [("error_rate", "max", "0.1", "fraction", None, "blocking")]
    failed = decide(spark, extra=extra, error_rate=(0.2, 0.3, "fraction"))
    assert (failed.verdict, failed.failed) == ("HOLD", "error_rate") and "error_rate" in failed.rationale
    unmeasured = decide(spark, extra=extra)
    assert (unmeasured.verdict, unmeasured.missing) == ("INCOMPLETE", "error_rate")
    with pytest.raises(Exception, match="undeclared gate"):
        decide(spark, error_rate=(0.2, 0.3, "fraction"))
    with pytest.raises(ValueError, match="more than once"):
        decide(spark, extra=[GATES[0]])
    names = "verdict string, rule string, description string"
    with pytest.raises(ValueError, match="without a verdict"):
        G.verdict_names(spark.createDataFrame(VERDICTS[:2], names))
    with pytest.raises(ValueError, match="more than once"):
        G.verdict_names(spark.createDataFrame([*VERDICTS, ("GO", "all_pass", "")], names))


def test_lines_are_read_strictly_and_keep_nulls(spark):
    good = '{"trace_id":"a","subagent":"t","model":"m","status":"ok","usage":{"input_tokens":1},"error":null}'
    bad = [good.replace('"input_tokens":1', '"input_tokens":1,"extra":2'), good.replace('"ok"', '"weird"'), good.replace('"trace_id":"a",', ""), "{"]
    lines = spark.createDataFrame([(x,) for x in [good, *bad]], "line string")
    got = [r.reject for r in jsonl.parse_strict(lines, schemas.CALL, schemas.CALL_REQUIRED, schemas.CALL_ALLOWED).select("reject").collect()]
    assert got == [None, "unknown keys: usage.extra", "not a status: weird", "missing: trace_id", "not a valid record"]
    one_null = spark.createDataFrame([(1, None)], "b long, a string")
    assert one_null.select(jsonl.canonical(one_null)).first()[0] == '{"a":null,"b":1}'


def test_a_core_larger_than_the_items_is_refused(spark):
    items = spark.createDataFrame([("t", 1), ("t", 2)], "task string, item_id long")
    with pytest.raises(ValueError, match="cannot be taken"):
        SM.mark_core(items, ("task",), 3, "item_id", 1)


def test_repeated_calls_of_an_item_are_refused(spark):
    row = ("feature_extractor", 1, "baseline", '{"title":"x"}')
    calls = spark.createDataFrame([row, row, ("feature_extractor", 1, "candidate", '{"title":"x"}')], "task string, item_id long, arm string, payload_json string")
    with pytest.raises(Exception, match="more than once"):
        A.compare_items(calls, "baseline", "candidate").collect()


def test_units_must_match(spark):
    with pytest.raises(Exception, match="unit mismatch"):
        decide(spark, quality_delta_pp=(0.9, 0.98, "fraction"))


def test_guards(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="same arm"):
        A.compare_items(df, "baseline", "baseline")
    with pytest.raises(ValueError, match="check itself"):
        X.pair_cells(df, "gated", "gated")


def test_replicates_of_many_values_cost_no_more_rows_than_blocks(spark):
    """A value goes to Python once, with its block, and not once per chunk of replicates; both ways of drawing have one law."""
    import numpy as np

    pairs = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 97 + F.col("id") / 5000).alias("base"), (F.col("id") % 89 + 0.0).alias("cand"))
    reps = B.histogram_replicates(pairs, ("g",), ("base", "cand"), 2000, cells=512)
    assert "explode(sequence(-1" not in reps._jdf.queryExecution().toString()
    got = reps.filter("replicate >= 0").toPandas()
    want = pairs.agg(F.stddev_pop("base"), F.stddev_pop("cand"), F.corr("base", "cand"), F.sum("base")).first()
    assert len(got) == 2000 and (got.sw == 5000).all()
    assert abs(got.s_base.std() / (want[0] * 5000 ** 0.5) - 1) < 0.08 and abs(got.s_cand.std() / (want[1] * 5000 ** 0.5) - 1) < 0.08
    assert abs(got.s_base.mean() - want[3]) < 4 * want[0] * 5000 ** 0.5 / 2000 ** 0.5
    rng, c, x = np.random.default_rng(3), np.array([3, 1, 2]), np.array([[1.0], [10.0], [100.0]])
    few, many = B._redrawn(rng, np.array([0, 4, 0, 2, 0]), c, x), B._redrawn(rng, np.full(4000, 200), c, x)
    assert few[[0, 2, 4]].sum() == 0 and (few[[1, 3]] > 0).all()
    assert abs(many.mean() / 200 / (c @ x[:, 0] / 6) - 1) < 0.01
