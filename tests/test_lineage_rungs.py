"""Rungs with inheritance, the arms of a candidate, fingerprints and a caller's own similarity."""

import difflib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from armparity.operators import agreement as A
from armparity.operators import lineage as LN
from armparity.operators import rungs as RG
from armparity.plans import q_shadow

RUNG = "task string, rung string, parent string, settings map<string,string>"


def _rungs(spark, rows):
    return spark.createDataFrame(rows, RUNG)


def test_settings_are_inherited(spark):
    rows = [("t", "a", None, {"m": "1", "p": "x"}), ("t", "b", "a", {"m": "2"}), ("t", "c", "b", {"q": "y"}), ("t", "d", "a", {}), ("u", "b", None, {"m": "9"})]
    got = {(r.task, r.rung): (r.settings, r.path, r.depth) for r in RG.resolve(_rungs(spark, rows)).collect()}
    assert got == {("t", "a"): ({"m": "1", "p": "x"}, ["a"], 0), ("t", "b"): ({"m": "2", "p": "x"}, ["a", "b"], 1), ("t", "c"): ({"m": "2", "p": "x", "q": "y"}, ["a", "b", "c"], 2),
                   ("t", "d"): ({"m": "1", "p": "x"}, ["a", "d"], 1), ("u", "b"): ({"m": "9"}, ["b"], 0)}
    assert RG.resolve(_rungs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[("t", "a", "b", {}), ("t", "b", "a", {})], [("t", "a", "gone", {})], [("t", "a", "a", {})]])
def test_circles_and_unknown_parents_are_refused(spark, rows):
    with pytest.raises(Exception, match="no root above rung t/a|no root above rung t/b"):
        RG.resolve(_rungs(spark, [*rows, ("t", "root", None, {})])).collect()


def test_registration(spark):
    base = _rungs(spark, [("t", "a", None, {})])
    assert RG.register(base, _rungs(spark, [("t", "b", "a", {"k": "v"})]), ["t"]).count() == 2
    with pytest.raises(Exception, match="unknown task u"):
        RG.register(base, _rungs(spark, [("u", "b", None, {})]), ["t"]).collect()
    with pytest.raises(Exception, match="registered twice: t/a"):
        RG.register(base, _rungs(spark, [("t", "a", None, {})]), ["t"]).collect()


def test_candidate_arms(spark):
    arm = "task string, variant string, n long, point double, recorded_from string, recorded_to string"
    baselines = spark.createDataFrame([("t", "inc", 70, 0.8, "2024-01-03", "2024-01-04"), ("other", "inc", 70, 0.8, "2020", "2030")], arm)
    records = spark.createDataFrame([("t", "v2", 70, 0.9, "2024-01-07", "2024-01-09", "r1", "measured"), ("t", "v2", 0, None, None, None, "r2", "no_recordings")], f"{arm}, rung string, status string")

    def run(task="t", rung="r1", variant="v2", base=baselines):
        return RG.candidate_arms(records, spark.createDataFrame([(task, rung, variant)], "task string, rung string, variant string"), base).orderBy("arm").collect()

    got = run()
    assert [(r.arm, r.variant, r.window_from, r.window_to) for r in got] == [("baseline", "inc", "2024-01-03", "2024-01-09"), ("candidate", "r1 v2", "2024-01-03", "2024-01-09")]
    for args, why in (({"rung": "r9"}, "no such rung"), ({"rung": "r2"}, "never measured"), ({"variant": "v1"}, "another variant ships"), ({"base": baselines.filter("task = 'other'")}, "no baseline arm")):
        with pytest.raises(Exception, match=why):
            run(**args)


def test_fingerprints_add_up_and_know_no_order(spark):
    rows = [("g", i % 7, f"t{i % 5}" if i % 4 else None) for i in range(200)] + [("h", 1, "x"), ("h", 1, "x")]
    df = spark.createDataFrame(rows, "g string, a int, b string")
    whole = sorted(LN.fingerprint(df, ("g",), ["a", "b"]).collect())
    assert sorted(LN.fingerprint(df.repartition(9).orderBy("b"), ("g",), ["a", "b"]).collect()) == whole
    parts = [LN.fingerprint(df.sample(0.4, 3), ("g",), ["a", "b"]), LN.fingerprint(df.exceptAll(df.sample(0.4, 3)), ("g",), ["a", "b"])]
    assert sorted(LN.merge(parts[0].unionByName(parts[1]), ("g",)).collect()) == whole
    # once is not twice, null is not empty, and values do not run into each other
    def one(*held):
        return tuple(LN.fingerprint(spark.createDataFrame([("g", *x) for x in held], "g string, a string, b string"), ("g",), ["a", "b"]).first())

    assert len({one(("x", "y")), one(("x", "y"), ("x", "y")), one(("xy", "")), one(("xy", None)), one(("", "xy")), one(("x", "y"), ("x", "z"))}) == 6


def test_a_scorer_sees_each_pair_of_a_batch_once_and_skips_blanks(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(a, b):
        seen.add(len(a))
        return pd.Series([float(len(x) + len(y)) for x, y in zip(a, b)])

    rows = [(["p", None, " ", "q"], ["r", "s", "t", "u"])] * 50 + [([], []), (["p"], ["r"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    got = [r.s for r in df.select(A.Scorer(score).column(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [[2.0, None, None, 2.0]] * 50 + [[], [2.0]]
    assert seen.value == 2


def test_own_similarity_against_brute_force(spark):
    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    pairs = [("topic 1 systems and methods", "systems of topic 1"), ("a b c", "a b c"), ("a", "b"), ("one two three four", "four three two one")]
    got = q_shadow.aligned_share(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])).tolist()
    assert got == pytest.approx([2 * lcs(a.split(), b.split()) / (len(a.split()) + len(b.split())) for a, b in pairs])
    assert difflib.SequenceMatcher(None, *[p.split() for p in pairs[1]]).ratio() == got[1]
    calls = spark.createDataFrame([("chunk_summarizer", i, arm, f'{{"summary":"{text}","key_points":[]}}') for i, two in enumerate(pairs) for arm, text in zip(("baseline", "candidate"), two)],
                                  "task string, item_id long, arm string, payload_json string")
    items = A.compare_items(calls, "baseline", "candidate", A.Scorer(q_shadow.aligned_share), threshold=0.6).orderBy("item_id").collect()
    for r, s in zip(items, got):
        field = next(f for f in r.fields if f.field == "summary")
        assert field.similarity == pytest.approx(s) and field.agreed == (s >= 0.6)
        assert r.agreed == (s >= 0.6)


def test_rungs_may_be_more_than_a_recursive_query_returns_by_default(spark):
    many = spark.range(1_000_002).select(F.lit("t").alias("task"), F.col("id").cast("string").alias("rung"), F.when(F.col("id") == 1, "0").alias("parent"),
                                         F.create_map(F.lit("m"), F.col("id").cast("string")).alias("settings"))
    found = RG.resolve(many)
    assert found.agg(F.count("*"), F.max("depth")).first() == (1_000_002, 1)
