"""Percentile intervals by order statistics against redrawn samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from armparity.operators import bootstrap as B
from armparity.operators import order_statistics as OS
from armparity.operators import ranking as R

RNG = np.random.default_rng(11)
SAMPLES = {
    "whole": RNG.integers(100, 900, 500).astype(float), "continuous": RNG.lognormal(3, 1.5, 700), "tied": RNG.integers(0, 3, 400).astype(float),
    "hot": np.concatenate([np.full(3000, 7.0), RNG.normal(7, 1, 200)]), "few": np.array([3.0, 9.0, 4.0, 11.0, 5.0]), "two": np.array([1.0, 2.0]), "one": np.array([4.0]),
}


def counts(spark, parts=4):
    rows = [(g, float(v)) for g, x in SAMPLES.items() for v in x] + [(None, float(v)) for v in SAMPLES["few"]]
    return R.value_counts(spark.createDataFrame(rows, "g string, v double").repartition(parts), ("g",), "v")


@pytest.mark.parametrize("q", [0.5, 0.95])
def test_bounds_agree_with_redrawn_samples(spark, q):
    got = {r.g: r for r in B.interval(OS.percentile_replicates(counts(spark), ("g",), "v", q, 8000, buckets=8), ("g",), F.col("stat")).collect()}
    assert set(got) == {*SAMPLES, None}
    for g, x in SAMPLES.items():
        r = got[g]
        assert r.n == len(x) and r.point == pytest.approx(np.percentile(x, 100 * q)) and r.resamples == 8000
        if len(x) < 2:
            assert r.lo is None and r.hi is None
            continue
        stats = np.percentile(x[RNG.integers(0, len(x), (8000, len(x)))], 100 * q, axis=1)
        # a bound may fall a step of the sample's own order to either side
        for bound, p in ((r.lo, 2.5), (r.hi, 97.5)):
            near = np.percentile(stats, [max(0, p - 0.8), min(100, p + 0.8)])
            assert near[0] - 1e-9 <= bound <= near[1] + 1e-9, (g, bound, near)
    assert (got[None].lo, got[None].hi) == pytest.approx((got["few"].lo, got["few"].hi), abs=2)


def test_values_at_ranks(spark):
    ranks = spark.createDataFrame([(g, r) for g, x in SAMPLES.items() for r in {0, len(x) // 3, len(x) - 1}], "g string, rank long")
    for buckets, rounds in ((64, 2), (3, 3), (1, 1)):
        for r in OS.values_at(counts(spark), ranks, ("g",), "v", buckets, rounds).collect():
            assert r.v == np.sort(SAMPLES[r.g])[r["rank"]]
    with pytest.raises(Exception, match="beyond its bucket"):
        OS.values_at(counts(spark), spark.createDataFrame([("few", 5)], "g string, rank long"), ("g",), "v").collect()


def test_draws_do_not_depend_on_partitioning_and_nothing_gives_nothing(spark):
    got = {tuple(sorted(map(tuple, OS.percentile_replicates(counts(spark, parts).filter("g = 'hot'"), ("g",), "v", 0.9, 300).collect()))) for parts in (1, 7)}
    assert len(got) == 1
    assert OS.percentile_replicates(counts(spark).limit(0), ("g",), "v", 0.9, 300).count() == 0


def test_ranks_follow_the_law_of_the_order_statistic():
    low, high = OS.draw_ranks(40, 0.95, 60_000, np.random.default_rng(1))
    redrawn = np.sort(np.random.default_rng(2).integers(0, 40, (60_000, 40)), axis=1)[:, 37:39]
    for drawn, direct in zip((low, high), redrawn.T):
        assert np.abs(np.bincount(drawn, minlength=40) - np.bincount(direct, minlength=40)).max() < 0.012 * 60_000
    assert (low <= high).all() and np.corrcoef(low, high)[0, 1] == pytest.approx(np.corrcoef(*redrawn.T)[0, 1], abs=0.02)


def test_no_task_holds_a_group(spark):
    """A plan without Python over value rows, and a large group that falls into many buckets."""
    df = spark.range(200_000).select(F.when(F.col("id") >= 0, "g").otherwise("h").alias("g"), (F.col("id") * 1.5).alias("v"))
    out = OS.percentile_replicates(R.value_counts(df, ("g",), "v"), ("g",), "v", 0.95, 200)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan
    cells = R.value_counts(df, ("g",), "v").groupBy("g").agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 640).alias("c"))
    sizes = df.join(cells, "g").groupBy(OS._place(F.col("c"), F.col("v")).alias("b")).count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) < 1.6 * 200_000 / 64
    assert B.interval(out, ("g",), F.col("stat")).first().point == pytest.approx(np.percentile(np.arange(200_000) * 1.5, 95))


def test_a_hot_group_meets_its_bracket_in_many_parts(spark):
    from armparity.operators import ranking as R

    # nine tenths of the rows are of one group, many of one value
    rows = spark.range(50_000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 0.5).alias("x"))
    out = R.exact_percentiles(rows, ("g",), "x", {"p50": 0.5, "p95": 0.95})
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and all("_salt" in line for line in joins)
    want = {r.g: (r.p50, r.p95) for r in rows.groupBy("g").agg(F.expr("percentile(x, 0.5)").alias("p50"), F.expr("percentile(x, 0.95)").alias("p95")).collect()}
    assert {r.g: (r.p50, r.p95) for r in out.collect()} == want
