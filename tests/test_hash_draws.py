"""Hash-drawn replicates against the same draws made in plain Python."""

import hashlib

import pytest

from armparity.operators import bootstrap as B

SEED = 20260801


def _weight(key, r):
    # SQL's concat reads a null as the empty text
    text = hashlib.md5(f"{SEED}|{r // 8}|{'' if key is None else key}".encode()).hexdigest()
    return sum(int(text[4 * (r % 8): 4 * (r % 8) + 4], 16) >= step for step in B.POISSON_STEPS)


def test_weighted_sums(spark):
    """Null keys and groups, unusable rows and groups, and more groups than a task holds at once."""
    rows = [(None if i % 5 == 0 else f"g{i % 90}", None if i % 17 == 0 else i, None if i % 7 == 0 else i / 4) for i in range(700)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(3)
    got = {(r.g, r.replicate): r for r in B.hash_replicates(df, ("g",), "id", ("x",), 12).collect()}
    assert ("none", 0) not in got and (got["none", -1].sw, got["none", -1].s_x, got["none", -1].dropped) == (0, None, 1)
    for g in {r[0] for r in rows} - {"none"}:
        mine = [(k, x) for name, k, x in rows if name == g]
        for replicate in range(-1, 12):
            drawn = [(1 if replicate < 0 else _weight(k, replicate), x) for k, x in mine if x is not None]
            r = got[g, replicate]
            assert r.sw == sum(w for w, _ in drawn) and r.s_x == pytest.approx(sum(w * x for w, x in drawn))
            assert r.dropped == (sum(x is None for _, x in mine) if replicate < 0 else 0)


def test_weighted_percentiles(spark):
    rows = [("a" if i % 3 else None, None if i % 17 == 0 else i, i * i % 31) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, x long").repartition(3)
    for r in B.hash_percentile_replicates(df, ("g",), "id", "x", 0.95, 10).collect():
        drawn = sorted(x for g, k, x in rows if g == r.g for _ in range(1 if r.replicate < 0 else _weight(k, r.replicate)))
        at = 0.95 * (len(drawn) - 1)
        low = drawn[int(at)]
        assert r.n == len(drawn) and r.stat == pytest.approx(low + (at - int(at)) * (drawn[min(int(at) + 1, len(drawn) - 1)] - low))
