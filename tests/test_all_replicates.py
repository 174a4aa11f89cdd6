"""Many hash-drawn replicates against the same draws made in plain Python, and the gate query that draws all of them."""

import hashlib
import re

import numpy as np
import pytest

from armparity.operators import bootstrap as B
from armparity.operators.gates import GROUNDEDNESS
from armparity.plans import q_gates
from armparity.plans.catalog import ORACLES
from armparity.plans.registry import Source

SEED, STEPS = 20260801, np.array(B.POISSON_STEPS)


def _drawn(keys, resamples):
    """Weights by key and replicate; SQL's concat reads a null as the empty text."""
    texts = [b"".join(hashlib.md5(f"{SEED}|{b}|{'' if k is None else k}".encode()).digest() for b in range(-(-resamples // 8))) for k in keys]
    return np.searchsorted(STEPS, np.frombuffer(b"".join(texts), ">u2"), side="right").reshape(len(keys), -1)[:, :resamples]


def test_weights_are_md5s_of_any_text():
    keys = ["", "7", "x" * 39, "y" * 41, "z" * 44, "w" * 300, "é|ß", *map(str, range(995, 1080))]
    assert (B._weights(keys, 10_000, SEED) == _drawn(keys, 10_000)).all()
    assert (B._weights(keys, 13, SEED, 96) == _drawn(keys, 120)[:, 96:109]).all()


def test_many_weighted_sums(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i % 17 == 0 else i // 2, None if i % 7 == 0 else i / 4) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(3)
    got = {(r.g, r.replicate): r for r in B.hash_replicates(df, ("g",), "id", ("x",), 1003).collect()}
    for g in {r[0] for r in rows}:
        mine = [(k, x) for name, k, x in rows if name == g and x is not None]
        w, x = _drawn([k for k, _ in mine], 1003), np.array([x for _, x in mine])
        for replicate in (-1, 0, 500, 1002):
            weight = np.ones(len(x)) if replicate < 0 else w[:, replicate]
            assert got[g, replicate].sw == weight.sum() and got[g, replicate].s_x == pytest.approx(weight @ x)
        assert got[g, -1].dropped == sum(name == g and x is None for name, _, x in rows)
    assert len(got) == 4 * 1004


VALUES = {"spread": lambda i: (i, i * i % 9973 - 4000), "hot": lambda i: (i, 3000 if i % 9 == 0 else i % 40), "one": lambda i: (i, 5),
          "shared_keys": lambda i: (i % 6, i * 31 % 977), "null_keys": lambda i: (None if i % 2 else i, i * 31 % 977), "few": lambda i: (i, i) if i < 2 else (i, None)}


@pytest.mark.parametrize("q", [0.95, 0.5, 1.0])
def test_many_weighted_percentiles(spark, q):
    """Far spread, hot and equal values, keys that many rows share, null groups and a group that some replicates miss."""
    rows = [(None if g == "spread" else g, *make(i)) for g, make in VALUES.items() for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, id long, x long").repartition(3)
    got = {}
    for r in B.hash_percentile_replicates(df, ("g",), "id", "x", q, 2500).collect():
        got.setdefault(r.g, {})[r.replicate] = (r.stat, r.n)
    for g in VALUES:
        g = None if g == "spread" else g
        mine = sorted(((x, k) for name, k, x in rows if name == g and x is not None), key=lambda p: p[0])
        x, w = np.array([v for v, _ in mine]), _drawn([k for _, k in mine], 2500)
        want = {-1: (np.quantile(x, q), len(x))}
        for r in range(2500):
            if w[:, r].any():
                want[r] = (np.quantile(np.repeat(x, w[:, r]), q), w[:, r].sum())
        assert set(got[g]) == set(want)
        for r, (stat, n) in want.items():
            assert got[g][r][0] == pytest.approx(stat, abs=1e-9) and got[g][r][1] == n


def test_alternatives_are_checked_on_all_replicates(spark, monkeypatch):
    """Every statistic behind ``gate_alternatives`` is drawn 10,000 times, and by its SQL as often."""
    asked = []
    for module, name in ((B, "hash_replicates"), (B, "hash_percentile_replicates")):
        real = getattr(module, name)

        def noted(*args, _real=real, _name=name, **kwargs):
            asked.append((_name, args[4] if _name == "hash_replicates" else args[5]))
            return _real(*args, **kwargs)

        monkeypatch.setattr(module, name, noted)
    src = Source(spark, "/root/testdata/sf0.001")
    q_gates.gate_alternatives(src)
    assert {n for n, _ in asked} == {"hash_replicates", "hash_percentile_replicates"} and {size for _, size in asked} == {10_000}
    assert set(re.findall(r"unnest\(range\((\d+)\)\) AS b\)", ORACLES["gate_alternatives"])) == {"1250"}
    got = {(r.task, r.gate) for r in src.once(q_gates.all_hashed_checks).collect()}
    assert {g for _, g in got} >= {"cost_savings_pct", "latency_p95", "shadow_agreement"} and {t for t, g in got if g == "groundedness_delta_pp"} == set(GROUNDEDNESS)
