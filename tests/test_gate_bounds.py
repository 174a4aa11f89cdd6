"""The bounds that gates read, against samples redrawn with NumPy."""

import numpy as np
import pytest

from armparity.operators import economics as E
from armparity.plans import q_gates
from armparity.plans.registry import Source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def src(spark):
    return Source(spark, SF)


def _near(bound, stats, p):
    low, high = np.percentile(stats, [max(0, p - 0.9), min(100, p + 0.9)])
    assert low - 1e-9 <= bound <= high + 1e-9, (bound, low, high)


def test_drawn_bounds(src):
    rng = np.random.default_rng(3)
    got = {(r.task, r.gate): r for r in q_gates.gate_evidence_drawn(src).collect()}
    samples = {}
    for r in q_gates.mean_gates(src).filter("base is not null and cand is not null").collect():
        samples.setdefault((r.task, r.gate), []).append(r.cand - r.base)
    for key, values in samples.items():
        x = np.array(values) * (100 if key[1].endswith("_pp") else 1)
        stats = x[rng.integers(0, len(x), (6000, len(x)))].mean(axis=1)
        assert got[key].point == pytest.approx(x.mean()) and got[key].n == len(x)
        _near(got[key].lo, stats, 2.5), _near(got[key].hi, stats, 97.5)
    costs = {}
    for r in E.paired_costs(src.view("calls"), src.view("prices")).filter("side = 'both'").collect():
        costs.setdefault(r.task, []).append((r.base, r.cand))
    latencies = {}
    for r in src.view("calls").filter("status = 'ok' and arm = 'candidate' and total_ms is not null").select("task", "total_ms").collect():
        latencies.setdefault(r.task, []).append(r.total_ms)
    for task, pairs in costs.items():
        x = np.array(pairs)
        drawn = x[rng.integers(0, len(x), (6000, len(x)))].sum(axis=1)
        _near(got[task, "cost_savings_pct"].lo, 100 * (drawn[:, 0] - drawn[:, 1]) / drawn[:, 0], 2.5)
        _near(got[task, "cost_savings_pct"].hi, 100 * (drawn[:, 0] - drawn[:, 1]) / drawn[:, 0], 97.5)
        x = np.array(latencies[task])
        stats = np.percentile(x[rng.integers(0, len(x), (6000, len(x)))], 95, axis=1)
        _near(got[task, "latency_p95"].lo, stats, 2.5), _near(got[task, "latency_p95"].hi, stats, 97.5)
    assert {g for _, g in samples} | {"cost_savings_pct", "latency_p95"} == {g for _, g in got}


def test_verdicts_follow_from_the_drawn_bounds(src):
    """Checked bound and outcome of each measured gate, and the verdicts agree with the SQL-drawn ones wherever both intervals clear the gate alike."""
    bounds = {"quality_delta_pp": -2.0, "json_schema_validity": 0.99, "groundedness_delta_pp": -1.0, "shadow_agreement": 0.90, "cost_savings_pct": 30.0}
    checks = q_gates.drawn_checks(src).collect()
    for r in checks:
        assert r.compared_value == (r.hi if r.direction == "max" else r.lo)
        assert r.passed == (r.compared_value <= r.bound_value if r.direction == "max" else r.compared_value >= r.bound_value)
        if r.gate in bounds:
            assert r.bound_value == bounds[r.gate]
    outcome = {(r.task, r.gate): r.passed for r in checks}
    other = {(r.task, r.gate): r.passed for r in q_gates.checks(src).collect()}
    assert set(outcome) == set(other)
    if outcome == other:
        assert sorted(q_gates.gate_verdict_drawn(src).collect()) == sorted(q_gates.gate_verdict(src).collect())
