"""Gates over confidence bounds and the verdict they add up to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The per-task metric behind the groundedness gate, and the rules a verdict can stand for.
GROUNDEDNESS = {"chunk_summarizer": "citation_coverage", "feature_extractor": "supported_claim_rate"}
RULES = ("all_pass", "only_quality_gates_fail", "any_blocking_gate_fails")

#: A gate file or verdict table is configuration; one with more rows than this is refused.
MOST_GATES = 1000

#: Evaluators of alternative clauses by gate, over a triage summary's columns.
ALT_EVALUATORS: dict[str, Callable[[], Column]] = {"shadow_agreement": lambda: F.col("wins_ge_losses")}


def _configured(table: DataFrame, column: str) -> list:
    rows = table.limit(MOST_GATES + 1).collect()
    if len(rows) > MOST_GATES:
        raise ValueError(f"more than {MOST_GATES} rows of configuration")
    twice = sorted({r[column] for r in rows if sum(x[column] == r[column] for x in rows) > 1})
    if twice:
        raise ValueError(f"declared more than once as {column}: {', '.join(twice)}")
    return rows


def gate_names(gates: DataFrame) -> list[str]:
    """Names of the declared gates; a name declared twice is an error."""
    return sorted(r["gate"] for r in _configured(gates.select("gate"), "gate"))


def verdict_names(verdicts: DataFrame) -> dict[str, tuple[str, str]]:
    """Verdict and description by rule; each rule needs exactly one verdict."""
    found = {r["rule"]: (r["verdict"], r["description"] or "") for r in _configured(verdicts.select("rule", "verdict", "description"), "rule")}
    absent = [r for r in RULES if r not in found]
    if absent or len(found) > len(RULES):
        raise ValueError(f"rules without a verdict: {absent}; rules that do not exist: {sorted(set(found) - set(RULES))}")
    return found


def all_gates(segments: DataFrame, gates: DataFrame) -> DataFrame:
    """Every (segment, gate) pair: the declared gates are few, so they are exploded."""
    return segments.withColumn("gate", F.explode(F.array(*[F.lit(g) for g in gate_names(gates)]).cast("array<string>")))


def build_evidence(segments: DataFrame, estimates: DataFrame, gates: DataFrame, by=("task",)) -> DataFrame:
    """Per segment and declared gate an estimate, or the reason there is none; an estimate of any other gate is an error."""
    declared = F.when(F.col("gate").isin(gate_names(gates)), F.col("gate")).otherwise(
        F.raise_error(F.concat(F.lit("estimate of an undeclared gate: "), F.coalesce("gate", F.lit("null")))).cast("string"))
    out = all_gates(segments, gates).join(estimates.withColumn("gate", declared), [*by, "gate"], "full_outer")
    reason = F.when(F.col("point").isNull(), F.when(
        (F.col("gate") == "groundedness_delta_pp") & ~F.col("task").isin(*GROUNDEDNESS), F.lit("inapplicable: the task has no groundedness instrument"))
        .when(F.col("lo").isNull() & F.col("n").isNotNull(), F.lit("too few observations")).otherwise(F.lit("not measured")))
    return out.withColumn("reason", reason)


def resolve_bounds(gates: DataFrame, sentinels: DataFrame, by=("task",)) -> DataFrame:
    """Numeric bound per (segment, gate) of the gates bounded by a named, measured value."""
    named = gates.filter(F.col("bound").try_cast("double").isNull()).select("gate", F.col("bound").alias("sentinel"))
    return sentinels.join(F.broadcast(named), "sentinel").select(*by, "gate", F.col("value").alias("bound_value"))


def check_gates(evidence: DataFrame, gates: DataFrame, sentinels: DataFrame, by=("task",)) -> DataFrame:
    """A min gate reads the lower bound, a max gate the upper; never the point.

    A unit mismatch, an unresolved sentinel or a NaN bound is an error, not a skipped gate.
    """
    rules = F.broadcast(gates.select("gate", "direction", "bound", F.col("unit").alias("want_unit"), "alt", "role"))
    measured = evidence.filter("lo is not null and hi is not null").join(rules, "gate")
    named = sentinels.select(*by, F.col("sentinel").alias("bound"), F.col("value").alias("_sentinel"))
    rows = measured.join(named, [*by, "bound"], "left")
    number = F.col("bound").try_cast("double")
    bound = F.coalesce(number, "_sentinel", F.raise_error(F.concat(F.lit("unresolved sentinel "), "bound")).cast("double"))
    compared = F.when(F.col("direction") == "min", F.col("lo")).otherwise(F.col("hi"))
    guarded = (
        F.when(F.col("unit") != F.col("want_unit"), F.raise_error(F.concat(F.lit("unit mismatch at gate "), "gate")).cast("double"))
        .when(F.isnan(compared), F.raise_error(F.concat(F.lit("NaN bound at gate "), "gate")).cast("double")).otherwise(compared))
    out = rows.withColumns({"bound_value": bound, "compared_value": guarded,
                            "bound_source": F.when(number.isNull(), F.concat(F.lit("sentinel:"), "bound")).otherwise("gate file")})
    passed = F.when(F.col("direction") == "min", F.col("compared_value") >= F.col("bound_value")).otherwise(F.col("compared_value") <= F.col("bound_value"))
    return out.select(*by, "gate", "direction", "bound_value", "bound_source", "point", "lo", "hi", "n", "unit", "compared_value",
                      F.when(F.col("direction") == "min", "ci_lower").otherwise("ci_upper").alias("compared_bound"), passed.alias("passed"), "alt", "role")


def missing_gates(segments: DataFrame, checks: DataFrame, gates: DataFrame, by=("task",)) -> DataFrame:
    return all_gates(segments, gates).join(checks.select(*by, "gate"), [*by, "gate"], "left_anti")


def apply_alternatives(checks: DataFrame, triage: DataFrame, by=("task",), evaluators=None) -> DataFrame:
    """A failed gate with a pre-agreed alternative may pass by it; unevaluated stays failed."""
    evaluators = ALT_EVALUATORS if evaluators is None else evaluators
    outcome = F.lit(None).cast("boolean")
    for gate, evaluate in evaluators.items():
        outcome = F.when(F.col("gate") == gate, evaluate()).otherwise(outcome)
    unknown = F.col("alt").isNotNull() & ~F.col("passed") & ~F.col("gate").isin(*evaluators)
    outcome = F.when(unknown, F.raise_error(F.concat(F.lit("no evaluator for the clause of "), "gate")).cast("boolean")).otherwise(outcome)
    joined = checks.join(triage.select(*by, "wins", "losses", "wins_ge_losses"), list(by), "left")
    alt_passed = F.when(~F.col("passed") & F.col("alt").isNotNull(), outcome)
    return joined.withColumn("alt_passed", alt_passed).withColumns({
        "effective_passed": F.col("passed") | F.coalesce("alt_passed", F.lit(False)),
        "alt_summary": F.when(F.col("alt_passed").isNotNull(), F.concat(F.col("wins").cast("string"), F.lit("W/"), F.col("losses").cast("string"), F.lit("L"))),
    }).drop("wins", "losses", "wins_ge_losses")


def decide(segments: DataFrame, checks: DataFrame, gates: DataFrame, verdicts: DataFrame, by=("task",)) -> DataFrame:
    """Verdict per segment with its reasons; the lists hold gate names, at most one per declared gate.

    Which gates are quality or blocking gates comes from ``gates``, what the rules are
    called from ``verdicts``. A failed blocking gate decides at once; otherwise every
    declared gate has to be measured.
    """
    name = verdict_names(verdicts)
    state = all_gates(segments, gates).join(checks.select(*by, "gate", "effective_passed", "alt_passed"), [*by, "gate"], "left").join(
        gates.select("gate", F.col("role").alias("_role")), "gate", "left")
    ok = F.col("effective_passed")

    def names(test: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("gate")))), ",")

    sums = state.groupBy(*by).agg(
        names(~ok).alias("failed"), names(ok.isNull()).alias("missing"), names(F.col("alt_passed")).alias("passed_by_alt"),
        names(~ok & F.col("_role").eqNullSafe("blocking")).alias("_blocking"), F.count_if(~ok & ~F.col("_role").eqNullSafe("quality")).alias("_hard"))
    passes, tune, hold = (name[r] for r in RULES)
    rule = F.when(F.col("failed") == "", passes[0]).when(F.col("_hard") == 0, tune[0]).otherwise("UNDETERMINED")
    blocked, open_ = F.col("_blocking") != "", F.col("missing") != ""
    verdict = F.when(blocked, hold[0]).when(open_, "INCOMPLETE").otherwise(rule)
    why = (F.when(blocked, F.concat(F.lit("blocking gates failed: "), "_blocking", F.lit(f". {hold[1]}")))
           .when(open_, F.concat(F.lit("not measured: "), "missing", F.lit("; were these to pass: "), rule))
           .when(F.col("failed") == "", F.lit(passes[1]))
           .when(F.col("_hard") == 0, F.concat(F.lit("quality gates failed: "), "failed", F.lit(f". {tune[1]}")))
           .otherwise(F.concat(F.lit("no rule covers the failed gates: "), "failed")))
    note = F.when(F.col("passed_by_alt") != "", F.concat(F.lit("; by agreed alternative: "), "passed_by_alt")).otherwise("")
    return sums.select(*by, verdict.alias("verdict"), F.when(~blocked & open_, rule).alias("provisional"), "failed", "missing", "passed_by_alt",
                       F.concat(why, note).alias("rationale"))


def verify_published(recomputed: DataFrame, published: DataFrame, key, tolerance: float = 1e-9) -> DataFrame:
    """Recomputed against published figures: everything that differs, with what is wrong."""
    a = recomputed.select(*key, F.col("mean").alias("a_mean"), F.col("n").alias("a_n"))
    b = published.select(*key, F.col("mean").alias("b_mean"), F.col("n").alias("b_n"))
    problem = (
        F.when(F.col("a_n").isNull(), "not recomputed").when(F.col("b_n").isNull(), "not published").when(F.col("a_n") != F.col("b_n"), "n differs")
        .when(F.abs(F.col("a_mean") - F.col("b_mean")) > tolerance, "mean differs"))
    return a.join(b, list(key), "full_outer").withColumn("problem", problem).filter("problem is not null").select(*key, "problem")
