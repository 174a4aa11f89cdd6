"""Shadow agreement of two arms and the adjudication of their disagreements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.functions import payload as P
from armparity.functions import text as T
from armparity.functions.plan import filter_above

PROSE_THRESHOLD = 0.60
NO_PAYLOAD = "no structured output from either arm"
Similarity = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Scorer:
    """A caller's own similarity of two texts, as a function over two equally long Series.

    It runs in Arrow batches and sees each distinct pair of a batch once, whatever the
    number of rows that hold the pair.
    """

    score: Callable[[pd.Series, pd.Series], pd.Series]

    def column(self, left: Column, right: Column) -> Column:
        """``array<double>`` of the pairs at the same place of two ``array<string>`` columns; null where a side is null or blank."""
        score = self.score

        @F.pandas_udf("array<double>")
        def rate(a: pd.Series, b: pd.Series) -> pd.Series:
            sizes = [len(x) for x in a]
            flat = pd.DataFrame({"a": [t for x in a for t in x], "b": [t for x in b for t in x]}, dtype=object)
            told = flat["a"].fillna("").str.strip().ne("") & flat["b"].fillna("").str.strip().ne("")
            pairs = flat[told].drop_duplicates()
            rated = pairs.assign(s=np.asarray(score(pairs["a"].reset_index(drop=True), pairs["b"].reset_index(drop=True)), float)) if len(pairs) else pairs.assign(s=pd.Series(dtype=float))
            values = flat.merge(rated, on=["a", "b"], how="left")["s"]
            values = [None if pd.isna(v) else float(v) for v in values]
            cuts = np.r_[0, np.cumsum(sizes)]
            return pd.Series([values[p:q] for p, q in zip(cuts, cuts[1:])])

        return rate(left, right)


def _raw_value(p: Column, name: str) -> Column:
    """Comparable value of a field before normalisation."""
    if name == "key_points.text":
        texts = F.transform(p["key_points"], lambda x: F.coalesce(x["text"], F.lit("")))
        return F.coalesce(F.array_join(texts, "\n"), F.lit(""))
    if name == "key_points.chunk_ids":
        none = F.array().cast("array<string>")
        return F.coalesce(F.flatten(F.transform(p["key_points"], lambda x: F.coalesce(x["chunk_ids"], none))), none)
    out = p
    for part in name.split("."):
        out = out[part]
    return out


def _comparable(p: Column, shape: Column, name: str, kind: str) -> Column:
    """One text per field: equal texts mean equal values, sets are sorted and joined."""
    raw = _raw_value(p, name)
    if kind == "prose":
        return raw
    if kind.endswith("_set"):
        return F.array_join(T.normalize_set(raw, code=kind == "code_set"), "\u0001")
    norm = (T.normalize_code if kind == "code" else T.normalize_scalar)(raw)
    if name == "independent_claim_count":
        return F.concat(F.when(F.rlike(shape, F.lit(f"{name}: STRING")), F.lit("text ")).otherwise(F.lit("")), norm)
    return norm


def field_values(task: Column, p: Column, shape: Column) -> Column:
    """``array<struct<field, kind, value>>`` for the row's task."""
    out = F.lit(None)
    for name, kinds in P.AGREEMENT_KINDS.items():
        rows = F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), _comparable(p, shape, f, k).alias("value"))
            for f, k in kinds.items()])
        out = F.when(task == name, rows).otherwise(out)
    return out


def compare_fields(left: Column, right: Column, similarity: Similarity, threshold: float, scores: Column | None = None) -> Column:
    """Field by field: prose by similarity, everything else by equal normal forms.

    ``scores``, where given, hold the similarities of the fields in their order.
    """

    def compare(a: Column, b: Column, score: Column | None = None) -> Column:
        blank_a = F.coalesce(F.trim(a["value"]), F.lit("")) == ""
        blank_b = F.coalesce(F.trim(b["value"]), F.lit("")) == ""
        near = F.when(a["kind"] == "prose", F.when(blank_a & blank_b, F.lit(1.0)).when(blank_a | blank_b, F.lit(0.0))
                      .otherwise(similarity(a["value"], b["value"]) if score is None else score))
        return F.struct(a["field"].alias("field"), a["kind"].alias("kind"), near.alias("similarity"),
                        a["value"].eqNullSafe(b["value"]).alias("same"))

    rated = F.zip_with(left, right, lambda a, b: compare(a, b)) if scores is None else F.zip_with(
        F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), scores, lambda ab, s: compare(ab["a"], ab["b"], s))
    return F.transform(rated, lambda x: F.struct(
        x["field"].alias("field"), x["kind"].alias("kind"), x["similarity"].alias("similarity"),
        F.when(x["kind"] == "prose", x["similarity"] >= threshold).otherwise(x["same"]).alias("agreed")))


def side(calls: DataFrame, arm: str, prefix: str) -> DataFrame:
    """One arm's answers, parsed where they are read, before any shuffle."""
    rows = calls.filter(F.col("arm") == arm).withColumn("shape", P.shape(F.col("payload_json"))).withColumn(
        "p", P.answer(F.col("payload_json"), F.col("shape")))
    answers = rows.select("task", "item_id", field_values(F.col("task"), F.col("p"), F.col("shape")).alias("fields"), F.col("p").isNotNull().alias("answered"))
    # an item is one observation: a second call of it is refused, as in any paired sample
    one = answers.groupBy("task", "item_id").agg(F.count("*").alias("_n"), F.first("fields").alias("fields"), F.first("answered").alias("answered"))
    again = F.raise_error(F.concat(F.lit(f"item called more than once in arm {arm}: "), F.col("item_id").cast("string"))).cast("boolean")
    return one.select("task", "item_id", F.col("fields").alias(f"{prefix}_fields"), F.when(F.col("_n") > 1, again).otherwise(F.col("answered")).alias(f"{prefix}_answered"))


def compare_items(calls: DataFrame, baseline: str, candidate: str, similarity: Similarity | Scorer = T.lexical_similarity,
                  threshold: float = PROSE_THRESHOLD) -> DataFrame:
    """One row per item seen in either arm: agreement, structured agreement, field detail.

    ``similarity`` of prose is a column function, or a :class:`Scorer` for what columns cannot say.
    """
    if baseline == candidate:
        raise ValueError("baseline and candidate are the same arm")
    both = side(calls, baseline, "b").join(side(calls, candidate, "c"), ["task", "item_id"], "full_outer")
    scores = None
    if isinstance(similarity, Scorer):
        prose = [F.coalesce(F.transform(f"{p}_fields", lambda x: F.when(x["kind"] == "prose", x["value"])), F.array().cast("array<string>")) for p in "bc"]
        held = F.col("b_answered") & F.col("c_answered")
        both = both.withColumn("_scores", similarity.column(*[F.when(held, x).otherwise(F.array().cast("array<string>")) for x in prose]))
        scores = F.col("_scores")
    b_ok, c_ok = F.coalesce("b_answered", F.lit(False)), F.coalesce("c_answered", F.lit(False))
    empty = F.when(~b_ok & c_ok, "baseline").when(b_ok & ~c_ok, "candidate")
    staged = both.withColumns({
        "has_baseline": F.col("b_answered").isNotNull(), "has_candidate": F.col("c_answered").isNotNull(),
        "comparable": b_ok | c_ok, "empty_arm": empty,
        "fields": F.when(b_ok & c_ok, compare_fields(F.col("b_fields"), F.col("c_fields"), similarity, threshold, scores)).when(
            b_ok | c_ok, F.transform(F.coalesce("b_fields", "c_fields"), lambda x: F.struct(
                x["field"].alias("field"), x["kind"].alias("kind"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("agreed")))),
    }).drop("b_fields", "c_fields", "b_answered", "c_answered", "_scores")
    one_empty = F.col("empty_arm").isNotNull()
    agreed = F.when(F.col("comparable"), ~one_empty & F.forall("fields", lambda x: x["agreed"]))
    structured = F.when(F.col("comparable"), ~one_empty & F.forall("fields", lambda x: x["agreed"] | (x["kind"] == "prose")))
    return staged.withColumns({
        "agreed": agreed, "structured_agreed": structured,
        "reason": F.when(~F.col("comparable"), F.lit(NO_PAYLOAD)),
        "disagreeing": F.transform(F.filter("fields", lambda x: ~x["agreed"]), lambda x: x["field"]),
    })


def agreement_summary(items: DataFrame, by=("task",)) -> DataFrame:
    return items.groupBy(*by).agg(
        F.count("*").alias("n_items"), F.count_if("comparable").alias("n_compared"), F.count_if("agreed").alias("n_agreed"),
        F.count_if("structured_agreed").alias("n_structured"), F.count_if(~F.col("comparable")).alias("n_excluded"),
        F.count("empty_arm").alias("n_one_arm_empty"),
        F.avg(F.col("agreed").cast("double")).alias("agreement"),
        F.avg(F.col("structured_agreed").cast("double")).alias("structured_agreement"),
    )


def field_rates(items: DataFrame, by=("task",)) -> DataFrame:
    rows = items.filter("empty_arm is null").select(*by, F.inline("fields"))
    return rows.groupBy(*by, "field", "kind").agg(
        F.count("*").alias("n"), F.avg(F.col("agreed").cast("double")).alias("rate"), F.avg("similarity").alias("mean_similarity"))


# --- adjudication ---------------------------------------------------------------------

def judged_side(cells: DataFrame, arm: str, prefix: str) -> DataFrame:
    """Mean score over the repeats that worked, and the first of them for its reasons."""
    rows = cells.filter(F.col("arm") == arm)
    first = F.min_by(F.when(F.col("status") == "ok", F.struct("criteria", "overall")), F.when(F.col("status") == "ok", F.col("repeat")))
    return rows.groupBy("task", "item_id").agg(
        F.avg("score").alias(f"{prefix}_score"), F.count("score").alias(f"{prefix}_repeats"), first.alias(f"{prefix}_first"))


def _losing_reason(loser: Column, winner: Column, arm: str) -> Column:
    """What the loser failed and the winner passed, else what it failed, else its summary."""
    passed = F.transform(F.filter(winner["criteria"], lambda c: c["passed"]), lambda c: c["criterion_id"])
    failed = F.filter(loser["criteria"], lambda c: ~c["passed"])
    telling = F.get(F.filter(failed, lambda c: F.array_contains(passed, c["criterion_id"])), F.lit(0))
    first = F.get(failed, F.lit(0))

    def quote(word: str, c: Column) -> Column:
        return F.concat(F.lit(f"{arm} {word} ["), c["criterion_id"], F.lit("]: "), c["rationale"])

    return T.one_line(F.coalesce(quote("lost on", telling), quote("failed", first),
                                 F.concat(F.lit(f"{arm} scored lower; "), loser["overall"])))


def adjudicate(items: DataFrame, judged: DataFrame, cells: DataFrame, malformed: DataFrame,
               baseline: str, candidate: str) -> DataFrame:
    """Win, loss or tie per disagreement, or why there is no verdict.

    ``judged`` lists the (task, item) pairs the first judge scored, ``malformed`` the
    baseline answers that are structurally broken.
    """
    rows = (
        filter_above(items, ~F.col("agreed"))
        .join(judged.select("task", "item_id", F.lit(True).alias("in_split")), ["task", "item_id"], "left")
        .join(judged_side(cells, baseline, "b"), ["task", "item_id"], "left")
        .join(judged_side(cells, candidate, "c"), ["task", "item_id"], "left")
        .join(malformed.select("task", "item_id", "baseline_malformed"), ["task", "item_id"], "left")
    )
    missing = F.concat_ws(", ", F.when(F.col("b_score").isNull(), F.lit(baseline)), F.when(F.col("c_score").isNull(), F.lit(candidate)))
    reason = (
        F.when(F.col("in_split").isNull(), F.lit("outside the judged split"))
        .when(~F.col("has_baseline") | ~F.col("has_candidate"), F.lit("one arm has no call for this item"))
        .when(missing != "", F.concat(F.lit("no verdict for "), missing))
    )
    gap = F.col("c_score") - F.col("b_score")
    verdict = F.when(F.col("reason_") .isNotNull(), "not_adjudicated").when(gap > 0, "win").when(gap < 0, "loss").otherwise("tie")
    why = (
        F.when(F.col("verdict") == "win", _losing_reason(F.col("b_first"), F.col("c_first"), baseline))
        .when(F.col("verdict") == "loss", _losing_reason(F.col("c_first"), F.col("b_first"), candidate))
        .when(F.col("verdict") == "tie", T.one_line(F.concat(F.lit(f"equal scores; on {candidate}: "), F.col("c_first.overall"))))
    )
    out = rows.withColumn("reason_", reason).withColumn("verdict", verdict).withColumn("rationale", why)
    return out.select("task", "item_id", "disagreeing", "verdict", F.col("reason_").alias("reason"), "b_score", "c_score",
                      "b_repeats", "c_repeats", "rationale", "baseline_malformed")


def triage_summary(rows: DataFrame, by=("task",)) -> DataFrame:
    """Tallies overall and without malformed baselines; nothing adjudicated is null, not true."""
    def n(verdict: str, broken: bool = False) -> Column:
        hit = F.col("verdict") == verdict
        return F.count_if(hit & F.col("baseline_malformed").isNotNull() if broken else hit)

    t = rows.groupBy(*by).agg(
        F.count("*").alias("disagreements"), n("win").alias("wins"), n("loss").alias("losses"), n("tie").alias("ties"),
        n("not_adjudicated").alias("not_adjudicated"), n("win", True).alias("wins_malformed"), n("loss", True).alias("losses_malformed"))
    judged = F.col("wins") + F.col("losses") + F.col("ties") > 0
    return t.withColumns({
        "wins_ge_losses": F.when(judged, F.col("wins") >= F.col("losses")),
        "quality_wins_ge_losses": F.when(judged, F.col("wins") - F.col("wins_malformed") >= F.col("losses") - F.col("losses_malformed")),
    })


def unadjudicated_reasons(rows: DataFrame, by=("task",)) -> DataFrame:
    return rows.filter("verdict = 'not_adjudicated'").groupBy(*by, F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def clause_text(summary: DataFrame) -> Column:
    """Whether the alternative clause holds, on each figure there is."""
    overall, quality = F.col("wins_ge_losses"), F.col("quality_wins_ge_losses")
    one_figure = F.col("wins_malformed") + F.col("losses_malformed") == 0
    return (
        F.when(overall.isNull(), F.lit("cannot be evaluated"))
        .when(one_figure, F.when(overall, F.lit("passes the clause")).otherwise(F.lit("fails the clause")))
        .when(overall == quality, F.when(overall, F.lit("passes on either figure")).otherwise(F.lit("fails on either figure")))
        .when(overall, F.lit("passes overall, not on the quality-only tally"))
        .otherwise(F.lit("fails overall, though the quality-only tally clears"))
    )


def judged_split(judged: DataFrame, by=("task",)) -> DataFrame:
    """The split a judge scored; ``all`` wins where arms differ."""
    return judged.groupBy(*by).agg(F.when(F.bool_or(~F.col("core")), "all").otherwise("core").alias("split"))


def carry_figures(grid: DataFrame, measured: DataFrame, base_config: str, key=("task", "config")) -> DataFrame:
    """Own figure of a configuration, else its base configuration's, labelled as carried."""
    base = measured.filter(F.col("config") == base_config).select("task", F.col("figure").alias("base_figure"))
    out = grid.join(measured, list(key), "left").join(base, "task", "left")
    return out.select(*key, F.coalesce("figure", "base_figure").alias("figure"),
                      (F.col("figure").isNull() & F.col("base_figure").isNotNull()).alias("carried"))
