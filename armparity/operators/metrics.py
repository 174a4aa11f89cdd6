"""Per-row quality metrics.

An outcome is ``ok`` with a value, ``not_applicable`` for an undefined ratio (never a
zero), or ``error`` for an answer that cannot be scored.  All of it is row-local once
call and gold are on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.functions import payload as P
from armparity.functions import text as T

#: Filter fields, scored extraction fields, verdicts.
FILTER_SCALARS = ("date_from", "date_to")
FILTER_LISTS = ("assignees", "jurisdictions", "cpc_codes")
CODE_FIELDS = ("jurisdictions", "cpc_codes", "jurisdiction")
EXTRACT_SCALARS = ("title", "assignee", "filing_date", "jurisdiction", "independent_claim_count")
EXTRACT_LISTS = ("cpc_codes",)
EXTRACT_FIELDS = EXTRACT_SCALARS + EXTRACT_LISTS
JUDGED_FIELDS = ("technical_field", "novelty_statement")
ALL_EXTRACT_FIELDS = EXTRACT_FIELDS + JUDGED_FIELDS
FIELD_VERDICTS = ("correct", "correct_abstention", "wrong", "hallucination", "omission", "unscoreable")

RAW = "struct<metric:string,value:double,note:string,broken:boolean>"


def outcome(metric: str, value: Column | None, absent: str | None = None, note: Column | None = None,
            broken: bool = False) -> Column:
    """One metric of one row: its value, and the note to show when there is none."""
    value = F.lit(None).cast("double") if value is None else value.cast("double")
    text = F.lit(absent).cast("string") if note is None else note
    return F.struct(F.lit(metric).alias("metric"), value.alias("value"), text.alias("note"),
                    F.lit(broken).alias("broken")).cast(RAW)


def scored_pairs(calls: DataFrame, items: DataFrame) -> DataFrame:
    """Calls with their gold answer, both parsed once: one shuffle join on the item."""
    gold = items.select("item_id", "gold_json", "n_chunks")
    kept = calls.select("call_id", "item_id", "task", "arm", "core", "status", "error", "payload_json", "output_text")
    return kept.join(gold, "item_id").withColumn("shape", P.shape(F.col("payload_json"))).withColumns({
        "p": P.answer(F.col("payload_json"), F.col("shape")),
        "g": F.from_json("gold_json", P.ANSWER),
        "gold_keys": P.keys_of(F.col("gold_json")),
    })


# --- validity ------------------------------------------------------------------

def validity_tag(status: Column, task: Column, p: Column, shape: Column) -> Column:
    """call_error / no_json / invalid / valid: exactly one per call."""
    return (
        F.when(status == "error", F.lit("call_error")).when(p.isNull(), F.lit("no_json"))
        .when(P.schema_valid(task, p, shape), F.lit("valid")).otherwise(F.lit("invalid"))
    )


# --- filters ---------------------------------------------------------------------

def _tagged(field: str, norm):
    return lambda x: F.concat(F.lit(field + "="), norm(x))


def _equals(name: str):
    return lambda x: x == name


def filter_assertions(filters: Column, fields=FILTER_SCALARS + FILTER_LISTS) -> Column:
    """Sorted distinct ``field=value`` assertions of a filters object."""
    parts = []
    for field in fields:
        norm = T.normalize_code if field in CODE_FIELDS else T.normalize_scalar
        values = filters[field] if field in FILTER_LISTS else F.array(filters[field])
        kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
        parts.append(F.transform(kept, _tagged(field, norm)))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def filter_counts(sets: Column) -> Column:
    """``tp, fp, fn`` of a struct holding the ``gold`` and ``predicted`` sets."""
    gold, predicted = sets["gold"], sets["predicted"]
    return F.struct(
        F.size(F.array_intersect(gold, predicted)).alias("tp"),
        F.size(F.array_except(predicted, gold)).alias("fp"),
        F.size(F.array_except(gold, predicted)).alias("fn"),
    )


def filter_prf(c: Column) -> list[Column]:
    """Precision, recall and F1; each undefined on an empty denominator."""
    precision = F.try_divide(c["tp"], c["tp"] + c["fp"])
    recall = F.try_divide(c["tp"], c["tp"] + c["fn"])
    both = ((c["tp"] + c["fp"]) > 0) & ((c["tp"] + c["fn"]) > 0)
    f1 = F.when(both, F.coalesce(F.try_divide(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]), F.lit(0.0)))
    return [
        outcome("filter_precision", precision, "answer has no filter"),
        outcome("filter_recall", recall, "gold has no filter"),
        outcome("filter_f1", f1, "one of the two shares is undefined"),
    ]


def exact_key(g: Column, gold_keys: Column, p: Column, key: str) -> Column:
    """1 when the normal forms are equal; undefined when gold does not carry the key."""
    same = T.normalize_scalar(g[key]).eqNullSafe(T.normalize_scalar(p[key]))
    value = F.when(F.array_contains(gold_keys, key), F.when(p.isNull(), F.lit(0.0)).otherwise(same.cast("double")))
    return outcome(f"exact_match_{key}", value, f"gold does not carry {key}")


# --- citations ---------------------------------------------------------------------

def point_classes(points: Column, supplied: Column) -> Column:
    """Class of each key point; citing nothing is tested before citing the unknown."""

    def classify(point: Column) -> Column:
        cited = F.coalesce(point["chunk_ids"], F.array().cast("array<string>"))
        return (
            F.when(F.size(cited) == 0, F.lit("uncited"))
            .when(F.size(F.array_except(cited, supplied)) > 0, F.lit("fabricated")).otherwise(F.lit("grounded"))
        )

    return F.transform(points, classify)


def citation_outcomes(p: Column, classes: Column) -> Column:
    """The three citation metrics as one array."""
    names = (("citation_coverage", "grounded"), ("uncited_claim_rate", "uncited"), ("fabricated_citation_rate", "fabricated"))
    lost = [outcome(m, F.lit(0.0) if m == "citation_coverage" else None, "no answer to read") for m, _ in names]
    unread = [outcome(m, None, "points are no list", broken=True) for m, _ in names]
    shares = [
        outcome(m, F.try_divide(F.size(F.filter(classes, _equals(c))), F.size(classes)), "list of points is empty")
        for m, c in names
    ]
    return F.when(p.isNull(), F.array(*lost)).when(classes.isNull(), F.array(*unread)).otherwise(F.array(*shares))


# --- extraction -----------------------------------------------------------------------

def _comparable(p: Column, shape: Column, field: str) -> Column:
    norm = T.normalize_code if field in CODE_FIELDS else T.normalize_scalar
    if field in EXTRACT_LISTS:
        return F.when(F.size(p[field]) > 0, F.array_join(
            F.array_sort(F.array_distinct(F.transform(p[field], norm))), "\u0001", "\u0000"))
    if field == "independent_claim_count":
        number = F.when(F.rlike(shape, F.lit(f"{field}: STRING")), F.lit("text ")).otherwise(F.lit(""))
        return F.concat(number, norm(p[field]))
    return norm(p[field])


def field_verdicts(g: Column, gold_keys: Column, p: Column, shape: Column, fields=EXTRACT_FIELDS) -> Column:
    """``array<struct<field, verdict>>``: null or an empty list is an abstention."""
    sides = F.array(*[
        F.struct(F.lit(f).alias("field"), _comparable(g, F.lit(""), f).alias("want"), _comparable(p, shape, f).alias("got"))
        for f in fields
    ])

    def judge(x: Column) -> Column:
        verdict = (
            F.when(~F.array_contains(gold_keys, x["field"]), F.lit("unscoreable"))
            .when(x["want"].isNull() & x["got"].isNull(), F.lit("correct_abstention"))
            .when(x["want"].isNull(), F.lit("hallucination")).when(x["got"].isNull(), F.lit("omission"))
            .when(x["want"] == x["got"], F.lit("correct")).otherwise(F.lit("wrong"))
        )
        return F.struct(x["field"].alias("field"), verdict.alias("verdict"))

    return F.transform(sides, judge)


def verdict_counts(verdicts: Column) -> Column:
    return F.struct(*[
        F.size(F.filter(verdicts, _has_verdict(v))).alias(v)
        for v in FIELD_VERDICTS
    ])


def _has_verdict(name: str):
    return lambda x: x["verdict"] == name


def extraction_outcomes(n: Column) -> list[Column]:
    """The five extraction metrics from a row's verdict counts."""
    answered = n["correct"] + n["wrong"] + n["hallucination"]
    unstated = n["correct_abstention"] + n["hallucination"]
    stated = n["correct"] + n["wrong"] + n["omission"]
    ratios = (
        ("extraction_accuracy", n["correct"] + n["correct_abstention"], unstated + stated, "nothing to score in gold"),
        ("answered_precision", n["correct"], answered, "answer leaves every field open"),
        ("supported_claim_rate", n["correct"] + n["wrong"], answered, "answer leaves every field open"),
        ("hallucination_rate", n["hallucination"], unstated, "gold leaves no field open"),
        ("omission_rate", n["omission"], stated, "gold leaves every field open"),
    )
    return [outcome(name, F.try_divide(top, bottom), why) for name, top, bottom, why in ratios]


# --- everything for a row, then per arm -------------------------------------------------

def supplied_chunks(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("c"), i.cast("string")))


def outcomes(pairs: DataFrame) -> DataFrame:
    """Long frame, one row per (call, metric), from :func:`scored_pairs`."""
    task, p, g = F.col("task"), F.col("p"), F.col("g")
    is_qr, is_cs, is_fe = (task == t for t in P.SCHEMAS)
    staged = pairs.withColumns({
        "_tag": validity_tag(F.col("status"), task, p, F.col("shape")),
        "_sets": F.when(is_qr, F.struct(filter_assertions(g["filters"]).alias("gold"),
                                        filter_assertions(p["filters"]).alias("predicted"))),
        "_points": F.when(is_cs, point_classes(p["key_points"], supplied_chunks(F.col("n_chunks")))),
        "_fields": F.when(is_fe, field_verdicts(g, F.col("gold_keys"), p, F.col("shape"))),
    }).withColumns({
        "_prf": F.when(is_qr, filter_counts(F.col("_sets"))),
        "_n": F.when(is_fe, verdict_counts(F.col("_fields"))),
    })
    validity = F.array(outcome("json_schema_validity", F.col("_tag") == "valid", note=F.col("_tag")))
    family = (
        F.when(is_qr, F.array(*filter_prf(F.col("_prf")), exact_key(g, F.col("gold_keys"), p, "intent")))
        .when(is_cs, citation_outcomes(p, F.col("_points")))
        .when(is_fe, F.array(*extraction_outcomes(F.col("_n"))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown task "), "task")).cast(f"array<{RAW}>"))
    )
    long = staged.select("call_id", "item_id", "task", "arm", "core", F.col("status").alias("call_status"),
                         F.inline(F.concat(validity, family)))
    status = F.when(F.col("value").isNotNull(), "ok").when(F.col("broken"), "error").otherwise("not_applicable")
    shown = F.when(F.col("value").isNull() | (F.col("metric") == "json_schema_validity"), F.col("note"))
    return long.select("call_id", "item_id", "task", "arm", "core", "call_status", "metric",
                       status.alias("status"), "value", shown.alias("detail"))


def arm_metrics(long: DataFrame, by=("task", "arm", "metric")) -> DataFrame:
    """Measured n, mean and the census of exclusions; partial aggregation first."""
    return long.groupBy(*by).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.count_if(F.col("status") == "not_applicable").alias("n_not_applicable"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.count_if((F.col("call_status") == "error") & F.col("value").isNotNull()).alias("call_errors"),
    )


def exclusion_census(long: DataFrame) -> DataFrame:
    return long.filter("status <> 'ok'").groupBy("task", "arm", "metric", "status", "detail").agg(F.count("*").alias("n"))


def error_kinds(calls: DataFrame, by=("task", "arm")) -> DataFrame:
    """Kinds of failed calls with their counts, most frequent first, in one text: ``Timeout x3, RateLimit x1``."""
    kinds = calls.filter("status = 'error'").groupBy(*by, T.error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind")))
    shown = F.transform(ranked, lambda x: F.concat(x["kind"], F.lit(" x"), (-x["less"]).cast("string")))
    return kinds.groupBy(*by).agg(F.array_join(shown, ", ").alias("error_kinds"))


def arm_report(long: DataFrame, calls: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Arm report: calls, models, kinds of errors and the judge's score beside every metric of the arm.

    ``judged`` has ``n_items``, ``mean_score`` and ``failed_repeats`` per task and arm; an
    arm that nobody judged has nulls there.
    """
    by = ["task", "arm"]
    counts = calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.count_if(F.col("status") == "error").alias("n_failed"),
                                    F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"))
    out = arm_metrics(long).join(counts, by).join(error_kinds(calls), by, "left")
    if judged is None:
        return out
    return out.join(judged.select(*by, F.col("n_items").alias("judged_items"), F.col("mean_score").alias("judge_score"), "failed_repeats"), by, "left")


def field_tally(pairs: DataFrame, fields=EXTRACT_FIELDS) -> DataFrame:
    """Verdicts per field under any field set."""
    rows = pairs.filter("task = 'feature_extractor'").select(
        "arm", F.inline(field_verdicts(F.col("g"), F.col("gold_keys"), F.col("p"), F.col("shape"), fields)))
    return rows.groupBy("arm", "field").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in FIELD_VERDICTS])


def malformed_reason(status: Column, error: Column, task: Column, p: Column, shape: Column, json_text: Column) -> Column:
    """Why an emission is structurally broken, or null; double encoding is tested before validity."""
    stuffed = P.reencoded_field(task, json_text)
    return (
        F.when(status == "error", F.concat(F.lit("call failed: "), F.coalesce(error, F.lit("unknown"))))
        .when(p.isNull(), F.lit("no JSON object"))
        .otherwise(F.coalesce(
            F.concat(F.lit("re-encoded inside "), stuffed),
            F.when(~P.schema_valid(task, p, shape), F.lit("does not validate"))))
    )


def emitted_chars(text: Column, json_text: Column) -> Column:
    """Characters returned: text plus compact JSON as the log writes it."""
    from armparity.functions.keys import ascii_json

    return F.coalesce(F.length(text), F.lit(0)) + F.coalesce(
        F.length(ascii_json(F.to_json(F.try_parse_json(json_text)))), F.lit(0))
