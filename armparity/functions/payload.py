"""Structured answers: parsing, schema rules and field access over VARIANT columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from armparity.constants import INTENTS
from armparity.functions import json_schema as J

#: Field kinds used when two answers are compared.
AGREEMENT_KINDS = {
    "query_rewriter": {
        "query": "prose", "intent": "scalar", "filters.date_from": "scalar", "filters.date_to": "scalar",
        "filters.assignees": "scalar_set", "filters.jurisdictions": "code_set", "filters.cpc_codes": "code_set",
    },
    "chunk_summarizer": {"summary": "prose", "key_points.text": "prose", "key_points.chunk_ids": "scalar_set"},
    "feature_extractor": {
        "title": "scalar", "assignee": "scalar", "filing_date": "scalar", "jurisdiction": "code",
        "cpc_codes": "code_set", "independent_claim_count": "scalar", "technical_field": "prose",
        "novelty_statement": "prose",
    },
}


@dataclass(frozen=True)
class Rule:
    """One field of an answer schema: ``text``, ``number``, ``texts``, ``filters``, ``points``."""

    name: str
    kind: str
    required: bool = False
    nullable: bool = False
    allowed: tuple[str, ...] = ()


#: Fixed answer schemas; unknown keys are always an error.
FILTER_RULES = (
    Rule("date_from", "text", nullable=True), Rule("date_to", "text", nullable=True),
    Rule("assignees", "texts"), Rule("jurisdictions", "texts"), Rule("cpc_codes", "texts"),
)
SCHEMAS: dict[str, tuple[Rule, ...]] = {
    "query_rewriter": (
        Rule("query", "text", required=True), Rule("filters", "filters"),
        Rule("intent", "text", required=True, allowed=INTENTS),
    ),
    "chunk_summarizer": (Rule("summary", "text", required=True), Rule("key_points", "points", required=True)),
    "feature_extractor": (
        Rule("title", "text", nullable=True), Rule("assignee", "text", nullable=True),
        Rule("filing_date", "text", nullable=True), Rule("jurisdiction", "text", nullable=True),
        Rule("cpc_codes", "texts"), Rule("technical_field", "text", nullable=True),
        Rule("independent_claim_count", "number", nullable=True), Rule("novelty_statement", "text", nullable=True),
    ),
}

#: One struct for the answers of all tasks; Spark prunes the members a query does not use.
ANSWER = (
    "query string, filters struct<date_from:string,date_to:string,assignees:array<string>,"
    "jurisdictions:array<string>,cpc_codes:array<string>>, intent string, summary string, "
    "key_points array<struct<text:string,chunk_ids:array<string>>>, title string, assignee string, "
    "filing_date string, jurisdiction string, cpc_codes array<string>, technical_field string, "
    "independent_claim_count string, novelty_statement string"
)

_TEXTS = "ARRAY<(?:STRING|VOID)>"
_TYPE_PATTERNS = {
    "text": "STRING",
    "number": r"(?:BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|STRING)",
    "texts": _TEXTS,
    "points": f"ARRAY<(?:VOID|OBJECT<chunk_ids: {_TEXTS}, text: STRING>)>",
}


def json_schema(rules: tuple[Rule, ...]) -> dict:
    """An answer schema in the words of :mod:`armparity.functions.json_schema`."""
    texts = {"type": "array", "items": {"type": "string"}}
    kinds = {
        "text": {"type": ["string"]}, "number": {"type": ["integer", "integer text"]}, "texts": texts,
        "points": {"type": "array", "items": {
            "type": "object", "properties": {"text": {"type": "string"}, "chunk_ids": texts}, "required": ["text", "chunk_ids"], "additionalProperties": False}},
    }
    properties = {}
    for rule in rules:
        schema = dict(json_schema(FILTER_RULES) if rule.kind == "filters" else kinds[rule.kind])
        if rule.nullable:
            schema["type"] = [*schema["type"], "null"]
        if rule.allowed:
            schema["enum"] = list(rule.allowed)
        properties[rule.name] = schema
    return {"type": "object", "properties": properties, "required": [r.name for r in rules if r.required], "additionalProperties": False}


def gold_defects(task: Column, gold: Column) -> Column:
    """``array<string>`` of what a gold answer (JSON text) breaks in its task's schema; a task without a schema is one defect."""
    out = F.array(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null"))))
    for name, rules in SCHEMAS.items():
        out = F.when(task == name, J.defects_of_text(gold, json_schema(rules), "gold")).otherwise(out)
    return out


def shape(json_text: Column) -> Column:
    """Inferred type of a JSON text, keys in alphabetical order; null when it is not JSON."""
    return F.schema_of_variant(F.try_parse_json(json_text))


def answer(json_text: Column, shape_: Column) -> Column:
    """The parsed answer when the text is a JSON object; arrays, prose and failures are null."""
    return F.when(shape_.startswith("OBJECT<"), F.from_json(json_text, ANSWER))


def keys_of(json_text: Column) -> Column:
    return F.json_object_keys(json_text)


def _object_pattern(rules: tuple[Rule, ...]) -> str:
    """Pattern over :func:`shape` text: known keys only, required ones present, right types."""
    parts = []
    for rule in sorted(rules, key=lambda r: r.name):
        kind = _object_pattern(FILTER_RULES) if rule.kind == "filters" else _TYPE_PATTERNS[rule.kind]
        if rule.nullable:
            kind = f"(?:VOID|{kind})"
        parts.append(f"(?:{rule.name}: {kind}(?:, |(?=>))){'' if rule.required else '?'}")
    return "OBJECT<" + "".join(parts) + ">"


def _no_null(values: Column) -> Column:
    return F.forall(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())


def _residual(rule: Rule, p: Column, shape_: Column) -> Column | None:
    """What the type text cannot say: enum members, null elements, whole numbers."""
    value = p[rule.name]
    if rule.allowed:
        return value.isin(*rule.allowed)
    if rule.kind == "texts":
        return _no_null(value)
    if rule.kind == "number":
        is_text = F.rlike(shape_, F.lit(f"{rule.name}: STRING"))
        whole = value.try_cast("decimal(38,9)")
        return value.isNull() | F.when(is_text, F.rlike(value, F.lit("^[+-]?[0-9]+$"))).otherwise(whole == F.floor(whole))
    if rule.kind == "filters":
        lists = [_no_null(value[r.name]) for r in FILTER_RULES if r.kind == "texts"]
        return lists[0] & lists[1] & lists[2]
    if rule.kind == "points":
        return F.forall(value, lambda x: x["text"].isNotNull() & x["chunk_ids"].isNotNull() & _no_null(x["chunk_ids"]))
    return None


def schema_valid(task: Column, p: Column, shape_: Column) -> Column:
    """Does the parsed answer satisfy its task's schema?"""
    checks = F.lit(False)
    for name, rules in SCHEMAS.items():
        ok = F.rlike(shape_, F.lit(f"^{_object_pattern(rules)}$"))
        for rule in rules:
            extra = _residual(rule, p, shape_)
            ok = ok if extra is None else ok & extra
        checks = F.when(task == name, F.coalesce(ok, F.lit(False))).otherwise(checks)
    return F.coalesce(checks, F.lit(False))


def field_names(task: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, rules in SCHEMAS.items():
        out = F.when(task == name, F.array(*[F.lit(r.name) for r in rules])).otherwise(out)
    return out


def reencoded_field(task: Column, json_text: Column, min_shared: int = 2) -> Column:
    """The field into which the whole answer was stuffed as a JSON string, or null.

    Only texts with an escaped quote can hold one, so the parse runs on those alone.
    """
    members = F.map_entries(F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>"))

    def holds(entry: Column) -> Column:
        inner = F.when(F.schema_of_variant(entry["value"]) == "STRING", F.trim(entry["value"].try_cast("string")))
        shared = F.array_intersect(F.coalesce(keys_of(inner), F.array().cast("array<string>")), field_names(task))
        return F.coalesce(inner.startswith("{") & (F.size(shared) >= min_shared), F.lit(False))

    names = F.transform(F.filter(members, holds), lambda e: e["key"])
    first = F.try_element_at(F.filter(keys_of(json_text), lambda k: F.array_contains(names, k)), F.lit(1))
    return F.when(json_text.contains('\\"'), first)
