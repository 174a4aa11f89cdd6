"""JSON schemas compiled to column expressions over VARIANT values.

:func:`defects` gives the list of everything a value breaks, each with its path. A schema
is a dict of the usual words: ``type`` (one or a list), ``properties``, ``required``,
``additionalProperties`` (false only), ``items``, ``minItems``, ``maxItems``, ``enum``,
``minimum``, ``maximum`` and ``pattern``. Any other word is an error when the expression
is built, so that no rule is silently skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN = {"type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "enum", "minimum", "maximum", "pattern"}

#: First word of a variant's type text, by JSON type.
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_TYPES: dict[str, Callable[[Column, Column], Column]] = {
    "object": lambda kind, v: kind == "OBJECT",
    "array": lambda kind, v: kind == "ARRAY",
    "string": lambda kind, v: kind == "STRING",
    "boolean": lambda kind, v: kind == "BOOLEAN",
    "null": lambda kind, v: kind == "VOID",
    "number": lambda kind, v: kind.isin(*_NUMBERS),
    "integer": lambda kind, v: (kind == "BIGINT") | (kind.isin(*_NUMBERS[1:]) & F.coalesce(_number(v) == F.floor(_number(v)), F.lit(False))),
    #: A whole number written as a text, which some writers use for ``integer``.
    "integer text": lambda kind, v: (kind == "STRING") & F.coalesce(F.rlike(_text(v), F.lit("^[+-]?[0-9]+$")), F.lit(False)),
}


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _texts(*cols: Column) -> Column:
    return F.array(*cols).cast("array<string>")


def _check(schema: dict) -> None:
    unknown = sorted(set(schema) - KNOWN)
    if unknown:
        raise ValueError(f"schema words that are not compiled: {', '.join(unknown)}")
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    if any(t not in _TYPES for t in types):
        raise ValueError(f"unknown type in {types}")
    if schema.get("additionalProperties", False) is not False:
        raise ValueError("additionalProperties can only be false")


def _let(fn: Callable[..., Column], **named: Column) -> Column:
    """``fn`` (giving an array) of columns that are computed once, however often it uses them."""
    bound = F.transform(F.array(F.struct(*[c.alias(n) for n, c in named.items()])), lambda s: fn(**{n: s[n] for n in named}))
    return F.flatten(bound)


def defects(value: Column, schema: dict, path: Column | str = "$") -> Column:
    """``array<string>`` of what ``value`` (VARIANT) breaks, in the schema's order; a null column is ``missing``."""
    _check(schema)
    at = F.lit(path) if isinstance(path, str) else path
    types = [schema["type"]] if isinstance(schema.get("type"), str) else list(schema.get("type", []))

    def note(text: Column | str) -> Column:
        return _texts(F.concat(at, F.lit(": "), F.lit(text) if isinstance(text, str) else text))

    def said(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), note(text)).otherwise(_texts())

    def members_of(value: Column, members: Column) -> list[Column]:
        names, own = list(dict.fromkeys([*schema.get("properties", {}), *schema.get("required", [])])), []
        for name in names:
            child, below = F.try_element_at(members, F.lit(name)), F.concat(at, F.lit(f".{name}"))
            missing = _texts(F.concat(below, F.lit(": missing"))) if name in schema.get("required", []) else _texts()
            own.append(F.when(F.array_contains(F.map_keys(members), name), defects(child, schema.get("properties", {}).get(name, {}), below)).otherwise(missing))
        if "additionalProperties" in schema:
            extra = F.array_sort(F.array_except(F.map_keys(members), _texts(*map(F.lit, names))))
            own.append(F.transform(extra, lambda x: F.concat(at, F.lit("."), x, F.lit(": unknown key"))))
        return own

    def items_of(rows: Column) -> list[Column]:
        own = []
        if "minItems" in schema:
            own.append(said(F.size(rows) < schema["minItems"], f"fewer than {schema['minItems']} items"))
        if "maxItems" in schema:
            own.append(said(F.size(rows) > schema["maxItems"], f"more than {schema['maxItems']} items"))
        if "items" in schema:
            own.append(F.flatten(F.transform(rows, lambda x, i: defects(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
        return own

    def body(v: Column, kind: Column) -> Column:
        inner = []
        if "enum" in schema:
            inner.append(said((kind != "VOID") & ~F.coalesce(_text(v).isin(*map(str, schema["enum"])), F.lit(False)), "not an allowed value"))
        for word, test in (("minimum", lambda n: _number(v) < n), ("maximum", lambda n: _number(v) > n)):
            if word in schema:
                inner.append(said(kind.isin(*_NUMBERS) & test(F.lit(float(schema[word]))), f"beyond the {word}"))
        if "pattern" in schema:
            inner.append(said((kind == "STRING") & ~F.rlike(_text(v), F.lit(schema["pattern"])), "not of the pattern"))
        if {"properties", "required", "additionalProperties"} & set(schema):
            own = _let(lambda members: F.concat(_texts(), *members_of(v, members)), members=F.try_variant_get(v, "$", "map<string,variant>"))
            inner.append(F.when(kind == "OBJECT", own).otherwise(_texts()))
        if {"items", "minItems", "maxItems"} & set(schema):
            own = _let(lambda rows: F.concat(_texts(), *items_of(rows)), rows=F.try_variant_get(v, "$", "array<variant>"))
            inner.append(F.when(kind == "ARRAY", own).otherwise(_texts()))
        found = F.concat(_texts(), *inner)
        if not types:
            return found
        right = F.lit(False)
        for name in types:
            right = right | _TYPES[name](kind, v)
        # what is of the wrong type breaks no other rule
        return F.when(right, found).otherwise(note(f"not {' or '.join(t for t in types if t != 'integer text')}"))

    return F.when(value.isNull(), note("missing")).otherwise(_let(body, v=value, kind=F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)))


def defects_of_text(text: Column, schema: dict, path: str = "$") -> Column:
    """The same for a JSON text; a text that is no JSON is one defect."""
    broken = F.when(text.isNull(), F.lit(f"{path}: missing")).otherwise(F.lit(f"{path}: not JSON"))
    return _let(lambda v: F.when(v.isNull(), _texts(broken)).otherwise(defects(v, schema, path)), v=F.try_parse_json(text))
