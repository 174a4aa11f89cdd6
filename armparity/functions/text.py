"""Text normalisation and comparison as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters whose full case fold differs from lower-casing (fixed values).
_FOLDS = (("ß", "ss"), ("ς", "σ"), ("ſ", "s"))


def casefold(col: Column) -> Column:
    return reduce(lambda c, f: F.replace(c, F.lit(f[0]), F.lit(f[1])), _FOLDS, F.lower(col))


def squeeze(col: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize_scalar(col: Column) -> Column:
    return casefold(squeeze(col))


def normalize_code(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, r"\s+", ""))


def normalize_set(values: Column, code: bool = False) -> Column:
    """Sorted distinct normal forms; null set is the empty set, null and '' drop out."""
    norm = normalize_code if code else normalize_scalar
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.transform(kept, norm)))


def normalize_by_kind(kind: Column, scalar: Column, members: Column) -> Column:
    """Normal form by field kind, as a sorted array so all kinds compare alike.

    ``scalar`` carries single values and ``members`` lists; a scalar given for a set
    kind counts as a one-element set.
    """
    as_set = F.when(members.isNull() & scalar.isNotNull(), F.array(scalar)).otherwise(members)
    return (
        F.when(kind == "code", F.array(normalize_code(scalar)))
        .when(kind == "scalar_set", normalize_set(as_set))
        .when(kind == "code_set", normalize_set(as_set, code=True))
        .otherwise(F.array(normalize_scalar(scalar)))
    )


def tokens(col: Column) -> Column:
    """Distinct lower-case alphanumeric words."""
    return F.array_distinct(F.regexp_extract_all(casefold(col), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(left_tokens: Column, right_tokens: Column) -> Column:
    """Overlap of two token sets; two empty sets agree fully."""
    union = F.size(F.array_union(left_tokens, right_tokens))
    shared = F.size(F.array_intersect(left_tokens, right_tokens))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.nullif(union, F.lit(0)))


def lexical_similarity(left: Column, right: Column) -> Column:
    return jaccard(tokens(left), tokens(right))


def truncate(col: Column, limit: int) -> Column:
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.substring(col, 1, limit - 1), F.lit("…")))


def one_line(col: Column, limit: int = 220) -> Column:
    """A table cell: one line, pipes escaped, cut with an ellipsis."""
    flat = F.replace(squeeze(col), F.lit("|"), F.lit("\\|"))
    return truncate(F.coalesce(flat, F.lit("")), limit)


def abbreviate(col: Column, limit: int = 60) -> Column:
    return truncate(squeeze(F.coalesce(col, F.lit("∅"))), limit)


def abbreviate_set(values: Column, limit: int = 60) -> Column:
    body = F.concat(F.lit("{"), F.array_join(F.array_sort(values), ", "), F.lit("}"))
    return truncate(squeeze(body), limit)


def error_kind(col: Column) -> Column:
    """The error's type: text before the first colon, 80 characters at most."""
    text = F.trim(F.coalesce(col, F.lit("unknown")))
    return F.substring(F.split_part(text, F.lit(":"), F.lit(1)), 1, 80)


#: Fixed patterns of the page normal form.
QUOTE_NOISE = "[\"'`‘’“”\\\\]|&quot;|&#3[49];|&rsquo;|&ldquo;|&rdquo;"
DASHES = "[-‐-―]|&mdash;|&ndash;"


def page_form(col: Column) -> Column:
    """Lower case, no quote marks, dashes as spaces, single spaces."""
    bare = F.regexp_replace(F.lower(col), QUOTE_NOISE, "")
    return squeeze(F.regexp_replace(bare, DASHES, " "))


#: Fixed patterns of the rewrite guard.
NUMBER = r"[0-9]+(?:[.,][0-9]+)*(?:[eE]-?[0-9]+)?"
UNIT_GLYPHS = "[µμ°²³⁻Ωωπ±×Å]"


def quantities(col: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col, F.lit(f"({NUMBER})"), F.lit(1))))


def unit_glyphs(col: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col, F.lit(f"({UNIT_GLYPHS})"), F.lit(1))))


def surface_violation(text: Column, original: Column, must_keep: Column, forbid: list[str]) -> Column:
    """First broken rule of a rewrite as ``kind: what``, or null.

    Kept words first, then forbidden patterns, then whatever either side has alone: numbers, then unit signs.
    """
    def named(kind: str, what: Column) -> Column:
        return F.concat(F.lit(f"{kind}: "), what)

    missing = F.filter(must_keep, lambda m: ~F.contains(F.lower(text), F.lower(m)))
    found = [named("lost word", F.try_element_at(missing, F.lit(1)))]
    found += [F.when(F.rlike(text, F.lit(p)), named("not allowed", F.regexp_substr(text, F.lit(p)))) for p in forbid]
    for kind, marks in (("number", quantities), ("unit sign", unit_glyphs)):
        for word, here, there in (("lost", original, text), ("new", text, original)):
            alone = F.array_sort(F.array_except(marks(here), marks(there)))
            found.append(named(f"{word} {kind}", F.try_element_at(alone, F.lit(1))))
    return F.coalesce(*found)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{name}}`` by the row's value; null when a value or name is missing."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value.cast("string"))
    return F.when(~F.rlike(out, F.lit(r"\{\{|\}\}")), out)


#: Fixed pattern of a stamp in UTC.
ISO_STAMP = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\+00:00|Z)\b"


def sgt_text(ts: Column) -> Column:
    """UTC timestamp as reader text in UTC+8, e.g. ``10 Aug 2026, 12:07 AM (SGT)``."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), "+08:00")
    return F.concat(F.date_format(local, "d MMM yyyy, h:mm a"), F.lit(" (SGT)"))


def sgt_window(start: Column, end: Column) -> Column:
    return F.concat(F.lit("Recorded "), sgt_text(start), F.lit(" → "), sgt_text(end))


def iso_stamps(body: Column) -> Column:
    """Sorted distinct UTC ISO timestamps stated in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(f"({ISO_STAMP})"), F.lit(1))))
