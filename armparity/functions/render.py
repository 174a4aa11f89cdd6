"""Report text: numbers in their own unit, absences said in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed report words.
NOT_MEASURED = "not measured"
EM_DASH = "—"
REGION_SPLIT = "region split: not comparable"

UNITS = ("fraction", "percentage_points", "percent", "ms", "usd", "tokens")


def _fixed(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def number_text(value: Column, unit: Column) -> Column:
    """A number in its unit; half-even on the exact binary value."""
    return (
        F.when(unit == "percentage_points", F.concat(_fixed(value, "+0.00;-0.00"), F.lit(" pp")))
        .when(unit == "percent", F.concat(_fixed(value, "0.0"), F.lit("%")))
        .when(unit == "ms", F.concat(_fixed(value, "#,##0"), F.lit(" ms")))
        .otherwise(_fixed(value, "0.000"))
    )


def estimate_text(point: Column, lo: Column, hi: Column, unit: Column) -> Column:
    """``0.957 [0.900, 1.000]``; a bare point when no interval; absence in words."""
    full = F.concat(
        number_text(point, unit), F.lit(" ["), number_text(lo, unit), F.lit(", "), number_text(hi, unit), F.lit("]")
    )
    return (
        F.when(point.isNull(), F.lit(NOT_MEASURED))
        .when(lo.isNull() | hi.isNull(), F.concat(_fixed(point, "0.000"), F.lit(" (no CI, n=1)")))
        .otherwise(full)
    )


def paired_delta_text(text: Column, paired_n: Column, dropped: Column) -> Column:
    return F.concat(
        text, F.lit(" (paired n="), paired_n.cast("string"),
        F.when(dropped > 0, F.concat(F.lit(", "), dropped.cast("string"), F.lit(" unpaired dropped"))).otherwise(F.lit("")),
        F.lit(")"),
    )


def cost_cell(prices_verified: Column, text: Column) -> Column:
    """A cost stays hidden while any price is unverified."""
    return F.when(~prices_verified, F.lit(f"{EM_DASH} (prices unverified)")).otherwise(
        F.coalesce(text, F.lit(NOT_MEASURED))
    )


def latency_cell(text: Column, same_region: Column, region: Column) -> Column:
    return F.when(
        same_region & text.isNotNull(), F.concat(text, F.lit(" (same-region probe, "), region, F.lit(")"))
    ).otherwise(F.lit(REGION_SPLIT))


def delta_failure_kind(lo: Column, hi: Column) -> Column:
    """Why a paired delta failed: a measured drop, or an interval spanning zero."""
    return F.when(hi < 0, F.lit("measured regression")).when(
        (lo <= 0) & (hi >= 0), F.lit("parity not demonstrated")
    )
