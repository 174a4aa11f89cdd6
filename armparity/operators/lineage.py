"""Fingerprints of stores that do not depend on order and add up.

A row's digest gives two numbers below 2**60; a store's fingerprint is how many rows it
has and the sums of both numbers modulo 2**60. Sums come out the same for any order and
partitioning, keep repeated rows apart from single ones, and the fingerprint of a store
and of what is appended to it add up to that of both, so an append reads its own rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MODULUS = 1 << 60


def _row_text(columns: list[str]) -> Column:
    """One text per row: each value with its length before it, so that no two rows share one; null is not an empty text."""
    parts = []
    for c in columns:
        value = F.col(c).cast("string")
        parts.append(F.when(value.isNull(), F.lit("~")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value)))
    return F.concat(*parts)


def fingerprint(rows: DataFrame, by, columns: list[str]) -> DataFrame:
    """Per group ``n``, ``sum_a``, ``sum_b`` over the given columns (text, whole numbers or booleans)."""
    digest = F.md5(_row_text(columns).cast("binary"))
    halves = rows.select(*by, *[F.conv(F.substring(digest, p, 15), 16, 10).cast("decimal(38,0)").alias(name) for name, p in (("_a", 1), ("_b", 16))])
    return _wrapped(halves.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")), by)


def merge(fingerprints: DataFrame, by) -> DataFrame:
    """Fingerprints of parts (one row each) added up per group."""
    return _wrapped(fingerprints.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.col(f"sum_{c}").cast("decimal(38,0)")).alias(f"_{c}") for c in "ab"]), by)


def _wrapped(sums: DataFrame, by) -> DataFrame:
    return sums.select(*by, F.col("n").cast("long").alias("n"), *[F.pmod(F.col(f"_{c}"), F.lit(_MODULUS).cast("decimal(38,0)")).cast("long").alias(f"sum_{c}") for c in "ab"])


def text(n: Column, a: Column, b: Column) -> Column:
    """A fingerprint in one word, ``rows-hash``."""
    return F.concat(n.cast("string"), F.lit("-"), *[F.lower(F.lpad(F.hex(x), 15, "0")) for x in (a, b)])


def banner(calls: DataFrame, items: DataFrame, prints: DataFrame, by=("task",)) -> DataFrame:
    """What a report rests on, per group: calls and models, recording window, seeds and generator versions of its items, and the store's fingerprint."""
    from armparity.operators import frames

    shown = prints.select(*by, text(F.col("n"), F.col("sum_a"), F.col("sum_b")).alias("_print"))
    # the sets hold configuration values and are as short as the configuration
    made = items.groupBy(*by).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "/").alias(f"_{c}") for c in ("seed", "generator_version")])
    out = frames.lineage_banner(calls, by).join(made, list(by), "left").join(shown, list(by), "left")
    return out.select(*by, F.concat(F.col("banner"), F.lit("; seeds "), F.coalesce("_seed", F.lit("not recorded")), F.lit("; generator "), F.coalesce("_generator_version", F.lit("not recorded")),
                                    F.lit("; store "), F.coalesce("_print", F.lit("not fingerprinted"))).alias("banner"))
