"""Registry tables (prices, gates, models) as small dimensions, with their own checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSET = "VERIFY"
#: Fixed price kinds.
PRICE_KINDS = ("input", "output", "cached_input")


def price_slots(book: DataFrame, keys=("model",)) -> DataFrame:
    """Wide price rows to one row per (model, kind)."""
    return book.unpivot(list(keys), list(PRICE_KINDS), "kind", "usd_per_1m")


def unverified_slots(slots: DataFrame) -> DataFrame:
    return slots.filter(F.col("usd_per_1m") == UNSET)


def book_is_verified(book: DataFrame, group: Column) -> DataFrame:
    """A book counts as verified when every row is stamped and no slot is unset."""
    unset = F.greatest(*[(F.col(k) == UNSET).cast("int") for k in PRICE_KINDS])
    return book.groupBy(group.alias("book")).agg(
        F.sum(F.coalesce(unset, F.lit(0))).cast("long").alias("rows_unset"),
        F.count(F.when(F.col("verified_on").isNull(), 1)).alias("rows_unstamped"),
    ).withColumn("verified", (F.col("rows_unset") == 0) & (F.col("rows_unstamped") == 0))


def uncited(book: DataFrame, citations: DataFrame) -> DataFrame:
    return book.select("model").join(citations, "model", "left_anti")


def stale_citations(book: DataFrame, citations: DataFrame) -> DataFrame:
    return citations.join(book, "model", "left_anti").select("model", "section")


def rate_lookup(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """Rate per (model, kind) with the reason where there is none; never a default."""
    known = slots.select("model", "kind", "usd_per_1m", F.lit(True).alias("_known"))
    out = requests.join(known, ["model", "kind"], "left")
    reason = (
        F.when(F.col("_known").isNull(), F.lit("unknown model or kind"))
        .when(F.col("usd_per_1m").isNull(), F.lit("no rate stated"))
        .when(F.col("usd_per_1m") == UNSET, F.lit("rate not verified"))
    )
    return out.withColumns({"rate": F.col("usd_per_1m").try_cast("double"), "reject": reason}).drop("usd_per_1m", "_known")


def verdict_defects(verdicts: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates that a verdict rule names and nobody declares: ``verdict``, ``role`` (quality or blocking), ``gate``, ``defect``.

    ``verdicts`` has ``verdict`` and the arrays ``quality`` and ``blocking`` of gate names.
    """
    named = verdicts.select("verdict", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("names")) for r in ("quality", "blocking")])).alias("g"))
    rows = named.select("verdict", F.col("g.role").alias("role"), F.explode("g.names").alias("gate"))
    return rows.join(gates.select("gate").distinct(), "gate", "left_anti").select(
        "verdict", "role", "gate", F.concat(F.lit("verdicts."), "verdict", F.lit("."), "role", F.lit(" names no declared gate: "), "gate").alias("defect"))


def gate_defects(gates: DataFrame, sentinels: DataFrame) -> DataFrame:
    """Gates without exactly one bound, and bounds naming an undeclared sentinel."""
    both, none = F.col("min_bound").isNotNull() & F.col("max_bound").isNotNull(), F.coalesce("min_bound", "max_bound").isNull()
    bound = F.coalesce("min_bound", "max_bound")
    named = gates.withColumn("_bound", bound).withColumn("_number", bound.try_cast("double"))
    declared = sentinels.select(F.col("sentinel").alias("_bound"), F.lit(True).alias("_declared"))
    defect = (
        F.when(both, F.lit("two bounds")).when(none, F.lit("no bound"))
        .when(F.col("_number").isNull() & F.col("_declared").isNull(), F.concat(F.lit("unknown sentinel "), "_bound"))
    )
    return (
        named.join(declared, "_bound", "left").withColumn("defect", defect)
        .filter("defect is not null").select("gate", "defect")
    )
