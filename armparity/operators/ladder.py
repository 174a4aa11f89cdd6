"""Ladder of rungs: current records, wide form, comparison with the incumbent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_records(records: DataFrame, by=("task",)) -> DataFrame:
    """Last measured record per (rung, split); unmeasured only if never measured.

    ``first_seen`` keeps the order in which rungs appeared.
    """
    key = [*by, "rung"]
    rest = [c for c in records.columns if c not in key]
    measured = F.col("status") == "measured"
    slot = F.when(measured, F.coalesce("split", F.lit("")))
    last = records.groupBy(*key, slot.alias("_slot")).agg(
        F.max_by(F.struct(*rest), F.col("ordinal")).alias("_r"), F.min("ordinal").alias("_first"))
    w = Window.partitionBy(*key)
    ranked = last.withColumns({"first_seen": F.min("_first").over(w), "_any": F.count("_slot").over(w) > 0})
    return ranked.filter(F.col("_slot").isNotNull() | ~F.col("_any")).select(*key, "_r.*", "first_seen")


def wide(records: DataFrame, metrics: DataFrame, names: list[str], by=("task", "rung", "split")) -> DataFrame:
    """One column per named metric beside each current record."""
    cols = metrics.groupBy(*by).pivot("metric", names).agg(F.first("value"))
    return records.join(cols, list(by), "left")


def versus_incumbent(records: DataFrame, incumbent: str, by=("task", "split")) -> DataFrame:
    """Each rung against the incumbent on its own split: interval against point."""
    base = records.filter(F.col("rung") == incumbent).select(*by, F.col("point").alias("incumbent_point"))
    out = records.join(base, list(by), "left")
    mark = (
        F.when(F.col("incumbent_point").isNull(), F.lit("no incumbent on this split")).when(F.col("rung") == incumbent, F.lit("incumbent"))
        .when(F.col("lo").isNull(), F.lit("—")).when(F.col("lo") > F.col("incumbent_point"), F.lit("clears"))
        .when(F.col("hi") < F.col("incumbent_point"), F.lit("below")).otherwise(F.lit("parity")))
    return out.withColumn("versus", mark)


def selection_rows(ladder: DataFrame, gated: DataFrame) -> DataFrame:
    return ladder.withColumn("origin", F.lit("ladder")).unionByName(gated.withColumn("origin", F.lit("gated")), allowMissingColumns=True)


def ship_arms(records: DataFrame, choice: DataFrame) -> DataFrame:
    """The chosen rung per task, or why it cannot ship."""
    have = records.select("task", "rung", "status", "point")
    out = choice.join(have, ["task", "rung"], "left")
    return out.withColumn("reject", F.when(F.col("status").isNull(), "no such rung").when(F.col("status") != "measured", "never measured"))


def append_records(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Prior records with the new ones behind them; a version other than the log's is an error."""
    versions = prior.groupBy("task").agg(F.max("version").alias("_v"))
    wrong = F.raise_error(F.concat(F.lit("version mismatch for "), "task")).cast("string")
    checked = new.join(F.broadcast(versions), "task", "left").withColumn(
        "version", F.when(F.col("_v").isNotNull() & (F.col("_v") != F.col("version")), wrong).otherwise(F.col("version"))).drop("_v")
    return prior.unionByName(checked)


def preferred(artifacts: DataFrame, preference: list[str], by=("task",)) -> DataFrame:
    """One artifact per task by the given order of preference, newest within a kind."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("kind"))
    rest = [c for c in artifacts.columns if c not in by]
    best = artifacts.filter(rank > 0).groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(rank, -F.col("ordinal"))).alias("_r"))
    return best.select(*by, "_r.*")
