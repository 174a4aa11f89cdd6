"""Rungs as rows: a rung names the one it builds on and states only what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.operators.bootstrap import null_safe_on


def register(rungs: DataFrame, new: DataFrame, tasks: list[str]) -> DataFrame:
    """``rungs`` (``task``, ``rung``, ``parent``, ``settings``) with the ``new`` ones behind them.

    A task that is none of ``tasks`` and a rung that a task has already are errors.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown task "), F.coalesce("task", F.lit("null")))).cast("string")
    both = rungs.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    counts = both.groupBy("task", "rung").agg(F.count("*").alias("_n"))
    checked = both.alias("x").join(counts.alias("y"), null_safe_on(["task", "rung"])).select("x.*", "_n")
    twice = F.raise_error(F.concat(F.lit("rung registered twice: "), "task", F.lit("/"), "rung")).cast("string")
    return checked.select(
        F.when((F.col("_new") == 1) & ~F.coalesce(F.col("task").isin(*tasks), F.lit(False)), unknown).otherwise(F.col("task")).alias("task"),
        F.when(F.col("_n") > 1, twice).otherwise(F.col("rung")).alias("rung"), "parent", "settings")


def resolve(rungs: DataFrame) -> DataFrame:
    """Every rung with the settings it ends up with: ``task``, ``rung``, ``parent``, ``settings``, ``path`` from its root, ``depth``.

    A recursive query walks down from the rungs without a parent, a level at a time; a
    setting of a rung hides the same one above it. A rung that no root leads to builds on
    one that is not there or, in a circle, on itself, and is an error.
    """
    spark = rungs.sparkSession
    walked = spark.sql("""
        WITH RECURSIVE walk(task, rung, parent, settings, path, depth) AS (
          SELECT task, rung, parent, settings, array(rung), 0 FROM {rungs} WHERE parent IS NULL
          UNION ALL
          SELECT c.task, c.rung, c.parent, map_from_entries(concat(filter(map_entries(w.settings), e -> NOT array_contains(map_keys(c.settings), e.key)), map_entries(c.settings))),
                 array_append(w.path, c.rung), w.depth + 1
          FROM {rungs} c JOIN walk w ON c.task = w.task AND c.parent = w.rung)
        SELECT * FROM walk""", rungs=rungs)
    lost = F.raise_error(F.concat(F.lit("no root above rung "), F.col("x.task"), F.lit("/"), F.col("x.rung"))).cast("int")
    found = rungs.select("task", "rung").alias("x").join(walked.alias("y"), null_safe_on(["task", "rung"]), "left")
    return found.select(F.col("x.task").alias("task"), F.col("x.rung").alias("rung"), "parent", "settings", "path", F.when(F.col("y.depth").isNull(), lost).otherwise(F.col("y.depth")).alias("depth"))


def candidate_arms(records: DataFrame, choice: DataFrame, baselines: DataFrame) -> DataFrame:
    """What a candidate is scored on: per task of ``choice`` the baseline arm and its chosen rung, nothing between.

    ``choice`` has ``task``, ``rung`` and the ``variant`` that ships; ``records`` have
    ``variant``, ``status``, ``n``, ``point``, ``recorded_from`` and ``recorded_to``, and
    ``baselines`` the same without ``rung`` and ``status``. A rung that is absent, was never
    measured or runs another variant, and a task without a baseline arm, are errors. The
    window of all arms is the union of both recordings.
    """
    def must(test: Column, value: Column, why: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{why}: "), F.col("task"), F.lit("/"), F.col("rung"))).cast("string"))

    arm = ["n", "point", "recorded_from", "recorded_to"]
    base = baselines.select("task", F.lit(True).alias("_base")).distinct()
    found = choice.select("task", "rung", F.col("variant").alias("_ships")).join(records.select("task", "rung", "variant", "status", *arm), ["task", "rung"], "left").join(base, "task", "left")
    task = must(F.col("status").isNotNull(), F.col("task"), "no such rung")
    measured = must(F.col("status") == "measured", F.col("rung"), "never measured")
    variant = must(F.col("variant") == F.col("_ships"), F.col("variant"), "another variant ships")
    origin = must(F.col("_base"), F.lit("candidate"), "no baseline arm to compare with")
    shipped = found.select(task.alias("task"), origin.alias("arm"), F.concat(measured, F.lit(" "), variant).alias("variant"), *arm)
    kept = baselines.join(choice.select("task"), "task", "left_semi").select("task", F.lit("baseline").alias("arm"), "variant", *arm)
    arms = kept.unionByName(shipped)
    window = arms.agg(F.min("recorded_from").alias("window_from"), F.max("recorded_to").alias("window_to"))
    return arms.crossJoin(F.broadcast(window))
