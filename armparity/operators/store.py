"""The call store: keep-latest index, lookups, miss reasons, recording windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("task", "model", "input_sha")


def keep_latest(calls: DataFrame, key=KEY, ordinal: str = "ordinal") -> DataFrame:
    """One row per key, the last recorded one; partial aggregation before the shuffle."""
    rest = [c for c in calls.columns if c not in key]
    latest = F.max_by(F.struct(*rest), F.col(ordinal)).alias("_row")
    return calls.groupBy(*key).agg(latest).select(*key, "_row.*")


def lookup(requests: DataFrame, store: DataFrame, key=KEY) -> DataFrame:
    """Each request with its recording; ``found`` tells hits from misses."""
    index = keep_latest(store, key).withColumn("found", F.lit(True))
    return requests.join(index, list(key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def miss_reasons(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Why each missing request is missing: nothing recorded for the task, none for the
    model (with the models that are there), or the model on other inputs only.

    The two side tables hold one row per task and per (task, model).
    """
    misses = requests.join(store.select(*KEY).distinct(), list(KEY), "left_anti")
    by_model = store.groupBy("task", "model").agg(F.count("*").alias("n_model"))
    by_task = by_model.groupBy("task").agg(
        F.sum("n_model").alias("n_task"), F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models")
    )
    hint = (
        F.when(F.col("n_task").isNull(), F.lit("store has no recordings for this task"))
        .when(F.col("n_model").isNull(), F.concat(F.lit("no rows for this model; recorded: "), "models"))
        .otherwise(F.concat(F.lit("model recorded on "), F.col("n_model").cast("string"), F.lit(" other inputs")))
    )
    return misses.join(by_task, "task", "left").join(by_model, ["task", "model"], "left").select(
        *requests.columns, hint.alias("reason")
    )


def recording_window(calls: DataFrame, by=("task", "model"), ts: str = "ts") -> DataFrame:
    return calls.groupBy(*by).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_calls")
    )


def merge_windows(windows: DataFrame, by=()) -> DataFrame:
    """Union of windows; missing ends do not count."""
    return windows.groupBy(*by).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_calls").alias("n_calls")
    )


def build_calls(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Call records from requests and responses; no response makes an ``error`` row."""
    joined = requests.join(responses.withColumn("_got", F.lit(True)), key, "left")
    failed = F.col("_got").isNull() | F.col("response_error").isNotNull()
    reason = F.coalesce("response_error", F.when(F.col("_got").isNull(), F.lit("no response recorded")))
    return joined.withColumns(
        {"status": F.when(failed, F.lit("error")).otherwise(F.lit("ok")), "error": F.when(failed, reason)}
    ).drop("_got", "response_error")


def parse_volume(spec: Column) -> Column:
    """``TASK:CALLS[:IN:OUT]`` as a struct; null when the field count or a number is off."""
    parts = F.split(spec, ":")

    def number(i: int) -> Column:
        return F.when(F.rlike(F.trim(F.get(parts, F.lit(i))), F.lit("^[+-]?[0-9]+$")), F.get(parts, F.lit(i)).try_cast("long"))

    four = F.size(parts) == 4
    ok = F.size(parts).isin(2, 4) & number(1).isNotNull() & (~four | (number(2).isNotNull() & number(3).isNotNull()))
    return F.when(
        ok,
        F.struct(
            F.get(parts, F.lit(0)).alias("task"), number(1).alias("calls_per_day"),
            F.when(four, number(2)).alias("avg_in"), F.when(four, number(3)).alias("avg_out"),
        ),
    )
