"""Corpus building: allocation, sequences, rotation, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armparity.functions import payload as P
from armparity.functions.plan import filter_above
from armparity.operators import ranking as R


def allocate(totals: DataFrame, by, weights: list[tuple[str, float]], n: str = "n") -> DataFrame:
    """Split each row's ``n`` over the weighted buckets by largest remainder.

    The buckets are few and declared, so they are exploded; ties go to the earlier one.
    """
    plan = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(float(w)).alias("w"), F.lit(i).alias("ord")) for i, (b, w) in enumerate(weights)])
    rows = totals.select(*by, F.col(n).alias("_n"), F.inline(plan))
    exact = F.round(F.col("_n") * F.col("w"), 9)
    rows = rows.withColumns({"_whole": F.floor(exact), "_frac": F.round(exact - F.floor(exact), 9)})
    w = Window.partitionBy(*by)
    short = F.col("_n") - F.sum("_whole").over(w)
    rank = F.row_number().over(w.orderBy(F.col("_frac").desc(), "ord"))
    return rows.select(*by, "bucket", "ord", (F.col("_whole") + (rank <= short).cast("long")).alias("quota"))


def bucket_sequence(items: DataFrame, by, order_hash: Column, weights, ordinal: str = "item_id") -> DataFrame:
    """Each group's items in a seeded shuffle cut at the cumulative quotas: exactly on mix.

    Positions come from hash buckets, so no group is sorted in one task.
    """
    sizes = items.groupBy(*by).agg(F.count("*").alias("n"))
    quotas = allocate(sizes, by, weights)
    upto = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = quotas.withColumn("_end", F.sum("quota").over(upto)).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_end", "bucket"))).alias("_cuts"))
    ranked = hash_positions(items, by, order_hash)
    chosen = F.get(F.filter("_cuts", lambda c: F.col("position") < c["_end"]), F.lit(0))["bucket"]
    return ranked.join(F.broadcast(cuts), list(by)).withColumn("bucket", chosen).drop("_cuts")


def hash_positions(df: DataFrame, by, order_hash: Column, hex_digits: int = 3) -> DataFrame:
    """Zero-based position in a seeded shuffle of each group; hash prefixes are even buckets."""
    by = list(by)
    hashed = df.withColumn("_hash", order_hash).withColumn("_b", F.substring("_hash", 1, hex_digits))
    totals = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_t"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*by, "_b", (F.sum("_t").over(upto) - F.col("_t")).alias("_off"))
    inside = hashed.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_hash")))
    return inside.join(offsets, [*by, "_b"]).withColumn("position", F.col("_off") + F.col("_rn") - 1).drop("_b", "_off", "_rn", "_hash")


def mix_of(items: DataFrame, by, bucket: str = "bucket") -> DataFrame:
    """Observed share per bucket; the window runs over the bucket counts only."""
    counts = items.groupBy(*by, bucket).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def round_robin(positioned: DataFrame, templates: list[str], position: str = "position") -> DataFrame:
    names = F.array(*[F.lit(t) for t in templates])
    return positioned.withColumn("template", F.element_at(names, (F.col(position) % len(templates) + 1).cast("int")))


def deal_topics(positioned: DataFrame, topics: list[str], seed: int, position: str = "position") -> DataFrame:
    """Deal a shuffled deck, reshuffled each full cycle: no topic repeats before all are used.

    The deck of a row's cycle is sorted inside the row, so no join or window is needed.
    """
    k = len(topics)
    cycle = F.floor(F.col(position) / k)
    deck = F.array_sort(F.transform(F.array(*[F.lit(t) for t in topics]), lambda t: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_cycle").cast("string"), t)).alias("h"), t.alias("t"))))
    return positioned.withColumn("_cycle", cycle).withColumn(
        "topic", F.element_at(deck, (F.col(position) % k + 1).cast("int"))["t"]).withColumnRenamed("_cycle", "cycle")


def stratified_quotas(items: DataFrame, strata, size: int) -> DataFrame:
    """Exact share of ``size`` per stratum by largest remainder, ties by name.

    One row per stratum; the unpartitioned window runs over those rows only.
    """
    counts = items.groupBy(*strata).agg(F.count("*").alias("_c"))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("_c").over(everything)
    want = F.least(F.lit(max(size, 0)), total)
    rows = counts.withColumns({"_n": total, "_want": want}).withColumn("_whole", F.floor(F.col("_c") * F.col("_want") / F.col("_n")))
    remainder = (F.col("_c") * F.col("_want")) % F.col("_n")
    rank = F.row_number().over(everything.orderBy(remainder.desc(), *strata))
    return rows.select(*strata, (F.col("_whole") + (rank <= F.col("_want") - F.sum("_whole").over(everything)).cast("long")).alias("_quota"))


def stratified_sample(items: DataFrame, strata, size: int, key: str, seed: int) -> DataFrame:
    """Exactly ``size`` rows keeping the strata's shares, the same for a seed on any layout."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return R.lowest_by_hash(items, strata, stratified_quotas(items, strata, size), order)


def mark_core(items: DataFrame, strata, size: int, key: str, seed: int) -> DataFrame:
    """Marks exactly ``size`` core rows; a core larger than the items is an error."""
    have = items.count()
    if not 0 <= size <= have:
        raise ValueError(f"a core of {size} cannot be taken from {have} items")
    picked = stratified_sample(items, strata, size, key, seed).select(key, F.lit(True).alias("_in"))
    return items.join(picked, key, "left").withColumn("is_core", F.coalesce("_in", F.lit(False))).drop("_in")


def first_per_task(items: DataFrame, n: int, by=("task",), order=None) -> DataFrame:
    """Core rows first, then the rest in file order, ``n`` per task; ranked before the shuffle too."""
    order = order or (F.col("core").desc(), F.col("item_id"))
    w = Window.partitionBy(*by).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def split_filter(items: DataFrame, split: str, by=("task",)) -> DataFrame:
    """``core`` rows, or all rows of a task with no core row; one small flag per task."""
    if split == "all":
        return items
    flags = items.groupBy(*by).agg(F.bool_or("core").alias("_any"))
    return items.join(F.broadcast(flags), list(by)).filter(F.col("core") | ~F.col("_any")).drop("_any")


def eligible_pool(items: DataFrame, judged: DataFrame) -> DataFrame:
    """Items in the split the first judge scored; two different splits for a task is an error."""
    splits = judged.groupBy("task").agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.raise_error(F.concat(F.lit("two judged splits for "), "task")).cast("string"))
    return items.join(F.broadcast(splits.select("task", one.alias("_split"))), "task").filter((F.col("_split") == "all") | F.col("core")).drop("_split")


def systematic_sample(pool: DataFrame, by, ordinal: str, size: int, seed: int) -> DataFrame:
    """Every stride-th row from an offset, wrapping once around; the whole pool if it is small."""
    placed = R.positions(pool, by, ordinal)
    n = F.col("group_size")
    stride = F.greatest(F.lit(1), F.floor(n / size))
    step = F.pmod(F.col("position") - F.pmod(F.lit(seed), n), n)
    chosen = (n <= size) | ((F.pmod(step, stride) == 0) & (step / stride < size))
    return placed.filter(chosen).drop("position", "group_size")


def training_rows(sample: DataFrame, calls: DataFrame) -> DataFrame:
    """Sampled items with their recorded answer, or the reason they are skipped."""
    joined = sample.join(calls, "item_id", "left")
    answer = F.coalesce("payload_json", "output_text")
    reason = (
        F.when(F.col("status").isNull(), F.lit("not recorded")).when(F.col("status") != "ok", F.lit("the recorded call failed"))
        .when(F.coalesce(F.trim(answer), F.lit("")) == "", F.lit("nothing to learn from")))
    return joined.select("item_id", "task", F.when(reason.isNull(), answer).alias("answer"), reason.alias("skipped"))


def contamination(examples: DataFrame, scored: DataFrame) -> DataFrame:
    """Items quoted as examples that are also scored: one row each, flagged and not removed."""
    return examples.join(scored.select("task", "item_id"), ["task", "item_id"], "left_semi")


def contract_defects(items: DataFrame) -> DataFrame:
    """Row integrity: a known task, gold that satisfies its schema, unique ids, citations within the supplied chunks, three to five criteria.

    ``items`` has ``task``, ``gold`` (a JSON text), ``rubric_ids`` and ``chunk_ids``. The
    chunks that gold cites are judged once the gold itself is sound.
    """
    points = F.try_variant_get(F.try_parse_json("gold"), "$.key_points", "array<struct<chunk_ids:array<string>>>")
    none = F.array().cast("array<string>")
    cited = F.coalesce(F.flatten(F.transform(points, lambda x: F.coalesce(x["chunk_ids"], none))), none)
    items = items.withColumns({"_cited": cited, "_gold": F.array_join(P.gold_defects(F.col("task"), F.col("gold")), "; ")})
    checks = [
        F.col("_gold"),
        F.when(F.size(F.array_distinct("rubric_ids")) != F.size("rubric_ids"), F.lit("duplicate rubric id")),
        F.when(F.size(F.array_distinct("chunk_ids")) != F.size("chunk_ids"), F.lit("duplicate chunk id")),
        F.when((F.col("_gold") == "") & (F.size(F.array_except("_cited", "chunk_ids")) > 0), F.lit("gold cites an unknown chunk")),
        F.when(~F.size("rubric_ids").between(3, 5), F.lit("rubric needs three to five criteria")),
    ]
    found = items.withColumn("defects", F.concat_ws("; ", *[F.nullif(c, F.lit("")) for c in checks])).drop("_cited", "_gold")
    return filter_above(found, F.col("defects") != "")


def context_chunks(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("] "), c["text"]))


def registry_gaps(templates: DataFrame, tasks: list[str], buckets: list[str]) -> DataFrame:
    """(task, bucket) pairs without a template; both lists are declared and few."""
    grid = templates.sparkSession.createDataFrame([(t, b) for t in tasks for b in buckets], "task string, bucket string")
    return grid.join(templates, ["task", "bucket"], "left_anti")


def duplicate_ids(templates: DataFrame) -> DataFrame:
    return templates.groupBy("template_id").agg(F.count("*").alias("n")).filter("n > 1")


def lineage(items: DataFrame, by, columns) -> DataFrame:
    """Distinct seeds, versions and provenances; more than one is reported.

    The sets hold configuration values, not rows, and stay as short as the configuration.
    """
    sets = items.groupBy(*by).agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns])
    mixed = reduce(lambda a, b: a | b, [F.size(c) > 1 for c in columns])
    return sets.withColumn("mixed", mixed).withColumns({c: F.array_join(c, "/") for c in columns})
