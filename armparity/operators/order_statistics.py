"""Bootstrap intervals of percentiles by drawing order statistics.

The k-th smallest of n values drawn with replacement sits, in the sample's own order, at
the k-th smallest of n uniform numbers, which follows Beta(k, n - k + 1). So a replicate
of a percentile needs no redrawn sample: two neighbouring order statistics are drawn as
ranks, and the ranks are looked up in the sample. The law is that of the full redraw, the
cost per group is the number of replicates, whatever the number of rows.

Ranks are looked up without sorting a group in one place. Its distinct values are cut at
approximate quantiles into even buckets, bucket totals say which bucket holds a rank, and
only buckets with a rank in them are cut again; after the last round each bucket is
accumulated by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armparity.operators.bootstrap import RESAMPLES, _key, _mix, null_safe_on

#: Buckets per round and group, and rounds: a group of d distinct values ends in buckets of about d / BUCKETS**ROUNDS.
BUCKETS, ROUNDS = 64, 2


def draw_ranks(n: int, q: float, size: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Zero-based ranks, in a sample of ``n``, of the two order statistics that percentile ``q`` of a redrawn sample lies between."""
    k = int(np.floor(q * (n - 1))) + 1
    low = rng.beta(k, n - k + 1, size)
    # of the n - k values above the k-th, the least
    high = 1 - (1 - low) * rng.random(size) ** (1 / (n - k)) if k < n else low
    return tuple(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high))


def _ranks(totals: DataFrame, by: list[str], q: float, resamples: int, seed: int, chunk: int) -> DataFrame:
    """``replicate``, ``part`` (0 and 1) and ``rank`` of each group; replicate -1 is the sample itself."""
    spread = totals.withColumn("_part", F.explode(F.sequence(F.lit(-1), F.lit(-(-resamples // chunk) - 1))))
    out = T.StructType([*[totals.schema[c] for c in by], T.StructField("replicate", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                n, part, key = int(row[len(by)]), int(row[len(by) + 1]), [None if pd.isna(v) else v for v in row[: len(by)]]
                if part < 0:
                    low = np.array([np.floor(q * (n - 1))], np.int64)
                    ranks, first = (low, np.minimum(low + 1, n - 1)), -1
                else:
                    size = min(chunk, resamples - part * chunk)
                    ranks, first = draw_ranks(n, q, size, np.random.default_rng(_mix(seed, _key(key), part))), part * chunk
                both = pd.DataFrame({"replicate": np.tile(np.arange(len(ranks[0])) + first, 2), "part": np.repeat(np.array([0, 1], np.int32), len(ranks[0])), "rank": np.concatenate(ranks)})
                for i, name in enumerate(by):
                    both.insert(i, name, [key[i]] * len(both))
                yield both

    # groups may be few: their chunks are spread before they are drawn
    return spread.select(*by, "_n", "_part").repartition(*by, "_part").mapInPandas(run, out)


def _place(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def values_at(counts: DataFrame, ranks: DataFrame, by, value: str, buckets: int = BUCKETS, rounds: int = ROUNDS) -> DataFrame:
    """``ranks`` (keys, ``rank`` and other columns) with ``value``: what stands at that zero-based rank of the group.

    ``counts`` has the keys, distinct values and ``_c``, how often each occurs; a rank no
    row has is an error. Null keys are a group.
    """
    by = list(by)
    kept = [c for c in ranks.columns if c not in by]
    cells = counts.select(*by, F.col(value).alias("_v"), "_c").withColumn("_cell", F.lit(0).cast("long"))
    asked = ranks.withColumns({"_cell": F.lit(0).cast("long"), "_rank": F.col("rank")})
    keys = [*by, "_cell"]
    for _ in range(rounds):
        cuts = cells.groupBy(*keys).agg(F.percentile_approx("_v", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("_cuts"))
        placed = cells.alias("x").join(cuts.alias("y"), null_safe_on(keys)).select(
            *[F.col(f"x.{c}") for c in keys], "_v", "_c", _place(F.col("_cuts"), F.col("_v")).alias("_b"))
        totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"))
        upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        starts = totals.withColumn("_start", F.sum("_t").over(upto) - F.col("_t"))
        # at most one entry per bucket
        table = starts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_start", "_b"))).alias("_table"))
        hit = F.element_at(F.filter("_table", lambda s: s["_start"] <= F.col("_rank")), -1)
        found = asked.alias("x").join(table.alias("y"), null_safe_on(keys)).select(*[F.col(f"x.{c}") for c in keys], *kept, "_rank", hit.alias("_hit")).select(
            *by, *kept, F.col("_cell") * buckets + F.col("_hit._b"), F.col("_rank") - F.col("_hit._start")).toDF(*by, *kept, "_cell", "_rank")
        wanted = found.select(*keys).distinct()
        narrowed = placed.select(*by, (F.col("_cell") * buckets + F.col("_b")).alias("_cell"), "_v", "_c")
        cells = narrowed.alias("x").join(wanted.alias("y"), null_safe_on(keys), "left_semi").select(*[F.col(f"x.{c}") for c in (*keys, "_v", "_c")])
        asked = found
    # each bucket's values and the ranks asked of it in one order: a rank takes the last value that starts at or before it
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    empty = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in kept]
    standing = cells.withColumn("_at", F.sum("_c").over(upto) - F.col("_c")).select(*keys, "_at", F.lit(0).alias("_kind"), F.struct("_v", (F.col("_at") + F.col("_c")).alias("_end")).alias("_s"), *empty)
    asking = asked.select(*keys, F.col("_rank").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(standing.schema["_s"].dataType).alias("_s"), *kept)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = standing.unionByName(asking).withColumn("_s", F.last("_s", ignorenulls=True).over(order)).filter("_kind = 1")
    sure = F.when(F.col("_at") < F.col("_s._end"), F.col("_s._v")).otherwise(F.raise_error(F.lit("a rank beyond its bucket")).cast(cells.schema["_v"].dataType))
    return read.select(*by, *kept, sure.alias(value))


def percentile_replicates(counts: DataFrame, by, value: str, q: float, resamples: int = RESAMPLES, seed: int = 20260801, chunk: int = 2000,
                          buckets: int = BUCKETS, rounds: int = ROUNDS) -> DataFrame:
    """``replicate``, ``stat``, ``n`` per group: percentile ``q`` of redrawn samples, interpolated between neighbouring ranks.

    ``counts`` has distinct values of any numeric type and ``_c``, how often each occurs.
    Replicate -1 is the sample's own percentile.
    """
    by = list(by)
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ranks = _ranks(totals, by, q, resamples, seed, chunk)
    found = values_at(counts, ranks, by, value, buckets, rounds)
    pairs = found.groupBy(*by, "replicate").agg(*[F.max(F.when(F.col("part") == p, F.col(value).cast("double"))).alias(f"_x{p}") for p in (0, 1)])
    out = pairs.alias("x").join(totals.alias("y"), null_safe_on(by)).withColumn("_h", F.lit(float(q)) * (F.col("_n") - 1))
    stat = F.col("_x0") + (F.col("_h") - F.floor("_h")) * (F.col("_x1") - F.col("_x0"))
    return out.select(*[F.col(f"x.{c}") for c in by], "replicate", stat.alias("stat"), F.col("_n").alias("n"))
