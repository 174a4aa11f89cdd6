"""Order statistics and positions without putting one group into one task.

Groups here may hold a third of all rows, so ranks are found in two steps: count per
(group, bucket), accumulate the few bucket totals, then rank inside the buckets that
matter.  Buckets are many per group and bounded in number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts a group is cut into where each of its rows is joined to what is known of the group.
SALTS = 256


def _window(by, *order):
    return Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)


def value_counts(df: DataFrame, by, value: str) -> DataFrame:
    """One row per (group, value): a hot value becomes one row before any shuffle of values."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))


def percentiles_of_counts(counts: DataFrame, by, value: str, named: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles from value counts.

    For values of a small domain (whole milliseconds, token counts): the state per
    group is one entry per distinct value.  Use :func:`exact_percentiles` otherwise.
    """
    cols = [F.expr(f"percentile(`{value}`, {q}D, _c)").alias(name) for name, q in named.items()]
    return counts.groupBy(*by).agg(*cols)


def exact_percentiles(df: DataFrame, by, value: str, named: dict[str, float], accuracy: int = 20_000) -> DataFrame:
    """Exact interpolated percentiles of a continuous column for groups of any size.

    An approximate pass brackets each percentile within ``2 / accuracy`` of the rows; a
    second pass counts the values inside the bracket, and of those below and above only
    how many there are and which lies nearest. Interpolation needs two neighbouring
    ranks, and where the bracket is narrower than that (small groups) the nearest value
    outside is the other one. A bracket that misses both is an error. Rows meet their
    group's bracket in ``SALTS`` parts by value, so that no task sorts a whole group.
    """
    by = list(by)
    margin = 2.0 / accuracy
    probs = [p for q in named.values() for p in (max(0.0, q - margin), min(1.0, q + margin))]
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_x"))
    bounds = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.percentile_approx("_x", [float(p) for p in probs], accuracy).alias("_e"))
    asked = F.array(*[
        F.struct(F.lit(name).alias("_name"), F.lit(float(q)).alias("_q"), F.get("_e", F.lit(2 * i)).alias("_lo"), F.get("_e", F.lit(2 * i + 1)).alias("_hi"))
        for i, (name, q) in enumerate(named.items())])
    parts = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(SALTS)).cast("int")).join(parts, [*by, "_salt"]).select(*by, "_n", "_x", F.inline(asked))
    side = F.when(F.col("_x") < F.col("_lo"), -1).when(F.col("_x") > F.col("_hi"), 1).otherwise(0)
    counts = placed.withColumn("_side", side).groupBy(*by, "_n", "_name", "_q", "_side", F.when(F.col("_side") == 0, F.col("_x")).alias("_v")).agg(
        F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    upto = Window.partitionBy(*by, "_name").orderBy("_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_cum": F.sum("_c").over(upto), "_h": F.col("_q") * (F.col("_n") - 1)})
    inside, below, above = (F.col("_side") == k for k in (0, -1, 1))
    low, high = F.floor("_h"), F.ceil("_h")

    def at(rank: Column, name: str) -> list[Column]:
        return [F.min(F.when(inside & (F.col("_cum") > rank), F.col("_v"))).alias(f"_{name}")]

    found = ranked.groupBy(*by, "_name", "_h").agg(
        *at(low, "a"), *at(high, "b"), F.coalesce(F.max(F.when(below, F.col("_cum"))), F.lit(0)).alias("_below"), F.max(F.when(below, F.col("_most"))).alias("_before"),
        F.max(F.when(inside, F.col("_cum"))).alias("_upto"), F.min(F.when(above, F.col("_least"))).alias("_after"))

    def pick(rank: Column, name: str) -> Column:
        missed = F.raise_error(F.lit("percentile bracket missed its rank")).cast("double")
        return (F.when(rank == F.col("_below") - 1, F.col("_before")).when(rank == F.col("_upto"), F.col("_after"))
                .when((rank >= F.col("_below")) & (rank < F.col("_upto")), F.col(name)).otherwise(missed).cast("double"))

    a, b = pick(low, "_a"), pick(high, "_b")
    exact = found.withColumns({"_pa": a, "_pb": b}).withColumn("_p", F.col("_pa") + (F.col("_h") - F.floor("_h")) * (F.col("_pb") - F.col("_pa")))
    return exact.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, F.col("_p"))).alias(k) for k in named])


def lowest_by_hash(df: DataFrame, strata, quotas: DataFrame, order_hash: Column, hex_digits: int = 3) -> DataFrame:
    """The ``_quota`` rows of each stratum with the lowest hash.

    Hash prefixes are even buckets whatever the data looks like. Buckets wholly under
    the quota pass unsorted; only the one bucket the quota ends in is ranked.
    """
    strata = list(strata)
    hashed = df.withColumn("_hash", order_hash).withColumn("_b", F.substring("_hash", 1, hex_digits))
    totals = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_t"))
    upto = _window(strata, "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = totals.withColumn("_off", F.sum("_t").over(upto) - F.col("_t")).join(quotas.select(*strata, "_quota"), strata)
    plan = marked.filter("_off < _quota").select(
        *strata, "_b", (F.col("_quota") - F.col("_off")).alias("_room"), (F.col("_off") + F.col("_t") <= F.col("_quota")).alias("_all"))
    near = hashed.join(plan, [*strata, "_b"])
    edge = near.filter("not _all").withColumn("_rn", F.row_number().over(_window([*strata, "_b"], "_hash"))).filter("_rn <= _room").drop("_rn")
    return near.filter("_all").unionByName(edge).select(*df.columns)


def positions(df: DataFrame, by, ordinal: str, buckets: int = 4096) -> DataFrame:
    """Zero-based position of each row in its group by a numeric ordinal, and the group size.

    The ordinal is cut into equal ranges per group; ordinals of an append log are dense,
    so the ranges are even.
    """
    by = list(by)
    span = df.groupBy(*by).agg(F.min(ordinal).alias("_lo"), F.max(ordinal).alias("_hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / buckets))
    placed = df.join(span, by).withColumn("_b", F.floor((F.col(ordinal) - F.col("_lo")) / width)).drop("_lo", "_hi")
    totals = placed.groupBy(*by, "_b").agg(F.count("*").alias("_t"))
    upto = _window(by, "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*by, "_b", (F.sum("_t").over(upto) - F.col("_t")).alias("_off"),
                            F.sum("_t").over(Window.partitionBy(*by)).alias("group_size"))
    inside = placed.withColumn("_rn", F.row_number().over(_window([*by, "_b"], ordinal)))
    return inside.join(offsets, [*by, "_b"]).withColumn("position", F.col("_off") + F.col("_rn") - 1).drop("_b", "_off", "_rn")
