"""Bootstrap intervals for means, paired differences, ratios of sums and percentiles.

Two ways to draw, both deterministic in the seed and independent of partitioning:

``histogram_replicates``  the default. Values are counted first, then redrawn from the
                      counts: a multinomial draw, the law of drawing n items out of n.
                      Cost is distinct values x replicates, whatever the number of rows.
``hash_replicates``   Poisson(1) weights from md5 of (seed, block, item), which SQL can
                      repeat. Row-local and combined before the shuffle; cost is rows x
                      replicates. A replicate may draw no row at all (chance exp(-n)) and
                      then has no statistic.
``estimate``          point and percentile bounds over the replicates of each group.

Replicate -1 is the sample itself (weight 1 per row), so the point estimate, its n and
the dropped rows come out of the same pass as the interval.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RESAMPLES = 10_000
CONFIDENCE = 0.95

#: Poisson(1) cumulative probabilities on a 16-bit grid (fixed values).
POISSON_STEPS = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


#: What a 16-bit draw weighs: how many of the steps it reaches.
_WEIGHT_OF = np.searchsorted(np.array(POISSON_STEPS), np.arange(1 << 16), side="right").astype(np.uint8)

#: Groups a task adds up at once; what it holds of more is passed on.
HELD = 64


#: Weights drawn at a time, and replicates beyond which rows are dealt out by key first.
DRAWN, MANY = 1 << 21, 256

#: MD5's start, its rotations a round, and which word a step of a round reads.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_READS = ((1, 0), (5, 1), (3, 5), (7, 0))


def _block(texts: list[bytes], at: int) -> np.ndarray:
    """Texts of one length as MD5 blocks, zero but for the text at ``at``."""
    wide = np.zeros((len(texts), 64), np.uint8)
    wide[:, at:at + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return wide


def _md5(heads: list[bytes], keys: list[bytes]) -> np.ndarray:
    """MD5 of each key behind each head, (keys, heads, 16 bytes): heads of one length, keys of one length, one block together."""
    size = len(heads[0]) + len(keys[0])
    back = _block(keys, len(heads[0]))
    back[:, size], back[:, 56], back[:, 57] = 0x80, size * 8 & 255, size * 8 >> 8
    words = list(zip(_block(heads, 0).view("<u4").T[:, :, None], back.view("<u4").T))
    words = [[int(x.flat[0]) if (x == x.flat[0]).all() else x for x in pair] for pair in words]
    a, b, c, d = (np.full((len(heads), len(keys)), x, np.uint32) for x in _START)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        stage, (step, start) = i // 16, _READS[i // 16]
        if stage == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif stage == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif stage == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        constant = int(abs(math.sin(i + 1)) * 2**32)
        for word in words[(step * i + start) % 16]:
            if isinstance(word, int):
                constant += word
            else:
                t += word
        t += constant & 0xFFFFFFFF
        turn = _TURNS[stage][i % 4]
        np.left_shift(t, turn, out=u)
        t >>= 32 - turn
        t |= u
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    out = np.stack([x + np.uint32(start) for x, start in zip((a, b, c, d), _START)], axis=-1)
    return np.ascontiguousarray(out.transpose(1, 0, 2).astype("<u4", copy=False)).view(np.uint8)


def _by_length(texts: list[bytes]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        places.setdefault(len(text), []).append(i)
    return places


def _weights(keys: list[str], resamples: int, seed: int, first: int = 0) -> np.ndarray:
    """Poisson(1) weights from replicate ``first`` on (a multiple of 8), a row per key: eight 16-bit draws from each md5 of (seed, block, key)."""
    heads = [f"{seed}|{b}|".encode() for b in range(first // 8, -(-(first + resamples) // 8))]
    texts = [k.encode() for k in keys]
    out = np.empty((len(texts), len(heads), 8), np.uint8)
    for wide, columns in _by_length(heads).items():
        for length, places in _by_length(texts).items():
            for at in range(0, len(columns), 256):
                some = columns[at:at + 256]
                for begin in range(0, len(places), 64):
                    rows = places[begin:begin + 64]
                    if wide + length > 55:
                        # no room for the length in one block
                        digests = b"".join([hashlib.md5(heads[b] + texts[k], usedforsecurity=False).digest() for k in rows for b in some])
                    else:
                        digests = _md5([heads[b] for b in some], [texts[k] for k in rows]).tobytes()
                    # heads of one length are neighbours
                    out[rows, some[0]:some[-1] + 1] = _WEIGHT_OF[np.frombuffer(digests, ">u2")].reshape(len(rows), len(some), 8)
    return out.reshape(len(texts), -1)[:, :resamples]


def _weighted(rows: pa.RecordBatch, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the distinct keys in the first column, and which of them each row has; a null key has the empty text."""
    coded = rows.column(0).fill_null("").dictionary_encode()
    return _weights(coded.dictionary.to_pylist(), resamples, seed), coded.indices.to_numpy()


def _slices(batches: Iterator[pa.RecordBatch], resamples: int) -> Iterator[pa.RecordBatch]:
    """Batches of few enough rows for ``DRAWN`` weights."""
    size = max(1, DRAWN // resamples)
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _parts(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The groups of a batch, null keys among them, with their rows."""
    if not by:
        if batch.num_rows:
            yield (), np.arange(batch.num_rows)
        return
    code, parts = np.zeros(batch.num_rows, np.int64), []
    for name in by:
        coded = batch.column(name).dictionary_encode(null_encoding="encode")
        parts.append(coded.dictionary)
        code = code * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
        at, key = int(code[rows[0]]), []
        for part in reversed(parts):
            at, k = divmod(at, len(part))
            key.append(part[k])
        yield tuple(reversed(key)), rows


def _text_key(key: str) -> Column:
    return F.col(key).cast("string").alias("_key")


def hash_replicates(df: DataFrame, by, key: str, values, resamples: int = 200, seed: int = 20260801) -> DataFrame:
    """Per replicate: sum of weights ``sw`` and weighted sums ``s_<value>``.

    Rows with a null value are not drawn; replicate -1 counts them as ``dropped``. A key
    is hashed once in a batch, whatever number of groups it is in, and a task adds up
    what it sees of a group before anything is shuffled. For many replicates the rows of
    a key are brought together first, so a key is hashed about once and every core has keys.
    """
    by, values = list(by), list(values)
    names = ["sw", *[f"s_{v}" for v in values]]
    narrow = df.select(_text_key(key), *by, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    keys = [df.schema[c] for c in by]
    out = T.StructType([*keys, T.StructField("replicate", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("dropped", T.LongType())])
    arrow = to_arrow_schema(out)
    if resamples > MANY:
        narrow = narrow.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key").sortWithinPartitions("_key")

    def told(group: tuple, held: list) -> pa.RecordBatch:
        sums, lost, n = held
        # a group without a row to draw from has the sample only
        sums = sums if n else sums[:1]
        size, given = len(sums), n > 0
        return pa.RecordBatch.from_arrays(
            [*[pa.repeat(group[i], size).cast(arrow.field(i).type) for i in range(len(by))], pa.array(np.arange(-1, size - 1)), pa.array(sums[:, 0]),
             *[pa.array(sums[:, 1 + i]) if given else pa.nulls(size, pa.float64()) for i in range(len(values))],
             pa.array(np.r_[lost, np.zeros(size - 1, np.int64)])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in _slices(batches, resamples):
            x = np.stack([np.ones(batch.num_rows), *[batch.column(f"_v{i}").fill_null(0.0).to_numpy() for i in range(len(values))]], axis=1)
            used = np.logical_and.reduce([np.ones(batch.num_rows, bool), *[batch.column(f"_v{i}").is_valid().to_numpy(zero_copy_only=False) for i in range(len(values))]])
            weights, of = _weighted(batch, resamples, seed)
            for group, rows in _parts(batch, by):
                if group not in held and len(held) >= HELD:
                    first = next(iter(held))
                    yield told(first, held.pop(first))
                mine = held.setdefault(group, [np.zeros((resamples + 1, len(names))), 0, 0])
                drawn = rows[used[rows]]
                mine[0][0] += x[drawn].sum(axis=0)
                some, at = np.unique(of[drawn], return_inverse=True)
                summed = np.zeros((len(some), len(names)))
                np.add.at(summed, at, x[drawn])
                mine[0][1:] += (summed.T @ weights[some].astype(np.float64)).T
                mine[1] += len(rows) - len(drawn)
                mine[2] += len(drawn)
        for group, mine in held.items():
            yield told(group, mine)

    return narrow.mapInArrow(run, out).groupBy(*by, "replicate").agg(*[F.sum(n).alias(n) for n in names], F.sum("dropped").alias("dropped"))


def estimate(replicates: DataFrame, by, statistic: Column, confidence: float = CONFIDENCE) -> DataFrame:
    """``n, dropped, point, lo, hi, resamples`` per group, from at most ``resamples`` values each.

    Fewer than two rows give a point and no interval.
    """
    tail = (1 - confidence) / 2
    sample = F.col("replicate") == -1
    kept = ["replicate", "sw", "dropped", *[c for c in replicates.columns if c.startswith("s_")]]
    out = replicates.select(*by, *kept, statistic.alias("_stat")).groupBy(*by).agg(
        F.max(F.when(sample, F.col("sw"))).cast("long").alias("n"), F.max(F.when(sample, F.col("dropped"))).alias("dropped"),
        F.max(F.when(sample, F.col("_stat"))).alias("point"), F.count(F.when(~sample, F.col("_stat"))).alias("resamples"),
        F.percentile(F.when(~sample, F.col("_stat")), F.array(F.lit(tail), F.lit(1 - tail))).alias("_p"),
        *[F.max(F.when(sample, F.col(c))).alias(f"sum_{c[2:]}") for c in kept if c.startswith("s_")])
    enough = F.col("n") >= 2
    return out.withColumns({"lo": F.when(enough, F.col("_p")[0]), "hi": F.when(enough, F.col("_p")[1])}).drop("_p")


def interval(replicates: DataFrame, by, statistic: Column, confidence: float = CONFIDENCE) -> DataFrame:
    """The same for replicates that already are a statistic and carry their ``n``."""
    tail = (1 - confidence) / 2
    drawn = F.when(F.col("replicate") >= 0, statistic)
    out = replicates.groupBy(*by).agg(
        F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("_p"), F.count(drawn).alias("resamples"),
        F.max(F.when(F.col("replicate") == -1, statistic)).alias("point"), F.max(F.when(F.col("replicate") == -1, F.col("n"))).alias("n"))
    enough = F.col("n") >= 2
    return out.select(*by, "n", "point", F.when(enough, F.col("_p")[0]).alias("lo"), F.when(enough, F.col("_p")[1]).alias("hi"), "resamples")


def mean_stat(value: str) -> Column:
    return F.try_divide(F.col(f"s_{value}"), F.col("sw"))


def delta_stat(base: str, cand: str) -> Column:
    return F.try_divide(F.col(f"s_{cand}") - F.col(f"s_{base}"), F.col("sw"))


def savings_stat(base: str, cand: str) -> Column:
    """Percent saved; replicates with no baseline cost have no ratio."""
    return F.when(F.col(f"s_{base}") > 0, 100 * (F.col(f"s_{base}") - F.col(f"s_{cand}")) / F.col(f"s_{base}"))


def _mix(seed: int, *parts) -> list[int]:
    return [seed, *[hash_ & 0xFFFFFFFF for p in parts for hash_ in (int(p), int(p) >> 32)]]


#: Distinct values drawn together. More are cut into blocks: first the draws fall to the blocks, then to the values of each.
CELLS = 2048


def _key(row) -> int:
    """64 bits of a group's key values, the same on every worker."""
    return int.from_bytes(hashlib.blake2b(repr(tuple(row)).encode(), digest_size=8).digest(), "big")


def _redrawn(rng: np.random.Generator, totals: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the columns of ``x`` over ``totals[r]`` draws per replicate ``r``, row ``i`` drawn with weight ``c[i]``.

    Many draws of few values are a multinomial draw, few draws of many values are drawn one by one: one law.
    """
    if totals.sum() > 10 * len(c) * len(totals):
        return rng.multinomial(totals, c / c.sum()) @ x
    rows = np.repeat(np.arange(len(c)), c)
    drawn = rng.integers(0, len(rows), int(totals.sum()), dtype=np.uint32)
    picked = x[rows]
    # a replicate without a draw sums to 0, which reduceat does not say
    some = totals > 0
    out = np.zeros((len(totals), x.shape[1]))
    if some.any():
        starts = np.concatenate([[0], np.cumsum(totals[some])[:-1]])
        for i in range(x.shape[1]):
            out[some, i] = np.add.reduceat(np.ascontiguousarray(picked[:, i])[drawn], starts)
    return out


def histogram_replicates(df: DataFrame, by, values, resamples: int = RESAMPLES, seed: int = 20260801,
                         chunk: int = 500, cells: int = CELLS) -> DataFrame:
    """Replicates drawn from value counts; same columns as :func:`hash_replicates`.

    Every replicate draws as many rows as the sample has. A group with many distinct
    values is drawn block by block: how many draws a block gets is multinomial over the
    blocks, and given that, what they are is multinomial within it, so the law is the
    same whatever the number of blocks, and no task holds more than a block. A block is
    one row with its values and its draws of all replicates; a task adds up the blocks
    it sees before anything is shuffled.
    """
    by, values = list(by), list(values)
    hist = df.groupBy(*by, *[F.col(v).cast("double").alias(v) for v in values]).agg(F.count("*").alias("_c"))
    used = F.lit(True)
    for v in values:
        used = used & F.col(v).isNotNull()
    lost = hist.groupBy(*by).agg(F.sum(F.when(used, 0).otherwise(F.col("_c"))).alias("dropped"), F.sum(F.when(used, F.col("_c")).otherwise(0)).alias("_n"),
                                 F.ceil(F.count_if(used) / cells).cast("int").alias("_blocks"))
    marked = hist.filter(used).alias("x").join(lost.alias("y"), null_safe_on(by)).select(*[F.col(f"x.{c}") for c in by], *values, "_c", "_blocks")
    blocked = marked.withColumn("_b", F.pmod(F.xxhash64(*values), F.col("_blocks")).cast("int")).drop("_blocks")
    packed = blocked.groupBy(*by, "_b").agg(F.sort_array(F.collect_list(F.struct(*values, "_c"))).alias("_cells"))
    shares = blocked.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_b", "_bc"))).alias("_shares"))
    parts = shares.select(*by, F.col("_shares._b").alias("_bs"), F.col("_shares._bc").alias("_bcs"), F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // chunk) - 1))).alias("_part"))
    names = ["sw", *[f"s_{v}" for v in values]]
    keys = [df.schema[c] for c in by]
    per_block = T.StructType([*keys, T.StructField("_b", T.IntegerType()), T.StructField("_part", T.IntegerType()), T.StructField("_draws", T.ArrayType(T.LongType()))])
    out = T.StructType([*keys, T.StructField("replicate", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                key, (blocks, counts, part) = [None if pd.isna(v) else v for v in row[: len(by)]], row[len(by):]
                counts = np.asarray(counts)
                size = min(chunk, resamples - part * chunk)
                drawn = np.random.default_rng(_mix(seed, _key(key), part)).multinomial(counts.sum(), counts / counts.sum(), size=size)
                res = pd.DataFrame({"_b": np.asarray(blocks, np.int32), "_part": np.full(len(counts), part, np.int32), "_draws": list(drawn.T)})
                for i, name in enumerate(by):
                    res.insert(i, name, pd.Series([key[i]] * len(res), dtype=frame[name].dtype))
                yield res

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def told(key, sums) -> pd.DataFrame:
            res = pd.DataFrame({"replicate": np.arange(-1, resamples), **{n: sums[:, i] for i, n in enumerate(names)}})
            for i, name in enumerate(by):
                res.insert(i, name, [key[i]] * len(res))
            return res

        for frame in frames:
            for row in frame.itertuples(index=False):
                key = tuple(None if pd.isna(v) else v for v in row[: len(by)])
                block, draws, c, *xs = row[len(by):]
                c, x, draws = np.asarray(c, np.int64), np.stack([np.asarray(v, np.float64) for v in xs], axis=1), np.asarray(draws, np.int64)
                if key not in held and len(held) >= 16:
                    # groups may be many, what is held of them is bounded
                    first = next(iter(held))
                    yield told(first, held.pop(first))
                sums = held.setdefault(key, np.zeros((resamples + 1, len(names))))
                sums[0] += [c.sum(), *(c @ x)]
                rng = np.random.default_rng(_mix(seed, _key(key), block + 1, -1))
                for at in range(0, resamples, chunk):
                    totals = draws[at:at + chunk]
                    sums[1 + at:1 + at + len(totals), 0] += totals
                    sums[1 + at:1 + at + len(totals), 1:] += _redrawn(rng, totals, c, x)
        for key, sums in held.items():
            yield told(key, sums)

    # blocks are small rows with much work in each, so their partitions are not put together again
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(spread, *by, "_part").mapInPandas(deal, per_block)
    drawn = dealt.groupBy(*by, "_b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_draws"))), lambda d: d["_draws"])).alias("_draws"))
    work = packed.alias("x").join(drawn.alias("y"), null_safe_on([*by, "_b"])).select(
        *[F.col(f"x.{c}") for c in (*by, "_b")], "_draws", *[F.col(f"x._cells.{c}").alias(f"_v_{c}") for c in ("_c", *values)])
    sums = work.repartition(spread, *by, "_b").mapInPandas(draw, out).groupBy(*by, "replicate").agg(*[F.sum(n).alias(n) for n in names])
    # a group without a usable row still has its count of dropped ones
    empty = lost.filter("_n = 0").select(*by, F.lit(-1).cast("long").alias("replicate"), *[F.lit(0.0).alias(n) for n in names], "dropped")
    return sums.alias("x").join(lost.alias("y"), null_safe_on(by)).select(*[F.col(f"x.{c}") for c in by], "replicate", *names, "dropped").unionByName(empty)


def null_safe_on(by) -> Column:
    """Join condition over the keys of two frames aliased ``x`` and ``y``; null keys meet."""
    return functools.reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by], F.lit(True))


def hash_percentile_replicates(df: DataFrame, by, key: str, value: str, q: float, resamples: int, seed: int = 20260801) -> DataFrame:
    """Percentiles by hash weights: weighted counts per value and replicate, summed per batch before the shuffle, then a weighted percentile.

    Many replicates are counted in cells of values first (:func:`_ranked_replicates`).
    """
    by = list(by)
    narrow = df.filter(F.col(value).isNotNull()).select(_text_key(key), *by, F.col(value).alias("_value"))
    if resamples > MANY:
        return _ranked_replicates(narrow, by, q, resamples, seed)
    counted = T.StructType([*narrow.schema.fields[1:], T.StructField("_c", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, resamples):
            weights, of = _weighted(batch, resamples, seed)
            for group, rows in _parts(batch, by):
                coded = batch.column("_value").take(pa.array(rows)).dictionary_encode()
                place = coded.indices.to_numpy()
                order = np.argsort(place, kind="stable")
                starts = np.flatnonzero(np.diff(place[order], prepend=-1))
                # the sample first, then the replicates
                drawn = np.concatenate([np.ones((len(rows), 1), np.int64), weights[of[rows[order]]]], axis=1)
                sums = np.add.reduceat(drawn, starts, axis=0)
                size = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.repeat(group[i], size).cast(arrow.field(i).type) for i in range(len(by))], coded.dictionary.cast(arrow.field("_value").type),
                     pa.ListArray.from_arrays(np.arange(0, sums.size + 1, resamples + 1, dtype=np.int32), pa.array(sums.reshape(-1))).cast(arrow.field("_c").type)], schema=arrow)

    tall = narrow.mapInArrow(run, counted)
    sums = tall.groupBy(*by, "_value").agg(*[F.sum(F.col("_c")[i]).alias(f"_c{i}") for i in range(resamples + 1)])
    each = F.array(*[F.struct(F.lit(i - 1).cast("long").alias("replicate"), F.col(f"_c{i}").alias("_c")) for i in range(resamples + 1)])
    counts = sums.select(*by, "_value", F.inline(each)).filter(F.col("_c") > 0)
    return counts.groupBy(*by, "replicate").agg(
        F.percentile("_value", F.lit(q), F.col("_c")).alias("stat"), F.sum("_c").alias("n"))


#: Cells of values a percentile is looked for in: quarter by quarter closer to it, down to this many standard errors.
QUARTERS, ERRORS = 8, 6


def _ranked_replicates(narrow: DataFrame, by: list[str], q: float, resamples: int, seed: int, chunk: int = 1000) -> DataFrame:
    """Weighted percentiles without a count per value and replicate.

    The values of a group are cut into cells, narrow ones around the percentile. The
    weights of the cells say, replicate by replicate, in which cells the two ranks lie
    that the percentile stands between. The rows of those cells alone are weighted once
    more, in the order of their values. Any row may be in such a cell, so the result is
    exact whatever the values and keys are; few rows are, unless many share a key. A
    value that a cut falls on is a cell of its own, so no cell holds many rows of one value.
    The cuts come from one entry per distinct value of a group.
    """
    narrow = narrow.withColumn("_value", F.col("_value").cast("double"))
    counts = narrow.groupBy(*by, "_value").agg(F.count("*").alias("_c"))
    far = [(side * 4.0**-j) for side in (-q, 1 - q) for j in range(1, QUARTERS + 1)]
    cuts = counts.groupBy(*by).agg(F.percentile("_value", F.array(*[F.lit(q + f) for f in far]), F.col("_c")).alias("_at"), F.sum("_c").alias("_n"))
    least = F.lit(ERRORS * math.sqrt(q * (1 - q))) / F.sqrt("_n")
    cuts = cuts.select(*by, F.array_distinct(F.filter("_at", lambda e, i: F.get(F.array(*[F.lit(abs(f)) for f in far]), i) >= least)).alias("_at"))
    place = 2 * F.size(F.filter("_at", lambda e: e < F.col("_value"))) + F.array_contains("_at", F.col("_value")).cast("int")
    rows = narrow.alias("x").join(cuts.alias("y"), null_safe_on(by)).select(*[F.col(f"x.{c}") for c in (*by, "_key", "_value")], place.alias("_cell")).withColumn(
        "_cut", F.when(F.col("_cell") % 2 == 1, F.col("_value")))
    group = Window.partitionBy(*by, "replicate")
    weighed = hash_replicates(rows, [*by, "_cell", "_cut"], "_key", (), resamples, seed).withColumns({
        "_upto": F.sum("sw").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"), "n": F.sum("sw").over(group).cast("long")})
    at = F.lit(float(q)) * (F.col("n") - 1)
    start = F.col("_upto") - F.col("sw").cast("long")
    ranks = F.inline(F.array(*[F.struct(F.lit(i).alias("_side"), (r.cast("long") - start).alias("_rank")) for i, r in enumerate((F.floor(at), F.ceil(at)))]))
    asked = weighed.filter("n > 0").select(*by, "_cell", "_cut", "replicate", "n", "sw", F.floor(F.col("replicate") / chunk).cast("int").alias("_part"), ranks).filter("0 <= _rank and _rank < sw")
    cell = [*by, "_cell"]
    wanted = asked.filter("_cut is null").select(*cell).distinct()
    inside = rows.alias("x").join(wanted.alias("y"), null_safe_on(cell), "left_semi").groupBy(*cell, "_value", "_key").agg(F.count("*").alias("_c")).withColumn(
        "_part", F.explode(F.sequence(F.lit(-1), F.lit(-(-resamples // chunk) - 1))))
    out = asked.select(*by, "replicate", "n", "_side", F.col("_cut").alias("_value")).schema
    arrow = to_arrow_schema(out)

    def find(held: pa.Table, ranks: pa.Table) -> pa.Table:
        """The values at the ranks asked in a cell by one chunk of replicates."""
        if not ranks.num_rows:
            return arrow.empty_table()
        if not ranks["_cut"].null_count:
            return pa.table([ranks["_cut" if c == "_value" else c] for c in arrow.names], schema=arrow)
        held, part = held.sort_by("_value"), ranks["_part"][0].as_py()
        first, size = (part * chunk, min(chunk, resamples - part * chunk)) if part >= 0 else (-1, 1)
        keys, counted = held["_key"].fill_null("").to_pylist(), held["_c"].to_numpy()
        rank, of = ranks["_rank"].to_numpy(), ranks["replicate"].to_numpy() - first
        found, before, step = np.full(len(rank), -1), np.zeros(size, np.int64), max(1, DRAWN // 8 // size)
        for begin in range(0, len(keys), step):
            some = keys[begin:begin + step]
            drawn = _weights(some, size, seed, first) if part >= 0 else np.ones((len(some), 1), np.int64)
            upto = np.cumsum(drawn * counted[begin:begin + step, None], axis=0) + before
            now = (found < 0) & (upto[-1, of] > rank)
            found[now] = begin + (upto[:, of[now]] > rank[now]).argmax(axis=0)
            before = upto[-1]
        if (found < 0).any():
            raise ValueError("a rank beyond its cell")
        values = held["_value"].take(pa.array(found))
        return pa.table([ranks[c] if c != "_value" else values for c in arrow.names], schema=arrow)

    read = inside.groupBy(*cell, "_part").cogroup(asked.groupBy(*cell, "_part")).applyInArrow(find, out)
    sides = read.groupBy(*by, "replicate").agg(*[F.max(F.when(F.col("_side") == i, F.col("_value"))).alias(f"_x{i}") for i in (0, 1)], F.max("n").alias("n"))
    between = (F.ceil(at) - at) * F.col("_x0") + (at - F.floor(at)) * F.col("_x1")
    return sides.select(*by, "replicate", F.when(F.col("_x0") == F.col("_x1"), F.col("_x0")).otherwise(between).alias("stat"), "n")
