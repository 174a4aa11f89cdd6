"""Nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long hash string: the signs of its products with random
directions, orthogonal in turns so that they repeat each other as little as possible. A
tree is the sorted array of its strings; the vectors that share a prefix with a query
are one range of it. A search descends to the longest matches and then ascends in all
trees at once, one bit at a time, until the ranges hold enough candidates, which are
compared exactly. Inner products become angles by one more coordinate that gives all
vectors the same length.

The index is cut into blocks of bounded size, each with a forest of its own, and the
stated queries run against every block; a block keeps its best for each query.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    trees: int = 80
    bits: int = 16  #: length of a hash string
    share: float = 0.7  #: candidates to reach, as a share of a block's vectors (a vector counts once per tree)
    least: int = 2000  #: and at least so many
    index_block: int = 65_536  #: vectors of a block
    query_block: int = 1024
    seed: int = 11


def _directions(dim: int, s: Settings) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(s.seed))
    need, parts = s.trees * s.bits, []
    while need > 0:
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q[:, : min(dim, need)])
        need -= dim
    return np.concatenate(parts, axis=1)


class Forest:
    """Sorted hash strings of one block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, s: Settings):
        self.s, self.vectors = s, vectors
        self.directions = _directions(vectors.shape[1] + 1, s)
        rest = np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
        strings = self._strings(vectors, rest)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def _strings(self, vectors: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Hash strings as integers: one row per tree, one column per vector."""
        s = self.s
        out = np.zeros((s.trees, len(vectors)), np.int64)
        for low in range(0, len(vectors), 4096):
            signs = np.column_stack([vectors[low : low + 4096], rest[low : low + 4096]]) @ self.directions > 0
            for bit in range(s.bits):
                out[:, low : low + 4096] = out[:, low : low + 4096] * 2 + signs[:, bit :: s.bits].T
        return out

    def candidates(self, queries: np.ndarray):
        """For each query, the places of its candidates."""
        s = self.s
        strings = self._strings(queries, np.zeros(len(queries)))
        low = np.empty((s.trees, s.bits + 1, len(queries)), np.int32)
        high = np.empty_like(low)
        for tree in range(s.trees):
            for depth in range(s.bits + 1):
                first = strings[tree] >> (s.bits - depth) << (s.bits - depth)
                low[tree, depth] = np.searchsorted(self.sorted[tree], first)
                high[tree, depth] = np.searchsorted(self.sorted[tree], first + (1 << (s.bits - depth)))
        held = (high - low).sum(axis=0)
        enough = max(s.least, s.share * len(self.vectors))
        for k in range(len(queries)):
            depth = int(np.flatnonzero(held[:, k] >= min(enough, held[0, k]))[-1])
            mark = np.zeros(len(self.vectors), bool)
            for tree in range(s.trees):
                mark[self.order[tree, low[tree, depth, k] : high[tree, depth, k]]] = True
            yield np.flatnonzero(mark)


def _block_search(k: int, longest: float, s: Settings):
    """Best ``k`` of one block for one block of queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], values[order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, vectors = matrix(left)
        queries, asked = matrix(right)
        # copies of a vector have one place in the trees; of their ids only the k + 1 smallest can be among the nearest
        same = np.unique(vectors, axis=0, return_inverse=True)[1].reshape(-1)
        by = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(same[by]) > 0])
        forest = Forest(vectors[by[starts]], longest, s)
        ends = np.r_[starts[1:], len(by)]
        out: list[tuple] = []
        for query, vector, found in zip(queries, asked, forest.candidates(asked)):
            score = forest.vectors[found] @ vector
            if len(found) > k + 1:
                kth = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                near = score >= kth
                found, score = found[near], score[near]
            best = [(-x, int(i)) for f, x in zip(found, score) for i in ids[by[starts[f] : min(ends[f], starts[f] + k + 1)]] if i != query]
            out += [(int(query), i, -x) for x, i in sorted(best)[:k]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def _usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and no component null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, s: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query by inner product.

    ``is_query`` picks the queries among the rows; candidates are all rows but the
    query's own. Products are in double precision on the original vectors, ties go to the
    smaller ``vec_id``. Null, empty and zero vectors, vectors with a null or non-finite
    component, and rows without ``vec_id`` take no part. Vectors of each length have their
    own forests and are searched among themselves. Rows of one ``vec_id`` and length count
    once, with the smallest of its vectors. Other columns play no part; an empty table
    gives no rows.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    good = vectors.filter(F.col("vec_id").isNotNull()).withColumn("_query", is_query).select("vec_id", "_query", doubles.alias("v")).filter(_usable(F.col("v")))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # a table of embeddings has few lengths: one per model
    shapes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(size).alias("m")).orderBy("dim").collect()
    found = [_of_length(good, r.dim, r.n, math.sqrt(r.m), k, s) for r in shapes] or [_of_length(good, 0, 0, 0.0, k, s)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = functools.reduce(DataFrame.unionByName, found)
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(good: DataFrame, dim: int, n: int, longest: float, k: int, s: Settings) -> DataFrame:
    """The best found among vectors of one length, by block."""
    rows = good.filter(F.size("v") == dim).groupBy(F.col("vec_id").cast("bigint").alias("id")).agg(F.min("v").alias("v"), F.max("_query").alias("_query"))
    blocks = max(1, math.ceil(n / s.index_block))
    asked = rows.filter("_query").select("id", "v")
    groups = max(1, math.ceil(asked.count() / s.query_block))
    spread = lambda df, own, parts, other, others: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = spread(rows.select("id", "v"), "i", blocks, "j", groups).select(F.col("i").cast("int"), "j", "id", "v")
    right = spread(asked, "j", groups, "i", blocks).select("i", F.col("j").cast("int"), "id", "v")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_block_search(k, longest, s), "query_id bigint, vec_id bigint, score double")
