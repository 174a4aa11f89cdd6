"""Near-duplicate join on word n-grams: MinHash LSH forest, then exact verification.

Each tree of the forest is a trie of MinHash signatures. A document matches others by
its prefix in the trie; the prefix is shortened, from the full depth on, until the
chance that two documents at the threshold share one in some tree reaches the target
recall. That depth depends on the threshold and the number of trees only, so it is set
before any data is read and no trie is built: documents are grouped by equal prefixes of
that depth (MinHash banding), which Spark does for all trees at once. Documents that meet form candidate groups; within a group
every two texts are compared exactly, block against block, and counted where they are:
no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armparity.llm.common import checkpointed, fingerprint, fresh, tidy, words_of
from armparity.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 40, 12, 0.99999
#: Texts in a block of the exact comparison; a task holds two blocks of shingles at a time.
BLOCK = 128
_ODD = np.random.Generator(np.random.PCG64(20_250_101)).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a text of fewer words is one n-gram, one without words none."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    grams = {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    found = np.fromiter((xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) for g in grams), np.uint64, len(grams))
    return np.unique(found)


def prefix_depth(threshold: float, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Prefix length at which the ascent ends: the longest that finds two texts at the threshold with the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("too few trees for this recall")


def _prefixes(found: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One 64-bit key per tree: the hash of its first ``depth`` MinHash values."""
    odd = _ODD[: trees * depth]
    low = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 2048):  # bounds the table of a very long text
        mixed = found[k : k + 2048, None] * odd[None, :]
        mixed ^= mixed >> np.uint64(29)
        np.minimum(low, mixed.min(axis=0), out=low)
    keys = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.reshape(trees, depth).T:
        keys = (keys ^ column) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _signatures(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (row), ``s1``, ``s2`` (n-gram set; null without words), ``keys`` per tree."""
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, keys = [], [], []
            for value in batch.column(3):
                found = shingles(value.as_py(), words)
                if not len(found):
                    s1.append(None), s2.append(None), keys.append(None)
                    continue
                h = xxhash.xxh3_128_intdigest(found.tobytes())
                s1.append(_signed(h >> 64)), s2.append(_signed(h & (1 << 64) - 1))
                keys.append(_prefixes(found, trees, depth).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "s1", "s2", "keys"])

    return narrow.mapInArrow(tidy(run), "doc_id bigint, k1 bigint, k2 bigint, s1 bigint, s2 bigint, keys array<bigint>")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, held = np.unique(values, return_inverse=True, return_counts=True)
    shared = held[place] > 1
    out = np.zeros((len(sets), len(sets)), np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    if shared.any():
        _, column = np.unique(place[shared], return_inverse=True)
        owner = owner[shared]
        both = np.zeros((len(sets), len(sets)))
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, int(column[-1]) + 1, 8192):  # bounds the dense table
            a, b = np.searchsorted(column, [low, low + 8192])
            table = np.zeros((len(sets), 8192), np.float32)
            table[owner[a:b], column[a:b] - low] = 1
            both += table @ table.T
        np.fill_diagonal(both, np.diag(out))
        out = np.rint(both).astype(np.int64)
    return out


def _compare(ids: list[int], sides: list[int], copies: list[int], sets: list[np.ndarray], within: bool, ratio: Fraction) -> list[tuple[int, int, int]]:
    """For each text of one block pair: its id, the rows it links to, and the least id it is linked with here."""
    common, size = _common(sets), np.array([len(s) for s in sets])
    union = size[:, None] + size[None, :] - common
    linked = common * ratio.denominator >= union * ratio.numerator
    np.fill_diagonal(linked, False)
    if not within:
        side = np.array(sides)
        linked &= side[:, None] != side[None, :]
    counts = linked @ np.array(copies, np.int64)
    hub = list(range(len(ids)))

    def root(x: int) -> int:
        while hub[x] != x:
            hub[x] = hub[hub[x]]
            x = hub[x]
        return x

    for x, y in zip(*np.nonzero(np.triu(linked))):
        a, b = root(int(x)), root(int(y))
        if ids[a] > ids[b]:
            a, b = b, a
        hub[b] = a
    return [(ids[i], int(counts[i]), ids[root(i)]) for i in range(len(ids)) if counts[i]]


def _verified(members: DataFrame, words: int, ratio: Fraction) -> DataFrame:
    """``id``, ``links``, ``hub`` from the block pairs of the candidate groups."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(v.as_py(), words).view(np.int64) for v in batch.column(4)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], names=["id", "component", "blocks", "copies", "grams"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        where = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, sides, copies, sets = zip(*held)
                rows = _compare(list(ids), list(sides), list(copies), list(sets), where[1] == where[2], ratio)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "links", "hub"])
            held.clear()

        for batch in batches:
            component, i, j, ids, side, copies = (batch.column(k).to_pylist() for k in range(6))
            grams = batch.column(6)
            for r in range(batch.num_rows):
                if (component[r], i[r], j[r]) != where:
                    yield from done()
                    where = (component[r], i[r], j[r])
                held.append((ids[r], side[r], copies[r], grams[r].values.to_numpy(zero_copy_only=False).view(np.uint64)))
        yield from done()

    grams = members.select("id", "component", "blocks", "copies", "text").mapInArrow(
        tidy(hashed), "id bigint, component bigint, blocks int, copies bigint, grams array<bigint>")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = (grams.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", F.col("own").alias("side"), "copies", "grams"))
    return (spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
            .mapInArrow(tidy(compared), "id bigint, links bigint, hub bigint"))


def _linked(docs: DataFrame, threshold: float, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their n-gram set, and sets with id, copies, links and class (``low``, the row that stands for it)."""
    depth = prefix_depth(threshold)
    rows = checkpointed(_signatures(docs, words, TREES, depth))
    me = F.struct("doc_id", "k1", "k2")
    sets = checkpointed(
        rows.filter("s1 is not null").groupBy("s1", "s2").agg(F.min(me).alias("low"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
        .withColumn("id", F.monotonically_increasing_id()))
    # one level of the tries: documents with the same key share the prefix of that tree
    leaves = sets.select("id", F.explode("keys").alias("key"))
    hubs = leaves.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    met = leaves.join(hubs, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    groups = checkpointed(components(met))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chosen = groups.join(sizes, "component").join(sets.select("id", "low", "copies"), "id")
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").alias("text"))
    members = chosen.select("id", "component", "blocks", "copies", F.col("low.k1").alias("k1"), F.col("low.k2").alias("k2")).join(texts, ["k1", "k2"])
    # a row that is repeated whole has the same key twice; one of its texts is enough
    members = members.groupBy("k1", "k2", "id", "component", "blocks", "copies").agg(F.first("text").alias("text"))
    found = checkpointed(_verified(members, words, Fraction(threshold).limit_denominator(10_000)))
    classes = components(found.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    placed = sets.select("id", "s1", "s2", "low", "copies").join(classes, "id", "left").join(links, "id", "left").select(
        "s1", "s2", "low", F.coalesce("component", "id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    lowest = placed.groupBy("class").agg(F.min("low").alias("lowest"))
    return rows, placed.join(lowest, "class").select("s1", "s2", "links", "lowest")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links``: one row per input row.

    Two rows are linked if the Jaccard similarity of their n-gram sets is at least
    ``threshold``; rows with equal sets (copies, also of one ``doc_id``) are linked.
    ``n_links`` counts the other rows linked to a row, ``class_id`` is the smallest
    ``doc_id`` of those it reaches over links (nulls first, so null where one has none).
    Null, empty and blank texts have no n-grams and no links, and are their own class.
    Other columns play no part.
    """
    rows, classes = _linked(docs, threshold, words)
    return rows.join(classes, ["s1", "s2"], "left").select(
        "doc_id", F.when(F.col("lowest").isNull(), F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row of each class of near-duplicates, the one with the smallest ``doc_id``, with all columns of ``docs``.

    Of several rows with that id, the one with the lowest fingerprint of id and text
    stays; which of wholly repeated rows stays is left open. Rows without words all stay.
    """
    rows, classes = _linked(docs, threshold, words)
    a, b = fresh(docs, "k1", "k2")
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    chosen = classes.select(F.col("lowest.k1").alias(a), F.col("lowest.k2").alias(b)).distinct()
    keyed = docs.withColumns({a: k1, b: k2})
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = keyed.filter(~wordless).join(chosen, [a, b], "left_semi").dropDuplicates([a, b])
    return kept.unionByName(keyed.filter(wordless)).select(*[F.col(f"`{c}`") for c in docs.columns])
