"""Exact substring dedup by hash-compared suffix sorting.

Sorting every suffix of a corpus is more than the question needs: whether a string of
``length`` bytes also starts elsewhere. Each such window picks one anchor in itself (the
place of the least hash of a shorter string), equal windows pick the same, and so only
suffixes at anchors with equal strings have to be compared. An anchor stands for the run
of windows that picked it; they cover its chunk. Chunks that occur twice are duplicates
whole. Where different chunks share an anchor string, their suffixes from the anchor on,
and their reversed prefixes up to it, are merge-sorted: two suffixes are compared by a
binary search for their common extension over prefix polynomial hashes, which the bytes
then verify. The common extensions of neighbours in both orders say which windows are equal.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armparity.llm.common import checkpointed, fingerprint

LENGTH = 400
ANCHOR = 128  #: bytes of an anchor string
SLICE = 1 << 21  #: bytes hashed at a time
#: Distinct chunks of one anchor sorted in a task; the windows of larger groups are counted by their hashes instead.
GROUP = 2048

#: Chunks of one anchor that are compared pair by pair from their sorted order; more go through the windows one by one.
PAIRS = 48

_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.Generator(np.random.PCG64(400)).integers(0, 1 << 64, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix, the empty one first: letter i times base**i, modulo 2**64."""
    powers, _ = _powers(max(len(data), 1024))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers[: len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of texts that stand one after the other in ``data``, each ending at one of ``ends``.

    Returns place, first and last window start, and hash of the anchor string.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n, span = len(data), length - size + 1
    if n < length:
        return none
    hashed = prefix_hashes(data)
    _, inverse = _powers(max(n, 1024))
    key = (hashed[size:] - hashed[:-size]) * inverse[: n - size + 1]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    mask = np.uint64((1 << 22) - 1)
    order = (key & ~mask) | np.arange(len(key), dtype=np.uint64)  # least hash, of equals the leftmost
    blocks = -(-len(order) // span) + 1
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    table = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    # windows that run over the end of a text are none
    valid = np.ones(windows, bool)
    for end in ends[ends < n]:
        valid[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    place = (least[starts] & mask).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(starts) != 1)])
    last = np.r_[first[1:], len(starts)] - 1
    return place[first], starts[first], starts[last], key[place[first]]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """Texts of a batch, some at a time: bytes, ends of the texts, and (row, place of the first byte in its text).

    A long text comes in slices that overlap by a window less a byte.
    """
    held: list[bytes] = []
    rows: list[tuple[int, int]] = []
    size = 0
    for row, value in enumerate(batch.column(column)):
        text = value.as_py() or b""
        for low in range(0, max(1, len(text) - LENGTH + 1), SLICE - LENGTH):
            part = text[low : low + SLICE]
            if len(part) < LENGTH:
                continue
            if size + len(part) > SLICE and held:
                yield b"".join(held), np.cumsum([len(h) for h in held]), rows
                held, rows, size = [], [], 0
            held.append(part[: SLICE - 1])
            rows.append((row, low))
            size += len(held[-1])
    if held:
        yield b"".join(held), np.cumsum([len(h) for h in held]), rows


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """One row per anchor: its string's hash, its chunk's 128-bit hash, document, place, first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, rows in _groups(batch, 2):
                place, low, high, key = anchors(np.frombuffer(data, np.uint8), ends)
                if not len(place):
                    continue
                of = np.searchsorted(ends, place, side="right")
                starts = np.r_[0, ends[:-1]]
                digests = [xxhash.xxh3_128_intdigest(data[a : b + LENGTH]) for a, b in zip(low.tolist(), high.tolist())]
                shift = np.array([at for _, at in rows])[of] - starts[of]
                row = pa.array(np.array([r for r, _ in rows])[of], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array([_signed(d >> 64) for d in digests], pa.int64()), pa.array([_signed(d & (1 << 64) - 1) for d in digests], pa.int64()),
                     batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x + shift, pa.int64()) for x in (place, low, high))],
                    names=["a", "c1", "c2", "k1", "k2", "p", "lo", "hi"])

    return texts.mapInArrow(run, "a bigint, c1 bigint, c2 bigint, k1 bigint, k2 bigint, p bigint, lo bigint, hi bigint")


class _Sorted:
    """Strings in suffix order with the common extensions of neighbours."""

    def __init__(self, parts: list[bytes]):
        self.parts = parts
        self.hashes = [prefix_hashes(np.frombuffer(p, np.uint8)).tolist() for p in parts]
        order = sorted(range(len(parts)), key=functools.cmp_to_key(self._compare))
        self.rank = np.empty(len(parts), np.int64)
        self.rank[order] = np.arange(len(parts))
        self.common = np.array([self.extension(x, y) for x, y in zip(order, order[1:])], np.int64)

    def extension(self, x: int, y: int) -> int:
        """Length of the common prefix: binary search over the hashes, verified by the bytes."""
        a, b, p, q = self.hashes[x], self.hashes[y], self.parts[x], self.parts[y]
        low, high = 0, min(len(p), len(q))
        if a[high] == b[high]:
            low = high
        while low < high:
            mid = (low + high + 1) // 2
            if a[mid] == b[mid]:
                low = mid
            else:
                high = mid - 1
        while p[:low] != q[:low]:  # hashes that collided: the bytes decide
            low -= 1
        return low

    def _compare(self, x: int, y: int) -> int:
        n = self.extension(x, y)
        p, q = self.parts[x], self.parts[y]
        return p[n] - q[n] if n < len(p) and n < len(q) else len(p) - len(q)

    def pairs(self) -> np.ndarray:
        """Common extension of every two strings: the least of the neighbours' between them in suffix order."""
        n = len(self.parts)
        out = np.zeros((n, n), np.int64)
        for k in range(n - 1):
            out[k, k + 1 :] = np.minimum.accumulate(self.common[k:])
        return np.maximum(out, out.T)[np.ix_(self.rank, self.rank)]

    def classes(self, length: int) -> np.ndarray:
        """A number per string, equal for those that share their first ``length`` bytes."""
        return np.r_[0, np.cumsum(self.common < length)][self.rank]


def equal_windows(chunks: list[bytes], places: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each of some distinct chunks with the same anchor string: runs of window starts that another chunk has too.

    ``places`` say where in its chunk the anchor is; starts count from the chunk's first byte.
    """
    right = _Sorted([c[p:] for c, p in zip(chunks, places)])
    left = _Sorted([c[:p][::-1] for c, p in zip(chunks, places)])
    at, sizes = np.array(places), np.array([len(c) for c in chunks])
    found = [np.zeros(n - length + 1, bool) for n in sizes]
    if len(chunks) <= PAIRS:
        # of two chunks the equal windows are one run, given by how far they agree on either side of the anchor
        ahead, behind = right.pairs(), left.pairs()
        for x in range(len(chunks)):
            for y in range(x):
                for k, other in ((x, y), (y, x)):
                    lo = max(int(at[k] - behind[x, y]), 0)
                    hi = min(int(at[k] + ahead[x, y]), int(sizes[k])) - length
                    # a window counts where both chunks have it
                    lo, hi = max(lo, int(at[k] - at[other])), min(hi, int(at[k] - at[other] + sizes[other] - length))
                    if lo <= hi:
                        found[k][lo : hi + 1] = True
        return [_runs(f) for f in found]
    # a window that starts ``back`` before the anchor is the last ``back`` bytes up to it and the first ``length - back`` from it
    first, last = at - (sizes - length), at
    for back in range(max(0, int(first.min())), int(last.max()) + 1):
        here = np.flatnonzero((first <= back) & (back <= last))
        if len(here) < 2:
            continue
        both = right.classes(length - back)[here] * len(chunks) + left.classes(back)[here]
        _, where, count = np.unique(both, return_inverse=True, return_counts=True)
        for k in here[count[where] > 1]:
            found[k][at[k] - back] = True
    return [_runs(f) for f in found]


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of marks."""
    edges = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _sorted_groups(chunks: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``lo``, ``hi``: windows of the chunks that occur once which another chunk of their anchor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        where = None

        def done() -> Iterator[pa.RecordBatch]:
            rows = []
            if len(held) > 1 and any(h[5] for h in held):
                for (k1, k2, at, _, _, once), runs in zip(held, equal_windows([h[3] for h in held], [h[4] for h in held])):
                    rows += [(k1, k2, at + a, at + b) for a, b in runs] if once else []
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["k1", "k2", "lo", "hi"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for a, *row in zip(*columns):
                if a != where:
                    yield from done()
                    where = a
                held.append(tuple(row))
        yield from done()

    ordered = chunks.select("a", "k1", "k2", "lo", "bytes", "place", "once").repartition("a").sortWithinPartitions("a")
    return ordered.mapInArrow(run, "k1 bigint, k2 bigint, lo bigint, hi bigint")


def _counted_windows(chunks: DataFrame) -> DataFrame:
    """The same for anchors with too many chunks for one task: windows are counted by a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, lo, data, once in zip(*(batch.column(k).to_pylist() for k in range(5))):
                digests = [xxhash.xxh3_128_intdigest(data[i : i + LENGTH]) for i in range(len(data) - LENGTH + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_signed(d >> 64) for d in digests], pa.int64()), pa.array([_signed(d & (1 << 64) - 1) for d in digests], pa.int64()),
                     pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int64()), pa.array([once] * n, pa.bool_())],
                    names=["w1", "w2", "k1", "k2", "at", "once"])

    windows = chunks.select("k1", "k2", "lo", "bytes", "once").mapInArrow(run, "w1 bigint, w2 bigint, k1 bigint, k2 bigint, at bigint, once boolean")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    return windows.filter("once").join(twice, ["w1", "w2"]).select("k1", "k2", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeated_windows(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``k1``, ``k2`` (fingerprint of id and text), ``lo``, ``hi``: window starts (bytes) whose string also starts elsewhere."""
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("binary").alias("data")).filter(F.length("data") >= LENGTH)
    found = _anchor_rows(texts)
    shared = found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    found = checkpointed(found.join(shared, "a"))
    me = F.struct("k1", "k2", "p", "lo", "hi")
    chunks = checkpointed(found.groupBy("a", "c1", "c2").agg(F.count("*").alias("n"), F.min(me).alias("me")))
    whole = found.join(chunks.filter("n > 1").select("a", "c1", "c2"), ["a", "c1", "c2"]).select("k1", "k2", "lo", "hi")
    # anchors with several chunks, one of which at least is found once
    mixed = chunks.groupBy("a").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("a", "m")
    wanted = chunks.join(mixed, "a").select("a", "m", (F.col("n") == 1).alias("once"), "me.*").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("a", "m", "once", "p", "lo", "hi")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, data, rows in zip(*(batch.column(k) for k in range(4))):
                data, rows, k1, k2 = data.as_py(), rows.as_py(), k1.as_py(), k2.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["a"] for r in rows], pa.int64()), pa.array([r["m"] for r in rows], pa.int64()), pa.array([k1] * len(rows), pa.int64()),
                     pa.array([k2] * len(rows), pa.int64()), pa.array([r["lo"] for r in rows], pa.int64()),
                     pa.array([data[r["lo"] : r["hi"] + LENGTH] for r in rows], pa.binary()), pa.array([r["p"] - r["lo"] for r in rows], pa.int64()),
                     pa.array([r["once"] for r in rows], pa.bool_())], names=["a", "m", "k1", "k2", "lo", "bytes", "place", "once"])

    # rows that are repeated whole have no chunk that occurs once; one of each text is enough
    sources = texts.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "data", "wanted")
    pieces = checkpointed(sources.mapInArrow(cut, "a bigint, m bigint, k1 bigint, k2 bigint, lo bigint, bytes binary, place bigint, once boolean"))
    return whole.unionByName(_sorted_groups(pieces.filter(F.col("m") <= group))).unionByName(_counted_windows(pieces.filter(F.col("m") > group)))


def dedup_substrings(docs: DataFrame, group: int = GROUP, keep: bool = False) -> DataFrame:
    """What is left of each text without the bytes that a repeated 400-byte string covers: one row per input row.

    ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` over the remaining UTF-8 bytes; with ``keep`` also those bytes as
    ``kept``. Strings are judged on the input: every occurrence goes, overlapping and
    in one document too, but none crosses documents. Null texts count as empty;
    repeated rows are two documents with the same strings. Other columns play no part.
    """
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    narrow = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    spans = repeated_windows(docs, group).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = narrow.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for data, spans in zip(batch.column(1), batch.column(2)):
                data, spans = data.as_py(), spans.as_py()
                cover: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"] + LENGTH) for x in spans or ()):
                    if cover and lo <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], hi)
                    else:
                        cover.append([lo, hi])
                left = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in cover)], [*(a for a, _ in cover), len(data)])) if cover else data
                sizes.append(len(data)), removed.append(len(data) - len(left)), runs.append(len(cover))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep else b"")
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep)
