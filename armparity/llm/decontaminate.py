"""Benchmark decontamination by latent semantic retrieval.

Texts are coded by the words the benchmark has; other words cannot match. A randomised
SVD of the TF-IDF matrix of all passages of the corpus gives those words a latent
space: every task multiplies its passages with a random test matrix, the products are
summed over the cluster, and the small remainder is factored. The space is scaled by the
inverse singular values, else the language of a text outweighs what it says. Windows as
long as an item are then compared with the items by cosine in that space, and windows
near enough are checked word by word: a long enough common subsequence proves a copy, a
shorter one a paraphrase if the item's answer words are there too. An item of which a
text has too few words anywhere cannot pass the check, so it is left out of the search of
that text beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from armparity.llm.common import checkpointed, fingerprint, fresh, summed, tidy

_EDGES = ".,;:!?()[]{}<>\"'*%$&#-_/\\«»“”‘’…¿¡"


@dataclass(frozen=True)
class Settings:
    passage: int = 64  #: words of a passage of the SVD
    rank: int = 64
    extra: int = 8  #: test vectors beyond the rank
    cosine: float = 0.3  #: windows this near an item are checked
    copy: float = 0.8  #: share of an item's words in the common subsequence that proves a copy
    paraphrase: float = 0.6  #: the share that is enough where the answer words are there
    answer: float = 0.2  #: share of an item's distinct words that make its answer, the rarest
    answered: float = 0.5  #: share of the answer's words a paraphrase has to have
    least_words: int = 5  #: items of fewer words are found only as a whole text: inside another they say nothing
    block_chars: int = 16_000_000  #: characters of benchmark text searched at a time


def _lower(text: str | None) -> str:
    """A-Z lower-cased; bytes do that faster than a table of characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _words(text: str | None) -> list[str]:
    """Words without the punctuation at their edges, in lower case (A-Z)."""
    return [w for w in (x.strip(_EDGES) for x in _lower(text).split()) if w]


def lcs_length(item: dict[int, int], size: int, window: list[int]) -> int:
    """Longest common subsequence of an item (bit masks of its words' places) and a window, by bit-parallel rows."""
    full = (1 << size) - 1
    row = full
    for t in window:
        mask = item.get(t)
        if mask is not None:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _coded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, ``codes``: the words as unsigned 32-bit integers; 0 stands for any word the benchmark lacks."""
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    narrow = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            codes = []
            for value in batch.column(3):
                words = [x.strip(_EDGES) for x in _lower(value.as_py()).split()]
                codes.append(np.fromiter([get(w, 0) for w in words if w], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary())], names=["doc_id", "k1", "k2", "codes"])

    return narrow.mapInArrow(tidy(run), f"doc_id {dict(narrow.dtypes)['doc_id']}, k1 bigint, k2 bigint, codes binary")


def _passages(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Passages of a batch, a row of codes each in rising order, short ones filled up with 0."""
    parts = []
    for value in batch.column(0):
        c = np.frombuffer(value.as_buffer(), np.uint32)
        parts += [c, np.zeros(-len(c) % size, np.uint32)]
    rows = np.concatenate(parts or [np.zeros(0, np.uint32)]).reshape(-1, size)
    return np.sort(rows, axis=1)


def _terms(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, word (from 0) and count of each word of some passages, by passage."""
    first = rows > 0
    first[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    at = np.flatnonzero(first)
    passage = at // rows.shape[1]
    # a word's run ends where the next begins, or with its passage
    ends = np.minimum(np.r_[at[1:], rows.size], (passage + 1) * rows.shape[1])
    return passage, rows.reshape(-1)[at].astype(np.int64) - 1, ends - at


def _inverse_frequency(coded: DataFrame, v: int, s: Settings) -> np.ndarray:
    """IDF of the benchmark's words over all passages of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(v + 1)
        for batch in batches:
            rows = _passages(batch, s.passage)
            held[:v] += np.bincount(_terms(rows)[1], minlength=v)
            held[v] += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["key", "data"])

    rows = summed(coded.select("codes").mapInArrow(tidy(run), "key int, data binary")).collect()
    held = np.frombuffer(rows[0].data) if rows else np.zeros(v + 1)
    return np.log((held[v] + 1) / (held[:v] + 1)) + 1


def _latent(coded: DataFrame, idf: np.ndarray, s: Settings) -> np.ndarray:
    """Rows: the benchmark's words, already weighted, in the space of the leading right singular vectors.

    With A the unit-length TF-IDF passages and W the random test matrix, the cluster sums
    A'(A W); its leading left singular vectors span those of A.
    """
    v = len(idf)
    width = min(v, s.rank + s.extra)
    test = np.random.Generator(np.random.PCG64(7)).standard_normal((v, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((v, width))
        for batch in batches:
            rows = _passages(batch, s.passage)
            for low in range(0, len(rows), 1024):  # bounds the dense parts
                pp, cc, counts = _terms(rows[low : low + 1024])
                if not len(pp):
                    continue
                w = counts * idf[cc]
                w = w / np.sqrt(np.bincount(pp, weights=w * w))[pp]
                starts = np.flatnonzero(np.r_[True, np.diff(pp) > 0])
                dense = test.take(cc, axis=0)
                dense *= w[:, None]
                product = np.add.reduceat(dense, starts)  # A W, a row per passage
                back = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pp)]))
                # A' times that: the rows of a word together
                order = np.argsort(cc.astype(np.uint16) if v < 1 << 16 else cc, kind="stable")  # short keys are sorted by radix
                cc = cc[order]
                words = np.flatnonzero(np.r_[True, np.diff(cc) > 0])
                np.take(product, back[order], axis=0, out=dense)
                dense *= w[order][:, None]
                out[cc[words]] += np.add.reduceat(dense, words)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["key", "data"])

    rows = summed(coded.select("codes").mapInArrow(tidy(run), "key int, data binary"), 16).collect()
    sketch = np.frombuffer(rows[0].data).reshape(v, width) if rows else test
    left, size, _ = np.linalg.svd(sketch, full_matrices=False)
    keep = min(s.rank, int((size > 1e-9 * max(size[0], 1e-300)).sum()) or 1)
    return (left[:, :keep] * idf[:, None] * (size[0] / np.maximum(size[:keep], 1e-300))).astype(np.float32)


def _index(items: list[tuple[int, list[int]]], latent: np.ndarray, idf: np.ndarray, s: Settings) -> dict:
    """Items by length class, and which words each has.

    A class has its window, its stride, and the items' places and unit vectors. ``start``,
    ``item`` and ``times`` list for each word the items that have it, and how often.
    """
    by: dict[int, list[int]] = {}
    checks, uses = [], []
    for k, (item_id, codes) in enumerate(items):
        by.setdefault(math.ceil(math.log(len(codes)) / math.log(1.25)), []).append(k)
        masks: dict[int, int] = {}
        for place, t in enumerate(codes):
            masks[t] = masks.get(t, 0) | 1 << place
        rare = sorted(masks, key=lambda t: (-idf[t - 1], t))[: max(1, math.ceil(s.answer * len(masks)))]
        checks.append((item_id, len(codes), masks, {t: m.bit_count() for t, m in masks.items()}, frozenset(rare)))
        uses += [(t, k, m.bit_count()) for t, m in masks.items()]
    classes = []
    for step, members in sorted(by.items()):
        upper = math.ceil(1.25**step)
        stride = max(1, upper // 2)
        vectors = np.stack([latent[np.array(items[k][1]) - 1].sum(axis=0) for k in members])
        norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        classes.append((upper + stride, stride, np.array(members), (vectors / norms).astype(np.float32)))
    uses.sort()
    words, item, times = (np.array(x, np.int64) for x in zip(*uses)) if uses else (np.zeros(0, np.int64),) * 3
    return {"classes": classes, "checks": checks, "start": np.searchsorted(words, np.arange(len(idf) + 2)), "item": item, "times": times,
            "need": np.array([s.paraphrase * c[1] for c in checks])}


def _possible(words: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's distinct words (rising): whether each item has enough of its words among them, and which words each item that has has."""
    first, count = index["start"][words], index["start"][words + 1] - index["start"][words]
    count = np.where(words > 0, count, 0)  # 0 is no word of an item
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    item = index["item"][at]
    enough = np.bincount(item, weights=index["times"][at], minlength=len(index["need"])) >= index["need"]
    hits, row = enough[item], np.cumsum(enough) - 1
    has = np.zeros((int(row[-1]) + 1 if len(row) else 0, len(words)), np.int32)
    if len(has):
        has[row[item[hits]], np.repeat(np.arange(len(words)), count)[hits]] = 1
    return enough, has


def _search_text(codes: np.ndarray, latent: np.ndarray, index: dict, s: Settings) -> dict[int, float]:
    """Items found in one text, each with the best share of its words in order."""
    found: dict[int, float] = {}
    words = np.unique(codes)
    possible, has = _possible(words, index)
    if not len(has):
        return found
    place, row, classes = np.searchsorted(words, codes), np.cumsum(possible) - 1, []
    for window, stride, members, vectors in index["classes"]:
        mine = possible[members]
        if mine.any():
            classes.append((window, stride, members[mine], vectors[mine], has[row[members[mine]]]))
    n, most = len(codes), max(c[0] for c in classes)
    for low in range(0, n, 20_000):  # bounds the running sums of a very long text
        part = codes[low : low + 20_000 + most]
        total = None
        for window, stride, members, vectors, own in classes:
            starts = np.arange(0, min(20_000, n - low), stride)
            ends = np.minimum(starts + window, len(part))
            # a window with too few words of an item cannot pass its check
            enough = np.zeros((len(starts), len(members)), bool)
            for k in range(0, len(members), 64):  # bounds the running counts
                held = np.zeros((len(own[k : k + 64]), len(part) + 1), np.int32)
                np.cumsum(own[k : k + 64][:, place[low : low + len(part)]], axis=1, out=held[:, 1:])
                enough[:, k : k + 64] = (held[:, ends] - held[:, starts] >= index["need"][members[k : k + 64], None]).T
            some = np.flatnonzero(enough.any(axis=1))
            if not len(some):
                continue
            if total is None:
                total = np.zeros((len(part) + 1, latent.shape[1]))
                known = part > 0
                total[1:][known] = latent[part[known] - 1]
                np.cumsum(total, axis=0, out=total)
            starts, ends = starts[some], ends[some]
            sums = (total[ends] - total[starts]).astype(np.float32)
            norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            near = (sums @ vectors.T >= s.cosine * np.maximum(norms, 1e-9)[:, None]) & enough[some]
            for w, k in zip(*np.nonzero(near)):
                item_id, size, masks, times, rare = index["checks"][members[k]]
                if found.get(item_id, 0.0) >= 1.0:
                    continue
                words = part[starts[w] : ends[w]].tolist()
                if sum(map(times.__getitem__, times.keys() & set(words))) < s.paraphrase * size:
                    continue
                share = lcs_length(masks, size, words) / size
                if share >= s.copy or share >= s.paraphrase and len(rare.intersection(words)) >= s.answered * len(rare):
                    found[item_id] = max(share, found.get(item_id, 0.0))
    return found


def _searched(docs: DataFrame, benchmark: DataFrame, s: Settings) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, ``items``, ``share``: one row per row of ``docs``."""
    given = benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & (F.length("text") > 0))
    chars = given.agg(F.sum(F.length("text")).alias("n")).collect()[0].n or 0
    blocks = max(1, math.ceil(chars / s.block_chars))
    out = None
    for block in range(blocks):  # a benchmark too large for one broadcast is searched part by part
        rows = given.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        texts = sorted((r.item_id, w) for r in rows if (w := _words(r.text)))
        vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, words in texts for w in words}))}
        coded = checkpointed(_coded(docs, vocabulary))
        items = [(i, [vocabulary[w] for w in words]) for i, words in texts]
        whole: dict[tuple[int, ...], list] = {}
        for i, codes in items:
            if len(codes) < s.least_words:
                whole.setdefault(tuple(codes), []).append(i)
        long = [(i, codes) for i, codes in items if len(codes) >= s.least_words]
        latent, index = np.zeros((0, 1), np.float32), None
        if long:
            idf = _inverse_frequency(coded, len(vocabulary), s)
            latent = _latent(coded, idf, s)
            index = _index(long, latent, idf, s)
        found = _hits(coded, latent, index, whole, benchmark.schema["item_id"].dataType, s)
        out = found if out is None else out.join(found.toDF("doc_id", "k1", "k2", "more", "other").drop("doc_id").distinct(), ["k1", "k2"]).select(
            "doc_id", "k1", "k2", F.concat("items", "more").alias("items"), F.greatest("share", "other").alias("share"))
    return out


def _hits(coded: DataFrame, latent: np.ndarray, index: dict | None, whole: dict[tuple[int, ...], list], kind: DataType, s: Settings) -> DataFrame:
    context = coded.sparkSession.sparkContext
    model = context.broadcast((latent, index, whole))  # of the benchmark's size, which block_chars bounds
    arrow = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, index, whole = model.value
        for batch in batches:
            items, shares = [], []
            for value in batch.column(3):
                codes = np.frombuffer(value.as_buffer(), np.uint32)
                found = _search_text(codes, latent, index, s) if index else {}
                if len(codes) < s.least_words:
                    found |= dict.fromkeys(whole.get(tuple(codes.tolist()), ()), 1.0)
                items.append(sorted(found))
                shares.append(max(found.values(), default=0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(items, arrow), pa.array(shares, pa.float64())],
                                             names=["doc_id", "k1", "k2", "items", "share"])

    ids = dict(coded.dtypes)["doc_id"]
    return coded.mapInArrow(tidy(run), f"doc_id {ids}, k1 bigint, k2 bigint, items array<{kind.simpleString()}>, share double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``contaminated``, ``items`` (sorted ids of the items found), ``share``: one row per input row.

    ``share`` is the largest part of an item's words that the text has in order. Whole
    texts are searched, null and empty ones have nothing. Benchmark rows with a null id
    or text are not searched; rows of one id count as that item. An item of fewer than
    ``least_words`` words is found where it is the whole text. An empty benchmark finds
    nothing. Repeated rows are judged alike, and other columns play no part.
    """
    found = _searched(docs, benchmark, s)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "share")


def keep_clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with all their columns."""
    a, b = fresh(docs, "k1", "k2")
    bad = _searched(docs, benchmark, s).filter(F.size("items") > 0).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    return docs.withColumns({a: k1, b: k2}).join(bad, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
