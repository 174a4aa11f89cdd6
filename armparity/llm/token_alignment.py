"""How the tokens of two tokenizers lie over the same bytes.

Both tokenizers encode a text, and each token covers a run of its bytes. Batch by batch,
keyed by document, ``pandas.merge_asof`` finds for each token start the covering token of
the other side; the union of both directions is every pair of tokens that overlap. Ends
that both sides share cut the tokens into groups.

How often two ids are linked in the whole corpus takes a second step: documents are held
in blocks, a block lists each of its id pairs once, the lists are summed over the cluster,
and every block gets back the sums of its own pairs. So neither the pairs of the corpus
nor those of its most frequent id meet in one place.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armparity.llm.common import checkpointed

BATCH = 1 << 21  #: bytes of text aligned at a time
BLOCK = 1 << 23  #: bytes of text that share one list of id pairs
CACHED = 1 << 19  #: units a worker remembers
_LONG = 64  #: letters of a unit worth remembering

#: Neither side has a token across such a place: white space before a word belongs to the word, and the text before ends.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for one in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, pieces: list[bytes], first: str):
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        ids = [str(k) for k in range(len(pieces))]
        self.inner = np.array([f"{k}," for k in ids], object)
        self.last = np.array([k + first for k in ids], object)


class _Known:
    """Ids of units by side, one unit after the other, and whether both sides give the unit back."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def add(self, units: list[str], both: tuple[list[list[int]], list[list[int]]], good: list[bool]) -> None:
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        self.good = np.r_[self.good, np.array(good, bool)]
        for side, rows in enumerate(both):
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            self.ids[side] = np.r_[self.ids[side], np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))]
            self.ends[side] = np.r_[self.ends[side], self.ends[side][-1] + np.cumsum(sizes)]

    def keep(self, n: int) -> None:
        """The first ``n`` units stay: a text's frequent ones come early."""
        if len(self.at) > n:
            self.at = dict(islice(self.at.items(), n))
            self.good = self.good[:n]
            for side in (0, 1):
                self.ends[side] = self.ends[side][: n + 1]
                self.ids[side] = self.ids[side][: self.ends[side][-1]]

    def of(self, side: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some units one after the other, and the end of each unit's."""
        first, n = self.ends[side][units], np.diff(self.ends[side])[units]
        ends = np.r_[0, np.cumsum(n)]
        return self.ids[side][np.repeat(first - ends[:-1], n) + np.arange(ends[-1])].astype(np.int64), ends


@dataclass
class _Pair:
    """Both tokenizers and what a worker remembers of them."""

    a: _Side
    b: _Side
    encode_a: Callable[[list[str]], list[list[int]]]
    encode_b: Callable[[list[str]], list[list[int]]]
    known: _Known = field(default_factory=_Known)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of either side for texts that begin with the added space, and how many each text has; each distinct unit between cuts is encoded once."""
        parts = [_CUT.split(t) if t else [] for t in texts]
        codes, units = pd.factorize(np.array([*chain.from_iterable(parts), ""], object)[:-1])
        known = self.known
        # long units last: they are not remembered
        new = sorted((u for u in units if u not in known.at), key=lambda u: len(u) > _LONG)
        worth = len(known.at) + sum(len(u) <= _LONG for u in new)
        both = self.encode_a(new), self.encode_b([u[1:] for u in new])
        known.add(new, both, [b"".join(map(self.a.pieces.__getitem__, a)) == u.encode() == b"".join(map(self.b.pieces.__getitem__, b)) for u, a, b in zip(new, *both)])
        codes = np.fromiter(map(known.at.__getitem__, units), np.int64, len(units))[codes]
        sizes = np.array([len(p) for p in parts])
        bounds, spoilt = np.r_[0, np.cumsum(sizes)], np.zeros(len(texts), bool)
        for d in set((np.searchsorted(bounds, np.flatnonzero(~known.good[codes]), side="right") - 1).tolist()):
            # what single units lose might make up for one another
            own, raw = codes[bounds[d] : bounds[d + 1]], texts[d].encode()
            spoilt[d] = any(b"".join(map(side.pieces.__getitem__, known.of(k, own)[0].tolist())) != raw for k, side in enumerate((self.a, self.b)))
        codes = codes[~np.repeat(spoilt, sizes)]
        bounds = np.r_[0, np.cumsum(np.where(spoilt, 0, sizes))]
        out = []
        for side in (0, 1):
            ids, ends = known.of(side, codes)
            out.append((ids, np.diff(ends[bounds])))
        known.keep(min(worth, CACHED))
        return out


@functools.lru_cache(maxsize=2)
def _load(byte_level: str, pieces: str) -> _Pair:
    # a task has one core
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(byte_level)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=pieces)
    added = {x["id"] for x in json.loads(one.to_str()).get("added_tokens", ())}
    alphabet = _byte_alphabet()
    size = 1 + max(one.get_vocab(with_added_tokens=True).values())
    entries = [one.id_to_token(k) or "" for k in range(size)]
    a = [e.encode() if k in added else bytes(alphabet[c] for c in e) for k, e in enumerate(entries)]
    b = [bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, two.id_to_piece(k)) for k in range(two.get_piece_size()))]
    return _Pair(_Side(a, "|"), _Side(b, ";"), lambda xs: [e.ids for e in one.encode_batch_fast(xs, add_special_tokens=False)] if xs else [],
                 lambda xs: two.encode(xs, num_threads=1) if xs else [])


def links(ids_a: np.ndarray, at_a: np.ndarray, doc_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens that overlap. ``at`` are token starts that rise over all documents; the tokens of either side cover a document without gaps."""
    a = pd.DataFrame({"at": at_a, "doc": doc_a, "a": np.arange(len(ids_a)), "start": at_a})
    b = pd.DataFrame({"at": at_b, "doc": doc_b, "b": np.arange(len(ids_b))})
    over = pd.merge_asof(a[["at", "doc", "a"]], b, on="at", by="doc")
    under = pd.merge_asof(b, a, on="at", by="doc")
    under = under[under["start"] < under["at"]]  # equal starts are found from A already
    return np.concatenate([over["a"].to_numpy(), under["a"].to_numpy(np.int64)]), np.concatenate([over["b"].to_numpy(np.int64), under["b"].to_numpy()])


@dataclass
class Aligned:
    """Documents of a batch: tokens by side, and what lies where. Documents without tokens have empty ranges."""

    ids: tuple[np.ndarray, np.ndarray]
    bounds: tuple[np.ndarray, np.ndarray]  #: first token of each document, and the end
    closes: tuple[np.ndarray, np.ndarray]  #: whether a token ends a group
    linked: tuple[np.ndarray, np.ndarray]  #: token numbers of both sides

    def docs_of_links(self) -> np.ndarray:
        return np.searchsorted(self.bounds[0], self.linked[0], side="right") - 1


def align_batch(pair: _Pair, texts: list[str | None]) -> Aligned:
    """Texts of a batch; a text whose tokens do not give its bytes back has none."""
    ids, bounds, ends, docs = [], [], [], []
    for side, (held, counts) in zip((pair.a, pair.b), pair.encode([" " + t if t else "" for t in texts])):
        ids.append(held)
        bounds.append(np.r_[0, np.cumsum(counts)])
        ends.append(np.cumsum(side.sizes[held]))
        docs.append(np.repeat(np.arange(len(counts)), counts))
    starts = [e - side.sizes[i] for e, side, i in zip(ends, (pair.a, pair.b), ids)]
    # both sides have the same bytes, so equal ends of the batch are equal ends of a document
    closes = (np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True))
    linked = links(ids[0], starts[0], docs[0], ids[1], starts[1], docs[1])
    return Aligned(tuple(ids), tuple(bounds), closes, linked)


def group_texts(pair: _Pair, x: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document: ids of A and B by group."""
    group = [np.r_[0, np.cumsum(c)[:-1]] if len(c) else np.zeros(0, np.int64) for c in x.closes]
    total = int(x.closes[0].sum())
    first = [np.searchsorted(g, np.arange(total + 1)) for g in group]
    out = np.empty(len(x.ids[0]) + len(x.ids[1]), object)
    # A tokens of a group follow the B tokens of the groups before, B tokens follow the A tokens of their own
    for side, ids, closed, place in zip((pair.a, pair.b), x.ids, x.closes,
                                        (np.arange(len(group[0])) + first[1][group[0]], np.arange(len(group[1])) + first[0][group[1] + 1])):
        words = side.inner[ids]
        words[closed] = side.last[ids[closed]]
        out[place] = words
    bounds = x.bounds[0] + x.bounds[1]
    return ["".join(out[a:b].tolist())[:-1] for a, b in zip(bounds, bounds[1:])]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None], int]]:
    """Ids and texts some at a time, and their bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            t = t.as_py()
            ids.append(i), texts.append(t)
            size += len(t or "")
            if size >= BATCH or len(ids) >= 4096:
                yield ids, texts, size
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``doc_id`` and ``groups`` of each document: per group ``first`` and ``end`` byte (of a space and the text) and the ids ``a``, ``b`` in it.

    Rows are taken one by one, so repeated rows repeat. A null or empty text, and a text
    that the tokens of a side do not give back, has no group. Other columns play no part.
    """
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _load(byte_level, pieces)
        for ids, texts, _ in _batches(batches):
            x, rows = align_batch(pair, texts), []
            for d in range(len(texts)):
                cut = [np.split(x.ids[s][p:q], np.flatnonzero(x.closes[s][p:q]) + 1)[:-1] for s, (p, q) in enumerate((b[d], b[d + 1]) for b in x.bounds)]
                ends = np.cumsum([int(pair.a.sizes[a].sum()) for a in cut[0]]).tolist()
                rows.append([{"first": p, "end": q, "a": a.tolist(), "b": b.tolist()} for p, q, a, b in zip([0, *ends], ends, *cut)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], ids[0].type), pa.array(rows, kind)], names=["doc_id", "groups"])

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, groups array<struct<first: bigint, end: bigint, a: array<int>, b: array<int>>>")


def _per_document(narrow: DataFrame, byte_level: str, pieces: str, block: int) -> DataFrame:
    """Rows of documents with their id pairs and how often each is linked, and one such row (``part`` 0) for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _load(byte_level, pieces)
        wide = len(pair.b.sizes)
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("doc_id", kind), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                            ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
        at, size, held = TaskContext.get().partitionId() << 32, 0, []

        def total() -> pa.RecordBatch:
            codes, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            times = np.bincount(where, weights=np.concatenate([t for _, t in held]), minlength=len(codes)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([at, 0, None, 0, 0, 0, 0, "", codes.tobytes(), times.tobytes()], schema)], schema=schema)

        for ids, texts, bytes_ in _batches(batches):
            x = align_batch(pair, texts)
            codes = x.ids[0][x.linked[0]] * wide + x.ids[1][x.linked[1]]
            key, times = np.unique((x.docs_of_links() << 32) | codes, return_counts=True)
            codes, times = (key & 0xFFFFFFFF).astype(np.uint32), times.astype(np.uint32)
            cuts = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
            n_links = np.add.reduceat(np.r_[times, 0].astype(np.int64), cuts[:-1]) * (np.diff(cuts) > 0)
            counts = [np.diff(b) for b in x.bounds]
            groups = np.add.reduceat(np.r_[x.closes[0], False].astype(np.int64), x.bounds[0][:-1]) * (counts[0] > 0)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(pair, x)]
            cut = list(zip(cuts, cuts[1:]))
            arrays = [[at] * len(texts), [1] * len(texts), [i.as_py() for i in ids], counts[0], counts[1], groups, n_links, digests,
                      [codes[p:q].tobytes() for p, q in cut], [times[p:q].tobytes() for p, q in cut]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(arrays, schema)], schema=schema)
            # the block's list so far, each pair once
            block_codes, where = np.unique(codes, return_inverse=True)
            held.append((block_codes, np.bincount(where, weights=times, minlength=len(block_codes)) if len(times) else np.zeros(0)))
            size += bytes_
            if size >= block:
                yield total()
                at, size, held = at + 1, 0, []
        if held:
            yield total()

    kind = pa.int64() if dict(narrow.dtypes)["doc_id"] == "bigint" else _arrow_type(narrow)
    schema = f"block bigint, part int, doc_id {dict(narrow.dtypes)['doc_id']}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
    return narrow.mapInArrow(run, schema)


def _arrow_type(narrow: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(narrow.schema["doc_id"].dataType)


def link_counts(docs: DataFrame, byte_level: str, pieces: str, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``n_best`` counts the links whose id pair is linked as often in the corpus as any of
    its B id, ``count_sum`` adds the corpus counts of all links. ``groups_sha256`` is the
    digest of :func:`group_texts`. A null or empty text, and one that the tokens of a
    side do not give back, has zeros and an empty string. Repeated rows are documents of
    their own and count as often. No documents give no rows; other columns play no part.
    A block holds ``block`` bytes of text or one longer text.
    """
    narrow = docs.select("doc_id", "text")
    wide = len(_load(byte_level, pieces).b.sizes)
    rows = checkpointed(_per_document(narrow, byte_level, pieces, block))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, codes, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                codes, times = (np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64) for v in (codes, times))
                for p in range(0, len(codes), 1 << 16):
                    part = slice(p, p + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(codes[part]), pa.array(np.full(len(codes[part]), at)), pa.array(times[part])], names=["code", "block", "n"])

    listed = rows.filter("part = 0").select("block", "pairs", "times").mapInArrow(unpack, "code bigint, block bigint, n bigint")
    # an id pair has one row per block, whatever its frequency
    counted = listed.withColumn("count", F.sum("n").over(Window.partitionBy("code")))
    best = counted.groupBy((F.col("code") % wide).alias("b")).agg(F.max("count").alias("most"))
    sums = counted.withColumn("b", F.col("code") % wide).join(F.broadcast(best), "b").select("block", "code", "count", (F.col("count") == F.col("most")).alias("best"))

    def add(_: tuple, found: pa.Table, sums: pa.Table) -> pa.Table:
        code = sums["code"].to_numpy()
        order = np.argsort(code)
        code, count, best = code[order], sums["count"].to_numpy()[order], sums["best"].to_numpy(zero_copy_only=False)[order]
        added, hits = [], []
        for pairs, times in zip(found["pairs"], found["times"]):
            pairs, times = (np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64) for v in (pairs, times))
            at = np.searchsorted(code, pairs)
            added.append(int((times * count[at]).sum()) if len(at) else 0)
            hits.append(int(times[best[at]].sum()) if len(at) else 0)
        out = {n: found[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(out | {"n_best": pa.array(hits, pa.int64()), "count_sum": pa.array(added, pa.int64()), "groups_sha256": found["groups_sha256"]})

    schema = f"doc_id {dict(narrow.dtypes)['doc_id']}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    texts = rows.filter("part = 1").drop("part")
    return texts.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(add, schema)
