"""Language-model scores by online logistic context mixing.

A text is a string of symbols: frequent words, or a mark and the bytes of a rarer word,
and an end. Each symbol is a path of binary decisions in a code tree. Several contexts
(none, the symbol before, the two before) are hashed with the place in the tree into
tables of bit counts, gathered from all training texts; each gives one prediction. Their
log-odds are mixed by weights that a gate selects (how much the longer contexts have
seen), starting from weights fitted on all training texts and refined by the error of
each block of a text as it is read; a last table corrects the mixed probability by what
happened at that probability before. The sum over the bits is the score.

The fit reads every decision of every training text, each left out of the counts it is
predicted by. What it needs of them is how often each gate, bit and combination of
log-odds occurs, in steps of 1/2; tasks count that and the counts are summed.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.llm.common import checkpointed, columns_of, summed, tidy

CONTEXTS = 3  #: symbols of history in the longest context, plus one


@dataclass(frozen=True)
class Settings:
    head_words: int = 1 << 18  #: most frequent training words that are symbols of their own
    head_bytes: int = 64  #: longer words are spelled, so the head has a bounded size
    slots: int = 19  #: log2 of the slots of each context's table
    segment: int = 2048  #: symbols after which a text's weights start anew
    block: int = 64  #: symbols scored between two refinements of the weights
    rate: float = 0.0005


# ---------------------------------------------------------------- code trees


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code; ties by place."""
    heap = [(int(w), k, None) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    n = len(heap)
    if n == 1:
        return np.ones(1, np.int64)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
        n += 1
    out = np.zeros(len(weights), np.int64)
    stack = [(heap[0], 0)]
    while stack:
        (_, k, below), depth = stack.pop()
        if below is None:
            out[k] = depth
        else:
            stack += [(below[0], depth + 1), (below[1], depth + 1)]
    return out


def canonical(lengths: np.ndarray) -> list[int]:
    """Canonical prefix code of the lengths."""
    codes = [0] * len(lengths)
    code = last = 0
    for k in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k] = code
        code += 1
    return codes


class Alphabet:
    """Symbols and their codes.

    0 is the end, 1 the mark of a spelled word, then the head words; after the mark come
    bytes and a stop from a second alphabet, with a code of its own.
    """

    def __init__(self, words: list[str], counts: np.ndarray, rare: int, ends: int, letters: np.ndarray):
        self.words = pa.array(words, pa.string())
        self.letters = len(words) + 2  # first symbol of the second alphabet
        lengths, codes = [], []
        for weights in (np.concatenate([[ends + 1, rare + 1], counts]), letters + 1):
            # a floor on the weights keeps the longest code within 40 bits
            weights = np.maximum(weights, weights.sum() / 2**26)
            lengths.append(code_lengths(np.ceil(weights)))
            codes.append(np.array(canonical(lengths[-1]), np.uint64))
        self.bits, self.code = np.concatenate(lengths), np.concatenate(codes)

    @functools.cached_property
    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each symbol's decisions start; of every decision a hash of tree and path before it (31 bits), and its bit as the lowest."""
        start = np.cumsum(self.bits) - self.bits
        of = np.repeat(np.arange(len(self.bits)), self.bits)
        done = (np.arange(len(of)) - start[of]).astype(np.uint64)
        code, left = self.code[of], self.bits[of].astype(np.uint64) - done
        bit = (code >> (left - np.uint64(1)) & np.uint64(1)).astype(np.uint32)
        tree = (of >= self.letters).astype(np.uint64)
        node = _half(((np.uint64(1) << done | code >> left) * np.uint64(2) + tree) * np.uint64(0x9E3779B97F4A7C15))
        return start, node & ~_BIT | bit

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "paths"}  # made anew by each worker

    def symbols(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Symbols of a text and the words that are spelled."""
        symbols, _, place = self.coded(pa.array(words, pa.string()), np.zeros(len(words), np.int64), 1)
        return symbols, [w for w, k in zip(words, place) if k == 1]

    def coded(self, words: pa.Array, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of ``rows`` texts one after the other, where each text begins, and the symbol each word has (the mark if it is spelled).

        ``row`` is the text each of the words stands in, in rising order.
        """
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        at = np.arange(len(place)) + row
        symbols = np.zeros(len(place) + rows, np.int64)  # the last of each text is its end
        symbols[at] = place
        first = np.r_[0, np.cumsum(np.bincount(row, minlength=rows) + 1)]
        rare = np.flatnonzero(place == 1)
        if not len(rare):
            return symbols, first, place
        # after a mark come the bytes and a stop
        sizes, letters = _bytes_of(words.take(pa.array(rare)))
        width = np.ones(len(symbols), np.int64)
        width[at[rare]] += sizes + 1
        start = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[start] = symbols
        after = start[at[rare]] + 1
        out[np.repeat(after - np.cumsum(sizes) + sizes, sizes) + np.arange(len(letters))] = letters.astype(np.int64) + self.letters
        out[after + sizes] = self.letters + 256
        return out, np.r_[start, len(out)][first], place


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each word has, and the bytes one after the other."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0]
    return sizes, np.frombuffer(joined.as_buffer(), np.uint8)


def _words(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[pa.Array, np.ndarray, int, int]]:
    """Words (maximal runs without ASCII white space, A-Z lower-cased), the row of each, and the first row and number of rows, for about ``most`` bytes at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // most)) + 1) if len(texts) else ():
        low, n = int(part[0]), len(part)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(low, n), "")))
        words = lists.flatten()
        real = pc.not_equal(words, "")  # a blank at either end has nothing beside it
        row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        yield words.filter(real), row[real.to_numpy(zero_copy_only=False)], low, n


_MORE, _ODD, _BIT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint32(0xD6E8FEB9), np.uint32(1)


def _half(mixed: np.ndarray) -> np.ndarray:
    """32 bits of a 64-bit hash."""
    return ((mixed ^ mixed >> np.uint64(29)) * _MORE >> np.uint64(32)).astype(np.uint32)


def _histories(symbols: np.ndarray) -> list[np.ndarray]:
    """Hashes of the symbol before each symbol, and of the two before.

    An end stands before the first symbol; contexts do not reach behind an end, so texts
    can stand one after the other.
    """
    one = np.concatenate([[0], symbols[:-1]])
    two = np.where(one == 0, 0, np.concatenate([[0, 0], symbols[:-2]])[: len(one)])
    first = (one.astype(np.uint64) + np.uint64(1)) * _MORE
    second = ((first ^ (first >> np.uint64(31))) + two.astype(np.uint64) + np.uint64(1)) * _MORE
    return [_half(first), _half(second)]


def _decisions(symbols: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The place in the alphabet's paths of every decision of some symbols, and how many each symbol has."""
    bits = alphabet.bits[symbols]
    ends = np.cumsum(bits)
    at = np.repeat(alphabet.paths[0][symbols] - ends + bits, bits)
    at += np.arange(len(at))
    return at, bits


def _slots(node: np.ndarray, history: np.ndarray | None, bits: np.ndarray | None, s: Settings) -> np.ndarray:
    """Slots of decisions in a context's table, from their nodes and the hash of the history of each symbol."""
    mixed = node | _BIT if history is None else node ^ np.repeat(history, bits)
    mixed |= _BIT  # a slot does not know the bit
    mixed *= _ODD
    mixed >>= np.uint32(32 - s.slots)
    return mixed


# ---------------------------------------------------------------- what the corpus gives


def _word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """``word``, ``n`` over the training texts; words are counted in the task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, *_ in _words(batch.column(0), 32 << 20):
                seen = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([seen.field(0), seen.field(1)], names=["word", "n"])

    return docs.filter(training).select("text").mapInArrow(tidy(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(counts: DataFrame, known) -> np.ndarray:
    """How often each byte and the stop occur in the training words that are spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = np.zeros(257), known.value
        for batch in batches:
            spelled = pc.invert(pc.is_in(batch.column(0), value_set=head))
            words, n = batch.column(0).filter(spelled), batch.column(1).filter(spelled).to_numpy(zero_copy_only=False)
            if len(words):
                sizes, letters = _bytes_of(words)
                held[:256] += np.bincount(letters, weights=np.repeat(n, sizes), minlength=256)
                held[256] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["key", "data"])

    rows = summed(counts.select("word", "n").mapInArrow(tidy(run), "key int, data binary"), 16).collect()
    return np.frombuffer(rows[0].data) if rows else np.zeros(257)


def _coded(docs: DataFrame, shared, frequency: np.ndarray) -> DataFrame:
    """The texts as ``symbols`` (32-bit integers), with ``n_tokens``, and of the head words among them how many (``found``) and the sum of their log counts (``base``).

    ``tail`` has the other words, ``size`` is the number of bytes, ``row`` a number of the row.
    """
    logs = docs.sparkSession.sparkContext.broadcast(np.log10(frequency + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, log_of = shared.value, logs.value
        for batch in batches:
            for words, row, low, n in _words(batch.column(1)):
                symbols, first, place = alphabet.coded(words, row, n)
                head = place > 1
                base = np.bincount(row[head], weights=log_of[place[head] - 2], minlength=n)
                rare = words.filter(pa.array(~head)).dictionary_encode()
                key, times = np.unique(row[~head] * (len(rare.dictionary) + 1) + rare.indices.to_numpy(zero_copy_only=False), return_counts=True)
                of, word = np.divmod(key, len(rare.dictionary) + 1)
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()),
                                                pa.StructArray.from_arrays([rare.dictionary.take(pa.array(word)), pa.array(times, pa.int64())], names=["word", "times"]))
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(symbols.astype(np.int32))])
                size = pc.fill_null(pc.binary_length(batch.column(1).slice(low, n)), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), batch.column(2).slice(low, n), pa.array(np.bincount(row, minlength=n) + 1, pa.int64()),
                     pa.array(np.bincount(row[head], minlength=n), pa.int64()), pa.array(base, pa.float64()), size.cast(pa.int64()), tail, data],
                    names=["doc_id", "held_out", "n_tokens", "found", "base", "size", "tail", "symbols"])

    ids = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {ids}, held_out boolean, n_tokens bigint, found bigint, base double, size bigint, tail array<struct<word:string,times:bigint>>, symbols binary"
    return docs.select("doc_id", "text", "held_out").mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id())


def _parts(texts: Iterable[np.ndarray], most: int = 1 << 15) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, int]]]]:
    """Symbols of texts, about ``most`` at a time.

    Yields symbols, how many at the front are only history, and the stretches (text,
    symbols, place of the first in its text). Texts longer than that come in several
    parts.
    """
    held: list[np.ndarray] = []
    stretches: list[tuple[int, int, int]] = []
    size = 0
    for row, symbols in enumerate(texts):
        if size + len(symbols) > most and held:
            yield np.concatenate(held), 0, stretches
            held, stretches, size = [], [], 0
        if len(symbols) > most:
            for low in range(0, len(symbols), most):
                back = min(low, 2)
                part = symbols[low - back : low + most]
                yield part, back, [(row, len(part) - back, low)]
        else:
            held.append(symbols)
            stretches.append((row, len(symbols), 0))
            size += len(symbols)
    if held:
        yield np.concatenate(held), 0, stretches


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Symbols of each text of a coded batch."""
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.int32)


def _cells(symbols: np.ndarray, skip: int, alphabet: Alphabet, s: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of every decision behind the first ``skip`` symbols its place in the alphabet's paths, and twice its slot plus its bit for each context with a history."""
    at, bits = _decisions(symbols[skip:], alphabet)
    node, out = alphabet.paths[1].take(at), []
    bit = node & _BIT
    for history in _histories(symbols):
        cell = _slots(node, history[skip:], bits, s)
        cell <<= _BIT
        cell |= bit
        out.append(cell)
    return at, out


def _plain_cells(alphabet: Alphabet, s: Settings) -> np.ndarray:
    """The same for the context without a history, of every place in the paths."""
    node = alphabet.paths[1]
    return _slots(node, None, None, s) << _BIT | node & _BIT


def _bit_counts(coded: DataFrame, training: Column, model, s: Settings) -> np.ndarray:
    """Counts of zeros and ones for every slot of every context, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = model.value
        held, times = np.zeros((CONTEXTS, 2 << s.slots)), np.zeros(len(alphabet.bits))
        for batch in batches:
            for symbols, skip, _ in _parts(_texts(batch.column(0)), 1 << 17):
                times += np.bincount(symbols[skip:], minlength=len(times))
                for k, cell in enumerate(_cells(symbols, skip, alphabet, s)[1]):
                    held[k + 1] += np.bincount(cell, minlength=2 << s.slots)
        # without a history the decisions of a symbol are always the same
        held[0] = np.bincount(_plain_cells(alphabet, s), weights=np.repeat(times, alphabet.bits), minlength=2 << s.slots)
        for k in range(CONTEXTS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([held[k].tobytes()], pa.binary())], names=["key", "data"])

    rows = {r.key: r.data for r in summed(coded.filter(training).select("symbols").mapInArrow(tidy(run), "key int, data binary"), 12).collect()}
    return np.stack([np.frombuffer(rows[k]) if k in rows else np.zeros(2 << s.slots) for k in range(CONTEXTS)])


# ---------------------------------------------------------------- mixing


GATES = 12  #: four steps of what the middle context has seen times three of the longest
STEPS = 33  #: of log-odds, from -8 to 8
_GATE = np.uint32(15)


def _gates(k: int, seen: np.ndarray) -> np.ndarray:
    """What context ``k`` adds to the gate, by how much it has seen."""
    return np.searchsorted(np.array((1, 4, 16) if k == 1 else (1, 4)), seen, side="right") * (3 if k == 1 else 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Mixer:
    """Tables of log-odds with gates by slot, the weights that texts start with, and the final correction."""

    def __init__(self, counts: np.ndarray):
        zero, one = counts[:, ::2], counts[:, 1::2]
        self.odds = np.log((one + 0.4) / (zero + 0.4)).astype(np.float32)
        seen = zero + one
        for k in range(1, CONTEXTS):  # what a slot adds to the gate stands in the last four bits, so both are read at once
            held = self.odds[k].view(np.uint32)
            held[:] = held & ~_GATE | _gates(k, seen[k]).astype(np.uint32)
        self.weights = np.tile(np.float32([0.3, 0.4, 0.3]), (GATES, 1))
        self.correction = _sigmoid(np.linspace(-8, 8, STEPS)).astype(np.float32)

    def fit(self, seen: np.ndarray) -> None:
        """Weights and correction from how often each cell of :func:`leaving_one_out` was seen."""
        seen = seen.reshape(GATES, -1, 2)
        some = [np.flatnonzero(seen[g].sum(axis=1)) for g in range(GATES)]
        hits, total = np.zeros(STEPS), np.zeros(STEPS)
        for g, cells in enumerate(some):
            if not len(cells):
                continue
            x = (np.stack([cells // STEPS**k % STEPS for k in range(CONTEXTS)]) - STEPS // 2) / 2
            ones, n, start = seen[g, cells, 1], seen[g, cells].sum(axis=1), self.weights[g].astype(np.float64)
            w = start.copy()
            for _ in range(8):  # Newton steps, drawn to the start
                p = _sigmoid(w @ x)
                hessian = (x * (n * p * (1 - p))) @ x.T + 20 * np.eye(CONTEXTS)
                w += np.linalg.solve(hessian, x @ (ones - n * p) - 20 * (w - start))
            self.weights[g] = w
            step = _step(w @ x)
            hits += np.bincount(step, weights=ones, minlength=STEPS)
            total += np.bincount(step, weights=n, minlength=STEPS)
        prior = _sigmoid(np.linspace(-8, 8, STEPS))
        self.correction = ((hits + 50 * prior) / (total + 50)).astype(np.float32)

    def score(self, symbols: np.ndarray, skip: int, stretches: list[tuple[int, int, int]], alphabet: Alphabet, s: Settings) -> np.ndarray:
        """Natural log of the probability of each stretch."""
        # a lane is a segment of a text with weights of its own; it moves on block by block
        sizes = np.array([n for _, n, _ in stretches])
        text = np.repeat(np.arange(len(stretches)), sizes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat([first for _, _, first in stretches], sizes)
        lane = np.cumsum(np.r_[0, (np.diff(text) > 0) | (np.diff(place // s.segment) != 0)])
        block = (place % s.segment // s.block).astype(np.int16)
        order = np.argsort(block, kind="stable")
        histories = [h[skip:][order] for h in _histories(symbols)]
        at, bits = _decisions(symbols[skip:][order], alphabet)
        starts = np.cumsum(bits) - bits
        bounds = np.r_[starts, len(at)][np.searchsorted(block[order], np.arange(int(block.max()) + 2))]
        node = alphabet.paths[1].take(at)
        odds, cell = [self._plain_odds(alphabet, s).take(at)], np.repeat(lane[order] * GATES, bits)
        for k, history in enumerate(histories, 1):
            odds.append(self.odds[k].take(_slots(node, history, bits, s)))
            cell += odds[k].view(np.uint32) & _GATE
        bit = (node & _BIT).astype(np.float32)
        # decisions of one lane and gate mostly follow each other; such a run has one set of weights
        new = np.empty(len(at), bool)
        np.not_equal(cell[1:], cell[:-1], out=new[1:])
        new[bounds[:-1]] = True
        runs = np.flatnonzero(new)
        cell, length = cell[runs], np.diff(np.r_[runs, len(at)])
        weights = np.tile(self.weights, (int(lane[-1]) + 1, 1)).T.copy()
        seen = np.empty(len(at), np.float32)
        edges = np.searchsorted(runs, bounds)
        for low, high, first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            x, y, c, n, at = [o[low:high] for o in odds], bit[low:high], cell[first:last], length[first:last], runs[first:last] - low
            z = np.repeat(weights[0][c], n)
            z *= x[0]
            for k in range(1, CONTEXTS):
                z += np.repeat(weights[k][c], n) * x[k]
            np.clip(z, -8, 8, out=z)
            p = np.exp(-z)
            p += 1
            np.reciprocal(p, out=p)
            z *= 2
            z += STEPS // 2 + 0.5
            seen[low:high] = self.correction.take(z.astype(np.intp))
            seen[low:high] += p
            error = y - p
            error *= np.float32(s.rate)
            for k in range(CONTEXTS):
                weights[k] += np.bincount(c, weights=np.add.reduceat(error * x[k], at), minlength=weights.shape[1])
        # the mean of the mixed and the corrected probability, of the bit that came
        seen *= 0.5
        seen -= 1 - bit
        np.abs(seen, out=seen)
        return np.bincount(text[order], weights=np.add.reduceat(np.log(seen, out=seen), starts), minlength=len(stretches))

    def _plain_odds(self, alphabet: Alphabet, s: Settings) -> np.ndarray:
        """Log-odds without a history for every place in the paths of the alphabet."""
        held = self.__dict__.get("_plain")
        if held is None or held[0] is not alphabet:
            held = self._plain = (alphabet, self.odds[0][_plain_cells(alphabet, s) >> np.uint32(1)])
        return held[1]


def _step(z: np.ndarray) -> np.ndarray:
    """Log-odds in steps of 1/2 from -8 to 8, halves upwards."""
    return (np.clip(z, -8, 8) * 2 + (STEPS // 2 + 0.5)).astype(np.int64)


def leaving_one_out(counts: np.ndarray) -> list[np.ndarray]:
    """For each context what a decision adds to its cell, by twice its slot plus its bit.

    The decision is left out of the counts it is predicted by. A cell stands for a gate,
    the steps of the log-odds and the bit; it is the sum of what the contexts add.
    """
    out = []
    for k in range(CONTEXTS):
        zero, one = np.repeat(counts[k, ::2], 2), np.repeat(counts[k, 1::2], 2)
        zero[::2], one[1::2] = np.maximum(zero[::2] - 1, 0), np.maximum(one[1::2] - 1, 0)
        cell = _step(np.log((one + 0.4) / (zero + 0.4))) * STEPS**k
        if k:
            cell += _gates(k, zero + one) * STEPS**CONTEXTS
        cell *= 2
        if not k:
            cell[1::2] += 1
        out.append(cell.astype(np.int32))
    return out


def _mixer(coded: DataFrame, training: Column, shared, counts: np.ndarray, s: Settings) -> Mixer:
    """Weights and correction fitted on all decisions of all training texts."""
    mixer, size = Mixer(counts), GATES * STEPS**CONTEXTS * 2
    parts = coded.sparkSession.sparkContext.broadcast(leaving_one_out(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, (plain, *adds) = shared.value, parts.value
        held, plain = np.zeros(size), plain[_plain_cells(alphabet, s)]
        for batch in batches:
            for symbols, skip, _ in _parts(_texts(batch.column(0)), 1 << 17):
                at, cells = _cells(symbols, skip, alphabet, s)
                total = plain.take(at)
                for add, cell in zip(adds, cells):
                    total += add.take(cell)
                held += np.bincount(total, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["key", "data"])

    rows = summed(coded.filter(training).select("symbols").mapInArrow(tidy(run), "key int, data binary"), 12).collect()
    parts.unpersist()
    if rows:
        mixer.fit(np.frombuffer(rows[0].data))
    return mixer


# ---------------------------------------------------------------- the operator


def score(docs: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """Scores of all whole texts by what the texts that are not ``held_out`` say: one row per input row.

    Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end per
    text. ``n_tokens`` counts them, ``n_known`` those that occur in training,
    ``train_tokens`` all training tokens. ``base_score`` is the log10 probability under
    add-one word counts, ``score`` that under the mixed model, ``bits_per_byte`` the latter
    in bits over the bytes of the text (null for an empty one). Null texts count as
    empty: just an end. Where ``held_out`` is null a row is for training. Repeated rows are scored alike
    and count as often in training. Other columns play no part.
    """
    narrow = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = ~F.col("held_out")
    context = docs.sparkSession.sparkContext
    counts = checkpointed(_word_counts(narrow, training))
    ends = narrow.filter(training).count()
    row = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()[0]
    total, distinct = (row.n or 0) + ends, row.v + (ends > 0)
    head = (counts.filter((F.col("n") > 1) & (F.octet_length("word") <= s.head_bytes)).orderBy(F.desc("n"), "word").limit(s.head_words).toArrow())
    words, frequency = head.column("word").to_pylist(), head.column("n").to_numpy()
    known = context.broadcast(pa.array(words, pa.string()))
    alphabet = Alphabet(words, frequency, (row.n or 0) - int(frequency.sum()), ends, _letters(counts, known))
    shared = context.broadcast(alphabet)
    coded = checkpointed(_coded(narrow, shared, frequency))
    table = _bit_counts(coded, training, shared, s)
    model = context.broadcast(_mixer(coded, training, shared, table, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, mixer = shared.value, model.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for symbols, skip, stretches in _parts(_texts(batch.column(0))):
                for (i, _, _), x in zip(stretches, mixer.score(symbols, skip, stretches, alphabet, s)):
                    scores[i] += x
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores / math.log(10), pa.float64())], names=[*batch.schema.names[1:], "score"])

    own = coded.select("symbols", "row", "doc_id", "held_out", "n_tokens", "found", "base", "size")
    scored = own.mapInArrow(tidy(run), f"{columns_of(own.drop('symbols'))}, score double")
    # words outside the head are looked up by a join; they are rare, so no key is hot
    rare = coded.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.times").alias("times")).join(counts, "word", "left")
    seen = F.coalesce("n", F.lit(0))
    rest = rare.groupBy("row").agg(F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(seen + 1.0)).alias("rest"))
    end_known = 1 if ends else 0
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("found") + F.coalesce("more", F.lit(0)) + end_known).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        "score", F.when(F.col("size") > 0, F.col("score") / -math.log10(2) / F.col("size")).alias("bits_per_byte"))
