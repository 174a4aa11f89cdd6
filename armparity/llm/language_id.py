"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A text's
probability is the sum over all ways to cut it into pieces, found by a forward pass. No
piece used here has white space behind its first character, so the sum over a text is
the product over its words, and a word's sum is kept once it is known.

The probabilities are fitted by expectation maximisation over all training texts: each
distinct word of a language is one row with its count, a forward and a backward pass give
the expected uses of every piece, and Spark adds them up. What comes to the driver and
goes out again is one number per piece and language, whatever the corpus.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armparity.llm.common import columns_of, kept_table

UNKNOWN = "und"
_SPACE = "▁"  #: stands for the white space before a word
_CHUNK = 1 << 22  #: letters of text scored at a time


@dataclass(frozen=True)
class Settings:
    rounds: int = 3  #: of expectation maximisation
    added: float = 0.05  #: to the expected uses of each piece
    kept: int = 1 << 18  #: words whose sums a task remembers; the others are summed again
    #: Longer words go letter by letter through a loop of their own instead of a table of words of one length.
    long: int = 48


@dataclass(frozen=True)
class Model:
    """Languages, their share of the training texts, and log probabilities by language and piece."""

    languages: tuple[str, ...]
    shares: tuple[float, ...]
    logs: np.ndarray
    path: str


class Pieces:
    """The vocabulary as a trie: nodes are the first parts of pieces, and a hash table leads from a node and a letter to the next node."""

    def __init__(self, path: str):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes = np.zeros(256, np.int64)
        self.size = held.get_piece_size()
        for k in range(self.size):
            piece = held.id_to_piece(k)
            if held.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (held.is_control(k) or held.is_unknown(k) or held.is_unused(k)) and piece and not any(c.isspace() or c == _SPACE for c in piece[1:]):
                self.ids[piece] = k
        self.longest = max(map(len, self.ids), default=1)
        self.heads = {p[:n]: 0 for p in self.ids for n in range(len(p) + 1)} | {"": 0}
        self.heads = {h: k for k, h in enumerate(sorted(self.heads))}  # the empty one is 0
        #: Piece of each node, or -1.
        self.piece = np.full(len(self.heads), -1, np.int64)
        for p, k in self.ids.items():
            self.piece[self.heads[p]] = k
        steps = [(self.heads[h[:-1]] << 21 | ord(h[-1]), k) for h, k in self.heads.items() if h]
        self._mask = (1 << max(4, (4 * len(steps)).bit_length())) - 1
        self._keys, self._nodes = np.full(self._mask + 1, -1, np.int64), np.full(self._mask + 1, -1, np.int64)
        for key, node in steps:
            at = int(self._slot(np.array([key]))[0])
            while self._keys[at] >= 0:
                at = (at + 1) & self._mask
            self._keys[at], self._nodes[at] = key, node

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype(np.int64) & self._mask

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Next node of each node and letter, or -1."""
        key = nodes << 21 | letters
        at, out = self._slot(key), np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self._keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self._nodes[at[open_[hit]]]
            open_ = open_[(found >= 0) & ~hit]
            at[open_] = (at[open_] + 1) & self._mask
        return out

    @functools.lru_cache(maxsize=1 << 14)
    def spelled(self, letter: str) -> tuple[int, ...]:
        """Byte pieces of a letter that is no piece itself."""
        return tuple(int(self.bytes[b]) for b in letter.encode("utf-8", "surrogatepass"))

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """Pieces that begin at each place of ``word``: their length and numbers."""
        out = []
        for i in range(len(word)):
            here = []
            for n in range(1, min(self.longest, len(word) - i) + 1):
                part = word[i : i + n]
                if part not in self.heads:
                    break
                if part in self.ids:
                    here.append((n, (self.ids[part],)))
            if not here or here[0][0] != 1:
                here.insert(0, (1, self.spelled(word[i])))
            out.append(here)
        return out


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class _Table:
    """Words of one length: which pieces run from each place over each number of letters."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.length, self.words = len(words[0]), len(words)
        letters = np.array(words, dtype=f"<U{self.length}").view(np.uint32).astype(np.int64).reshape(len(words), self.length)
        #: First place, end, numbers of the words and of the piece each has there.
        self.runs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        nodes = np.zeros((self.length, len(words)), np.int64)  # by place and word
        for n in range(min(pieces.longest, self.length)):
            nodes = nodes[: self.length - n].copy()
            alive = np.flatnonzero(nodes >= 0)
            if not len(alive):
                break
            flat = nodes.reshape(-1)
            flat[alive] = pieces.step(flat[alive], letters[:, n:].T.reshape(-1)[alive])
            ids = np.where(nodes >= 0, pieces.piece[nodes], -1)
            if n == 0:
                # every letter counts: one that is no piece is spelled in bytes
                self.runs += [(i, i + 1, np.arange(len(words)), ids[i]) for i in range(self.length)]
                self.spelled = np.argwhere(ids < 0)
                self.bytes = [pieces.spelled(chr(c)) for c in letters.T[tuple(self.spelled.T)].tolist()]
                continue
            places, rows = np.nonzero(ids >= 0)
            cuts = np.searchsorted(places, np.arange(len(ids) + 1))
            self.runs += [(i, i + n + 1, r, ids[i, r]) for i, r in ((i, rows[p:q]) for i, (p, q) in enumerate(zip(cuts, cuts[1:])) if q > p)]

    def chances(self, logs: np.ndarray) -> list[np.ndarray]:
        """Probabilities of each run's pieces by language."""
        by_piece = np.exp(logs).T
        out = [by_piece[ids] for _, _, _, ids in self.runs]
        for (place, word), letters in zip(self.spelled.tolist(), self.bytes):
            out[place][word] = np.exp(logs[:, list(letters)].sum(axis=1))
        return out

    def sums(self, chances: list[np.ndarray], back: bool = False) -> np.ndarray:
        """Sum over all paths from the first place to each place, or, ``back``, from each to the last; axes place, word, language."""
        out = np.zeros((self.length + 1, self.words, chances[0].shape[1]))
        out[self.length if back else 0] = 1
        order = sorted(range(len(self.runs)), key=lambda k: -self.runs[k][0] if back else self.runs[k][1])
        for k in order:
            start, end, rows, _ = self.runs[k]
            into, source = (start, end) if back else (end, start)
            if len(rows) == self.words:
                out[into] += chances[k] * out[source]
            else:
                out[into][rows] += chances[k] * out[source][rows]
        return out


#: Below this a sum over all segmentations may have lost digits; such words are summed in logarithms.
_LEAST = 1e-250


def _log_sums(pieces: Pieces, word: str, logs: np.ndarray, back: bool = False) -> dict[int, np.ndarray]:
    """Log sums of one word by place and language."""
    arcs = pieces.arcs(word)
    ahead: dict[int, list[np.ndarray]] = {0: [np.zeros(logs.shape[0])]}
    out = {}
    for i in range(len(word) + 1):
        out[i] = np.logaddexp.reduce(ahead.pop(i))
        for n, ids in arcs[i] if i < len(word) else ():
            ahead.setdefault(i + n, []).append(out[i] + logs[:, list(ids)].sum(axis=1))
    if not back:
        return out
    behind = {len(word): np.zeros(logs.shape[0])}
    for i in reversed(range(len(word))):
        behind[i] = np.logaddexp.reduce([behind[i + n] + logs[:, list(ids)].sum(axis=1) for n, ids in arcs[i]])
    return behind


def _tables(words: list[str], long: int) -> Iterator[np.ndarray]:
    """Numbers of words of one length, some at a time; those longer than ``long`` one by one."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for some in np.split(order, cuts[1:]) if len(order) else ():
        step = 8192 if sizes[some[0]] <= long else 1
        yield from (some[p : p + step] for p in range(0, len(some), step))


def word_logs(pieces: Pieces, words: list[str], logs: np.ndarray, long: int = Settings.long) -> np.ndarray:
    """Log of the sum over all segmentations of each word, by language."""
    out = np.zeros((len(words), logs.shape[0]))
    marked = [_SPACE + w for w in words]
    for some in _tables(marked, long):
        slow = some
        if len(marked[some[0]]) <= long:
            table = _Table(pieces, [marked[k] for k in some])
            whole = table.sums(table.chances(logs))[-1]
            out[some] = np.log(np.maximum(whole, _LEAST))
            slow = some[(whole < _LEAST).any(axis=1)]
        for k in slow:
            out[k] = _log_sums(pieces, marked[k], logs)[len(marked[k])]
    return out


def expected_uses(pieces: Pieces, words: list[str], of: np.ndarray, times: np.ndarray, logs: np.ndarray, long: int = Settings.long) -> np.ndarray:
    """Expected uses of each piece by language, over all segmentations of ``words``, each of language ``of`` and seen ``times``."""
    out = np.zeros(logs.shape)
    for lang in range(len(logs)):
        own = np.flatnonzero(of == lang)
        marked, n, log = [_SPACE + words[k] for k in own], times[own], logs[lang : lang + 1]
        for some in _tables(marked, long):
            slow = some
            if len(marked[some[0]]) <= long:
                table = _Table(pieces, [marked[k] for k in some])
                chances = table.chances(log)
                ahead, behind = (x[:, :, 0] for x in (table.sums(chances), table.sums(chances, back=True)))
                sure = ahead[-1] >= _LEAST
                weight = np.where(sure, n[some] / np.maximum(ahead[-1], _LEAST), 0)
                shares = [p[:, 0] * ahead[start][rows] * behind[end][rows] * weight[rows] for (start, end, rows, _), p in zip(table.runs, chances)]
                for (place, word), letters in zip(table.spelled.tolist(), table.bytes):
                    for x in letters:
                        out[lang, x] += shares[place][word]
                ids, share = np.concatenate([r[3] for r in table.runs]), np.concatenate(shares)
                out[lang] += np.bincount(ids[ids >= 0], weights=share[ids >= 0], minlength=pieces.size)
                slow = some[~sure]
            for k in slow:
                word = marked[k]
                ahead, behind = _log_sums(pieces, word, log), _log_sums(pieces, word, log, back=True)
                for i, here in enumerate(pieces.arcs(word)):
                    for m, ids in here:
                        share = float(np.exp(ahead[i] + log[:, list(ids)].sum() + behind[i + m] - behind[0])[0]) * n[k]
                        for x in ids:
                            out[lang, x] += share
    return out


def _words(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n``: distinct words by language. A word is a run without ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update(split(text.as_py()))
            rows = [(lang, w, n) for lang, found in seen.items() for w, n in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches put together: words of one length and language are summed at once, and the more the faster."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _some(column: pa.Array) -> Iterator[list[str | None]]:
    """Texts of a column, some at a time."""
    texts, size = [], 0
    for v in column:
        texts.append(v.as_py())
        size += len(texts[-1] or "")
        if size >= _CHUNK:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


#: What ``str.split`` takes for white space beyond the six ASCII characters.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def split(text: str | None) -> list[str]:
    """Words of a text: runs without ASCII white space."""
    text = text or ""
    return _WORD.findall(text) if _OTHER_BLANKS.search(text) else text.split()


def fit(docs: DataFrame, path: str, s: Settings = Settings()) -> Model:
    """Piece probabilities of every language in ``lang`` over all rows of ``docs``; rows without a language or text teach nothing.

    Repeated rows count as often. The languages are few (codes); the model has a number
    per piece and language, and it is collected and sent out with the tasks.
    """
    known = docs.filter("lang is not null and text is not null")
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(shares))
    pieces = _pieces(path)
    logs = np.full((len(languages), pieces.size), -math.log(pieces.size))
    if not languages:
        return Model((), (), logs, path)
    number = {lang: k for k, lang in enumerate(languages)}
    with kept_table(_words(known)) as words:
        for _ in range(s.rounds):

            def run(batches: Iterator[pa.RecordBatch], logs: np.ndarray = logs) -> Iterator[pa.RecordBatch]:
                pieces, total = _pieces(path), np.zeros(logs.shape)
                for rows in _rows(batches):
                    of = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
                    total += expected_uses(pieces, rows.column("word").to_pylist(), of, rows.column("n").to_numpy().astype(np.float64), logs, s.long)
                lang, piece = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[lang, piece])], names=["lang", "piece", "uses"])

            uses = np.full(logs.shape, s.added)
            for r in words.mapInArrow(run, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect():
                uses[r["lang"], r["piece"]] += r["uses"]
            logs = np.log(uses / uses.sum(axis=1, keepdims=True))
    total = sum(shares.values())
    return Model(languages, tuple(shares[x] / total for x in languages), logs.astype(np.float32), path)


def predict(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language given the text.

    The whole text counts; its language, if there is such a column, does not. A null
    text, one without a letter, and any text under a model without languages is
    ``und`` with score 0. Of equal languages the first by name is taken. All columns
    stay, but for earlier ones of these two names; repeated rows repeat.
    """
    rest = docs.drop("lang_pred", "score")
    where = rest.columns.index("text")
    names, logs = model.languages, model.logs.astype(np.float64)
    shares, path = np.log(np.array(model.shares or [1.0])), model.path
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs = _pieces(path), sent.value
        # the sums of the words that came first
        known: dict[str, int] = {}
        held = np.zeros((s.kept, len(names)))
        for batch in batches:
            langs, scores = [], []
            for texts in _some(batch.column(where)):
                parts = [split(t) if t and names and any(map(str.isalpha, t)) else [] for t in texts]
                codes, words = pd.factorize(np.array(list(chain.from_iterable(parts)), object))
                logs_of = np.zeros((len(words), len(names)))
                at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                logs_of[at >= 0] = held[at[at >= 0]]
                new = np.flatnonzero(at < 0)
                logs_of[new] = word_logs(pieces, [words[k] for k in new], logs, s.long)
                keep = [k for k in new[: s.kept - len(known)].tolist() if len(words[k]) < s.long]
                held[len(known) : len(known) + len(keep)] = logs_of[keep]
                known.update(zip((words[k] for k in keep), range(len(known), len(known) + len(keep))))
                sizes = [len(p) for p in parts]
                for some in np.split(codes, np.cumsum(sizes)[:-1]):
                    if not len(some):
                        langs.append(UNKNOWN), scores.append(0.0)
                        continue
                    total = shares + logs_of[some].sum(axis=0)
                    best = int(np.argmax(total))
                    langs.append(names[best]), scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, f"{columns_of(rest)}, lang_pred string, score double")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def identify(docs: DataFrame, path: str, s: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row of ``docs``, learnt from the rows that are not held out (checksum of the id modulo 4 is 2)."""
    held = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held).select("lang", "text"), path, s)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, s).select("doc_id", "held_out", "lang_pred", "score")
