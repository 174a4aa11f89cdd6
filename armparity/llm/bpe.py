"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

A token sequence is the encoding of its bytes exactly when every two neighbours are, so
every prefix of a piece has one last token, found from the last tokens of shorter
prefixes. The transducer keeps those prefixes at which a longer token may still begin
(the bytes since the oldest of them are bounded by the longest token), each with the
tokens its encoding has beyond what all of them share. A token leaves as soon as all
live prefixes agree on it. States are made when first met; transitions are kept.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from armparity.llm.common import columns_of, tidy

#: Bounds of the two caches of a worker; a full cache starts anew, results do not change.
MAX_TRANSITIONS = 400_000
MAX_PIECES = 250_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: one base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, data.split(b"\n")))}


class Transducer:
    """Encodes one piece (a match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._starts = {token[:k] for token in ranks for k in range(1, len(token))}
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (b"", ((0, -1, ()),))
        self._ids: dict[tuple, int] = {start: 0}
        self._states: list[tuple] = [start]
        self._next: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, data: bytes, barred: int = -1) -> list[int]:
        """Encoding by repeated merging of the lowest-ranked pair, without the rank ``barred``; used for single tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank != barred and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token`` in its own encoding; None for a byte or a token no text yields."""
        if token not in self._split:
            cut = None
            if len(token) > 1:
                # leave out the token itself: what is left in the end are its two halves
                parts = self.merge(token, self.ranks[token])
                if len(parts) == 2:
                    cut = (self.bytes_of[parts[0]], self.bytes_of[parts[1]])
            self._split[token] = cut
        return self._split[token]

    def _reachable(self, token: bytes) -> bool:
        return len(token) == 1 or self._halves(token) is not None

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Tokens at one edge of ``token`` while its merges run, smallest first, each with the rank that ends it."""
        key = (token, side)
        if key not in self._spines:
            edge, ends = [], 1 << 60
            while True:
                edge.append((token, ends))
                halves = self._halves(token)
                if halves is None:
                    break
                ends, token = self.ranks[token], halves[side]
            self._spines[key] = edge[::-1]
        return self._spines[key]

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes: no merge crosses the border first.

        Of equal ranks the leftmost merge runs first, so a crossing merge gives way to
        one inside the left token and precedes one inside the right.
        """
        if left < 0:
            return True
        key = (left, right)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= MAX_TRANSITIONS:
                self._pairs.clear()
            a, b = self._spine(self.bytes_of[left], 1), self._spine(self.bytes_of[right], 0)
            i = j = 0
            found = True
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                crossing = self.ranks.get(x + y)
                if crossing is not None and crossing < x_ends and crossing <= y_ends:
                    found = False
                    break
                if i == len(a) - 1 and j == len(b) - 1:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self._pairs[key] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition of ``state`` on ``byte``: next state and the tokens now certain."""
        tail, live = self._states[state]
        window = tail + bytes((byte,))
        size, ranks, starts = len(window), self.ranks, self._starts
        kept, pasts, reached = [], [], None
        for back, last, pending in live:
            span = window[size - back - 1 :]
            if reached is None:
                rank = ranks.get(span)
                if rank is not None and (back == 0 or self._reachable(span)) and self._adjacent(last, rank):
                    reached = (rank, pending + (rank,))
            if span in starts:
                kept.append((back + 1, last))
                pasts.append(pending)
        if reached is None:
            raise ValueError("the ranks lack a single byte")
        if not kept:
            key, out = (b"", ((0, reached[0], ()),)), reached[1]
        else:
            kept.append((0, reached[0]))
            pasts.append(reached[1])
            low, high = min(pasts), max(pasts)  # what these two share, all share
            shared = 0
            for x, y in zip(low, high):
                if x != y:
                    break
                shared += 1
            out = low[:shared]
            key = (window[size - kept[0][0] :], tuple([(back, last, p[shared:]) for (back, last), p in zip(kept, pasts)]))
        target = self._ids.get(key)
        if target is None:
            target = self._ids[key] = len(self._states)
            self._states.append(key)
        self._next[state * 256 + byte] = found = (target, out)
        return found

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodings of sorted pieces; each starts where it parts from the one before."""
        if len(self._next) >= MAX_TRANSITIONS:
            self._reset()
        known, states, ranks = self._next, self._states, self.ranks
        path, ends, out = [0], [0], []  # after each byte of the piece before: the state, and the tokens out by then
        before, found = b"", []
        for piece in pieces:
            whole = ranks.get(piece)
            if whole is not None:
                found.append([whole])
                continue
            same = 0
            for x, y in zip(before, piece):
                if x != y:
                    break
                same += 1
            del path[same + 1 :], ends[same + 1 :]
            state = path[same]
            del out[ends[same] :]
            for byte in piece[same:]:
                step = known.get(state * 256 + byte)
                state, tokens = step if step is not None else self._step(state, byte)
                if tokens:
                    out.extend(tokens)
                path.append(state)
                ends.append(len(out))
            before = piece
            found.append([*out, *states[state][1][-1][2]])
        return found


class Encoder:
    """Whole texts to ids: split by the pattern, each piece through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self._split = regex.compile(pattern).findall
        self._pieces: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._split(t) for t in texts]
        known = self._pieces
        new = set().union(*split).difference(known)
        if len(known) + len(new) > MAX_PIECES:
            known.clear()
            new = set().union(*split)
        new = sorted(p.encode("utf-8") for p in new)
        for piece, ids in zip(new, self.transducer.encode_all(new)):
            known[piece.decode("utf-8")] = array("I", ids).tobytes()
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def stream(self, texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[bytes]:
        """:meth:`packed` over any number of texts, about ``chars`` characters at a time; null as empty."""
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= chars:
                yield from self.packed(held)
                held, size = [], 0
        yield from self.packed(held)


#: Bytes a UTF-8 character needs after its first byte, by ranges of the first byte.
_FOLLOWERS = ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))


class Utf8Stream:
    """Incremental UTF-8: text comes out as soon as its characters are whole.

    The state is the unfinished character at the end of what was fed: its bytes so far
    (three at most). Malformed bytes come out as U+FFFD.
    """

    def __init__(self):
        self.pending = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not whole yet."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if 0x80 <= byte <= 0xBF:
                continue
            for low, high, need in _FOLLOWERS:
                if low <= byte <= high:
                    return back if back <= need else 0
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        held = self._unfinished(data)
        self.pending = data[len(data) - held :] if held else b""
        return (data[: len(data) - held] if held else data).decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], chunk: int = 65_536) -> Iterator[str]:
    """Text of an id stream, in pieces that never cut a character."""
    stream, held = Utf8Stream(), []
    for i in ids:
        held.append(bytes_of[i])
        if len(held) == chunk:
            yield stream.feed(b"".join(held))
            held = []
    yield stream.feed(b"".join(held))
    yield stream.finish()


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(parse_ranks(f.read()), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of their whole texts in ``out``, an ``array<int>``.

    ``path`` names a rank file every worker can read, as it comes with the tokenizer
    package. Null texts count as empty and give no ids; a column named ``out`` is replaced.
    """
    rest = docs.drop(out) if out in docs.columns else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            ids = [array("i", p) for p in encoder.stream(v.as_py() for v in texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return rest.mapInArrow(tidy(run), f"{columns_of(rest)}, `{out}` array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``out``; null ids give an empty text."""
    rest = rows.drop(out) if out in rows.columns else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _encoder(path, "").transducer.bytes_of
        for batch in batches:
            texts = ["".join(decode_stream(x or (), bytes_of)) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rest.mapInArrow(tidy(run), f"{columns_of(rest)}, `{out}` string")


def round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and give digests of both: one row per input row.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` over the ids as little-endian
    unsigned 32-bit integers, ``decoded_sha256`` over the decoded bytes, and with
    ``keep_ids`` the ids. The ids stay in the worker otherwise. Rows are taken one by
    one, so repeated rows give repeated results, null texts count as empty, ``doc_id``
    passes as it is, and other columns play no part.
    """
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = f"doc_id {dict(narrow.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        bytes_of = encoder.transducer.bytes_of
        for batch in batches:
            counts, encoded, decoded, kept = [], [], [], []
            for packed in encoder.stream(v.as_py() for v in batch.column(1)):
                counts.append(len(packed) // 4)
                encoded.append(hashlib.sha256(packed).hexdigest())
                digest = hashlib.sha256()
                for part in decode_stream(memoryview(packed).cast("I"), bytes_of):
                    digest.update(part.encode("utf-8"))
                decoded.append(digest.hexdigest())
                if keep_ids:
                    kept.append(array("i", packed))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return narrow.mapInArrow(tidy(run), schema)
