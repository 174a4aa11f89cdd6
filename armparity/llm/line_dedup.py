"""Line dedup by pairwise alignment: common blocks go from the later of two overlapping documents.

Every line is hashed; lines that one document alone has are left out from there on. A
document is paired with the first holder of each of its lines, of each further copy of a
line, and of each run of 2, 4, 8, ... of its shared lines and of all of them. So it has
a number of partners that depends on its own lines only, however many hold a line: no
group is expanded into pairs and no frequent line needs a cap. In each pair the lines
found in common are aligned by patience diff. Its anchors are the rare lines, those that
occur once on either side; their longest increasing run is kept, and repeated lines are
matched in order between anchors. Runs of aligned lines form blocks, and blocks that are
long enough are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armparity.llm.common import BLANKS, checkpointed, fingerprint, fresh, tidy

#: A block of fewer words is no sign of copying and stays.
LEAST_WORDS = 5


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run of ``values`` (patience sorting; of equal runs, the one with the smallest ends)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tops, v)
        if at == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[at], piles[at] = v, k
        back[k] = piles[at - 1] if at else -1
    run, k = [], piles[-1] if piles else -1
    while k >= 0:
        run.append(k)
        k = back[k]
    return run[::-1]


def patience(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[int]:
    """Positions of ``right`` that align with ``left``; both are (position, line) in order of position.

    Lines that both sides have once are anchors. Between two neighbouring anchors, the
    remaining lines are matched greedily in order.
    """
    def once(side: Iterable[tuple[int, int]]) -> dict[int, int]:
        seen: dict[int, int] = {}
        for k, (_, line) in enumerate(side):
            seen[line] = k if line not in seen else -1
        return {line: k for line, k in seen.items() if k >= 0}

    ours, theirs = once(right), once(left)
    both = [(k, theirs[line]) for line, k in ours.items() if line in theirs]
    both.sort()
    anchors = [both[i] for i in _increasing([b for _, b in both])]
    out = []
    low_r = low_l = 0
    for high_r, high_l in [*anchors, (len(right), len(left))]:
        places: dict[int, list[int]] = {}
        for k in range(low_l, high_l):
            places.setdefault(left[k][1], []).append(k)
        at = low_l
        for k in range(low_r, high_r):
            found = places.get(right[k][1])
            if found:
                j = bisect_left(found, at)
                if j < len(found):
                    out.append(right[k][0])
                    at = found[j] + 1
        if high_r < len(right):
            out.append(right[high_r][0])
        low_r, low_l = high_r + 1, high_l + 1
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per document and distinct line: document, line hash, words, and where the line is.

    ``at`` holds (position, ordinal among the lines that are not blank).
    """
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    narrow = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text")
    place = pa.struct([("p", pa.int32()), ("o", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            h1, h2, words, at = [], [], [], []
            for row, value in enumerate(batch.column(3)):
                seen: dict[str, list[tuple[int, int]]] = {}
                ordinal = 0
                for p, line in enumerate(value.as_py().split("\n")):
                    line = line.strip(BLANKS)
                    if line:
                        seen.setdefault(line, []).append((p, ordinal))
                        ordinal += 1
                for line, places in seen.items():
                    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
                    rows.append(row)
                    h1.append(_signed(h >> 64))
                    h2.append(_signed(h & (1 << 64) - 1))
                    words.append(len(line.split()))
                    at.append([{"p": p, "o": o} for p, o in places])
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(words, pa.int32()), pa.array(at, pa.list_(place))], names=["doc_id", "k1", "k2", "h1", "h2", "words", "at"])

    return narrow.mapInArrow(tidy(run), "doc_id bigint, k1 bigint, k2 bigint, h1 bigint, h2 bigint, words int, at array<struct<p:int,o:int>>")


_KEYS = "g1 bigint, g2 bigint, doc_id bigint, k1 bigint, k2 bigint, size int, at array<int>"


def _sequence(lines: list[dict]) -> list[tuple[int, int, int, tuple[int, int]]]:
    """Position, ordinal, words and hash of the shared lines of a document, in order."""
    return sorted((x["p"], x["o"], line["words"], (line["h1"], line["h2"])) for line in lines for x in line["at"])


def _keys_of(hashes: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, list[int]]]:
    """Keys by which a document finds partners: hash, lines it stands for, and where these start in ``hashes``.

    A line has one key with all its places, and one with its k-th place for each further
    copy. A run of 2, 4, 8, ... lines, and the run of all, has one for each copy.
    """
    def keys(level: list[bytes], size: int) -> Iterator[tuple[int, int, int, list[int]]]:
        places: dict[bytes, list[int]] = {}
        for k, h in enumerate(level):
            places.setdefault(h, []).append(k)
        for h, at in places.items():
            for k, place in enumerate(at):
                d = h if size == 1 and not k else xxhash.xxh3_128_digest(h + size.to_bytes(8) + k.to_bytes(8))
                yield int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True), size, at if size == 1 and not k else [place]

    level = [a.to_bytes(8, signed=True) + b.to_bytes(8, signed=True) for a, b in hashes]
    yield from keys(level, 1)
    whole = xxhash.xxh3_128_digest(b"".join(level))
    size = 1
    while 2 * size <= len(hashes):
        level = [xxhash.xxh3_128_digest(a + b) for a, b in zip(level, level[size:])]
        size *= 2
        yield from keys(level, size)
    if size < len(hashes):
        yield from keys([whole], len(hashes))


def _keys(shared: DataFrame) -> DataFrame:
    """The keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = [h for _, _, _, h in _sequence(batch.column(3)[row].as_py())]
                found = list(_keys_of(hashes))
                for low in range(0, len(found), 1 << 14):
                    g1, g2, size, at = zip(*found[low : low + (1 << 14)])
                    own = [pa.array([batch.column(c)[row].as_py()] * len(g1), pa.int64()) for c in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), *own, pa.array(size, pa.int32()), pa.array(at, pa.list_(pa.int32()))],
                        names=["g1", "g2", "doc_id", "k1", "k2", "size", "at"])

    return shared.select("doc_id", "k1", "k2", "lines").mapInArrow(tidy(run), _KEYS)


def _aligned(hashes: list[tuple[int, int]], found: list[dict]) -> set[int]:
    """Places in ``hashes`` that align with a partner, from the keys that each partner has."""
    names: dict[tuple[int, int], int] = {}
    ids = [names.setdefault(h, len(names)) for h in hashes]
    partners: dict[tuple[int, int], list[dict]] = {}
    for x in found:
        partners.setdefault((x["a1"], x["a2"]), []).append(x)
    out: set[int] = set()
    for keys in partners.values():
        ours: set[int] = set()
        theirs: dict[int, int] = {}
        runs: dict[int, list[tuple[int, int]]] = {}
        for x in keys:
            if len(x["at"]) > 1 or len(x["first_at"]) > 1:
                ours.update(x["at"])
                theirs.update((k, ids[x["at"][0]]) for k in x["first_at"])
            else:
                a, b = x["at"][0], x["first_at"][0]
                runs.setdefault(b - a, []).append((a, a + x["size"]))
        for ahead, parts in runs.items():
            done = 0
            for low, high in sorted(parts):  # runs overlap; each place is taken once
                for k in range(max(low, done), high):
                    ours.add(k)
                    theirs[k + ahead] = ids[k]
                done = max(done, high)
        out.update(patience(sorted(theirs.items()), [(k, ids[k]) for k in sorted(ours)]))
    return out


def _blocks(found: DataFrame, least_words: int) -> DataFrame:
    """Ranges of positions that go from each document: runs of aligned lines with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines, keys in zip(batch.column(2), batch.column(3)):
                sequence = _sequence(lines.as_py())
                ranges, block, words = [], [], 0
                for k in [*sorted(_aligned([h for _, _, _, h in sequence], keys.as_py())), None]:
                    x = None if k is None else sequence[k]
                    if block and (x is None or x[1] != block[-1][1] + 1):
                        if words >= least_words:
                            ranges.append({"a": block[0][0], "b": block[-1][0]})
                        block, words = [], 0
                    if x is not None:
                        block.append(x)
                        words += x[2]
                out.append(ranges)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["k1", "k2", "ranges"])

    return found.mapInArrow(tidy(run), "k1 bigint, k2 bigint, ranges array<struct<a:int,b:int>>").filter(F.size("ranges") > 0)


def duplicate_blocks(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``k1``, ``k2`` (fingerprint of id and text) and ``ranges`` of line positions, for each document that loses lines."""
    occ = _occurrences(docs)
    several = occ.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h1", "h2")
    shared = checkpointed(occ.join(several, ["h1", "h2"]).groupBy("doc_id", "k1", "k2").agg(F.collect_set(F.struct("h1", "h2", "words", "at")).alias("lines")))
    keys = _keys(shared)
    first = (keys.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "k1", "k2", "at")).alias("first"), F.max("doc_id").alias("last"))
             .filter("first.doc_id < last").select("g1", "g2", "first"))
    match = F.struct("size", "at", F.col("first.k1").alias("a1"), F.col("first.k2").alias("a2"), F.col("first.at").alias("first_at"))
    found = keys.join(first, ["g1", "g2"]).filter("doc_id > first.doc_id").groupBy("k1", "k2").agg(F.collect_list(match).alias("found"))
    return _blocks(shared.select("k1", "k2", "lines").join(found, ["k1", "k2"]), least_words)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, count: str | None = None) -> DataFrame:
    """``docs`` with the duplicated blocks cut out of ``text``; every row stays, with all its columns.

    Documents are ordered by ``doc_id``, and rows of one id are not compared with each
    other. Lines are compared without white space at either end; blank lines are not
    compared and go only inside a block. A block goes if it has ``least_words`` words.
    Repeated rows are cut alike. A line that only one document has stays, also where it
    repeats it. Where several rows of the first id hold a line, the one with the lowest
    fingerprint is aligned. Rows with a null ``doc_id`` or a null or empty text pass
    unchanged and are compared with nothing. ``count`` names a column for the number of
    lines cut.
    """
    k1, k2 = fingerprint(F.col("doc_id"), F.col("text"))
    a, b, ranges = fresh(docs, "k1", "k2", "ranges")
    joined = docs.withColumns({a: k1, b: k2}).join(duplicate_blocks(docs, least_words).toDF(a, b, ranges), [a, b], "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.exists(ranges, lambda r: (i >= r["a"]) & (i <= r["b"])))
    text = F.when(F.col(ranges).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    cut = F.coalesce(F.aggregate(ranges, F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0))
    return joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], *([cut.alias(count)] if count else []))


def keep_rest(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """:func:`dedup_lines` without the documents of which it leaves no word; those that had none before stay."""
    count = fresh(docs, "cut")[0]
    return dedup_lines(docs, least_words, count).filter((F.col(count) == 0) | F.col("text").rlike(f"[^{BLANKS}]")).drop(count)
