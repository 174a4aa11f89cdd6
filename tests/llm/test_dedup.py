import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from armparity.llm import line_dedup, ngram_join, suffix_dedup
from armparity.llm.common import words_of
from armparity.llm.graph import components

LINES = [f"line number {k} of the common text here" for k in range(40)]


def test_blocks_go_from_the_later_document(docs_of):
    a, b = "\n".join(LINES[:6]), "\n".join(["own words at the start of it", *LINES[2:5], "", LINES[5], "own end"])
    rows = [(1, a), (2, b), (2, b), (3, None), (4, ""), (None, a), (5, "\n".join(reversed(LINES[:3]))), (6, "ok\nshort"), (7, "ok\nother"), (8, "x y z a b\nx y z a b")]
    docs = docs_of(rows)
    out = line_dedup.dedup_lines(docs, count="cut")
    assert out.columns == [*docs.columns, "cut"]
    kept = "own words at the start of it\nown end"
    assert out.count() == len(rows) and out.filter("doc_id = 2").select("text", "cut").distinct().count() == 1
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].text == kept and by[2].cut == 5 and by[1].text == a and by[3].text is None and by[4].text == "" and by[None].text == a
    assert by[5].cut == 1  # of lines in another order only one run can align
    assert by[7].text == "ok\nother" and by[8].cut == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_patience_keeps_an_increasing_run():
    assert line_dedup.patience([(0, 1), (1, 2), (2, 3)], [(0, 3), (1, 1), (2, 2)]) == [1, 2]
    assert line_dedup.patience([(0, 9), (1, 1), (2, 9)], [(0, 9), (1, 9), (2, 1), (3, 9)]) == [0, 2, 3]


def test_lines_against_brute_force(docs_of):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choices(LINES, k=rng.randint(1, 6)) if i % 2 else [f"{i} {k} some words of its own" for k in range(3)] + LINES[i % 30 : i % 30 + 3])) for i in range(60)]
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            first.setdefault(line, i)
    out = {r.doc_id: r.text.split("\n") if r.text else [] for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    for i, t in rows:
        lines = t.split("\n")
        assert all(line in out[i] for line in lines if first[line] == i)  # nothing of its own goes
        if len(set(lines)) == len(lines) and len({first[line] for line in lines if first[line] < i}) == 1:
            order = [rows[first[line]][1].split("\n").index(line) for line in lines if first[line] < i]
            if order == sorted(order):
                assert out[i] == [line for line in lines if first[line] == i]


def test_copies_whose_lines_have_other_first_holders(docs_of):
    many = [f"{k} is one of a hundred lines here" for k in range(100)]
    odd, twice = [f"odd {line}" for line in LINES], "this line is there several times over"
    rows = [(1, many[::-1]), (2, many), (3, many), (4, ["own words before the block start", *many[20:52], "own words behind the block end"]),
            (5, [odd[1], odd[0]]), (6, odd[:2]), (7, odd[:2]), (8, odd[1::-1]), (9, [twice]), (10, [twice, odd[9], twice, twice]), (11, [twice, twice, twice, odd[10]])]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of([(i, "\n".join(t)) for i, t in rows])).collect()}
    assert out[1] == "\n".join(many[::-1]) and len(out[2].split("\n")) == 99  # in another order only one line can align
    assert out[3] == "" and out[4] == "own words before the block start\nown words behind the block end"
    assert out[6] in odd[:2] and out[7] == "" and out[8] == ""
    assert out[10].split("\n").count(twice) == 2 and out[11] == odd[10]


def test_copies_in_crossing_order_against_brute_force(docs_of):
    rng = random.Random(21)
    rows = []
    for i in range(80):
        t = list(rows[rng.randrange(i)][1]) if i % 3 == 2 else rng.choices(LINES[:12], k=rng.randint(2, 9))
        rows.append((i, t))
    out = {r.doc_id: r.text.split("\n") if r.text else [] for r in line_dedup.dedup_lines(docs_of([(i, "\n".join(t)) for i, t in rows])).collect()}
    for i, t in rows:
        assert all(line in out[i] for line in t if not any(line in u for _, u in rows[:i]))  # nothing of its own goes
        if any(t == u for _, u in rows[:i]):
            assert out[i] == []  # a copy of any earlier document goes as a whole


def sets(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_rows(rng):
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 50)) for _ in range(rng.randint(3, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "q9"])
        rows.append((i, (" " if i % 2 else "\n").join(w)))
    return rows


def test_near_duplicates_against_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks in a group
    rows = [*near_rows(random.Random(5)), (500, None), (501, ""), (502, " \n"), (503, "solo"), (503, "solo"), (504, "SOLO")]
    s = [sets(t) for _, t in rows]
    link = [[j for j in range(len(rows)) if i != j and s[i] and s[j] and len(s[i] & s[j]) * 5 >= len(s[i] | s[j]) * 4] for i in range(len(rows))]

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(rows[j][0] for j in seen)

    want = sorted((rows[i][0], reach(i), len(link[i])) for i in range(len(rows)))
    docs = docs_of(rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()) == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_depth_follows_the_target():
    assert ngram_join.prefix_depth(0.8, 40, 0.99999) == 6 and ngram_join.prefix_depth(0.8, 40, 0.9) > 6
    with pytest.raises(ValueError):
        ngram_join.prefix_depth(0.1, 2, 0.9999)


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows):
    seen, n = {}, suffix_dedup.LENGTH
    for t in rows:
        for s in range(len(t) - n + 1):
            seen[t[s : s + n]] = seen.get(t[s : s + n], 0) + 1
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2048, 1])
def test_substrings_against_brute_force(docs_of, group):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    passage, short = text(900), text(330)
    rows = [(1, text(300) + passage + text(50)), (2, passage[100:700]), (3, text(500)), (4, text(20) + passage[200:620] + text(700)), (5, short), (6, short), (7, None), (8, ""),
            (9, "ab" * 700), (10, text(80) + passage[:405] + text(9) + passage[480:]), (11, text(600)), (11, text(450)), (None, passage[:399]), (12, passage[500:] * 2)]
    rows.append(rows[2])  # a repeated row is a copy
    docs = docs_of(rows)
    want = sorted((i or 0, *x) for (i, _), x in zip(rows, brute_spans([(t or "").encode() for _, t in rows])))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(docs, group).collect())
    assert got == want
    assert suffix_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_slices_of_a_long_text_leave_no_window_out(monkeypatch):
    text = "".join(random.Random(12).choices("abcdefgh", k=7000)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * 450, text], pa.binary())], names=["data"])

    def windows():
        found = {}
        for data, ends, rows in suffix_dedup._groups(batch, 0):
            starts = [0, *ends[:-1]]
            for p, lo, hi, _ in zip(*suffix_dedup.anchors(np.frombuffer(data, np.uint8), ends)):
                k = int(np.searchsorted(ends, p, side="right"))
                row, at = rows[k]
                for w in range(int(lo), int(hi) + 1):
                    key = (row, w + at - int(starts[k]))
                    assert key not in found
                    found[key] = int(p) + at - int(starts[k])
        return found

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "SLICE", 1500)
    assert windows() == whole and len(whole) == 7000 - 399 + 51


def test_pairs_and_windows_say_the_same(monkeypatch):
    rng = random.Random(13)
    text = lambda n: bytes(rng.choices(b"abcd", k=n))
    core = text(900)
    for _ in range(20):
        chunks, places = [], []
        while len(chunks) < rng.randint(2, 12):
            low, high = rng.randint(0, 300), rng.randint(600, 900)
            before, after = text(rng.choice([0, 40])), text(rng.choice([0, 30]))
            chunk = before + core[low:high] + after
            if len(chunk) >= 400 and chunk not in chunks and 400 - low + len(before) + 128 <= len(chunk):
                chunks.append(chunk)
                places.append(400 - low + len(before))
        every = []
        for most in (48, 1):
            monkeypatch.setattr(suffix_dedup, "PAIRS", most)
            every.append(suffix_dedup.equal_windows(chunks, places))
        # the window loop looks only at windows that hold the anchor
        held = [[(max(a, 0), min(b, p)) for a, b in runs if max(a, 0) <= min(b, p)] for runs, p in zip(every[0], places)]
        assert held == every[1]


def test_suffix_order_and_collisions(monkeypatch):
    parts = [b"abc", b"ab", b"abd", b"", b"zz"]
    order = suffix_dedup._Sorted(parts)
    assert sorted(range(5), key=lambda k: order.rank[k]) == sorted(range(5), key=lambda k: parts[k])
    monkeypatch.setattr(suffix_dedup, "_LETTERS", np.ones(256, np.uint64))  # every hash of a length collides
    assert suffix_dedup._Sorted([b"abc", b"abd"]).extension(0, 1) == 2
