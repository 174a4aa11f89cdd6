import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from armparity.llm import ann_forest, context_mixing, decontaminate
from armparity.llm.common import words_of


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, size=(900, 1))
    x[100:130] = x[100]  # copies: ties go to the smaller id
    rows = [(int(i), [float(v) for v in x[i]], 1.5) for i in range(900)]
    bad = [(2000, None, 0.0), (2020, [0.0] * 16, 0.0), (2040, [float("nan")] * 16, 0.0), (2060, [None] + [1.0] * 15, 0.0), (2080, [1.0] * 3, 0.0), (2100, [], 0.0), (None, [1.0] * 16, 0.0), rows[7]]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, score double")
    small = ann_forest.Settings(trees=24, bits=12, least=200, index_block=400, query_block=16)
    got = {}
    for r in ann_forest.nearest(df, F.col("vec_id") % 20 == 0, s=small).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 900, 20)}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in found)
        scores = sorted(((-round(float(x[q] @ x[i]), 9), i) for i in range(900) if i != q))[:20]
        hits += len({i for _, i in scores} & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    assert [i for _, i, _ in sorted(got[100])] == list(range(101, 121))
    few = ann_forest.nearest(df.filter("vec_id < 5"), F.col("vec_id") == 0, s=small).collect()
    assert len(few) == 4
    assert ann_forest.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_scores(spark, docs_of):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(1, 120)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "never seen words only"), (203, "É W1\tw1\u00a0w2"), (None, "w1 w2"), (4, rows[4][1]), (205, "w1 " * 30_000)]
    docs = docs_of(rows)
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = context_mixing.score(docs, held, context_mixing.Settings(slots=12)).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for i, t in rows:
        if i is None or i % 3:
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        tokens = [*words_of(t), None]
        for r in by[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[w] > 0 for w in tokens), n, i is not None and i % 3 == 0)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
            assert r.score < 0
    assert by[4][0].score == by[4][1].score
    assert by[203][0].n_tokens == 4 and by[200][0].bits_per_byte is None
    plain = [r for i in range(0, 120, 3) for r in by[i]]
    assert sum(r.score for r in plain) > 1.6 * sum(r.base_score for r in plain)
    assert context_mixing.score(docs.limit(0), held, context_mixing.Settings(slots=8)).count() == 0


def test_codes_are_a_full_prefix_code():
    lengths = context_mixing.code_lengths(np.array([50, 1, 1, 7, 20, 3]))
    codes = context_mixing.canonical(lengths)
    assert sum(2.0 ** -int(n) for n in lengths) == 1
    assert len({format(c, f"0{n}b") for c, n in zip(codes, lengths)}) == 6


def test_probabilities_of_a_step_sum_to_one():
    s = context_mixing.Settings(slots=10)
    alphabet = context_mixing.Alphabet(["a", "b", "c"], np.array([5, 3, 1]), 2, 4, np.zeros(257))
    rng = np.random.default_rng(1)
    mixer = context_mixing.Mixer(rng.integers(0, 9, (context_mixing.CONTEXTS, 2 << s.slots)).astype(float))
    total = 0.0
    for symbol in range(alphabet.letters):  # every way to go on after "a"
        one = np.array([2, symbol], np.int64)
        both, first = (mixer.score(x, 0, [(0, len(x), 0)], alphabet, s)[0] for x in (one, one[:1]))
        total += math.exp(both - first)
    assert total == pytest.approx(1.0, abs=1e-5)


def test_a_text_in_parts_scores_like_the_whole():
    s = context_mixing.Settings(slots=10, segment=8, block=4)
    alphabet = context_mixing.Alphabet(["a", "b", "c"], np.array([5, 3, 1]), 2, 4, np.zeros(257))
    mixer = context_mixing.Mixer(np.random.default_rng(2).integers(0, 9, (context_mixing.CONTEXTS, 2 << s.slots)).astype(float))
    symbols, spelled = alphabet.symbols(list("abcabcxaabbccyab"))
    assert spelled == ["x", "y"]
    whole = mixer.score(symbols, 0, [(0, len(symbols), 0)], alphabet, s)[0]
    parts = sum(mixer.score(symbols[max(0, low - 2) : low + 16], min(low, 2), [(0, min(16, len(symbols) - low), low)], alphabet, s)[0] for low in range(0, len(symbols), 16))
    assert parts == pytest.approx(whole, rel=1e-5)


def test_weights_are_fitted_on_every_decision_of_all_training_texts(spark, docs_of):
    """More texts than the 96 and longer ones than the 20,000 decisions that a fit once took; the cells are counted one by one."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(0, 40)))) for i in range(150)]
    rows += [(150, "w1 w2 w3 " * 3000), (151, None), (152, "Only here\x0bw1 ")]
    s, held = context_mixing.Settings(slots=12), F.col("doc_id") % 5 == 0
    docs = docs_of(rows).select("doc_id", "text", F.lit(False).alias("held_out")).repartition(5)
    alphabet = context_mixing.Alphabet(words, np.arange(40, 0, -1), 2, len(rows), np.zeros(257))
    shared = spark.sparkContext.broadcast(alphabet)
    coded = context_mixing._coded(docs, shared, np.ones(40))
    training = ~held
    counts = context_mixing._bit_counts(coded, training, shared, s)
    got = context_mixing._mixer(coded, training, shared, counts, s)

    plain, seen = context_mixing._plain_cells(alphabet, s), Counter()
    want, of = np.zeros_like(counts), []
    for i, text in rows:
        if i % 5:
            at, cells = context_mixing._cells(alphabet.symbols(words_of(text))[0], 0, alphabet, s)
            of += list(zip(plain[at].tolist(), *(c.tolist() for c in cells)))
    for cells in of:
        for k, cell in enumerate(cells):
            want[k, cell] += 1
    assert np.array_equal(counts, want)
    for cells in of:
        bit, gate, steps = cells[0] % 2, 0, []
        for k, cell in enumerate(cells):
            zero, one = (want[k, cell - bit + b] - (b == bit) for b in (0, 1))
            steps.append(math.floor(2 * min(8, max(-8, math.log((one + 0.4) / (zero + 0.4)))) + 0.5) + 16)
            gate += (3, 1)[k - 1] * sum(zero + one >= c for c in ((1, 4, 16), (1, 4))[k - 1]) if k else 0
        seen[((gate * 33 + steps[2]) * 33 + steps[1]) * 33 + steps[0], bit] += 1
    table = np.zeros(context_mixing.GATES * 33**3 * 2)
    for (cell, bit), n in seen.items():
        table[cell * 2 + bit] = n
    fitted = context_mixing.Mixer(counts)
    fitted.fit(table)
    assert np.array_equal(got.weights, fitted.weights) and np.array_equal(got.correction, fitted.correction)
    assert not np.array_equal(got.weights, context_mixing.Mixer(counts).weights)


def test_coded_texts_against_words(spark, docs_of):
    rows = [(1, "a\x0bB  éÉ a\x1cx y\n"), (2, None), (3, " \t"), (4, "b zz b ZZ q"), (5, "")]
    alphabet = context_mixing.Alphabet(["a", "b"], np.array([3, 2]), 2, 5, np.zeros(257))
    docs = docs_of(rows).select("doc_id", "text", F.lit(True).alias("held_out"))
    got = {r.doc_id: r for r in context_mixing._coded(docs, spark.sparkContext.broadcast(alphabet), np.array([9, 99])).collect()}
    for i, text in rows:
        words, r = words_of(text), got[i]
        symbols = []
        for w in words:
            symbols += {"a": [2], "b": [3]}.get(w) or [1, *(alphabet.letters + c for c in w.encode()), alphabet.letters + 256]
        assert np.frombuffer(r.symbols, np.int32).tolist() == [*symbols, 0]
        assert (r.n_tokens, r.found, r.size) == (len(words) + 1, sum(w in "ab" for w in words), len((text or "").encode()))
        assert r.base == pytest.approx(sum({"a": 1, "b": 2}.get(w, 0) for w in words))
        assert {x.word: x.times for x in r.tail} == Counter(w for w in words if w not in "ab")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a, b = rng.choices(range(1, 6), k=rng.randint(1, 20)), rng.choices(range(1, 9), k=rng.randint(0, 30))
        masks = {}
        for k, t in enumerate(a):
            masks[t] = masks.get(t, 0) | 1 << k
        assert decontaminate.lcs_length(masks, len(a), b) == lcs(a, b)


def test_leaks(spark, docs_of):
    rng = random.Random(6)
    common, rare = [f"c{k}" for k in range(40)], [f"r{k}" for k in range(3000)]
    some = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    items = {i: some(rng.randint(15, 55)) for i in range(30)}
    rows, leaked = [], {}
    for d in range(300):
        words = some(rng.randint(20, 400))
        if d % 4 == 0:
            i = rng.randrange(30)
            part = items[i] if d % 8 else [w for w in items[i] if rng.random() > 0.1]
            at = rng.randrange(len(words))
            words[at:at] = part
            leaked[d] = i
        rows.append((d, " ".join(words).capitalize() + "."))
    rows += [(900, None), (901, ""), (None, "c1 c2"), (0, rows[0][1])]
    docs = docs_of(rows)
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (50, None), (51, ""), (52, "c1"), (None, "c1 c2 c3 c4 c5 c6")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert decontaminate.find_leaks(docs, bench).count() == len(rows)
    exact = [d for d in leaked if d % 8]
    assert all(leaked[d] in got[d]["items"] for d in exact)
    assert sum(leaked[d] in got[d]["items"] for d in leaked) >= 0.95 * len(leaked)
    assert not any(r.contaminated for d, r in got.items() if d not in leaked)
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.contaminated}
    assert decontaminate.find_leaks(docs, bench.limit(0)).filter("contaminated").count() == 0
    split = decontaminate.find_leaks(docs, bench, decontaminate.Settings(block_chars=2000)).collect()
    assert len(split) == len(rows) and all(leaked[r.doc_id] in r["items"] for r in split if r.doc_id in exact)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_short_items_and_named_items(spark, docs_of):
    bench = spark.createDataFrame([("short", "four words in all"), ("one", "Unique!"), ("long", "a longer item that has more than five words in it"), (None, "no id"), ("void", "")], "item_id string, text string")
    rows = [(1, "Four words, in all."), (2, "here are four words in all of it"), (3, "unique"), (4, "x a longer item that has more than five words in it y"), (5, None), (6, "")]
    got = {r.doc_id: r["items"] for r in decontaminate.find_leaks(docs_of(rows), bench).collect()}
    assert got == {1: ["short"], 2: [], 3: ["one"], 4: ["long"], 5: [], 6: []}


def test_latent_space_against_a_dense_sketch(spark):
    """More passages than one block has, so blocks are added up; words of equal weight in any order."""
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 30, n).astype(np.uint32) for n in [*rng.integers(0, 40, 300), 64 * 1500]]
    coded = spark.createDataFrame([(bytearray(c.tobytes()),) for c in texts], "codes binary").coalesce(1)
    s, idf = decontaminate.Settings(rank=4, extra=2), rng.uniform(1, 3, 29)
    rows = []
    for c in texts:
        for low in range(0, len(c), s.passage):
            x = np.bincount(c[low : low + s.passage], minlength=30)[1:] * idf
            if x.any():
                rows.append(x / np.linalg.norm(x))
    a = np.array(rows)
    test = np.random.Generator(np.random.PCG64(7)).standard_normal((29, 6))
    left, size, _ = np.linalg.svd(a.T @ (a @ test), full_matrices=False)
    want = left[:, :4] * idf[:, None] * (size[0] / size[:4])
    got = decontaminate._latent(coded, idf, s)
    assert np.allclose(np.abs(got), np.abs(want), rtol=1e-3, atol=1e-3)


def test_passage_terms_against_counters():
    rng = np.random.default_rng(4)
    rows = np.sort(rng.integers(0, 9, (40, 16)).astype(np.uint32), axis=1)
    rows[3], rows[7] = 0, 5
    passage, word, count = decontaminate._terms(rows)
    want = {(p, w - 1): n for p in range(40) for w, n in Counter(rows[p].tolist()).items() if w}
    assert dict(zip(zip(passage.tolist(), word.tolist()), count.tolist())) == want


def test_search_against_every_window():
    """The search finds an item wherever any window of its class holds enough of it in order, with the cosine set so low that it excludes nothing."""
    rng = random.Random(2)
    items = [(k, [rng.randint(1, 60) for _ in range(rng.randint(6, 20))]) for k in range(30)]
    s = decontaminate.Settings(cosine=-2.0)
    idf, latent = np.ones(60), np.random.default_rng(1).standard_normal((60, 8)).astype(np.float32)
    index = decontaminate._index(items, latent, idf, s)
    for _ in range(60):
        text = [rng.randint(0, 60) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            item = rng.choice(items)[1]
            kept = [w for w in item if rng.random() < rng.choice([1, 0.85, 0.7])]
            at = rng.randint(0, len(text))
            text[at:at] = kept
        want = {}
        for window, stride, members, _ in index["classes"]:
            for start in range(0, len(text), stride):
                part = text[start : start + window]
                for member in members:
                    item_id, size, masks, _, rare = index["checks"][member]
                    share = decontaminate.lcs_length(masks, size, part) / size
                    if share >= s.copy or share >= s.paraphrase and len(rare.intersection(part)) >= s.answered * len(rare):
                        want[item_id] = max(share, want.get(item_id, 0))
        got = decontaminate._search_text(np.array(text, np.uint32), latent, index, s)
        assert set(got) == set(want)


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8 if i % 3 else 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann_forest.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in (0, 20, 40):
        x = np.array(rows[q][1])
        want = sorted((-float(np.dot(x, v)), i) for i, v in rows if i != q and len(v) == len(x))[:20]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
