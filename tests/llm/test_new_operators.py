import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from armparity.llm import language_id, token_alignment, turn_repair

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = hashlib.sha256(b"").hexdigest()


# --- token alignment -------------------------------------------------------------------------------------------------

ODD = ["Hello  world", " lead", "  two", "tabs\tand\nlines \n\n x", "naïve über 東京 🙂🙂 é", "<|endoftext|> and <s> and <unk>", "a" * 300, "don't we'll  I'd",
       "x y   z", "under▁score", "123 456.789 -- ... !!", "\x1c \x1d a \x85 b", "end ", " ", "\n", "no pieces: ▁", "ﬁ ligature Å", "​zero​ width"]


def _tokens(text):
    """Ids and bytes of both tokenizers over the whole text, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(BYTES)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = token_alignment._byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def _spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def _expected_alignment(rows):
    links, texts = [], []
    for _, text in rows:
        a, b = map(_spans, _tokens(text)) if text else ([], [])
        links.append([(i, j) for i, p, q in a for j, r, s in b if p < s and r < q])
        common = sorted({q for _, _, q in a} & {s for _, _, s in b})
        groups, low = [], 0
        for high in common:
            groups.append(",".join(str(i) for i, _, q in a if low < q <= high) + "|" + ",".join(str(j) for j, _, s in b if low < s <= high))
            low = high
        texts.append((len(a), len(b), len(groups), ";".join(groups)))
    count = Counter(itertools.chain.from_iterable(links))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(d, na, nb, ng, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for (d, _), (na, nb, ng, g), ls in zip(rows, texts, links)]


def test_alignment_against_brute_force(spark, docs_of):
    rng = random.Random(5)
    rows = list(enumerate(ODD))
    rows += [(100 + k, "".join(rng.choice(["the ", "Ünder", "ing", " ", "\n", "q", "東", "thing", ".", "▁", "  "]) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    rows += [(200, None), (201, ""), (3, rows[3][1]), (3, rows[3][1]), (None, "no id"), (202, "longer text " * 400)]
    want = sorted(_expected_alignment(rows), key=str)
    for block in (token_alignment.BLOCK, 200):
        got = token_alignment.link_counts(docs_of(rows).repartition(3), BYTES, PIECES, block).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_groups_and_no_rows(spark, docs_of):
    rows = [(1, "Under the thing 東京"), (2, None), (3, "under▁score")]
    got = {r.doc_id: r.groups for r in token_alignment.align(docs_of(rows), BYTES, PIECES).collect()}
    raw = " Under the thing 東京".encode()
    assert got[2] == got[3] == []
    assert [g["first"] for g in got[1]] == [0, *(g["end"] for g in got[1][:-1])] and got[1][-1]["end"] == len(raw)
    assert [x for g in got[1] for x in g["a"]] == [i for i, _ in _tokens(rows[0][1])[0]] and [x for g in got[1] for x in g["b"]] == [i for i, _ in _tokens(rows[0][1])[1]]
    assert token_alignment.link_counts(docs_of(rows).limit(0), BYTES, PIECES).count() == 0
    named = spark.createDataFrame([("x", "a text"), (None, "")], "doc_id string, text string")
    assert {r.doc_id for r in token_alignment.link_counts(named, BYTES, PIECES).collect()} == {"x", None}


# --- language identification -----------------------------------------------------------------------------------------


def _all_segmentations(pieces, word, logs):
    """Sum over every way to cut the word, one by one."""
    if not word:
        return np.ones(len(logs))
    total = np.zeros(len(logs))
    for n in range(1, len(word) + 1):
        if word[:n] in pieces.ids:
            total += np.exp(logs[:, pieces.ids[word[:n]]]) * _all_segmentations(pieces, word[n:], logs)
        elif n == 1:
            total += np.exp(logs[:, list(pieces.spelled(word[0]))].sum(axis=1)) * _all_segmentations(pieces, word[1:], logs)
    return total


def test_sums_over_all_segmentations():
    pieces, rng = language_id._pieces(PIECES), np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(pieces.size), 3))
    words = ["the", "station", "über", "東京都", "🙂x", "a", "͸͹", "ationally"]
    got = language_id.word_logs(pieces, words, logs)
    assert np.allclose(got, np.log([_all_segmentations(pieces, "▁" + w, logs) for w in words]))
    # the loop for long words, and for words whose sums are too small, says the same
    assert np.allclose(language_id.word_logs(pieces, words, logs, long=1), got)
    long = ["ab" * 40, "東" * 60, "͸" * 47]
    assert np.allclose(language_id.word_logs(pieces, long, logs), language_id.word_logs(pieces, long, logs, long=1)) and np.isfinite(language_id.word_logs(pieces, long, logs)).all()


def test_expected_uses_are_the_gradient():
    # the expected uses of a piece are the derivative of the log sum by its log probability
    pieces, rng = language_id._pieces(PIECES), np.random.default_rng(2)
    logs = np.log(rng.dirichlet(np.ones(pieces.size), 2))
    words, of, times = ["station", "über", "͸ab", "東" * 30], np.array([0, 1, 0, 1]), np.array([2.0, 1.0, 3.0, 1.0])
    got = language_id.expected_uses(pieces, words, of, times, logs)
    assert np.allclose(got, language_id.expected_uses(pieces, words, of, times, logs, long=1))
    for lang, piece in [(0, pieces.ids["ation"]), (0, pieces.ids["s"]), (1, pieces.ids["東"]), (0, int(pieces.bytes["͸".encode()[0]]))]:
        up, low = logs.copy(), logs.copy()
        up[lang, piece] += 1e-4
        low[lang, piece] -= 1e-4
        diff = sum(t * (language_id.word_logs(pieces, [w], up)[0, o] - language_id.word_logs(pieces, [w], low)[0, o]) for w, o, t in zip(words, of, times) if o == lang)
        assert got[lang, piece] == pytest.approx(diff / 2e-4, rel=1e-3, abs=1e-9)


def _two_languages():
    rng = random.Random(4)
    kinds = {"xx": ["alo", "mina", "tero", "sola", "vi"], "yy": ["krug", "schtal", "wen", "dorf", "ung"]}
    rows = []
    for i in range(240):
        lang = rng.choice(["xx", "yy"])
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=2)) for _ in range(rng.randint(3, 20))), lang))
    return rows


def test_language_on_held_out(spark):
    rows = _two_languages()
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !?", "yy"), (None, "aloalo mina", "xx"), (1003, "aloalo mina", None), (1004, "alo" * 5000, "xx"), rows[7]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "doc_id long, text string, lang string, held_out int, lang_pred string")
    got = {}
    for r in language_id.identify(df, PIECES, language_id.Settings(rounds=2)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) + len(odd) and got[7][0] == got[7][1]
    for i, _, lang in rows:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i][0].held_out == held and got[i][0].lang_pred == lang and 0.5 < got[i][0].score <= 1
    for i in (1000, 1001, 1002):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert got[None][0].lang_pred == got[1003][0].lang_pred == got[1004][0].lang_pred == "xx"
    assert not got[None][0].held_out
    # the language, source and id of a row play no part in its prediction
    model = language_id.fit(df, PIECES, language_id.Settings(rounds=1))
    swapped = language_id.predict(df.withColumn("lang", F.lit("yy")).withColumn("doc_id", F.lit(0)), model).select("lang_pred", "score")
    assert sorted(swapped.collect()) == sorted(language_id.predict(df, model).select("lang_pred", "score").collect())


def test_language_without_training(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.identify(spark.createDataFrame([], schema), PIECES).count() == 0
    got = language_id.identify(spark.createDataFrame([(1, "some text", None), (2, None, None)], schema), PIECES).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    # equal languages: the first by name
    even = [(i, "some text", lang) for i, lang in enumerate(["b", "a", "b", "a"])]
    model = language_id.fit(spark.createDataFrame(even, schema), PIECES, language_id.Settings(rounds=1))
    assert {(r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(even, schema), model).collect()} == {("a", 0.5)}


# --- conversations ---------------------------------------------------------------------------------------------------


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _cheapest(rows, faults):
    """Least (cost, audit) and what it leaves, over every sequence of edits with up to three inserts at a place."""
    best = None
    order = [(r, t) for r, t in rows]
    grammar = ("", "s")

    def legal(initials):
        rest = initials[1:] if initials[:1] == "s" else initials
        return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))

    for edits in itertools.product(*([["D"] if f in ("blank", "duplicate") else ["D", "K", "R"] for f in faults])):
        for gaps in itertools.product(range(4), repeat=len(order) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, edits)) + "I" * gaps[-1]
            cost = sum({"I": 3, "D": 4, "K": 0, "R": 3}[e] for e in audit) + sum(3 for e, f in zip(edits, faults) if f == "truncated" and e != "D")
            if best is not None and (cost, audit) >= best[:2]:
                continue
            # roles of rows that are not kept follow from their place
            done, at = [], iter(order)
            for e in audit:
                role, text = ("", "") if e == "I" else next(at)
                if e == "D":
                    continue
                past = [x[:1] for x, _ in done]
                free = "user" if not past or past[-1] in ("s", "a") else "assistant"
                done.append((role if e == "K" else free, text))
            if legal("".join(r[:1] or "?" for r, _ in done)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in done))
    return best


def _expected_report(rows):
    by = {c: [] for c, *_ in rows}
    for row in _damage(rows):
        by[row[0]].append(row)
    out = {}
    for conv, held in by.items():
        held.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], _digest(r[2], r[3])))
        turns, seen, faults = {t for _, t, _, _ in held if t is not None}, set(), []
        for _, _, role, text in held:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, left = _cheapest([(r, t) for _, _, r, t in held], faults)
        initials = [r[:1] for _, _, r, _ in held]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(left.encode()).hexdigest())
    return out


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")


def _reports(spark, rows):
    got = turn_repair.repair_report(turn_repair.damaged(_conversations(spark, rows))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_repair_against_brute_force(spark):
    rng, rows = random.Random(8), []
    for conv in range(160):
        turn = rng.randint(0, 3)
        for _ in range(rng.randint(1, 4)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "assistant", "user", "tool"]), rng.choice(["Yes.", "Yes.", "No!  ", "cut off", " \t", "a?\x0b"])))
            turn += rng.choice([1, 1, 1, 2])
    rows += [(900, None, "user", "a."), (900, None, None, None), (901, 3, "user", "x."), (901, 3, "user", "x."), (None, 1, "user", "q."), (None, 2, "assistant", "r"), (902, None, None, None)]
    assert _reports(spark, rows) == _expected_report(rows)


def test_repair_of_a_long_conversation_and_of_none(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(4000)]
    got = _reports(spark, rows)[1]
    kept = _damage(rows)
    turns = {r[1] for r in kept}
    blank = sum(not r[3].strip() for r in kept)
    assert got[:3] == (max(turns) - min(turns) + 1 - len(turns), blank, len(kept) - blank - len({r[2:] for r in kept if r[3].strip()}))
    # replay of the audit over the damaged rows
    at, text, cost = iter(sorted(kept, key=lambda r: (r[1], r[2], _digest(r[2], r[3])))), [], 0
    for e in got[6]:
        row = (1, 0, "", "") if e == "I" else next(at)
        cost += {"I": 3, "D": 4, "K": 0, "R": 3}[e]
        if e != "D":
            cost += 3 * (e != "I" and row[3].strip()[-1:] not in (".", "!", "?"))
            text.append(f"{row[2] if e == 'K' else 'assistant' if len(text) % 2 else 'user'}:{row[3]}")
    assert next(at, None) is None and cost == got[5] and hashlib.sha256("\n".join(text).encode()).hexdigest() == got[7]
    assert turn_repair.repair_report(turn_repair.damaged(_conversations(spark, rows).limit(0))).count() == 0
    dropped = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _reports(spark, [(dropped, 0, "user", "gone.")])[dropped] == (0, 0, 0, 0, 0, 0, "", EMPTY)


def test_repair_shares_the_nodes_of_common_ends(monkeypatch):
    made = []
    real = turn_repair._node
    monkeypatch.setattr(turn_repair, "_node", lambda letter, rest: made.append(letter) or real(letter, rest))
    words = sorted({"".join(w) for n in range(1, 6) for w in itertools.product("ua", repeat=n)}, key=lambda w: w[::-1])
    ends = turn_repair._Ends()
    for w in words:
        ends.move(w[::-1])
        assert len(ends.nodes) == len(w) + 1
    assert len(made) == len({w[k:] for w in words for k in range(len(w))})


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "b."), (1, 1, "user", ""), (1, 2, "tool", "c.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    audited = turn_repair.audit(frame)
    got = [tuple(r) for r in turn_repair.repaired(frame, audited).orderBy("edit_no").collect()]
    assert [(r.audit, r.cost, r.blank) for r in audited.collect()] == [("RDR", 10, 1)]
    assert got == [(1, 0, "R", "user", "b."), (1, 1, "D", "user", ""), (1, 2, "R", "assistant", "c.")]
