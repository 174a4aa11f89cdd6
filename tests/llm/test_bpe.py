import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from armparity.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def truth(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_are_those_of_the_reference_library(ranks, truth):
    encoder, rng, tokens = bpe.Encoder(ranks, P.PATTERN), random.Random(3), list(ranks)
    texts = ["", " ", "a" * 5000, "the<|endoftext|>", "\n\n \t x", "don't we'll"]
    for k in range(400):
        t = b"".join(rng.choices(tokens, k=rng.randint(1, 8))).decode("utf-8", "ignore")
        texts.append(t.replace(" ", "") * rng.randint(1, 9) if k % 5 == 0 else t)
        texts.append("".join(rng.choices("abé中\U0001f600 \n\tthe1_-", k=rng.randint(0, 60))))
    for text, packed in zip(texts, encoder.packed(texts)):
        assert list(array("I", packed)) == truth(text), text[:80]


def test_full_caches_change_nothing(ranks, truth, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    encoder = bpe.Encoder(ranks, P.PATTERN)
    for text in ("several words of a sentence, then more", "unheardofcompoundwords again", "several words"):
        assert list(array("I", encoder.packed([text])[0])) == truth(text)


def test_characters_cut_by_chunks_are_held_back():
    data = ("Aé中\U0001f600" * 9).encode()
    for size in (1, 2, 3, 5):
        stream = bpe.Utf8Stream()
        parts = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join(parts) + stream.finish() == data.decode() and "\ufffd" not in "".join(parts)
    broken = bpe.Utf8Stream()
    assert broken.feed(b"a\xe4\xb8") + broken.finish() == "a\ufffd"


def test_round_trip(docs_of, truth):
    rows = [(1, "some text, 12 words"), (1, "some text, 12 words"), (2, None), (3, ""), (None, "é" * 30_000), (4, "  \n")]
    docs = docs_of(rows)
    got = bpe.round_trip(docs, PATH, P.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.ids_sha256)), sorted(rows, key=lambda x: (x[0] or 0, hashlib.sha256(array("I", truth(x[1] or "")).tobytes()).hexdigest()))):
        assert (r.doc_id, list(r.ids), r.n_tokens) == (i, truth(t or ""), len(truth(t or "")))
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert sorted((r.text or "", r.decoded) for r in back) == sorted((t or "", t or "") for _, t in rows)
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
