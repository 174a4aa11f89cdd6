"""Retrieval by shared words: one read of the texts, and the same result whichever way a query is settled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from armparity.operators import retrieval as RT

QUERY, DOC = "query_id long, text string", "doc_id long, text string"


def _tables(spark, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    odds = 1 / np.arange(1, 301)
    odds /= odds.sum()
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40), p=odds))) for i in rng.permutation(400)]
    queries = [(i, " ".join(rng.choice(words, 12, p=odds))) for i in range(30)]
    # passages that some documents hold, null texts and ids, and rows of one id
    docs += [(1000 + i, f"{queries[i % 10][1]} {docs[i][1]}") for i in range(20)] + [(2000, None), (None, queries[3][1] + " w7")]
    docs += [(i, f"{text} w1 w2") for i, text in docs[:30]]
    queries += [(99, "nothing shared"), (100, None), (101, ""), (None, "w1 w250"), (5, "w3 w4")]
    return docs, queries, spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, QUERY)


def _brute(docs, queries):
    held, asked, want = {}, {}, {}
    for rows, sets in ((docs, held), (queries, asked)):
        for key, text in rows:
            sets.setdefault(key, set()).update((text or "").split())
    for q, own in asked.items():
        overlap, _, doc = max(((len(own & s), -(d if d is not None else 1 << 60), d) for d, s in held.items()), key=lambda x: x[:2])
        if overlap:
            want[q] = (doc, overlap)
    return want


@pytest.mark.parametrize("cost", [0, 3, 1 << 40])
def test_best_document_is_exact_however_a_query_is_settled(spark, monkeypatch, cost):
    monkeypatch.setattr(RT, "PAIR_COST", cost)
    docs, queries, d, q = _tables(spark, cost % 7)
    for limit in (0, 50):
        got = {r.query_id: (r.doc_id, r.overlap) for r in RT.best_documents(q, d, limit).collect()}
        assert got == _brute(docs, queries), limit


def test_texts_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    _, _, d, q = _tables(spark, 1)
    RT.best_documents(q, d.mapInArrow(seen, DOC)).collect()
    assert reads.value == d.count()


def test_first_chunks(spark):
    d = spark.createDataFrame([(1, "a\n\n b \n  \nc\nd\ne"), (2, "x"), (3, None)], DOC)
    best = spark.createDataFrame([(7, 1), (8, 1), (9, 2), (10, 3)], "query_id long, doc_id long")
    got = {r.query_id: r.chunks for r in RT.first_chunks(best, d).select("query_id", "chunks").collect()}
    assert got == {7: ["a", " b ", "c", "d"], 8: ["a", " b ", "c", "d"], 9: ["x"], 10: None}
    assert set(RT.first_chunks(best.withColumn("overlap", F.lit(1)), d).columns) == {"query_id", "doc_id", "overlap", "chunks"}
