import os
import random
import uuid

import corpus_pipeline
import pytest
from armparity.session import checkpoint_root
from armparity.llm import decontaminate, line_dedup, ngram_join, queries, toxicity
from armparity.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), before.schema)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids
        if name == "toxicity":
            assert ids - now == {r.doc_id for r in toxicity.severity(before, model).filter("toxic").collect()}
        elif name == "line_dedup":
            cut = line_dedup.dedup_lines(before, count="cut").collect()
            assert now == {r.doc_id for r in cut if not r.cut or r.text.strip()}
        elif name == "ngram_join":
            assert now == {r.class_id for r in ngram_join.near_duplicates(before).collect()}
        else:
            assert ids - now == {r.doc_id for r in decontaminate.find_leaks(before, table(spark, SF, "benchmark")).filter("contaminated").collect()}
        ids = now
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(ids) and all(len(r.ids) == r.n_tokens for r in last)


def test_every_number_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.fixture
def folder(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("tor", "mel", "sund", "kar", "vil", "gra") for b in ("na", "ek", "os", "ir", "um", "ed", "ant")]

    def text(n):
        return "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(n))

    place = f"{checkpoint_root(spark).removeprefix('file:')}/{uuid.uuid4().hex}"
    os.makedirs(place)
    rows = [(i, text(6), "en", "s", 1, 0.5, "x") for i in range(40)]
    rows += [(100, None, None, None, 0, 0.0, "x"), (101, "", "en", "s", 0, 0.0, "x"), (102, " \n ", "en", "s", 0, 0.0, "x"), (103, text(900), "en", "s", 0, 0.0, "x"),
             (104, rows[1][1], "en", "s", 0, 0.0, "x"), rows[2], rows[2], (105, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 0, 0.0, "x")]
    schema = "doc_id long, text string, lang string, source string, k1 int, share double, ids string"
    spark.createDataFrame(rows, schema).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def test_nulls_empty_texts_repeats_and_clashing_columns(spark, folder):
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
    # no labels: nothing is toxic; the benchmark's own text goes; of the copies the first stays, and so do texts without words
    assert set(got) == {*range(40), 100, 101, 102, 103}
    assert got.count(2) == 1
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert last[100].n_tokens == last[101].n_tokens == 0 and last[103].n_tokens > 5000


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = f"{folder}-empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_only_the_last_table_stays(spark, folder):
    root = corpus_pipeline.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, folder).count()
    new = [x for x in set(os.listdir(root)) - before if x.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{root}/{new[0]}") == ["3-decontaminate"]


def test_batches_of_a_stage_are_bounded_in_bytes(spark):
    """The long texts of one task came in one batch before."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('some words ', 1500) as text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        corpus_pipeline.tokens(spark, docs, "unused")
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 4 and max(found) < 6 << 20
    finally:
        spark.conf.set(key, before)
