"""Corpus-wide retrieval and text scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armparity.functions import text as T
from armparity.session import written

TOP_K = 4
#: Words counted for one pair of a query and a document that has to be compared; decides how a query is answered, not what is found.
PAIR_COST = 64
WINDOW = 200


def best_documents(queries: DataFrame, documents: DataFrame, rare_limit: int = 100) -> DataFrame:
    """The document sharing most distinct words with each query, first by id among equals; rows of one id are one.

    Joining on every word would pair each query with nearly every document through the
    common words. Of a query's n words that occur, the rarest are joined first, until
    ``rare_limit`` documents are passed; the best of the documents found shares some b
    words. A document that shares b or more lacks at most n - b, so it holds one of the
    n - b + 1 rarest words: joining on those misses none. Queries for which that leaves
    too many documents are counted word by word. Exact at any limit. The texts are read
    once; of their words only those that a query asks for are kept.
    """
    asked = written(queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token")).distinct(), "asked")
    doc_tokens = documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    held = written(doc_tokens.join(asked.select("token").distinct(), "token", "left_semi").select("doc_id", "token"), "held")
    words = written(_rarest_first(asked, held), "words")

    seeds = _overlaps(words.filter(F.col("before") <= rare_limit), words, held)
    least = seeds.groupBy(F.col("query_id").alias("_q")).agg(F.max("overlap").alias("_least"))
    needed = words.join(least, F.col("query_id").eqNullSafe(F.col("_q"))).withColumn("needed", F.col("place") <= F.col("n") - F.col("_least") + 1)
    whole = Window.partitionBy("query_id")
    needed = written(needed.withColumn("selective", F.sum(F.when(F.col("needed"), F.col("df"))).over(whole) * PAIR_COST <= F.sum("df").over(whole)).drop("_q", "_least"), "needed")

    found = _overlaps(needed.filter("selective and needed"), words, held).unionByName(_counted(needed.filter("not selective").join(held, "token")))
    return found.groupBy("query_id").agg(
        F.max_by(F.struct("doc_id", "overlap"), F.struct("overlap", -F.col("doc_id"))).alias("_b")).select("query_id", "_b.doc_id", "_b.overlap")


def _rarest_first(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Each query's words that occur, with the documents ``df`` that hold each, its ``place`` among ``n``, and the documents ``before`` it."""
    frequency = held.groupBy("token").agg(F.count("*").alias("df"))
    whole = Window.partitionBy("query_id")
    order = whole.orderBy("df", "token")
    return asked.join(frequency, "token").select(
        "query_id", "token", "df", F.row_number().over(order).alias("place"), F.count("*").over(whole).alias("n"),
        F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _overlaps(some: DataFrame, words: DataFrame, held: DataFrame) -> DataFrame:
    """``query_id``, ``doc_id``, ``overlap`` over all ``words`` for the documents that hold one of ``some`` words of the query."""
    pairs = written(some.join(held, "token").select(F.col("query_id").alias("_q"), F.col("doc_id").alias("_d")).distinct(), "pairs")
    read = held.join(pairs, F.col("doc_id").eqNullSafe(F.col("_d"))).select("_q", "doc_id", F.col("token").alias("_t"))
    return _counted(read.join(words, F.col("_q").eqNullSafe(F.col("query_id")) & (F.col("_t") == F.col("token"))))


def _counted(shared: DataFrame) -> DataFrame:
    return shared.groupBy("query_id", "doc_id").agg(F.count_distinct("token").alias("overlap"))


def first_chunks(best: DataFrame, documents: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first ``k`` chunks (lines) of each query's document; only the texts that are some query's best are cut."""
    chunks = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    texts = written(best, "best").join(documents.select("doc_id", "text"), "doc_id")
    return texts.withColumn("chunks", F.slice(chunks, 1, k)).drop("text")


def forbidden_hits(documents: DataFrame, phrases: list[tuple[str, list[str]]], key: str, body: str) -> DataFrame:
    """One row per (phrase, document) where the phrase stands outside its excusing contexts.

    The phrase list is configuration: each phrase is an expression, so documents are read
    once and nothing is joined. Occurrences are the non-overlapping ones from the left.
    """
    checks = []
    for phrase, contexts in phrases:
        needle = F.lit(phrase)
        pieces = F.split(F.col("_t"), F.lit("\\Q" + phrase + "\\E"))

        def start(i: Column, pieces=pieces, n=len(phrase)) -> Column:
            before = F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda acc, x: acc + F.length(x))
            return before + (i - 1) * n

        def excused(i: Column, start=start, contexts=contexts, n=len(phrase)) -> Column:
            lo = F.greatest(F.lit(0), start(i) - WINDOW)
            window = F.substring(F.col("_t"), lo + 1, start(i) + n + WINDOW - lo)
            out = F.lit(False)
            for c in contexts:
                out = out | F.contains(window, F.lit(c))
            return out

        checks.append(F.when(F.contains(F.col("_t"), needle), F.when(_any_open(pieces, excused), needle)))
    normal = documents.select(key, T.page_form(F.col(body)).alias("_t"))
    return normal.select(key, F.explode(F.array_compact(F.array(*checks))).alias("phrase"))


def _any_open(pieces: Column, excused) -> Column:
    return F.exists(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: ~excused(i))


def stale_claims(claims: DataFrame, figures: DataFrame, key) -> DataFrame:
    """Claims whose text does not state the figure as recomputed."""
    joined = claims.join(figures, list(key), "left")
    return joined.withColumn("holds", F.coalesce(F.contains("claim", F.col("figure")), F.lit(False)))
